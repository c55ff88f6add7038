"""Personal data by weak supervision.

Rules find spans of four kinds. The strict form of each kind is always kept.
Looser forms (spelled-out addresses, local telephone numbers, other card and
address formats, parts of a number that is too long or fails its check digit)
are candidates, and so are the strict ones: regular-expression, gazetteer and
context labelers vote on each for, against or not at all, by the same rules for
strict and looser forms. Expectation-maximisation over the vote patterns
estimates how often each labeler votes each way on personal spans and on others,
and its posteriors train a logistic span classifier, which alone decides on the
looser candidates.

A vote pattern has three values for each of six labelers, so the counts that
reach the driver are at most 4 * 3^6 rows at any size; they are taken over all
candidates of all documents. Candidates stay in the tables.

Defined results: null texts are empty; repeated rows get one result each; with
no candidates nothing is learned and nothing added.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.texts import byte_class, per_row, text_slices
from vitrine.session import settle

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.85
# Candidates that the first guess of a labeler's votes counts for.
PRIOR = 8.0
NEAR = 40
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match always starts where a run of digits does, so looking back changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

LOOSE = {
    "email": re.compile(
        r"\b[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|@) ?[\])}] ?[A-Za-z0-9-]{1,63}"
        r"(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[A-Za-z0-9-]{2,63}){1,5}"
        r"|\b[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,5}",
        re.IGNORECASE,
    ),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:.])"),
    "card": re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}([ .-])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,4})?(?![0-9A-Za-z.-])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
    ),
}
CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "credit", "payment", "iban", "amex"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact"),
}
AGAINST = ("token", "password", "key", "isbn", "version", "order", "sku", "invoice")
# Common top-level domains, leading digits of card issuers, first digits of country calling codes.
ENDINGS = frozenset(
    "com org net edu gov mil int io co me info biz app dev ai de fr es uk eu it nl be ch at se no dk fi pl pt cz gr ie "
    "ru ua tr us ca mx br ar cl jp cn kr in au nz za il sg hk tw".split()
)
ISSUERS = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6(?:011|5)|35(?:2[89]|[3-8])|62")
CALLING = re.compile(r"1|7|2[0-79]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-24-8]|9[0-9]")
CARD_GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}(?:([ .-])[0-9]{4}){3}(?:\1[0-9]{1,3})?|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}")
AREA = re.compile(r"[2-9][0-9]{2}[2-9][0-9]{6}")
N_LABELERS = 6

SCHEMA = "id long, found array<struct<kind: int, start: int, stop: int, base: boolean, votes: int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def strict_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each at sign outwards, so long words cost nothing."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            low = domain.end()
            yield start, low
            at = text.find("@", low)
        else:
            at = text.find("@", at + 1)


def matched(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the strict forms; (start, end) of the card matches that fail."""
    out = [(0, a, b) for a, b in strict_emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    failed = []
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
        elif len(digits) >= 13:
            failed.append(m.span())
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append((3, *m.span()))
    return out, failed


def strict(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict forms."""
    return matched(text)[0]


def card_parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Cards among whole groups of digits of a failed match, leftmost and longest first; if there
    are none and the length is a card's, all of it."""
    groups = [(start + m.start(), start + m.end()) for m in re.finditer(r"[0-9]+", text[start:end])]
    i, any_part = 0, False
    while i < len(groups):
        size, best = 0, None
        for j in range(i, len(groups)):
            size += groups[j][1] - groups[j][0]
            if size > 19:
                break
            if size >= 13 and luhn(digits_of(text[groups[i][0] : groups[j][1]])):
                best = j
        if best is None:
            i += 1
        else:
            yield groups[i][0], groups[best][1]
            i, any_part = best + 1, True
    if not any_part and 13 <= sum(b - a for a, b in groups) <= 19:
        yield start, end


def form_votes(name: str, own: str) -> tuple[int, int, int]:
    """What form, check and gazetteer say of a span's own characters, whichever rule found it."""
    digits = digits_of(own)
    if name == "email":
        ending = re.split(r"[^A-Za-z0-9-]+", own.rstrip("]) }"))[-1].lower()
        valid = len(ending) > 1 and ending.isalpha()
        return 1 if "@" in own and " " not in own else 0, 1 if valid else -1, 1 if ending in ENDINGS else 0
    if name == "ip" and ":" in own:
        groups = own.split(":")
        return -1 if max(map(len, groups)) < 3 else 1, 1, 1 if groups[0][0] in "23fF" else 0
    if name == "ip":
        parts = own.split(".")
        plain = all(p == "0" or not p.startswith("0") for p in parts)
        return 1, 1 if plain else -1, -1 if int(parts[0]) in (0, 127, 255) else 1
    if name == "card":
        valid = 13 <= len(digits) <= 19 and luhn(digits)
        grouped = CARD_GROUPS.fullmatch(own)
        return 1 if grouped else -1, 1 if valid else -1, 1 if ISSUERS.match(digits) else -1
    abroad = own.startswith("+")
    known = CALLING.match(digits) if abroad else AREA.fullmatch(digits)
    # A local number is checked by the rules of its numbering plan.
    valid = 8 <= len(digits) <= 15 and len(set(digits)) > 2 and (abroad or known)
    return 1 if own[0] in "+(" else 0, 1 if valid else -1, 1 if known else -1


def votes(text: str, kind: int, start: int, end: int, close: bool) -> tuple[int, ...]:
    """+1 personal, -1 not, 0 no opinion: form, check, gazetteer, context, counter-context, company."""
    name = KINDS[kind]
    before = text[max(0, start - NEAR) : start].lower()
    around = before + " " + text[end : end + NEAR].lower()
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    words = set(re.findall(r"[a-z]+", around))
    return (
        *form_votes(name, text[start:end]),
        1 if words & set(CUES[name]) else 0,
        -1 if glued or words & set(AGAINST) else 0,
        1 if close else 0,
    )


def packed(values: tuple[int, ...]) -> int:
    out = 0
    for v in values:
        out = out * 3 + v + 1
    return out


def unpacked(pattern: int) -> np.ndarray:
    out = []
    for _ in range(N_LABELERS):
        out.append(pattern % 3 - 1)
        pattern //= 3
    return np.array(out[::-1])


def spans_of(text: str) -> list[dict[str, object]]:
    """Strict and looser spans with their votes, by kind and start; looser ones overlap no other."""
    base, failed = matched(text)
    taken = sorted((a, b) for _k, a, b in base)
    found = [(k, a, b, True) for k, a, b in base]
    looser = [(2, a, b) for span in failed for a, b in card_parts(text, *span)]
    looser += [(kind, *m.span()) for kind, name in enumerate(KINDS) for m in LOOSE[name].finditer(text)]
    for kind, a, b in looser:
        i = bisect.bisect_left(taken, (b, 0))
        if i and taken[i - 1][1] > a:
            continue
        bisect.insort(taken, (a, b))
        found.append((kind, a, b, False))
    places = sorted(a for _k, a, _b in base)
    out = []
    for kind, a, b, strict_form in sorted(found):
        low = bisect.bisect_left(places, a - 2 * NEAR)
        high = bisect.bisect_right(places, b + 2 * NEAR)
        close = high - low > (1 if strict_form else 0)
        pattern = packed(votes(text, kind, a, b, close))
        out.append({"kind": kind, "start": a, "stop": b, "base": strict_form, "votes": pattern})
    return out


MARKED = byte_class((0x30, 0x39), (0x40, 0x40), (0x5B, 0x5B), (0x28, 0x28), (0x7B, 0x7B), (0x3A, 0x3A))
FOUND = pa.list_(
    pa.struct(
        [("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32())]
    )
)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_slices(batches, "text"):
        # Every form holds a digit, an at sign, a bracket or a colon, or else the word "dot".
        marked = per_row(MARKED[data], offsets) > 0
        marked |= pc.match_substring(rows.column("text"), " dot ", ignore_case=True).fill_null(False).to_numpy(False)
        texts = rows.column("text")
        found = [spans_of(texts[i].as_py()) if m else [] for i, m in enumerate(marked.tolist())]
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(found, FOUND)], ["id", "found"])


@dataclass
class Reliability:
    """``votes[c, j, v]``: chance that labeler j votes v - 1 on a span of class c (0 not personal, 1 personal);
    ``share``: how many spans are personal."""

    votes: np.ndarray
    share: float

    @property
    def right(self) -> np.ndarray:
        """How often each labeler, when it votes, is right: (not personal, personal) x labelers."""
        cast = self.votes[:, :, 0] + self.votes[:, :, 2]
        return np.stack([self.votes[0, :, 0], self.votes[1, :, 2]]) / cast

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of personal."""
        said = np.log(self.votes[1] / self.votes[0])
        log_odds = said[np.arange(patterns.shape[1]), patterns + 1].sum(1) + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Reliability:
    """Dawid-Skene over vote patterns with counts; keeping silent is one of three votes.

    Each labeler starts as one that is more often right than wrong, which counts
    for ``PRIOR`` candidates and so fades as they grow; it names the two classes.
    """
    guess = PRIOR * np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]])[:, None, :]
    said = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = 1 / (1 + np.exp(-patterns.sum(1, dtype=float)))
    model = None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        votes = np.einsum("cn,njv->cjv", weight, said) + guess
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        model = Reliability(votes / votes.sum(2, keepdims=True), float(share))
        good = model.posterior(patterns)
    return model


def features(kinds: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    return np.concatenate(
        [np.ones((len(kinds), 1)), patterns > 0, patterns < 0, np.eye(len(KINDS))[kinds]], axis=1
    ).astype(float)


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """Weighted logistic regression on soft targets with a small ridge."""
    w = np.zeros(x.shape[1])
    share = weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (share * (p - target)) + 1e-4 * w)
    return w


def accepted(counted: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int]]:
    """(kind, votes) that the trained classifier takes for personal."""
    if not counted:
        return []
    kinds = np.array([k for k, _v, _n in counted])
    patterns = np.stack([unpacked(v) for _k, v, _n in counted])
    counts = np.array([n for _k, _v, n in counted], float)
    target = expectation_maximisation(patterns, counts).posterior(patterns)
    x = features(kinds, patterns)
    # Rare patterns weigh by the root of their count, so that common forms do not drown them.
    p = 1 / (1 + np.exp(-x @ logistic(x, target, np.sqrt(counts))))
    return [(k, v) for (k, v, _n), q in zip(counted, p) if q >= threshold]


def personal_spans(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, found, kept): all candidates, and those that are personal, by kind and start."""
    plain = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    scanned = settle(plain.mapInArrow(candidates, SCHEMA))
    counted = (
        scanned.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes").agg(F.count("*").alias("n")).collect()
    )
    taken = accepted(sorted((r.kind, r.votes, r.n) for r in counted), threshold)
    wanted = F.array(*(F.lit(k * 3**N_LABELERS + v) for k, v in taken)).cast("array<int>")

    def personal(f: Column) -> Column:
        return f.base | F.array_contains(wanted, f.kind * F.lit(3**N_LABELERS) + f.votes)

    return scanned.withColumn("kept", F.filter("found", personal))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s.kind + 1), s.start, s.stop)), ","
    )


def count_of(kind: int) -> Column:
    return F.size(F.filter("found", lambda f: f.base & (f.kind == kind))).cast("long")
