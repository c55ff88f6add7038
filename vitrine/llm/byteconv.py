"""Language identification by a byte convolutional network written in numpy.

Filters of several widths slide over the bytes, the strongest response of each
filter in a window is kept (max pooling), and a softmax over those names the
language. A window is 256 starting positions; every window of the whole text is
scored and a text takes the mean of its windows' probabilities.

The network is fitted on a bounded sample of labelled windows: at most
``per_language`` texts a language and ``sample`` texts in all, the smallest by a
hash of their id and text, two windows each; repeated rows count once. The bound is a parameter; everything else
covers all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if there is nothing to learn from; null and repeated ids are
scored like any other and a null id is never learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.texts import text_slices
from vitrine.session import settle

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PAD = 256
REACH = max(WIDTHS) - 1
SAMPLE = 8192
PER_LANGUAGE = 1536
EPOCHS = 4
BATCH = 64
RATE = 0.01
BROADCAST_NAMES = 100_000
BROADCAST_BYTES = 16 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """``kernels[i]`` is (width, 257, filters) over one-hot bytes; the pad byte weighs nothing."""

    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]

    def parameters(self) -> list[np.ndarray]:
        return [*self.kernels, self.bias, self.out, self.out_bias]


def fresh(languages: list[str], rng: np.random.RandomState) -> Network:
    kernels = [(rng.randn(w, 257, FILTERS) * 0.3).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, PAD] = 0
    n = FILTERS * len(WIDTHS)
    return Network(
        kernels,
        np.zeros(n, np.float32),
        (rng.randn(n, len(languages)) * 0.1).astype(np.float32),
        np.zeros(len(languages), np.float32),
        languages,
    )


def responses(net: Network, symbols: np.ndarray) -> np.ndarray:
    """(windows, positions, filters) of windows given with their reach."""
    parts = []
    for kernel, width in zip(net.kernels, WIDTHS):
        part = kernel[0][symbols[:, :WINDOW]]
        for offset in range(1, width):
            part = part + kernel[offset][symbols[:, offset : offset + WINDOW]]
        parts.append(part)
    all_parts = np.concatenate(parts, axis=2)
    all_parts[symbols[:, :WINDOW] == PAD] = -1e9
    return all_parts


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(symbols: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 1) -> Network:
    """Adam on the cross entropy; pooling passes the gradient to the strongest position only."""
    rng = np.random.RandomState(seed)
    net = fresh(languages, rng)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            pick = order[low : low + BATCH]
            own, wanted = symbols[pick], labels[pick]
            conv = responses(net, own)
            at = conv.argmax(1)
            pooled = np.maximum(np.take_along_axis(conv, at[:, None], 1)[:, 0] + net.bias, 0)
            probability = softmax(pooled @ net.out + net.out_bias)
            probability[np.arange(len(pick)), wanted] -= 1
            error = probability / len(pick)
            back = (error @ net.out.T) * (pooled > 0)
            gradients = []
            row = np.repeat(np.arange(len(pick)), FILTERS)
            for i, width in enumerate(WIDTHS):
                cut = slice(i * FILTERS, (i + 1) * FILTERS)
                gradient = np.zeros_like(net.kernels[i])
                column = np.tile(np.arange(FILTERS), len(pick))
                for offset in range(width):
                    np.add.at(
                        gradient[offset], (own[row, at[:, cut].ravel() + offset], column), back[:, cut].ravel()
                    )
                gradient[:, PAD] = 0
                gradients.append(gradient)
            gradients += [back.sum(0), pooled.T @ error, error.sum(0)]
            step += 1
            for p, g, (m, v) in zip(net.parameters(), gradients, state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, each filled up to whole windows, and the windows of each row."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    first = np.cumsum(count) - count
    symbols = np.full(int(count.sum()) * WINDOW + REACH, PAD, np.uint16)
    shift = np.repeat(first * WINDOW - offsets[:-1], size)
    symbols[np.arange(len(data)) + shift] = data
    return symbols, count


class Scorer:
    """A fitted network with its kernels folded into tables over byte pairs."""

    def __init__(self, net: Network) -> None:
        self.net = net
        two, three, four = net.kernels
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(257 * 257, FILTERS)
        self.first = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1)
        self.third = np.ascontiguousarray(three[2])
        self.last = pair(four[2], four[3])

    def windows(self, symbols: np.ndarray) -> np.ndarray:
        """Probabilities (windows, languages); a window sees ``REACH`` bytes into the next one."""
        n = (len(symbols) - REACH) // WINDOW
        out = np.empty((n, len(self.net.languages)), np.float32)
        rows = np.lib.stride_tricks.sliding_window_view(symbols, WINDOW + REACH)[::WINDOW]
        for low in range(0, n, BATCH):
            own = rows[low : low + BATCH].astype(np.int32)
            # A window that ends with its row must not see the next row.
            own[:, WINDOW:][own[:, WINDOW - 1] == PAD] = PAD
            pairs = own[:, :-1] * 257 + own[:, 1:]
            conv = self.first[pairs[:, :WINDOW]]
            conv[:, :, FILTERS : 2 * FILTERS] += self.third[own[:, 2 : WINDOW + 2]]
            conv[:, :, 2 * FILTERS :] += self.last[pairs[:, 2 : WINDOW + 2]]
            conv[own[:, :WINDOW] == PAD] = -1e9
            pooled = np.maximum(conv.max(1) + self.net.bias, 0)
            out[low : low + BATCH] = softmax(pooled @ self.net.out + self.net.out_bias)
        return out


def sampled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two windows of every text, at places given by its order."""
    for rows, data, offsets in text_slices(batches, "text"):
        order = rows.column("order").to_numpy().view(np.uint64)
        room = np.maximum(np.diff(offsets) - WINDOW - REACH, 0).astype(np.uint64) + np.uint64(1)
        out = []
        for half in (np.uint64(0), np.uint64(32)):
            start = offsets[:-1] + ((order >> half) % room).astype(np.int64)
            stop = np.minimum(start + WINDOW + REACH, offsets[1:])
            out.append(pa.array([data[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist())], pa.binary()))
        yield pa.RecordBatch.from_arrays(
            [rows.column("lang"), rows.column("order"), *out], ["lang", "order", "one", "two"]
        )


def window_symbols(window: bytes) -> np.ndarray:
    out = np.full(WINDOW + REACH, PAD, np.int64)
    out[: len(window)] = np.frombuffer(window, np.uint8)
    return out


def learned(docs: DataFrame, usable: Column, sample: int, per_language: int) -> Network | None:
    """The network fitted on the bounded sample of the usable rows' windows.

    Each language's rows are counted first, so that little more than its part of
    the sample is cut into windows and ranked, however many rows it has.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(
        "text", "lang", F.xxhash64("id", "text").alias("order")
    )
    counts = settle(rows.groupBy("lang").agg(F.count("*").alias("n")))
    # Texts stay in place unless there are very many languages or very long names.
    names, size = counts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("lang")), F.lit(0))).first()
    if names <= BROADCAST_NAMES and size <= BROADCAST_BYTES:
        counts = F.broadcast(counts)
    # Eight standard deviations more than wanted, as a share of all orders.
    share = (per_language + 8 * per_language**0.5) / F.col("n")
    near = rows.join(counts, "lang").filter(F.shiftrightunsigned("order", 11) < share * float(1 << 53))
    by_language = Window.partitionBy("lang").orderBy("order", "one")
    chosen = (
        near.select("text", "lang", "order")
        .mapInArrow(sampled_windows, "lang string, order long, one binary, two binary")
        .distinct()
        .withColumn("rank", F.row_number().over(by_language))
        .filter(F.col("rank") <= per_language)
        .orderBy("rank", "lang")
        .limit(sample)
        .collect()
    )
    if not chosen:
        return None
    languages = sorted({r.lang for r in chosen})
    index = {x: i for i, x in enumerate(languages)}
    symbols = np.stack([window_symbols(bytes(w)) for r in chosen for w in (r.one, r.two)])
    labels = np.array([index[r.lang] for r in chosen for _ in range(2)])
    return fit(symbols, labels, languages)


def predictor(net: Network | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net is not None else None
        for rows, data, offsets in text_slices(batches, "text", 1 << 20):
            lettered = [bool(t and LETTER.search(t)) for t in rows.column("text").to_pylist()]
            names: list[str] = [UNKNOWN] * len(lettered)
            scores = [0.0] * len(lettered)
            if scorer is not None and len(data):
                symbols, count = padded(data, offsets)
                found = scorer.windows(symbols).astype(np.float64)
                first = np.append(0, np.cumsum(count))
                total = np.vstack([np.zeros(found.shape[1]), np.cumsum(found, 0)])
                for i in np.flatnonzero(lettered).tolist():
                    mean = (total[first[i + 1]] - total[first[i]]) / count[i]
                    best = int(mean.argmax())
                    names[i], scores[i] = scorer.net.languages[best], min(1.0, max(0.0, float(mean[best])))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "lang_pred", "score"],
            )

    return predict


def languages(
    docs: DataFrame,
    usable: Column,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """(id, lang_pred, score) of every document; ``usable`` (over ``id``) tells what to learn from."""
    plain = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"),
    )
    net = learned(plain, usable, sample, per_language)
    return plain.select("id", "text").mapInArrow(predictor(net), "id long, lang_pred string, score double")
