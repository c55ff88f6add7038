"""A gated recurrent language model in numpy with a class-factored output.

Words are numbered by falling frequency; ``span`` neighbouring numbers form a
class and one more class stands for all other words, so a word's probability is
that of its class times its share within the class. Inputs go straight into the
gates, one row per word. Training is back-propagation through time, truncated
to windows of ``STEPS``, with the state carried into the next window; the output
loss takes every position, and what fills up the last lane has no loss.
Scoring carries the state through a whole document, however long.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
STEPS = 16
LANES = 512
SCORE_STEPS = 64
SCORE_LANES = 256
# One of so many positions has a loss: all of them.
LOSS_SHARE = 1
RATE = 0.1
NO_TARGET = -1


@dataclass
class Model:
    inputs: np.ndarray  # (words + 1, 3 * hidden): update gate, reset gate, candidate
    recurrent: np.ndarray  # (hidden, 3 * hidden)
    classes: np.ndarray  # (hidden + 1, classes + 1), the last row is the bias
    words: np.ndarray  # (classes, hidden + 1, span)

    @property
    def n_words(self) -> int:
        return len(self.inputs) - 1

    @property
    def span(self) -> int:
        return self.words.shape[2]

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.classes, self.words]

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def with_packed(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parameters():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*out)


def fresh(counts: np.ndarray, others: int, span: int, seed: int = 1) -> Model:
    """A model that starts from word frequencies; ``counts`` fall, ``others`` is the rest."""
    rng = np.random.RandomState(seed)
    n = len(counts)
    n_classes = -(-n // span)
    padded = np.zeros(n_classes * span)
    padded[:n] = counts
    padded = padded.reshape(n_classes, span)
    words = (rng.randn(n_classes, HIDDEN + 1, span) * 0.05).astype(np.float32)
    most = padded.max(1, keepdims=True, initial=1)
    words[:, HIDDEN] = np.where(padded > 0, np.log(np.maximum(padded, 1) / most), -1e9)
    classes = (rng.randn(HIDDEN + 1, n_classes + 1) * 0.05).astype(np.float32)
    share = np.append(padded.sum(1), others) + 1.0
    classes[HIDDEN] = np.log(share / share.max())
    inputs = (rng.randn(n + 1, 3 * HIDDEN) * 0.3).astype(np.float32)
    inputs[:, :HIDDEN] += 1.0
    recurrent = (rng.randn(HIDDEN, 3 * HIDDEN) * 0.25).astype(np.float32)
    return Model(inputs, recurrent, classes, words)


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of each row, their sums, and the shift taken off before.

    Rows are shifted by their maximum only if some row would overflow or vanish.
    """
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        total = e @ np.ones(e.shape[1], np.float32)
    if np.isfinite(total).all() and total.all():
        return e, total, np.zeros(1, np.float32)
    shift = logits.max(1)
    e = np.exp(logits - shift[:, None])
    return e, e.sum(1), shift


def picked_logs(logits: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Log-softmax of one column of each row."""
    _e, total, shift = exponentials(logits)
    return logits[np.arange(len(columns)), columns] - shift - np.log(total)


def softmax(logits: np.ndarray) -> np.ndarray:
    e, total, _shift = exponentials(logits)
    e *= (1 / total)[:, None]
    return e


def with_one(states: np.ndarray) -> np.ndarray:
    return np.concatenate([states, np.ones((len(states), 1), np.float32)], axis=1)


def class_runs(targets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of the targets by class, their classes in it, and its (class, from, to) runs of words,
    which come first."""
    classes = targets // model.span
    classes[targets >= model.n_words] = len(model.words)
    # Small numbers sort in linear time.
    order = np.argsort(classes.astype(np.int16), kind="stable")
    classes = classes[order]
    bounds = np.searchsorted(classes, np.arange(len(model.words) + 1)).tolist()
    return order, classes, [(c, a, b) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]


def word_logits(model: Model, states: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits within its class of every row of the runs; the exponentials are then taken of all at once."""
    out = np.empty((found[-1][2] if found else 0, model.span), np.float32)
    for c, a, b in found:
        np.matmul(states[a:b], model.words[c], out=out[a:b])
    return out


def log_probabilities(model: Model, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target; words outside the vocabulary get their class's."""
    order, classes, found = class_runs(targets, model)
    states = with_one(states[order])
    logs = picked_logs(states @ model.classes, classes)
    logits = word_logits(model, states, found)
    inside = len(logits)
    logs[:inside] += picked_logs(logits, targets[order[:inside]] - classes[:inside] * model.span)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def forward(model: Model, inputs: np.ndarray, starts: np.ndarray, state: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """States after each step; ``starts`` marks steps before which the state is cleared.

    The lanes of a hidden unit lie side by side, so that every operation runs along them;
    ``kept`` gets arrays (hidden, steps, lanes).
    """
    steps, lanes = inputs.shape
    gates = model.inputs[inputs]
    across = np.ascontiguousarray(model.recurrent.T)
    states = np.empty((HIDDEN, steps, lanes), np.float32)
    state = state.T
    if kept is not None:
        kept |= {k: np.empty((HIDDEN, steps, lanes), np.float32) for k in ("before", "z", "r", "n", "candidate")}
    any_start = starts.any(1)
    for t in range(steps):
        if any_start[t]:
            state = state * ~starts[t]
        gate = gates[t].T
        own = across @ state
        both = own[: 2 * HIDDEN]
        both += gate[: 2 * HIDDEN]
        sigmoid(both)
        z, r, candidate = both[:HIDDEN], both[HIDDEN:], own[2 * HIDDEN :]
        n = r * candidate
        n += gate[2 * HIDDEN :]
        np.tanh(n, out=n)
        if kept is not None:
            for k, v in (("before", state), ("z", z), ("r", r), ("n", n), ("candidate", candidate)):
                kept[k][:, t] = v
        state = state - n
        state *= z
        state += n
        states[:, t] = state
    return states.transpose(1, 2, 0)


class Trainer:
    """Adagrad over truncated windows."""

    def __init__(self, model: Model, seed: int) -> None:
        self.model = model
        self.rng = np.random.RandomState(seed)
        self.squares = [np.full(p.shape, 1e-8, np.float32) for p in model.parameters()]
        self.tokens = 0

    def step(self, which: int, gradient: np.ndarray, rows: np.ndarray | int | None = None) -> None:
        p, s = self.model.parameters()[which], self.squares[which]
        if rows is None:
            s += gradient * gradient
            p -= RATE * gradient / np.sqrt(s)
        else:
            own = s[rows] + gradient * gradient
            s[rows] = own
            p[rows] -= RATE * gradient / np.sqrt(own)

    def train(self, tokens: np.ndarray, first: np.ndarray, end: int) -> None:
        """Documents one after another in ``tokens``, each ending with ``end``; ``first`` marks their starts."""
        lanes = int(min(LANES, max(1, len(tokens) // (STEPS * 40))))
        length = -(-len(tokens) // lanes)
        if length == 0:
            return
        before = np.concatenate([[end], tokens[:-1]])
        filled = lanes * length - len(tokens)

        def cut(x: np.ndarray, rest: int) -> np.ndarray:
            whole = np.concatenate([x, np.full(filled, rest, x.dtype)])
            return np.ascontiguousarray(whole.reshape(lanes, length).T)

        inputs, targets, starts = cut(before, end), cut(tokens, NO_TARGET), cut(first, False)
        starts[0] = True
        inputs[0] = end
        state = np.zeros((lanes, HIDDEN), np.float32)
        for low in range(0, length, STEPS):
            state = self.window(inputs[low : low + STEPS], targets[low : low + STEPS], starts[low : low + STEPS], state)
        self.tokens += len(tokens)

    def window(self, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray, state: np.ndarray) -> np.ndarray:
        model = self.model
        kept: dict[str, np.ndarray] = {}
        states = forward(model, inputs, starts, state, kept)
        flat = states.reshape(-1, HIDDEN)
        wanted = targets.ravel() != NO_TARGET
        picked = np.flatnonzero(wanted & (self.rng.randint(0, LOSS_SHARE, len(flat)) == 0))
        if len(picked) == 0:
            return states[-1]
        back = np.zeros((HIDDEN, len(flat)), np.float32)
        back[:, picked] = self.output(flat[picked], targets.ravel()[picked]).T
        steps, lanes = inputs.shape
        back = back.reshape(HIDDEN, steps, lanes)

        before, z, r, n, candidate = (kept[k] for k in ("before", "z", "r", "n", "candidate"))
        to_z = (before - n) * z * (1 - z)
        to_n = (1 - z) * (1 - n * n)
        to_r = candidate * r * (1 - r)
        gate = np.empty((3 * HIDDEN, steps, lanes), np.float32)
        own = np.empty_like(gate)
        carried = np.zeros((HIDDEN, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            d = back[:, t] + carried
            dn = d * to_n[:, t]
            o = own[:, t]
            np.multiply(d, to_z[:, t], out=o[:HIDDEN])
            np.multiply(dn, to_r[:, t], out=o[HIDDEN : 2 * HIDDEN])
            np.multiply(dn, r[:, t], out=o[2 * HIDDEN :])
            gate[2 * HIDDEN :, t] = dn
            carried = model.recurrent @ o
            carried += d * z[:, t]
            if starts[t].any():
                carried *= ~starts[t]
        gate[: 2 * HIDDEN] = own[: 2 * HIDDEN]
        self.step(1, before.reshape(HIDDEN, -1) @ own.reshape(3 * HIDDEN, -1).T)
        words = inputs.ravel()
        met = np.zeros(len(model.inputs), bool)
        met[words] = True
        rows = np.flatnonzero(met)
        place = (np.cumsum(met) - 1)[words]
        sums = [np.bincount(place, weights, len(rows)) for weights in gate.reshape(3 * HIDDEN, -1)]
        self.step(0, np.array(sums, np.float32).T, rows)
        return states[-1]

    def output(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """One step of the output layer; the gradient of the states."""
        model, n = self.model, len(targets)
        order, classes, found = class_runs(targets, model)
        full = with_one(states[order])
        error = softmax(full @ model.classes)
        error[np.arange(n), classes] -= 1
        back = error @ model.classes[:HIDDEN].T
        self.step(2, full.T @ error / n)
        error = softmax(word_logits(model, full, found))
        inside = np.arange(len(error))
        error[inside, targets[order[inside]] - classes[inside] * model.span] -= 1
        gradient = np.empty((len(found), HIDDEN + 1, model.span), np.float32)
        for i, (c, a, b) in enumerate(found):
            e = error[a:b]
            back[a:b] += e @ model.words[c][:HIDDEN].T
            np.matmul(full[a:b].T, e, out=gradient[i])
        gradient /= n
        self.step(3, gradient, np.array([c for c, _a, _b in found], np.int64))
        back /= n
        out = np.empty_like(back)
        out[order] = back
        return out


def score(model: Model, documents: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-probability of each document, state carried from its first word to its end."""
    size = np.array([len(d) for d in documents])
    total = np.zeros(len(documents))
    if not len(documents):
        return total
    lanes = int(min(SCORE_LANES, len(size), max(1, 2 * size.sum() // size.max())))
    # Longest first onto the least loaded lane.
    load = [(0, k) for k in range(lanes)]
    place = np.zeros((len(documents), 2), np.int64)
    for d in np.argsort(-size, kind="stable").tolist():
        at, k = heapq.heappop(load)
        place[d] = at, k
        heapq.heappush(load, (at + int(size[d]), k))
    lengths = np.zeros(lanes, np.int64)
    for at, k in load:
        lengths[k] = at
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(lanes)
    lengths = np.sort(lengths)[::-1]
    steps = int(lengths[0])
    inputs = np.full((steps, lanes), end, np.int32)
    targets = np.full((steps, lanes), end, np.int32)
    owner = np.full((steps, lanes), -1, np.int32)
    starts = np.zeros((steps, lanes), bool)
    for d, words in enumerate(documents):
        at, k = int(place[d, 0]), rank[place[d, 1]]
        targets[at : at + len(words), k] = words
        inputs[at + 1 : at + len(words), k] = words[:-1]
        owner[at : at + len(words), k] = d
        starts[at, k] = True
    state = np.zeros((lanes, HIDDEN), np.float32)
    for low in range(0, steps, SCORE_STEPS):
        active = int((lengths > low).sum())
        cut = (slice(low, low + SCORE_STEPS), slice(0, active))
        states = forward(model, inputs[cut], starts[cut], state[:active])
        state = states[-1]
        mine = owner[cut].ravel()
        live = np.flatnonzero(mine >= 0)
        logs = log_probabilities(model, states.reshape(-1, HIDDEN)[live], targets[cut].ravel()[live])
        total += np.bincount(mine[live], weights=logs, minlength=len(documents))
    return total
