"""A gated recurrent language model in numpy, with a softmax factored into classes.

Words are numbered by falling frequency and cut into classes of about equal summed square roots of frequency, so common
words are in small classes: ``P(word | state) = P(class | state) * P(word | class, state)``. Training goes through
streams of documents in windows: gradients stop at a window's start, states are carried over it and cleared where a
document begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WINDOW = 32
STREAMS = 64
# Words whose probabilities are worked out at a time: what fits a core's cache.
COLUMNS = 16_384


def class_edges(counts: np.ndarray, classes: int) -> np.ndarray:
    """First word of each class, and the number of words at the end."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1e-9)))
    wanted = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes, side="right")
    return np.unique(np.concatenate([[0], wanted, [len(counts)]]))


@dataclass
class Gru:
    """``inputs`` holds what each word adds to the gates (update, reset, candidate), gate by gate in memory."""

    edges: np.ndarray
    inputs: np.ndarray
    recurrent: np.ndarray
    class_weights: np.ndarray
    class_bias: np.ndarray
    word_weights: np.ndarray
    word_bias: np.ndarray

    @property
    def hidden(self) -> int:
        return len(self.recurrent)

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))

    def parameters(self) -> list[np.ndarray]:
        return [
            self.inputs, self.recurrent, self.class_weights, self.class_bias, self.word_weights, self.word_bias,
        ]

    def step(self, words: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and the update gate, reset gate, candidate and recurrent candidate part."""
        return tuple(x.T for x in self.advance(words, state.T))

    def advance(self, words: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """``step`` with one column per word, so that every operation runs along memory."""
        n = self.hidden
        given, carried = np.take(self.inputs.T, words, axis=1), self.recurrent.T @ state
        gates = given[: 2 * n] + carried[: 2 * n]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        update, reset, part = gates[:n], gates[n:], carried[2 * n :]
        candidate = reset * part
        candidate += given[2 * n :]
        np.tanh(candidate, out=candidate)
        following = state - candidate
        following *= update
        following += candidate
        return following, update, reset, candidate, part

    def by_class(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each word, the order that brings classes together, and where each class begins in it."""
        classes = self.class_of[words]
        order = np.argsort(classes, kind="stable")
        return classes, order, np.cumsum([0, *np.bincount(classes, minlength=len(self.edges) - 1)])

    def log_probabilities(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability in its state."""
        return self.log_chances(states.T, words)

    def log_chances(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """``log_probabilities`` with one column per word."""
        if len(words) > COLUMNS:
            cuts = range(COLUMNS, len(words), COLUMNS)
            parts = zip(np.split(states, cuts, axis=1), np.split(words, cuts), strict=True)
            return np.concatenate([self.log_chances(*part) for part in parts])
        classes, order, bounds = self.by_class(words)
        out = _chosen(self.class_weights.T @ states + self.class_bias[:, None], classes)
        states, inside = states[:, order], (words - self.edges[classes])[order]
        for k in np.flatnonzero(np.diff(bounds)):
            low, high = self.edges[k], self.edges[k + 1]
            if high - low == 1:
                continue
            at = slice(bounds[k], bounds[k + 1])
            inner = self.word_weights[low:high] @ states[:, at] + self.word_bias[low:high, None]
            out[order[at]] += _chosen(inner, inside[at])
        return out

    def output_gradients(self, states: np.ndarray, words: np.ndarray, into: list[np.ndarray]) -> np.ndarray:
        """Adds the output layer's gradients of the summed loss; returns those of the states, one column per word."""
        classes, order, bounds = self.by_class(words)
        error = _errors(self.class_weights.T @ states + self.class_bias[:, None], classes)
        into[2] += states @ error.T
        into[3] += error.sum(1)
        back = self.class_weights @ error
        states, inside = states[:, order], (words - self.edges[classes])[order]
        back_words = np.zeros_like(back)
        for k in np.flatnonzero(np.diff(bounds)):
            low, high = self.edges[k], self.edges[k + 1]
            if high - low == 1:
                continue
            at = slice(bounds[k], bounds[k + 1])
            error = _errors(self.word_weights[low:high] @ states[:, at] + self.word_bias[low:high, None], inside[at])
            into[4][low:high] += error @ states[:, at].T
            into[5][low:high] += error.sum(1)
            back_words[:, at] = self.word_weights[low:high].T @ error
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        back += back_words[:, place]
        return back

    def score(self, documents: list[np.ndarray], start: int, window: int = 64) -> np.ndarray:
        """Summed log probability of each whole document. ``start`` is the word that stands before every document.

        Documents go side by side, longest first; those that have ended fall away at the end of the block. States are
        carried from window to window, so memory does not grow with a document's length.
        """
        total = np.zeros(len(documents))
        lengths = np.array([len(d) for d in documents])
        order = np.argsort(-lengths, kind="stable")
        active = int((lengths > 0).sum())
        state = np.zeros((self.hidden, active), np.float32)
        last = np.full(active, start, np.int64)
        # Columns are documents in this order; laid out once, and cut by window.
        flat = np.concatenate([documents[i] for i in order[:active]]) if active else np.empty(0, np.int64)
        begins = np.cumsum(lengths[order[:active]]) - lengths[order[:active]]
        left = lengths[order[:active]]
        at = 0
        while active:
            states, words, owners = [], [], []
            for step in range(at, at + window):
                active = int(np.searchsorted(-left, -step, side="left"))
                if not active:
                    break
                state = self.advance(last[:active], state[:, :active])[0]
                last = flat[begins[:active] + step]
                states.append(state)
                words.append(last)
                owners.append(order[:active])
            if states:
                found = self.log_chances(np.concatenate(states, axis=1), np.concatenate(words))
                total += np.bincount(np.concatenate(owners), found, minlength=len(documents))
            at += window
        return total


def _chosen(logits: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per column, the log probability of its row; ``logits`` is overwritten."""
    columns = np.arange(len(rows))
    logits -= logits.max(0)
    out = logits[rows, columns]
    np.exp(logits, out=logits)
    return out - np.log(logits.sum(0))


def _errors(logits: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities less one at each column's row; ``logits`` is overwritten."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    logits[rows, np.arange(len(rows))] -= 1
    return logits


def untrained(counts: np.ndarray, hidden: int, classes: int, rng: np.random.Generator) -> Gru:
    """Biases that give each word its frequency, whatever the state."""
    counts = np.maximum(counts, 0.5)
    edges = class_edges(counts, classes)
    sums = np.add.reduceat(counts, edges[:-1])
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Gru(
        edges,
        np.asfortranarray(small(len(counts), 3 * hidden)),
        small(hidden, 3 * hidden),
        small(hidden, len(sums)),
        np.log(sums / sums.sum()).astype(np.float32),
        small(len(counts), hidden),
        np.log(counts / np.repeat(sums, np.diff(edges))).astype(np.float32),
    )


def _windows(
    documents: list[np.ndarray], start: int, rng: np.random.Generator, most: int
) -> Iterator[tuple[np.ndarray, ...]]:
    """Inputs, targets and starts of documents, ``WINDOW`` steps of at most ``most`` streams at a time; what does not
    fill the streams comes last, in one."""
    shuffled = [documents[i] for i in rng.permutation(len(documents))]
    targets = np.concatenate(shuffled)
    inputs = np.concatenate([[start], targets[:-1]])
    begins = np.zeros(len(targets), bool)
    begins[np.cumsum([0, *map(len, shuffled[:-1])])] = True
    inputs[begins] = start
    streams = max(1, min(most, len(targets) // WINDOW))
    steps = len(targets) // streams
    cut = [x[: streams * steps].reshape(streams, steps).T for x in (inputs, targets, begins)]
    for at in range(0, steps, WINDOW):
        yield tuple(x[at : at + WINDOW] for x in cut)
    if streams * steps < len(targets):
        yield tuple(x[streams * steps :, None] for x in (inputs, targets, begins))


def train(
    documents: list[np.ndarray],
    counts: np.ndarray,
    start: int,
    hidden: int = 24,
    classes: int = 40,
    epochs: int = 3,
    rate: float = 0.01,
    seed: int = 5,
) -> Gru:
    """A new model fitted to documents, which are arrays of word numbers that end with the end word."""
    rng = np.random.default_rng(seed)
    return improve(untrained(counts, hidden, classes, rng), documents, start, epochs, rate, rng)


def improve(
    model: Gru,
    documents: list[np.ndarray],
    start: int,
    epochs: int,
    rate: float,
    rng: np.random.Generator,
    streams: int = STREAMS,
) -> Gru:
    """Adam on windows, from the model's weights on; they are changed in place."""
    documents = [d for d in documents if len(d)]
    if not documents:
        return model
    parameters = model.parameters()
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    done, expected = 0, max(1, epochs * -(-sum(map(len, documents)) // (WINDOW * streams)))
    for _ in range(epochs):
        state = None
        for inputs, targets, begins in _windows(documents, start, rng, streams):
            if state is None or len(state) != inputs.shape[1]:
                state = np.zeros((inputs.shape[1], model.hidden), np.float32)
            gradients, state = _window_gradients(model, inputs, targets, begins, state)
            done += 1
            pace = rate * max(0.05, 1 - done / expected)
            for p, g, m, v in zip(parameters, gradients, first, second, strict=True):
                g /= targets.size
                np.clip(g, -1, 1, out=g)
                m *= 0.9
                m += 0.1 * g
                g *= g
                g *= 0.01
                v *= 0.99
                v += g
                # What the weights move by, worked out in the gradient's place.
                np.multiply(v, 1 / (1 - 0.99**done), out=g)
                np.sqrt(g, out=g)
                g += 1e-8
                np.divide(m, g, out=g)
                g *= pace / (1 - 0.9**done)
                p -= g
    return model


def _window_gradients(
    model: Gru, inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray, state: np.ndarray
) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of one window by backpropagation to its start, and the state at its end."""
    n, kept, state = model.hidden, [], state.T
    for words, begin in zip(inputs, begins, strict=True):
        if begin.any():
            state = np.where(begin, state.dtype.type(0), state)
        following, *parts = model.advance(words, state)
        kept.append((begin, state, following, *parts))
        state = following
    gradients = [np.zeros_like(p) for p in model.parameters()]
    # What the output sees is the state after each step, before it is cleared for a new document.
    outputs = np.concatenate([k[2] for k in kept], axis=1)
    back_out = model.output_gradients(outputs, targets.reshape(-1), gradients)
    width = inputs.shape[1]
    given, into_recurrent = np.empty((3 * n, inputs.size), state.dtype), np.empty((3 * n, inputs.size), state.dtype)
    carried = np.zeros_like(state)
    for at in range(len(kept) - 1, -1, -1):
        begin, before, _, update, reset, candidate, part = kept[at]
        columns = slice(at * width, (at + 1) * width)
        own = carried + back_out[:, columns]
        into_gates, into_carried = given[:, columns], into_recurrent[:, columns]
        d_candidate = own * (1 - update) * (1 - candidate * candidate)
        into_gates[:n] = own * (before - candidate) * update * (1 - update)
        into_gates[n : 2 * n] = d_candidate * part * reset * (1 - reset)
        into_gates[2 * n :] = d_candidate
        into_carried[: 2 * n] = into_gates[: 2 * n]
        into_carried[2 * n :] = d_candidate * reset
        carried = own * update + model.recurrent @ into_carried
        if begin.any():
            carried[:, begin] = 0
    gradients[1] += np.concatenate([k[1] for k in kept], axis=1) @ into_recurrent.T
    words = inputs.reshape(-1)
    for i, row in enumerate(given):
        gradients[0][:, i] = np.bincount(words, row, len(model.inputs))
    return gradients, state.T


def flat(model: Gru) -> np.ndarray:
    """All weights in one row."""
    return np.concatenate([p.ravel() for p in model.parameters()])


def with_weights(model: Gru, weights: np.ndarray) -> Gru:
    """A model of the same shape with other weights."""
    parts, at = [], 0
    for p in model.parameters():
        part = np.empty_like(p)
        part[...] = weights[at : at + p.size].reshape(p.shape)
        parts.append(part)
        at += p.size
    return Gru(model.edges, *parts)
