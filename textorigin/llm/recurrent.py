"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried over windows."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np

UNITS, CLASSES = 32, 40
#: lanes and steps of one update, and of one window when scoring
TRAIN_LANES, TRAIN_STEPS, LANES, STEPS = 96, 24, 512, 48
RATE = 0.01
END = 0
#: logits between -FAR and FAR need no care for overflow
FAR = 60.0
#: places of an item in a window whose gradients are added for all items at once
SINGLY = 8
WEIGHTS = ("inputs", "recurrent", "class_out", "class_bias", "word_out", "word_bias")


@dataclass(frozen=True)
class Network:
    """Item 0 of the vocabulary ends a text, and is the input before its first token. Items are numbered by class: class c
    holds ``first[c]`` to ``first[c + 1]``."""

    inputs: np.ndarray  # item x 3 units: update, reset, candidate
    recurrent: np.ndarray  # units x 3 units
    class_out: np.ndarray
    class_bias: np.ndarray
    word_out: np.ndarray  # item x units
    word_bias: np.ndarray
    first: np.ndarray
    class_of: np.ndarray


def classes(counts: np.ndarray) -> np.ndarray:
    """Borders of classes of items (sorted by falling count) with about equal sums of the square roots of their counts."""
    share = np.cumsum(np.sqrt(np.maximum(counts, 1.0)))
    cuts = np.searchsorted(share, share[-1] * np.arange(1, CLASSES) / CLASSES) + 1
    return np.unique(np.concatenate([[0], np.minimum(cuts, len(counts)), [len(counts)]]))


def start(counts: np.ndarray, seed: int = 5) -> Network:
    """A network that gives the items' frequencies before it has learned anything."""
    rng, n = np.random.default_rng(seed), len(counts)
    first = classes(counts)
    class_of = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.int32)
    c = np.maximum(counts, 0.5)
    sums = np.add.reduceat(c, first[:-1])
    wide = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        wide(n, 3 * UNITS, scale=0.3), wide(UNITS, 3 * UNITS, scale=UNITS**-0.5), wide(UNITS, len(first) - 1), np.log(sums / sums.sum()).astype(np.float32),
        wide(n, UNITS), np.log(c / sums[class_of]).astype(np.float32), first, class_of,
    )


class _Rows:
    """Rows of different widths, or all of the one ``width``, one after the other in a flat array."""

    def __init__(self, widths: np.ndarray, width: int = 0):
        self.widths, self.width = widths, width
        ends = np.cumsum(widths)
        self.starts, self.size = ends - widths, int(ends[-1])

    def exp(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In place the exponential of ``x``, less each row's largest value where it could overflow or vanish; the logarithms of
        what stands at the places ``at``, and each row's sum."""
        if not (x.min() > -FAR and x.max() < FAR):
            x -= np.repeat(np.maximum.reduceat(x, self.starts), self.widths)
        own = x[at]
        np.exp(x, out=x)
        if self.width:
            return own, x.reshape(-1, self.width) @ np.ones(self.width, x.dtype)
        return own, np.add.reduceat(x, self.starts)


class Streams:
    """Texts (each ending with END) laid one after the other in lanes of about equal length; a text stays in one lane."""

    def __init__(self, tokens: np.ndarray, borders: np.ndarray, lanes: int):
        sizes = np.diff(borders)
        lanes = max(1, min(lanes, len(sizes)))
        heap, where = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in np.argsort(-sizes, kind="stable").tolist():
            length, k = heap[0]
            heapq.heapreplace(heap, (length + int(sizes[i]), k))
            where[k].append(i)
        where = [w for w in where if w]
        where.sort(key=lambda w: -int(sizes[w].sum()))
        order = np.array([i for w in where for i in w], np.int64)
        self.lengths = np.array([int(sizes[w].sum()) for w in where], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        own = sizes[order]
        ends = np.cumsum(own)
        place = np.repeat(borders[:-1][order] - (ends - own), own) + np.arange(int(own.sum()))
        self.target = tokens[place]
        self.input = np.empty_like(self.target)
        self.input[1:] = self.target[:-1]
        self.input[ends - own] = END
        self.owner = np.repeat(order, own)

    def windows(self, steps: int):
        """For each window, its places: one array per step, over the lanes that still run (a falling number)."""
        falling, longest = -self.lengths, int(self.lengths.max(initial=0))
        for t0 in range(0, longest, steps):
            times = range(t0, min(t0 + steps, longest))
            running = np.searchsorted(falling, -np.array(times), "left").tolist()
            yield [self.begins[:n] + t for n, t in zip(running, times)]


@dataclass(frozen=True)
class _Pass:
    """What a window's steps gave, one after the other in the rows of each array; step t has the rows ``cuts[t]`` to ``cuts[t + 1]``.
    Gates stand in arrays of their own, so that numpy runs through a step's numbers without a break at each row."""

    at: np.ndarray
    cuts: list[int]
    x: np.ndarray
    fresh: list[np.ndarray | None]  # per step the rows where a text begins, and with it an empty state
    before: np.ndarray
    gates: np.ndarray  # 3 x rows x units: update, reset, and what the candidate gets from the state before the reset
    candidate: np.ndarray
    hidden: np.ndarray


def _by_gate(net: Network) -> np.ndarray:
    """The recurrent weights as gate x units x units."""
    return np.ascontiguousarray(net.recurrent.reshape(UNITS, 3, UNITS).transpose(1, 0, 2))


class _Cell:
    """The network's step. Its weights for update and reset have the other sign: the logistic function of x is 1 / (1 + exp(-x))."""

    def __init__(self, net: Network, lanes: int):
        self.weights = _by_gate(net)
        np.negative(self.weights[:2], out=self.weights[:2])
        self.inputs, self.one = net.inputs.reshape(-1, UNITS), net.inputs.dtype.type(1)
        self.given = np.empty((3 * lanes, UNITS), net.inputs.dtype)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``inputs`` with the gates of the items ``x``, gate by gate."""
        return x.astype(np.intp) * 3 + np.arange(3)[:, None]

    def step(self, rows: np.ndarray, before: np.ndarray, gates: np.ndarray, candidate: np.ndarray, hidden: np.ndarray) -> None:
        """Fills ``gates`` (update, reset, what is recalled from the state), ``candidate`` and ``hidden``."""
        k = len(before)
        given = self.given[: 3 * k]
        self.inputs.take(rows.ravel(), 0, given, "clip")
        given = given.reshape(3, k, UNITS)
        np.matmul(before, self.weights, out=gates)
        both = gates[:2]
        both -= given[:2]
        np.exp(both, out=both)
        both += self.one
        np.divide(self.one, both, out=both)
        np.multiply(gates[1], gates[2], out=candidate)
        candidate += given[2]
        np.tanh(candidate, out=candidate)
        np.subtract(before, candidate, out=hidden)
        hidden *= gates[0]
        hidden += candidate


def _begun(x: np.ndarray, cuts: list[int]) -> list[np.ndarray | None]:
    """Per step the rows where a text begins, counted from the step's first row."""
    places = np.flatnonzero(x == END)
    at = np.searchsorted(places, cuts).tolist()
    return [places[i:j] - a if i < j else None for i, j, a in zip(at[:-1], at[1:], cuts)]


def _places(window: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    return np.concatenate(window), [0, *np.cumsum([len(w) for w in window]).tolist()]


def _steps(net: Network, s: Streams, window: list[np.ndarray], h: np.ndarray) -> _Pass:
    """All arrays are made once for the window and filled step by step."""
    u, kind = UNITS, net.recurrent.dtype
    at, cuts = _places(window)
    x, m = s.input[at], len(at)
    fresh, cell = _begun(x, cuts), _Cell(net, len(window[0]))
    rows = cell.rows(x)
    before, candidate, hidden = (np.empty((m, u), kind) for _ in range(3))
    gates = np.empty((3, m, u), kind)
    with np.errstate(over="ignore"):  # 1 / (1 + infinity) is the right 0
        for a, b, begins in zip(cuts[:-1], cuts[1:], fresh):
            p = before[a:b]
            p[:] = h[: b - a]
            if begins is not None:
                p[begins] = 0
            h = hidden[a:b]
            cell.step(rows[:, a:b], p, gates[:, a:b], candidate[a:b], h)
    return _Pass(at, cuts, x, fresh, before, gates, candidate, hidden)


class _Outputs:
    """The two softmaxes of all tokens of a window, which stand in the order of the classes of the items that follow them. ``hidden``
    has a column of ones, the weights one with the biases."""

    def __init__(self, net: Network, hidden: np.ndarray, y: np.ndarray):
        c = net.class_of[y].astype(np.uint8 if len(net.first) <= 256 else np.int32)
        self.order = np.argsort(c, kind="stable")
        c, m, self.classes = c[self.order], len(y), len(net.first) - 1
        self.hidden = np.ones((m, hidden.shape[1] + 1), hidden.dtype)
        self.hidden[:, :-1] = hidden.take(self.order, 0)
        self.class_out, self.word_out = np.vstack([net.class_out, net.class_bias]), np.column_stack([net.word_out, net.word_bias])
        self.class_rows = _Rows(np.full(m, self.classes), self.classes)
        self.class_at = self.class_rows.starts + c
        self.class_x = (self.hidden @ self.class_out).ravel()
        cuts, first = np.searchsorted(c, np.arange(self.classes + 1)).tolist(), net.first.tolist()
        self.word_rows = _Rows(np.diff(net.first)[c])
        self.word_at = self.word_rows.starts + y[self.order] - net.first[c]
        self.word_x = np.empty(self.word_rows.size, hidden.dtype)
        self.parts, at = [], 0
        for a, b, low, high in zip(cuts[:-1], cuts[1:], first[:-1], first[1:]):
            if a < b:
                x = self.word_x[at : at + (b - a) * (high - low)].reshape(b - a, -1)
                np.dot(self.hidden[a:b], self.word_out[low:high].T, out=x)
                self.parts.append((self.hidden[a:b], x, slice(a, b), slice(low, high)))
                at += x.size

    def logarithms(self) -> np.ndarray:
        own, total = self.class_rows.exp(self.class_x, self.class_at)
        of_class = own - np.log(total)
        own, total = self.word_rows.exp(self.word_x, self.word_at)
        return of_class.astype(np.float64) + (own - np.log(total))

    def gradients(self) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss: of the weights, and of ``hidden``."""
        share = self.hidden.dtype.type(1 / len(self.order))
        for x, rows, at in ((self.class_x, self.class_rows, self.class_at), (self.word_x, self.word_rows, self.word_at)):
            _, total = rows.exp(x, at)
            x *= np.repeat(share / total, rows.widths)
            x[at] -= share
        d = self.class_x.reshape(-1, self.classes)
        of_class, of_word = self.hidden.T @ d, np.zeros_like(self.word_out)
        back, by_word = d @ self.class_out[:-1].T, np.empty((len(d), self.word_out.shape[1] - 1), d.dtype)
        for hidden, e, rows, items in self.parts:
            np.dot(e.T, hidden, out=of_word[items])
            np.dot(e, self.word_out[items, :-1], out=by_word[rows])
        back += by_word
        return {"class_out": of_class[:-1], "class_bias": of_class[-1], "word_out": np.ascontiguousarray(of_word[:, :-1]), "word_bias": of_word[:, -1]}, back


def log_probabilities(net: Network, tokens: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each whole text."""
    out = np.zeros(len(borders) - 1)
    if not len(tokens):
        return out
    s = Streams(tokens, borders, LANES)
    lanes = len(s.lengths)
    cell, kind = _Cell(net, lanes), net.recurrent.dtype
    h = np.zeros((lanes, UNITS), kind)
    # learning keeps what each step gave; here only the states leave a step
    before, candidate, gates = np.empty_like(h), np.empty_like(h), np.empty((3, lanes, UNITS), kind)
    with np.errstate(over="ignore"):
        for window in s.windows(STEPS):
            at, cuts = _places(window)
            x = s.input[at]
            rows, hidden = cell.rows(x), np.empty((len(at), UNITS), kind)
            for a, b, begins in zip(cuts[:-1], cuts[1:], _begun(x, cuts)):
                k = b - a
                p = before[:k]
                p[:] = h[:k]
                if begins is not None:
                    p[begins] = 0
                h = hidden[a:b]
                cell.step(rows[:, a:b], p, gates[:, :k], candidate[:k], h)
            outputs = _Outputs(net, hidden, s.target[at])
            out += np.bincount(s.owner[at[outputs.order]], outputs.logarithms(), len(out))
    return out


def _gradients(net: Network, s: Streams, window: list[np.ndarray], h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean loss of a window; the state enters as a constant, so backpropagation ends at the window's border."""
    done, u = _steps(net, s, window, h), UNITS
    m, kind = len(done.at), net.recurrent.dtype
    outputs = _Outputs(net, done.hidden, s.target[done.at])
    grad, sorted_back = outputs.gradients()
    place = np.empty(m, np.int64)
    place[outputs.order] = np.arange(m)
    back = sorted_back.take(place, 0)
    # by how much each unit's gradient enters update, reset and what is recalled; only the gradient itself goes from step to step
    (z, r, recalled), n, p = done.gates, done.candidate, done.before
    kept, one = 1 - z, kind.type(1)
    of_candidate = n * n
    np.subtract(one, of_candidate, out=of_candidate)
    of_candidate *= kept
    factors, into = np.empty((3, m, u), kind), np.empty((3, m, u), kind)
    of_update, of_reset, of_recalled = factors
    np.subtract(done.hidden, n, out=of_update)  # the old state less the candidate, times the update
    of_update *= kept
    np.multiply(of_candidate, r, out=of_recalled)
    np.subtract(one, r, out=of_reset)
    of_reset *= of_recalled
    of_reset *= recalled
    returned = np.ascontiguousarray(_by_gate(net).transpose(0, 2, 1))
    following = np.zeros((0, u), kind)
    for a, b, begins in zip(done.cuts[-2::-1], done.cuts[:0:-1], done.fresh[::-1]):
        dh, d = back[a:b], into[:, a:b]
        dh[: len(following)] += following
        np.multiply(dh, factors[:, a:b], out=d)
        by_update, by_reset, by_recalled = np.matmul(d, returned)
        following = dh * z[a:b]
        following += by_update
        following += by_reset
        following += by_recalled
        if begins is not None:
            following[begins] = 0
    grad["recurrent"] = np.matmul(p.T, into).transpose(1, 0, 2).reshape(u, 3 * u)
    np.multiply(back, of_candidate, out=into[2])
    grad["inputs"] = _sums(done.x, into, len(net.inputs))
    return grad, done.hidden[done.cuts[-2] :]


def _sums(x: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n items the sum of its places in ``rows`` (gate x place x units), the gates side by side."""
    by = np.argsort(x.astype(np.uint16) if n <= 1 << 16 else x, kind="stable")
    own = x[by]
    places = np.flatnonzero(own[1:] != own[:-1]) + 1
    places = np.concatenate([[0], places])
    times = np.diff(places, append=len(x))
    order = np.argsort(-times, kind="stable")
    places, times = places[order], times[order]
    # all items' first places, then the second places of items that have them, and so on; what frequent items have beyond is added item by item
    sums = rows.take(by[places], 1)
    falling = -times
    for k in range(1, min(SINGLY, int(times[0]))):
        some = int(np.searchsorted(falling, -k))
        sums[:, :some] += rows.take(by[places[:some] + k], 1)
    many = int(np.searchsorted(falling, -SINGLY))
    if many:
        widths = times[:many] - SINGLY
        ends = np.cumsum(widths)
        rest = rows.take(by[np.repeat(places[:many] + SINGLY - (ends - widths), widths) + np.arange(ends[-1])], 1)
        # two numbers at a time, as the parts of a complex one
        sums[:, :many] += np.add.reduceat(rest.view(np.result_type(rows.dtype, np.complex64)), ends - widths, axis=1).view(rows.dtype)
    out = np.zeros((n, 3 * rows.shape[2]), rows.dtype)
    out[own[places]] = sums.transpose(1, 0, 2).reshape(len(places), -1)
    return out


def train(net: Network, tokens: np.ndarray, borders: np.ndarray, passes: int = 1, rate: float = RATE) -> Network:
    """Adam over windows of TRAIN_STEPS steps; the rate falls to a tenth towards the end."""
    if not len(tokens):
        return net
    own = {k: getattr(net, k).copy() for k in WEIGHTS}
    net = replace(net, **own)
    first, second = ({k: np.zeros_like(v) for k, v in own.items()} for _ in range(2))
    s = Streams(tokens, borders, TRAIN_LANES)
    total, t = passes * -(-int(s.lengths[0]) // TRAIN_STEPS), 0
    for _ in range(passes):
        h = np.zeros((len(s.lengths), UNITS), np.float32)
        for window in s.windows(TRAIN_STEPS):
            grad, h = _gradients(net, s, window, h)
            t += 1
            norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            pace = rate * (1 - 0.9 * t / total) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            for k, g in grad.items():
                _adam(own[k].ravel(), g.ravel(), first[k].ravel(), second[k].ravel(), np.float32(clip), np.float32(pace))
    return net


def _adam(own: np.ndarray, grad: np.ndarray, first: np.ndarray, second: np.ndarray, clip: np.float32, pace: np.float32) -> None:
    """One step, in place."""
    step = grad * (np.float32(0.1) * clip)
    first *= np.float32(0.9)
    first += step
    # the square of a tenth of the gradient is a hundredth of its square
    step *= step
    second *= np.float32(0.99)
    second += step
    np.sqrt(second, out=step)
    step += np.float32(1e-8)
    np.divide(first, step, out=step)
    step *= pace
    own -= step
