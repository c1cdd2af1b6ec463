"""A log-bilinear model of units in clusters: vocabulary, noise-contrastive training in minibatches, exact scores.

Units are the document's end, words frequent enough for vectors of their own, and classes of all other words by their
ending; they stand in the order of their counts, cut into clusters of about equal counts.  The POSITIONS units before a
place, each through its position's matrix, give a vector h; P(unit) is P(cluster | h) times P(unit | cluster, h), two
softmax layers of products with h, so the exact normaliser takes about two square roots of the units.  Both layers are
trained by noise-contrastive estimation, with noise drawn from counts, on every place of the documents.

A minibatch is a stretch of text: a unit's vector is looked up once for all places after it.  Places share
the noise of clusters, and those whose targets are of one cluster the noise of its units.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np

POSITIONS, DIMENSIONS = 3, 24
#: Noise samples of a minibatch: clusters, and units of each cluster that has targets.
CLUSTER_NOISE, UNIT_NOISE = 24, 5
#: Places of a minibatch: of those learnt so far one in GROWTH, within these bounds.
BATCH, GROWTH, RATE = (256, 8192), 32, 0.08
#: Places whose words are looked up together.
POOL = 1 << 15
#: Places whose logits are in memory at once.
SLICE = 2048
END = b""  # no word is empty
ENDINGS, ENDING_BYTES = 4096, 3
Parameters = dict[str, np.ndarray]


def ending(word: bytes) -> int:
    """The class of a word that has no vector of its own."""
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def endings(words: Iterable[bytes], n: int) -> np.ndarray:
    """The classes of n such words."""
    return np.fromiter((zlib.crc32(w[-ENDING_BYTES:]) for w in words), np.int64, n) % ENDINGS


class Vocabulary:
    """own words and their counts, counts of the ending classes, and documents; numbers of units by count."""

    def __init__(self, own: Sequence[bytes], own_counts: Sequence[int], class_counts: Sequence[int], ends: int):
        names: list[bytes | int] = [END, *own, *range(ENDINGS)]
        counts = np.concatenate(([ends], np.asarray(own_counts, dtype=np.float64), np.asarray(class_counts, dtype=np.float64)))
        order = np.lexsort((np.arange(len(counts)), -counts))
        share = (counts[order] + 0.5) / (counts.sum() + 0.5 * len(counts))
        self.log_share, self.upto = np.log(share), np.cumsum(share)
        n = int(np.ceil(np.sqrt(len(share))))
        at = np.minimum(((self.upto - share) * n).astype(np.int64), n - 1)
        _, self.cluster = np.unique(at, return_inverse=True)
        self.starts = np.searchsorted(self.cluster, np.arange(self.cluster[-1] + 2))
        place = {names[i]: k for k, i in enumerate(order.tolist())}
        self.end = place[END]
        self.classes = np.array([place[t] for t in range(ENDINGS)], dtype=np.int64)
        self.own = {w: place[w] for w in own}
        self.is_class = np.zeros(len(share), dtype=bool)
        self.is_class[self.classes] = True

    def __len__(self) -> int:
        return len(self.log_share)

    def units(self, words: Sequence[bytes]) -> np.ndarray:
        own, classes = self.own, self.classes
        return np.array([own[w] if w in own else classes[zlib.crc32(w[-ENDING_BYTES:]) % ENDINGS] for w in words], dtype=np.int64)


def begin(v: Vocabulary, seed: int = 5) -> Parameters:
    """The model that knows counts only: all target vectors are 0.  Target vectors meet (h, 1), so their last column is the
    bias."""
    rng = np.random.default_rng(seed)
    mass = np.add.reduceat(np.exp(v.log_share), v.starts[:-1])
    d = DIMENSIONS
    return {
        "context": rng.normal(0, 0.3, (len(v), d)).astype(np.float32),
        "position": np.stack([np.eye(d) / (k + 1) for k in range(POSITIONS)]).astype(np.float32),
        "unit": with_bias(len(v), v.log_share - np.log(mass)[v.cluster]),
        "cluster": with_bias(len(mass), np.log(mass)),
    }


def with_bias(rows: int, bias: np.ndarray) -> np.ndarray:
    """Target vectors of 0, the bias in one more column."""
    return np.concatenate((np.zeros((rows, DIMENSIONS)), bias[:, None]), axis=1).astype(np.float32)


def contexts(units: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """[place, position] units before each place of documents that stand one after the other from these starts on; ends
    stand before the start of each."""
    places = np.arange(len(units))
    inside = places - starts[np.searchsorted(starts, places, side="right") - 1]
    return np.stack([np.where(inside > k, units[np.maximum(places - 1 - k, 0)], end) for k in range(POSITIONS)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Adaptive gradient steps on a copy of the parameters."""

    def __init__(self, v: Vocabulary, p: Parameters, seed: int):
        self.v, self.p = v, {k: x.copy() for k, x in p.items()}
        self.squares = {k: np.full(x.shape[0] if x.ndim == 2 else x.shape, 1e-2, dtype=np.float32) for k, x in p.items()}
        self.touched = {k: np.zeros(x.shape[0]) for k, x in p.items()}
        self.place = {k: np.zeros(x.shape[0], dtype=np.int64) for k, x in p.items()}  # of the rows of a step among them
        self.rng, self.seen = np.random.default_rng(seed), 0  # places learnt
        mass = np.add.reduceat(np.exp(v.log_share), v.starts[:-1])
        self.before, self.noise_cdf = np.concatenate(([0.0], v.upto)), np.cumsum(mass)
        self.cluster_prior = (np.log(CLUSTER_NOISE) + np.log(mass)).astype(np.float32)
        self.unit_prior = (np.log(UNIT_NOISE) + v.log_share - np.log(mass)[v.cluster]).astype(np.float32)

    def rows(self, name: str, at: np.ndarray, grads: np.ndarray) -> None:
        """Gradients of rows, several of one row summed, with a step for each row."""
        place, width = self.place[name], grads.shape[1]
        place[at] = 1
        found = np.flatnonzero(place)
        place[found] = np.arange(len(found))
        cells = (place[at] * width)[:, None] + np.arange(width)
        sums = np.bincount(cells.ravel(), grads.ravel(), len(found) * width).reshape(-1, width).astype(np.float32)
        place[found] = 0
        squares = self.squares[name][found] + np.einsum("ij,ij->i", sums, sums) / width
        self.squares[name][found] = squares
        self.p[name][found] += sums * (RATE / np.sqrt(squares))[:, None]
        self.touched[name][found] += 1

    def step(self, line: np.ndarray, places: np.ndarray) -> None:
        """One step from these places of a stretch of units, each of which has POSITIONS units before it."""
        p, v, rng, size = self.p, self.v, self.rng, len(line)
        vectors, matrices = p["context"][line], p["position"]
        beside = np.concatenate(matrices, axis=1)  # the matrices side by side
        ahead = [slice(POSITIONS - 1 - k, size - 1 - k) for k in range(POSITIONS)]  # the units k + 1 before each place
        columns = [slice(k * DIMENSIONS, (k + 1) * DIMENSIONS) for k in range(POSITIONS)]
        moved = vectors @ beside
        h = np.ones((size - POSITIONS, DIMENSIONS + 1), dtype=np.float32)
        h[:, :-1] = sum(moved[a, c] for a, c in zip(ahead, columns, strict=True))
        # places by their targets, and so by their clusters
        places = places[np.argsort(narrow(line[places], len(v)), kind="stable")]
        target, h = line[places], h[places - POSITIONS]
        g = v.cluster[target]
        groups = changes(g)
        parts = [slice(a, b) for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(g)], strict=True)]
        # clusters: one draw of noise for all places
        noise = np.minimum(np.searchsorted(self.noise_cdf, rng.random(CLUSTER_NOISE) * self.noise_cdf[-1]), len(self.noise_cdf) - 1)
        goal, others = p["cluster"][g], p["cluster"][noise]
        true = 1 - sigmoid(np.einsum("ij,ij->i", h, goal) - self.cluster_prior[g])
        false = sigmoid(h @ others.T - self.cluster_prior[noise])
        dh = true[:, None] * goal - false @ others
        self.rows("cluster", np.concatenate((g[groups], noise)), np.concatenate(([true[a] @ h[a] for a in parts], -(false.T @ h))))
        # units: one draw of noise for the places of a cluster
        c = g[groups]
        low, high = self.before[v.starts[c]], self.before[v.starts[c + 1]]
        drawn = np.searchsorted(v.upto, low[:, None] + rng.random((len(c), UNIT_NOISE)) * (high - low)[:, None], side="right")
        drawn = np.clip(drawn, v.starts[c][:, None], v.starts[c + 1][:, None] - 1)
        goal, others = p["unit"][target], p["unit"][drawn]
        true = 1 - sigmoid(np.einsum("ij,ij->i", h, goal) - self.unit_prior[target])
        false = np.concatenate([h[a] @ x.T for a, x in zip(parts, others, strict=True)])
        false = sigmoid(false - np.repeat(self.unit_prior[drawn], np.diff(groups, append=len(g)), axis=0))
        dh += true[:, None] * goal - np.concatenate([false[a] @ x for a, x in zip(parts, others, strict=True)])
        pushed = np.concatenate([false[a].T @ h[a] for a in parts])
        self.rows("unit", np.concatenate((target, drawn.ravel())), np.concatenate((true[:, None] * h, -pushed)))
        # h: context vectors and position matrices
        back = np.zeros((size, DIMENSIONS), dtype=np.float32)
        back[places] = dh[:, :DIMENSIONS]
        after = np.zeros((size, POSITIONS * DIMENSIONS), dtype=np.float32)  # what comes back to a unit from the places after it
        for a, c in zip(ahead, columns, strict=True):
            after[a, c] = back[POSITIONS:]
        dposition = (vectors.T @ after).reshape(DIMENSIONS, POSITIONS, DIMENSIONS).transpose(1, 0, 2)
        self.rows("context", line, after @ beside.T)
        self.squares["position"] += dposition * dposition
        p["position"] += 0.3 * RATE * dposition / np.sqrt(self.squares["position"])
        self.touched["position"] += 1

    def learn(self, documents: Iterable[list[bytes]], units: Callable[[list[bytes]], np.ndarray], times: int = 1) -> None:
        """Minibatches of all places of all documents, the end of each among them; each takes so many steps."""
        held: list[list[bytes]] = []
        n = 0
        for words in documents:
            held.append(words)
            n += len(words) + 1
            if n >= POOL:
                self.batches(held, units, times)
                held, n = [], 0
        if held:
            self.batches(held, units, times)

    def batches(self, documents: list[list[bytes]], units: Callable[[list[bytes]], np.ndarray], times: int) -> None:
        # each document has ends before it, which are no places to learn from
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        starts = np.cumsum(sizes + POSITIONS + 1) - sizes - 1
        line = np.full(int(starts[-1] + sizes[-1] + 1), self.v.end, dtype=np.int64)
        line[np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)] = units(list(itertools.chain.from_iterable(documents)))
        is_place = np.ones(len(line), dtype=bool)
        is_place[(starts[:, None] - 1 - np.arange(POSITIONS)).ravel()] = False
        a = POSITIONS
        while a < len(line):
            b = a + min(max(self.seen // GROWTH, BATCH[0]), BATCH[1])
            places = POSITIONS + np.flatnonzero(is_place[a:b])
            for _ in range(times if len(places) else 0):
                self.step(line[a - POSITIONS : b], places)
            self.seen += len(places)
            a = b


def narrow(x: np.ndarray, size: int) -> np.ndarray:
    """Numbers below a size in 16 bits if they fit, which sort in linear time."""
    return x.astype(np.uint16) if size <= 1 << 16 else x


def changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def averaged(start: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A parameter of several trainers: each row's mean, weighted by how often a trainer changed it."""
    w = weights.reshape(-1, *[1] * (start.ndim - 1))
    return np.where(w > 0, sums / np.maximum(w, 1), start).astype(np.float32)


class Scorer:
    """log10 P(unit | units before), exact, for many places at once."""

    def __init__(self, v: Vocabulary, p: Parameters):
        self.v = v
        # a context vector through each position's matrix, once for all
        self.moved = np.stack([p["context"] @ p["position"][k] for k in range(POSITIONS)])
        self.cluster, self.unit = np.ascontiguousarray(p["cluster"].T), p["unit"]

    def log10(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        v = self.v
        h = np.ones((len(target), DIMENSIONS + 1), dtype=np.float32)
        h[:, :-1] = self.moved[0][before[:, 0]]
        for k in range(1, POSITIONS):
            h[:, :-1] += self.moved[k][before[:, k]]
        g = v.cluster[target]
        order = np.argsort(g, kind="stable")
        h, g, target = h[order], g[order], target[order]
        found = np.concatenate([log_share(h[a : a + SLICE] @ self.cluster, g[a : a + SLICE]) for a in range(0, len(g), SLICE)])
        cuts = np.searchsorted(g, np.arange(len(v.starts)))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            a, b, first, last = v.starts[c], v.starts[c + 1], cuts[c], cuts[c + 1]
            if b - a > 1:
                found[first:last] += log_share(h[first:last] @ self.unit[a:b].T, target[first:last] - a)
        out = np.empty(len(found))
        out[order] = found
        return out / np.log(10)


def log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row at its place; the logits are overwritten."""
    logits -= logits.max()  # one number for all rows, unless a row is so far below that its sum vanishes
    own = logits[np.arange(len(at)), at].astype(np.float64)
    low = logits.max(axis=1)[:, None] if logits.min() < -80 else None
    if low is not None:
        logits -= low
        own -= low[:, 0]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], dtype=np.float32))
