"""A causal self-attention model over subword ids, in numpy.

The next id is predicted in two steps: attention over a window of earlier ids gives the probability
of each of ``CLASSES`` classes of ids; counts over the whole training text give the probability of an
id within its class after the id before it. The classes' logits start from counts too (log probability
of a class after an id), attention adds what the earlier ids tell.
"""

from __future__ import annotations

import numpy as np

#: Positions of a window, and how many of them only give context to the rest.
WINDOW, OVERLAP = 32, 6
CLASSES, WIDTH = 24, 16
#: Ids with a row of their own in the attention tables, hashed rows for others, and previous ids that
#: the probabilities within a class tell apart.
OWN_ROWS, HASHED_ROWS, CONTEXTS = 1023, 256, 1024
#: Entries of the table of ids within classes at most: contexts times ids seen.
MAX_ENTRIES = 8_000_000
BATCH = 256
#: Windows of one array: their attention stays in a core's own cache.
BLOCK = 64
#: Windows that are cut at once.
CUT = 2048
_STRIDE = WINDOW - OVERLAP
_BEHIND = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_FUTURE = np.where(_BEHIND < 0, np.float32(-1e9), np.float32(0))
_ONES = np.ones(CLASSES, np.float32)


class Vocabulary:
    """Rows, contexts and classes of ids, from counts. The id ``size`` opens and ends a text."""

    def __init__(self, size: int, counts: np.ndarray):
        self.size = size
        order = np.lexsort((np.arange(size + 1), -counts))
        self.row = OWN_ROWS + 1 + (np.arange(size + 1) * 2654435761 % 4294967296 >> 7) % HASHED_ROWS
        own = order[:OWN_ROWS]
        self.row[own] = np.arange(len(own))
        self.row[size] = OWN_ROWS
        self.rows = OWN_ROWS + 1 + HASHED_ROWS
        #: Columns of the table within classes: ids that were seen, and one for the rest.
        self.seen = np.flatnonzero(counts > 0)
        self.column = np.full(size + 1, len(self.seen))
        self.column[self.seen] = np.arange(len(self.seen))
        self.contexts = int(min(CONTEXTS, max(2, MAX_ENTRIES // (len(self.seen) + 1))))
        self.context = np.full(size + 1, self.contexts - 1)
        own = order[: self.contexts - 2]
        self.context[own] = np.arange(len(own))
        self.context[size] = self.contexts - 2
        self.counts = counts
        self.kind = np.zeros(size + 1, np.int64)

    def set_classes(self, after: np.ndarray) -> None:
        """Classes by k-means over the contexts that ids follow; ``after``: contexts x seen ids."""
        seen = self.seen
        x = np.sqrt(after[:128].T / np.maximum(self.counts[seen], 1)[:, None])
        weight = self.counts[seen].astype(float)
        k = min(CLASSES, len(seen))
        if k:
            first = [int(np.argmax(weight))]
            near = ((x - x[first[0]]) ** 2).sum(1)
            while len(first) < k:
                first.append(int(np.argmax(near * weight**0.5)))
                near = np.minimum(near, ((x - x[first[-1]]) ** 2).sum(1))
            centre = x[first]
            for _ in range(15):
                kind = ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)
                mass = np.bincount(kind, weights=weight, minlength=k)
                for j in np.flatnonzero(mass):
                    centre[j] = (x[kind == j] * weight[kind == j, None]).sum(0) / mass[j]
            self.kind[seen] = kind


def tables(vocabulary: Vocabulary, by_row: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of a class after each row, and of each id within its class after each context.

    ``by_row``: rows x classes, ``after``: contexts x seen ids, counts of the training text.
    """
    total = by_row.sum(0) + 0.5
    prior = total / total.sum()
    step = np.log((by_row + 8 * prior) / (by_row.sum(1, keepdims=True) + 8))
    # Ids never seen share a hundredth of class 0.
    seen = vocabulary.seen
    counts = np.append(vocabulary.counts[seen], 0.0)
    kind = np.append(vocabulary.kind[seen], 0)
    whole = np.bincount(kind, weights=counts, minlength=CLASSES)
    counts[-1] = max(0.01 * whole[0], 1.0) if len(seen) <= vocabulary.size else 1e-9
    inside = counts / np.bincount(kind, weights=counts, minlength=CLASSES)[kind]
    pick = np.zeros((len(kind), CLASSES))
    pick[np.arange(len(kind)), kind] = 1
    after = np.hstack([after, np.zeros((len(after), 1))])
    within = np.log((after + 4 * inside) / ((after @ pick)[:, kind] + 4))
    within[:, -1] -= np.log(max(1, vocabulary.size + 1 - len(seen)))
    return step.astype(np.float32), within.astype(np.float32)


def initial(rows: int, seed: int = 5) -> np.ndarray:
    """All weights in one vector: query, key and value rows, offsets, output."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.3, 3 * rows * WIDTH), np.linspace(0, -1, WINDOW), rng.normal(0, 0.05, WIDTH * CLASSES)]
    return np.concatenate(parts).astype(np.float32)


class Model:
    """``within`` may be None for a model that is only trained: gradients do not read it."""

    def __init__(self, vocabulary: Vocabulary, step: np.ndarray, within: np.ndarray | None, weights: np.ndarray):
        self.vocabulary, self.step, self.within = vocabulary, step, within
        self.row = vocabulary.row.astype(np.int32)
        self.kind = vocabulary.kind.astype(np.int32)
        self.context, self.column = vocabulary.context.astype(np.int32), vocabulary.column.astype(np.int32)
        self.load(weights)

    def load(self, weights: np.ndarray) -> None:
        self.weights = weights
        n = self.vocabulary.rows * WIDTH
        self.query, self.key, self.value = (weights[i * n : (i + 1) * n].reshape(-1, WIDTH) for i in range(3))
        self.offset = weights[3 * n : 3 * n + WINDOW]
        self.out = weights[3 * n + WINDOW :].reshape(WIDTH, CLASSES)
        # Query, key and value of a row side by side; the one at the end sums the attention's parts.
        self.joined = np.hstack([self.query * np.float32(WIDTH**-0.5), self.key, self.value, np.ones((len(self.key), 1), np.float32)])
        self.bias = self.offset[np.maximum(_BEHIND, 0)] + _FUTURE
        longest = [float(np.sqrt((t * t).sum(axis=1).max())) for t in (self.query, self.key, self.value, self.out.T)]
        # Where no logit can pass its bound, none is compared with it.
        self.steep = longest[0] * longest[1] * WIDTH**-0.5 + float(self.offset.max()) > 29
        self.wide = longest[2] * longest[3] > 19

    def _forward(self, x: np.ndarray, start: int):
        """Logits of the classes after positions ``start`` and later, and what led to them."""
        rows = self.row.take(x)
        joined = self.joined.take(rows, axis=0)
        q, k, v = joined[:, start:, :WIDTH], joined[:, :, WIDTH : 2 * WIDTH], joined[:, :, 2 * WIDTH :]
        s = q @ k.transpose(0, 2, 1)
        s += self.bias[start:]
        if self.steep:
            np.minimum(s, 30, out=s)
        np.exp(s, out=s)
        h = s @ v
        total = h[:, :, WIDTH:]
        h = h[:, :, :WIDTH] / total
        z = h.reshape(-1, WIDTH) @ self.out
        if self.wide:
            np.clip(z, -20, 20, out=z)
        z += self.step.take(rows[:, start:].ravel(), axis=0)
        return rows, q, k, v, s, total, h, z

    def log_probability(self, x: np.ndarray, y: np.ndarray, start: int = 0) -> np.ndarray:
        """Natural log probability of each next id ``y`` of windows ``x`` (windows x positions), from ``start`` on."""
        z = self._forward(x, start)[-1]
        x, y = x[:, start:], y[:, start:].ravel()
        hit = z.ravel()[np.arange(0, z.size, CLASSES) + self.kind.take(y)]
        np.exp(z, out=z)
        hit -= np.log(z @ _ONES)
        place = self.context.take(x.ravel()).astype(np.int64) * self.within.shape[1] + self.column.take(y)
        hit += self.within.ravel().take(place)
        return hit.reshape(x.shape)

    def gradient(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> np.ndarray:
        # Lines of the blocks one after another, each position's part of its row's gradient; the last is zero.
        lines = np.empty((x.size + 1, 3 * WIDTH), np.float32)
        lines[-1] = 0
        at = 0
        g_out, g_bias = np.zeros((WIDTH, CLASSES), np.float32), np.zeros((WINDOW, WINDOW), np.float32)
        all_rows = np.empty(x.size, np.int32)
        share = np.float32(1 / max(scored.sum(), 1))
        for pick, start in parts(scored):
            rows, q, k, v, p, total, h, z = self._forward(x[pick], start)
            to = slice(at, at + rows.size)
            at += rows.size
            all_rows[to] = rows.ravel()
            np.exp(z, out=z)
            weight = scored[pick, start:].ravel() * share
            z *= (weight / (z @ _ONES))[:, None]
            z.ravel()[np.arange(0, z.size, CLASSES) + self.kind.take(y[pick, start:].ravel())] -= weight
            g_out += h.reshape(-1, WIDTH).T @ z
            # ``p`` is not divided by its sum: what it meets is. The column behind it takes away the mean.
            g_h = np.empty((*h.shape[:2], WIDTH + 1), np.float32)
            g_h[:, :, :WIDTH] = (z @ self.out.T).reshape(h.shape) / total
            g_h[:, :, WIDTH] = -np.einsum("ijk,ijk->ij", g_h[:, :, :WIDTH], h)
            g_s = g_h @ v.transpose(0, 2, 1)
            g_s *= p
            g_bias[start:] += g_s.sum(axis=0)
            found = lines[to].reshape(*rows.shape, 3 * WIDTH)
            found[:, :start, :WIDTH] = 0
            np.matmul(g_s, k, out=found[:, start:, :WIDTH])
            np.matmul(g_s.transpose(0, 2, 1), q, out=found[:, :, WIDTH : 2 * WIDTH])
            np.matmul(p.transpose(0, 2, 1), g_h[:, :, :WIDTH], out=found[:, :, 2 * WIDTH :])
        g_offset = np.bincount(np.maximum(_BEHIND, 0).ravel(), weights=g_bias.ravel(), minlength=WINDOW)
        total = sums_by_row(lines, all_rows, self.vocabulary.rows)
        total[:, :WIDTH] *= np.float32(WIDTH**-0.5)
        tables = [total[:, i * WIDTH : (i + 1) * WIDTH].ravel() for i in range(3)]
        return np.concatenate([*tables, g_offset.astype(np.float32), g_out.ravel()])

    def train(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, least_steps: int, rate: float, seed: int) -> np.ndarray:
        """Weights after Adam steps over all windows, again and again up to ``least_steps``."""
        rng = np.random.default_rng(seed)
        weights = self.weights.astype(np.float32).copy()
        m, u, t = np.zeros_like(weights), np.zeros_like(weights), 0
        batches = -(-len(x) // BATCH)
        total = max(least_steps, batches)
        while t < total:
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at : at + BATCH]
                self.load(weights)
                g = self.gradient(x[pick], y[pick], scored[pick])
                t += 1
                m *= np.float32(0.9)
                m += g * np.float32(0.1)
                np.square(g, out=g)
                g *= np.float32(0.01)
                u *= np.float32(0.99)
                u += g
                pace = rate * min(1.0, t / 20) * (1 - 0.9 * (t - 1) / total)
                np.multiply(u, np.float32(1 / (1 - 0.99**t)), out=g)
                np.sqrt(g, out=g)
                g += np.float32(1e-8)
                np.divide(m, g, out=g)
                g *= np.float32(pace / (1 - 0.9**t))
                weights = weights - g
                if t >= total:
                    break
        return weights


def parts(scored: np.ndarray):
    """Slices of windows and the first position that any of them scores: a text's first windows, and later ones."""
    first = scored[:, :OVERLAP].any(axis=1)
    for some, start in ((np.flatnonzero(~first), OVERLAP), (np.flatnonzero(first), 0)):
        for i in range(0, len(some), BLOCK):
            yield some[i : i + BLOCK], start


def sums_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the lines of ``values`` that have the same ``row``; a line of zeros follows the last of them."""
    if rows >= 1 << 16:
        raise ValueError("rows are numbered in 16 bits")
    order = np.argsort(row.astype(np.uint16), kind="stable")
    counts = np.bincount(row, minlength=rows)
    # Lines of a row in groups of four, filled up with a line of zeros: most sums are of whole arrays.
    groups = -(-counts // 4)
    places = np.full((int(groups.sum()), 4), len(row))
    first = 4 * (np.cumsum(groups) - groups) - (np.cumsum(counts) - counts)
    places.ravel()[np.arange(len(order)) + np.repeat(first, counts)] = order
    some = values.take(places[:, 0], axis=0)
    for i in range(1, 4):
        some += values.take(places[:, i], axis=0)
    out = np.zeros((rows, values.shape[1]), values.dtype)
    seen = np.flatnonzero(groups)
    if len(seen):
        out[seen] = np.add.reduceat(some, (np.cumsum(groups) - groups)[seen], axis=0)
    return out


def windows_of(per_doc: np.ndarray) -> np.ndarray:
    """Number of windows of texts of so many ids."""
    length = per_doc + 1
    return np.where(length <= WINDOW, 1, 1 + -(-(length - WINDOW) // _STRIDE))


def window_blocks(ids: np.ndarray, per_doc: np.ndarray, edge: int, size: int):
    """Windows of the texts' ids, opened and ended by ``edge``, ``size`` at a time: x, y, scored, document number.

    Neighbouring windows overlap; every id, the end included, is scored in exactly one.
    """
    length = per_doc + 1
    count = windows_of(per_doc)
    before = np.cumsum(count) - count
    stream = np.insert(ids.astype(np.int32), np.cumsum(per_doc), edge)  # every text with its end
    first = np.cumsum(length) - length
    for begin in range(0, int(count.sum()), size):
        window = np.arange(begin, min(begin + size, int(count.sum())))
        doc = np.searchsorted(before, window, side="right") - 1
        at = (window - before[doc])[:, None] * _STRIDE + np.arange(WINDOW)[None, :]
        inside = at < length[doc][:, None]
        place = first[doc][:, None] + np.minimum(at, length[doc][:, None] - 1)
        y = stream[place]
        x = np.where(at == 0, edge, stream[np.maximum(place - 1, 0)])
        scored = inside & ((at[:, :1] == 0) | (np.arange(WINDOW) >= OVERLAP)[None, :])
        yield x, y, scored, doc


def cut_windows(ids: np.ndarray, per_doc: np.ndarray, edge: int):
    """All windows of ``window_blocks`` in arrays, filled block by block: a block's working space is small."""
    total = int(windows_of(per_doc).sum())
    x, y = np.empty((total, WINDOW), np.int32), np.empty((total, WINDOW), np.int32)
    scored, doc = np.empty((total, WINDOW), bool), np.empty(total, np.int64)
    at = 0
    for found in window_blocks(ids, per_doc, edge, CUT):
        to = slice(at, at + len(found[0]))
        x[to], y[to], scored[to], doc[to] = found
        at = to.stop
    return x, y, scored, doc
