"""Language-model scores: a unigram baseline and a causal self-attention model over subword ids.

Tokens are words (A-Z lower-cased) and one end for each text. The baseline adds, over a text's tokens, the logarithm of
(count + alpha) / (all + alpha * (distinct + 1)), with the counts of all training texts. Counting is a Spark aggregate
over 64-bit word hashes, combined in each task first. Words that make up at least one in ``FREQUENT`` of all training
tokens (there are at most ``FREQUENT`` of these, whatever the corpus) go to the scoring tasks; all other words of each
text are joined to their counts in a shuffle.

The model sees the subword ids of a public byte-level BPE tokenizer, given by path. An id's cell is its place among the
most frequent ids of all training texts; all further ids share the last cell, within which a smoothed unigram tells them
apart. Context windows of two blocks of ``BLOCK`` ids overlap by one block; each window scores the ids of its second block,
so that every id is scored once and sees BLOCK to 2 * BLOCK - 1 ids before it. Attention is one masked matrix product for
a whole batch of windows. A cell is predicted as a class and a place in it. What attention sees is added to the logarithms
of smoothed counts of (previous id, cell) pairs, so an untrained model is a bigram.

Everything that is learned grows with the corpus: ids and pairs are counted over all training texts by Spark aggregates
(the tables have a fixed size), and the weights are trained on the windows of all training texts, dealt by a
hash over ``ROUNDS`` rounds (``share`` takes a part of them). A round's texts are dealt by a hash of their ids into shards of about
``SHARD`` subword ids; Adam runs in numpy over the windows of each shard on a copy of the weights, in the order of that
hash, and the copies are averaged by their numbers of windows, ``FAN`` at a time. No task or driver holds more than its
part, a shard sees as much text whatever the size of the corpus, and weights do not depend on tasks, batches or machines.

Defined results: a null or empty text has one token, its end; a null id is a training text (crc32 of nothing is not
held out); rows that repeat id and text give one row, rows of one id with different texts one each; without any training
token the baseline is that of an empty corpus and the model is untrained (but still a distribution); an empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import copy
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bendscape.llm.common import LOWER, NOT_SPACE, between, blocks, byte_values, cut, prefix, spans, texts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FREQUENT = 1 << 22
#: Part of the training texts whose windows train the weights (all), and in how many rounds, each on texts of its own.
SHARE, ROUNDS = 1.0, 2
#: About how many subword ids one copy of the weights sees in a round, how many copies are averaged at once, and among how
#: many tasks shards are dealt at most.
SHARD, FAN, TASKS = 1 << 19, 64, 1 << 14
#: Windows of one step of the training, and the rate of the first round.
STEP, RATE = 64, 0.015
ALPHA = 0.1
BLOCK = 8
WIDTH = 16
CLASSES, PLACES = 32, 64
CELLS = CLASSES * PLACES
#: Ids that have counts of their own for what follows them; all others share one row.
BEFORE = 1024
#: Pseudo-counts of the smoothing of pairs towards single counts.
PRIOR = 8.0
#: Pieces never cross words; each word begins with the one space of its piece.
PATTERN = r" ?[^ ]{1,32}"
#: Hash of the token that ends a text.
END_HASH = np.uint64(0x454E445F4F465F54)

_encodings: dict = {}


def encoding(path: str):
    """(tokenizer, which ids begin a word, number of ids) of a file of ranks; read once in a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        begins = np.zeros(max(ranks.values()) + 2, dtype=bool)
        begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        _encodings[path] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), begins, len(begins)
    return _encodings[path]


class Batch:
    """Words of some texts, as hashes; the distinct ones, and which each word is."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.start, self.end, self.first = spans(self.data, offsets, NOT_SPACE)
        self.hashes = between(prefix(byte_values(self.data)), self.start, self.end)
        self.distinct, self.at, self.which = np.unique(self.hashes, return_index=True, return_inverse=True)

    def subwords(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of all words in order, and the place of each text's first one."""
        coder, begins, _ = encoding(path)
        body = self.data.tobytes()
        known = [body[a:b] for a, b in zip(self.start[self.at].tolist(), self.end[self.at].tolist(), strict=True)]
        ids = np.array(coder.encode_ordinary((b" " + b" ".join(known)).decode()) if known else [], dtype=np.int32)
        begin = np.flatnonzero(begins[ids]) if len(ids) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(ids)))
        of_word = count[self.which]
        ends = np.cumsum(of_word)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - of_word, of_word) + np.repeat(begin[self.which], of_word)
        return ids[place], np.append(0, ends)[self.first]


def views_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, keys and values of all rows but the first; a row's keys and values are its own and those of the row before.

    ``p`` has, for each id, its query, what goes straight to its state, its key, its value, and 1 if it is not dead.
    """
    d, rows = WIDTH, len(p) // BLOCK
    at, one = p.strides
    both = lambda first, width: np.ndarray((rows - 1, 2 * BLOCK, width), p.dtype, p, first * one, (BLOCK * at, at, one))
    return p.reshape(rows, BLOCK, -1)[1:, :, :d], both(2 * d, d), both(3 * d, d + 1)


class Room:
    """Arrays for the steps of a training, of that many rows at most."""

    def __init__(self, rows: int, dtype: np.dtype):
        d, n = WIDTH, rows * BLOCK
        self.p, self.dp = np.empty((n, 5 * d), dtype), np.empty((n, 4 * d), dtype)
        self.q, self.keys, self.values = views_of(self.p)
        self.s, self.ds = np.empty((2, rows - 1, BLOCK, 2 * BLOCK), dtype)
        self.c, self.g = np.empty((2, rows - 1, BLOCK, d + 1), dtype)
        self.both = np.empty((rows - 1, 2 * BLOCK, 2 * d), dtype)
        self.y, self.z, self.t = np.empty((n, CLASSES), dtype), np.empty((n, PLACES), dtype), np.empty((n, d), dtype)
        self.ones, self.rows = np.ones(max(n, CLASSES, PLACES), dtype), np.arange(n)


@dataclass
class Step:
    """Where the ids of a step's rows are and what they aim at, found out for many steps at once."""

    windows: int
    #: Cells of all rows' ids, and the places of dead ones among these.
    cells: np.ndarray
    dead: np.ndarray
    #: By class: where the targets' ids stand (from the second row on), and (class, begin, end).
    at: np.ndarray
    classes: list[tuple[int, int, int]]
    of_class: np.ndarray
    place: np.ndarray
    before: np.ndarray
    pairs: np.ndarray
    #: All rows' ids by cell, the cells that occur, and where each begins.
    order: np.ndarray
    used: np.ndarray
    first: np.ndarray


def planned(cells: np.ndarray, goals: np.ndarray, low: np.ndarray, high: np.ndarray, windows: int = 0):
    """The steps of rows low..high each (fewer than 2,048 steps); a first row is only seen, ``goals`` are the cells that follow."""
    n = high - low
    step, top = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    offset = np.arange(top[-1]) - np.repeat(top - n, n)
    row = np.repeat(low, n) + offset
    seen = cells[row]
    goal = np.where((offset[:, None] > 0) & (seen < CELLS), goals[row], CELLS).ravel()
    seen = seen.ravel()
    live = np.flatnonzero(goal < CELLS)
    goal = goal[live]
    key = (step[live // BLOCK] * CLASSES + goal // PLACES).astype(np.uint16)
    by_class = np.argsort(key, kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(key, minlength=len(n) * CLASSES))).tolist()
    live, goal = live[by_class], goal[by_class]
    at = (offset[live // BLOCK] - 1) * BLOCK + live % BLOCK
    before = np.minimum(seen[live], BEFORE - 1)
    of_class, place = goal // PLACES, goal % PLACES
    pairs = before * CLASSES + of_class
    # Numbers of step, cell and place sort faster than places by cell.
    bits = int(n.max() * BLOCK).bit_length()
    inside = offset.repeat(BLOCK) * BLOCK + np.tile(np.arange(BLOCK), len(row))
    order = np.sort(((step.repeat(BLOCK) * (CELLS + 1) + seen) << bits) + inside)
    cell, order = order >> bits, order & ((1 << bits) - 1)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    used = cell[first] % (CELLS + 1)
    dead = np.flatnonzero(seen == CELLS)
    tops = np.append(0, top * BLOCK)
    of_first, of_dead, tops = np.searchsorted(first, tops).tolist(), np.searchsorted(dead, tops).tolist(), tops.tolist()
    for i in range(len(n)):
        a, b = edges[i * CLASSES], edges[(i + 1) * CLASSES]
        mine = edges[i * CLASSES : (i + 1) * CLASSES + 1]
        classes = [(c, x - a, y - a) for c, (x, y) in enumerate(itertools.pairwise(mine)) if x < y]
        t, r, f = slice(tops[i], tops[i + 1]), slice(a, b), slice(of_first[i], of_first[i + 1])
        yield Step(windows, seen[t], dead[of_dead[i] : of_dead[i + 1]] - tops[i], at[r], classes, of_class[r], place[r], before[r], pairs[r], order[t], used[f], first[f] - tops[i])


def steps_of(grids, cell: np.ndarray, size: int, most: int = 1024):
    """Steps of ``size`` windows each, the last of what is left; where a grid ends does not matter."""
    held = np.full((1, BLOCK), -1, dtype=np.int32)
    for grid in itertools.chain(grids, [None]):
        rows = held if grid is None else np.concatenate([held, grid])
        windows = np.flatnonzero(rows[1:, 0] >= 0) + 1
        cells = np.where(rows >= 0, cell[rows], CELLS).astype(np.int64)
        goals = np.append(cells.ravel()[1:], CELLS).reshape(cells.shape)
        whole = len(windows) // size * size
        for i in range(0, whole, most * size):
            mine = windows[i : min(i + most * size, whole)]
            yield from planned(cells, goals, mine[::size] - 1, mine[size - 1 :: size] + 1, size)
        if grid is None and whole < len(windows):
            yield from planned(cells, goals, windows[whole : whole + 1] - 1, windows[-1:] + 1, len(windows) - whole)
        held = rows[windows[whole] - 1 :] if whole < len(windows) else rows[-1:]


class Model:
    """The attention model: cells of the ids, their static shares, and the weights."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        order = np.argsort(-counts, kind="stable")
        self.cell = np.full(len(counts), CELLS - 1, dtype=np.int32)
        self.cell[order[: CELLS - 1]] = np.arange(min(CELLS - 1, len(counts)))
        rest = order[CELLS - 1 :]
        share = np.zeros(len(counts))
        share[rest] = np.log((counts[rest] + 0.1) / (counts[rest].sum() + 0.1 * len(rest)))
        self.share = share.astype(np.float32)
        d = WIDTH
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.known = np.bincount(self.cell, weights=counts, minlength=CELLS) + 0.5
        self.w = {
            "E": rng.normal(0, 0.3, (CELLS + 1, d)).astype(np.float32), "q": draw(d, d), "k": draw(d, d), "v": draw(d, d), "x": draw(d, d), "c": draw(d, d), "b": np.zeros(d, np.float32),
            "R": np.zeros((BLOCK, 2 * BLOCK), np.float32), "C": np.zeros((d, CLASSES), np.float32), "U": np.zeros((CLASSES, d, PLACES), np.float32),
        }
        self.follow(np.zeros((BEFORE, CELLS)))
        self.causal = np.where(np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK, 0, -1e9).astype(np.float32)

    def follow(self, pairs: np.ndarray) -> None:
        """Takes the counts of (previous cell, cell): logarithms of the class, and of the place in its class."""
        single = (self.known / self.known.sum()).reshape(1, CLASSES, PLACES)
        share = pairs.reshape(BEFORE, CLASSES, PLACES) + PRIOR * single
        by_class = share.sum(axis=2)
        self.of_class = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
        inner = pairs.reshape(BEFORE, CLASSES, PLACES) + PRIOR * single / single.sum(axis=2, keepdims=True)
        self.of_place = np.log(inner / inner.sum(axis=2, keepdims=True)).astype(np.float32)

    def logits(self, h: np.ndarray, before: np.ndarray, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all classes, and of the places in the given classes, for states in the order of these classes."""
        z = self.of_place.reshape(-1, PLACES).take(before * CLASSES + of_class, axis=0)
        edges = np.searchsorted(of_class, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                z[a:b] += h[a:b] @ self.w["U"][c]
        return h @ self.w["C"] + self.of_class[before], z

    def hidden(self, x: np.ndarray, before: np.ndarray, dead: np.ndarray):
        """States of the second blocks ``x``, given the blocks before them and a penalty for dead keys."""
        w, d = self.w, WIDTH
        both = np.concatenate([before, x], axis=1)
        q, k, v = x @ w["q"], both @ w["k"], both @ w["v"]
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(1 / np.sqrt(d))
        s += w["R"] + self.causal
        s += dead[:, None, :]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        c = s @ v
        return np.tanh(x @ w["x"] + c @ w["c"] + w["b"]), (both, q, k, v, s, c)

    def states(self, e: np.ndarray, live: np.ndarray) -> np.ndarray:
        """What :meth:`hidden` gives for all rows but the first of a text laid out in rows, in fewer passes over memory.

        Masks and distances are a factor, dead keys have no value and no weight, and the sum of weights is one more
        column of the values. Logits stay below the range of exp by a clip, not by their largest. All projections of the
        ids are one matrix product.
        """
        w, d = self.w, WIDTH
        p = np.empty((live.size, 5 * d), e.dtype)
        np.matmul(e.reshape(-1, d), self.projections(), out=p[:, : 4 * d])
        p[:, 4 * d] = 1
        p[np.flatnonzero(~live)] = 0
        q, keys, values = views_of(p)
        s = q @ keys.transpose(0, 2, 1)
        np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= np.exp(w["R"]) * (self.causal == 0)
        c = (s @ values).reshape(-1, d + 1)
        h = (c[:, :d] * (1 / (c[:, d:] + np.float32(1e-30)))) @ w["c"]
        h += p[BLOCK:, d : 2 * d]
        h += w["b"]
        return np.tanh(h, out=h).reshape(-1, BLOCK, d)

    def projections(self) -> np.ndarray:
        """What makes of an id its query, what goes straight to its state, its key and its value."""
        w = self.w
        return np.concatenate([w["q"] * w["q"].dtype.type(WIDTH**-0.5), w["x"], w["k"], w["v"]], axis=1)

    def gradients(self, cells: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss over the targets of some windows (as cells), and its gradients."""
        rows = cells[:, :-1].reshape(-1, BLOCK)
        goals = np.full_like(rows, CELLS)
        goals[1::2] = cells[:, BLOCK + 1 :]
        grad = {k: np.empty_like(v) for k, v in self.w.items()}
        (step,) = planned(rows, goals, np.array([0]), np.array([len(rows)]))
        if not len(step.at):
            return 0.0, {}
        return self.backward(step, Room(len(rows), self.w["E"].dtype), grad), grad

    def backward(self, step: Step, room: Room, grad: dict[str, np.ndarray]) -> float:
        """Fills in the gradients of the mean loss over a step's targets; returns the loss.

        States are those of :meth:`states`. All four projections of the ids are one matrix product, keys and values of two
        blocks are views of it, and so are their gradients.
        """
        w, d, n, k = self.w, WIDTH, len(step.cells) // BLOCK, len(step.at)
        e, u = w["E"].take(step.cells, axis=0), w["U"]
        e[step.dead] = 0
        all_w = self.projections()
        p, dp = room.p[: n * BLOCK], room.dp[: n * BLOCK]
        np.matmul(e, all_w, out=p[:, : 4 * d])
        p[:, 4 * d] = 1
        p[step.dead, 4 * d] = 0
        q, keys, values, s, ds, both = room.q[: n - 1], room.keys[: n - 1], room.values[: n - 1], room.s[: n - 1], room.ds[: n - 1], room.both[: n - 1]
        np.matmul(q, keys.transpose(0, 2, 1), out=s)
        np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= np.exp(w["R"]) * (self.causal == 0)
        # The last column is the sum of weights, then minus what each state's gradient has in common for all keys.
        c, g = room.c[: n - 1].reshape(-1, d + 1), room.g[: n - 1].reshape(-1, d + 1)
        np.matmul(s, values, out=room.c[: n - 1])
        one = 1 / (c[:, d:] + e.dtype.type(1e-30))
        c = c[:, :d] * one
        h = c @ w["c"]
        h += p[BLOCK:, d : 2 * d]
        h += w["b"]
        seen = np.tanh(h, out=h).take(step.at, axis=0)
        y, z, g_seen = room.y[:k], room.z[:k], room.t[:k]
        np.dot(seen, w["C"], out=y)
        for i, a, b in step.classes:
            np.dot(seen[a:b], u[i], out=z[a:b])
        y += self.of_class.take(step.before, axis=0)
        z += self.of_place.reshape(-1, PLACES).take(step.pairs, axis=0)
        loss = 0.0
        # States lie between -1 and 1, so logits are small enough for exp as they are.
        for x, hit in ((y, step.of_class), (z, step.place)):
            np.exp(x, out=x)
            flat, total, at = x.reshape(-1), x @ room.ones[: x.shape[1]], room.rows[:k] * x.shape[1] + hit
            loss -= float(np.log(flat[at] / total).mean())
            total *= k
            x *= (1 / total)[:, None]
            flat[at] -= x.dtype.type(1 / k)
        np.dot(seen.T, y, out=grad["C"])
        grad["U"][...] = 0
        for i, a, b in step.classes:
            np.dot(seen[a:b].T, z[a:b], out=grad["U"][i])
            np.dot(z[a:b], u[i].T, out=g_seen[a:b])
        g_seen += y @ w["C"].T
        seen *= seen
        g_seen *= np.subtract(1, seen, out=seen)
        g_z = np.zeros_like(h)
        g_z[step.at] = g_seen
        np.dot(c.T, g_z, out=grad["c"])
        np.dot(room.ones[: len(g_z)], g_z, out=grad["b"])
        g_c = g_z @ w["c"].T
        g_c *= one
        g[:, :d] = g_c
        g_c *= c
        np.negative(g_c @ room.ones[:d], out=g[:, d])
        np.matmul(room.g[: n - 1], values.transpose(0, 2, 1), out=ds)
        ds *= s
        np.dot(room.ones[: n - 1], ds.reshape(n - 1, -1), out=grad["R"].reshape(-1))
        np.matmul(ds.transpose(0, 2, 1), q, out=both[..., :d])
        np.matmul(s.transpose(0, 2, 1), room.g[: n - 1, :, :d], out=both[..., d:])
        of_rows = dp.reshape(n, BLOCK, 4 * d)
        of_rows[0, :, : 2 * d] = 0
        np.matmul(ds, keys, out=of_rows[1:, :, :d])
        dp[BLOCK:, d : 2 * d] = g_z
        of_rows[-1, :, 2 * d :] = 0
        of_rows[:-1, :, 2 * d :] = both[:, :BLOCK]
        of_rows[1:, :, 2 * d :] += both[:, BLOCK:]
        g_w = e.T @ dp
        np.multiply(g_w[:, :d], g_w.dtype.type(d**-0.5), out=grad["q"])
        grad["x"][...], grad["k"][...], grad["v"][...] = g_w[:, d : 2 * d], g_w[:, 2 * d : 3 * d], g_w[:, 3 * d :]
        grad["E"][...] = 0
        grad["E"][step.used] = np.add.reduceat((dp @ all_w.T).take(step.order, axis=0), step.first, axis=0)
        grad["E"][CELLS] = 0
        return loss

    def train(self, grids, rate: float = 0.01, size: int = STEP) -> int:
        """Adam over the rows of whole texts (see :func:`laid_out`), ``size`` windows a step: rows whose first id is not dead.

        Returns the number of windows.
        """
        names = list(self.w)
        ends = np.cumsum([self.w[k].size for k in names])[:-1]
        weights = np.concatenate([self.w[k].ravel() for k in names])
        split = lambda flat: {k: part.reshape(self.w[k].shape) for k, part in zip(names, np.split(flat, ends), strict=True)}
        m1, m2, part, g = (np.zeros_like(weights) for _ in range(4))
        # All weights lie in one array, updated in place, and so do their gradients.
        self.w, grad = split(weights), split(g)
        room, n, seen = Room(2 * size + 1, weights.dtype), 0, 0
        for step in steps_of(grids, self.cell, size):
            seen += step.windows
            if not len(step.at):
                continue
            self.backward(step, room, grad)
            n += 1
            now, root = rate * min(1, n / 10), (1 - 0.99**n) ** 0.5
            # Moments without their factors 0.1 and 0.01.
            m1 *= 0.9
            m1 += g
            m2 *= 0.99
            g *= g
            m2 += g
            np.sqrt(m2, out=part)
            part += 1e-7 * root
            np.divide(m1, part, out=part)
            part *= now * root / (1 - 0.9**n)
            weights -= part
        return seen

    def score(self, ids: np.ndarray, first: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """Natural logarithm of the probability of each text; ``first`` has where its ids begin, one more at the end."""
        grid, begin = laid_out(ids, first, len(self.cell) - 1)
        w, out = self.w, np.zeros(len(grid))
        flat = grid.ravel()
        target = np.append(flat[1:], -1).reshape(grid.shape)
        alive = grid >= 0
        cells = np.where(alive, self.cell[grid], CELLS)
        goals = np.append(cells.ravel()[1:], CELLS).reshape(grid.shape)
        ones_c, ones_p = np.ones(CLASSES, np.float32), np.ones(PLACES, np.float32)
        for i in range(1, len(grid), chunk):
            part = slice(i - 1, i + chunk)
            h = self.states(w["E"][cells[part]], alive[part])
            now = alive[i : i + chunk] & (target[i : i + chunk] >= 0)
            at = np.flatnonzero(now.ravel())
            if not len(at):
                continue
            goal = goals[i : i + chunk].ravel()[at]
            order = np.argsort((goal // PLACES).astype(np.uint8), kind="stable")
            at, goal = at[order], goal[order]
            of_class, rows = goal // PLACES, np.arange(len(goal))
            before = np.minimum(cells[i : i + chunk].ravel()[at], BEFORE - 1)
            # States lie between -1 and 1, so logits are small enough for exp as they are.
            y, z = self.logits(h.reshape(-1, WIDTH)[at], before, of_class)
            log = y[rows, of_class] + z[rows, goal % PLACES] + self.share[target[i : i + chunk].ravel()[at]]
            log -= np.log((np.exp(y, out=y) @ ones_c) * (np.exp(z, out=z) @ ones_p))
            out[i : i + chunk] = np.bincount(at // BLOCK, weights=log, minlength=len(now))
        return np.add.reduceat(out, begin) if len(begin) else np.zeros(0)


def laid_out(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of BLOCK ids, dead ones -1, and the first row of each text.

    A text is a dead row, then an end as its start, its ids, and its end, filled up with dead ids.
    """
    n = np.diff(first)
    rows = 1 + -(-(n + 2) // BLOCK)
    begin = np.cumsum(rows) - rows
    grid = np.full(int(rows.sum()) * BLOCK, -1, dtype=np.int32)
    start = (begin + 1) * BLOCK
    grid[start] = end
    grid[start + n + 1] = end
    grid[np.arange(int(n.sum())) - np.repeat(first[:-1] - first[0], n) + np.repeat(start + 1, n)] = ids
    return grid.reshape(-1, BLOCK), begin


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, held_out, text): ``h`` tells rows of one id apart, where ids repeat."""
    total, distinct = docs.agg(F.count("*"), F.countDistinct(key)).first()
    h = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if total > distinct else F.lit(0).cast("long")
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col(key).alias("id"), h.alias("h"), held.alias("held_out"), F.col(text).alias("text"))
    return rows.groupBy("id", "h", "held_out").agg(F.first("text").alias("text")) if total > distinct else rows


def counted(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(subword, hash, c): the count of each token of the texts, and of each subword id (as its hash)."""

    def run(batches):
        end = encoding(tokenizer)[2] - 1
        for batch in batches:
            data, offsets = texts(batch.column(0))
            hashes, counts = [np.array([END_HASH])], [np.array([len(batch)])]
            of_id = np.zeros(end + 1, dtype=np.int64)
            of_id[end] = len(batch)
            for i, j in blocks(offsets, 1 << 23):
                b = Batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes.append(b.distinct)
                counts.append(np.bincount(b.which, minlength=len(b.distinct)))
                of_id += np.bincount(b.subwords(tokenizer)[0], minlength=end + 1)
            ids = np.flatnonzero(of_id)
            subword = np.repeat([False, True], [sum(map(len, hashes)), len(ids)])
            all_hashes = np.concatenate([*[h.view(np.int64) for h in hashes], ids])
            yield pa.RecordBatch.from_arrays([pa.array(subword), pa.array(all_hashes), pa.array(np.concatenate([*counts, of_id[ids]]).astype(np.int64))], names=["subword", "hash", "n"])

    return rows.select("text").mapInArrow(run, "subword boolean, hash long, n long").groupBy("subword", "hash").agg(F.sum("n").alias("c"))


def grids_of(column: pa.Array, tokenizer: str):
    """The texts of a batch laid out in rows of BLOCK ids, some at a time."""
    data, offsets = texts(column)
    for i, j in blocks(offsets):
        ids, first = Batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).subwords(tokenizer)
        yield laid_out(ids, first, encoding(tokenizer)[2] - 1)[0]


def pair_counts(training: DataFrame, model: Model, tokenizer: str = TOKENIZER) -> np.ndarray:
    """How often each cell follows each of the BEFORE cells, over all training texts; each task adds up its own first."""
    cell = training.sparkSession.sparkContext.broadcast(model.cell)

    def run(batches):
        total = np.zeros(BEFORE * CELLS, dtype=np.int64)
        for batch in batches:
            for grid in grids_of(batch.column(0), tokenizer):
                one, two = grid.ravel()[:-1], grid.ravel()[1:]
                live = (one >= 0) & (two >= 0)
                total += np.bincount(np.minimum(cell.value[one[live]], BEFORE - 1) * CELLS + cell.value[two[live]], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    found = training.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BEFORE * CELLS)
    if len(found):
        out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(BEFORE, CELLS)


def _packed(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in sorted(w))


def _unpacked(body: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at, flat = {}, 0, np.frombuffer(body, dtype=np.float32)
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def runs_of(column: pa.Array) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal numbers in a column."""
    values = column.to_numpy()
    edges = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)).tolist() if len(values) else [0]
    return [(int(values[i]), i, j) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def averaged(training: DataFrame, model: Model, rate: float, shards: int, tokenizer: str = TOKENIZER, batch_size: int = STEP, fan: int = FAN, tasks: int = TASKS) -> None:
    """Trains a copy of the model on each shard of the texts (id, h, text), and gives the model the mean of their weights.

    A text's shard and its place in there follow from its id (and hash) alone. A task may hold several shards, one after
    another, each with a copy of its own.
    """
    shared = training.sparkSession.sparkContext.broadcast(model)
    form = "shard long, n long, body binary"
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])

    def fit(batches):
        pieces = ((shard, batch.column(1).slice(i, j - i)) for batch in batches for shard, i, j in runs_of(batch.column(0)))
        for shard, group in itertools.groupby(pieces, key=lambda piece: piece[0]):
            mine = copy.copy(shared.value)
            mine.w = {k: v.copy() for k, v in shared.value.w.items()}
            n = mine.train((grid for _, column in group for grid in grids_of(column, tokenizer)), rate, batch_size)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([shard], [n], [_packed(mine.w)]), schema.types, strict=True)], schema=schema)

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("body", "ascending")])
        n = table.column("n").to_numpy()
        total = sum(np.frombuffer(b.as_py(), dtype=np.float32).astype(float) * c for b, c in zip(table.column("body"), n, strict=True)) / n.sum()
        return pa.table([table.column("shard").slice(0, 1), pa.array([int(n.sum())]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], schema=schema)

    # The hash for the shard is another one than that which chose the round's texts.
    place = F.xxhash64("id", "h", F.lit("shard"))
    dealt = training.select("id", "h", "text", place.alias("place"), F.pmod(place, F.lit(shards)).alias("shard"))
    dealt = dealt.repartitionById(min(shards, tasks), F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "place", "id", "h")
    weights = dealt.select("shard", "text").mapInArrow(fit, form)
    while shards > fan:
        shards = -(-shards // fan)
        weights = weights.withColumn("shard", F.floor(F.col("shard") / fan)).groupBy("shard").applyInArrow(mean, form)
    found = weights.toArrow()  # ``fan`` rows at most
    if len(found):
        model.w = _unpacked(mean(found.combine_chunks()).column("body")[0].as_py(), model.w)


def fitted(training: DataFrame, ids: np.ndarray, share: float = SHARE, rounds: int = ROUNDS, tokenizer: str = TOKENIZER, shard: int = SHARD) -> Model:
    """A model of all training texts (id, h, text), given the counts of all subword ids."""
    model = Model(ids)
    model.follow(pair_counts(training, model, tokenizer))
    place = F.pmod(F.xxhash64("id", "h", F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    shards = max(1, -(-int(ids.sum() * share / rounds) // shard))
    for r in range(rounds if share else 0):
        averaged(training.where((place >= share * r / rounds) & (place < share * (r + 1) / rounds)), model, RATE / (1 + 2 * r), shards, tokenizer)
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, share: float = SHARE, frequent: int = FREQUENT, alpha: float = ALPHA, shard: int = SHARD) -> DataFrame:
    """(key, h, held_out, n_tokens, n_known, train_tokens, base_score, score) of each text."""
    rows = _rows(docs, key, text)
    training = rows.where("not held_out")
    both = cut(counted(training, tokenizer))
    counts = both.where("not subword").drop("subword")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    found_ids = both.where("subword").toArrow()  # as many rows as the tokenizer has ids, at most
    ids = np.zeros(encoding(tokenizer)[2])
    ids[found_ids.column("hash").to_numpy()] = found_ids.column("c").to_numpy()
    model = fitted(training, ids, share, tokenizer=tokenizer, shard=shard)
    below = total + alpha * (distinct + 1)
    # At most ``frequent`` words can have that share of all tokens.
    often = counts.where(F.col("c") * frequent >= total).toArrow()
    often_hash = np.asarray(often.column("hash").combine_chunks()).view(np.uint64) if len(often) else np.zeros(0, np.uint64)
    often_log = np.log10((np.asarray(often.column("c").combine_chunks(), dtype=float) + alpha) / below) if len(often) else np.zeros(0)
    order = np.argsort(often_hash)
    shared = docs.sparkSession.sparkContext.broadcast((often_hash[order], often_log[order], model))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, h long, held_out boolean, hash long, n int, n_tokens long, n_known long, part double, score double"
    names = ["id", "h", "held_out", "hash", "n", "n_tokens", "n_known", "part", "score"]

    def run(batches):
        known, logs, model = shared.value

        def found(hashes):
            at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            return hit, np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(hashes))

        end_hit, end_log = found(np.array([END_HASH]))
        for batch in batches:
            data, offsets = texts(batch.column(3))
            for i, j in blocks(offsets):
                b = Batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hit, log = found(b.distinct)
                per_word, per_hit = np.append(0.0, np.cumsum(log[b.which])), np.append(0, np.cumsum(hit[b.which]))
                ids, first = b.subwords(tokenizer)
                scores = model.score(ids, first) / np.log(10)
                n = j - i
                part = np.diff(per_word[b.first]) + end_log[0]
                n_known = np.diff(per_hit[b.first]) + int(end_hit[0])
                # One row for the text, whose own hash nothing shares, or that of a rare end; then its rare words.
                own = np.full(n, END_HASH) if not end_hit[0] else b.first[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(i)
                texts_of = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays([texts_of.column(0), texts_of.column(1), texts_of.column(2), pa.array(own.view(np.int64)), pa.array(np.full(n, 0 if end_hit[0] else 1, np.int32)), pa.array(np.diff(b.first) + 1), pa.array(n_known), pa.array(part), pa.array(scores)], names=names)
                rare = np.flatnonzero(~hit[b.which])
                if len(rare):
                    pairs = np.stack([np.searchsorted(b.first, rare, side="right") - 1, b.which[rare]], axis=1)
                    flat, times = np.unique(pairs[:, 0] * len(b.distinct) + pairs[:, 1], return_counts=True)
                    at = pa.array(flat // len(b.distinct) + i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(b.distinct[flat % len(b.distinct)].view(np.int64)), pa.array(times.astype(np.int32)), *[pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names=names)

    scored = rows.mapInArrow(run, schema)
    rare = counts.where(F.col("c") * frequent < total)
    met = scored.join(rare.hint("shuffle_hash"), "hash", "left")
    c = F.coalesce("c", F.lit(0))
    term = F.when(F.col("n") > 0, F.col("n") * F.log10((c + alpha) / below)).otherwise(F.lit(0.0))
    out = met.groupBy("id", "h", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.sum("part") + F.sum(term)).alias("base_score"),
        F.sum("score").alias("score"),
    )
    return out.withColumnRenamed("id", key)
