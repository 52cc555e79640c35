"""Language-model scoring: a unigram base over words, and a causal self-attention model over subword ids, trained in numpy.

The attention model has one layer and one head. Subwords are those of a fixed public vocabulary; a subword's probability is that of
its class, which the model predicts from the attended context, times its share of the class in the counts of the whole training
corpus. Windows hold SCORED positions to be scored and OVERLAP before them as context, so that each token is scored once; all
windows of a chunk are scored by batched matrix products with a causal mask. The model is trained on the windows of all
training texts, where they are: each task goes over its own, and only sums of the changes travel.
"""

from __future__ import annotations

import binascii
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, col, few_rows, fold_col, removed, summed, table, written
from .shingles import IS_SPACE, PIECE, hash_piece, mixed

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
IDS, END = 50_257, 50_256
WIDTH, CLASSES, SCORED, OVERLAP = 16, 64, 16, 8
WINDOW = SCORED + OVERLAP
#: One in so many windows of every training text is trained on: all of them. Rounds of training, steps of all rounds at least,
#: windows of a step, and windows stored in a row.
SHARE, ROUNDS, LEAST_STEPS, BATCH, RATE, PACK = 1, 2, 300, 256, 0.02, 32
#: In a window: no subword. Groups of ids that what comes before an id is counted by. Slices that arrays are summed in. Changes of
#: weights are summed as multiples of 1 / FIXED.
NONE, BUCKETS, SLICES, FIXED = 65_535, 64, 64, float(1 << 32)
#: Rows of a matrix product. Exponentials are powers of 2, which numpy is quicker at: weights that lead to one have this factor.
BLOCK, UNIT = 512, np.float32(np.log2(np.e))
#: Words whose counts are broadcast: the most frequent, 12 bytes each. The others are joined.
FREQUENT = 1_000_000
#: Words whose subwords a task keeps.
KEPT_WORDS = 400_000


def vocabulary(tokenizers: str) -> dict[bytes, int]:
    with open(f"{tokenizers.rstrip('/')}/{VOCABULARY}", "rb") as f:
        fields = f.read().split()
    return dict(zip(map(binascii.a2b_base64, fields[::2]), map(int, fields[1::2])))


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces_of(texts: list[str | None]):
    """Chunks of about PIECE bytes: (index of the text, its bytes in ASCII lower case, whether its last). Long texts are cut at white space."""
    chunk, size = [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "replace").lower()
        at = 0
        while True:
            end = min(at + PIECE, len(data))
            while end < len(data) and not IS_SPACE[data[end]]:
                end += 1
            if size and size + end - at > PIECE:
                yield chunk
                chunk, size = [], 0
            chunk.append((i, data[at:end], end == len(data)))
            size += end - at + 1
            at = end
            if at == len(data):
                break
    if chunk:
        yield chunk


class Subwords:
    """Subword ids of words, kept by the words' hashes."""

    def __init__(self, tokenizers: str):
        ranks = vocabulary(tokenizers)
        self.encoder = encoder(ranks)
        self.starts = np.zeros(IDS, bool)
        self.starts[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True
        self.clear()

    def clear(self):
        self.hashes, self.first, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def add(self, words: str, many: int) -> tuple[np.ndarray, np.ndarray]:
        """First subword and number of subwords of words, each of which follows a space."""
        ids = np.array(self.encoder.encode_ordinary(words), np.int32)
        begin = np.flatnonzero(self.starts[ids])
        if len(begin) != many or begin[:1].tolist() != [0]:  # other white space inside a word: one by one
            each = [self.encoder.encode_ordinary(" " + w) for w in words[1:].split(" ")]
            ids = np.array([i for e in each for i in e], np.int32)
            begin = np.cumsum([0, *map(len, each)])[:-1]
        n = len(self.flat)
        self.flat = np.concatenate((self.flat, ids))
        return n + begin, np.diff(np.append(begin, len(ids)))

    def of(self, hashes: np.ndarray, spaced) -> tuple[np.ndarray, np.ndarray]:
        """First subword, in flat, and number of subwords of distinct words in the order of their hashes; spaced(new) gives the words
        at these places, each after a space."""
        if len(self.hashes) > KEPT_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        lacks = (at == len(self.hashes)) | (np.append(self.hashes, hashes[:1])[at] != hashes)
        new = np.flatnonzero(lacks)
        if len(new):
            first, sizes = self.add(spaced(new), len(new))
            place = at[new]
            self.hashes, self.first, self.sizes = (np.insert(x, place, y) for x, y in ((self.hashes, hashes[new]), (self.first, first), (self.sizes, sizes)))
            at += np.cumsum(lacks) - lacks
        return self.first[at], self.sizes[at]


class Chunk:
    """Words of a chunk of texts: hashes, distinct hashes, and subwords."""

    def __init__(self, parts, subwords: Subwords | None):
        data = b"\n".join(p for _, p, _ in parts)
        plain = np.frombuffer(data, np.uint8)
        h, start = hash_piece(plain)
        self.owner = np.array([i for i, _, _ in parts])
        self.last = np.array([x for _, _, x in parts])
        self.bounds = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for _, p, _ in parts)]))
        order = sorting(h)
        h = h[order]
        first = firsts(h)
        at = order[first]
        self.unique, self.counts = h[first], np.diff(np.append(first, len(h)))
        self.inverse = np.empty(len(h), np.int64)
        self.inverse[order] = np.repeat(np.arange(len(first)), self.counts)
        if subwords is not None:
            space = np.append(IS_SPACE[plain], True)
            end = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # of each word, as start has their beginnings

            def spaced(new):
                begin = start[at[new]]
                sizes = end[at[new]] - begin + 1
                text = plain[np.maximum(gathered(begin - 1, sizes), 0)]
                text[np.cumsum(sizes) - sizes] = ord(" ")
                return text.tobytes().decode("utf-8", "replace")

            self.first, self.sizes = subwords.of(self.unique, spaced)
        self.unique = self.unique.view(np.int64)


def sorting(h: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes. Plain numbers sort much faster than an order is found, so the places stand in for the low bits
    of the hashes; where different hashes share the others and come out of order, the whole hashes are sorted."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    order = (np.sort(h & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    got = h[order]
    return order if (got[1:] >= got[:-1]).all() else np.argsort(h, kind="stable")


def firsts(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


def gathered(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges first..first+size, one after the other."""
    end = np.cumsum(sizes)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - sizes, sizes) + np.repeat(first, sizes)


# ---- the model


def windows(bounds: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of inputs at bounds[k]:bounds[k+1], of which the first lead[k] are context only: (windows, WINDOW) places of
    inputs, those that hold a key, and for the last SCORED of each whether they are scored; and the sequence of each window."""
    length = np.diff(bounds) - lead
    n = -(-length // SCORED)
    seq = np.repeat(np.arange(len(length)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = (k * SCORED)[:, None] + np.arange(-OVERLAP, SCORED)
    valid = (place >= -lead[seq][:, None]) & (place < length[seq][:, None])
    return np.where(valid, place + (bounds[:-1] + lead)[seq][:, None], 0), valid, valid[:, OVERLAP:], seq


def product(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """a @ b, BLOCK rows at a time: BLAS packs larger matrices before it multiplies them, which takes longer than these products."""
    b, k = np.ascontiguousarray(b), len(a) // BLOCK * BLOCK
    np.matmul(a[:k].reshape(-1, BLOCK, a.shape[1]), b, out=out[:k].reshape(-1, BLOCK, out.shape[1]))
    np.matmul(a[k:], b, out=out[k:])
    return out


def spread(values: np.ndarray, columns: int) -> np.ndarray:
    """A matrix of equal columns. Rows of a few columns are scaled faster by it than by a column."""
    return np.repeat(values, columns).reshape(-1, columns)


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, in the same way."""
    k = len(a) // BLOCK * BLOCK
    return np.matmul(a[:k].reshape(-1, BLOCK, a.shape[1]).transpose(0, 2, 1), b[:k].reshape(-1, BLOCK, b.shape[1])).sum(0) + a[k:].T @ b[k:]


class Attention:
    """x = E[id] + P[place]; context by one masked head; logits of classes from x and context."""

    SMALL = ("P", "Wq", "Wk", "Wv", "Wo", "Wc", "b")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        d, c = WIDTH, CLASSES
        self.E, self.P = f(IDS, d, scale=0.1), f(WINDOW, d, scale=0.1)
        self.Wq, self.Wk, self.Wv, self.Wo = (f(d, d, scale=d**-0.5) for _ in range(4))
        self.Wc, self.b = f(d, c, scale=d**-0.5), np.zeros(c, np.float32)
        self.class_of = np.zeros(IDS, np.int16)
        self.log_share = np.zeros(IDS, np.float32)
        at = np.arange(WINDOW)
        self.mask = (at[None, :] <= at[OVERLAP:, None]).astype(np.float32)
        self.space: dict[str, np.ndarray] = {}

    def group(self, counts: np.ndarray, before: np.ndarray) -> None:
        """Classes: subwords are halved again and again, each time by the main direction in which what comes before them differs, into
        halves of about equal counts. before has a row for each id; ids never seen are dealt out to the classes in turn."""
        mass = counts + 1.0
        seen = np.flatnonzero(before.sum(1))
        self.class_of = (np.arange(IDS) % CLASSES).astype(np.int16)
        if len(seen):
            x = np.sqrt(before[seen].astype(np.float32))
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            parts = [np.arange(len(seen))]
            while len(parts) < CLASSES:
                halves = []
                for rows in parts:
                    w = mass[seen[rows]]
                    y = x[rows] - (x[rows] * w[:, None]).sum(0) / max(w.sum(), 1.0)
                    _, v = np.linalg.eigh((y * w[:, None]).T @ y)
                    along = y @ (v[:, -1] * np.sign(v[np.abs(v[:, -1]).argmax(), -1]))
                    by = rows[np.lexsort((rows, along))]
                    half = np.cumsum(mass[seen[by]]) - mass[seen[by]] / 2 <= mass[seen[by]].sum() / 2
                    halves += [by[half], by[~half]]
                parts = halves
            for k, rows in enumerate(parts):
                self.class_of[seen[rows]] = k
        total = np.bincount(self.class_of, mass, CLASSES)
        self.log_share = np.log(mass / total[self.class_of]).astype(np.float32)
        self.b = np.log(np.maximum(total, 1.0) / total.sum()).astype(np.float32)

    def forward(self, ids: np.ndarray, valid: np.ndarray) -> dict:
        x = self.E[ids] + self.P
        q, k, v = x[:, OVERLAP:] @ self.Wq, x @ self.Wk, x @ self.Wv
        s = np.exp(np.clip(q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5), -30, 30)) * self.mask * valid[:, None, :]
        a = s / (s.sum(2, keepdims=True) + np.float32(1e-30))
        c = a @ v
        h = x[:, OVERLAP:] + c @ self.Wo
        z = h @ self.Wc + self.b
        z -= z.max(2, keepdims=True)
        e = np.exp(z)
        p = e / e.sum(2, keepdims=True)
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "c": c, "h": h, "p": p}

    def gradients(self, ids, valid, classes, scored) -> tuple[float, np.ndarray, dict]:
        """The loss in nats a target, the distinct ids, and gradients; that of E has a row for each of them. The function of forward, but
        the projections of queries and keys, and of values and output, are multiplied first, so that only the scored places are
        projected. Products go over all places at once in arrays that are kept. Weights of places stay exponentials, and their sums
        divide what is made of them. Scores are clipped and logits shifted only where the sums show that it matters. Places that
        aren't valid get no gradient, as their weights are 0."""
        d, m, scale = WIDTH, len(ids), np.float32(WIDTH**-0.5)
        n = max(1, int(scored.sum()))
        flat = lambda y: y.reshape(-1, y.shape[-1])
        new, shape, many = self.held, (m, SCORED, d), (m * SCORED, d)
        Wqk, Wvo, eb, ones = self.Wq @ self.Wk.T * scale, self.Wv @ self.Wo, np.exp(self.b), np.ones(WINDOW, np.float32)
        x = np.take(self.E, ids, axis=0, out=new("x", m, WINDOW, d), mode="clip")
        x += self.P
        xq, xt = new("xq", *shape), new("xt", m, d, WINDOW)
        xq[:] = x[:, OVERLAP:]
        xt[:] = x.transpose(0, 2, 1)
        q = product(flat(xq), Wqk * UNIT, new("q", *many)).reshape(shape)
        a, sums = self.weights(q, xt, valid)
        q *= np.float32(1 / UNIT)
        inverse = spread(1 / sums, d)
        u = flat(np.matmul(a, x, out=new("u", *shape)))
        u *= inverse
        h = product(u, Wvo, new("h", *many))
        h += flat(xq)
        once, at = scored.ravel(), classes.ravel()
        cell = np.arange(0, len(h) * CLASSES, CLASSES) + at
        e, total, own = self.odds(h, self.Wc * UNIT, eb, cell)
        own, share = np.exp2(own), np.take(eb, at)
        loss = float(-(np.log(own * share / total + 1e-30) * once).sum() / n)
        e.ravel()[cell] = own - total / share  # with the factors r and eb: the probabilities, less 1 at the class
        r = once / (total * np.float32(n))
        dh = product(e, np.ascontiguousarray((self.Wc * eb).T), new("dh", *many))
        wide = spread(r, d)
        dh *= wide
        h *= wide
        dWc, db = crossed(h, e) * eb, (r @ e) * eb
        dWvo = crossed(u, dh)
        du = product(dh, Wvo.T, new("du", *many))
        u *= du
        du *= inverse
        ds = np.matmul(du.reshape(shape), xt, out=new("ds", m, SCORED, WINDOW))
        ds -= spread(u @ ones[:d] / sums, WINDOW).reshape(ds.shape)
        ds *= a
        dq = flat(np.matmul(ds, x, out=new("u", *shape)))
        dWqk = crossed(flat(xq), dq) * scale
        dx = np.matmul(ds.transpose(0, 2, 1), q, out=new("dx", m, WINDOW, d))
        dx += np.matmul(a.transpose(0, 2, 1), du.reshape(shape), out=x)
        dh += product(dq, Wqk.T, flat(xq))
        dx[:, OVERLAP:] += dh.reshape(shape)
        ids = ids.astype(np.uint16)
        by = np.argsort(ids, axis=None, kind="stable")
        sorted_ = np.take(ids, by)
        first = firsts(sorted_)
        dE = np.add.reduceat(np.take(flat(dx), by, axis=0, out=flat(x), mode="clip"), first)
        return loss, sorted_[first], {"E": dE, "P": (np.ones(m, np.float32) @ dx.reshape(m, -1)).reshape(WINDOW, d), "Wq": dWqk @ self.Wk, "Wk": dWqk.T @ self.Wq, "Wv": dWvo @ self.Wo.T, "Wo": self.Wv.T @ dWvo, "Wc": dWc, "b": db}

    def weights(self, q: np.ndarray, xt: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the scores q @ xt of the places that a place may look at, 0 at the others, and their sums. q has the factor
        UNIT. Scores are clipped to 30 on both sides: sums within the bounds say that none is above, and that what is below is nothing
        beside them; else all are made again and clipped."""
        a, ones, bound = self.held("a", len(q), SCORED, WINDOW), np.ones(WINDOW, np.float32), np.float32(30 * UNIT)
        cut = np.flatnonzero(~valid) // WINDOW
        cut = cut[firsts(cut)]
        for clipped in (False, True):
            np.matmul(q, xt, out=a)
            if clipped:
                np.clip(a, -bound, bound, out=a)
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp2(a, out=a)
                a *= self.mask
                a[cut] *= valid[cut, None, :]
                sums = a.reshape(-1, WINDOW) @ ones
            if clipped or not len(q) or (sums.min() > 1e-4 and sums.max() < 1e13):
                return a, sums + np.float32(1e-30)

    def odds(self, h: np.ndarray, Wc: np.ndarray, eb: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials of h @ Wc, their sums with the factors eb, and of the logits, before their exponentials, those in the cells. Wc
        has the factor UNIT. Where a sum leaves the bounds, the largest of a row is taken off all of them first."""
        e = self.held("e", len(h), CLASSES)
        for shifted in (False, True):
            product(h, Wc, e)
            if shifted:
                e -= e.max(1, keepdims=True)
            own = np.take(e, cell)
            with np.errstate(over="ignore", invalid="ignore"):
                total = np.exp2(e, out=e) @ eb
            if shifted or not len(h) or (total.min() > 1e-20 and total.max() < 1e20):
                return e, total, own

    def held(self, name: str, *shape: int) -> np.ndarray:
        """An array for a step's results, the same in the next step of this shape."""
        got = self.space.get(name)
        if got is None or got.shape != shape:
            got = self.space[name] = np.empty(shape, np.float32)
        return got

    def fused(self) -> Attention:
        """With the products of projections worked out once."""
        self.Wqk, self.Wvo = self.Wq @ self.Wk.T * np.float32(WIDTH**-0.5) * UNIT, self.Wv @ self.Wo
        self.Wcu, self.eb = self.Wc * UNIT, np.exp(self.b)
        self.own_b = self.b[self.class_of] + self.log_share
        return self

    def log_probabilities(self, ids: np.ndarray, valid: np.ndarray, targets: np.ndarray, step: int = 256) -> np.ndarray:
        """Natural logarithms for the last SCORED places of each window."""
        out = np.zeros((len(ids), SCORED), np.float32)
        d, new = WIDTH, self.held
        for a in range(0, len(ids), step):
            i, ok, t = ids[a : a + step], valid[a : a + step], targets[a : a + step].ravel()
            m = len(i)
            x = np.take(self.E, i, axis=0, out=new("x", m, WINDOW, d), mode="clip")
            x += self.P
            xq, xt = new("xq", m, SCORED, d), new("xt", m, d, WINDOW)
            xq[:] = x[:, OVERLAP:]
            xt[:] = x.transpose(0, 2, 1)
            xq = xq.reshape(-1, d)
            q = product(xq, self.Wqk, new("q", m * SCORED, d)).reshape(m, SCORED, d)
            s, sums = self.weights(q, xt, ok)
            u = np.matmul(s, x, out=new("u", m, SCORED, d)).reshape(-1, d)
            u *= spread(1 / sums, d)
            h = product(u, self.Wvo, new("h", m * SCORED, d))
            h += xq
            cell = np.arange(0, len(h) * CLASSES, CLASSES) + np.take(self.class_of, t)
            _, total, own = self.odds(h, self.Wcu, self.eb, cell)
            out[a : a + step] = (own * (1 / UNIT) + np.take(self.own_b, t) - np.log(total)).reshape(-1, SCORED)
        return out


class Learner:
    """Adagrad for the embeddings, whose steps touch the ids of a batch only, and Adam for the rest."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.seen = np.zeros(IDS, bool)
        self.squares = np.full(IDS, 1e-8, np.float32)
        self.small = np.concatenate([getattr(model, n).ravel() for n in model.SMALL])
        at = 0
        for n in model.SMALL:  # from here on parts of one array, so that a step changes them at once
            v = getattr(model, n)
            setattr(model, n, self.small[at : at + v.size].reshape(v.shape))
            at += v.size
        self.m1, self.m2 = np.zeros_like(self.small), np.zeros_like(self.small)

    def step(self, rows: np.ndarray) -> float:
        """One batch of windows: WINDOW inputs and one target more, NONE where there is none."""
        valid = rows[:, :-1] != NONE
        scored = (rows[:, OVERLAP + 1 :] != NONE) & valid[:, OVERLAP:]
        ids = np.minimum(rows, np.uint16(END))  # NONE is above the ids, and END the last of them
        m = self.model
        loss, ids, grads = m.gradients(ids[:, :-1], valid, np.take(m.class_of, ids[:, OVERLAP + 1 :]), scored)
        self.t += 1
        g = grads["E"]
        squares = self.squares[ids] + (g * g) @ np.full(WIDTH, 1 / WIDTH, np.float32)
        self.squares[ids] = squares
        self.seen[ids] = True
        g *= (np.float32(4 * self.rate) / np.sqrt(squares))[:, None]
        m.E[ids] = np.take(m.E, ids, axis=0) - g
        g = np.concatenate([grads[n].ravel() for n in m.SMALL])
        self.m1 = 0.9 * self.m1 + 0.1 * g
        self.m2 = 0.99 * self.m2 + 0.01 * g**2
        step = (self.m1 / (1 - 0.9**self.t)) / (np.sqrt(self.m2 / (1 - 0.99**self.t)) + 1e-6)
        self.small -= (self.rate * min(1.0, self.t / 10) * step).astype(np.float32)
        return loss


# ---- counts, training and scoring on Spark


def corpus_pass(docs: DataFrame, text_col: str, tokenizers: str, share: int) -> DataFrame:
    """One pass over whole texts. kind ("w" word, "s" subword, "d" texts), key (a word's hash or a subword's id) and n are a task's
    counts; kind "x" has in w n windows to train on, of every text one in share: of one, all. A task numbers its "x" rows by key."""

    def run(batches):
        subwords = Subwords(tokenizers)
        packs = 0
        own = np.zeros(IDS, np.int64)
        texts_seen = 0
        words: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush():
            h, n = (np.concatenate(x) for x in zip(*words))
            order = sorting(h.view(np.uint64))
            h, n = h[order], n[order]
            first = firsts(h)
            return rows("w", h[first], np.add.reduceat(n, first))

        def rows(kind, key, n, w=None):
            k = len(key)
            return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.binary()) if w else pa.nulls(k, pa.binary())], ["kind", "key", "n", "w"])

        for b in few_rows(batches):
            texts = b.column(0).to_pylist()
            texts_seen += len(texts)
            carried: dict[int, np.ndarray] = {}
            for parts in pieces_of(texts):
                c = Chunk(parts, subwords)
                if len(c.unique):
                    words.append((c.unique, c.counts))
                    held += len(c.unique)
                    ids = subwords.flat[gathered(c.first, c.sizes)]
                    own += np.bincount(ids, np.repeat(c.counts, c.sizes), IDS).astype(np.int64)
                picked = picked_windows(parts, c, subwords, share, carried)
                if len(picked):
                    packed = [picked[a : a + PACK] for a in range(0, len(picked), PACK)]
                    yield rows("x", packs + np.arange(len(packed)), np.array([len(x) for x in packed]), [x.tobytes() for x in packed])
                    packs += len(packed)
                if held > 1_000_000:
                    yield flush()
                    words, held = [], 0
        if words:
            yield flush()
        own[END] += texts_seen
        seen = np.flatnonzero(own)
        yield rows("s", seen, own[seen])
        yield rows("d", np.zeros(1, np.int64), np.full(1, texts_seen))

    found = docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, key long, n long, w binary")
    return written(found, "counts")


def picked_windows(parts, c: Chunk, subwords: Subwords, share: int, carried: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """WINDOW inputs and one target more of one in share windows of a chunk's texts, drawn by hash; of one, all of them, so that each
    token is a target once. NONE before a text and after it. What a text's later pieces need of this one is left in carried."""
    carried = {} if carried is None else carried
    size = c.sizes[c.inverse]
    stream = subwords.flat[gathered(c.first[c.inverse], size)].astype(np.uint16)
    edge = np.concatenate(([0], np.cumsum(size)))[c.bounds].tolist()
    before, end, pad = np.array([NONE] * OVERLAP + [END], np.uint16), np.array([END], np.uint16), np.full(SCORED, NONE, np.uint16)
    runs, n = [], []
    for k, (i, _, last) in enumerate(parts):
        ids = [carried.pop(i, before), stream[edge[k] : edge[k + 1]]]
        targets = len(ids[0]) + len(ids[1]) + last - OVERLAP - 1
        if last:
            n.append(-(-targets // SCORED))
            runs += [*ids, end, pad[: n[-1] * SCORED - targets]]
        else:  # the rest of the text takes up at a window's border, with the context that the window has
            n.append(targets // SCORED)
            whole = np.concatenate(ids)
            carried[i] = whole[n[-1] * SCORED :]
            runs.append(whole[: n[-1] * SCORED + OVERLAP + 1])
    of = np.repeat(np.arange(len(n)), n)
    w = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(n) - n)[of] * SCORED + of * (OVERLAP + 1) + w * SCORED
    if share > 1:
        with np.errstate(over="ignore"):
            draw = mixed(w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([zlib.crc32(data) for _, data, _ in parts], np.uint64)[of])
        start = start[draw % np.uint64(share) == 0]
    if not len(start):
        return np.zeros((0, WINDOW + 1), np.uint16)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate(runs), WINDOW + 1)[start]


def unpacked(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, WINDOW + 1)


def in_slices(whole: np.ndarray):
    """slice and payload of the slices of an array of IDS rows that aren't 0 throughout."""
    step = -(-IDS // SLICES)
    for k in range(SLICES):
        part = whole[k * step : (k + 1) * step]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "payload"])


def from_slices(found: dict[int, np.ndarray], columns: int, dtype) -> np.ndarray:
    step = -(-IDS // SLICES)
    whole = np.zeros((IDS, columns), dtype)
    for k, part in found.items():
        if k < SLICES:
            whole[k * step : (k + 1) * step] = part.reshape(-1, columns)
    return whole


def preceding(sample: DataFrame) -> np.ndarray:
    """How often each id follows each of BUCKETS groups of ids, over all windows."""

    def run(batches):
        whole = np.zeros(IDS * BUCKETS, np.int64)
        for b in batches:
            packed = unpacked(b)
            for a in range(0, len(packed), 8192):
                rows = packed[a : a + 8192].astype(np.int64)
                x, y = rows[:, OVERLAP:-1].ravel(), rows[:, OVERLAP + 1 :].ravel()
                both = (x != NONE) & (y != NONE)
                np.add.at(whole, y[both] * BUCKETS + (x[both] * 2654435761 >> 7) % BUCKETS, 1)
        yield from in_slices(whole.reshape(IDS, BUCKETS))

    return from_slices(summed(sample.select("w").mapInArrow(run, "slice int, payload binary"), SLICES, np.int64), BUCKETS, np.int64)


def train(sample: DataFrame, model: Attention, n: int, rounds: int, least_steps: int) -> Attention:
    """Goes over all windows: each task goes on from the common weights with its own windows, and the tasks' changes are averaged,
    those of an embedding over the tasks that saw its id. The rounds share the windows out, so that each is gone over once; where they
    are too few for least_steps steps, each round goes over all of them, as often as makes that many steps in all. Changes are summed
    as whole numbers, so that their order doesn't matter."""
    enough = n >= least_steps * BATCH
    epochs = 1 if enough else max(1, min(40, -(-least_steps * BATCH // max(1, rounds * n))))
    small = {k: getattr(model, k) for k in model.SMALL}
    sizes = np.cumsum([0, *(v.size for v in small.values())])

    for k in range(rounds):
        sent = Sent(sample.sparkSession, model)
        rate = RATE * (1.0 - k / rounds)

        def run(batches, sent=sent, rate=rate):
            m = sent.value
            old = {name: getattr(m, name).copy() for name in ("E", *m.SMALL)}
            learner = Learner(m, rate)
            kept = []
            for b in batches:
                rows = unpacked(b)
                if epochs > 1:
                    kept.append(rows)
                steps = -(-len(rows) // BATCH)
                for a in range(steps):  # neighbours are of one text, so a step takes windows from all over the batch
                    learner.step(rows[a::steps])
            again = np.concatenate(kept) if kept else None
            for e in range(1, epochs if kept else 1):
                order = np.random.default_rng(e).permutation(len(again))
                for a in range(0, len(again), BATCH):
                    learner.step(again[order[a : a + BATCH]])
            if learner.t:
                change = np.zeros((IDS, WIDTH + 1), np.int64)
                change[:, :-1] = np.rint((m.E - old["E"]) * FIXED)
                change[:, -1] = learner.seen
                yield from in_slices(change)
                rest = np.concatenate([np.rint((getattr(m, name) - old[name]) * FIXED).astype(np.int64).ravel() for name in m.SMALL] + [[1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([SLICES], pa.int32()), pa.array([rest.tobytes()], pa.binary())], ["slice", "payload"])

        part = sample.filter(F.col("key") % rounds == k) if enough else sample
        found = summed(part.select("w").mapInArrow(run, "slice int, payload binary"), SLICES + 1, np.int64)
        if SLICES not in found:
            continue
        change = from_slices(found, WIDTH + 1, np.int64)
        model.E = (model.E + change[:, :-1] / FIXED / np.maximum(change[:, -1:], 1)).astype(np.float32)
        rest = found[SLICES]
        for (name, v), a, z in zip(small.items(), sizes, sizes[1:]):
            setattr(model, name, (getattr(model, name) + (rest[a:z] / FIXED / rest[-1]).reshape(v.shape)).astype(np.float32))
    return model


class Scorer:
    """What the executors need: the frequent words' counts and the attention model."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, model: Attention):
        self.hashes, self.counts, self.model = hashes, counts, model


def fit(training: DataFrame, *, text_col="text", tokenizers: str = TOKENIZERS, share=SHARE, frequent=FREQUENT, rounds=ROUNDS, least_steps=LEAST_STEPS):
    """(counts of all training words as a table, N, V, texts, scorer). Counts and the attention model learn from every token of all
    rows; a caller may let the model's weights and classes learn from one in share windows only. An empty table leaves the model as it
    begins."""
    found = corpus_pass(training, text_col, tokenizers, share)
    counts = written(found.filter("kind <> 'x'").groupBy("kind", "key").agg(F.sum("n").alias("n")), "totals")
    words = counts.filter("kind = 'w'").select(F.col("key").alias("h"), "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    docs = counts.filter("kind = 'd'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = words.groupBy(F.floor(F.log2("n") * 4).alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect()
    least, seen = None, 0
    for r in bins:  # the lowest bin down to which no more than `frequent` words are
        seen += r.words
        if seen > frequent:
            break
        least = r.bin
    top = words.filter(F.floor(F.log2("n") * 4) >= least) if least is not None else words.limit(0)
    top = top.toArrow()
    hashes, times = (top.column(k).to_numpy() for k in ("h", "n"))
    order = np.argsort(hashes)
    ids = counts.filter("kind = 's'").select("key", "n").toArrow()  # the subword ids at most
    own = np.zeros(IDS)
    own[ids.column("key").to_numpy()] = ids.column("n").to_numpy()
    trained = found.filter("kind = 'x'")
    model = Attention()
    model.group(own, preceding(trained))
    train(trained, model, trained.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rounds, least_steps)
    removed(found)
    return words, int(total + docs), int(distinct + (docs > 0)), int(docs), Scorer(hashes[order], times[order], model)


def score(docs: DataFrame, fitted, *, text_col="text", tokenizers: str = TOKENIZERS, keep: list[str] | None = None) -> DataFrame:
    """row (the columns in keep, all by default), n_tokens, n_known, base_score and score, one row for each row of docs.

    Null and empty texts are their end token alone. Repeated rows score alike. An empty table gives no rows. Long texts are read in
    pieces, but their windows and the context run on across the pieces, so that a text scores as a whole. The attention model sees a
    text as its words in ASCII lower case, each after one space, and the end.
    """
    words, total, distinct, ends, scorer = fitted
    sent = Sent(docs.sparkSession, scorer)
    names = docs.columns if keep is None else keep
    row = T.StructType([docs.schema[docs.columns.index(n)] for n in names])
    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("logs", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    ]
    labels = ["row", *(f.name for f in fields)]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches):
        s = sent.value
        model = s.model.fused()
        subwords = Subwords(tokenizers)
        for b in few_rows(batches):
            texts = b.column(1).to_pylist()
            n = len(texts)
            n_tokens, known = np.ones(n, np.int64), np.zeros(n, np.int64)
            logs, total_ = np.zeros(n), np.zeros(n)
            rare: list[list] = [[] for _ in texts]
            times: list[list] = [[] for _ in texts]
            carried: dict[int, tuple[np.ndarray, int]] = {}
            end = np.array([END], np.uint16)
            for parts in pieces_of(texts):
                c = Chunk(parts, subwords)
                if len(c.unique):
                    at = np.searchsorted(s.hashes, c.unique)
                    at[at == len(s.hashes)] = 0
                    hit = s.hashes[at] == c.unique if len(s.hashes) else np.zeros(len(c.unique), bool)
                    count = np.where(hit, s.counts[at] if len(s.hashes) else 0, 0)
                    value = np.log10(count + 1.0)
                    size = c.sizes[c.inverse]
                    stream = subwords.flat[gathered(c.first[c.inverse], size)].astype(np.uint16)
                    edge = np.concatenate(([0], np.cumsum(size)))[c.bounds]
                    words_of = np.diff(c.bounds)
                    of = np.repeat(c.owner, words_of)
                    n_tokens += np.bincount(c.owner, words_of, n).astype(np.int64)
                    known += np.bincount(of, hit[c.inverse], n).astype(np.int64)
                    logs += np.bincount(of, value[c.inverse], n)
                    left = np.flatnonzero(~hit[c.inverse])
                    if len(left):
                        pairs, each = np.unique(of[left] * len(hit) + c.inverse[left], return_counts=True)
                        of_pair, word = np.divmod(pairs, len(hit))
                        edges = firsts(of_pair)
                        for i, a, z in zip(of_pair[edges].tolist(), edges.tolist(), np.append(edges[1:], len(pairs)).tolist()):
                            rare[i] += c.unique[word[a:z]].tolist()
                            times[i] += each[a:z].tolist()
                else:
                    stream, edge = np.zeros(0, np.uint16), np.zeros(len(parts) + 1, np.int64)
                streams, leads, owners = [], [], []
                for k, (i, last) in enumerate(zip(c.owner.tolist(), c.last.tolist())):
                    ids, lead = carried.pop(i, (end, 0))
                    ids = np.concatenate((ids, stream[edge[k] : edge[k + 1]], end[:last]))
                    if not last:  # the rest of the text takes up at a window's border, with the context that the window has
                        full = lead + (len(ids) - 1 - lead) // SCORED * SCORED
                        keep = max(0, full - OVERLAP)
                        carried[i] = (ids[keep:], full - keep)
                        ids = ids[: full + 1]
                    streams.append(ids)
                    leads.append(lead)
                    owners.append(i)
                sizes = np.array([len(x) - 1 for x in streams])
                inputs, targets = np.concatenate([x[:-1] for x in streams]), np.concatenate([x[1:] for x in streams])
                if not len(inputs):
                    continue
                place, valid, scored, seq_of = windows(np.concatenate(([0], np.cumsum(sizes))), np.array(leads))
                got = model.log_probabilities(np.take(inputs, place), valid, np.take(targets, place[:, OVERLAP:]))
                total_ += np.bincount(np.array(owners)[seq_of], (got * scored).astype(np.float64) @ np.ones(SCORED), n)
            out = [n_tokens, known, logs, total_ / np.log(10.0), rare, times]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, types))], labels)

    picked = docs.select(F.struct(*[col(n) for n in names]).alias("row"), col(text_col).cast("string").alias("text"))
    made = picked.mapInArrow(run, T.StructType([T.StructField("row", row, False), *fields]))
    made = written(made.withColumn("uid", F.monotonically_increasing_id()), "scored")
    left = made.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    more = left.join(words, "h").groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    out = made.drop("rare", "times").join(more, "uid", "left")
    tokens = F.col("n_tokens")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.log10(F.lit(ends + 1.0)) - tokens * F.log10(F.lit(float(total + distinct + 1)))
    return out.select("row", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score; nulls, empty and long texts and repeats as score has them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = fit(docs.filter(fold_col(F.col("doc_id"), 7) != 2))
    found = score(docs, fitted, keep=["doc_id"])
    return found.select("row.doc_id", (fold_col(F.col("row.doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLES: dict[str, str] = {}
