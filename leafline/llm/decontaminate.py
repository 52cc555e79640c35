"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each Arrow batch of documents is cut into shards of a few MB. A shard's words become ids of the benchmark's vocabulary (0: any
other word) and its suffixes are sorted; every test suffix is then binary-searched, word by word, for its interval in the sorted
order. Intervals that survive a whole window are occurrences; runs of them on one diagonal are the longest verbatim matches.
Documents are only mapped over, never shuffled, so a hot passage or source costs no task more than its share of the text.

The benchmark is sent to the executors in blocks of at most block_words words, one pass for each block: its size needn't be known.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, col, slices, table, with_text, written

WINDOW = 8
#: Words of benchmark text in one broadcast: 4 bytes each, and some 100 for each different word.
BLOCK_WORDS = 2_000_000

#: A-Z become a-z; other ASCII characters but digits and letters become a space.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))

MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()),
    T.StructField("doc_start", T.IntegerType()), T.StructField("length", T.IntegerType()),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLDED).split()


class TestSuffixes:
    """The suffixes of a block of items that are long enough for a window, and what finds them in a shard."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [k for k, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        words, starts, item, need = [], [], [], []
        for k, (_, ws) in enumerate(items):
            n = min(window, len(ws))
            first = len(words)
            words += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            for s in range(len(ws) - n + 1 if n else 0):
                starts.append(first + s)
                item.append(k)
                need.append(n)
        self.flat = np.array([*words, *[0] * 64], np.int64)
        self.start, self.item, self.need = (np.array(x, np.int64) for x in (starts, item, need))
        sizes = np.cumsum([0, *[len(ws) for _, ws in items]])
        self.offset = self.start - sizes[self.item] if len(starts) else self.start
        self.base = len(self.vocabulary) + 2
        self.step = 1
        least = int(self.need.min()) if len(starts) else 1
        while self.step < min(4, least) and self.base ** (self.step + 1) < 2**62:
            self.step += 1
        self.keys = np.unique(self.packed(self.flat, self.start, self.step))

    def packed(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        key = ids[at].astype(np.int64)
        for k in range(1, n):
            key = key * self.base + ids[at + k]
        return key

    def suffix_array(self, ids: np.ndarray, depth: int) -> np.ndarray:
        """Positions in the order of their next depth words. Those that begin no window of any item are left out beforehand."""
        at = np.flatnonzero(ids[: len(ids) - 64])
        key = self.packed(ids, at, self.step)
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        at = at[self.keys[found] == key]
        rank = np.zeros(len(at), np.int64)
        for d in range(0, depth, self.step):
            if not len(at):
                break
            key = self.packed(ids, at + d, self.step)
            order = np.lexsort((key, rank))
            at, rank, key = at[order], rank[order], key[order]
            new = np.ones(len(at), bool)
            new[1:] = (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])
            rank = np.cumsum(new)
            if new.all():
                break
        # a stop at unique ranks leaves a full order; otherwise depth words are compared
        return at

    def intervals(self, ids: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Test suffixes that occur as long as their window, and where in the suffix array."""
        live = np.arange(len(self.start))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = 0
        while len(live):
            ended = self.need[live] == depth
            if ended.any():
                done.append((live[ended], lo[ended], hi[ended]))
                live, lo, hi = live[~ended], lo[~ended], hi[~ended]
            if not len(live):
                break
            want = self.flat[self.start[live] + depth]
            lo, hi = (self.bound(ids, sa, lo, hi, depth, want, right) for right in (False, True))
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
            depth += 1
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (live, lo, hi)

    @staticmethod
    def bound(ids, sa, lo, hi, depth, want, right):
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) >> 1
            v, w = ids[sa[mid] + depth], want[open_]
            up = (v <= w) if right else (v < w)
            a[open_[up]] = mid[up] + 1
            b[open_[~up]] = mid[~up]

    def search(self, docs: list[list[bytes]]) -> list[list[tuple]]:
        """For each document its longest verbatim matches of at least a window: (item, item_start, doc_start, length)."""
        out: list[list[tuple]] = [[] for _ in docs]
        if not len(self.start):
            return out
        get = self.vocabulary.get
        parts, begins, n = [], [], 0
        for ws in docs:
            begins.append(n)
            parts.append(np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)))
            parts.append(np.zeros(1, np.int64))
            n += len(ws) + 1
        ids = np.concatenate([*parts, np.zeros(64, np.int64)])
        sa = self.suffix_array(ids, int(self.need.max()))
        if not len(sa):
            return out
        s, lo, hi = self.intervals(ids, sa)
        count = hi - lo
        if not count.sum():
            return out
        s = np.repeat(s, count)
        pos = sa[np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        item, offset = self.item[s], self.offset[s]
        order = np.lexsort((offset, pos - offset, item))
        item, offset, pos, need = item[order], offset[order], pos[order], self.need[s][order]
        new = np.ones(len(pos), bool)
        new[1:] = (item[1:] != item[:-1]) | (pos[1:] != pos[:-1] + 1) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(pos)))
        doc = np.searchsorted(begins, pos[first], "right") - 1
        for d, i, o, p, length in zip(doc.tolist(), item[first].tolist(), offset[first].tolist(), pos[first].tolist(), (need[first] + runs - 1).tolist()):
            out[d].append((self.names[i], o, p - begins[d], length))
        return out


def blocks_of(items, block_words: int):
    block, n = [], 0
    for k, ws in items:
        block.append((k, ws))
        n += len(ws)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text_col="text", item_col="item_id", item_text_col="text", window=WINDOW, block_words=BLOCK_WORDS, keep=None) -> DataFrame:
    """row (the columns in keep), n_words and matches (item_id, item_start, doc_start, length), one row for each row of docs.

    Null or empty texts have no words and no matches; an item without words never occurs; a null item id is named "null"; items of
    one id in several rows count as one item; an empty benchmark leaves every document without matches. Repeated documents are
    searched each by itself. Words are compared by ASCII lower case and count from 0.
    """
    spark = docs.sparkSession
    rows = benchmark.select(col(item_col).cast("string").alias("k"), col(item_text_col).cast("string").alias("t")).toLocalIterator()
    items = (("null" if r.k is None else r.k, words_of(r.t)) for r in rows)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))]
    blocks = blocks_of(items, block_words)
    ahead = list(itertools.islice(blocks, 2))
    carry = keep if len(ahead) < 2 or keep is None or text_col in keep else [*keep, text_col]
    found = None
    for block in itertools.chain(ahead, blocks):
        sent = Sent(spark, TestSuffixes(block, window))

        def work(texts, sent=sent):
            n_words, matches = [], []
            for i, j in slices(texts):
                docs_ = [words_of(t) for t in texts[i:j]]
                n_words += map(len, docs_)
                matches += sent.value.search(docs_)
            return {"n_words": n_words, "matches": matches}

        if found is None:
            found = with_text(docs, text_col, work, fields, keep=carry)
        else:  # the row is carried through, so each pass adds the matches of its block
            more = with_text(found.withColumn("text", F.col("row").getField(text_col)), "text", work, fields, keep=["row", "matches"])
            # stored, so that no task holds more than one block at a time
            found = written(more.select(F.col("row.row").alias("row"), "n_words", F.concat("row.matches", "matches").alias("matches")), "matches")
    if found is not None and carry != keep:
        found = found.withColumn("row", F.struct(*[F.col("row").getField(n).alias(n) for n in keep]))
    if found is None:
        empty = TestSuffixes([], window)
        found = with_text(docs, text_col, lambda texts: {"n_words": [len(words_of(t)) for t in texts], "matches": empty.search(texts)}, fields, keep=keep)
    return found


def covered(matches):
    """Words inside any match: the length of the union of their ranges."""
    ranges = F.array_sort(F.transform(matches, lambda m: F.struct(m.doc_start.alias("a"), (m.doc_start + m.length).alias("b"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"))
    step = lambda s, r: F.struct((s.n + F.greatest(F.lit(0), r.b - F.greatest(s.b, r.a))).alias("n"), F.greatest(s.b, r.b).alias("b"))
    return F.aggregate(ranges, start, step, lambda s: s.n).cast("long")


def item_names(matches):
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.item_id)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col="text", window=WINDOW, min_items=1, **more) -> DataFrame:
    """docs without the rows that hold a window of at least min_items items; columns, nulls and repeats stay as they are."""
    found = find_matches(docs, benchmark, text_col=text_col, window=window, **more)
    return found.filter(F.size(item_names(F.col("matches"))) < min_items).select("row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits on all benchmark items; nulls, empty texts and repeats as find_matches has them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark")
    found = find_matches_slim(docs, bench)
    names = item_names(F.col("matches"))
    return found.select(
        "doc_id", "n_words", covered(F.col("matches")).alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size(names) >= 2).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.length)), F.lit(0)).cast("long").alias("longest_match"),
    )


def find_matches_slim(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words and matches; the texts aren't carried back."""
    return find_matches(docs, bench, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_words", "matches")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[s : s + least(8, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, dw.n AS n, s FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
longest AS (
  SELECT doc_id, max(len) AS longest_match FROM (
    SELECT doc_id, item, o - s AS diagonal, grp, any_value(n) + count(*) - 1 AS len FROM (
      SELECT doc_id, item, n, s, o, s - row_number() OVER (PARTITION BY doc_id, item, o - s ORDER BY s) AS grp FROM (
        SELECT DISTINCT dw.doc_id, bo.item, dw.n, dw.s, bo.o FROM dw JOIN (
          SELECT item, s AS o, least(8, len(w)) AS n, array_to_string(w[s : s + least(8, len(w)) - 1], ' ') AS g
          FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)) bo ON dw.g = bo.g AND dw.n = bo.n))
    GROUP BY doc_id, item, o - s, grp) GROUP BY doc_id),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(items.n_items, 0) >= 2 AS contaminated,
  CAST(coalesce(longest.longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": ORACLE}
