"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the classes that its links make.

1. Equal sets are one node, named by a 62-bit fingerprint of the set that a second one checks; copies are never paired.
2. A sketch of shingle frequencies (a fixed number of counters, all documents) gives a global order, rare shingles first. Any fixed
   order is exact; this one keeps the shingles of passages that many documents share out of the prefixes.
3. Each node takes the prefix that must hold m shingles of any partner, n - ceil(0.75 n) + m, where m from 1 to MOST_MATCHES is the
   one of least estimated cost: postings read, and candidates (postings / m) to verify. Two nodes share at least the smaller m of
   both prefixes, or they can't link.
4. Star round: each shared prefix shingle links its nodes to the most central of them (the one whose shingles are the most frequent,
   as a text's are whose edited copies abound); these pairs, linear in the postings, make most components. Frequent shingles are
   salted and their salts' central nodes meet once more.
   A second round, among nodes of different components, takes some pivots of each shingle by hash: edited copies that have lost their
   central text meet through many different pivots. Its pairs are linear in the postings too.
5. Exact rest: only pairs of nodes in different components remain. A pair must have sizes that allow a link and share, among the
   shingles that rank early enough in both sets, as many as the smaller m of both prefixes.
Every pair is verified on the whole sets, unless the parities of the sets tell it apart before: bits of the parity differ only where
the sets do, and a parity has at least two bits for each shingle. Nothing is capped: a pair is left out only if its components are
the same or a bound proves it dissimilar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Sent, col, few_rows, pinned, removed, summed, table, written
from .components import components
from .shingles import mixed, shingle_sets

WORDS, PERCENT, MOST_MATCHES = 5, 75, 4
#: Counters of the frequency sketch (4 bytes each) and bits of the candidate filter: fixed sizes, whatever the corpus.
COUNTERS, FILTER_BITS, SLICES = 1 << 20, 1 << 25, 64
#: Pivots of a shingle in the second star round.
PIVOTS = 4
#: Longs of the parity that rows of the shingle join carry, and the least of a set's own: bit k tells whether an odd number of its
#: shingles hash to k.
PARITY_LONGS = 8
#: Estimated documents of a shingle from which it is salted, and in one salt.
HOT_DF, SALT_DF = 2000, 1000
#: Cost of verifying a candidate, in postings.
VERIFY_COST = 8.0
#: Nodes that a task remembers, so as to leave out their copies.
KEPT_NODES = 1_000_000


def fingerprints(sets: list[np.ndarray], collided: frozenset = frozenset()) -> tuple[list[int | None], list[int | None]]:
    """62-bit names of sets, equal for equal sets, and second fingerprints; None for empty ones. Where different sets have one name
    (collided), the second fingerprint is the name."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    names: list[int | None] = [None] * len(sets)
    checks = list(names)
    if len(full):
        first = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        h = mixed(np.concatenate([sets[k] for k in full]))
        for out, salt in ((names, np.uint64(0)), (checks, np.uint64(0xA5A5A5A55A5A5A5A))):
            with np.errstate(over="ignore"):
                total = np.add.reduceat(mixed(h ^ salt) if salt else h, first)
                got = mixed(total ^ mixed(sizes[full].astype(np.uint64))).astype(np.int64) & ~np.int64(3)
            for k, name in zip(full.tolist(), got.tolist()):
                out[k] = name
        if collided:
            names = [c if n in collided else n for n, c in zip(names, checks)]
    return names, checks


def parity_longs(n: int) -> int:
    """Longs of the parity of a set of n shingles: two bits for each, rounded up to a power of two."""
    return max(PARITY_LONGS, 1 << max(0, (2 * n - 1).bit_length() - 6))


def parities(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The parity of each set, as longs. Two sets' differing bits are at most their symmetric difference, and so bound their overlap."""
    out = []
    for s in sets:
        width = 64 * parity_longs(len(s))
        bits = np.bincount((mixed(s) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64))
    return out


def xor(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))


def halved(x: Column) -> Column:
    """A parity at half its width."""
    h = (F.size(x) / 2).cast("int")
    return xor(F.slice(x, F.lit(1), h), F.slice(x, h + 1, h))


def differing(x: Column, y: Column) -> Column:
    """Bits in which two parities differ, at the width of the shorter; sizes of a link differ by less than a factor of two."""
    a, b = F.when(F.size(x) > F.size(y), halved(x)).otherwise(x), F.when(F.size(y) > F.size(x), halved(y)).otherwise(y)
    return F.aggregate(xor(a, b), F.lit(0), lambda n, w: n + F.bit_count(w))


def differing_rows(x: str, y: str):
    """Bits in which two columns of parities of PARITY_LONGS longs differ."""
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(PARITY_LONGS)), F.lit(0))


def folded(x: Column) -> Column:
    """A parity at the width of PARITY_LONGS longs."""
    one = lambda k: F.aggregate(F.filter(x, lambda _, i: i % PARITY_LONGS == k), F.lit(0).cast("long"), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(x) == PARITY_LONGS, x).otherwise(F.array(*[one(k) for k in range(PARITY_LONGS)]))


def sizes_allow(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def overlap_and_matches(x, y, percent: int):
    """The shingles that a link of two nodes shares at least, and the matches asked of it; x and y give the nodes' columns.

    A link shares least shingles, so k of them rank below size - least + k in both sets, for each k that both prefixes have room for:
    the smaller m of both is one.
    """
    return F.ceil((x("size") + y("size")) * percent / (100 + percent)), F.least(x("m"), y("m"))


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


class Sketch:
    """Frequencies of shingles, estimated from counters that they share."""

    def __init__(self, counts: np.ndarray):
        self.mean = float(counts.mean()) if len(counts) else 0.0
        spread = 3.0 * np.sqrt(self.mean) if self.mean else 0.0
        df = np.maximum(counts - self.mean - spread, 1.0)
        self.level = np.minimum(np.log2(df).astype(np.uint8), 63)

    def levels(self, s: np.ndarray) -> np.ndarray:
        return self.level[(s >> np.uint64(44)).astype(np.int64)]

    def prefix(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The adaptive prefix of a set: shingles, their levels (log2 of the estimated frequency), the matches it asks for, and how
        central the set is: its mean level in thousandths, largest where no edit has made a shingle rare."""
        n = len(s)
        level = self.levels(s)
        order = np.lexsort((s, level))
        least = least_overlap(n, percent)
        cost = np.cumsum(np.exp2(level[order].astype(np.float64)) - 1.0)
        best, m = np.inf, 1
        for k in range(1, min(MOST_MATCHES, least) + 1):
            p = n - least + k
            total = p + cost[p - 1] * (1.0 + VERIFY_COST / k)
            if total < best:
                best, m = total, k
        take = order[: n - least + m]
        return s[take], level[take], m, int(1000 * level.mean())


def rows_and_sketch(docs: DataFrame, words: int) -> tuple[DataFrame, Sketch]:
    """One pass over docs (id, text_hash, text): every document's node, set size and parity, and the sketch. Kept as a table."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("text_hash", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("second", T.LongType()),
        T.StructField("parity", T.ArrayType(T.LongType())), T.StructField("slice", T.IntegerType()), T.StructField("payload", T.BinaryType()),
    ])
    arrow = [to_arrow_type(f.dataType) for f in schema]
    step = COUNTERS // SLICES

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for b in few_rows(batches):
            sets = shingle_sets(b.column(2).to_pylist(), words)
            k = len(sets)
            if k:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            made = [b.column(0), b.column(1), [*map(len, sets)], *fingerprints(sets), parities(sets), [None] * k, [None] * k]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) if isinstance(x, list) else x.cast(t) for x, t in zip(made, arrow)], schema.names)
        for k in range(SLICES):
            part = counts[k * step : (k + 1) * step]
            if part.any():
                made = [pa.nulls(1, t) for t in arrow[:-2]]
                yield pa.RecordBatch.from_arrays([*made, pa.array([k], arrow[-2]), pa.array([part.tobytes()], arrow[-1])], schema.names)

    both = written(docs.select("id", "text_hash", "text").mapInArrow(run, schema), "shingles")
    counts = np.zeros(COUNTERS, np.uint32)
    for k, part in summed(both.filter("payload is not null"), SLICES, np.uint32).items():
        counts[k * step : (k + 1) * step] = part
    return both.filter("payload is null").drop("slice", "payload"), Sketch(counts)


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, frozenset]:
    """rows (id, text_hash, n, node) and nodes (node, id: the smallest of its documents, size, parity), and names that different sets had."""
    by = rows.filter("n > 0").groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high"))
    collided = frozenset(r.node for r in by.filter("low <> high").select("node").collect())  # by 62 bits about one in 10^9 documents
    rows = rows.withColumn("node", F.when(F.col("node").isin(*collided), F.col("second")).otherwise(F.col("node"))) if collided else rows
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("size"), F.first("parity").alias("parity"))
    return rows.select("id", "text_hash", "n", "node"), written(nodes, "nodes"), collided


def postings(docs: DataFrame, sketch: Sketch, collided: frozenset, words: int, percent: int) -> DataFrame:
    """shingle, rank, salt, node, size, m, central: the prefix of every node, rank counting from 0 in the global order. A copy is left out where its task has seen the node."""
    sent = Sent(docs.sparkSession, sketch)
    schema = "shingle long, rank int, salt int, node long, size int, m byte, central int"
    names = ["shingle", "rank", "salt", "node", "size", "m", "central"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int8(), pa.int32()]

    def run(batches):
        seen: set[int] = set()
        for b in few_rows(batches):
            parts: list[list[np.ndarray]] = [[] for _ in names]
            sets = shingle_sets(b.column(0).to_pylist(), words)
            for s, node in zip(sets, fingerprints(sets, collided)[0]):
                if node is None or node in seen:
                    continue
                if len(seen) < KEPT_NODES:
                    seen.add(node)
                take, level, m, central = sent.value.prefix(s, percent)
                salts = np.where(level >= int(np.log2(HOT_DF)), np.exp2(level).astype(np.int64) // SALT_DF + 1, 0)
                salt = np.where(salts > 0, (node >> 2) % np.maximum(salts, 1) + 1, 0)
                for x, y in zip(parts, (take.astype(np.int64), np.arange(len(take)), salt, np.full(len(take), node), np.full(len(take), len(s)), np.full(len(take), m), np.full(len(take), central))):
                    x.append(y)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(t) for x, t in zip(parts, types)], names)

    return docs.select("text").mapInArrow(run, schema)


def place_in_filter(h: np.ndarray) -> np.ndarray:
    return (mixed(h.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, packed, of which those are set that the hashes (a column h of longs) name."""
    step = FILTER_BITS // SLICES

    def places(batches):
        for b in batches:
            at = np.unique(place_in_filter(b.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(at // step, pa.int32()), pa.array(at % step, pa.int32())], ["slice", "at"])

    def union(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            slices_, at = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k in np.unique(slices_).tolist():
                held.setdefault(k, np.zeros(step, bool))[at[slices_ == k]] = True
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["slice", "payload"])

    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in hashes.mapInArrow(places, "slice int, at int").repartition(SLICES, "slice").mapInArrow(union, "slice int, payload binary").collect():
        whole[r.slice * step // 8 : (r.slice + 1) * step // 8] = np.frombuffer(r.payload, np.uint8)
    return whole


def candidate_sets(docs: DataFrame, pairs: DataFrame, collided: frozenset, words: int) -> DataFrame:
    """node and set (bytes of sorted hashes) for the nodes of pairs, and few others: the texts of their smallest ids are read again."""
    ids = [F.xxhash64(f"id_{k}") for k in "ab"]
    packed = hash_filter(pairs.select(F.explode(F.array("a", "b", *ids)).alias("h")))
    sent = Sent(docs.sparkSession, packed)

    def run(batches):
        wanted = np.unpackbits(sent.value).view(bool)
        seen: set[int] = set()
        for b in few_rows(batches):
            b = b.filter(pa.array(wanted[place_in_filter(b.column(0).to_numpy(zero_copy_only=False))]))
            node, sets = [], []
            every = shingle_sets(b.column(1).to_pylist(), words)
            names = fingerprints(every, collided)[0]
            hits = wanted[place_in_filter(np.array([k or 0 for k in names], np.int64))]
            for s, k, hit in zip(every, names, hits.tolist()):
                if k is None or not hit or k in seen:
                    continue
                if len(seen) < KEPT_NODES:
                    seen.add(k)
                node.append(k)
                sets.append(s.tobytes())
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return docs.select(F.xxhash64("id").alias("h"), "text").mapInArrow(run, "node long, set binary")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, collided: frozenset, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union. Parities sift them, so that few sets are dealt in vain."""
    for k in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("id", "size", "parity")]), k)
    least, _ = overlap_and_matches(lambda c: F.col(f"{c}_a") if c == "size" else F.lit(0), lambda c: F.col(f"{c}_b") if c == "size" else F.lit(0), percent)
    near = pairs.filter(sizes_allow("size_a", "size_b", percent)).filter(differing(F.col("parity_a"), F.col("parity_b")) <= F.col("size_a") + F.col("size_b") - 2 * least)
    near = pinned(near.select("a", "b", "id_a", "id_b"))
    if near.isEmpty():
        return near.select("a", "b")
    sets = written(candidate_sets(docs, near, collided, words), "sets")
    one = sets.groupBy("node").agg(F.first("set").alias("set"))
    joined = near.join(one.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(one.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = pinned(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    removed(sets)
    return links


def linked_components(docs: DataFrame, nodes: DataFrame, sketch: Sketch, collided: frozenset, words: int, percent: int) -> DataFrame:
    """node and component for every node that is linked with another."""
    posts = postings(docs, sketch, collided, words, percent)
    by = Window.partitionBy("shingle", "salt")
    rank = F.struct("central", "node")
    live = posts.withColumn("pivot", F.max(rank).over(by)).withColumn("last", F.min(rank).over(by)).filter("pivot <> last or salt > 0")
    live = written(live.select("shingle", "rank", "salt", "node", "size", "m", "pivot"), "postings")
    # a star's pairs only speed things up, so those that share few shingles are left to the exact rest
    stars = live.filter("node <> pivot.node").groupBy(F.col("pivot.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    stars = stars.filter("20 * shared >= size").select("a", "b")
    over = live.filter("salt > 0").select("shingle", "pivot").distinct()
    over = over.withColumn("a", F.max("pivot").over(Window.partitionBy("shingle"))).filter("a <> pivot").select(F.col("a.node").alias("a"), F.col("pivot.node").alias("b"))
    pairs = pinned(stars.unionByName(over).distinct())
    links = verified(docs, pairs, nodes, collided, words, percent)
    found = components(links)

    by = Window.partitionBy("shingle")
    rest = live.drop("pivot", "salt").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = rest.withColumn("low", F.min("component").over(by)).withColumn("high", F.max("component").over(by)).filter("low <> high")
    rest = rest.drop("low", "high").dropDuplicates(["shingle", "node"])
    rest = written(rest.join(nodes.select("node", folded(F.col("parity")).alias("parity")), "node"), "rest")
    removed(live)
    # as in the exact rest, which takes what these pairs leave: k of a link's shingles rank below size - least + k in both sets
    names = ("node", "size", "m", "component", "rank", "parity")
    pivots = F.array(*[F.max(F.struct(F.xxhash64("node", "shingle", F.lit(k)).alias("draw"), *names)).over(by) for k in range(PIVOTS)])
    spun = rest.withColumn("pivots", pivots).withColumn("pivot", F.explode("pivots"))
    least, needed = overlap_and_matches(F.col, lambda c: F.col(f"pivot.{c}"), percent)
    spun = spun.filter((F.col("component") != F.col("pivot.component")) & sizes_allow("size", "pivot.size", percent))
    spun = spun.filter((F.col("rank") < F.col("size") - least + needed) & (F.col("pivot.rank") < F.col("pivot.size") - least + needed))
    spun = spun.filter(differing_rows("parity", "pivot.parity") <= F.col("size") + F.col("pivot.size") - 2 * least)
    spun = pinned(spun.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct())
    links = pinned(links.unionByName(verified(docs, spun, nodes, collided, words, percent)))
    found = components(links)
    pairs = pairs.unionByName(spun)
    again = written(rest.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "rest")
    removed(rest)
    x, y = (again.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in names]) for k in "xy")
    least, needed = overlap_and_matches(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"), percent)
    near = F.expr("node_x < node_y and component_x <> component_y") & sizes_allow("size_x", "size_y", percent)
    for k in "xy":
        near &= F.col(f"rank_{k}") < F.col(f"size_{k}") - least + needed
    near &= differing_rows("parity_x", "parity_y") <= F.col("size_x") + F.col("size_y") - 2 * least
    counted = x.join(y, "shingle").filter(near).groupBy(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    counted = counted.agg(F.count("*").alias("shared"), F.first(needed).alias("needed"))
    more = pinned(counted.filter("shared >= needed").select("a", "b").join(pairs, ["a", "b"], "left_anti"))
    removed(again)
    if more.isEmpty():
        return found
    return components(links.unionByName(verified(docs, more, nodes, collided, words, percent)))


def jaccard_classes(docs: DataFrame, *, id_col="doc_id", text_col="text", words=WORDS, percent=PERCENT) -> DataFrame:
    """id, text_hash (64 bits, null for null), n_shingles, component_id (the smallest id reachable by links) and class (a long; null for
    an empty set), one row for each row of docs.

    Texts without words, null included, have an empty set and are linked with nothing, so that their component is their own id.
    Equal texts, in whatever rows, are one class; a null id is no candidate for the smallest, and a class that only has null ids has
    a null component_id. Rows that share an id are documents of their own. An empty table gives no rows.
    """
    text = col(text_col).cast("string")
    slim = docs.select(col(id_col).alias("id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("text_hash"), text.alias("text"))
    rows, sketch = rows_and_sketch(slim, words)
    rows, nodes, collided = nodes_of(rows)
    found = linked_components(slim, nodes, sketch, collided, words, percent)
    nodes = nodes.select("node", "id").join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component_id", F.col("component").alias("class"))
    out = rows.join(named, "node", "left")
    return out.select("id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "class")


def one_of_each(docs: DataFrame, *, id_col="doc_id", text_col="text", **more) -> DataFrame:
    """docs with one row of each class: of the smallest id, null ids last. Rows without words are in no class and stay.

    Of rows with that id in one class the one with the smallest text hash stays, and of equal texts the smallest row, so that reruns
    agree; columns must be orderable for that. An empty table gives no rows.
    """
    key = F.struct("id", "text_hash")
    found = pinned(jaccard_classes(docs, id_col=id_col, text_col=text_col, **more).groupBy("class", "id", "text_hash").agg(F.count("*").alias("rows")))
    first = found.filter("class is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "rows")).alias("f"))
    first = pinned(first.select("f.*"))
    alone = first.filter("rows = 1").select(key.alias("key")).unionByName(found.filter("class is null").select(key.alias("key")))
    text = col(text_col).cast("string")
    keyed = docs.select(F.struct(*[col(n) for n in docs.columns]).alias("row"), F.struct(col(id_col).alias("id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("text_hash")).alias("key"))
    kept = keyed.join(alone, "key", "left_semi").select("row")
    repeated = first.filter("rows > 1").select(key.alias("key"))
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row"))
    return kept.select(*[F.col("row").getField(n).alias(n) for n in docs.columns])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates among all documents; nulls, empty texts and repeats as jaccard_classes has them."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
"""
ORACLE = "WITH RECURSIVE" + ORACLE.split("WITH", 1)[1] + r"""
reach AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""
QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {"op5_jaccard_join": ORACLE}
