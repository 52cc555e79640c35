"""Line deduplication with levelled sorted runs of line hashes, in DataFrame functions only.

The texts are split once, into a table of line hashes that is parted into batches by id. A run is a bucketed, sorted table of line
hashes with the document that holds them first; level k has runs of about fanout ** k batches. A new batch is merge-anti-joined with
every run (both sides bucketed alike, so only the batch is shuffled), adds a run of its new hashes at level 0, and a level that has
fanout runs is compacted into one run of the next. There are more batches than fanout, so that a whole table compacts, too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, col, removed, shared_dir, shuffles_removed, table, written

LEAST_CHARS, BATCHES, FANOUT = 10, 5, 4
#: Hashes of a run in one bucket, at most about; there are as many buckets as shuffle partitions at least.
BUCKET_ROWS = 4_000_000


def keys_of(lines: Column) -> Column:
    """Keys of lines: stripped of the contract's white space, ASCII lower case."""
    return F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(SPACE_CHARS))))


def hashed(key: Column, least: int) -> Column:
    """128 bits of a key as two longs; null for keys that are too short to count."""
    return F.when(F.char_length(key) >= least, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit("second")).alias("g")))


class LineRuns:
    """The levels. Runs are bucketed tables whose files are in the shared folder, until drop()."""

    def __init__(self, spark: SparkSession, name: str = "runs", *, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.prefix = f"leafline_{name}_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark).rstrip('/')}/leafline-{name}-{uuid.uuid4().hex}"
        self.buckets = buckets
        self.levels: list[list[str]] = [[]]
        self.made = self.compactions = 0

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def put(self, firsts: DataFrame) -> str:
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        if self.buckets is None:
            self.buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = firsts.select("h", "g", "first").repartition(self.buckets, "h", "g")
        with shuffles_removed(self.spark):
            dealt.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").format("parquet").option("path", self.path(name)).saveAsTable(name)
        return name

    def path(self, name: str) -> str:
        return f"{self.folder}/leafline-{name}"

    def add(self, lines: DataFrame) -> None:
        """lines (h, g, id) of one batch. Ids are larger than those of earlier batches, so the first holder of a hash never changes."""
        firsts = lines.groupBy("h", "g").agg(F.min("id").alias("first"))
        for run in self.runs():
            firsts = firsts.join(self.spark.table(run).select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        self.levels[0].append(self.put(firsts))
        k = 0
        while len(self.levels[k]) >= self.fanout:
            self.compact(k)
            k += 1

    def compact(self, k: int) -> None:
        """The runs of level k have no hash in common: their union is one run of the next level."""
        old = self.levels[k]
        merged = self.put(self.union(old))
        self.compactions += 1
        if len(self.levels) == k + 1:
            self.levels.append([])
        self.levels[k], self.levels[k + 1] = [], [*self.levels[k + 1], merged]
        self.forget(old)

    def union(self, names: list[str]) -> DataFrame:
        """Read by path: without buckets Spark can split what one very common line makes of a join."""
        return self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*map(self.path, names))

    def first_holders(self) -> DataFrame:
        """h, g, first of every hash so far, each once."""
        return self.union(self.runs())

    def forget(self, names: list[str]) -> None:
        files = [self.spark.table(n) for n in names]
        removed(*files)
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        self.forget(self.runs())
        self.levels = [[]]


def batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ids that part the table into batches of about equal size; fewer where ids repeat, one where they are not whole numbers."""
    if batches < 2:
        return []
    kind = docs.schema[docs.columns.index(id_col)].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        return []
    cuts = docs.agg(F.percentile_approx(col(id_col), [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    return sorted(set(cuts))


def line_hashes(docs: DataFrame, *, id_col="doc_id", text_col="text", least_chars=LEAST_CHARS, batches=BATCHES) -> tuple[DataFrame, int]:
    """A table of id, t (the text's hash, which tells rows of one id apart), h, g, pos of every line with a key that counts, parted
    by batch (null ids have none), and the number of batches."""
    bounds = batch_bounds(docs, id_col, batches)
    batch = sum(((col(id_col) > b).cast("int") for b in bounds), F.lit(0)) + F.when(col(id_col).isNotNull(), 0)
    keys = F.transform(keys_of(F.split(col(text_col).cast("string"), "\n")), lambda k: hashed(k, least_chars))
    lines = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col).cast("string")).alias("t"), batch.alias("batch"), F.posexplode(keys).alias("pos", "k"))
    lines = lines.filter("k is not null").select("id", "t", "k.h", "k.g", "pos", "batch")
    return written(lines, "lines"), len(bounds) + 1


def first_lines(lines: DataFrame, runs: LineRuns, batches: int) -> LineRuns:
    """Feeds lines (h, g, id, batch) to the runs, batch by batch; rows with a null id make no first holders."""
    if runs.buckets is None:
        runs.buckets = max(int(runs.spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // BUCKET_ROWS))
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k).select("id", "h", "g"))
    return runs


def dedup_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", least_chars=LEAST_CHARS, batches=BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """row (all columns of docs), n_lines, n_dropped and kept (the text that stays), one row for each row of docs.

    Null and empty texts are one empty line. A line stays in the document with the smallest id that holds its key, repeats there
    included; rows of one id are one document, and rows with a null id come after all others and lose what any of those holds, but
    nothing to each other. Keys below least_chars code points always stay. White space and ASCII case don't count for keys. An empty
    table gives no rows. Given runs are added to and stay the caller's, to drop() in the end; their documents' ids must be smaller.
    """
    lines, n = line_hashes(docs, id_col=id_col, text_col=text_col, least_chars=least_chars, batches=batches)
    made = first_lines(lines, runs or LineRuns(docs.sparkSession), n)
    later = lines.join(made.first_holders(), ["h", "g"]).filter("id is null or id > first")
    lost = written(later.groupBy(F.struct("id", "t").alias("key")).agg(F.collect_list("pos").alias("lost")), "lost")
    removed(lines)
    if runs is None:
        made.drop()
    text = col(text_col).cast("string")
    base = docs.select(F.struct("*").alias("row"), F.struct(col(id_col).alias("id"), F.xxhash64(text).alias("t")).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    base = base.join(lost, "key", "left").withColumn("lines", F.split("text", "\n"))
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(at, lambda i: F.get("lines", i)), "\n"))
    n_dropped = F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size(at)).cast("long")
    return base.select("row", F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), kept.alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds; nulls, empty texts and repeats as dedup_lines has them."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.line, k.pos, f.first IS NULL OR f.first = k.doc_id AS stays FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": ORACLE}
