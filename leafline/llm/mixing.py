"""Mixing sources to target weights by entropy balancing.

Documents are base-weighted by their words; the balancing weights w stay as close to 1 as the token constraints allow, in relative
entropy. The dual is convex and is solved by Newton iterations whose gradient and Hessian are sums over the cells of the corpus (one
for each combination of constraint keys), computed by Spark; the weights are exponentially tilted rates, w = exp(sum of multipliers).
Rates become copies: in the order of a hash of the document, the first documents of a source get one copy more than the rest, so
that the words taken meet the source's target; the one document at the border is taken in part, for the words still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, col, pinned, table

SHARE, MOST, WEIGHTS = 1.5, 2.0, (5.0, 2.0, 1.0)
#: Documents of a source in one bucket of the running sums: a hot source is cut into many.
BUCKET_DOCS = 4096


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^" + SPACE_CLASS[1:] + "+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """source, words, docs and place: the source's place in code-point order, null last. One row for each source is sorted, not documents."""
    return sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)


def targets_for(sources: DataFrame, *, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """sources with target: weights in turn, share times all words; targets stop at most times the source's words and the excess is
    shared again by weight until none is above. Each round takes two sums to the driver."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))) + 1)
    now = pinned(ranked(sources).withColumn("weight", weight).withColumn("cap", most * F.col("words")))
    total = now.agg(F.sum("words")).first()[0] or 0
    level, rest, weight_left = 0.0, share * total, None
    while True:  # a source whose cap is below level * weight is full; the level only rises
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        caps, weight_sum, n_full = now.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, True))).first()
        if not weight_sum or n_full == weight_left:
            break
        weight_left = n_full
        level = (rest - (caps or 0.0)) / weight_sum
    return now.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight")))


def balance(cells: DataFrame, *, tolerance: float = 1e-9, iterations: int = 60) -> DataFrame:
    """cells (source, words, target) with rate: Newton on the dual, one multiplier for each source.

    The gradient of the dual is the words taken less the target and its Hessian the words taken, so it is diagonal and each
    iteration is a projection and one aggregate; a step is held to 2 so that the exponential can't overshoot. Sources without words
    or with a target of 0 take nothing.
    """
    live = (F.col("words") > 0) & (F.col("target") > 0)
    now = cells.withColumn("multiplier", F.lit(0.0))
    for k in range(iterations):
        taken = F.col("words") * F.exp("multiplier")
        step = F.least(F.lit(2.0), F.greatest(F.lit(-2.0), (F.col("target") - taken) / taken))
        now = now.withColumn("multiplier", F.when(live, F.col("multiplier") + step).otherwise(F.col("multiplier")))
        if k % 4 == 3:  # the residual is looked at every fourth iteration
            now = pinned(now)
            off = now.filter(live).agg(F.max(F.abs(F.col("words") * F.exp("multiplier") - F.col("target")) / F.col("target"))).first()[0]
            if (off or 0.0) <= tolerance:
                break
    return now.withColumn("rate", F.when(live, F.exp("multiplier")).otherwise(0.0))


def mix(docs: DataFrame, *, id_col="doc_id", source_col="source", text_col="text", keep: list[str] | None = None, **rule) -> DataFrame:
    """row (the columns in keep), size, source_size, target, rate, copies and taken, one row for each row of docs.

    Null texts have size 0; a null source is a source of its own, last in the order. Documents of size 0 are taken 0 times.
    Equal rows are separate documents. An empty table gives no rows. No document is taken more than rule's most times, and the words
    that a source's documents are taken together differ from its target by less than one.
    """
    order = F.xxhash64(F.lit("mix"), col(id_col).cast("string"))
    slim = docs.select(
        F.struct(*[col(n) for n in (docs.columns if keep is None else keep)]).alias("row"),
        col(source_col).cast("string").alias("source"), n_words(col(text_col)).alias("size"), order.alias("order"), col(id_col).cast("string").alias("id"),
    )
    slim = pinned(slim)
    sources = slim.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    rates = balance(targets_for(sources, **rule))
    #: whole copies of each document, and the words that further copies must give: integers, so that reruns agree
    whole = F.floor(F.col("rate") + 1e-9).cast("long")
    quota = F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - whole * F.col("words"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_DOCS)).cast("long")
    rates = pinned(rates.select(F.struct("source").alias("key"), F.col("words").alias("source_size"), "target", "rate", whole.alias("whole"), quota.alias("quota"), buckets.alias("buckets")))
    # one row for each source, joined to every document: broadcast where Spark knows it small, else a join that AQE splits
    at = slim.withColumn("key", F.struct("source")).join(rates, "key", "left")
    at = at.withColumn("bucket", F.floor(((F.col("order") / F.lit(2.0**63)) + 1.0) / 2.0 * F.col("buckets")).cast("long"))
    at = at.withColumn("bucket", F.least(F.col("bucket"), F.col("buckets") - 1))
    # one column, else rows that the join has dealt by source count as dealt by source and bucket, and a source's meet in one task
    at = at.withColumn("cell", F.struct("key", "bucket"))
    before = at.groupBy("cell").agg(F.sum("size").alias("words"))
    by_bucket = Window.partitionBy("cell.key").orderBy("cell.bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("cell", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)).alias("before"))
    inside = Window.partitionBy("cell").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.join(before, "cell").withColumn("offset", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    extra = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("quota") - F.col("offset")))
    return at.select(
        "row", "size", "source_size", "target", "rate",
        (F.col("whole") + (extra > 0).cast("long")).alias("copies"), (F.col("whole") * F.col("size") + extra).alias("taken"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document; null sources, empty texts and repeats as mix has them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken", "rate", "copies")


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
