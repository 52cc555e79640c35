"""A training corpus from raw documents: language ID, line dedup, near-duplicate removal, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents. run() writes each stage's result as Parquet in the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from leafline.llm.common import SPACE_CHARS, fold_col, table, written

#: Share of the likelihood below which a language is too uncertain to keep the document.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty texts among them, or without a language that is likelier than the others together, go.

    The model learns from labelled documents with an id outside fold 1; a null id or language keeps none from being predicted. A tie goes to
    the first language and its share is below the limit. Repeated rows are judged alike. An empty table, or one without labels, gives no rows.
    """
    model = language_id.fit(docs.filter(fold_col(F.col("doc_id"), 3) != 1))
    found = language_id.predict(docs, model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that several documents hold stays in the first; documents of which nothing but white space stays go.

    Null and empty texts lose no line and stay as empty texts. Rows of one id are one document; rows without an id lose what any
    document with one holds. n_chars, where there is one, is counted anew. An empty table gives no rows.
    """
    found = line_dedup.dedup_lines(docs)
    kept = found.filter((F.col("n_dropped") == 0) | (F.length(F.btrim("kept", F.lit(SPACE_CHARS))) > 0))
    names = [n for n in docs.columns if n not in ("text", "n_chars")]
    rest = [F.length("kept").cast("long").alias("n_chars")] if "n_chars" in docs.columns else []
    return kept.select(*[F.col("row").getField(n).alias(n) for n in names], F.col("kept").alias("text"), *rest).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays: that of the smallest id.

    A null id comes after all others; of rows that share the smallest id one stays. Null, empty and wordless texts are in no class
    and stay. An empty table gives no rows.
    """
    return jaccard_join.one_of_each(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go.

    Null and empty texts hold none, and items without words are in no text. Repeated rows are judged alike; ids don't matter. An empty
    table gives no rows, an empty benchmark leaves all.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it.

    A null source is a source of its own, last in the order; a null text has no words and nothing is taken of it. Repeated rows are
    documents of their own, in the order of a hash of the id. An empty table gives no rows.
    """
    return mixing.mix(docs, keep=["doc_id", "source"]).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", remove_benchmarks),
    ("mixing", mix_sources),
]
#: Language ID and the order of the mix can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what the other stages keep of documents; each stage says what it makes of nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
