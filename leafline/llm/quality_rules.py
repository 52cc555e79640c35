"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document: its measurements are kept, and a bit is set for each rule that the document fails. A
policy is a named, versioned mask; applying one, and computing what each of its rules removes by itself, are bitwise operations on
the ledger that never touch the text again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, ascii_lower, col, table, written

SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the text.

    Windows are sorted with their places; those equal to a neighbour are repeated, and each adds the words up to the next, 3 at most.
    """
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    same = lambda s, x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
    repeated = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(s, x, k), F.lit(False))), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last"))
    return let(F.sort_array(F.transform(places, window)), lambda s: F.aggregate(repeated(s), start, step, lambda a: a["n"]))


def measured(docs: DataFrame, text_col: str, keep: list[str] | None) -> DataFrame:
    """row and the measurements of every rule."""
    names = docs.columns if keep is None else keep
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(F.col("text"), SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike("[^" + SPACE_CLASS[1:]))
    base = docs.select(F.struct(*[col(n) for n in names]).alias("row"), text.alias("text"))
    base = base.withColumn("words", words)
    plain = lambda c, marks: F.char_length(c) - F.char_length(F.translate(c, marks, ""))
    return base.select(
        "row", F.size("words").cast("long").alias("n_words"),
        plain(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.char_length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        let(F.col("words"), repeated_words).cast("long").alias("n_repeat_words"),
        let(lines, F.size).cast("long").alias("n_lines"),
        F.size(F.array_distinct(F.transform("words", ascii_lower))).cast("long").alias("n_distinct_words"),
        plain(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        plain(F.col("text"), "0123456789").cast("long").alias("n_digits"),
        plain(F.col("text"), "!").cast("long").alias("n_exclaims"),
    )


#: Rules by bit. Each is a failure, so that a mask of 0 is a clean document; integer arithmetic only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("exclaims", "10 * n_exclaims > 3 * n_words"),
    ("few_distinct_words", "n_words >= 200 and 100 * n_distinct_words < 10 * n_words"),
]
BITS = {name: k for k, (name, _) in enumerate(RULES)}
#: Policies by name and version.
POLICIES: dict[tuple[str, int], list[str]] = {
    ("base", 1): ["few_words", "repeated_words"],
    ("default", 1): ["few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words", "shouting", "digits", "exclaims"],
    ("default", 2): ["few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words", "shouting", "digits", "exclaims", "few_distinct_words"],
}


def mask_of(rules: list[str]) -> int:
    return sum(1 << BITS[r] for r in rules)


def ledger(docs: DataFrame, *, text_col="text", keep: list[str] | None = None) -> DataFrame:
    """row (the columns in keep, all by default), the measurements, and mask: bit k is set where rule k fails.

    Null and empty texts have no words, so they fail few_words and nothing else; repeated rows have equal masks; whole texts are
    measured, however long. An empty table gives an empty ledger.
    """
    mask = F.lit(0).cast("long")
    for k, (_, failure) in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.expr(failure), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text_col, keep).withColumn("mask", mask)


def passes(policy: tuple[str, int]) -> Column:
    return F.col("mask").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def apply_policy(ledger_: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """The rows that fail no rule of the policy."""
    return ledger_.filter(passes(policy)).select("row.*")


def ablation(ledger_: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """rule, failed (documents that fail it), only (that no other rule of the policy removes): one aggregate by mask, which has few values."""
    all_ = mask_of(POLICIES[policy])
    masks = ledger_.groupBy(F.col("mask").bitwiseAND(F.lit(all_)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = masks.select("mask", "n", F.explode(rules).alias("r"))
    has = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy("r.rule").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only"))


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of documents as a table in the shared folder: every rule is evaluated once, policies and ablations read the table."""
    return written(ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]), "ledger")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements, mask and verdicts by two policies; nulls, empty texts and repeats as ledger has them."""
    return stored_ledger(spark, sf_dir).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(("base", 1))).alias("base_failed"), passes(("default", 2)).alias("kept"), "mask", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_exclaims",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy fails in documents, and what no other of its rules does; without rows an empty table."""
    return ablation(stored_ledger(spark, sf_dir), ("default", 2))


def ledger_sql() -> str:
    failures = " + ".join(f"CASE WHEN {f} THEN {1 << k} ELSE 0 END" for k, (_, f) in enumerate(RULES))
    chars = lambda marks: f"length(text) - length(translate(text, '{marks}', ''))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({chars(SYMBOLS)} AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(list_distinct(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS BIGINT) AS n_distinct_words, CAST({chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS BIGINT) AS n_upper,
    CAST({chars("0123456789")} AS BIGINT) AS n_digits, CAST({chars("!")} AS BIGINT) AS n_exclaims
  FROM t LEFT JOIN r USING (doc_id)),
k AS (SELECT *, CAST({failures} AS BIGINT) AS mask FROM m)
"""


def oracle() -> str:
    return ledger_sql() + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (mask & {mask_of(POLICIES[("base", 1)])}) <> 0 AS base_failed,
  (mask & {mask_of(POLICIES[("default", 2)])}) = 0 AS kept, mask, n_lines, n_distinct_words, n_upper, n_digits, n_exclaims FROM k
"""


def ablation_oracle() -> str:
    policy = POLICIES[("default", 2)]
    rules = ", ".join(f"('{r}', {1 << BITS[r]})" for r in policy)
    return ledger_sql() + f"""
SELECT rule, CAST(count(*) FILTER (mask & bit <> 0) AS BIGINT) AS failed, CAST(count(*) FILTER (mask & {mask_of(policy)} = bit) AS BIGINT) AS "only"
FROM k, (VALUES {rules}) AS r(rule, bit) GROUP BY rule
"""


QUERIES = {"op9_quality_rules": op9_quality_rules, "quality_ablation": quality_ablation}
ORACLES = {"op9_quality_rules": oracle(), "quality_ablation": ablation_oracle()}
