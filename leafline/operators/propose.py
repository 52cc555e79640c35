"""Repair proposals: detectors over records and violations, with the order in which they suppress each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bold_fields, close_enough
from .infer import field_values, majority
from .schema import Schema
from .validate import union

COLUMNS = ("type", "field", "path", "from", "to")
BLOCKED = r"^\s*(.*?)\s*\(\s*blocked by\s+(.+?)\s*\)\s*$"
#: Body words that stand for enum values.
BODY_VALUES = {"completado": "completed", "pendiente": "pending", "en progreso": "in_progress", "bloqueado": "blocked"}


def shaped(df: DataFrame, kind: str, *, field="field", path="path", from_=None, to=None) -> DataFrame:
    none = F.lit(None).cast("string")
    c = lambda x: none if x is None else (F.col(x) if isinstance(x, str) else x).cast("string")
    return df.select(F.lit(kind).alias("type"), F.col(field).alias("field"), c(path).alias("path"), c(from_).alias("from"), c(to).alias("to"))


def blocking(c: Column) -> Column:
    """base, targets and notes of "X (blocked by A + B, note)": targets are ids like T012."""
    inner = F.regexp_extract(c, BLOCKED, 2)
    parts = F.transform(F.split(inner, r"\s*[+,]\s*"), lambda x: F.trim(x))
    is_id = lambda x: x.rlike(r"^[A-Z]+\d+[\w/-]*$")
    return F.when(c.rlike(BLOCKED), F.struct(F.regexp_extract(c, BLOCKED, 1).alias("base"), F.filter(parts, is_id).alias("targets"), F.filter(parts, lambda x: ~is_id(x)).alias("notes")))


def map_value(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in BODY_VALUES.items() for x in kv])
    return F.coalesce(F.try_element_at(words, F.lower(F.trim(c))), c)


def extend_enum(bad: DataFrame, least: int = 2) -> DataFrame:
    """An invalid enum value in two or more records, without a parenthesis."""
    got = bad.filter((F.col("rule") == "enum") & ~F.col("message").contains("(")).groupBy("field", "message").agg(F.countDistinct("path").alias("n"))
    return shaped(got.filter(F.col("n") >= least), "extend_enum", path=None, to="message")


def migrate_value(bad: DataFrame, schema: Schema) -> DataFrame:
    """Values like "X (blocked by A)" whose base is, or is close to, an enum value."""
    got = bad.filter(F.col("rule") == "enum").withColumn("b", blocking(F.col("message"))).filter("b is not null")
    return shaped(nearest(got.withColumn("word", F.col("b.base")), schema), "migrate_value", from_="message", to="best")


def correct_value(bad: DataFrame, schema: Schema) -> DataFrame:
    got = bad.filter((F.col("rule") == "enum") & ~F.col("message").rlike(BLOCKED)).withColumn("word", F.col("message"))
    return shaped(nearest(got, schema), "correct_value", from_="message", to="best")


def nearest(df: DataFrame, schema: Schema) -> DataFrame:
    """best: the closest enum value of the row's field to its word. Values are literals of the plan: nothing is joined."""
    best = F.lit(None).cast("string")
    for n, f in schema.fields.items():
        if f.values:
            vals = F.array(*[F.lit(v) for v in sorted(f.values)])
            near = F.filter(F.transform(vals, lambda v: F.struct(F.levenshtein(F.lower(F.col("word")), F.lower(v)).alias("d"), v.alias("v"))), lambda x: close_enough(F.col("word"), x["v"]))
            best = F.when(F.col("field") == n, F.array_min(near)["v"]).otherwise(best)
    return df.withColumn("best", best).filter("best is not null")


def extract_body(records: DataFrame, bad: DataFrame) -> DataFrame:
    """Missing required fields that the body states as **Key**: value."""
    missing = bad.filter(F.col("rule") == "required").select("path", "field")
    found = missing.join(records.select("path", bold_fields(F.col("body")).alias("b")), "path").withColumn("v", F.try_element_at("b", F.lower("field"))).filter("v is not null and v <> ''")
    return shaped(found, "extract_body", to=map_value(F.col("v")))


def infer_from_siblings(records: DataFrame, bad: DataFrame, *, index_base="README.md", share=0.6, least=2) -> DataFrame:
    """Missing required fields that most siblings with a string value agree on."""
    vals = field_values(records.filter(F.col("base") != index_base)).filter(F.col("value.repr") == "string").select("dir", "field", F.col("value.text").alias("value"))
    top = majority(vals, ["dir", "field"], share=share, least=least)
    missing = bad.filter(F.col("rule") == "required").select("path", "field").join(records.filter(F.col("base") != index_base).select("path", "dir"), "path")
    return shaped(missing.join(top, ["dir", "field"]), "infer_from_siblings", to="value")


def correct_outlier(records: DataFrame, bad: DataFrame, *, index_base="README.md", share=0.75, least=3) -> DataFrame:
    """Valid values that differ from what at least three quarters of the directory's records have."""
    vals = field_values(records.filter(F.col("base") != index_base)).filter(F.col("value.repr") == "string").select("path", "dir", "field", F.col("value.text").alias("value"))
    vals = vals.join(bad.select("path", "field").distinct(), ["path", "field"], "left_anti")
    top = majority(vals, ["dir", "field"], share=share, least=least).select("dir", "field", F.col("value").alias("most"))
    return shaped(vals.join(top, ["dir", "field"]).filter("value <> most"), "correct_outlier", from_="value", to="most")


def add_field(bad: DataFrame, schema: Schema) -> DataFrame:
    """Missing required fields get the default, else the first enum value, else an empty text."""
    to = F.lit("")
    for n, f in schema.fields.items():
        to = F.when(F.col("field") == n, F.lit(f.default if f.default is not None else f.values[0] if f.values else "")).otherwise(to)
    return shaped(bad.filter(F.col("rule") == "required"), "add_field", to=to)


def correct_link(records: DataFrame, bad: DataFrame, schema: Schema) -> DataFrame:
    """Targets that break their pattern: the only sibling whose base name begins so, else another type whose pattern they meet."""
    links = bad.filter(F.col("rule") == "link_target").select("path", F.regexp_replace("field", r"^links\.", "").alias("field"), F.col("message").alias("target"))
    names = records.select("dir", F.regexp_replace("base", r"\.[^.]*$", "").alias("name"))
    near = links.join(records.select("path", "dir"), "path").join(names, "dir").filter(F.col("name").startswith(F.col("target")) & (F.col("name") != F.col("target")))
    one = near.groupBy("path", "field", "target").agg(F.count("*").alias("n"), F.first("name").alias("name")).filter("n = 1")
    retype = F.coalesce(*[F.when((F.col("field") != k) & F.col("target").rlike(r.target), F.lit(k)) for k, r in sorted(schema.links.rules.items()) if r.target], F.lit(None).cast("string"))
    rest = links.join(one.select("path", "field", "target"), ["path", "field", "target"], "left_anti").withColumn("kind", retype).filter("kind is not null")
    return shaped(one, "correct_link", from_="target", to="name").unionByName(shaped(rest, "retype_link", from_="target", to=F.concat("kind", F.lit(":"), "target")))


def quote_scalars(bad: DataFrame, records: DataFrame) -> DataFrame:
    """Scalars of another representation in string fields: their text, quoted."""
    wrong = bad.filter((F.col("rule") == "type") & F.col("message").startswith("expected string")).select("path", "field")
    got = field_values(records).filter(F.col("value.repr").isin("boolean", "integer", "timestamp")).select("path", "field", F.col("value.text").alias("text"))
    return shaped(wrong.join(got, ["path", "field"]), "quote_scalar", from_="text", to=F.concat(F.lit('"'), "text", F.lit('"')))


def propagate_aggregate(bad: DataFrame) -> DataFrame:
    """Stored roll-ups that differ from the computed ones."""
    got = bad.filter(F.col("rule") == "aggregate")
    return shaped(got, "propagate_aggregate", from_=F.regexp_extract("message", "^(.*) should be ", 1), to=F.regexp_extract("message", " should be (.*)$", 1))


def propose(records: DataFrame, bad: DataFrame, schema: Schema) -> DataFrame:
    """All proposals. Migration goes before enum extension and correction; body, sibling values before defaults."""
    own = lambda df, *others: df.join(union([o.select("path", "field") for o in others]).distinct(), ["path", "field"], "left_anti").select(*COLUMNS)
    migrate, body = migrate_value(bad, schema), extract_body(records, bad)
    siblings = own(infer_from_siblings(records, bad), body)
    return union([
        extend_enum(bad), migrate, own(correct_value(bad, schema), migrate), body, siblings, own(add_field(bad, schema), body, siblings),
        correct_outlier(records, bad), correct_link(records, bad, schema), quote_scalars(bad, records), propagate_aggregate(bad),
    ])


def summarize(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("type").agg(F.count("*").alias("n"))
