"""Inference from data: field statistics, constants, link types, sections, cross references, naming, levels, invariants, dependencies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import missing_back_references

REQUIRED_ABOVE, ENUM_VALUES, ENUM_ABOVE = 0.8, 20, 0.5


def field_values(records: DataFrame) -> DataFrame:
    """path, field and value of every metadata entry."""
    return records.select("path", "dir", "base", F.explode(F.map_entries("fm")).alias("e")).select("path", "dir", "base", F.col("e.key").alias("field"), F.col("e.value").alias("value"))


def field_stats(records: DataFrame) -> DataFrame:
    """field, present, distinct, is_list, total, inferred type and required.

    list if any value is one; enum with at most 20 distinct values and presence above half; else string. Required above 80 %.
    Distinct values are counted in two steps, by (field, text) first, so that no task gathers a field's values.
    """
    total = records.agg(F.count("*").alias("total"))
    one = field_values(records).groupBy("field", F.col("value.text").alias("text")).agg(F.count("*").alias("n"), F.max(F.col("value.repr") == "sequence").alias("is_list"))
    got = one.groupBy("field").agg(F.sum("n").alias("present"), F.count("*").alias("distinct_values"), F.max("is_list").alias("is_list")).join(F.broadcast(total))
    share = F.col("present") / F.col("total")
    kind = F.when(F.col("is_list"), "list").when((F.col("distinct_values") <= ENUM_VALUES) & (share > ENUM_ABOVE), "enum").otherwise("string")
    return got.withColumn("inferred_type", kind).withColumn("required", share > REQUIRED_ABOVE)


def enum_values(records: DataFrame) -> DataFrame:
    """field and its values (sorted) for inferred enums."""
    enums = field_stats(records).filter("inferred_type = 'enum'").select("field")
    return field_values(records).join(F.broadcast(enums), "field", "left_semi").groupBy("field").agg(F.sort_array(F.collect_set("value.text")).alias("enum_values"))


def constants(records: DataFrame, least: int = 3) -> DataFrame:
    """field and value in every one of at least three records."""
    total = records.agg(F.count("*").alias("total"))
    got = field_values(records).groupBy("field").agg(F.count("*").alias("present"), F.min("value.text").alias("value"), F.max("value.text").alias("high"))
    return got.join(F.broadcast(total)).filter((F.col("total") >= least) & (F.col("present") == F.col("total")) & (F.col("value") == F.col("high"))).select("field", "value")


def link_types(records: DataFrame, allowed: list[str] | None = None, share: float = 0.8) -> DataFrame:
    """type, n, total and suggested (a type of at least a share of all typed links); with allowed, the links of other types as violations."""
    typed = records.select("path", F.explode("links").alias("l")).filter(F.col("l.type") != "").select("path", F.col("l.type").alias("type"))
    if allowed is not None:
        return typed.filter(~F.col("type").isin(*allowed)).groupBy("path", "type").agg(F.count("*").alias("n"))
    counts = typed.groupBy("type").agg(F.count("*").alias("n"))
    all_ = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(all_)).withColumn("suggested", F.col("n") >= F.lit(share) * F.col("total"))


def section_patterns(records: DataFrame, threshold: float = 0.6) -> DataFrame:
    """level, heading, contributors, total and status (required in all records, else optional) of headings in a share of all records."""
    total = records.agg(F.count("*").alias("total"))
    heads = records.select("path", F.explode("body_sections").alias("s")).filter("s.level > 0").select("path", "s.level", "s.heading").distinct()
    got = heads.groupBy("level", "heading").agg(F.count("*").alias("contributors")).join(F.broadcast(total))
    return got.filter(F.col("contributors") >= F.lit(threshold) * F.col("total")).withColumn("status", F.when(F.col("contributors") == F.col("total"), "required").otherwise("optional"))


def section_selectors(records: DataFrame, threshold: float = 0.6) -> DataFrame:
    """level, heading and selector: the shortest suffix of heading paths that picks exactly one section in every record that has the heading.

    Null where suffixes leave several or none. Suffixes are rows, so families of any size are aggregated, not gathered.
    """
    occ = records.select("path", F.explode("body_sections").alias("s")).filter("s.level > 0").select("path", "s.level", "s.heading", F.col("s.path").alias("keys"))
    families = section_patterns(records, threshold).select("level", "heading", "contributors")
    occ = occ.join(F.broadcast(families), ["level", "heading"])
    text = lambda k: F.concat(F.repeat(F.lit("#"), k["level"]), F.lit(" "), k["text"])
    suffix = occ.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("keys")))).withColumn("selector", F.array_join(F.transform(F.slice("keys", -F.col("n"), F.col("n")), text), " / "))
    per = suffix.groupBy("level", "heading", "contributors", "n", "selector", "path").agg(F.count("*").alias("hits"))
    good = per.groupBy("level", "heading", "contributors", "n", "selector").agg(F.count("*").alias("records"), F.max("hits").alias("hits")).filter("hits = 1 and records = contributors")
    best = good.groupBy("level", "heading").agg(F.min(F.struct("n", "selector")).alias("b"))
    return families.join(best, ["level", "heading"], "left").select("level", "heading", F.col("b.selector").alias("selector"))


CROSS = r"\b[EFST]\d{2,4}(?:/[EFST]\d{2,4})*\b"


def cross_references(records: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """path, reference and, with directories (dir), whether its last part names one (E02 or E02-...)."""
    refs = records.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(CROSS), F.lit(0)))).alias("reference"))
    if directories is None:
        return refs
    names = directories.select(F.regexp_extract(F.element_at(F.split("dir", "/"), -1), r"^([EFST]\d{2,4})(?:-.*)?$", 1).alias("id")).filter("id <> ''").distinct()
    last = F.element_at(F.split("reference", "/"), -1)
    return refs.join(names.withColumn("resolved", F.lit(True)), last == F.col("id"), "left").select("path", "reference", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def invariants(records: DataFrame, headings: tuple[str, ...] = ("Invariantes", "Preserva")) -> DataFrame:
    """path, id and text of "INV1: text" items in some sections."""
    own = records.select("path", F.explode("body_sections").alias("s")).filter(F.col("s.heading").isin(*headings))
    pattern = r"(?m)^\s*(?:[-*+]\s+)?(INV\d+):\s*(.+?)\s*$"
    hits = own.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("s.content", F.lit(pattern), F.lit(1)).alias("id"), F.regexp_extract_all("s.content", F.lit(pattern), F.lit(2)).alias("text"))).alias("i"))
    return hits.select("path", "i.id", "i.text")


def formal_dependencies(records: DataFrame) -> DataFrame:
    """path, kind (formal or informal), type and target: typed links, and list items under "Dependencias" without one."""
    formal = records.select("path", F.explode("links").alias("l")).filter(F.col("l.type").isin("blocks", "relates", "extends")).select("path", F.lit("formal").alias("kind"), "l.type", "l.target")
    items = records.select("path", F.explode("body_sections").alias("s")).filter(F.col("s.heading") == "Dependencias").select("path", F.explode(F.regexp_extract_all("s.content", F.lit(r"(?m)^\s*[-*+]\s+(.+?)\s*$"), F.lit(1))).alias("target"))
    return formal.unionByName(items.filter(~F.col("target").contains("[[")).select("path", F.lit("informal").alias("kind"), F.lit("").alias("type"), "target"))


TRACE_VERBS = ("implements", "verifies", "satisfies", "traces", "refines", "derives", "covers")


def traceability(records: DataFrame, verbs: tuple[str, ...] = TRACE_VERBS) -> DataFrame:
    """path, verb, target and verified (a wikilink) of "Verb: a, b" lines."""
    pattern = r"(?im)^\s*(?:[-*+]\s+)?\**(" + "|".join(map(re.escape, verbs)) + r")\**\s*:\**\s*(.+?)\s*$"
    hits = records.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("verb"), F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("rest"))).alias("h"))
    each = hits.select("path", F.lower("h.verb").alias("verb"), F.explode(F.split("h.rest", r",(?![^\[]*\])")).alias("target")).withColumn("target", F.trim("target")).filter("target <> ''")
    return each.withColumn("verified", F.col("target").rlike(r"\[\[[^\[\]]+\]\]"))


def levels(records: DataFrame) -> DataFrame:
    """depth, kind (directory or file), prefix, digits and count of names like T001 in groups of two or more."""
    parts = F.split("path", "/")
    names = records.select(F.posexplode(parts).alias("depth", "name"), F.size(parts).alias("size"), "path")
    names = names.select("depth", F.when(F.col("depth") == F.col("size") - 1, "file").otherwise("directory").alias("kind"), "name", F.array_join(F.slice(F.split("path", "/"), 1, F.col("depth") + 1), "/").alias("full")).distinct()
    got = names.withColumn("prefix", F.regexp_extract("name", r"^([A-Za-z]+)(\d+)", 1)).withColumn("digits", F.length(F.regexp_extract("name", r"^([A-Za-z]+)(\d+)", 2))).filter("digits > 0")
    return got.groupBy("depth", "kind", "prefix", "digits").agg(F.count("*").alias("n")).filter("n >= 2")


PATTERNS = {"kebab-case": r"^[a-z0-9]+(-[a-z0-9]+)*$", "snake_case": r"^[a-z0-9]+(_[a-z0-9]+)+$", "PascalCase": r"^([A-Z][a-z0-9]+)+$", "camelCase": r"^[a-z]+([A-Z][a-z0-9]*)+$", "prefixed": r"^[A-Z]+\d+(-.*)?$"}


def naming(names: DataFrame, share: float = 0.7, least: int = 3) -> DataFrame:
    """dir, pattern, matching, total: the most frequent pattern of a directory's names (dir, name), if most but not all follow it."""
    counts = names.groupBy("dir").agg(F.count("*").alias("total"), *[F.count(F.when(F.col("name").rlike(p), 1)).alias(k) for k, p in PATTERNS.items()])
    best = F.array_max(F.array(*[F.struct(F.col(f"`{k}`").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(PATTERNS)]))
    got = counts.withColumn("b", best).filter((F.col("total") >= least) & (F.col("b.n") >= F.lit(share) * F.col("total")) & (F.col("b.n") < F.col("total")))
    return got.select("dir", F.col("b.k").alias("pattern"), F.col("b.n").alias("matching"), "total")


def child_bounds(children: DataFrame, least: int = 3) -> DataFrame:
    """min_children and max_children suggested by directories' child counts (dir, children)."""
    got = children.filter("children > 0").agg(F.count("*").alias("parents"), F.min("children").alias("low"), F.max("children").alias("high")).filter(F.col("parents") >= least)
    return got.select(F.greatest(F.lit(1), F.floor(F.col("low") * 0.8)).alias("min_children"), F.ceil(F.col("high") * 1.2).alias("max_children"), "parents")


def index_share(records: DataFrame, base: str = "README.md", share: float = 0.9) -> DataFrame:
    """directories, with_index and whether enough have an index to require it."""
    got = records.groupBy("dir").agg(F.max(F.col("base") == base).alias("has"))
    return got.agg(F.count("*").alias("directories"), F.count(F.when(F.col("has"), 1)).alias("with_index")).withColumn("suggested", F.col("with_index") >= F.lit(share) * F.col("directories"))


def uncovered(inferences: DataFrame, coverage: DataFrame) -> DataFrame:
    """Inferences (id, …) that not every relevant scope covers: coverage has id, relevant and covered for each scope."""
    done = coverage.filter("relevant").groupBy("id").agg(F.min("covered").alias("all")).filter("all").select("id")
    return inferences.join(done, "id", "left_anti")


def validation_gaps(records: DataFrame, schema, scope: str = "", share: float = 0.8, least: int = 3) -> DataFrame:
    """field and gap: enums without values, fields without type, incomplete sequences, and fields that most records have but none requires."""
    from .schema import declaration_issue

    spark = records.sparkSession
    static = [(n, {"incomplete-enum": "enum_without_values", "incomplete-type": "untyped", "incomplete-sequence": "sequence_incomplete"}[i]) for n, f in sorted(schema.fields.items()) if (i := declaration_issue(f)) in ("incomplete-enum", "incomplete-type", "incomplete-sequence")]
    loose = [n for n, f in schema.fields.items() if not f.required]
    own = spark.createDataFrame(static, "field string, gap string")
    if not loose:
        return own
    used = field_stats(records).filter(F.col("field").isin(*loose) & (F.col("total") >= least) & (F.col("present") >= F.lit(share) * F.col("total")))
    return own.unionByName(used.select("field", F.lit("required_understated").alias("gap")))


CATEGORIES = {
    "field_stats": field_stats, "enum_values": enum_values, "constant_fields": constants, "link_types": link_types, "section_patterns": section_patterns,
    "cross_references": cross_references, "invariants": invariants, "formal_dependencies": formal_dependencies, "traceability_links": traceability, "levels": levels,
}


def analyze(records: DataFrame, only: list[str] | None = None) -> dict[str, DataFrame | str]:
    """Every category by itself: one that fails gives its error's text and stops no other."""
    out: dict[str, DataFrame | str] = {}
    for name, f in CATEGORIES.items():
        if only is None or name in only:
            try:
                out[name] = f(records)
            except Exception as e:  # noqa: BLE001
                out[name] = f"detector_error: {e}"
    return out


def back_references(edges: DataFrame) -> DataFrame:
    return missing_back_references(edges)


def majority(values: DataFrame, keys: list[str], *, share: float, least: int) -> DataFrame:
    """keys, value, n and total: the value of most rows of a group (key columns, value), none on a tie, by share and least count."""
    counts = values.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    top = counts.withColumn("total", F.sum("n").over(w)).withColumn("best", F.max("n").over(w)).filter("n = best").withColumn("ties", F.count("*").over(w))
    return top.filter((F.col("ties") == 1) & (F.col("n") >= least) & (F.col("n") >= F.lit(share) * F.col("total"))).select(*keys, "value", "n", "total")
