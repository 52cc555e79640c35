"""Validation: one DataFrame of violations for each family of rules, united."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_component, glob_match, glob_regex, heading_slug
from . import graph
from .query import effective
from .schema import Field, Links, Rule, Schema

COLUMNS = ("path", "field", "rule", "severity", "message")
EXPECTED = {"string": ("string",), "enum": ("string",), "sequence": ("string",), "list": ("sequence",), "link": ("string", "sequence"), "boolean": ("boolean",), "integer": ("integer",)}


def struct(name: str, rule: str, severity: str, message) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def value_of(name: str, f: Field) -> Column:
    """Metadata, else the one body section (or first level-1 heading) that the field's source names."""
    own = F.try_element_at("fm", F.lit(name))
    if not f.source:
        return own
    from .query import as_text_value

    if f.source == "body.h1":
        heads = F.filter("body_sections", lambda s: s["level"] == 1)
        return F.coalesce(own, F.when(F.size(heads) > 0, as_text_value(F.get(heads, F.lit(0))["heading"])))
    hits = F.filter("body_sections", selected(f.source))
    return F.coalesce(own, F.when(F.size(hits) == 1, as_text_value(F.get(hits, F.lit(0))["content"])))


def selector(source: str) -> list[tuple[int, str]]:
    """Level and text of the headings that body.section["## X"]["### Y"] names."""
    keys = re.findall(r"\[\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)')\s*\]", source)
    out = []
    for a, b in keys:
        m = re.fullmatch(r"(#{1,6})\s+(.*?)\s*", a or b)
        if not m:
            raise ValueError(f"bad section selector {source!r}")
        out.append((len(m[1]), m[2]))
    return out


def selected(source: str):
    """Whether a section's path ends in the selector."""
    keys = selector(source)
    want = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(t).alias("text")) for n, t in keys])
    return lambda s: (F.size(s["path"]) >= len(keys)) & (F.slice(s["path"], -len(keys), len(keys)) == want)


def field_violations(name: str, f: Field, aggregated: set[str], index_base: str) -> list[Column]:
    """One nullable struct for each rule of a field; null where it holds, and for records that the field's match leaves out."""
    if f.severity == "off":
        return []
    out = []
    applies = any_component(F.col("path"), list(f.match)) if f.match else F.lit(True)
    ambiguous = F.lit(False)
    if f.source and f.source != "body.h1":
        ambiguous = ~F.map_contains_key("fm", F.lit(name)) & (F.size(F.filter("body_sections", selected(f.source))) > 1)
        out.append(F.when(ambiguous, struct(name, "source", f.severity, "several sections match")))
    v = value_of(name, f)
    if f.required:
        exempt = F.lit(False)
        if name in aggregated:
            exempt = exempt | (F.col("base") == index_base)
        if f.excludes:
            exempt = exempt | glob_match(F.col("path"), f.excludes)
        present = v.isNotNull() if f.source else F.map_contains_key("fm", F.lit(name))
        if f.required_match:
            exempt = exempt | ~any_component(F.col("path"), list(f.required_match))
        out.append(F.when(~present & ~exempt & ~ambiguous, struct(name, "required", f.severity, "missing")))
    there = v.isNotNull() & (v["repr"] != "null")
    good = v["repr"].isin(*EXPECTED[f.type]) if f.type in EXPECTED else F.lit(True)
    issue = F.when(there & ~good, struct(name, "type", f.severity, F.concat(F.lit(f"expected {f.type}, found "), v["repr"])))
    if f.type == "enum":
        issue = F.coalesce(issue, F.when(there & ~v["text"].isin(*f.values), struct(name, "enum", f.severity, v["text"])))
    if f.type == "sequence":
        issue = F.coalesce(issue, F.when(there & ~follows_sequence(v["text"], f), struct(name, "sequence-format", f.severity, v["text"])))
    if f.type == "link":
        linked = lambda c: c.rlike(r"\[\[[^\[\]]+\]\]")
        fine = F.when(v["repr"] == "sequence", F.forall(F.coalesce(v["items"], F.array().cast("array<struct<repr:string,text:string,num:double,bool:boolean>>")), lambda x: (x["repr"] == "string") & linked(x["text"]))).otherwise(linked(v["text"]))
        issue = F.coalesce(issue, F.when(there & ~fine, struct(name, "link-format", f.severity, v["text"])))
    return [F.when(applies, x) for x in (*out, F.when(~ambiguous, issue))]


def deepest(regex: str) -> Column:
    """Place of the last component of the path that a pattern fits, -1 for none."""
    return F.array_max(F.transform(F.split("path", "/"), lambda c, i: F.when(c.rlike(regex), i).otherwise(F.lit(-1))))


def follows_sequence(text: Column, f: Field) -> Column:
    """Whether a text has the prefix and digits of the field, or those that its match sets for the deepest component of the path."""
    form = lambda prefix, digits: text.rlike(f"^{re.escape(prefix or f.prefix)}[0-9]{{{digits or f.digits}}}$")
    out, best = form("", 0), F.lit(-1)
    for pattern, (prefix, digits) in sorted(f.match_config):
        if regex := glob_regex(pattern):
            last = deepest(regex)
            out, best = F.when(last > best, form(prefix, digits)).otherwise(out), F.greatest(best, last)
    return out


def rule_violations(r: Rule) -> list[Column]:
    if r.severity == "off":
        return []
    v = F.try_element_at("fm", F.lit(r.field))
    missing = ~F.map_contains_key("fm", F.lit(r.field))
    if r.rule == "non_empty":
        return [F.when(missing | ((v["repr"] == "string") & (v["text"] == "")), struct(r.field, "non_empty", r.severity, "empty"))]
    if r.rule == "exists":
        return [F.when(missing, struct(r.field, "exists", r.severity, "missing"))]
    if r.rule == "enum":
        return [F.when(~missing & ~v["text"].isin(*r.values), struct(r.field, "enum", r.severity, v["text"]))] if r.values else []
    cond = F.lit(True)
    for k, want in r.if_:
        cond = cond & (any_component(F.col("path"), [want]) if k == "match" else F.coalesce(effective(k)["text"] == want, F.lit(False)))
    return [F.when(cond & effective(n).isNull(), struct(n, "requires", r.severity, "missing")) for n in r.then]


def aggregate_violations(aggregated: dict, index_base: str) -> list[Column]:
    """Stored values of index records that differ from the computed ones, where both exist."""
    out = []
    for n in sorted(aggregated):
        stored, computed = F.try_element_at("fm", F.lit(n)), F.try_element_at("derived", F.lit(n))
        differs = (F.col("base") == index_base) & stored.isNotNull() & computed.isNotNull() & (stored["text"] != computed["text"])
        out.append(F.when(differs, struct(n, "aggregate", "error", F.concat(stored["text"], F.lit(" should be "), computed["text"]))))
    return out


def link_violations(links: Links) -> Column:
    """Array of violations of link types and targets, for links of the governed styles."""
    known = F.array(*[F.lit(s) for s in links.effective_styles])
    own = F.filter("links", lambda x: F.array_contains(known, x["style"]))
    named = lambda x, rule, message: F.struct(F.concat(F.lit("links."), x["type"]).alias("field"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"), message.alias("message"))
    parts = []
    if links.allowed:
        allowed = F.array(*[F.lit(a) for a in links.allowed])
        parts.append(F.transform(F.filter(own, lambda x: (x["type"] != "") & ~F.array_contains(allowed, x["type"])), lambda x: named(x, "link_type", x["target"])))
    for kind, rule in sorted(links.rules.items()):
        if rule.target:
            re.compile(rule.target)
            parts.append(F.transform(F.filter(own, off_target(kind, rule.target)), lambda x: named(x, "link_target", x["target"])))
    return F.concat(*parts) if parts else None


def link_checks(records: DataFrame, links: Links, files: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """path, field, rule, severity and message of links (of the governed styles) that lead nowhere (on unless the schema says no), whose
    anchor is no heading of the record they lead to, or that have spaces in their target (both if the schema asks).

    files has the paths that targets may name, records or not; anchors are looked up in the headings of among (records themselves if
    not given), and one in a file that is no record is not judged. Where base names may stand for paths, a target that no path fits
    is a warning. One equi-join for each check.
    """
    e = graph.edges(records, links.effective_styles)
    found = lambda df, rule, severity, message: df.select(F.col("source").alias("path"), F.lit("links").alias("field"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))
    parts = []
    if links.checks.get("encoding"):
        parts.append(found(e.filter(F.col("target").contains(" ")), "link_encoding", "error", F.col("target")))
    if links.resolves or links.checks.get("anchors"):
        e = graph.resolve(e, files)
    if links.resolves:
        rule, severity = ("link_unverifiable", "warn") if links.basename_fallback else ("link_resolve", "error")
        parts.append(found(e.filter("to is null"), rule, severity, F.col("target")))
    if links.checks.get("anchors"):
        heads = (records if among is None else among).select(F.col("path").alias("to"), F.transform("body_sections", lambda s: heading_slug(s["heading"])).alias("slugs"))
        asked = e.filter("anchor <> ''").join(heads, "to")
        parts.append(found(asked.filter(~F.array_contains("slugs", F.lower(graph.decoded(F.col("anchor"))))), "link_anchor", "error", F.concat("anchor", F.lit(" not found in "), "to")))
    return reduce(DataFrame.unionByName, parts) if parts else records.select("path").limit(0).select("path", *[F.lit("").alias(c) for c in COLUMNS[1:]])


def off_target(kind: str, pattern: str):
    return lambda x: (x["type"] == kind) & ~x["target"].rlike(pattern)


def violations(records: DataFrame, schema: Schema) -> DataFrame:
    """path, field, rule, severity and message of each violation, in one pass over the records: no shuffle."""
    each: list[Column] = []
    for n, f in sorted(schema.fields.items()):
        each += field_violations(n, f, set(schema.aggregate), schema.index_base)
    each += aggregate_violations(schema.aggregate, schema.index_base)
    for r in schema.validate:
        each += rule_violations(r)
    kind = "struct<field:string,rule:string,severity:string,message:string>"
    found = F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast(f"array<{kind}>")
    if (linked := link_violations(schema.links)) is not None:
        found = F.concat(found, linked)
    errors = F.transform("errors", lambda e: F.struct(F.lit("").alias("field"), F.lit("malformed_yaml").alias("rule"), F.lit("error").alias("severity"), e["message"].alias("message")))
    return records.select("path", F.explode(F.concat(found, errors)).alias("v")).select("path", "v.*")


def results(records: DataFrame, found: DataFrame) -> DataFrame:
    """path, valid, errors and warnings of every record."""
    warn = F.col("severity") == "warn"
    counts = found.groupBy("path").agg(F.count(F.when(~warn, 1)).alias("errors"), F.count(F.when(warn, 1)).alias("warnings"))
    out = records.select("path").join(counts, "path", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("valid", F.col("errors") == 0)


def summary(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("valid"), 1)).alias("valid"), F.count(F.when(~F.col("valid"), 1)).alias("invalid"),
        F.count(F.when(F.col("warnings") > 0, 1)).alias("with_warnings"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
    )


def drift(records: DataFrame, fields: list[str], *, index_base: str = "README.md") -> DataFrame:
    """dir, field, parent and children where the index has another text than all of its directory's records that have the field agree on."""
    names = F.array(*[F.lit(n) for n in fields])
    rows = records.select("dir", (F.col("base") == index_base).alias("is_index"), F.explode(F.map_entries(F.map_filter("fm", lambda k, _: F.array_contains(names, k)))).alias("e"))
    rows = rows.filter(F.col("e.value.repr") != "null").select("dir", "is_index", F.col("e.key").alias("field"), F.col("e.value.text").alias("text"))
    got = rows.groupBy("dir", "field").agg(
        F.max(F.when(F.col("is_index"), F.col("text"))).alias("parent"), F.min(F.when(~F.col("is_index"), F.col("text"))).alias("low"), F.max(F.when(~F.col("is_index"), F.col("text"))).alias("high"),
    )
    return got.filter("parent is not null and low = high and parent <> low").select("dir", "field", "parent", F.col("low").alias("children"))


def structural(inventory: DataFrame, *, min_children: int | None = None, max_children: int | None = None, require_index: str | None = None) -> DataFrame:
    """dir, rule and children for the directories of an inventory (path, is_dir) that break a rule; hidden ones don't count."""
    shown = inventory.filter(~F.col("path").rlike(r"(^|/)\."))
    dirs = shown.filter("is_dir").select(F.col("path").alias("dir"))
    parts = F.split("path", "/")
    kids = shown.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("base"))
    kids = kids.groupBy("dir").agg(F.count("*").alias("children"), F.max(F.col("base") == F.lit(require_index or "")).alias("index"))
    d = dirs.join(kids, "dir", "left").fillna(0, ["children"])
    none = F.lit(None)
    checks = [
        F.when(F.col("children") < min_children, F.lit("min_children")) if min_children is not None else none,
        F.when(F.col("children") > max_children, F.lit("max_children")) if max_children is not None else none,
        F.when(~F.coalesce("index", F.lit(False)), F.lit("require_index")) if require_index else none,
    ]
    return d.select("dir", F.explode(F.filter(F.array(*[c.cast("string") for c in checks]), lambda x: x.isNotNull())).alias("rule"), "children")


def explain(records: DataFrame, schema: Schema) -> DataFrame:
    """path, field, text and origin (frontmatter, derived, aggregate, schema default or missing) of every field known for a record."""
    names = sorted({*schema.fields, *schema.derive, *schema.aggregate})
    rows = []
    for n in names:
        default = schema.fields[n].default if n in schema.fields else None
        derived, own = F.try_element_at("derived", F.lit(n)), F.try_element_at("fm", F.lit(n))
        origin = F.when(derived.isNotNull(), F.lit("aggregate" if n in schema.aggregate else "derived")).when(own.isNotNull(), F.lit("frontmatter")).otherwise(F.lit("missing" if default is None else "schema"))
        rows.append(F.struct(F.lit(n).alias("field"), F.coalesce(derived["text"], own["text"], F.lit(default).cast("string")).alias("text"), origin.alias("origin")))
    return records.select("path", F.explode(F.array(*rows)).alias("x")).select("path", "x.*")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
