"""Schema evolution and edits of content: impact of changes, renames, and text edits that keep what they don't touch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import markdown
from .schema import Schema


def impact(records: DataFrame, changes: list[dict]) -> DataFrame:
    """kind, field, breaking, before, after and affected (records that the change concerns): one pass, one row of counts, unpivoted."""
    if not changes:
        return records.sparkSession.createDataFrame([], "kind string, field string, breaking boolean, before string, after string, affected long")
    def hit(c):
        v = F.try_element_at("fm", F.lit(c["field"]))
        there = v.isNotNull()
        if c["kind"] == "required_added":
            return ~there
        if c["kind"] == "enum_value_removed":
            return there & (v["text"] == c["before"])
        return F.lit(False) if c["kind"] in ("field_added", "enum_value_added", "rule_added") else there

    counts = records.agg(F.array(*[F.count(F.when(F.coalesce(hit(c), F.lit(False)), 1)) for c in changes]).alias("n"))
    meta = F.array(*[F.struct(*[F.lit(c[k]).alias(k) for k in ("kind", "field", "breaking", "before", "after")]) for c in changes])
    return counts.select(F.explode(F.arrays_zip(meta.alias("c"), F.col("n").alias("n"))).alias("x")).select("x.c.*", F.col("x.n").alias("affected"))


def rename_field(records: DataFrame, old: str, new: str) -> DataFrame:
    """Metadata with one key renamed. A record that has both is an error for the whole run: look at collisions() first."""
    key = lambda k, v: F.when(k == old, F.lit(new)).otherwise(k)
    return records.withColumn("fm", F.when(F.map_contains_key("fm", F.lit(old)) & ~F.map_contains_key("fm", F.lit(new)), F.transform_keys("fm", key)).otherwise(F.col("fm")))


def collisions(records: DataFrame, old: str, new: str) -> DataFrame:
    return records.filter(F.map_contains_key("fm", F.lit(old)) & F.map_contains_key("fm", F.lit(new))).select("path")


# ---- text edits: plain functions, for staged content columns


def yaml_scalar(v: str) -> str:
    plain = re.fullmatch(r"[A-Za-zÀ-ɏ_][\w À-ɏ./-]*", v) and not re.fullmatch(r"(?i)true|false|null|yes|no|on|off|~", v) and v == v.strip()
    return v if plain else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def set_field(content: str, name: str, value: str, *, raw: bool = False) -> str:
    """One top-level metadata key set; other lines, comments and order stay."""
    line = f"{name}: {value if raw else yaml_scalar(value)}"
    bounds = markdown.frontmatter_bounds(content)
    if not bounds or bounds[1] < 0:
        return f"---\n{line}\n---\n{content}"
    head = content[bounds[0] : bounds[1]]
    pattern = re.compile(rf"(?m)^{re.escape(name)}[ \t]*:[^\n]*(?:\n(?:[ \t]+[^\n]*|[ \t]*-[^\n]*))*")
    head = pattern.sub(lambda _: line, head, count=1) if pattern.search(head) else head + ("" if head.endswith("\n") or not head else "\n") + line + "\n"
    return content[: bounds[0]] + head + content[bounds[1] :]


def set_section(content: str, heading: str, text: str, *, mode: str = "replace") -> str:
    """A section's content replaced or appended to, up to the next heading of its level or above; made at the end if there is none."""
    m = re.fullmatch(r"(#{1,6})\s+(.*?)\s*", heading)
    if not m:
        raise ValueError(f"bad heading {heading!r}")
    lines = content.split("\n")
    code = markdown.fenced(lines)
    start = next((i for i, x in enumerate(lines) if not code[i] and (h := markdown.ATX.match(x)) and len(h[1]) == len(m[1]) and (h[2] or "").strip() == m[2]), None)
    if start is None:
        return content.rstrip("\n") + f"\n\n{heading}\n\n{text.strip()}\n"
    end = next((i for i in range(start + 1, len(lines)) if not code[i] and (h := markdown.ATX.match(lines[i])) and len(h[1]) <= len(m[1])), len(lines))
    old = "\n".join(lines[start + 1 : end]).strip()
    new = text.strip() if mode == "replace" or not old else f"{old}\n{text.strip()}"
    return "\n".join([*lines[: start + 1], "", new, "", *lines[end:]]).rstrip("\n") + "\n"


def insert_links(content: str, links: list[str]) -> str:
    """Lines of missing wikilinks before the first level-2 heading."""
    missing = [x for x in links if not re.search(rf"(?m)^\s*{re.escape(x)}\s*$", content)]
    if not missing:
        return content
    m = re.search(r"(?m)^## ", content)
    at = m.start() if m else len(content)
    return content[:at].rstrip("\n") + "\n\n" + "\n".join(missing) + "\n\n" + content[at:]


def materialize_heading(level: int, text: str) -> str:
    if not 1 <= level <= 6 or "\n" in text and level > 2:
        raise ValueError("no heading has this level and text")
    return f"{'#' * level} {text}" if "\n" not in text else text + "\n" + ("=" if level == 1 else "-") * 3


def scaffold_sections(content: str, schema: Schema) -> str:
    """Sections that required, section-sourced string fields lack, each with its heading."""
    from .validate import selector

    for f in schema.fields.values():
        if f.required and f.source.startswith("body.section") and f.type in ("", "string"):
            level, text = selector(f.source)[-1]
            if not any(s["level"] == level and s["heading"] == text for s in markdown.extract(content)["body_sections"]):
                content = content.rstrip("\n") + "\n\n" + materialize_heading(level, text) + "\n"
    return content


def new_document(schema: Schema, title: str) -> str:
    head = "".join(f"{n}: {yaml_scalar(f.default if f.default is not None else f.values[0] if f.values else '')}\n" for n, f in schema.fields.items() if f.required and not f.source)
    return scaffold_sections(f"---\n{head}---\n\n# {title}\n", schema)


def title_of(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in re.split(r"[-_ ]+", name.rsplit(".", 1)[0]) if w)


def apply(contents: DataFrame, proposals: DataFrame) -> DataFrame:
    """path and content with every value proposal made, staged: nothing is written until the caller has validated the result.

    A field is set only where it still has the value that the proposal saw.
    """
    edits = proposals.filter(F.col("type").isin("add_field", "correct_value", "migrate_value", "correct_outlier", "extract_body", "infer_from_siblings", "propagate_aggregate", "quote_scalar"))
    per = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("field", "from", "to", "type"))).alias("edits"))

    @F.udf("string")
    def edited(content, edits):
        for e in edits or ():
            now = markdown.extract(content)["fm"].get(e["field"])
            if e["from"] is None and now is not None or e["type"] not in ("quote_scalar",) and e["from"] is not None and str(now) != e["from"]:
                continue
            content = set_field(content, e["field"], e["to"] or "", raw=e["type"] == "quote_scalar")
        return content

    return contents.join(per, "path", "left").select("path", F.when(F.col("edits").isNull(), F.col("content")).otherwise(edited("content", "edits")).alias("content"))


def aggregate_expression(name: str, values: list[str]) -> str:
    """A roll-up for an enum: its first value if all descendants have it, else the second, if there is one."""
    if not values:
        return "nil"
    q = lambda v: '"' + v.replace('"', '\\"') + '"'
    return f"all(descendants, {{.{name} == {q(values[0])}}}) ? {q(values[0])} : {q(values[min(1, len(values) - 1)])}"
