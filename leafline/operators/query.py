"""Filter, sort, limit, count and projection over records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Scope, Val, compile_filter, free_names, parse
from ..functions.scalars import closest

BUILTINS = ("path", "body", "type")


def effective(name: str) -> Column:
    """The derived value where there is one (a derived null shadows), else the metadata's; null where the name is missing."""
    return F.when(F.map_contains_key("derived", F.lit(name)), F.try_element_at("derived", F.lit(name))).otherwise(F.try_element_at("fm", F.lit(name)))


def has(name: str) -> Column:
    return F.map_contains_key("derived", F.lit(name)) | F.map_contains_key("fm", F.lit(name))


def as_text_value(c: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit("string").alias("repr"), c.alias("text"), none.cast("double").alias("num"), none.cast("boolean").alias("bool"), none.cast("array<struct<repr:string,text:string,num:double,bool:boolean>>").alias("items"), none.cast("string").alias("json"))


def where_scope(aliases: dict[str, str] | None = None) -> Scope:
    """Metadata and derived values overlay path, body and type; sections are a map; aliases never shadow a field."""

    def resolve(name: str) -> Val:
        if name == "sections":
            return Val("map", F.col("sections"))
        value = effective(name)
        if name in BUILTINS:
            value = F.when(has(name), value).otherwise(as_text_value(F.col(name)))
        elif aliases and name in aliases:
            value = F.when(has(name), value).otherwise(effective(aliases[name]))
        return Val("fv", value)

    return Scope(resolve)


def where(records: DataFrame, *conditions: str, aliases: dict[str, str] | None = None, compat: bool = False) -> DataFrame:
    """Rows for which every condition is true. compat joins the texts without parentheses before parsing, as a plain join does."""
    texts = [" && ".join(conditions)] if compat and conditions else list(conditions)
    out = records
    for text in texts:
        out = out.filter(compile_filter(text, where_scope(aliases)))
    return out


def known_names(records: DataFrame, schema_names: set[str] = frozenset()) -> set[str]:
    """Names that conditions may use: keys of the records, the schema's, and the built-in ones; empty if there are no fields."""
    keys = {r[0] for r in records.select(F.explode(F.array_union(F.map_keys("fm"), F.map_keys("derived")))).distinct().collect()}
    fields = keys | set(schema_names)
    return fields | {*BUILTINS, "sections"} if fields else set()


def unknown_names(condition: str, known: set[str]) -> list[tuple[str, str | None]]:
    """(name, nearest known name) for the names of a condition that aren't known."""
    return [(n, closest(n, sorted(known))) for n in sorted(free_names(parse(condition)) - known)] if known else []


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False


def parse_sort(spec: str) -> list[SortKey]:
    out = []
    for part in spec.split(","):
        if not part.strip():
            if spec.strip():
                raise ValueError("empty sort key")
            continue
        name, *direction = (x.strip() for x in part.split(":"))
        if len(direction) > 1 or not name or (direction and direction[0] not in ("asc", "desc")):
            raise ValueError(f"bad sort key {part.strip()!r}")
        out.append(SortKey(name, direction == ["desc"]))
    return out


def check_sort(keys: list[SortKey], known: set[str]) -> None:
    for k in keys:
        if k.field == "sections" or (known and k.field not in known):
            near = closest(k.field, sorted(known - {"sections"}))
            raise ValueError(f"unknown sort field {k.field!r}" + (f"; did you mean {near!r}?" if near else ""))


def sort(records: DataFrame, keys: list[SortKey] | str, *, enums: dict[str, list[str]] | None = None, tie: Column | None = None) -> DataFrame:
    """By several keys, missing and null last either way, ties in scan order.

    Enum fields sort by their place in the list, unknown values after all. Any other value sorts as a number if it is one, numbers
    before text: one total order, whatever mix the column holds.
    """
    keys = parse_sort(keys) if isinstance(keys, str) else keys
    order = []
    for k in keys:
        way = (lambda c: c.desc_nulls_last()) if k.descending else (lambda c: c.asc_nulls_last())
        if k.field in BUILTINS:
            order.append(way(F.col(k.field)))
            continue
        v = effective(k.field)
        missing = v.isNull() | (v["repr"] == "null")
        order.append(F.coalesce(missing, F.lit(True)).asc())
        if enums and k.field in enums:
            place = F.array_position(F.lit(enums[k.field]) if enums[k.field] else F.array().cast("array<string>"), v["text"])
            order.append(way(F.when(place == 0, len(enums[k.field]) + 1).otherwise(place)))
        else:
            order += [way(v["num"].isNull()), way(v["num"]), way(F.when(v["num"].isNull(), v["text"]))]
    return records.orderBy(*order, tie if tie is not None else F.col("scan_ord"), F.col("path"))


def select(records: DataFrame, names: list[str]) -> DataFrame:
    """Text of the selected fields; path and links are built in, absent fields are null."""
    cols = []
    for n in dict.fromkeys(names):
        cols.append(F.col("path") if n == "path" else F.to_json("links").alias("links") if n == "links" else F.when(effective(n)["repr"] != "null", effective(n)["text"]).alias(n))
    return records.select(*cols)


def select_json(records: DataFrame, names: list[str]) -> DataFrame:
    """One JSON object a row, keys in the order selected; absent keys are left out and nulls stay."""
    parts = []
    for n in dict.fromkeys(names):
        js = F.to_json(F.array("path")).substr(2, 1 << 30) if n == "path" else F.to_json("links") if n == "links" else F.when(has(n), F.coalesce(effective(n)["json"], F.lit("null")))
        js = F.regexp_replace(js, r"\]$", "") if n == "path" else js
        parts.append(F.concat(F.to_json(F.array(F.lit(n))).substr(2, len(n) + 2), F.lit(":"), js))
    return records.select(F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}")).alias("value"))


# ---- condition trees


def field_value(name: str) -> Column:
    """What a condition tree reads: never derived values. Bare names mean metadata."""
    name = name.removeprefix("frontmatter.")
    return as_text_value(F.col(name)) if name in BUILTINS else F.try_element_at("fm", F.lit(name))


def condition(tree: dict) -> Column:
    """{op, field, value | values | conditions} as a column: eq, ne, in, contains, exists, and. Unknown operators are false."""
    op, name, want = tree.get("op"), tree.get("field", ""), tree.get("value")
    if op == "and":
        out = F.lit(True)
        for sub in tree.get("conditions", []):
            out = out & condition(sub)
        return out
    v = field_value(name)
    items = lambda: F.transform(v["items"], lambda x: x["text"])
    listed = F.coalesce(v["repr"] == "sequence", F.lit(False))
    if op == "eq":
        return F.coalesce(F.when(listed, F.array_contains(items(), F.lit(str(want)))).otherwise(v["text"] == str(want)), F.lit(False))
    if op == "ne":
        return F.coalesce(v["text"] != str(want), F.lit(True))
    if op == "in":
        wanted = F.array(*[F.lit(str(x)) for x in tree.get("values", want) or []])
        return F.coalesce(F.when(listed, F.arrays_overlap(items(), wanted)).otherwise(F.array_contains(wanted, v["text"])), F.lit(False)) if tree.get("values", want) else F.lit(False)
    if op == "contains":
        return F.coalesce(F.when(listed, F.exists(items(), lambda x: F.contains(x, F.lit(str(want))))).otherwise(F.contains(v["text"], F.lit(str(want)))), F.lit(False))
    if op == "exists":
        return F.lit(True) if name in BUILTINS else F.map_contains_key("fm", F.lit(name.removeprefix("frontmatter.")))
    return F.lit(False)


# ---- traversal


def traverse(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, *, outbound: str | None = None, inbound: str | None = None, edge_type: str | None = None) -> DataFrame:
    """Candidates with at least one edge whose other end is a record that meets the condition; with both directions, both must hold."""
    typed = edges if edge_type is None else edges.filter(F.col("type") == edge_type)
    out = candidates
    for text, own, other in ((outbound, "source", "target"), (inbound, "target", "source")):
        if text is not None:
            ends = (where(nodes, text) if text else nodes).select(F.col("path").alias("end"))
            hits = typed.join(ends, typed[other] == ends["end"], "left_semi").select(F.col(own).alias("hit")).distinct()
            out = out.join(hits, out["path"] == hits["hit"], "left_semi")
    return out
