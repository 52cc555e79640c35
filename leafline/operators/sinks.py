"""Sinks: JSON lines, CSV, text tables, Graphviz, Mermaid and directory trees."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derive import tree_totals
from .graph import dot, mermaid_id
from .query import select, select_json

#: Rows that the text renderings take to the driver.
SHOWN = 10_000


def write_jsonl(records: DataFrame, names: list[str], path: str, mode: str = "errorifexists") -> None:
    select_json(records, names).write.mode(mode).text(path)


def write_csv(records: DataFrame, names: list[str], path: str, mode: str = "errorifexists") -> None:
    select(records, names).na.fill("").write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_parquet(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.write.mode(mode).parquet(path)


def envelope(kind: str, data, version: int = 1, ok: bool = True) -> str:
    return json.dumps({"version": version, "kind": kind, "ok": ok, "data": data}, ensure_ascii=False)


def path_values(value, path: str):
    """a.b[].c of decoded JSON."""
    here = [value]
    many = False
    for part in path.split("."):
        each = part.endswith("[]")
        here = [v.get(part.removesuffix("[]")) for v in here if isinstance(v, dict)]
        if each:
            here, many = [x for v in here if isinstance(v, list) for x in v], True
    return here if many else here[0] if here else None


def text_table(df: DataFrame, most: int = SHOWN) -> str:
    """Aligned columns; a last line says so if there are more than the rows shown."""
    found = df.limit(most + 1).collect()
    rows = [tuple("" if v is None else str(v) for v in r) for r in found[:most]]
    widths = [max(map(len, c)) for c in zip(df.columns, *rows)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in (tuple(df.columns), *rows)]
    return "\n".join([*lines, f"... more than {most} rows"] if len(found) > most else lines)


def write_dot(edges: DataFrame, path: str) -> None:
    """Lines of a digraph's body; the files of the folder, between "digraph {" and "}", are the graph."""
    dot(edges).write.text(path)


def mermaid(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("  "), mermaid_id(F.col("source")), F.lit(" --> "), mermaid_id(F.col("target"))).alias("value"))


def tree_text(records: DataFrame, most: int = SHOWN) -> str:
    """Directories with their totals and records, names in order; a last line says so if there are more than the records shown."""
    shown = records.select("path", "ancestors").orderBy("path").limit(most + 1)
    paths = [r["path"] for r in shown.collect()]
    more, paths = len(paths) > most, paths[:most]
    wanted = shown.select(F.explode("ancestors").alias("dir")).distinct()
    totals = {r["dir"]: r["total"] for r in tree_totals(records).join(wanted, "dir", "left_semi").collect()}
    out = [f". [{totals.get('', 0)}]"]
    seen: set[str] = set()
    for p in paths:
        parts = p.split("/")
        for n in range(1, len(parts)):
            d = "/".join(parts[:n])
            if d not in seen:
                seen.add(d)
                out.append("  " * n + f"{parts[n - 1]}/ [{totals.get(d, 0)}]")
        out.append("  " * len(parts) + parts[-1])
    if more:
        out.append(f"... more than {most} records")
    return "\n".join(out)
