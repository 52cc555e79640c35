"""Sources of records: a tree of Markdown files, and any DataFrame lifted into the same shape."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import values
from ..functions.scalars import glob_regex
from ..functions.values import VALUES
from . import markdown

cloudpickle.register_pickle_by_value(values)
cloudpickle.register_pickle_by_value(markdown)

KEY = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])
SECTION = T.StructType([T.StructField("heading", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("path", T.ArrayType(KEY)), T.StructField("content", T.StringType()), T.StructField("start_line", T.IntegerType())])
LINK = T.StructType([T.StructField(n, T.IntegerType() if n == "line" else T.StringType()) for n in ("target", "type", "line", "source", "style", "anchor")])
ERROR = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())])
EXTRACTED = T.StructType([
    T.StructField("fm", VALUES), T.StructField("body", T.StringType()), T.StructField("sections", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body_sections", T.ArrayType(SECTION)), T.StructField("links", T.ArrayType(LINK)), T.StructField("errors", T.ArrayType(ERROR)),
])
RECORD = ["path", "dir", "base", "depth", "ancestors", "type", "fm", "body", "sections", "body_sections", "links", "derived", "errors", "scan_ord"]
#: Characters of files that a task passes on at once; a single file isn't split.
FRAME_CHARS = 4 << 20
EXTENSIONS = {".md": "markdown", ".markdown": "markdown"}


def placed(df: DataFrame, path: Column | None = None) -> DataFrame:
    """dir, base, depth and ancestors (every directory above, "" for the root) of a path column."""
    df = df if path is None else df.withColumn("path", path)
    parts = F.split("path", "/")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return df.withColumns({
        "dir": F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(F.lit("")),
        "base": F.element_at(parts, -1), "depth": F.size(parts), "ancestors": F.concat(F.array(F.lit("")), up),
    })


# ---- trees


def ignore_patterns(text: str) -> list[str]:
    return [s for line in text.splitlines() if (s := line.strip()) and not s.startswith("#")]


def is_ignored(rel: str, ignores: dict[str, list[str]]) -> bool:
    """By base name, or by the path relative to the ignoring directory."""
    parts = rel.split("/")
    for n in range(len(parts)):
        above = "/".join(parts[:n])
        for p in ignores.get(above, ()):
            regex = glob_regex(p.rstrip("/"))
            if regex and (re.match(regex, parts[-1]) or re.match(regex, "/".join(parts[n:]))):
                return True
    return False


def inventory(root: str) -> list[tuple[str, bool]]:
    """(path relative to root, whether a directory), in lexical walk order, without .git and what is ignored."""
    out: list[tuple[str, bool]] = []
    ignores: dict[str, list[str]] = {}

    def walk(rel: str):
        here = os.path.join(root, rel) if rel else root
        names = sorted(os.listdir(here))
        if ".stemignore" in names:
            with open(os.path.join(here, ".stemignore"), encoding="utf-8") as f:
                ignores[rel] = ignore_patterns(f.read())
        for name in names:
            path = f"{rel}/{name}" if rel else name
            if name == ".git" or is_ignored(path, ignores):
                continue
            is_dir = os.path.isdir(os.path.join(root, path))
            out.append((path, is_dir))
            if is_dir:
                walk(path)

    walk("")
    return out


def schema_files(root: str, listing=None) -> dict[str, str]:
    """Text of each schema file by directory."""
    out = {}
    for path, is_dir in listing if listing is not None else inventory(root):
        if not is_dir and posixpath.basename(path) == ".stem":
            with open(os.path.join(root, path), encoding="utf-8") as f:
                out[posixpath.dirname(path)] = f.read()
    return out


def scan_tree(spark: SparkSession, root: str, *, listing=None, keep=None, partitions: int | None = None) -> DataFrame:
    """Records of the Markdown files below root, which driver and executors must both see. keep(path) filters before any is read."""
    listing = inventory(root) if listing is None else listing
    files = [(i, p) for i, (p, is_dir) in enumerate(x for x in listing) if not is_dir and posixpath.splitext(p)[1].lower() in EXTENSIONS and (keep is None or keep(p))]
    schema = T.StructType([T.StructField("scan_ord", T.LongType()), T.StructField("path", T.StringType())])
    paths = spark.createDataFrame(files, schema)
    paths = paths.repartition(partitions or max(1, min(len(files) // 200 + 1, 10_000)))

    def read(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                with open(os.path.join(root, r.path), encoding="utf-8", errors="replace") as file:
                    yield r.scan_ord, r.path, file.read()

    def run(frames):
        import pandas as pd

        held, size = [], 0
        for row in read(frames):
            held.append(row)
            size += len(row[2])
            if size >= FRAME_CHARS:
                yield pd.DataFrame(held, columns=["scan_ord", "path", "content"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["scan_ord", "path", "content"])

    return from_contents(paths.mapInPandas(run, "scan_ord long, path string, content string"))


def from_contents(df: DataFrame) -> DataFrame:
    """Records from path, content and scan_ord: extraction is the one step that leaves the JVM."""

    kind = to_arrow_type(EXTRACTED)

    def one(got: dict):
        return got | {"fm": [(k, values.value_of(v)) for k, v in got["fm"].items()], "sections": list(got["sections"].items())}

    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for held in markdown.frames((c.as_py() or "" for c in b), FRAME_CHARS):
                yield pa.array([one(got) for got in held], kind)

    out = placed(df).withColumn("x", F.arrow_udf(extracted, EXTRACTED, ArrowUDFType.SCALAR_ITER)("content"))
    if "scan_ord" not in df.columns:
        out = out.withColumn("scan_ord", F.monotonically_increasing_id())
    return out.select("path", "dir", "base", "depth", "ancestors", F.lit("markdown").alias("type"), *[f"x.{f.name}" for f in EXTRACTED.fields[:5]], no_values().alias("derived"), "x.errors", "scan_ord").select(*RECORD)


def no_values() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(T.ArrayType(values.VALUE)))


# ---- tables


def lift(df: DataFrame, path: Column | str, fields: dict[str, Column | str] | list[str], *, body: Column | str | None = None, links: Column | None = None, order: Column | None = None, type_: str = "row", present_nulls: bool = False) -> DataFrame:
    """Records of a table's rows: path, metadata from columns, body and links.

    A null column is an absent key, or with present_nulls a null value. order gives the scan order (path order without it). Columns
    that the query doesn't use are pruned from the scan, as the metadata map is built in a projection.
    """
    fields = {n: n for n in fields} if isinstance(fields, list) else fields
    c = lambda x: F.col(x) if isinstance(x, str) else x
    kinds = dict(df.select(*[c(x).alias(f"f{i}") for i, x in enumerate(fields.values())]).dtypes)
    entries = F.array(*[F.struct(F.lit(n).alias("key"), values.value(kinds[f"f{i}"], c(x)).alias("value")) for i, (n, x) in enumerate(fields.items())])
    if fields and not present_nulls:
        entries = F.filter(entries, lambda e: e["value"]["repr"] != "null")
    out = df.select(c(path).alias("path"), (F.map_from_entries(entries) if fields else no_values()).alias("fm"), (F.lit("") if body is None else c(body)).alias("body"), (F.array().cast(T.ArrayType(LINK)) if links is None else links).alias("links"), (F.lit(None).cast("long") if order is None else order).alias("scan_ord"))
    out = placed(out).withColumns({
        "type": F.lit(type_), "sections": F.create_map().cast("map<string,string>"), "body_sections": F.array().cast(T.ArrayType(SECTION)),
        "derived": no_values(), "errors": F.array().cast(T.ArrayType(ERROR)),
    })
    return out.select(*RECORD)


def link(target: Column, type_: str, style: str = "wikilink") -> Column:
    """A LINK struct."""
    return F.struct(target.cast("string").alias("target"), F.lit(type_).alias("type"), F.lit(0).alias("line"), F.lit("body").alias("source"), F.lit(style).alias("style"), F.lit("").alias("anchor"))
