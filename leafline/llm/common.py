"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The ASCII white space of the contracts, as a character class and as plain characters.
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without; it gets a temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="leafline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


#: Makes Spark remove the shuffle files of a query when it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that are made and run inside leave no shuffle files: their results are stored, so nothing reads them again."""
    try:
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
    except PySparkException:  # this Spark doesn't know the setting
        yield
        return
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def pinned(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: for intermediate results that are too large for a row checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/leafline-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("leafline-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def summed(parts: DataFrame, slices: int, dtype) -> dict[int, np.ndarray]:
    """The sums of arrays that tasks sent in slices (columns slice and payload, bytes of dtype): one task adds the arrays of a slice,
    and one array for each slice reaches the driver. Slices are of a fixed size, and whole numbers sum alike in any order."""
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("payload", T.BinaryType())])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(payload, dtype)
                held[k] = held[k] + part if k in held else part.copy()
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema.names)

    dealt = parts.select("slice", "payload").repartition(slices, "slice").mapInArrow(add, schema)
    with shuffles_removed(parts.sparkSession):
        return {r.slice: np.frombuffer(r.payload, dtype) for r in dealt.select("*").collect()}


class Sent:
    """A broadcast of an object by value: executors needn't be able to import the module that its class is in."""

    def __init__(self, spark: SparkSession, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.held = None

    def __getstate__(self):
        return {"bytes": self.bytes, "held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = cloudpickle.loads(self.bytes.value)
        return self.held


def with_text(df: DataFrame, text_col: str, work, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns in keep, all by default) and the fields that work makes of the texts.

    work gets a list of texts (None for null) and returns a dict of lists. Columns stay inside row, so that no name can clash.
    """
    names = df.columns if keep is None else keep
    row = T.StructType([df.schema[df.columns.index(n)] for n in names])
    types = [to_arrow_type(f.dataType) for f in fields]
    labels = [f.name for f in fields]

    def run(batches):
        for b in few_rows(batches):
            out = work(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[n], t) for n, t in zip(labels, types))], ["row", *labels])

    picked = df.select(F.struct(*[col(n) for n in names]).alias("row"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, T.StructType([T.StructField("row", row, False), *fields]))


def few_rows(batches, rows: int = 1000):
    """Arrow batches in pieces, so that a task doesn't hold the texts of a whole batch as Python strings."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def slices(texts: list, limit: int = 4 << 20):
    """Index ranges whose texts have about limit characters together; one text is never split."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fold(doc_id, n: int) -> int:
    """crc32 of the id as text, mod n: what the contracts call a fold."""
    return zlib.crc32(str(doc_id).encode()) % n


def fold_col(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


HAS_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))
