"""What the operators of this subpackage share: scratch tables, text batches and names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Small side tables are broadcast up to this many rows and this many bytes of
#: strings; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20

#: Bytes of an Arrow batch between Spark and Python, in place of a default of 64 MB.
BATCH_BYTES = 4 << 20
#: Rows of a batch that are worked on at once in Python.
SLICE = 512

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = own.get() if own.isDefined() else None
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _ROOTS:
            _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        conf = _ROOTS[app]
    return conf.rstrip("/")


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with ``options``) into the shared folder and read it back.

    The table survives the loss of executors and cuts the lineage. It goes when
    :func:`discard` is called, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}-{label}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    small_batches(df).write.options(**options).parquet(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        df._scratch.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(df._scratch, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on the session sends Python batches of at most BATCH_BYTES.

    Both sides hold a few batches for each task, outside the heap. With texts of
    a megabyte, batches of so many rows would not fit; so the limit is in bytes.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) != f"{BATCH_BYTES}b":
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df`` (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, text: str | None = None) -> bool:
    """Whether ``df`` is within the size that may be broadcast; the check itself reads a bounded number of rows."""
    head = df.limit(rows + 1)
    size = F.sum(F.octet_length(F.col(text))) if text else F.lit(0)
    n, b = head.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return n <= rows and b <= BROADCAST_BYTES


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most SLICE rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for i in range(0, max(batch.num_rows, 1), SLICE):
            yield batch.slice(i, SLICE)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the UTF-8 bytes of its texts; a null text counts as empty."""
    for batch in slices(batches):
        raw = pc.fill_null(pc.cast(batch.column(column), pa.large_binary()), b"")
        yield batch, raw.to_pylist()


def _mapped(batches, step, setup, schema, keep, column):
    state = setup() if setup else None
    names = [f.name for f in schema]
    for batch, texts in text_batches(batches, column):
        cols = step(texts) if state is None else step(texts, state)
        have = {k: batch.column(k) for k in keep}
        have |= cols
        yield pa.RecordBatch.from_arrays([_array(have[n], schema.field(n).type) for n in names], schema=schema)


def _array(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.Array):
        return x if x.type == kind else pc.cast(x, kind)
    return pa.array(x, kind)


def map_texts(df: DataFrame, step: Callable, schema: str, *, keep: list[str], column: str = "text", setup: Callable | None = None) -> DataFrame:
    """Apply ``step`` (list of bytes -> dict of columns) to each Arrow batch of texts.

    ``schema`` is DDL for the whole output; columns in ``keep`` are passed on.
    ``setup`` makes the state of a task, given to ``step`` as second argument.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    return small_batches(df).mapInArrow(partial(_mapped, step=step, setup=setup, schema=arrow, keep=keep, column=column), struct)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
