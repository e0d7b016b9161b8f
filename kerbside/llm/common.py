"""Shared helpers: tables, shared-folder materialisation, Arrow batching."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Text handed to one vectorised step, in characters.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own; the machines of
    a cluster share none, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kerbside-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        _drop(spark, path)
    except Exception:  # noqa: BLE001  the session or its JVM may have ended before the interpreter
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a read of the written table,
    not a recomputation.  The files go when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kerbside-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Pieces of `batch` whose texts have about `chars` bytes together, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str, text: str, chars: int = SLICE_CHARS) -> DataFrame:
    """Apply `function` to slices of the rows of `df` that hold about `chars` bytes of column `text`."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text, chars):
                out = function(piece)
                yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def fold(text_id: str) -> F.Column:
    """crc32 of an id as text."""
    return F.crc32(F.col(text_id).cast("string").cast("binary"))


#: Ids that a semi-join may broadcast; a long takes some 16 bytes there.
BROADCAST_IDS = 4_000_000


def with_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of `df` whose `column` is in `ids` (a written table of distinct ids).

    Longs are counted first: up to BROADCAST_IDS of them are broadcast, so that
    the wide side isn't shuffled; more, and ids of other types, are joined by a
    shuffle.
    """
    few = isinstance(ids.schema[column].dataType, LongType) and ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")
