"""What the operators share: the shared folder, reading tables, Arrow batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Text bytes handled at once in a task; a single longer text makes a batch of its own.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir; a temporary one where it is unset on a single machine, as in tests."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = getattr(context, "_llm_scratch", None)
        if root is None:
            root = context._llm_scratch = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
            context.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, and what made it runs once."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Makes this package known to the executors, once per application; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    package = Path(__file__).parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tallyloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))  # from the driver's own disk; Spark serves it
    context._llm_shipped = True


def ddl(fields: str) -> StructType:
    """The columns that a Python function over batches returns; what runs such functions needs the package."""
    ship(SparkSession.active())
    return StructType.fromDDL(fields)


def release() -> None:
    """Gives back memory that earlier batches and tasks of this worker have freed; Spark keeps its workers."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES, rows: int = 1 << 30
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` (string or binary) holds about `limit` bytes in each, and `rows` rows at most.
    Unused memory is given back before the first and after the last."""
    import numpy as np
    import pyarrow.compute as pc

    release()
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, base + limit, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def utf8(column: pa.Array) -> tuple:
    """(bytes, offsets) of a string column as numpy arrays; a null is an empty text."""
    import numpy as np
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
