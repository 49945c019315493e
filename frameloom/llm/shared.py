"""Session and storage helpers of the operators.

Intermediate tables go to the folder that all executors share
(``spark.checkpoint.dir``); a table written there has no lineage, so a lost
executor never forces the work before it to run again.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a local session gets a temporary one and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="frameloom-shared-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_LOCAL = threading.local()


def _written() -> list[str]:
    """The tables that this thread has written, so that runs side by side keep theirs apart."""
    if not hasattr(_LOCAL, "tables"):
        _LOCAL.tables = []
    return _LOCAL.tables


def mark() -> int:
    """How many tables this thread has written so far, for clear()."""
    return len(_written())


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the tables that this thread wrote (after ``since``, without the one that ``keep`` reads); for after their results have been stored."""
    kept = {f.rsplit("/", 1)[0] for f in keep.inputFiles()} if keep is not None else set()
    tables = _written()
    gone = [t for t in tables[since:] if not any(k == t or k.endswith(t.split(":", 1)[-1].lstrip("/")) for k in kept)]
    tables[since:] = [t for t in tables[since:] if t not in gone]
    for table in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written().append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on Arrow batches of this session hold so many bytes at most (the default is 64 MB), which bounds what texts take next to the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def tasks_for(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Stands for a missing id in arrays of ids.
NO_ID = -(2**63)


def id_array(column) -> np.ndarray:
    """Ids of an Arrow column as 64-bit numbers, missing ones as NO_ID."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    """The reverse of id_array()."""
    ids = np.asarray(ids, dtype=np.int64)
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def only(docs: DataFrame, **wanted: str) -> DataFrame:
    """The columns an operator reads, under its own names (extra columns go).

    ``wanted`` maps the operator's name to the table's name.
    """
    return docs.select(*[F.col(f"`{have}`").alias(name) for name, have in wanted.items()])


def removed(table: DataFrame, below: str = "") -> None:
    """Delete the files of a table from written() that nothing reads any more, or one folder of it."""
    spark = table.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        if folder.startswith(shared_dir(spark).replace("file:///", "file:/")) or folder.startswith(shared_dir(spark)):
            if not below or folder.endswith(f"/{below}"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def heavy_join(rows: DataFrame, groups: DataFrame, key: str, size: str, heavy: int = 1024) -> DataFrame:
    """Inner join of rows with the one row of their group, safe for large groups.

    ``groups`` is a written table whose ``size`` is how many of ``rows`` have
    the key. Fewer than ``heavy`` groups can have a ``1 / heavy`` of all rows
    each; those are broadcast, and their rows don't shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(2, total // heavy + 1)
    large = groups.where(F.col(size) >= least)
    small = groups.where(F.col(size) < least)
    columns = [*rows.columns, *[c for c in groups.columns if c != key]]
    there = rows.join(F.broadcast(large), key).select(columns)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key).select(columns)
    return there.unionByName(rest)
