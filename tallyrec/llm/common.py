"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders this session has staged tables in, for :func:`drop_staged`.
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` names it.  Only where that is unset and the session
    runs in one local process (as in tests) a temporary folder is made for it.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/tallyrec/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def staged_so_far() -> int:
    """A mark for :func:`drop_staged`."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what has been staged in this process since a mark, but for ``keep``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept = {df._staged_at for df in keep}
    for at in [p for p in _STAGED[since:] if p not in kept]:
        _STAGED.remove(at)
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
    # exchanges of tables that are written by now go from the disks only once the driver has collected what stood for them
    gc.collect()
    jvm.System.gc()


def text_or_empty(name: str = "text"):
    """The text column, null read as empty."""
    return F.coalesce(F.col(name), F.lit("")).alias("text")


def tasks_of(spark: SparkSession) -> int:
    """How many tasks a keyed exchange has by the session's settings."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, which gives freed memory back when it ends: a worker lives on and would keep the most that any task before held."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tasks
