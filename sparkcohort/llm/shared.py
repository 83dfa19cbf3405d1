"""What the operators share: the folder that cuts lineage, and word patterns."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Temporary folders by application, where a local session names none.
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in a local session that names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="sparkcohort-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[context.applicationId] = f"file://{folder}"
    return _LOCAL[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_root(spark)}/sparkcohort/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lost executor costs no recomputation before here."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete what cut() wrote for these frames, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sparkcohort/" in folder:
                path = hadoop.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, after a lower bound on rows in an Arrow batch where the session has none of its own: texts may be long, and a batch is held in memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(rows))
    return df


def tidy() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and stages of other operators follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with tidy() when its partition is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return wrapped
