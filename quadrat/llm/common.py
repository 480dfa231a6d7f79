"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: the six ASCII white space characters.  ``bytes.split()`` uses the same six.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Folders that table() has written, by application and owner; an owner's go together.
_TABLES: dict[tuple[str, str], list[str]] = {}
_OWNER: ContextVar[str] = ContextVar("owner", default="")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text as UTF-8 bytes, a null text being empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` may use it many times."""
    return F.transform(F.array(value), body).getItem(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one of this machine, if Spark runs on this machine alone."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrat-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """What table() writes inside belongs to the owner."""
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def table(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadrat-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # The stored rows replace the shuffle files behind them; those go when the driver collects its garbage.
    spark.sparkContext._jvm.System.gc()
    _TABLES.setdefault((spark.sparkContext.applicationId, _OWNER.get()), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, owner: str) -> None:
    """Deletes what table() has written for an owner, once the results that read it are stored elsewhere; other results keep their tables."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for path in _TABLES.pop((spark.sparkContext.applicationId, owner), []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release_memory() -> None:
    """Returns what a worker has freed to the system, for idle workers stay; does nothing where the C library can't."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(function: Callable) -> Callable:
    """A cache of what a worker makes of its arguments, for all its tasks until it begins one that calls forget()."""
    found = lru_cache(maxsize=2)(function)
    _KEPT.append(found.cache_clear)
    return found


def forget() -> None:
    """Drops what other operators' tasks have left in this worker, for idle workers stay."""
    for clear in _KEPT:
        clear()
    release_memory()


_KEPT: list[Callable[[], None]] = []
