"""Session helpers: shared folder, lineage cuts, dynamic partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and all executors see (``spark.checkpoint.dir``).

    Only where the setting is absent and the master is a single local process (tests) is a
    temporary folder made for it; on a cluster a missing setting is an error.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or getattr(spark, "_synframe_dir", None)
    if path:
        return path.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="synframe-")
    spark._synframe_dir = path
    spark.sparkContext.setCheckpointDir(path)
    return path


_ROOTS: list[str] = []


class Written:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self.root = f"{shared_dir(spark)}/synframe-{tag}-{uuid.uuid4().hex}"
        self.n = 0
        _ROOTS.append(self.root)

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut(self, df: DataFrame) -> DataFrame:
        return self.put(df)[0]

    def drop(self, path: str | None) -> None:
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of one Arrow batch that carries whole texts to Python.
TEXT_BYTES = 4 << 20


def bound_text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: the buffers of both sides live outside the heap and do not shrink.

    Lowers the session's byte limit of a batch; a lower limit stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = "".join(c for c in spark.conf.get(key, "1b") if c.isdigit() or c == "-")
    if not 1 < int(digits) <= TEXT_BYTES:
        spark.conf.set(key, str(TEXT_BYTES))


def lean(run):
    """Give memory back when a task of ``run`` (a function of batches) ends: Python workers stay for the next task and several of
    them share an executor."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return inner


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished queries go, whose results are written tables by now: Spark deletes them when the driver collects its
    garbage, but for those of the last query, so that a small one comes first."""
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Delete the tables that operators of this process have written to the shared folder. Results that still read them must be
    written before."""
    kept = Written(spark, "clean")
    while _ROOTS:
        kept.drop(_ROOTS.pop())
