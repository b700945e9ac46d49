"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

UNPACKED = 4  # bytes of rows counted for a byte of a checkpoint, whose files are compressed: 1.5 to 4.6 in the tables of p4 above 50 rows


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(partitions or cores)).config("spark.ui.enabled", "false")
    s = b.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per context; they may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_clauseweave", None):
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="clauseweave-"))
    shutil.copytree(root, at / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(at / root.name), "zip", at / "src"))
    sc._clauseweave = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of part files)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may leave that unset: then a temporary folder of this
    machine is used. On a cluster it is an error, as the executors wouldn't share such a folder.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="clauseweave-", dir=os.environ.get("TMPDIR")))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder and return it without its lineage.

    For small or iterated results: the files go when the result is no longer referenced. A reliable
    checkpoint survives the loss of executors, unlike ``localCheckpoint``. Without constraint
    propagation, as a checkpoint keeps the constraints of its plan, which pile up in loops.
    """
    spark = df.sparkSession
    _shared_folder(spark)
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return _with_real_size(df.checkpoint(eager=True))
    finally:
        spark.conf.set(key, before)


def _with_real_size(df: DataFrame) -> DataFrame:
    """The checkpoint ``df`` with the size that its files tell in place of the one that Spark expected of its plan.

    Spark expects as many rows out of a Python step as went in, so the many keys of few forms would
    be broadcast, however large they are. Of a join it expects the product of its sides, and a checkpoint
    hands that number on, so its digits would multiply with every round of a loop until they fill the
    driver's memory.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength() * UNPACKED
    like = spark.range(1 + size // 8).select("id")  # 8 bytes a row; Spark's own numbers can't be made from here
    stats = jvm.scala.Option.apply(like._jdf.queryExecution().analyzed().stats())
    none = getattr(getattr(jvm.scala, "None$"), "MODULE$")
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, stats, none)
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed Parquet table in the shared folder and return the table.

    For large results that are read several times: columnar, so readers take only what they need,
    and a fraction of a checkpoint's size. The tables go when the application ends.
    """
    spark = df.sparkSession
    at = f"{_shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _forget_at_exit(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder for files that go when the application ends."""
    at = f"{_shared_folder(spark)}/files/{uuid.uuid4().hex}"
    _forget_at_exit(spark, at)
    return at


def _forget_at_exit(spark: SparkSession, at: str) -> None:
    sc = spark.sparkContext

    def drop() -> None:
        if sc._jsc is None:
            return
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001, S110 - the gateway may be gone already
            pass

    atexit.register(drop)
