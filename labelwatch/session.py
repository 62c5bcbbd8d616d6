"""Session construction and the few facts operators ask a session for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def audit_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "labelwatch") -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    configuration decides them and adaptive execution coalesces from there.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder for written tables: below spark.checkpoint.dir when the cluster names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/labelwatch-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stored(df: DataFrame) -> DataFrame:
    """A result as a Parquet table in the shared folder: computed once, later reads prune columns and push filters."""
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch one only locally."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(scratch_folder(spark))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that several later steps read, in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
