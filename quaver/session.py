"""Session settings the library relies on."""

import re

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC time, AQE on and, if given, a fixed shuffle width."""
    b = (
        SparkSession.builder.appName("quaver")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxPlanStringLength", "65536")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that checkpoints go to: the session's spark.checkpoint.dir. Where that is unset and all runs in one process, a
    local one is set; on a cluster a folder that all machines share must be named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^,]*(, *\d+)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/quaver")
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there: what several branches of a plan use is worked out once."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
