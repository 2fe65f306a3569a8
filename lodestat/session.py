"""Session set-up and the checkpoint folder shared by all executors."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "lodestat") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    parts = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODESTAT_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. Only a local session without one (tests) gets a
    temporary folder; on a cluster, whose executors could not read that, its absence is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("name a folder all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestat-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder as a path for files all executors read."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs no re-computation
    of earlier rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Before an operator that works long on every row: more partitions, by a round of shuffle. The setting
    spark.lodestat.spread says when: "always", "never", or "auto" (unset), if a scan has fewer than
    `per_core` per core. Results are the same; only for scans and projections of them, as the number of
    partitions is taken from the plan."""
    how = df.sparkSession.conf.get("spark.lodestat.spread", "auto")
    if how not in ("auto", "always", "never"):
        raise ValueError("spark.lodestat.spread must be auto, always or never")
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    if how == "never" or (how == "auto" and df.rdd.getNumPartitions() >= want):
        return df
    return df.repartition(want)
