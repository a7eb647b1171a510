"""Session set-up and lineage cutting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoints of tables that are no longer referred to are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", name: str = "lexiloom", **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` overrides them (underscores stand for dots)."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session's setting names.

    A local session without one takes ``spark.local.dir``'s or the working machine's own folder, which all of its tasks
    share; a cluster without one is refused, for a folder of one machine is none that all executors share.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            shared = f"{spark.conf.get('spark.local.dir', '/tmp')}/lexiloom-checkpoints"
        spark.sparkContext.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written rows.

    A reliable checkpoint survives the loss of executors, keeps an expensive stage from being computed once per
    consumer, and keeps iterative plans short.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
