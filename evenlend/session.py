"""Session settings and lineage control shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A lookup side is broadcast only when it was counted and has at most this many rows / cells.
BROADCAST_ROWS = 200_000
BROADCAST_CELLS = 1_000_000
# Level lists (distinct labels of categorical columns) up to this size are handled on the driver, longer ones as tables.
LEVEL_CAP = 20_000


def build_session(app: str = "evenlend", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the adaptive settings the operators rely on; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def work_partitions(spark: SparkSession) -> int:
    """How many range buckets an ordered operator should aim for."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and model files.

    ``spark.checkpoint.dir`` wins, then a folder already set on the context. Where neither is set (tests),
    a folder beside the warehouse is used, which every executor reaches as it reaches the tables.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return configured or current
    root = configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    context.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once; later jobs read the files, not the lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
