"""Session helpers: shared scratch space, cutting lineage and measured broadcasts."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def build_session(app_name: str = "triagework", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs expect; a cluster's own settings win over these defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the checkpoint folder already set.

    A temporary local folder is used in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="triagework-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_output_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a small ``df`` once and keep it as a reliable checkpoint, so later stages do not recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Compute a large ``df`` once into a Parquet table; later scans read only the columns they need.

    The table goes when the session ends.
    """
    spark = df.sparkSession
    path = new_output_dir(spark, name)
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether a settled ``df``, measured, is small enough to broadcast."""
    rows, size = (
        df.limit(MAX_BROADCAST_ROWS + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)))
        .first()
    )
    return rows <= MAX_BROADCAST_ROWS and size <= MAX_BROADCAST_BYTES


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """Broadcast hint for a table measured as small; else the join is left to a shuffle."""
    return F.broadcast(df) if small else df


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return broadcast_if(is_small(df), df)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the left side's key columns are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])
