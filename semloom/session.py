"""Session, table and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "semloom", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and no UI; every setting can be overridden by the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder under the shared one, for what a query writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def col(name: str) -> Column:
    """The top-level column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def computed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns as a result of their own, which no later filter or projection is merged into.

    Else the optimiser would put a costly expression in place of every use of its name.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and cut lineage that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only with a local master, where
    all tasks share one machine, a temporary folder stands in for it; elsewhere
    a missing setting is an error, as each host would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="semloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named
