"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "tessellex", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of a folder; naming columns keeps the scan narrow."""
    frame = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return frame.select(*columns) if columns else frame


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Writes a frame to the shared checkpoint folder and reads it back.

    The cluster names the folder in ``spark.checkpoint.dir``; only where that
    is unset (tests on one machine) a local folder is chosen.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessellex-"))
    return frame.checkpoint(eager=True)


def broadcast_checked(frame: DataFrame, max_rows: int) -> DataFrame:
    """Hints a broadcast only if the frame really has at most max_rows rows.

    At most ``max_rows + 1`` rows are counted; beyond that the frame comes
    back without a hint and the join shuffles.
    """
    if frame.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(frame)
    return frame


def collect_bounded(frame: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a model table whose size bound is checked before use."""
    rows = frame.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; raise the bound or shrink the model")
    return rows
