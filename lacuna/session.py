"""Session helpers: a local session for tests and the place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "lacuna") -> SparkSession:
    """Session for tests and benchmarks on one machine. Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints. The cluster's own setting wins; a local one is a fallback."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="lacuna-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lacuna-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str = "staged") -> DataFrame:
    """Writes ``df`` once as Parquet in the run folder and reads it back.

    The lineage ends there, readers take only the columns they need, and the planner knows the size.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_run_folder(spark: SparkSession) -> None:
    """Deletes everything staged by this application, through the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
