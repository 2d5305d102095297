"""Session helpers: local sessions for tests, and the shared folder for durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "casemill", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def durable_dir(spark: SparkSession) -> str:
    """Folder that survives the loss of an executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets
    a folder of its own; a cluster session without it is refused, because a machine-local folder
    would not be visible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="casemill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_STAGES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def durable(df: DataFrame) -> DataFrame:
    """Write a result once to the shared folder and read it back, cutting its lineage.

    Used where two consumers must see the same rows or where a loop would grow the plan. A loop hands what
    its next round no longer reads to :func:`release`.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STAGES[stored] = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete results of :func:`durable` that nothing will read again; other tables are left alone."""
    for df in stored:
        path = _STAGES.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
