"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "terralux", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # HotSpot does not compile methods above 8,000 bytes of bytecode; wider generated
        # stages (all criteria scored at once) run several times faster split up.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut tables: the cluster's checkpoint dir.

    Only a local-mode session without that setting gets a temporary folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder, which goes when the application ends."""
    folder = f"{scratch_root(spark)}/terralux-{spark.sparkContext.applicationId}"
    where, files = _file_system(spark, folder)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    where, files = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def path_exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`cut` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where, files = _file_system(df.sparkSession, folder)
        files.delete(where, True)


def write_plain(df: DataFrame, path: str) -> None:
    """Parquet without compression and dictionaries, whose file sizes tell how large the rows are.

    Spark takes a file's size for the size of its rows. Millions of cells with few different values shrink to
    a file below the broadcast threshold, and a join would gather them on the driver.
    """
    df.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def cut(df: DataFrame, label: str = "cut", plain: bool = True) -> DataFrame:
    """Write ``df`` once and read it back.

    Unlike a cached plan this survives lost executors, and unlike a checkpoint the
    reader's size statistics are those of the files, so iterative joins keep sane
    estimates; see :func:`write_plain`. Without ``plain`` the files are compressed, for tables
    that no join may broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if plain:
        write_plain(df, path)
    else:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to a fixed number of tasks, for work that takes long for its bytes.

    Adaptive execution merges partitions by their bytes. Thousands of small groups, each of which costs Python a fixed
    time, would come into one task; it leaves partitions alone whose number is given.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def null_for_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NULL is the only missing value inside the library; sources pass through here."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})
