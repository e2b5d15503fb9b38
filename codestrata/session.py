"""Session helpers: reading tables, cutting lineage, and broadcasts whose size is checked."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its measured size stays under this many bytes.
BROADCAST_LIMIT = 32 * 1024 * 1024


def local_session(cores: int | str = 8, app: str = "codestrata", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="codestrata-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what ``spark.checkpoint.dir`` names; only where that is unset on a local master (tests, a laptop) a temporary
    folder is made and kept in the session's configuration. On a cluster without the setting this is an error, as no
    folder of one machine could be read by the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = spark.conf.get("codestrata.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="codestrata-")
            spark.conf.set("codestrata.checkpoint.dir", path)
    return path


def cut_folder(spark: SparkSession) -> str:
    """Where the tables of this application are written."""
    return f"{shared_folder(spark)}/codestrata/{spark.sparkContext.applicationId}"


#: Spark's switch to delete shuffle files at the end of the query that wrote them, not when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there.

    A written Parquet table survives the loss of any executor, keeps column pruning for later readers and
    gives the optimizer real sizes, which a cached or locally checkpointed frame does not. The table is deleted
    when the application ends, or by ``drop`` and ``drop_cuts``. With ``tidy`` the shuffle files of the writing go at once.
    """
    spark = df.sparkSession
    path = f"{cut_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete one table that ``cut`` has written; frames that read it are no longer usable."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_cuts(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` has written in this application; frames that read them are no longer usable."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cut_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def plan_bytes(df: DataFrame) -> int:
    """Upper estimate of the optimizer for the size of ``df``; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, measured: int | None = None, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only if ``df`` is known to be under ``limit`` bytes.

    Beyond it the frame is returned as it is, so that the join shuffles (and AQE splits skewed keys).
    """
    size = plan_bytes(df) if measured is None else measured
    return F.broadcast(df) if size <= limit else df
