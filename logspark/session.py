"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "logspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution on; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_logspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="logspark-ship-")) / "logspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._logspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a session on one machine makes a temporary folder where
    that is unset; on any other master executors could not read each other's files, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder shared by all executors of {master}")
        folder = tempfile.mkdtemp(prefix="logspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back.

    Cuts the lineage; what is read survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_in_buckets(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like :func:`save_and_read`, in as many buckets of ``key`` as a shuffle has partitions: grouping by ``key`` moves none of it.

    Every task of ``df`` writes a file for each bucket that it has rows of. The table stays in the session's catalog under a name of its own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    label = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(label)
    return spark.table(label)
