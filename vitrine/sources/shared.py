"""The shared folder the cluster names for checkpoints and derived tables."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Otherwise shuffle files stay until the driver's garbage collector comes upon the plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it gets a temporary
    folder, since driver and executors are then one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="vitrine-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """For writes whose files are read from then on: shuffle files of what is written go when its write ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut_lineage(df):
    """Write ``df`` to the shared folder once and read it back.

    Later stages start from the files, whatever executors are lost meanwhile; the shuffles
    behind them are removed.
    """
    path = new_path(df.sparkSession, "cut")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df) -> None:
    """Delete the files of a frame that ``cut_lineage`` returned and nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        raise ValueError("only frames written by cut_lineage can be discarded")
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
