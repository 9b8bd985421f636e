"""Session settings the library relies on."""

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Results depend on the first. The next three let Spark re-plan joins and split hot keys at run time. The last one:
# the JVM never compiles a method of more than 8000 bytes, and long text expressions make such methods; Spark then
# does better with its operators one by one.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in `spark.checkpoint.dir`.

    Where the session names none, a temporary folder serves, but only in local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="pricetide-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def partitions_for(input_bytes: int, at_least: int, bytes_per_task: int = 128 * 2**20) -> int:
    return max(at_least, -(-input_bytes // bytes_per_task))


def files_for(spark: SparkSession, input_bytes: int, bytes_per_file: int, least_bytes: int = 2**20) -> int:
    """How many files to write: eight or more, by size, and one for each core as far as none gets small for it. With
    fewer files than cores, the tasks that write them, and those that read them later, leave cores without work."""
    cores = spark.sparkContext.defaultParallelism
    return max(partitions_for(input_bytes, 8, bytes_per_file), min(cores, input_bytes // least_bytes))


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int):
    """Let the shuffles of a job start with enough partitions for an input of this size (compressed, as stored).

    Adaptive execution merges partitions that turn out small, but splits none that were planned too large, so the
    number to start from has to follow the data.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, partitions_for(input_bytes, int(before or spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def use_checkpoints(spark: SparkSession) -> None:
    """Make `checkpoint()` work: Spark sets its folder from `spark.checkpoint.dir`; where that is unset, we do."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
