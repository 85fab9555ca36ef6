"""Session helpers shared by the whole library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only when the session names no shared folder, as in tests.
FALLBACK_SHARED_DIR = "/tmp/rulespan-shared"
#: Whether Spark deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "rulespan", cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_SHARED_DIR).rstrip("/")


class Scratch:
    """Written tables in the shared folder, used to cut lineage.

    Tables live in replicated storage, not on executors, so that losing an executor costs one
    task and not the rounds before it. With ``release``, the shuffle files that led to a table are
    deleted once it is written; nothing else can read them.
    """

    def __init__(self, spark: SparkSession, name: str = "scratch", release: bool = False):
        self.spark, self.release = spark, release
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it again."""
        held = self.spark.conf.get(CLEANUP)
        try:
            if self.release:
                self.spark.conf.set(CLEANUP, "true")
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, held)
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Deletes a table, or all of them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
