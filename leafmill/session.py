"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and bench; on a cluster the caller's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder of ``spark.checkpoint.dir`` and read from there.

    The folder named by the cluster is used; only where none is set (tests on
    one machine) a temporary one is made. The written files outlive a lost
    executor, so nothing is computed again from scratch.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="leafmill-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
