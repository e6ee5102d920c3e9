"""Session helpers: checkpoint folder, lineage cuts, table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "tracewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map={**defaults, **conf}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and all runs on this machine (tests, a
    laptop) a temporary folder is used instead; a cluster without it is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not named and not current.isDefined() and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tracewell-")
    if not current.isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables written by this driver, for ``release``.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables ``written`` by this driver; call it once their results have been used."""
    jvm = spark.sparkContext._jvm
    gone = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Unlike ``cut`` the result has sizes, so adaptive execution can choose join
    strategies from them, and it is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(T._parse_datatype_json_string(df.schema.json())).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
