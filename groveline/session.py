"""Session defaults and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(name: str = "groveline", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir``, which executors share, and read it again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="groveline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/groveline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
