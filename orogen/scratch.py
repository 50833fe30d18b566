"""A place for tables that a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from orogen.errors import InvalidArgument


def path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; on a lone machine, in its temporary folder."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise InvalidArgument("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "orogen-scratch")
    return f"{shared.rstrip('/')}/orogen-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read again: its lineage ends here, and lost executors cost nothing."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
