"""Tables written to the folder that driver and executors share, to cut lineage between rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Whether Spark removes a query's shuffle files when the query ends; they are of no use once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Up to which sizes Spark broadcasts a side of a join: by what it takes a table for, and by what a shuffle has counted.
ESTIMATED, COUNTED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def written(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """df as a table in the shared folder; what its shuffles left on disk goes. settings: of Spark, for this table alone."""
    conf, settings = df.sparkSession.conf, {CLEANUP: "true"} | settings
    before = {k: conf.get(k, None) for k in settings}
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    try:
        for k, v in settings.items():
            conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as written, where no join takes a side for small that nobody has counted: texts and repeated names are a hundred times their
    size on disk, and a column made from a key has no size there at all. What a shuffle has counted may still be broadcast."""
    conf = df.sparkSession.conf
    return written(df, name, **{ESTIMATED: "-1", COUNTED: conf.get(COUNTED, None) or conf.get(ESTIMATED)})
