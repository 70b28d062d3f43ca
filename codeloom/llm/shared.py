"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.tables import shared_dir, written

__all__ = ["WORD", "BROADCAST_BYTES", "Numbers", "n_words", "new_path", "running_total", "shared_dir", "small", "table", "written"]

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a table may be broadcast.
BROADCAST_BYTES = 8 << 20


class Numbers(dict):
    """Numbers keys in the order in which they are met first; `fresh` holds the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame) -> DataFrame:
    """Marks a written table for broadcast if its counted bytes allow it; otherwise Spark chooses the join."""
    size = F.lit(8)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = 8 * (1 + len(f.dataType.elementType.fields)) if isinstance(f.dataType.elementType, T.StructType) else 8
            size = size + width * F.coalesce(F.size(f.name), F.lit(0))
        else:
            size = size + 8
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, key: str, order: list[str], value: str, out: str, bucket_rows: int = 2048, counts: dict | None = None) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows of the same key that come before.

    A key may hold any share of the rows: its rows are dealt into buckets of about `bucket_rows` by a hash of `order`,
    the buckets' sums are added up, and each bucket is then summed by itself. The order is (bucket, order). Rows that
    tie in `order` take any order among themselves. df should be a written table, as it is read three times. counts: the rows of
    each key, if they are few long numbers and known.
    """
    from pyspark.sql import Window as W

    if counts:
        per_key = F.broadcast(df.sparkSession.createDataFrame([(k, -(-n // bucket_rows)) for k, n in counts.items()], f"{key} long, _nb long"))
    else:
        per_key = small(written(df.groupBy(key).agg(F.ceil(F.count("*") / bucket_rows).cast("long").alias("_nb")), "keys"))
    dealt = df.join(per_key, key).withColumn("_b", F.pmod(F.xxhash64(*order), F.col("_nb"))).drop("_nb")
    sums = dealt.groupBy(key, "_b").agg(F.sum(value).alias("_s"))
    w = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = written(sums.select(key, "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_from")), "starts")
    inner = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.join(small(starts), [key, "_b"])
        .withColumn(out, (F.col("_from") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
        .drop("_b", "_from")
    )
