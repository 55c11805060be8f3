"""Batches of rows under a budget of tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_batches(rows: DataFrame, key: str, length: str, budget: int, most: int, width: int = 32, shards: int = 64) -> DataFrame:
    """key, bucket, shard, batch: rows of like length (bucket of `width`) go into batches of at most `most` rows and
    longest * rows <= budget. A bucket is packed in shards by hash, so that no task has a whole bucket."""
    keyed = rows.select(F.col(key).alias("key"), F.col(length).cast("int").alias("len")).withColumn("bucket", F.floor(F.col("len") / width).cast("int"))
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["len", "key"])
        batch, n, longest, out = 0, 0, 0, []
        for x in pdf["len"]:
            if n and (n == most or max(longest, x) * (n + 1) > budget):
                batch, n, longest = batch + 1, 0, 0
            n, longest = n + 1, max(longest, x)
            out.append(batch)
        return pdf.assign(batch=out)[["key", "len", "bucket", "shard", "batch"]]

    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.groupBy("bucket", "shard").applyInPandas(run, f"key {kind}, len int, bucket int, shard int, batch int")
