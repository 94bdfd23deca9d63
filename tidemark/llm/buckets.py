"""Candidate pairs from shared bucket keys, without caps.

Members of a bucket of ordinary size meet in one task. A larger bucket is cut into blocks, and
each pair of blocks becomes a task of its own that compares its members and passes on only the
pairs that hold; so neither a hot bucket nor its pairs ever gather in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members up to which a bucket stays whole, and of a block of a larger one.
WHOLE, BLOCK = 64, 256


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        lo, hi = [], []
        for ids in b["ids"]:
            x = np.sort(np.asarray(ids))
            i, j = np.triu_indices(len(x), 1)
            lo.append(x[i])
            hi.append(x[j])
        if lo:
            yield pd.DataFrame({"a": np.concatenate(lo), "b": np.concatenate(hi)})


def small_bucket_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b), a < b, once each, of buckets of at most WHOLE members. ``members``: (key, id), ids once per key."""
    whole = members.join(sizes.where(f"n > {WHOLE}"), "key", "left_anti").groupBy("key").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").select("ids")
    return whole.mapInPandas(_pairs, "a bigint, b bigint").distinct()


def in_blocks(members: DataFrame, sizes: DataFrame, payload: DataFrame, check: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, whole: int = WHOLE) -> DataFrame:
    """What ``check`` gives for each two blocks of a bucket of more than ``whole`` members. ``payload``: (id, ...); a block also meets itself."""
    big = sizes.where(f"n > {whole}").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
    at = members.join(big, "key").withColumn("blk", F.pmod(F.xxhash64("id", "key"), F.col("nb")).cast("int"))
    # block k meets every block: as the lower of the two, or the upper
    spread = at.select("key", "id", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    spread = spread.select("key", "id", "blk", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"))
    full = spread.join(payload, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        left = pdf[pdf["blk"] == p].reset_index(drop=True)
        return check(left, left if p == q else pdf[pdf["blk"] == q].reset_index(drop=True))

    return full.groupBy("key", "p", "q").applyInPandas(run, schema)


def large_bucket_pairs(members: DataFrame, sizes: DataFrame, payload: DataFrame, check: Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray]], whole: int = WHOLE) -> DataFrame:
    """(a, b), a < b, of buckets of more than ``whole`` members; ``check`` returns positions, in two blocks, of the pairs that hold."""

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        i, j = check(left, right)
        x, y = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = x < y if left is right else x != y
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep]})

    return in_blocks(members, sizes, payload, pairs, "a bigint, b bigint", whole).distinct()
