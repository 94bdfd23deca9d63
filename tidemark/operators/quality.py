"""Quality roll-ups of feeds, classifications and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(df: DataFrame, dims: list[str], *aggs: Column) -> DataFrame:
    """(dimension, value, aggregates): each dimension on its own and in total, by grouping sets over one scan."""
    sets = [[d] for d in dims] + [[]]
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(*aggs, F.grouping_id().alias("_g"))
    name, value = F.lit("total"), F.lit(None).cast("string")
    for k, d in enumerate(dims):
        at = (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - k))
        name, value = F.when(F.col("_g") == at, d).otherwise(name), F.when(F.col("_g") == at, F.col(d).cast("string")).otherwise(value)
    return g.select(name.alias("dimension"), value.alias("value"), *[c for c in g.columns if c not in (*dims, "_g")])


def duplicates(c: Column) -> Column:
    """Aggregate: rows less distinct values."""
    return F.count(c) - F.countDistinct(c)


def concentration(x: Column) -> Column:
    """Aggregate: greatest absolute value over their sum."""
    return F.try_divide(F.max(F.abs(x)), F.sum(F.abs(x)))


def coverage(items: DataFrame, groups: DataFrame, as_of: str, stale_days: int) -> DataFrame:
    """(grp, n, share, latest, stale, missing) of every configured group; ``groups``: grp. ``items``: grp, day."""
    n = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("latest"))
    total = items.agg(F.count(F.lit(1)).alias("_t"))
    out = groups.join(n, "grp", "left").crossJoin(F.broadcast(total))
    age = F.datediff(F.to_date(F.lit(as_of)), "latest")
    return out.select("grp", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide("n", "_t"), F.lit(0.0)).alias("share"), "latest", F.coalesce(age > stale_days, F.lit(True)).alias("stale"), F.col("n").isNull().alias("missing"))


def nearest_rank(column: str, q: float) -> Column:
    """Aggregate: the ceil(q n)-th value of a column in order."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{column}`)")


def recurring(df: DataFrame, json_ids: str, k: int) -> DataFrame:
    """(id, n): the ``k`` most frequent ids of JSON arrays; bad JSON counts as empty."""
    ids = df.select(F.explode(F.from_json(json_ids, "array<string>")).alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(k)
