"""Mixing sources to target weights by weighted fair queueing.

Each document of a source, in shuffled order, gets a virtual finish time: the source's tokens up
to and with it, divided by the source's weight. Served in order of finish time, every source has
its share at any moment; the line is cut where the total budget is used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running
from tidemark.session import bounded, durable

SEED = 20_240_131


def weights(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, weight, capacity) of each listed source; weight is null for one without tokens.

    Weights are shares among the sources that have tokens and a positive share, so that they add up to 1.
    """
    have = docs.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("greatest"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = durable(t.join(have, "source", "left"), "weights")
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    total = t.where(usable).agg(F.sum("target_share")).first()[0]
    t = t.withColumn("weight", F.when(usable, F.col("target_share") / F.lit(total or 1.0)))
    return durable(t.withColumn("capacity", F.col("tokens") * F.col("max_repeats") / F.col("weight")), "weights")


def latest_finish(sources: list[tuple[float, float, float]], budget: float) -> float:
    """Finish time after which nothing is served; ``sources`` has (weight, capacity, greatest document) each.

    At time t a source has been served at least weight * min(t, capacity) less one document. Where that adds up to the
    budget, the line has been cut.
    """
    need = budget + sum(m for _, _, m in sources)
    at, got, live = 0.0, 0.0, sum(w for w, _, _ in sources)
    for w, cap, _ in sorted(sources, key=lambda s: s[1]):
        if live > 0 and got + live * (cap - at) >= need:
            break
        got, at, live = got + live * (cap - at), cap, live - w
    return at + (need - got) / live if live > 1e-12 else float("inf")


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(draws, shares) for ``docs`` (doc_id, source, n_tokens).

    draws: doc_id, source, n_tokens, repeats (1..max_repeats). shares: source, target_share, weight, drawn_docs,
    drawn_tokens, actual_share, one row per listed source. ``budget`` in tokens; by default the largest at which no
    source runs out: the least capacity of any source at its weight. Unlisted and null sources, and documents without
    tokens, are not drawn. A listed source without documents gets nothing; its share goes to the others in proportion.
    With larger budgets sources run out and the others go on. Sources of any size are ordered over many tasks.
    """
    w = weights(docs, targets)
    if budget is None:
        least = w.agg(F.min("capacity")).first()[0]
        budget = int(least) if least is not None else 0
    listed = docs.where("n_tokens > 0").join(bounded(w.where("weight is not null").select("source", "max_repeats", "tokens", "weight")), "source")
    listed = listed.select("doc_id", "source", "n_tokens", "max_repeats", "tokens", "weight").withColumn("_shuffle", F.xxhash64("doc_id", F.lit(SEED)))
    # every pass over a source is the same shuffled order, so sums inside one pass serve all
    line = running(listed, ["source"], [F.col("_shuffle"), F.col("doc_id")], F.col("n_tokens"))
    copies = line.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
    finish = (F.col("_pass") * F.col("tokens") + F.col("_cum")) / F.col("weight")
    # what finishes after the line is cut need not be sorted; one row per listed source decides
    few = [(r.weight, r.capacity, r.greatest) for r in w.where("weight is not null").collect()]
    copies = copies.select("doc_id", "source", "n_tokens", "_pass", "_shuffle", finish.alias("_finish")).where(F.col("_finish") <= latest_finish(few, budget) * (1 + 1e-9))
    served = running(copies, [], [F.col("_finish"), F.col("source"), F.col("_shuffle"), F.col("doc_id"), F.col("_pass")], F.col("n_tokens")).where(F.col("_cum") <= budget)
    draws = durable(served.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).cast("int").alias("repeats")), "draws")
    got = draws.groupBy("source").agg(F.count(F.lit(1)).alias("drawn_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"))
    total = got.agg(F.sum("drawn_tokens")).first()[0] or 0
    shares = w.select("source", "target_share", "weight").join(got, "source", "left")
    drawn = F.coalesce("drawn_tokens", F.lit(0))
    shares = shares.select("source", "target_share", "weight", F.coalesce("drawn_docs", F.lit(0)).alias("drawn_docs"), drawn.alias("drawn_tokens"), F.try_divide(drawn, F.lit(total)).alias("actual_share"))
    return draws, shares
