"""State over time: leaders, the hysteresis filter, transitions, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leaders(scored: DataFrame, health: DataFrame) -> DataFrame:
    """(date, valid, raw_state, raw_probability, second_state, second_probability, confidence)."""
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    two = scored.groupBy("date").agg(pick(1, "output_id").alias("raw_state"), pick(1, "probability").alias("raw_probability"), pick(2, "output_id").alias("second_state"), pick(2, "probability").alias("second_probability"))
    return health.select("date", "valid", "confidence").join(two, "date", "left").select("date", "valid", "raw_state", "raw_probability", "second_state", "second_probability", "confidence")


def held_states(timeline: DataFrame, threshold: float, months: int = 1, only_below: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """``timeline`` (keys, date, valid, raw_state, confidence) with the reported state and the filter's reason.

    A change is reported once a new leader of at least ``threshold`` confidence has led so many valid periods in a row;
    with ``only_below``, a leader of that confidence or more is taken at once. A weak leader resets the count, an
    invalid period neither resets nor advances it. Null confidence is weak. One fold per key over its sorted periods,
    inside the JVM; a key's periods are bounded by the calendar.
    """
    keys = keys or []
    rows = timeline.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "valid", "raw_state", F.coalesce("confidence", F.lit(0.0)).alias("c")))).alias("rows"))
    item = "struct<date:date,state:string,reason:string>"
    start = F.struct(F.lit(None).cast("string").alias("cur"), F.lit(None).cast("string").alias("pend"), F.lit(0).alias("n"), F.array().cast(f"array<{item}>").alias("out"))

    def step(a, r):
        need = F.lit(months) if only_below is None else F.when(r.c < only_below, F.lit(months)).otherwise(F.lit(1))
        run = F.when(a.pend == r.raw_state, a.n + 1).otherwise(F.lit(1))
        case = (
            F.when(~r.valid | r.raw_state.isNull(), "invalid").when(a.cur.isNull(), "initial_state").when(a.cur == r.raw_state, "raw_signal_confirmed")
            .when(r.c < threshold, "held_below_min_confidence").when(run >= need, "switch_confirmed").otherwise("awaiting_confirmation")
        )
        moved = case.isin("initial_state", "switch_confirmed")
        cur = F.when(moved, r.raw_state).otherwise(a.cur)
        pend = F.when(case == "invalid", a.pend).when(case == "awaiting_confirmation", r.raw_state)
        n = F.when(case == "invalid", a.n).when(case == "awaiting_confirmation", run).otherwise(F.lit(0))
        out = F.concat(a.out, F.array(F.struct(r.date.alias("date"), F.when(case != "invalid", cur).alias("state"), case.alias("reason"))))
        return F.struct(cur.alias("cur"), pend.alias("pend"), n.cast("int").alias("n"), out.alias("out"))

    folded = rows.select(*keys, F.explode(F.aggregate("rows", start, step, lambda a: a.out)).alias("r"))
    return timeline.join(folded.select(*keys, F.col("r.date").alias("date"), F.col("r.state").alias("reported_state"), F.col("r.reason").alias("filter_reason")), [*keys, "date"])


def next_held(held: tuple[str | None, str | None, int], raw: str | None, confidence: float, threshold: float, months: int, only_below: float | None = None) -> tuple[tuple[str | None, str | None, int], str]:
    """((current, pending, count), reason) after one period: the step of ``held_states`` for rows that come one by one. No raw state is an invalid period."""
    current, pending, count = held
    if raw is None:
        return held, "invalid"
    if current is None:
        return (raw, None, 0), "initial_state"
    if raw == current:
        return (current, None, 0), "raw_signal_confirmed"
    if not confidence >= threshold:
        return (current, None, 0), "held_below_min_confidence"
    count = count + 1 if raw == pending else 1
    need = months if only_below is None or confidence < only_below else 1
    return ((raw, None, 0), "switch_confirmed") if count >= need else ((current, raw, count), "awaiting_confirmation")


def transitions(timeline: DataFrame) -> DataFrame:
    """(transition_date, from_state, to_state, from_probability, to_probability): reported changes between successive valid periods.

    ``timeline``: date, valid, reported_state, reported_probability.
    """
    w = W.orderBy("date")
    v = timeline.where("valid and reported_state is not null").select("date", "reported_state", "reported_probability", F.lag("reported_state").over(w).alias("_s"), F.lag("reported_probability").over(w).alias("_p"))
    return v.where("_s is not null and _s <> reported_state").select(F.col("date").alias("transition_date"), F.col("_s").alias("from_state"), F.col("reported_state").alias("to_state"), F.col("_p").alias("from_probability"), F.col("reported_probability").alias("to_probability"))


def runs(timeline: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """(keys, run, state, start, end, length): stretches of one state (gaps and islands)."""
    w = W.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    marked = timeline.withColumn("_new", new).withColumn("run", F.sum("_new").over(w).cast("int"))
    return marked.groupBy(*keys, "run").agg(F.first(state).alias("state"), F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"))


def summary(timeline: DataFrame, low: float = 0.25) -> DataFrame:
    """One row: valid_count, invalid_count, switch_count, avg_run, avg_confidence, low_confidence_count, distribution ("state=share" text)."""
    v = timeline.where("valid")
    base = timeline.agg(
        F.count_if("valid").alias("valid_count"), F.count_if(~F.col("valid")).alias("invalid_count"), F.avg(F.when(F.col("valid"), F.col("confidence"))).alias("avg_confidence"),
        F.count_if(F.col("valid") & (F.coalesce("confidence", F.lit(0.0)) < low)).alias("low_confidence_count"),
    )
    r = runs(v, [], "date", "reported_state").agg(F.avg("length").alias("avg_run"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("switch_count"))
    n = v.groupBy("reported_state").count()
    share = n.withColumn("_t", F.sum("count").over(W.partitionBy())).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("reported_state"), F.lit("="), F.format_number(F.col("count") / F.col("_t"), 4)))), ",").alias("distribution"))
    return base.crossJoin(r).crossJoin(share)


def reversals(found: DataFrame, months: int) -> DataFrame:
    """(n): transitions that are turned back within so many months. Transitions are bounded by the calendar; states and months make it an equi-join."""
    a = found.select("transition_date", "from_state", "to_state", F.explode(F.sequence(F.trunc("transition_date", "month"), F.add_months(F.trunc("transition_date", "month"), months), F.expr("interval 1 month"))).alias("m"))
    b = found.select(F.col("transition_date").alias("back"), F.col("from_state").alias("to_state"), F.col("to_state").alias("from_state"), F.trunc("transition_date", "month").alias("m"))
    hit = a.join(b, ["from_state", "to_state", "m"]).where("back > transition_date")
    return hit.agg(F.countDistinct("transition_date").alias("n"))
