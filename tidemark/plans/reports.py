"""Reports and reviews over the test tables as small frames, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import items, ranking, reports, scoring, state
from tidemark.plans import feed, macro, news
from tidemark.plans.macro import loose, rounded
from tidemark.plans.macro_sql import DIM, HELD, PR, REG, SECT, SEEN
from tidemark.session import table

SQL: dict[str, str] = {}
QUERIES = {}
CRISES = [("1997-03-01", "1997-08-01"), ("1999-06-01", "1999-09-01")]
RT = "WITH RECURSIVE"


def query(sql: str | None = None):
    """Registers a query with the SQL it is compared with."""

    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def held(spark: SparkSession, d: str) -> DataFrame:
    return macro.timeline(spark, d)


# -- states and series


@query(f"{RT} {HELD}, c AS (SELECT * FROM tl WHERE valid AND e = (SELECT max(e) FROM hl WHERE valid)) SELECT hl.e AS date, dom AS raw_state, round(mp, 6) AS raw_probability, round(hl.conf, 6) AS confidence, rep AS reported_state, round(repp, 6) AS reported_probability, why AS filter_reason FROM hl JOIN c ON c.e = hl.e")
def current_regime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.current_state(macro.chain(spark, d).health, held(spark, d)))


@query(f"WITH {REG}, l AS (SELECT max(e) AS e FROM hl WHERE valid), x AS (SELECT rcn.o, i, sv * nw AS c FROM rcn JOIN l USING (e) WHERE ok), s AS (SELECT *, CASE WHEN c > 0 THEN 'supporting' WHEN c < 0 THEN 'opposing' END AS side FROM x), r AS (SELECT *, (row_number() OVER (PARTITION BY o, side ORDER BY round(abs(c), 9) DESC, i))::INT AS place FROM s WHERE side IS NOT NULL) SELECT o AS output_id, side, place, i AS input_id, round(c, 6) AS contribution FROM r WHERE place <= 3")
def regime_contributors(spark: SparkSession, d: str) -> DataFrame:
    c = macro.chain(spark, d)
    last = reports.latest(c.health.where("valid"), "date").select("date")
    return rounded(reports.by_sign(c.reg_contrib.where("valid").join(F.broadcast(last), "date", "left_semi"), ["output_id"], "contribution", "input_id", 3).select("output_id", "side", "place", "input_id", "contribution"))


@query(f"{RT} {HELD}, v AS (SELECT *, lag(rep) OVER (ORDER BY e) AS ps FROM tl WHERE valid), t AS (SELECT e, ps, rep FROM v WHERE ps <> rep ORDER BY e DESC LIMIT 10) SELECT e AS transition_date, ps AS from_state, rep AS to_state FROM t")
def last_transitions(spark: SparkSession, d: str) -> DataFrame:
    return reports.tail(state.transitions(held(spark, d)), 10, "transition_date").select("transition_date", "from_state", "to_state")


@query(f"{RT} {HELD}, n AS (SELECT rep, count(*) AS n FROM tl WHERE valid GROUP BY 1) SELECT rep AS state, n, round(n / sum(n) OVER (), 6) AS share FROM n")
def state_distribution(spark: SparkSession, d: str) -> DataFrame:
    n = held(spark, d).where("valid").groupBy(F.col("reported_state").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())))


@query(f"{RT} {HELD}, pb AS (SELECT e, string_agg(o || '=' || round(p, 4)::VARCHAR, ',' ORDER BY o) AS mix FROM (SELECT e, o, CASE WHEN round(p, 4) = 1 THEN 1.0 WHEN round(p, 4) = 0 THEN 0.0 ELSE round(p, 4) END AS p FROM reg WHERE p IS NOT NULL) GROUP BY 1) SELECT tl.e AS date, coalesce(rep, raw) AS reported_state, raw AS raw_state, tl.valid, mix FROM tl LEFT JOIN pb ON pb.e = tl.e")
def timeline_export(spark: SparkSession, d: str) -> DataFrame:
    """Each date with its reported state and the map of all probabilities, as text here."""
    c = macro.chain(spark, d)
    p = reports.as_map(c.regimes.where("probability is not null"), ["date"], F.col("output_id"), F.round("probability", 4))
    text = F.array_join(F.transform(F.map_entries("values"), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string"))), ",")
    return held(spark, d).join(p, "date", "left").select("date", F.coalesce("reported_state", "raw_state").alias("reported_state"), "raw_state", "valid", text.alias("mix"))


@query(f"WITH {SEEN}, fm AS (SELECT DISTINCT i AS f, first(o ORDER BY o) OVER (PARTITION BY i ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dim FROM (VALUES ('growth', 'f1'), ('growth', 'f2'), ('growth', 'f3'), ('pressure', 'f3'), ('pressure', 'f4'), ('pressure', 'f5')) v(o, i)), s AS (SELECT coalesce(dim, 'unmapped') AS dimension_id, seen.f, e, round(z, 3) AS v FROM seen LEFT JOIN fm ON fm.f = seen.f WHERE z IS NOT NULL) SELECT dimension_id, f AS feature_id, count(*) AS points, min(e) AS first, max(e) AS last, round(sum(v), 3) AS total FROM s GROUP BY 1, 2")
def feature_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Dimension to feature to points, nested in the frame; here its shape, ends and sums."""
    c = macro.chain(spark, d)
    dim = c.dim_contrib.groupBy(F.col("input_id").alias("feature_id")).agg(F.min("output_id").alias("dimension_id"))
    p = c.seen.where("normalized_value is not null").join(F.broadcast(dim), "feature_id", "left").withColumn("dimension_id", F.coalesce("dimension_id", F.lit("unmapped")))
    points = p.groupBy("dimension_id", "feature_id").agg(F.array_sort(F.collect_list(F.struct(F.col("evaluation_date").alias("date"), F.round("normalized_value", 3).alias("value")))).alias("points"))
    nested = points.groupBy("dimension_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "points"))).alias("features"))
    flat = nested.select("dimension_id", F.inline("features"))
    return flat.select("dimension_id", "feature_id", F.size("points").cast("long").alias("points"), F.get("points", F.lit(0)).date.alias("first"), F.element_at("points", -1).date.alias("last"), F.round(F.aggregate("points", F.lit(0.0), lambda a, x: a + x.value), 3).alias("total"))


@query(f"{RT} {HELD}, v AS (SELECT e, valid, rep, CASE WHEN lag(e) OVER (ORDER BY e) IS NOT NULL AND lag(rep) OVER (ORDER BY e) IS NOT DISTINCT FROM rep THEN 0 ELSE 1 END AS nw FROM tl), g AS (SELECT *, (sum(nw) OVER (ORDER BY e))::INT AS phase FROM v) SELECT phase, min(rep) AS state, min(e) AS start, max(e) AS end, count(*) AS length, bool_or(NOT valid) AS faded FROM g GROUP BY 1")
def regime_phases(spark: SparkSession, d: str) -> DataFrame:
    return reports.phases(held(spark, d), "reported_state")


BENCH = f"""{HELD}, wn AS (SELECT unnest(generate_series(s, f, INTERVAL 1 MONTH))::DATE AS mo FROM (VALUES {', '.join(f"(DATE '{a}', DATE '{b}')" for a, b in CRISES)}) v(s, f)),
rp AS (SELECT date_trunc('month', e)::DATE AS mo, sum(p) AS p FROM reg WHERE o IN ('slump') AND p IS NOT NULL GROUP BY 1),
mb AS (SELECT date_trunc('month', e)::DATE AS month, coalesce(rp.p, 0) AS p, raw, rep, date_trunc('month', e)::DATE IN (SELECT mo FROM wn) AS inside FROM tl LEFT JOIN rp ON rp.mo = date_trunc('month', e) WHERE valid)"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    w = spark.createDataFrame(CRISES, "start string, end string").select(F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return ranking.monthly_benchmark(macro.chain(spark, d).regimes, held(spark, d), w, ["slump"])


@query(f"{RT} {BENCH} SELECT month, round(p, 6) AS probability, raw AS raw_state, rep AS reported_state, inside FROM mb")
def monthly_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monthly(spark, d))


LABELS = "count(*) FILTER (inside) AS inside_months, count(*) FILTER (inside AND {0} = 'slump') AS hits, round(coalesce(count(*) FILTER (inside AND {0} = 'slump') / nullif(count(*) FILTER (inside), 0), 0), 6) AS hit_rate, count(*) FILTER (NOT inside AND {0} = 'slump') AS flags, round(coalesce(count(*) FILTER (NOT inside AND {0} = 'slump') / nullif(count(*) FILTER (NOT inside), 0), 0), 6) AS flag_rate"


@query(f"{RT} {BENCH} SELECT 'raw' AS label, {LABELS.format('raw')} FROM mb UNION ALL SELECT 'reported', {LABELS.format('rep')} FROM mb")
def label_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d)
    parts = [ranking.label_rates(m.withColumn("label", F.lit(k)), ["label"], F.col(c).isin("slump"), "inside") for k, c in (("raw", "raw_state"), ("reported", "reported_state"))]
    return rounded(parts[0].unionByName(parts[1]))


@query(f"{RT} {BENCH}, k AS (SELECT inside, rank() OVER (ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY round(p, 9)) - 1) / 2.0 AS r FROM mb) SELECT count(*) AS months, count(*) FILTER (inside) AS inside_months, CASE WHEN count(*) FILTER (inside) = 0 OR count(*) FILTER (NOT inside) = 0 THEN 'insufficient_overlap' ELSE 'ok' END AS status, round((sum(r) FILTER (inside) - count(*) FILTER (inside) * (count(*) FILTER (inside) + 1) / 2.0) / (count(*) FILTER (inside) * count(*) FILTER (NOT inside)), 6) AS auroc FROM k")
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d).withColumn("probability", F.round("probability", 9))
    a = ranking.auroc(m, "probability", "inside")
    months = F.col("positives") + F.col("negatives")
    status = F.when((F.col("positives") == 0) | (F.col("negatives") == 0), "insufficient_overlap").otherwise("ok")
    return rounded(a.select(months.alias("months"), F.col("positives").alias("inside_months"), status.alias("status"), "auroc"))


REV = f"{HELD}, v AS (SELECT *, lag(rep) OVER (ORDER BY e) AS ps FROM tl WHERE valid), tr AS (SELECT e, ps, rep, conf FROM v WHERE ps <> rep), rw AS (SELECT count(*) AS n FROM (SELECT raw, lag(raw) OVER (ORDER BY e) AS pr FROM tl WHERE valid) WHERE pr <> raw)"
PAIRS = "(SELECT count(*) FROM tr a WHERE EXISTS (SELECT 1 FROM tr b WHERE b.e > a.e AND (year(b.e) - year(a.e)) * 12 + month(b.e) - month(a.e) <= {0} AND b.ps = a.rep AND b.rep = a.ps))"


@query(f"{RT} {REV} SELECT (SELECT n FROM rw) AS raw_switches, count(*) AS switches, count(*) FILTER (coalesce(conf, 0) < 0.01) AS near_zero, count(*) FILTER (coalesce(conf, 0) < 0.03) AS low, {PAIRS.format(1)} AS reversals_1m, {PAIRS.format(2)} AS reversals_2m FROM tr")
def transition_review(spark: SparkSession, d: str) -> DataFrame:
    t = held(spark, d)
    found = state.transitions(t).join(t.select(F.col("date").alias("transition_date"), "confidence"), "transition_date")
    w = W.orderBy("date")
    raw = t.where("valid").withColumn("_p", F.lag("raw_state").over(w)).agg(F.count_if(F.col("_p") != F.col("raw_state")).alias("raw_switches"))
    n = found.agg(F.count(F.lit(1)).alias("switches"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.01).alias("near_zero"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.03).alias("low"))
    out = raw.crossJoin(n)
    for m in (1, 2):
        out = out.crossJoin(state.reversals(found, m).withColumnRenamed("n", f"reversals_{m}m"))
    return out


INTER = f"{REG}, dv AS (SELECT o, e, score FROM dim WHERE score IS NOT NULL), iv AS (SELECT g.e, least(g.score, -p.score) AS v FROM dv g JOIN dv p ON g.e = p.e AND g.o = 'growth' AND p.o = 'pressure'), nx AS (SELECT reg1.o, reg1.e, CASE WHEN reg1.o = 'boom' AND v IS NOT NULL THEN score * (1.0 / 1.5) + v * (0.5 / 1.5) ELSE score END AS score FROM reg1 LEFT JOIN iv ON iv.e = reg1.e), ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY e)) AS x FROM nx)"


@query(f"WITH {INTER} SELECT o AS output_id, e AS date, round(score, 6) AS score, round(x / sum(x) OVER (PARTITION BY e), 6) AS probability FROM ex")
def interaction_scores(spark: SparkSession, d: str) -> DataFrame:
    """A state's score blended with the least of two dimensions as their polarities count them; null if either is missing, and then left as it is."""
    c = macro.chain(spark, d)
    inter = scoring.interaction(c.dims, [("growth", "positive"), ("pressure", "negative")])
    s = scoring.blended(c.regimes.select("output_id", "date", "score", "valid", "coverage_ratio"), inter, "boom", 1.0, 0.5)
    return rounded(scoring.probabilities(s, macro.ORDER).select("output_id", "date", "score", "probability"))


# -- sectors


@query(f"WITH {SECT}, l AS (SELECT max(e) AS e FROM ss WHERE valid) SELECT ss.e AS date, rk::DOUBLE AS rank, ent AS entity_id, round(raw, 6) AS raw_score, round(adj, 6) AS adjusted_score, CASE WHEN adj > 0 THEN 'supported' WHEN adj < 0 THEN 'pressured' ELSE 'flat' END AS side, coalesce(conf, 0) < 0.05 AS weak FROM ss JOIN l ON l.e = ss.e JOIN hl ON hl.e = ss.e WHERE ss.valid")
def sector_ranking(spark: SparkSession, d: str) -> DataFrame:
    s = reports.latest(macro.sectors(spark, d)[1].where("valid"), "date")
    side = F.when(F.col("adjusted_score") > 0, "supported").when(F.col("adjusted_score") < 0, "pressured").otherwise("flat")
    return loose(rounded(s.select("date", "rank", "entity_id", "raw_score", "adjusted_score", side.alias("side"), (F.coalesce("macro_confidence", F.lit(0.0)) < 0.05).alias("weak"))), "rank")


@query(f"WITH {SECT}, l AS (SELECT max(e) AS e FROM ss WHERE valid), x AS (SELECT ent, ct || ':' || ci AS comp, c, CASE WHEN c > 0 THEN 'supporting' WHEN c < 0 THEN 'opposing' END AS side FROM sc JOIN l ON l.e = sc.e WHERE ok), r AS (SELECT *, (row_number() OVER (PARTITION BY ent, side ORDER BY round(abs(c), 9) DESC, comp))::INT AS place FROM x WHERE side IS NOT NULL) SELECT ent AS entity_id, side, place, comp AS component, round(c, 6) AS contribution FROM r WHERE place <= 2")
def sector_drivers(spark: SparkSession, d: str) -> DataFrame:
    comps, scores = macro.sectors(spark, d)
    last = reports.latest(scores.where("valid"), "date").select("date").distinct()
    x = comps.where("valid").join(F.broadcast(last), "date", "left_semi").withColumn("component", F.concat_ws(":", "component_type", "component_id"))
    return rounded(reports.by_sign(x, ["entity_id"], "contribution", "component", 2).select("entity_id", "side", "place", "component", "contribution"))


@query(f"WITH {SECT} SELECT ss.e AS date, ss.valid, missing, coalesce(conf, 0) < 0.1 AS warning, round(adj, 6) AS adjusted_score FROM ss JOIN hl ON hl.e = ss.e WHERE ent = 'beta'")
def inspect_sector(spark: SparkSession, d: str) -> DataFrame:
    """One sector's rows, with what it lacked and the low-confidence warning."""
    s = reports.inspect(macro.sectors(spark, d)[1], entity_id="beta", date=None)
    return rounded(s.select("date", "valid", "missing", (F.coalesce("macro_confidence", F.lit(0.0)) < 0.1).alias("warning"), "adjusted_score"))


@query(f"WITH {SECT}, n AS (SELECT ent, count(*) AS firsts FROM ss WHERE rk = 1 GROUP BY 1) SELECT ent AS entity_id, firsts, firsts = (SELECT count(DISTINCT e) FROM ss) AS always FROM n")
def rank_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_distribution(macro.sectors(spark, d)[1], "entity_id", "date", 1)


@query(f"WITH {PR} SELECT ent AS entity_id, count(*) AS rows, round(avg(score), 6) AS average_score, round(avg(r1), 6) AS average_relative_1m, round(avg((r1 > 0)::INT) FILTER (r1 IS NOT NULL), 6) AS hit_rate_1m, round(avg(r3), 6) AS average_relative_3m, round(avg((r3 > 0)::INT) FILTER (r3 IS NOT NULL), 6) AS hit_rate_3m FROM ret WHERE coalesce(r1, r3) IS NOT NULL GROUP BY 1")
def sector_validation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.validation_by(macro.returns(spark, d).where("valid"), "entity_id", [1, 3]))


@query(f"WITH {PR}, p AS (SELECT min(d) AS a, max(d) AS b FROM pr), r AS (SELECT count(*) FILTER (coalesce(r1, r3) IS NOT NULL) AS ok, count(*) FILTER (coalesce(r1, r3) IS NULL) AS bad, min(d) FILTER (coalesce(r1, r3) IS NOT NULL) AS c, max(d) FILTER (coalesce(r1, r3) IS NOT NULL) AS e FROM ret) SELECT a AS price_start, b AS price_end, c AS score_start, e AS score_end, ok AS observations, bad AS invalid FROM p, r")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    p = macro.prices(spark, d).agg(F.min("date").alias("price_start"), F.max("date").alias("price_end"))
    ok = F.col("valid")
    r = macro.returns(spark, d).agg(F.min(F.when(ok, F.col("score_date"))).alias("score_start"), F.max(F.when(ok, F.col("score_date"))).alias("score_end"), F.count_if(ok).alias("observations"), F.count_if(~ok).alias("invalid"))
    return p.crossJoin(r)


IC = f"{PR}, k AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY score) + (count(*) OVER (PARTITION BY d, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY d ORDER BY r) + (count(*) OVER (PARTITION BY d, r) - 1) / 2.0 AS b FROM (SELECT d, score, round(r1, 9) AS r FROM ret WHERE r1 IS NOT NULL)), ic AS (SELECT d, count(*) AS n, CASE WHEN count(*) >= 2 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS ic FROM k GROUP BY 1)"


@query(f"WITH {IC}, m AS (SELECT round(max(abs(ic)), 6) AS most FROM ic) SELECT most, CASE WHEN most IS NULL THEN 'none' WHEN most >= 0.1 THEN 'signal' ELSE 'weak' END AS verdict FROM m")
def validation_verdict(spark: SparkSession, d: str) -> DataFrame:
    r = macro.returns(spark, d).withColumn("rel", F.round("relative_forward_1m_return", 9))
    return rounded(reports.verdict(ranking.spearman(r, ["score_date"], "score", "rel")))


@query(f"WITH {IC} SELECT count(*) AS dates, sum(n)::BIGINT AS observations, round(avg(ic), 6) AS mean_ic FROM ic")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    r = macro.returns(spark, d).withColumn("rel", F.round("relative_forward_1m_return", 9))
    s = ranking.spearman(r, ["score_date"], "score", "rel")
    return rounded(s.agg(F.count(F.lit(1)).alias("dates"), F.sum("n").alias("observations"), F.avg("ic").alias("mean_ic")))


VARIANTS = [("base", 1.0, 1.0), ("macro_only", 1.0, 0.0), ("half_priors", 0.5, 1.0)]
VAR = f"{SECT}, va(vid, pw, dw) AS (VALUES {', '.join(str(v) for v in VARIANTS)}), vs AS (SELECT vid, ent, e, sum(c * CASE ct WHEN 'regime_prior' THEN pw ELSE dw END) AS s, bool_and(ok) AS ok FROM sc CROSS JOIN va GROUP BY 1, 2, 3), vr AS (SELECT *, row_number() OVER (PARTITION BY vid, e ORDER BY round(s, 9) DESC, ent) AS r, dense_rank() OVER (PARTITION BY vid ORDER BY e) AS n FROM vs WHERE ok), vd AS (SELECT vid, s, CASE WHEN lag(n) OVER w = n - 1 THEN abs(r - lag(r) OVER w) END AS dr FROM vr WINDOW w AS (PARTITION BY vid, ent ORDER BY e))"


@query(f"WITH {VAR} SELECT vid AS variant_id, round(avg(s), 6) AS mean_score, round(stddev_pop(s), 6) AS spread, round(avg(dr), 6) AS mean_rank_change FROM vd GROUP BY 1 ORDER BY 3 DESC NULLS LAST, 4 DESC NULLS LAST, 1")
def variant_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the component types as a column: all variants in one plan, then compared."""
    comps = macro.sectors(spark, d)[0]
    v = spark.createDataFrame(VARIANTS, "variant_id string, prior_weight double, dimension_weight double")
    return rounded(ranking.variant_comparison(scoring.varied(comps, v)))


# -- news scores and their combination


@query(f"WITH {news.DAY}, l AS (SELECT max(sd) AS sd FROM dd), x AS (SELECT key, adj, item_count FROM dd JOIN l USING (sd)), r AS (SELECT 'tailwind' AS side, key, adj, item_count, row_number() OVER (ORDER BY round(adj, 9) DESC, key) AS place FROM x WHERE adj > 0 UNION ALL SELECT 'headwind', key, adj, item_count, row_number() OVER (ORDER BY round(adj, 9), key) FROM x WHERE adj < 0) SELECT side, key, round(adj, 9) AS adjusted_score, item_count FROM r WHERE place <= 5")
def news_score_report(spark: SparkSession, d: str) -> DataFrame:
    x = reports.latest(news.days(spark, d), "score_date")
    cols = ["side", "key", "adjusted_score", "item_count"]
    up, down = (reports.top(x, "adjusted_score", "key", 5, s).withColumn("side", F.lit(n)).select(cols) for s, n in ((True, "tailwind"), (False, "headwind")))
    return rounded(up.unionByName(down), 9)


@query(f"WITH {news.COMB}, l AS (SELECT max(sd) AS sd FROM ck) SELECT rk AS rank, key, round(sc, 9) AS combined_score, round(greatest(0, least(1, ac)), 9) AS diagnostic_confidence, round(mw * ms, 9) AS macro_part, round(nwt * ns, 9) AS news_part FROM ck JOIN l USING (sd)")
def combined_report(spark: SparkSession, d: str) -> DataFrame:
    c = reports.latest(news.events.combined(news.macro_cross(spark, d), news.days(spark, d), max_age=2), "diagnostic_date")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("news_confidence")))
    return rounded(c.select("rank", "key", "combined_score", conf.alias("diagnostic_confidence"), (F.col("macro_weight") * F.col("macro_score")).alias("macro_part"), (F.col("news_weight") * F.col("news_score")).alias("news_part")), 9)


@query(f"WITH {news.COMB}, g AS (SELECT sd, max(abs(mk - rk)) AS most, avg(abs(mk - rk)) AS mean, sum(ic)::BIGINT AS items, min(ic) < 1 AS thin, string_agg(key::VARCHAR, ',' ORDER BY rk) FILTER (rk <= 5) AS top, string_agg(key::VARCHAR, ',' ORDER BY mk) FILTER (mk <= 5) AS macro_top FROM ck GROUP BY 1) SELECT sd AS diagnostic_date, most AS max_rank_change, round(mean, 9) AS avg_abs_rank_change, items AS news_item_count, thin AS thin_news, top AS top_combined, macro_top FROM g")
def combined_history(spark: SparkSession, d: str) -> DataFrame:
    c = news.events.combined(news.macro_cross(spark, d), news.days(spark, d), max_age=2)
    m = F.row_number().over(W.partitionBy("diagnostic_date").orderBy(F.round("macro_score", 12).desc(), "key"))
    c = c.withColumn("mk", m).withColumn("change", F.abs(F.col("mk") - F.col("rank")).cast("long"))
    five = lambda o: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(o, "key"))), 1, 5), lambda s: s.key.cast("string")), ",")  # noqa: E731  a date has one row per key
    return rounded(c.groupBy("diagnostic_date").agg(F.max("change").alias("max_rank_change"), F.avg("change").alias("avg_abs_rank_change"), F.sum("news_item_count").alias("news_item_count"), (F.min("news_item_count") < 1).alias("thin_news"), five("rank").alias("top_combined"), five("mk").alias("macro_top")), 9)


@query(f"WITH {news.DAY}, t AS (SELECT sd, key, adj, item_count, row_number() OVER (PARTITION BY sd ORDER BY round(adj, 9) DESC, key) AS r FROM dd) SELECT sd AS score_date, count(*) AS keys, string_agg(key::VARCHAR, ',' ORDER BY r) FILTER (r <= 5) AS top FROM t GROUP BY 1")
def news_history(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("score_date").orderBy(F.round("adjusted_score", 9).desc(), "key")
    t = news.days(spark, d).withColumn("_r", F.row_number().over(w))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.struct("_r", "key")))), lambda s: s.key.cast("string")), ",")
    return t.groupBy("score_date").agg(F.count(F.lit(1)).alias("keys"), top.alias("top"))


@query(f"WITH {news.COMB}, l AS (SELECT max(sd) AS sd FROM ck), x AS (SELECT max(abs(mk - rk)) AS most, avg(abs(mk - rk)) AS mean, max(abs(ns)) / nullif(sum(abs(ns)), 0) AS conc, sum(ic)::BIGINT AS items, count(*) FILTER (mk <> rk) AS changed FROM ck JOIN l USING (sd)) SELECT most AS max_rank_change, round(mean, 9) AS avg_abs_rank_change, round(conc, 9) AS concentration, items, changed, CASE WHEN most > 2 OR conc > 0.5 THEN 'warning' ELSE 'ok' END AS status FROM x")
def overlay_monitoring(spark: SparkSession, d: str) -> DataFrame:
    c = reports.latest(news.events.combined(news.macro_cross(spark, d), news.days(spark, d), max_age=2), "diagnostic_date")
    m = F.row_number().over(W.partitionBy("diagnostic_date").orderBy(F.round("macro_score", 12).desc(), "key"))
    c = c.withColumn("change", F.abs(m - F.col("rank")).cast("long"))
    g = c.agg(F.max("change").alias("max_rank_change"), F.avg("change").alias("avg_abs_rank_change"), F.try_divide(F.max(F.abs("news_score")), F.sum(F.abs("news_score"))).alias("concentration"), F.sum("news_item_count").alias("items"), F.count_if(F.col("change") > 0).alias("changed"))
    return rounded(g.withColumn("status", F.when(F.size(items.warned(rank=F.col("max_rank_change") > 2, concentration=F.col("concentration") > 0.5)) > 0, "warning").otherwise("ok")), 9)


LOADS = "ld AS (SELECT batch_no AS run, min(ingested_at)::DATE AS run_date, count(*) AS n, count(title) / count(*) AS rate, count(DISTINCT source_group)::INT AS groups, CASE WHEN count(title) / count(*) < 0.97 THEN 'failed' ELSE 'passed' END AS guard, CASE count(*) % 3 WHEN 0 THEN 'boom' WHEN 1 THEN 'heat' ELSE 'slump' END AS regime FROM sample_news_items GROUP BY 1)"


def loads(spark: SparkSession, d: str) -> DataFrame:
    """Each load as a run."""
    n = table(spark, d, "sample_news_items").groupBy(F.col("batch_no").alias("run_id")).agg(F.to_date(F.min("ingested_at")).alias("run_date"), F.count(F.lit(1)).alias("n"), F.try_divide(F.count("title"), F.count(F.lit(1))).alias("success_rate"), F.countDistinct("source_group").cast("int").alias("max_rank_change"))
    regime = F.when(F.col("n") % 3 == 0, "boom").when(F.col("n") % 3 == 1, "heat").otherwise("slump")
    return n.withColumn("confidence", F.col("success_rate")).withColumn("guardrail", F.when(F.col("success_rate") < 0.97, "failed").otherwise("passed")).withColumn("regime", regime)


@query(f"WITH {LOADS}, t AS (SELECT * FROM ld ORDER BY run_date DESC, run DESC LIMIT 20) SELECT count(*) AS runs, round(avg(rate), 9) AS mean_confidence, max(groups) AS most_rank_change, round(arg_max(rate, (run_date, run)), 9) AS last_success_rate FROM t")
def history_kpis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.kpis(loads(spark, d)), 9)


@query(f"WITH {LOADS}, t AS (SELECT *, lag(regime) OVER (ORDER BY run_date, run) AS before FROM ld ORDER BY run_date DESC, run DESC LIMIT 1) SELECT run AS run_id, concat_ws('; ', CASE WHEN guard <> 'passed' THEN 'guardrail status = ' || guard END, CASE WHEN before <> regime THEN 'regime change: ' || before || ' -> ' || regime END) AS alert FROM t")
def run_alert(spark: SparkSession, d: str) -> DataFrame:
    return reports.alerts(loads(spark, d))


@query(f"WITH {LOADS} SELECT CASE WHEN guard = 'failed' THEN 'failed' WHEN n % 2 = 0 THEN 'success_with_warnings' ELSE 'success' END AS status, count(*) AS n FROM ld GROUP BY 1")
def run_statuses(spark: SparkSession, d: str) -> DataFrame:
    r = loads(spark, d)
    return r.select(items.run_status(F.when(F.col("guardrail") == "failed", 1).otherwise(0), F.when(F.col("n") % 2 == 0, 1).otherwise(0)).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"{RT} {HELD} SELECT hl.e AS date, dom AS regime, round(mp, 6) AS probability, round(conf, 6) AS confidence, CASE WHEN conf IS NULL THEN 'unknown' WHEN conf >= 0.5 THEN 'high' WHEN conf >= 0.25 THEN 'moderate' ELSE 'low' END AS conviction FROM hl WHERE valid ORDER BY e DESC LIMIT 1".replace("SELECT hl.e AS date, dom AS regime, round(mp", "SELECT hl.e AS date, dom AS regime, round(mp").replace("ORDER BY e", "ORDER BY hl.e"))
def regime_status(spark: SparkSession, d: str) -> DataFrame:
    """The first valid of two documents: an invalid one, and the latest state."""
    h = reports.latest(macro.chain(spark, d).health.where("valid"), "date")
    doc = h.select("valid", F.lit(None).cast("string").alias("reported_state"), F.col("dominant").alias("raw_state"), F.col("dominant_probability").alias("probability"), "confidence")
    got = reports.first_valid(doc.withColumn("valid", F.lit(False)), doc)
    return rounded(h.select("date").crossJoin(got).withColumn("conviction", reports.conviction(F.col("confidence"))))


@query("SELECT coalesce(source_group, 'unmapped') AS grp, count(*) AS sources, string_agg(source, '|' ORDER BY source, source_id) AS names FROM news_sources WHERE provider = 'rss' GROUP BY 1")
def sources_used(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "news_sources").where("provider = 'rss'")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "source_id"))), lambda x: x.source), "|")
    return s.groupBy(F.coalesce("source_group", F.lit("unmapped")).alias("grp")).agg(F.count(F.lit(1)).alias("sources"), names.alias("names"))


@query(f"WITH {news.FEED}, {news.SEC}, t AS (SELECT key, count(DISTINCT i) AS n, sum(a) AS s FROM sl GROUP BY 1) SELECT key, n AS item_count, round(s, 9) AS score FROM t WHERE s <> 0 OR n > 0 ORDER BY abs(round(s, 9)) DESC, n DESC, key DESC LIMIT 3".replace("round(s, 9) AS score FROM t", "round(s, 9) AS score FROM t"))
def top_long_themes(spark: SparkSession, d: str) -> DataFrame:
    """The three of greatest absolute score, uncapped over sources."""
    s = news.events.secular(news.feed(spark, d), news.AS_OF, 45.0, 180, news.ITEM_CAP, 1e9)
    return rounded(s.orderBy(F.abs(F.round("score", 9)).desc(), F.col("item_count").desc(), F.col("key").desc()).limit(3).select("key", "item_count", "score"), 9)


@query(f"WITH {feed.CLASS}, e AS (SELECT secular_theme AS theme, ai_provider, source, severity * cl.confidence AS a FROM cl LEFT JOIN it USING (news_id) WHERE classification_status = 'success' AND secular_theme IN ('ai_compute', 'energy_transition')), m AS (SELECT theme, coalesce(source, 'unknown') AS s, count(*) AS n FROM e GROUP BY 1, 2) SELECT theme, round(sum(abs(a)) FILTER (ai_provider LIKE '%mock%') / nullif(sum(abs(a)), 0), 9) AS mock_ratio, (SELECT count(*) FROM m WHERE m.theme = e.theme) AS sources, (SELECT max(n) FROM m WHERE m.theme = e.theme) AS most FROM e GROUP BY 1")
def long_theme_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of the stand-in classifier in each long theme, and how its items spread over sources."""
    e = items.dated_events(feed.classes(spark, d), feed.news(spark, d), feed.LONG_THEMES).withColumn("a", F.abs(F.col("severity") * F.col("confidence")))
    r = e.groupBy(F.col("secular_theme").alias("theme")).agg(F.try_divide(F.sum(F.when(F.col("ai_provider").contains("mock"), F.col("a"))), F.sum("a")).alias("mock_ratio"))
    m = e.groupBy(F.col("secular_theme").alias("theme"), F.coalesce("source", F.lit("unknown")).alias("s")).agg(F.count(F.lit(1)).alias("n")).groupBy("theme").agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most"))
    return rounded(r.join(m, "theme"), 9)


@query(f"WITH {DIM} SELECT o AS output_id, e AS date, reason FROM dim WHERE e BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND reason <> 'ok' UNION ALL SELECT 'empty', NULL, 'no_scores'")
def dimension_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Invalid scores of a range of dates; a configured dimension without any score says so."""
    dims = macro.chain(spark, d).dims
    wanted = spark.createDataFrame([("growth",), ("pressure",), ("empty",)], "output_id string")
    bad = dims.where(F.col("date").between("1998-01-01", "1999-12-31") & (F.col("reason") != "ok")).select("output_id", "date", "reason")
    none = wanted.join(dims.select("output_id").distinct(), "output_id", "left_anti").select("output_id", F.lit(None).cast("date").alias("date"), F.lit("no_scores").alias("reason"))
    return bad.unionByName(none)
