"""DuckDB SQL of the queries in macro, written on its own from the operators' definitions."""

from __future__ import annotations

from tidemark.plans.macro import DIMENSIONS, ENTITIES, PRIORITIES, REGIMES

OBS = "obs AS (SELECT o_orderpriority AS s, date_trunc('month', o_orderdate)::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


def weighted(rows) -> str:
    return ", ".join(f"('{r.output_id}', '{r.input_id}', {r.weight}, '{r.polarity}', {r.ordinal})" for r in rows)


def signed(k: str, x: str) -> str:
    return f"CASE {k} WHEN 'positive' THEN {x} WHEN 'negative' THEN -{x} WHEN 'positive_only' THEN greatest({x}, 0) WHEN 'negative_only' THEN greatest(-{x}, 0) WHEN 'penalize_positive_only' THEN -greatest({x}, 0) WHEN 'penalize_negative_only' THEN -greatest(-{x}, 0) ELSE -abs({x}) END"


FEATS = ", ".join(f"('f{k}', '{p}', {k % 2})" for k, p in enumerate(PRIORITIES, 1))
CAL = "cal AS (SELECT unnest(generate_series(DATE '1995-07-01', DATE '2001-08-01', INTERVAL 1 MONTH))::DATE AS e)"
FEAT = f"""{OBS}, fd(f, s, y) AS (VALUES {FEATS}),
t0 AS (SELECT f, d, v, CASE WHEN y = 1 THEN (v / lag(v, 12) OVER w - 1) * 100 ELSE v - lag(v, 3) OVER w END AS t FROM obs JOIN fd USING (s) WINDOW w AS (PARTITION BY f ORDER BY d)),
ft AS (SELECT f, d, CASE WHEN count(t) OVER w >= 12 AND stddev_pop(t) OVER w > 0 THEN (t - avg(t) OVER w) / stddev_pop(t) OVER w END AS z FROM t0 WINDOW w AS (PARTITION BY f ORDER BY d ROWS 35 PRECEDING))"""
SEEN = f"""{FEAT}, {CAL}, good AS (SELECT f, d, z FROM ft WHERE z IS NOT NULL),
p AS (SELECT e, f FROM cal CROSS JOIN (SELECT DISTINCT f FROM fd)),
seen AS (SELECT p.e, p.f, g.d AS od, g.z, date_diff('day', g.d, p.e) AS lag_days,
  CASE WHEN g.d IS NULL AND EXISTS (SELECT 1 FROM good h WHERE h.f = p.f AND h.d <= p.e) THEN 'not_yet_published' WHEN g.d IS NULL THEN 'no_prior_valid_feature' WHEN date_diff('day', g.d, p.e) > 75 THEN 'stale_asof_value' ELSE 'ok' END AS reason
  FROM p ASOF LEFT JOIN (SELECT f, d, z, d + 20 AS seen FROM good) g ON p.f = g.f AND p.e >= g.seen)"""
DIM = f"""{SEEN}, dcfg(o, i, w, k, n) AS (VALUES {weighted(DIMENSIONS)}),
dc AS (SELECT o, i, e, w, n, reason = 'ok' AS ok, reason, CASE WHEN reason = 'ok' THEN {signed('k', 'z')} END AS sv FROM dcfg JOIN seen ON seen.f = i),
dcn AS (SELECT *, CASE WHEN ok THEN w / sum(CASE WHEN ok THEN w END) OVER (PARTITION BY o, e) ELSE 0 END AS nw FROM dc),
dim0 AS (SELECT o, e, sum(CASE WHEN ok THEN sv * nw ELSE 0 END) AS s, count(*) FILTER (ok) AS n, coalesce(sum(w) FILTER (ok), 0) / sum(w) AS cov FROM dcn GROUP BY 1, 2),
dim AS (SELECT o, e, n, cov, CASE WHEN n < 2 THEN 'below_min_valid_features' WHEN cov < 0.6 - 1e-9 THEN 'below_min_coverage_ratio' ELSE 'ok' END AS reason, CASE WHEN n >= 2 AND cov >= 0.6 - 1e-9 THEN s END AS score FROM dim0)"""
REG = f"""{DIM}, rcfg(o, i, w, k, n) AS (VALUES {weighted(REGIMES)}),
rc AS (SELECT r.o, r.i, e, r.w, score IS NOT NULL AS ok, CASE WHEN score IS NOT NULL THEN {signed('r.k', 'score')} END AS sv FROM rcfg r JOIN dim ON dim.o = r.i),
rcn AS (SELECT *, CASE WHEN ok THEN w / sum(CASE WHEN ok THEN w END) OVER (PARTITION BY o, e) ELSE 0 END AS nw FROM rc),
reg0 AS (SELECT o, e, sum(CASE WHEN ok THEN sv * nw ELSE 0 END) AS s, count(*) FILTER (ok) AS n, coalesce(sum(w) FILTER (ok), 0) / sum(w) AS cov FROM rcn GROUP BY 1, 2),
reg1 AS (SELECT o, e, cov, n >= 1 AND cov >= 0.3 - 1e-9 AS ok, CASE WHEN n >= 1 AND cov >= 0.3 - 1e-9 THEN s END AS score FROM reg0),
reg2 AS (SELECT *, exp(score - max(score) OVER (PARTITION BY e)) AS x FROM reg1),
reg3 AS (SELECT *, x / sum(x) OVER (PARTITION BY e) AS p FROM reg2),
reg AS (SELECT *, CASE WHEN p IS NOT NULL THEN (row_number() OVER (PARTITION BY e ORDER BY p DESC NULLS LAST, o))::INT END AS rk FROM reg3),
hl0 AS (SELECT e, count(p) AS n, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h, avg(cov) FILTER (p IS NOT NULL) AS c, max(p) AS mp, min(o) FILTER (rk = 1) AS dom FROM reg GROUP BY 1),
hl AS (SELECT e, n, n > 0 AS valid, dom, mp, CASE WHEN n > 0 THEN (CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0, least(1, 1 - h / ln(n))) END) * c END AS conf, CASE WHEN n > 0 THEN h END AS h FROM hl0)"""
TOP = f"""{REG}, top AS (SELECT hl.e, hl.valid, a.o AS raw, a.p AS rp, b.o AS second, b.p AS sp, hl.conf FROM hl LEFT JOIN reg a ON a.e = hl.e AND a.rk = 1 LEFT JOIN reg b ON b.e = hl.e AND b.rk = 2)"""
HELD = f"""{TOP}, l AS (SELECT *, row_number() OVER (ORDER BY e) AS k FROM top),
st AS (
  SELECT 0::BIGINT AS k, NULL::VARCHAR AS cur, NULL::VARCHAR AS pend, 0 AS c, NULL::VARCHAR AS why
  UNION ALL
  SELECT k, CASE WHEN why IN ('initial_state', 'switch_confirmed') THEN raw ELSE cur END, CASE WHEN why = 'invalid' THEN pend WHEN why = 'awaiting_confirmation' THEN raw END,
    CASE WHEN why = 'invalid' THEN c WHEN why = 'awaiting_confirmation' THEN run ELSE 0 END, why
  FROM (SELECT l.k, l.raw, st.cur, st.pend, st.c, CASE WHEN st.pend = l.raw THEN st.c + 1 ELSE 1 END AS run,
      CASE WHEN NOT l.valid THEN 'invalid' WHEN st.cur IS NULL THEN 'initial_state' WHEN st.cur = l.raw THEN 'raw_signal_confirmed' WHEN coalesce(l.conf, 0) < 0.02 THEN 'held_below_min_confidence'
        WHEN (CASE WHEN st.pend = l.raw THEN st.c + 1 ELSE 1 END) >= (CASE WHEN coalesce(l.conf, 0) < 0.15 THEN 2 ELSE 1 END) THEN 'switch_confirmed' ELSE 'awaiting_confirmation' END AS why
    FROM st JOIN l ON l.k = st.k + 1)),
tl AS (SELECT l.e, l.valid, l.raw, CASE WHEN st.why <> 'invalid' THEN st.cur END AS rep, st.why, l.conf, reg.p AS repp FROM l JOIN st USING (k) LEFT JOIN reg ON reg.e = l.e AND reg.o = CASE WHEN st.why <> 'invalid' THEN st.cur END)"""
MATRIX = ", ".join([f"('{e}', 'regime_prior', '{r}', {w})" for e, b, h, _, _ in ENTITIES for r, w in (("boom", b), ("heat", h))] + [f"('{e}', 'dimension_exposure', '{x}', {w})" for e, _, _, g, p in ENTITIES for x, w in (("growth", g), ("pressure", p))])
SECT = f"""{REG}, m(ent, ct, ci, w) AS (VALUES {MATRIX}),
vals AS (SELECT e, 'regime_prior' AS ct, o AS ci, p AS x FROM reg WHERE p IS NOT NULL UNION ALL SELECT e, 'dimension_exposure', o, score FROM dim WHERE score IS NOT NULL),
sc AS (SELECT ent, hl.e, m.ct, m.ci, vals.x, w, coalesce(x * w, 0) AS c, x IS NOT NULL AS ok FROM hl CROSS JOIN m LEFT JOIN vals ON vals.e = hl.e AND vals.ct = m.ct AND vals.ci = m.ci),
ss0 AS (SELECT ent, sc.e, bool_and(ok) AS valid, coalesce(string_agg(sc.ct || ':' || sc.ci, ',' ORDER BY sc.ct || ':' || sc.ci) FILTER (NOT ok), '') AS missing, CASE WHEN bool_and(ok) THEN sum(c) END AS raw FROM sc GROUP BY 1, 2),
ss1 AS (SELECT ss0.*, raw * (0.4 + 0.6 * greatest(0, least(1, coalesce(conf, 0)))) AS adj FROM ss0 JOIN hl USING (e)),
ss AS (SELECT *, CASE WHEN valid THEN (row_number() OVER (PARTITION BY e ORDER BY adj DESC NULLS LAST, ent))::INT END AS rk FROM ss1)"""
PR = """pr AS (SELECT p_brand AS tk, l_shipdate::DATE AS d, avg(l_extendedprice) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 UNION ALL SELECT 'ALL', l_shipdate::DATE, avg(l_extendedprice) FROM lineitem GROUP BY 1, 2),
sd AS (SELECT DISTINCT tk AS ent FROM pr WHERE tk <> 'ALL'), cd AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS d),
s AS (SELECT ent, d, ((length(ent) * 7 + ascii(right(ent, 1)) * 13 + ascii(left(right(ent, 2), 1)) * 5 + month(d) * 11) % 17)::DOUBLE AS score FROM sd CROSS JOIN cd),
q AS (SELECT ent, d, h, role, CASE role WHEN 'own' THEN ent ELSE 'ALL' END AS tk, (d + to_months(h))::DATE AS due FROM s CROSS JOIN (VALUES (0), (1), (3)) hh(h) CROSS JOIN (VALUES ('own'), ('bench')) rr(role)),
x AS (SELECT q.ent, q.d, h, role, CASE WHEN date_diff('day', due, pr.d) <= 7 THEN c END AS c FROM q ASOF LEFT JOIN pr ON q.tk = pr.tk AND q.due <= pr.d),
y AS (SELECT ent, d, max(c) FILTER (h = 0 AND role = 'own') AS o0, max(c) FILTER (h = 1 AND role = 'own') AS o1, max(c) FILTER (h = 3 AND role = 'own') AS o3, max(c) FILTER (h = 0 AND role = 'bench') AS b0, max(c) FILTER (h = 1 AND role = 'bench') AS b1, max(c) FILTER (h = 3 AND role = 'bench') AS b3 FROM x GROUP BY 1, 2),
ret AS (SELECT s.ent, s.d, score, o1 / o0 - 1 AS f1, (o1 / o0 - 1) - (b1 / b0 - 1) AS r1, o3 / o0 - 1 AS f3, (o3 / o0 - 1) - (b3 / b0 - 1) AS r3 FROM s LEFT JOIN y USING (ent, d))"""
LAB = "lab AS (SELECT round(o_totalprice / 1000, 0) AS score, o_orderstatus = 'F' AS label FROM orders)"
AVG_RANK = "rank() OVER (PARTITION BY d ORDER BY {0}) + (count(*) OVER (PARTITION BY d, {0}) - 1) / 2.0"


def transforms(expr: str, name: str) -> str:
    short = {"level": 0, "diff_3m": 3, "diff_6m": 6, "diff_12m": 12, "yoy_pct_change": 12}[name]
    why = "'ok'" if not short else f"CASE WHEN lag(v, {short}) OVER w IS NULL THEN 'insufficient_transform_history' ELSE 'ok' END"
    return f"SELECT '{name}|' || s AS feature_id, d AS date, round({expr}, 6) AS transformed_value, {why} AS reason FROM obs WINDOW w AS (PARTITION BY s ORDER BY d)"


SQL = {
    "latest_states": f"WITH {REG} SELECT e AS date, o AS output_id, round(score, 6) AS score, round(p, 6) AS probability, rk AS rank FROM reg WHERE p IS NOT NULL AND e = (SELECT max(e) FROM reg WHERE p IS NOT NULL)",
    "scan_projection": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49",
    "vintage_dedupe": "SELECT series_id, date, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM raw_observations QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY fetched_at DESC NULLS LAST, value DESC NULLS LAST) = 1",
    "feature_diff_yoy": f"WITH {OBS} " + " UNION ALL ".join([transforms("v", "level"), *[transforms(f"v - lag(v, {n}) OVER w", f"diff_{n}m") for n in (3, 6, 12)], transforms("(v / lag(v, 12) OVER w - 1) * 100", "yoy_pct_change")]),
    "rolling_zscore": f"""WITH {OBS}, z AS (SELECT s, d, CASE WHEN count(v) OVER w >= 24 AND stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS z,
        coalesce(lag(d, 35) OVER (PARTITION BY s ORDER BY d), lag(d, 23) OVER (PARTITION BY s ORDER BY d)) AS b FROM obs WINDOW w AS (PARTITION BY s ORDER BY d ROWS 35 PRECEDING))
        SELECT s AS feature_id, d AS date, round(z, 6) AS normalized_value, b AS window_start, z IS NOT NULL AS valid FROM z""",
    "expanding_zscore": """WITH o AS (SELECT c_mktsegment AS s, o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
        z AS (SELECT s, d, CASE WHEN count(v) OVER w >= 30 AND stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS z FROM o WINDOW w AS (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING))
        SELECT s AS feature_id, d AS date, round(z, 6) AS normalized_value, CASE WHEN z IS NULL THEN 'insufficient_normalization_history' ELSE 'ok' END AS reason FROM z""",
    "feature_health": f"""WITH {OBS}, t AS (SELECT s, d, (v / lag(v, 12) OVER w - 1) * 100 AS t FROM obs WINDOW w AS (PARTITION BY s ORDER BY d)),
        z AS (SELECT s, d, CASE WHEN t IS NULL THEN 'insufficient_transform_history' WHEN count(t) OVER w < 24 OR stddev_pop(t) OVER w = 0 THEN 'insufficient_normalization_history' ELSE 'ok' END AS r FROM t WINDOW w AS (PARTITION BY s ORDER BY d ROWS 35 PRECEDING)),
        g AS (SELECT s, r, count(*) AS n, max(CASE WHEN r = 'ok' THEN d END) AS d FROM z GROUP BY 1, 2 UNION ALL SELECT 'off', 'disabled_feature', 1, NULL UNION ALL SELECT 'none', 'missing_source_data', 1, NULL)
        SELECT s AS feature_id, coalesce(sum(n) FILTER (r = 'ok'), 0)::BIGINT AS valid_count, coalesce(sum(n) FILTER (r <> 'ok'), 0)::BIGINT AS invalid_count, max(d) AS latest_valid_date, coalesce(sum(n) FILTER (r = 'ok'), 0) > 0 AS usable, string_agg(r || '=' || n, ',' ORDER BY r || '=' || n) AS reasons FROM g GROUP BY 1""",
    "source_health": f"""WITH {OBS}, a AS (SELECT s, max(d) AS d, count(*) FILTER (v IS NULL) AS m FROM obs GROUP BY 1), src(s, stale, en) AS (VALUES {', '.join(f"('{p}', 20, true)" for p in PRIORITIES)}, ('absent', 45, true), ('off', 45, false)),
        j AS (SELECT src.s, a.d, date_diff('day', a.d, DATE '2001-09-01')::INT AS n, coalesce(m, 0) AS m, CASE WHEN NOT en THEN 'retired' WHEN a.d IS NULL THEN 'no_observations' WHEN date_diff('day', a.d, DATE '2001-09-01') > 120 THEN 'unusable_stale' WHEN date_diff('day', a.d, DATE '2001-09-01') > stale THEN 'stale' ELSE 'fresh' END AS r FROM src LEFT JOIN a USING (s))
        SELECT s AS series_id, d AS last_observation_date, n::DOUBLE AS days_since, m AS missing_count, r IN ('stale', 'unusable_stale') AS stale, r IN ('fresh', 'stale') AS usable, r AS reason FROM j""",
    "month_spine": "SELECT unnest(generate_series(DATE '1995-07-01', DATE '2001-08-01', INTERVAL 1 MONTH))::DATE AS evaluation_date, 'start' AS at UNION ALL SELECT last_day(m::DATE), 'end' FROM (SELECT unnest(generate_series(DATE '1995-06-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS m)",
    "asof_reasons": f"WITH {SEEN} SELECT e AS evaluation_date, f AS feature_id, od AS source_observation_date, round(z, 6) AS normalized_value, lag_days::DOUBLE AS lag_days, reason FROM seen",
    "dimension_contributions": f"WITH {DIM} SELECT o AS output_id, i AS input_id, e AS date, round(nw, 6) AS normalized_weight, round(sv, 6) AS signed_value, round(CASE WHEN ok THEN sv * nw ELSE 0 END, 6) AS contribution, ok AS valid FROM dcn",
    "dimension_scores": f"WITH {DIM} SELECT o AS output_id, e AS date, round(score, 6) AS score, n AS valid_count, round(cov, 6) AS coverage_ratio, reason FROM dim",
    "dimension_health": f"WITH {DIM} SELECT o AS output_id, e AS date, count(*) FILTER (ok) AS valid_count, '' AS missing, coalesce(string_agg(i, ',' ORDER BY n) FILTER (NOT ok), '') AS invalid FROM dcn GROUP BY 1, 2",
    "regime_scores": f"WITH {REG} SELECT o AS output_id, e AS date, round(score, 6) AS score, round(p, 6) AS probability, rk::DOUBLE AS rank, ok AS valid FROM reg",
    "regime_health": f"WITH {REG} SELECT e AS date, valid, dom AS dominant, round(mp, 6) AS dominant_probability, round(conf, 6) AS confidence, round(h, 6) AS entropy, n AS valid_count, CASE WHEN valid THEN 'ok' ELSE 'no_valid_regimes' END AS reason FROM hl",
    "top2_gap": f"WITH {REG} SELECT e AS date, round(max(p) FILTER (rk = 1) - coalesce(max(p) FILTER (rk = 2), 0), 6) AS gap FROM reg GROUP BY 1",
    "polarity_matrix": "WITH t AS (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer) SELECT c_custkey, " + ", ".join(f"round({signed(chr(39) + p + chr(39), 'x')}, 6) AS {p}" for p in ("positive", "negative", "positive_only", "negative_only", "penalize_positive_only", "penalize_negative_only", "reward_near_zero")) + " FROM t",
    "regime_timeline_top2": f"WITH {TOP} SELECT e AS date, valid, raw AS raw_state, round(rp, 6) AS raw_probability, second AS second_state, round(sp, 6) AS second_probability, round(conf, 6) AS confidence FROM top",
    "transition_filter": f"WITH RECURSIVE {HELD} SELECT e AS date, raw AS raw_state, rep AS reported_state, why AS filter_reason, round(repp, 6) AS reported_probability FROM tl",
    "regime_transitions": f"WITH RECURSIVE {HELD}, v AS (SELECT *, lag(rep) OVER (ORDER BY e) AS ps, lag(repp) OVER (ORDER BY e) AS pp FROM tl WHERE valid) SELECT e AS transition_date, ps AS from_state, rep AS to_state, round(pp, 6) AS from_probability, round(repp, 6) AS to_probability FROM v WHERE ps <> rep",
    "regime_runlength": f"WITH RECURSIVE {HELD}, v AS (SELECT e, rep, CASE WHEN lag(rep) OVER (ORDER BY e) = rep THEN 0 ELSE 1 END AS nw FROM tl WHERE valid), g AS (SELECT e, rep, (sum(nw) OVER (ORDER BY e))::INT AS run FROM v) SELECT run, min(rep) AS state, min(e) AS start, max(e) AS end, count(*) AS length FROM g GROUP BY run",
    "regime_summary": f"""WITH RECURSIVE {HELD}, v AS (SELECT e, rep, CASE WHEN lag(rep) OVER (ORDER BY e) = rep THEN 0 ELSE 1 END AS nw FROM tl WHERE valid), g AS (SELECT e, sum(nw) OVER (ORDER BY e) AS run FROM v), rr AS (SELECT run, count(*) AS n FROM g GROUP BY 1)
        SELECT count(*) FILTER (valid) AS valid_count, count(*) FILTER (NOT valid) AS invalid_count, round(avg(conf) FILTER (valid), 6) AS avg_confidence, count(*) FILTER (valid AND coalesce(conf, 0) < 0.25) AS low_confidence_count, (SELECT round(avg(n), 6) FROM rr) AS avg_run, (SELECT greatest(count(*) - 1, 0) FROM rr) AS switch_count FROM tl""",
    "stacked_bands": f"WITH {REG} SELECT e AS date, o AS output_id, round(sum(p) OVER (PARTITION BY e ORDER BY o ROWS UNBOUNDED PRECEDING), 6) AS upper FROM reg WHERE p IS NOT NULL",
    "sector_components": f"WITH {SECT} SELECT ent AS entity_id, e AS date, ct AS component_type, ci AS component_id, round(x, 6) AS input_value, w::DOUBLE AS weight, round(c, 6) AS contribution, ok AS valid, CASE WHEN ok THEN 'ok' WHEN ct = 'regime_prior' THEN 'missing_regime_probability' ELSE 'missing_dimension_score' END AS reason FROM sc",
    "sector_scores": f"WITH {SECT} SELECT ent AS entity_id, e AS date, round(raw, 6) AS raw_score, round(adj, 6) AS adjusted_score, rk::DOUBLE AS rank, missing, valid FROM ss",
    "forward_returns": f"WITH {PR} SELECT ent AS entity_id, d AS score_date, round(f1, 6) AS forward_1m_return, round(r1, 6) AS relative_forward_1m_return, round(f3, 6) AS forward_3m_return, round(r3, 6) AS relative_forward_3m_return, CASE WHEN coalesce(r1, r3) IS NULL THEN 'missing_forward_prices' ELSE 'ok' END AS reason FROM ret",
    "spearman_ic": f"WITH {PR}, k AS (SELECT d, {AVG_RANK.format('score')} AS a, {AVG_RANK.format('r')} AS b FROM (SELECT d, score, round(r1, 9) AS r FROM ret WHERE r1 IS NOT NULL)) SELECT d AS score_date, count(*) AS n, CASE WHEN count(*) >= 2 AND min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS ic FROM k GROUP BY 1",
    "quintile_spread": f"WITH {PR}, k AS (SELECT r1, row_number() OVER (PARTITION BY d ORDER BY score DESC, ent) AS r, count(*) OVER (PARTITION BY d) AS n FROM ret WHERE r1 IS NOT NULL), m AS (SELECT *, greatest(1, round_even(n * 0.2, 0)) AS q FROM k WHERE n >= 2) SELECT round(avg(r1) FILTER (r <= q), 6) AS top_avg, round(avg(r1) FILTER (r > n - q), 6) AS bottom_avg, round(avg(r1) FILTER (r <= q) - avg(r1) FILTER (r > n - q), 6) AS spread, round(avg((r1 > 0)::INT) FILTER (r <= q), 6) AS hit_rate FROM m",
    "auroc": f"WITH {LAB}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM lab) SELECT count(*) FILTER (label) AS positives, count(*) FILTER (NOT label) AS negatives, round((sum(k) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 6) AS auroc FROM r",
    "threshold_metrics": f"WITH {LAB} SELECT t::DOUBLE AS threshold, count(*) FILTER (label AND score >= t) AS hits, round(count(*) FILTER (label AND score >= t) / count(*) FILTER (label), 6) AS hit_rate, count(*) FILTER (NOT label AND score >= t) AS flags, round(count(*) FILTER (NOT label AND score >= t) / count(*) FILTER (NOT label), 6) AS flag_rate FROM lab CROSS JOIN (VALUES (50), (150), (300)) v(t) GROUP BY t",
    "lead_lag": f"WITH {REG}, w(s, f) AS (VALUES (DATE '1997-03-01', DATE '1997-08-01'), (DATE '1999-06-01', DATE '1999-09-01'), (DATE '2030-01-01', DATE '2030-03-01')), h AS (SELECT s, f, min(e) AS m FROM w LEFT JOIN reg ON o = 'slump' AND p >= 0.45 AND e BETWEEN s - INTERVAL 6 MONTH AND f GROUP BY 1, 2) SELECT s AS start, f AS end, m AS detected, ((year(m) - year(s)) * 12 + month(m) - month(s))::DOUBLE AS lead_lag_months FROM h",
    "corr_matrix": f"WITH {REG} SELECT x.o AS a, y.o AS b, round(corr(x.score, y.score), 6) AS corr FROM reg x JOIN reg y ON x.e = y.e AND x.o < y.o WHERE x.score IS NOT NULL AND y.score IS NOT NULL GROUP BY 1, 2",
    "confidence_quantiles": f"WITH {REG} SELECT round(quantile_cont(conf, 0.25), 6) AS p25, round(quantile_cont(conf, 0.5), 6) AS p50, round(quantile_cont(conf, 0.75), 6) AS p75 FROM hl WHERE conf IS NOT NULL",
    "rank_stability": f"WITH {SECT}, v AS (SELECT ent, e, rk, dense_rank() OVER (ORDER BY e) AS n FROM ss WHERE valid), x AS (SELECT CASE WHEN lag(n) OVER w = n - 1 THEN abs(rk - lag(rk) OVER w) END AS d FROM v WINDOW w AS (PARTITION BY ent ORDER BY n)) SELECT round(avg(d), 6) AS mean_abs_change FROM x",
    "component_dominance": f"WITH {SECT}, x AS (SELECT ct, ci, abs(c) AS a, abs(c) / nullif(sum(abs(c)) OVER (PARTITION BY ent, e), 0) AS s FROM sc) SELECT ct AS component_type, ci AS component_id, round(avg(a), 6) AS mean_abs, round(max(s), 6) AS max_share FROM x GROUP BY 1, 2",
    "score_dispersion": f"WITH {SECT}, x AS (SELECT e, stddev_samp(adj) AS s, max(abs(adj)) AS m FROM ss WHERE valid GROUP BY 1) SELECT round(avg(s), 6) AS mean_std, round(max(m), 6) AS max_abs FROM x",
    "variants": f"WITH {REG}, x AS (SELECT t, e, exp((score - max(score) OVER (PARTITION BY t, e)) / t) AS x FROM reg CROSS JOIN (VALUES (0.6::DOUBLE), (1.0), (2.0)) v(t) WHERE score IS NOT NULL), y AS (SELECT t, e, x / sum(x) OVER (PARTITION BY t, e) AS p FROM x), h AS (SELECT t, e, CASE WHEN count(*) <= 1 THEN 1 ELSE greatest(0, least(1, 1 + sum(p * ln(p)) / ln(count(*)))) END AS c FROM y GROUP BY 1, 2) SELECT t::DOUBLE AS temperature, round(avg(c), 6) AS avg_confidence FROM h GROUP BY 1",
}
