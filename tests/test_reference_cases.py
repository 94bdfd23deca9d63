"""Hand-computed cases of transforms, as-of joins, roll-ups, states, ranks and events."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, classify, events, ranking, scoring, series, state, text
from tidemark.params import Feature, Source, Weighted, check
from tidemark.sources import tables

D = datetime.date
M = lambda k: D(2000 + k // 12, k % 12 + 1, 1)
OBS = "series_id string, date date, value double, fetched_at timestamp"


def monthly(spark, values, sid="s"):
    return spark.createDataFrame([(sid, M(k), v, None) for k, v in enumerate(values)], OBS)


def feats(spark, values, **kw):
    return series.features(monthly(spark, values), [Source("s", "monthly")], [Feature("f", "s", **kw)]).orderBy("date").collect()


def test_level_diff_yoy(spark):
    assert [r.transformed_value for r in feats(spark, [1.0, 2.0, 3.0])] == [1.0, 2.0, 3.0]
    assert feats(spark, [float(k) for k in range(7)], transform="diff_6m")[6].transformed_value == 6.0
    assert feats(spark, [100.0] * 12 + [112.0], transform="yoy_pct_change")[12].transformed_value == pytest.approx(12.0)


def test_no_leakage_and_reasons(spark):
    v = [math.sin(k) + k / 10 for k in range(72)]
    a = feats(spark, v, normalization="rolling_z_3y", min_observations=12)
    b = feats(spark, [*v[:-1], 10000.0], normalization="rolling_z_3y", min_observations=12)
    assert [r.normalized_value for r in a[:71]] == [r.normalized_value for r in b[:71]]
    r = feats(spark, [1.0, 2.0, float("nan"), 4.0, 5.0], transform="diff_6m", normalization="rolling_z_5y", min_observations=6)
    assert [x.reason for x in r] == ["insufficient_transform_history"] * 2 + ["missing_raw_value"] + ["insufficient_transform_history"] * 2


def test_constant_series_has_no_zscore(spark):
    assert all(r.normalized_value is None for r in feats(spark, [5.0] * 30, normalization="expanding_z", min_observations=5))


def test_disabled_missing_and_vintages(spark):
    r = series.features(monthly(spark, [1.0]), [Source("s", "monthly", enabled=False), Source("t", "monthly")], [Feature("a", "s"), Feature("b", "t"), Feature("c", "t", enabled=False)])
    assert {(x.feature_id, x.date, x.reason) for x in r.collect()} == {("a", None, "disabled_source"), ("b", None, "missing_source_data"), ("c", None, "disabled_feature")}
    t = lambda h: datetime.datetime(2020, 1, 1, h)
    o = spark.createDataFrame([("s", M(k), k + x, t(h)) for k in range(6) for h, x in ((1, 0.0), (2, 0.5))], OBS)
    assert sorted(r.value for r in series.latest_vintage(o).collect()) == [k + 0.5 for k in range(6)]


def test_config_is_checked():
    with pytest.raises(ValueError, match="unknown series"):
        check([Source("s", "daily")], [Feature("f", "x")])
    with pytest.raises(ValueError, match="unknown input"):
        check([Source("s", "daily")], [Feature("f", "s")], [Weighted("o", "g", 1.0)])


FEATURE_ROWS = "feature_id string, date date, transformed_value double, normalized_value double, valid boolean"


def seen(spark, rows, day, lag=0, limit=10):
    cal = spark.createDataFrame([(day,)], "evaluation_date date")
    f = spark.createDataFrame([("f", d, v, v, ok) for d, v, ok in rows], FEATURE_ROWS)
    r = asof.asof_features(cal, f, [Feature("f", "s")], [Source("s", "daily", publication_lag_days=lag)], {"daily": limit}).collect()[0]
    return r.normalized_value, r.lag_days, r.reason


def test_asof(spark):
    rows = [(D(2026, 4, 28), 1.0, True), (D(2026, 5, 3), 99.0, True)]
    e = D(2026, 5, 1)
    assert seen(spark, rows, e) == (1.0, 3, "ok")
    assert seen(spark, rows, e, limit=1) == (1.0, 3, "stale_asof_value")
    assert seen(spark, [(e, 5.0, True)], e) == (5.0, 0, "ok")
    assert seen(spark, [(D(2026, 4, 20), 1.0, True), (D(2026, 4, 28), 2.0, True)], e, lag=5) == (1.0, 11, "stale_asof_value")
    assert seen(spark, [(D(2026, 4, 26), 2.0, True)], e, lag=5) == (2.0, 5, "ok")
    assert seen(spark, [(D(2026, 4, 28), 2.0, True)], e, lag=5)[2] == "not_yet_published"
    assert seen(spark, rows[1:], e)[2] == "no_prior_valid_feature"
    assert seen(spark, [(D(2026, 4, 28), 1.0, True), (D(2026, 4, 30), None, False)], e) == (1.0, 3, "ok")


VALUES = "input_id string, date date, value double, valid boolean, reason string"


def dims(spark, b_ok, min_valid, cov):
    cfg = [Weighted("d", "a", 0.6, "positive", min_valid, cov, 1), Weighted("d", "b", 0.4, "negative", min_valid, cov, 2)]
    v = spark.createDataFrame([("a", M(0), 1.0, True, "ok"), ("b", M(0), 2.0, b_ok, "ok" if b_ok else "bad")], VALUES)
    c = scoring.contributions(v, cfg, "missing_feature")
    return c, scoring.rolled(c, "features").collect()[0]


def test_weighted_rollup(spark):
    assert dims(spark, True, 1, 0.5)[1].score == pytest.approx(-0.2)
    r = dims(spark, False, 2, 0.5)[1]
    assert (r.valid_count, r.coverage_ratio, r.reason, r.score) == (1, pytest.approx(0.6), "below_min_valid_features", None)
    assert dims(spark, False, 1, 0.75)[1].reason == "below_min_coverage_ratio"
    c, r = dims(spark, False, 1, 0.5)
    assert r.score == 1.0 and {x.input_id: x.normalized_weight for x in c.collect()} == {"a": 1.0, "b": 0.0}
    assert scoring.rollup_health(c).collect()[0].invalid == "b"


def test_polarities(spark):
    x = spark.createDataFrame([(2.0, -2.0, 0.5, None)], "a double, b double, c double, n double")
    p = lambda k, c: scoring.polarity(F.lit(k), F.col(c)).alias(f"{k}_{c}")
    r = x.select(p("positive", "a"), p("negative", "a"), p("positive_only", "b"), p("negative_only", "b"), p("penalize_positive_only", "a"), p("penalize_negative_only", "b"), p("reward_near_zero", "c"), p("positive_only", "n")).collect()[0]
    assert list(r) == [2.0, -2.0, 0.0, 2.0, -2.0, -2.0, -0.5, None]


def test_softmax_and_confidence(spark):
    s = spark.createDataFrame([("g", M(0), -0.2, True, 1.0), ("i", M(0), 0.5, True, 1.0), ("z", M(0), None, False, 0.0)], "output_id string, date date, score double, valid boolean, coverage_ratio double")
    p = scoring.probabilities(s, {"g": 1, "i": 2, "z": 3})
    got = {r.output_id: (r.probability, r.rank) for r in p.collect()}
    assert got["g"] == (pytest.approx(0.3318, abs=1e-4), 2) and got["i"] == (pytest.approx(0.6682, abs=1e-4), 1) and got["z"] == (None, None)
    h = scoring.state_health(p).collect()[0]
    assert h.dominant == "i" and h.valid_count == 2 and 0 < h.confidence < 0.2
    hot = scoring.probabilities(s, {"g": 1, "i": 2, "z": 3}, 0.5)
    assert max(r.probability or 0 for r in hot.collect()) > 0.6682


@pytest.mark.parametrize(
    ("rows", "months", "below", "want"),
    [
        ([("G", 0.30), ("T", 0.019)], 1, None, ["initial_state", "held_below_min_confidence"]),
        ([("G", 0.30), ("T", 0.020)], 1, None, ["initial_state", "switch_confirmed"]),
        ([("G", 0.30), ("T", 0.10), ("T", 0.10)], 2, 0.15, ["initial_state", "awaiting_confirmation", "switch_confirmed"]),
        ([("G", 0.30), ("R", 0.83)], 2, 0.15, ["initial_state", "switch_confirmed"]),
        ([("G", 0.3), ("T", 0.10), ("G", 0.12), ("T", 0.10)], 2, 0.15, ["initial_state", "awaiting_confirmation", "raw_signal_confirmed", "awaiting_confirmation"]),
        ([("G", 0.3), ("T", 0.10), (None, None), ("T", 0.10)], 2, 0.15, ["initial_state", "awaiting_confirmation", "invalid", "switch_confirmed"]),
    ],
)
def test_transition_filter(spark, rows, months, below, want):
    t = spark.createDataFrame([(M(k), s is not None, s, c) for k, (s, c) in enumerate(rows)], "date date, valid boolean, raw_state string, confidence double")
    assert [r.filter_reason for r in state.held_states(t, 0.02, months, below).orderBy("date").collect()] == want


def test_summary_and_runs(spark):
    t = spark.createDataFrame([(M(0), True, "g", 0.6, 0.30), (M(1), True, "g", 0.55, 0.20), (M(2), True, "r", 0.58, 0.26), (M(3), False, None, None, None)], "date date, valid boolean, reported_state string, reported_probability double, confidence double")
    r = state.summary(t).collect()[0]
    assert (r.valid_count, r.invalid_count, r.switch_count, r.avg_run, r.low_confidence_count) == (3, 1, 1, 1.5, 1)
    assert r.avg_confidence == pytest.approx((0.30 + 0.20 + 0.26) / 3)
    x = state.transitions(t).collect()
    assert [(y.transition_date, y.from_state, y.from_probability) for y in x] == [(M(2), "g", 0.55)]


def test_auroc_thresholds_and_lead(spark):
    f = lambda rows: ranking.auroc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").collect()[0].auroc
    assert f([(0.9, True), (0.8, True), (0.2, False)]) == 1.0
    assert f([(0.5, True), (0.5, False)]) == 0.5
    assert f([(0.5, True)]) is None
    m = spark.createDataFrame([(D(2020, 1, 1), 0.30), (D(2020, 2, 1), 0.9)], "month date, probability double")
    w = spark.createDataFrame([(D(2020, 2, 1), D(2020, 4, 1)), (D(2030, 1, 1), D(2030, 2, 1))], "start date, end date")
    assert [r.lead_lag_months for r in ranking.lead_lag(m, w, 0.25, 6).orderBy("start").collect()] == [-1, None]


def test_forward_returns(spark):
    p = [("XLE", M(k), v) for k, v in enumerate([100.0, 110.0, 121.0, 130.0, 143.0])] + [("SPY", M(k), v) for k, v in enumerate([100.0, 105.0, 110.0, 115.0, 120.0])]
    s = spark.createDataFrame([("energy", "XLE", M(0)), ("utilities", "XLU", M(0)), ("none", None, M(0)), ("old", "XLE", D(1990, 1, 1))], "entity_id string, ticker string, score_date date")
    r = {x.entity_id: x for x in asof.forward_returns(s, spark.createDataFrame(p, "ticker string, date date, close double"), "SPY").collect()}
    assert (r["energy"].forward_1m_return, r["energy"].relative_forward_1m_return) == (pytest.approx(0.10), pytest.approx(0.05))
    assert (r["energy"].forward_3m_return, r["energy"].relative_forward_3m_return) == (pytest.approx(0.30), pytest.approx(0.15))
    assert (r["utilities"].reason, r["none"].reason, r["old"].reason) == ("missing_forward_prices", "missing_proxy_ticker", "missing_forward_prices")


def test_spearman_constant_side_is_null(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, None)], "g string, x double, y double")
    assert {r.g: r.ic for r in ranking.spearman(d, ["g"], "x", "y").collect()} == {"a": 1.0, "b": None}


def test_decay_and_caps(spark):
    r = spark.range(1).select(*[events.decay(F.lit(a), 7.0, 21.0).alias(f"d{a}") for a in (0, 7, 22)], events.clip(F.lit(float("nan")), 1.0).alias("n"), events.clip(F.lit(-9.0), 1.0).alias("c")).collect()[0]
    assert list(r) == [1.0, 0.5, 0.0, 0.0, -1.0]
    item = lambda i, s: (i, "k", 1, s, D(2026, 1, 1), 1.0, 1.0, 1.0)
    f = spark.createDataFrame([item(i, s) for i, s in ((1, "a"), (2, "a"), (3, "b"), (4, "b"))], "news_id long, key string, event_id long, source string, day date, raw double, severity double, confidence double")
    c = events.components(f, 7.0, 21, 0.2)
    assert events.daily(c, 0.3).collect()[0].adjusted_score == pytest.approx(0.6)
    assert events.daily(c, 0.3, 0.5).collect()[0].adjusted_score == pytest.approx(0.5)


def test_combined(spark):
    m = spark.createDataFrame([("energy", D(2026, 1, 1), 0.30), ("real_estate", D(2026, 1, 1), -0.20)], "key string, date date, score double")
    n = spark.createDataFrame([(D(2026, 1, 5), "energy", 0.4, 1, 0.8), (D(2026, 1, 5), "real_estate", -0.4, 1, 0.7)], "score_date date, key string, adjusted_score double, item_count int, avg_confidence double")
    r = {x.key: x for x in events.combined(m, n).collect()}
    assert (r["energy"].combined_score, r["energy"].rank) == (pytest.approx(0.84), 1)
    assert r["real_estate"].combined_score == pytest.approx(-0.865)


def test_leader_clusters_match_greedy_loop(spark):
    import random

    rnd = random.Random(3)
    base = [[f"w{rnd.randint(0, 200)}" for _ in range(14)] for _ in range(12)]
    docs = []
    for i in range(120):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(14)] = f"w{rnd.randint(0, 400)}"
        docs.append((i, t))
    docs += [(200, []), (201, []), (202, docs[7][1]), (203, docs[7][1])]
    sets = {i: set(t) for i, t in docs}
    lead, want = [], {}
    for i in sorted(sets):
        hit = next((j for j in lead if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6), None)
        want[i] = i if hit is None else hit
        if hit is None:
            lead.append(i)
    d = spark.createDataFrame(docs, "id long, toks array<string>").withColumn("toks", F.array_distinct("toks"))
    assert {r.id: r.event_id for r in text.leaders(*text.similar_classes(d, 0.6)).collect()} == want


def template_sets(n, names=3):
    """Sets of sentences in common words, each with rare names; every tenth is an earlier one with a few words changed, some of those without any of its names."""
    rnd, said = random.Random(7), [[f"s{k}w{j}" for j in range(9)] for k in range(40)]
    docs = []
    for i in range(n):
        if i % 10 == 9:
            old = rnd.choice(docs)
            kept = [t for t in old if not t.startswith("n")] if i % 20 == 9 else old[:-2]
            docs.append(list(dict.fromkeys([*kept, *(f"n{rnd.randrange(4 * n)}" for _ in range(2))])))
        else:
            docs.append([t for k in rnd.sample(range(40), 8) for t in said[k]] + list({f"n{rnd.randrange(4 * n)}" for _ in range(names)}))
    return docs


def alike(docs):
    return {(i, j) for j in range(len(docs)) for i in range(j) if len(x := {*docs[i]} & {*docs[j]}) / (len(docs[i]) + len(docs[j]) - len(x)) >= 0.6}


def test_similar_classes_with_and_without_a_rare_word_in_common(spark):
    docs = template_sets(300)
    d = spark.createDataFrame(list(enumerate(docs)), "id long, toks array<string>")
    want = alike(docs)
    assert any(not {t for t in docs[i] if t[0] == "n"} & {*docs[j]} for i, j in want)
    for hot in (None, 5, 1):
        assert {(r.a, r.b) for r in text.similar_classes(d, 0.6, hot)[0].collect()} == want


def test_candidates_of_common_words_stay_few(spark):
    docs = template_sets(1500)
    d = spark.createDataFrame(list(enumerate(docs)), "id long, toks array<string>")
    got = {(r.a, r.b) for r in text.candidates(d, 0.6, 30).collect()}
    want = {(r.a, r.b) for r in text.similar_classes(d, 0.6, 30)[0].collect()}
    assert want <= got and len(got) < 4 * len(want) + 100 < 0.01 * len(docs) ** 2


def block_of(n, seed, slack):
    """A block of random sets of 70 to 90 common tokens, differing in the last four words only; every tenth is another with two bits turned."""
    import numpy as np

    rnd = np.random.default_rng(seed)
    r = np.zeros(n, text.KIND)
    r["id"], r["h"], r["slack"] = np.arange(n) + seed * n, rnd.integers(70, 91, n), rnd.uniform(*slack, n)
    r["w"][:, 2:] = rnd.integers(0, 2**63, (n, text.WORDS - 2), dtype=np.uint64)
    r["w"][9::10] = r["w"][: len(r[9::10])]
    r["w"][9::10, 2] ^= np.uint64(5)
    r["h"][9::10] = r["h"][: len(r[9::10])] + 1
    return r


@pytest.mark.parametrize("slack", [(-4, 9), (-20, 40), (30, 80)])
def test_blocks_compared_as_pair_by_pair(slack):
    import numpy as np

    blocks = block_of(700, 0, slack), block_of(2300, 1, slack)
    blocks[1]["w"][:700], blocks[1]["h"][:700] = blocks[0]["w"], blocks[0]["h"]
    for x, y in (blocks, blocks[:1] * 2):
        turned = np.bitwise_count(x["w"][:, None] ^ y["w"][None]).astype(int).sum(axis=2)
        most = x["slack"][:, None] + y["slack"][None] + 1e-6
        fits = (turned <= most) & (np.abs(x["h"][:, None] - y["h"][None]) <= most) & (x["id"][:, None] != y["id"][None])
        want = {(min(a, b), max(a, b)) for a, b in zip(x["id"][np.nonzero(fits)[0]].tolist(), y["id"][np.nonzero(fits)[1]].tolist())}
        got = text._compare(x.tobytes(), y.tobytes())
        assert want and set(zip(got.a.tolist(), got.b.tolist())) == want


def test_long_sets_that_share_a_rare_word_are_told_apart_by_their_bits(spark):
    rnd = random.Random(5)
    docs = [[f"c{k}" for k in rnd.sample(range(1500), 480)] + [f"r{i % 40}"] for i in range(240)]
    docs += [[*docs[k][60:], *(f"d{k}x{j}" for j in range(40))] for k in range(20)]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, toks array<string>")
    want = alike(docs)
    got = {(r.a, r.b) for r in text.candidates(d, 0.6, 20).collect()}
    assert len(want) >= 20 and want <= got and len(got) < len(want) + 20
    assert {(r.a, r.b) for r in text.similar_classes(d, 0.6, 20)[0].collect()} == want


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_sets_meet_at_keys_as_pair_by_pair(threshold):
    import numpy as np

    rnd = np.random.default_rng(4)
    x, share = block_of(500, 3, (0, 9)), (1 - threshold) / (1 + threshold)
    size, w = rnd.integers(20, 300, len(x)), np.zeros((len(x), 7), np.uint64)
    size[9::10], w[:, 1:] = size[: len(size[9::10])], x["w"]
    t = [(k, i) for i in range(len(x)) for k in (7, 8 + i % 10 // 9, 1000 + i // 3)]
    # a key of all, one of the copies, one of the others, and keys of three
    keys, at = np.array([k for k, _ in t]), np.array([i for _, i in t])
    mix = rnd.permutation(len(t))
    keys, at = keys[mix], at[mix]
    a, b = text._meet(keys, x["id"][at], size[at].astype(np.int32), w[at].T, threshold, share)
    ok = (np.bitwise_count(w[:, None] ^ w[None]).astype(int).sum(axis=2) <= (size[:, None] + size[None]) * share + 1e-6) & (size[:, None] >= threshold * size[None] - 1e-9) & (size[None] >= threshold * size[:, None] - 1e-9)
    want = [(int(x["id"][i]), int(x["id"][j])) for i, j in zip(*np.nonzero(ok)) if i < j]
    assert want and sorted(zip(a.tolist(), b.tolist())) == want
    none = text._meet(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty((7, 0), np.uint64), threshold, share)
    assert [len(v) for v in none] == [0, 0]


def test_blocks_take_the_time_of_a_few_plain_passes():
    import time

    import numpy as np

    x = block_of(6000, 2, (0, 6))
    w, began = x["w"][:, 2].copy(), time.thread_time()
    for g in range(0, len(w), 16):
        np.bitwise_count(w[g : g + 16, None] ^ w[None])
    plain, began = time.thread_time() - began, time.thread_time()
    assert len(text._compare(x.tobytes(), x.tobytes()))
    assert time.thread_time() - began < 12 * plain


def test_prioritised_ranks_a_pool_that_is_written(spark, monkeypatch):
    # a range sort evaluates its input twice
    seen, real = [], text.running
    monkeypatch.setattr(text, "running", lambda df, *a: (seen.append(hasattr(df, "_tidemark_path")), real(df, *a))[1])
    pool = spark.createDataFrame([(1, 2.0, False, ["aa"]), (2, 1.0, False, ["aa"]), (3, 1.0, True, [])], "id long, base double, bad boolean, toks array<string>")
    got = {r.id: (r.event_id, r.eligible) for r in text.prioritised(pool, 0.6, 0.4, 0.05).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (3, False)} and seen == [True]


def test_leaders_of_a_long_chain(spark):
    # each item is similar to its neighbours only, and only the least open one can be decided
    n = 54
    links = spark.createDataFrame([(k, k + 1, 0.7) for k in range(1, n)], "a long, b long, similarity double").coalesce(1)
    members = spark.createDataFrame([(k, k) for k in range(1, n + 1)], "id long, rep long").coalesce(1)
    assert {r.id: r.event_id for r in text.leaders(links, members).collect()} == {k: k if k % 2 else k - 1 for k in range(1, n + 1)}


def test_guardrail_and_repair(spark):
    i = spark.createDataFrame([(1, "e", "headwind", 0.9), (2, "e", "tailwind", 0.9), (3, "e", "headwind", 0.1), (4, "x", "headwind", 0.9), (5, "e", "neutral", 0.9)], "news_id long, sector_id string, impact_direction string, confidence double")
    t = spark.createDataFrame([(k, "t", "positive") for k in (1, 2, 3, 4, 5)], "news_id long, theme_id string, direction string")
    w = spark.createDataFrame([("t", "e", 1)], "theme_id string, sector_id string, sign int")
    assert [(r.news_id, r.expected) for r in classify.guardrail_anomalies(i, t, w, 0.6).collect()] == [(1, "tailwind")]
    r = spark.createDataFrame([(" Positive_For_Macro ",), ("MIXED",), ("bullish",), (None,)], "v string").select(classify.repaired(F.col("v"), "theme_direction").alias("r")).collect()
    assert [x.r for x in r] == ["positive", "mixed", None, None]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "k int, h string, v int")
    new = spark.createDataFrame([(2, None, 20), (9, "c", 90)], "k int, h string, v int")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"]).collect()} == {(1, "a", 1), (2, None, 20), (3, "c", 3), (9, "c", 90)}
    assert {tuple(r) for r in tables.upsert_any(old, new, ["k", "h"]).collect()} == {(1, "a", 1), (2, None, 20), (9, "c", 90)}
    assert {tuple(r) for r in tables.upsert(old, new, ["h"], null_safe=True).collect()} == {(1, "a", 1), (2, None, 20), (9, "c", 90)}
    again = tables.upsert(tables.upsert(old, new, ["k"]), new, ["k"])
    assert again.count() == 4


def test_quota_selection(spark):
    p = spark.createDataFrame([(i, "a" if i < 8 else "b", float(20 - i)) for i in range(12)], "id long, grp string, score double")
    got = {r.id for r in ranking.within_budget(p, "grp", [F.col("score").desc(), F.col("id")], {}, 5).collect()}
    assert got == {0, 1, 8, 9, 2}
