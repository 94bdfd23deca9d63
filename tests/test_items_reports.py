import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, items, reports, state
from tidemark.sources import landing, tables
from tidemark.streaming import feeds

D, T = datetime.date, datetime.datetime


def test_latest_and_discovery(spark):
    i = spark.createDataFrame([(1, T(2024, 1, 1)), (2, None), (3, T(2024, 1, 3)), (4, T(2024, 1, 2))], "news_id long, published_at timestamp")
    c = spark.createDataFrame([(10, 1, T(2024, 1, 1), "t", 0.9, "success"), (11, 1, T(2024, 1, 2), "t", 0.2, "success"), (12, 3, T(2024, 1, 2), "t", None, "success"), (13, 4, None, "t", 0.9, "error")], "classification_id long, news_id long, classified_at timestamp, secular_theme string, confidence double, classification_status string")
    assert {r.news_id for r in items.discovery_pool(i, c, 0.35).collect()} == {1, 2, 3}
    assert [r.news_id for r in items.newest(i, "published_at", 2, unknown_new=True).collect()] == [2, 3]
    assert [r.news_id for r in items.newest(i, "published_at", 2).collect()] == [3, 4]
    assert {r.news_id for r in items.unclassified(i, c).collect()} == {2}
    assert items.discovery_pool(i.limit(0), c, 0.3).count() == 0


def test_buckets_edges(spark):
    r = spark.createDataFrame([(0.0, 1.0, 0.1), (0.3, -1.0, 0.1), (0.6, 1.0, -0.1), (0.9, None, 0.1), (1.4, 1.0, 0.2)], "confidence double, expected_sign double, r double")
    got = {x.bucket: (x.n, x.hit_rate) for x in items.confidence_buckets(r, "r", [0.0, 0.3, 0.6, 0.8, 1.0]).collect()}
    assert got == {"0.0-0.3": (2, 0.5), "0.3-0.6": (1, 0.0), "0.6-0.8": (0, None), "0.8-1.0": (1, 1.0)}


def test_answers_are_repaired_or_told(spark):
    good = {"summary": " s ", "macro_themes": [{"theme_id": "a", "direction": "Uncertain", "severity": 1.7, "confidence": 0.5, "time_horizon": "near_term"}], "sector_impacts": [{"sector_id": "x", "impact_direction": "positive", "impact_score": -3, "confidence": 0.5}], "entities": [], "overall_severity": 2, "overall_confidence": 0.5, "time_horizon": "long-term"}
    rows = [json.dumps(good), "no json", json.dumps(good | {"summary": " ", "time_horizon": "soon"}), json.dumps(good | {"macro_themes": []}), json.dumps(good | {"macro_themes": [{"theme_id": "zz", "direction": "odd"}]}), None]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, j string").select("k", classify.repaired_payload(F.col("j"), ["a"], ["x"]).alias("p")).orderBy("k").collect()
    assert [list(r.p.errors) for r in got] == [[], ["not_json"], ["missing_summary", "bad_horizon"], ["no_themes"], ["unknown_theme", "bad_direction"], ["not_json"]]
    p = got[0].p.payload
    assert (p.macro_themes[0].direction, p.macro_themes[0].severity, p.sector_impacts[0].impact_direction, p.sector_impacts[0].impact_score, p.time_horizon, p.overall_severity) == ("unclear", 1.0, "tailwind", -1.0, "long_term", 1.0)


def test_asking_again_and_stopping(spark):
    def answer(text, errors):
        if text == "bad":
            raise ValueError("no")
        return "{}" if errors else "nothing"

    got = {r.news_id: (r.retry_count, r.errors) for r in classify.ask(spark.createDataFrame([(1, "a"), (2, "bad")], "news_id long, text string"), answer, lambda raw: [] if raw == "{}" else ["not_json"]).collect()}
    assert got == {1: (1, []), 2: (2, ["ValueError: no"])}
    a = spark.createDataFrame([(k, k >= 8) for k in range(40)], "k int, failed boolean")
    # 12 attempts hold 4 failures: the first share over 0.3 from the tenth on
    assert classify.stopped_at(a, "k", 0.3).count() == 12
    assert classify.stopped_at(a.where("not failed"), "k", 0.3).count() == 8


def test_replay_sees_nothing_later(spark):
    i = spark.createDataFrame([(k, T(2024, 1, k)) for k in range(1, 6)] + [(9, None)], "news_id long, published_at timestamp")
    got = items.replay(i, ["2024-01-03", "2024-01-05"], 1, 10)
    assert {(r.replay_day.day, r.news_id) for r in got.collect()} == {(3, 2), (3, 3), (5, 4), (5, 5)} and items.leaks(got).first().leaked == 0
    with pytest.raises(Exception, match="later than"):
        feeds.replayed(i.where("news_id = 5"), "2024-01-03", "published_at").collect()


def test_current_state_falls_back(spark):
    h = spark.createDataFrame([(D(2024, 1, 1), True, "a", 0.6, 0.3), (D(2024, 2, 1), True, "b", 0.5, 0.2), (D(2024, 3, 1), False, None, None, None)], "date date, valid boolean, dominant string, dominant_probability double, confidence double")
    t = "date date, valid boolean, reported_state string, reported_probability double, filter_reason string"
    last = lambda rows: reports.current_state(h, spark.createDataFrame(rows, t)).first()
    assert (last([]).reported_state, last([]).filter_reason) == ("b", "no_timeline")
    assert last([(D(2024, 2, 1), False, None, None, "invalid")]).filter_reason == "no_valid_timeline"
    assert last([(D(2024, 1, 1), True, "a", 0.6, "initial_state")]).reported_state == "a"
    assert last([(D(2024, 1, 1), True, "a", 0.6, "initial_state"), (D(2024, 2, 1), True, "a", 0.4, "held_below_min_confidence")]).reported_probability == 0.4


def test_one_step_for_batch_and_stream(spark):
    rows = [(D(2020, 1, 1), "G", 0.3), (D(2020, 2, 1), "T", 0.1), (D(2020, 3, 1), None, None), (D(2020, 4, 1), "T", 0.1), (D(2020, 5, 1), "R", 0.5), (D(2020, 6, 1), "S", 0.01), (D(2020, 7, 1), "R", 0.1)]
    held, steps = (None, None, 0), []
    for _, raw, c in rows:
        held, why = state.next_held(held, raw, c or 0.0, 0.02, 2, 0.15)
        steps.append(why)
    df = spark.createDataFrame([(d, raw is not None, raw, c) for d, raw, c in rows], "date date, valid boolean, raw_state string, confidence double")
    assert steps == [r.filter_reason for r in state.held_states(df, 0.02, 2, 0.15).orderBy("date").collect()]


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"articles": [{"title": "T", "url": "u", "domain": "d", "seendate": "20240105T010203Z"}, {"title": " ", "url": "u"}]}))
    (tmp_path / "w.json").write_text(json.dumps([{"headline": "H", "summary": "", "source": "S", "url": "u", "datetime": 1704067200}]))
    (tmp_path / "a.xml").write_text('<feed><entry><title>A</title><link href="https://x/1" rel="alternate"/><summary>S</summary><content>C</content><updated>2024-01-02T00:00:00Z</updated></entry></feed>')
    g, w, a = landing.news_archive(spark, str(tmp_path / "g.json")).collect(), landing.news_wire(spark, str(tmp_path / "w.json")).collect(), landing.news_rss(spark, str(tmp_path / "a.xml")).collect()
    assert len(g) == 1 and g[0].body == "T" and w[0].body == "H" and w[0].published_at is not None
    assert (a[0].body, a[0].source_url) == ("S", "https://x/1") and a[0].published_at is not None
    src = [{"source_id": "g", "provider": "gdelt", "path": str(tmp_path / "g.json"), "profiles": ["p"]}, {"source_id": "again", "provider": "gdelt", "path": str(tmp_path / "g.json"), "profiles": ["p"]}, {"source_id": "gone", "provider": "local_csv", "path": str(tmp_path / "none.csv"), "profiles": ["p"]}, {"source_id": "off", "provider": "finnhub", "path": str(tmp_path / "w.json")}]
    got, warnings = landing.news_sources(spark, src, "p")
    assert got.count() == 1 and [x.split(":")[0] for x in warnings] == ["gone"]
    x = [(str(r.window_start)[:10], str(r.window_end)[:10]) for r in landing.date_windows(spark, "2024-01-01", "2024-01-08", 3).collect()]
    assert x == [("2024-01-01", "2024-01-04"), ("2024-01-04", "2024-01-07"), ("2024-01-07", "2024-01-08")]
    pages = spark.createDataFrame([("u", "<html><body><p>" + "long text " * 20 + "</p></body></html>")], "source_url string, html string")
    full = landing.with_fulltext(landing.news_archive(spark, str(tmp_path / "g.json")), pages, 50, 5, 60).first()
    assert len(full.body) == 60 and full.news_id == g[0].news_id
    assert [r.title for r in landing.manual_items(spark, [{"title": "M", "body": "B"}, {"title": "M"}]).collect()] == ["M"]


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    tables.shaped(spark.createDataFrame([("A", D(2024, 1, 2), 2.0), ("A", D(2024, 1, 1), 1.0), ("B", D(2024, 1, 1), 3.0)], "ticker string, date date, close double"), "sector_proxy_prices").write.parquet(f"{root}/sector_proxy_prices")
    got = tables.read(spark, root, "sector_proxy_prices", ordered=True, ticker="A").collect()
    assert [r.close for r in got] == [1.0, 2.0] and got[0].source is None
    old = spark.createDataFrame([(1, "a", T(2024, 1, 1)), (2, "b", T(2024, 1, 5))], "k int, v string, at timestamp")
    new = spark.createDataFrame([(1, "c", T(2024, 1, 1)), (2, "d", T(2024, 1, 2))], "k int, v string, at timestamp")
    assert {(r.k, r.v) for r in tables.merge_ledger(old, new, ["k"], "at").collect()} == {(1, "c"), (2, "b")}
    assert tables.aged(old, "v", "at", "2024-01-03").first().n == 1


def test_runs(spark, tmp_path):
    for day, run, regime, guard in (("2024-01-01", "r1", "boom", "ok"), ("2024-01-02", "r2", "slump", "failed")):
        p = tmp_path / day / run
        p.mkdir(parents=True)
        (p / "daily_diagnostic_summary.json").write_text(json.dumps({"run_id": run, "run_date": day, "status": "success", "macro": {"reported_regime": regime, "confidence": 0.5}, "step_statuses": {"guardrail_status": guard}, "warnings": ["w"]}))
    index = reports.history_index(landing.run_summaries(spark, str(tmp_path))).collect()
    assert [r.run_id for r in index] == ["r2", "r1"] and index[0].warning_count == 1 and index[0].readiness_label == "insufficient_history"
    runs = landing.run_summaries(spark, str(tmp_path)).select("run_date", "run_id", F.col("macro.reported_regime").alias("regime"), F.col("step_statuses.guardrail_status").alias("guardrail"))
    assert reports.alerts(runs).first().alert == "guardrail status = failed; regime change: boom -> slump"


def test_texts(spark):
    x = spark.createDataFrame([("We should BUY; portfolio allocation",), (None,)], "t string").select(items.safe_text(F.col("t")).alias("s"), items.forbidden_terms(F.col("t")).alias("f")).collect()
    assert x[0].s == "We should market-action term; market-action term" and x[0].f == ["portfolio allocation", "buy"] and x[1].s == "" and x[1].f == []
    y = spark.createDataFrame([("^spx",), (" XLE ",), ("a.b",), ("",)], "t string").select(items.stooq_symbol(F.col("t")).alias("s")).collect()
    assert [r.s for r in y] == ["^spx", "xle.us", "a.b", ""]
    z = spark.createDataFrame([("Date,Open,Close\n1,2,3",), ("Get your apikey here",), ("<html>",), (" ",), ("none",)], "t string").select(items.price_answer(F.col("t")).alias("s")).collect()
    assert [r.s for r in z] == ["csv", "apikey_instruction", "html", "empty", "non_csv"]
