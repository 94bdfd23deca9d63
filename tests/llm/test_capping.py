import os
import random
from collections import defaultdict

from tidemark.llm.capping import CapState, latest_quality, load_caps

SCHEMA = "load long, contributor int, record_id long, quality double"


def kept_by_brute(rows, caps):
    g = defaultdict(list)
    for ld, c, i, q in rows:
        if c is not None and ld is not None:
            g[ld, c].append((q is None or q != q, -(q if q is not None and q == q else 0.0), i))
    return {i for k, v in g.items() for *_, i in sorted(v)[: caps[k[0]]]}


def test_any_split_into_deliveries_ends_the_same(spark):
    rnd = random.Random(1)
    # contributor 0 holds a third of all rows; qualities tie often
    rows = [(rnd.randint(1, 3), rnd.choice([0, 0, 0, 1, 2, 3, None]), i, rnd.choice([None, float("nan"), 0.1, 0.5, 0.5, 0.9])) for i in range(400)]
    caps = {1: 9, 2: 1, 3: 4}
    cdf = spark.createDataFrame(list(caps.items()), "load long, cap long")
    want = kept_by_brute(rows, caps)
    for cuts in ([0, 400], [0, 130, 131, 400]):
        state = CapState(spark)
        for a, b in zip(cuts, cuts[1:]):
            # every delivery opens the state again
            state = CapState(spark, state.path)
            state.merge(spark.createDataFrame(rows[a:b], SCHEMA), cdf)
        kept = {r.record_id for r in state.kept().collect()}
        gone = [r.record_id for r in state.log().collect()]
        assert kept == want
        assert sorted(gone) == sorted({r[2] for r in rows if r[1] is not None} - want)
        cut = {(r.load, r.contributor): r.kept_n for r in state.cutoffs().collect()}
        assert all(n <= caps[k[0]] for k, n in cut.items())


def test_empty_and_broken_deliveries(spark):
    caps = spark.createDataFrame([(1, 2), (2, 1)], "load long, cap long")
    s = CapState(spark)
    s.merge(spark.createDataFrame([], SCHEMA), caps)
    s.merge(spark.createDataFrame([(1, 1, 5, 0.5)], SCHEMA), caps)
    s.merge(spark.createDataFrame([], SCHEMA), caps)
    assert [r.record_id for r in s.kept().collect()] == [5] and s.log().count() == 0
    # a delivery that never came to its end is not read, and is given again
    s.merge(spark.createDataFrame([(1, 1, 6, 0.9), (1, 1, 7, 0.7), (2, 1, 8, 0.1)], SCHEMA), caps)
    os.rmdir(f"{s.path}/done/00000003")
    again = CapState(spark, s.path)
    assert {r.record_id for r in again.kept().collect()} == {5}
    again.merge(spark.createDataFrame([(1, 1, 6, 0.9), (1, 1, 7, 0.7), (2, 1, 8, 0.1)], SCHEMA), caps)
    assert {r.record_id for r in again.kept().collect()} == {6, 7, 8} and [r.record_id for r in again.log().collect()] == [5]


def test_caps_and_quality(spark):
    items = spark.createDataFrame([(i, 1 if i < 60 else 2) for i in range(70)], "item_id long, batch_no long")
    assert {tuple(r) for r in load_caps(items, "batch_no", 25).collect()} == {(1, 2), (2, 1)}
    rep = spark.createDataFrame([(1, 7, 0.4, "2024-01-01"), (2, 7, 1.4, "2024-01-03"), (3, 7, 0.6, "2024-01-02"), (4, 7, 0.2, "2024-01-02"), (5, None, 0.5, "2024-01-02"), (6, 8, float("nan"), "2024-01-02"), (7, 8, None, "2024-01-02")], "report_row_id long, top_news_id long, avg_confidence double, generated_at string")
    assert [tuple(r) for r in latest_quality(rep).collect()] == [(7, 0.2)]
