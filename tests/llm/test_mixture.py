import random

from tidemark.llm.mixture import mix

DOCS, TARGETS = "doc_id long, source string, n_tokens long", "source string, target_share double, max_repeats int"


def test_shares_repeats_and_budget(spark):
    rnd = random.Random(1)
    docs = [(i, rnd.choice(["a"] * 6 + ["b", "c", "x", None]), rnd.randint(1, 60)) for i in range(3000)] + [(9000, "a", 0), (9001, "b", 5)]
    targets = [("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.1, 2)]
    draws, shares = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    s = {r.source: r for r in shares.collect()}
    tokens = {k: sum(n for _, x, n in docs if x == k) for k in "abc"}
    budget = min(tokens["a"] / (4 / 9), 3 * tokens["b"] / (3 / 9), 2 * tokens["c"] / (2 / 9))
    assert all(abs(s[k].actual_share - w / 0.9) < 0.01 for k, w in (("a", 0.4), ("b", 0.3), ("c", 0.2)))
    assert s["gone"].drawn_docs == 0 and budget * 0.98 < sum(r.drawn_tokens for r in s.values()) <= budget
    d = draws.collect()
    assert len({r.doc_id for r in d}) == len(d) and {r.source for r in d} == {"a", "b", "c"}
    assert all(1 <= r.repeats <= dict((k, m) for k, _, m in targets)[r.source] for r in d)
    # no document a second time before all of its source once
    for k in "abc":
        reps = [r.repeats for r in d if r.source == k]
        if max(reps) > 1:
            assert len(reps) == sum(1 for _, x, n in docs if x == k and n) and max(reps) - min(reps) <= 1


def test_larger_budget_runs_sources_out(spark):
    docs = [(i, "a" if i % 4 else "b", 10) for i in range(200)]
    _, shares = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS), budget=10**9)
    assert {r.source: r.drawn_tokens for r in shares.collect()} == {"a": 1500, "b": 1000}


def test_same_draw_again_and_empty(spark):
    docs = spark.createDataFrame([(i, "a", 7) for i in range(50)], DOCS)
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    one, two = (sorted(r.doc_id for r in mix(docs, t, 100)[0].collect()) for _ in range(2))
    assert one == two and len(one) == 14
    draws, shares = mix(spark.createDataFrame([], DOCS), t)
    assert draws.collect() == [] and shares.collect()[0].drawn_tokens == 0
