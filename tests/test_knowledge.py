import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators.knowledge import as_known

D = datetime.date
EV, AT = "event_id long, entity string, day date", "attr_id long, entity string, known date, until date, k1 date, k2 int"


def run(spark, events, attrs, seg=92):
    a = spark.createDataFrame(attrs, AT).select("attr_id", "entity", "known", "until", F.struct("k1", "k2").alias("key"))
    return {(r.event_id, r.attr_id) for r in as_known(spark.createDataFrame(events, EV), a, seg).collect()}


def brute(events, attrs):
    low = lambda x: (x is not None, x or (D(1, 1, 1) if x is None else x))
    out = set()
    for e, ent, day in events:
        if ent is None or day is None:
            continue
        ok = [a for a in attrs if a[1] == ent and a[2] is not None and a[2] <= day and (a[3] is None or a[3] >= day)]
        if ok:
            out.add((e, max(ok, key=lambda a: (a[4] or D(1, 1, 1), -(10**9) if a[5] is None else a[5], a[0]))[0]))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    day = lambda: D(2020, 1, 1) + datetime.timedelta(rnd.randint(0, 900))
    attrs = []
    for i in range(600):
        known = day() if rnd.random() > 0.03 else None
        until = None if rnd.random() < 0.4 else (known or day()) + datetime.timedelta(rnd.choice([-5, 0, 3, 40, 200, 500]))
        attrs.append((i, rnd.choice(["a", "a", "a", "b", None]), known, until, day() if rnd.random() > 0.05 else None, rnd.choice([None, 1, 2, 3])))
    events = [(i, rnd.choice(["a", "b", "c", None]), day() if rnd.random() > 0.03 else None) for i in range(300)]
    want = brute(events, attrs)
    assert len(want) > 150
    assert run(spark, events, attrs) == want
    assert run(spark, events, attrs, 7) == want


def test_ties_repeats_empty(spark):
    d = D(2024, 5, 1)
    assert run(spark, [(1, "a", d), (1, "a", d)], [(5, "a", d, None, d, 1), (6, "a", d, d, d, 1)]) == {(1, 6)}
    assert run(spark, [], [(5, "a", d, None, d, 1)]) == set()
    assert run(spark, [(1, "a", d)], []) == set()
