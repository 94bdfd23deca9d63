import random
import re

import numpy as np

from tidemark.llm.neardup import Plan, Shingler, classes, expanded, near_duplicates, permutations, signatures

PLAN = Plan(words=3, similarity=0.5, least_words=8, bands=48, rows=4)


def shingles(t, n=3):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= 8 else set()


def corpus(seed=4):
    rnd = random.Random(seed)
    docs = []
    for f in range(40):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(60)]
        for _ in range(rnd.randint(1, 5)):
            t = list(base)
            for _ in range(rnd.randint(0, 6)):
                t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 9999)}"
            docs.append((len(docs), " ".join(t)))
    return docs


def brute(docs):
    s = {i: shingles(t or "") for i, t in docs}
    return {(a, b) for a in s for b in s if a < b and s[a] and s[b] and 2 * len(s[a] & s[b]) >= len(s[a] | s[b])}


def test_pairs_against_brute_force(spark):
    docs = corpus() + [(900, None), (901, ""), (902, "too short"), (903, "A, b! c d e f g h i"), (904, "a b c D e F g h i")]
    g = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in docs], "id long, text string, rep string"), PLAN)
    got = {tuple(r) for r in expanded(g).collect()}
    want = brute(docs)
    assert got <= want and len(got) >= 0.99 * len(want) and (903, 904) in got


def test_hot_group_of_copies_is_one_class(spark):
    docs = corpus(9)
    hot = "one text that a third of all the records carry again and again in the feed"
    docs += [(5000 + i, hot + ("" if i % 2 else " ")) for i in range(150)] + [(6000, hot + " twice")]
    g = near_duplicates(spark.createDataFrame(docs, "id long, text string"), PLAN)
    c = {r.id: (r.rep, r.n_links) for r in classes(g).collect()}
    assert {c[5000 + i][0] for i in range(150)} == {5000} and c[5000][1] == 1 and c[6000] == (6000, 1)
    assert {(r.a, r.b) for r in g.links.collect()} >= {(5000, 6000)}


def test_large_bucket_in_blocks(spark):
    # many different texts that share most of their words land in the same buckets
    rnd = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(90):
        t = list(base)
        t[rnd.randrange(120)] = f"u{i}"
        docs.append((i, " ".join(t)))
    g = near_duplicates(spark.createDataFrame(docs, "id long, text string"), PLAN)
    assert {tuple(r) for r in expanded(g).collect()} == brute(docs)


def test_signature_estimates_similarity():
    a, b = " ".join(f"t{i}" for i in range(400)), " ".join(f"t{i}" for i in range(100, 500))
    plan = Plan(words=1, bands=128, rows=4)
    s, d, _ = Shingler(1).batch([a, b], 0)
    _, sig = signatures(s, d, plan, permutations(plan))
    assert abs(float(np.mean(sig[0] == sig[1])) - 300 / 500) < 0.1


def test_empty(spark):
    g = near_duplicates(spark.createDataFrame([], "id long, text string"), PLAN)
    assert g.links.collect() == [] and classes(g).collect() == [] and expanded(g).collect() == []
