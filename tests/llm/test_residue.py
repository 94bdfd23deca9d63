import os

import pytest

from tidemark.llm import residue as R

GOOD = "Inventories held by retailers in Moboth now cover {} days of sales. Officials at Kivan Sotiris described orders as steady. The panel will publish its funding plan in March."
CASES = [
    (1, "Please enable JavaScript to view this page.", None, "notice"), (2, "Home | Markets | Economy\n\n502 Bad Gateway", "x", "notice"), (3, "404 Not Found\n\nThe requested address /a/1 was not found on this server.", None, "notice"),
    (4, GOOD.format("{{value}}"), None, "placeholder"), (5, "Dear {first_name},\n\n" + GOOD.format(40), None, "placeholder"), (6, "Text goes here. Text goes here. Replace this paragraph before publication.", None, "placeholder"),
    (7, GOOD.format(40), "t", None), (8, GOOD.format(50) + "\n\nPlease enable JavaScript to view this page.", None, None), (9, GOOD.format(50) + "\n\nPage not found errors on the portal rose 17 percent after the move, Fojolm Rebith told the committee.", None, None),
    (10, None, None, None), (11, "", None, None), (12, " \n\t ", None, None), (13, "In our template guide, the field {{ series_title }} is replaced by the name of the series.\n\n" + GOOD.format(3), None, None),
    (14, (GOOD.format(9) + "\n") * 3000 + "By {{author}}", None, "placeholder"),
]
AT = "/root/testdata/sf0.1/documents.parquet"


@pytest.fixture(scope="module")
def fitted(spark):
    if not os.path.exists(AT):
        pytest.skip("no test corpus")
    return R.fit(spark.read.parquet(AT))


def test_unseen_hosts(fitted):
    report = fitted[1]
    assert report["held_docs"] > 50
    assert min(report["sentence_precision"], report["sentence_recall"], report["line_precision"], report["line_recall"]) >= 0.9


def test_unseen_families(spark):
    """Fields of shapes that no training document had are found by what surrounds and makes them up."""
    report = R.fit(spark.read.parquet(AT), unseen=R.UNSEEN)[1]
    assert report["unseen_docs"] > 20 and report["unseen_recall"] >= 0.8 and report["unseen_precision"] >= 0.9, report


def test_long_sentences_are_judged_whole():
    words = " ".join(f"word{i}" for i in range(400))
    assert "".join(t for _, toks in R.pieces(words) for t in toks).count("word399") <= 2
    assert {t for _, toks in R.pieces(words) for t in toks} == set(R.TOKEN.findall(words))


def test_cases(spark, fitted):
    d = spark.createDataFrame([(i, t, ti, "s") for i, t, ti, _ in CASES], "doc_id long, text string, title string, kind string")
    assert {r.doc_id: r.kind for r in R.residue(d, fitted[0]).collect()} == {i: k for i, _, _, k in CASES if k}


def test_empty_tables(spark, fitted):
    none = spark.createDataFrame([], "doc_id long, text string, title string, source string")
    assert R.residue(none, fitted[0]).collect() == []
    det, report = R.fit(none)
    assert R.residue(spark.createDataFrame([(1, "Just a text.", None)], "doc_id long, text string, title string"), det).collect() == [] and report["fit_docs"] == 0
