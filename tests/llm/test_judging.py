"""Quality rules, toxicity and URL rules."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.llm import quality, redirects, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n ", "a", "a b", "a b c a b c a b c", "x y z\nx y z\n\nx y z", "w " * 60, "é ñ ß 1 2 3\t#|<> AB!", " ".join(f"w{i % 50}" for i in range(400))]


def brute(text):
    text = text or ""
    words, places = WORD.findall(text), {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for own in places.values() if len(own) > 1 for i in own for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "id long, text string, extra string")
    found = quality.text_statistics(rows).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r["id"]: tuple(r[c] for c in columns) for r in found} == {i: brute(t) for i, t in enumerate(TEXTS)}


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose, symbol junk and shouting; a quarter of the rows has no label."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        bad = i % 5 == 0
        if bad:
            words = [w + "#" for w in words] if i % 10 else [w.upper() for w in words]
        rows.append((i, " ".join(words), "src", i))
        if i % 4:
            labels.append((i, 0 if bad else 1))
    rows += [(None, "too short", "src", 0), (7, None, "src", 0)]
    labels += [(3, 1), (3, None), (None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_are_learned_and_applied(labelled):
    docs, labels = labelled
    found = quality.judged(docs, labels)
    by_id = {r["id"]: r for r in found.collect() if r["id"] != 7}
    assert all(by_id[i]["kept"] == (i % 5 != 0) for i in range(400) if i != 7)
    assert not by_id[None]["kept"] and found.count() == 402
    left = quality.drop_rejected(docs, labels)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in range(400) if i % 5}


def test_without_labels_the_base_rules_decide(spark, labelled):
    docs, labels = labelled
    none = labels.where("false")
    assert quality.judged(docs, none).where("kept = base_failed").count() == 0
    assert quality.judged(docs.where("false"), labels).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = quality.op9_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_risk_turns_back_when_it_falls_below_zero():
    margin, positive = np.array([4.0, 4.0, -9.0, -9.0]), np.array([True, True, False, False])
    back = toxicity.risk_step(margin, positive, 0.5)
    assert (back[positive] > 0).all() and (back[~positive] < 0).all()
    usual = toxicity.risk_step(np.array([-1.0, -1.0, 1.0, 1.0]), positive, 0.5)
    assert (usual[positive] < 0).all() and (usual[~positive] > 0).all()


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    scored = toxicity.op2_pu_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit / max(1, sum(r["predicted"] for r in rows)) > 0.9 and hit / sum(r["toxic"] for r in rows) > 0.6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_toxicity_learns_from_few_rows_and_handles_odd_ones(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choices("the a of house river green walks slowly".split(), k=20))
    rows = [(i, prose() + (" vile brute" if i % 4 == 0 else ""), "clash") for i in range(300)]
    rows += [(None, None, "x"), (1000, "", "x"), (1000, "vile brute", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_positive=40, max_unlabelled=120, shards=2)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) and max(model.weights, key=model.weights.get)[:3] in ("vil", "bru")
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in found if r["doc_id"] is not None and r["doc_id"] < 300)
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(docs.where("false"), model).count() == 0


PAGES = [
    (0, "http://a.example.org/x", '<link rel="canonical" href="http://b.net/es/1">'), (1, "http://c.org/y", "<LINK href=/z rel=canonical>"),
    (2, "http://c.org/z", '<meta http-equiv="refresh" content="0; url=http://a.example.org/x">'), (3, "https://d.org/p", '<link rel="canonical" href="https://q.com/ok">'),
    (4, "https://e.org/p", '<link rel=canonical href="//D.org/p#x"><link rel=canonical href="http://b.net/fr/2">'), (5, None, "<link rel=canonical href=x>"),
    (6, "nothing", None), (7, "http://c.org/y?a=1&b", '<link rel="canonical" href="?a=2&amp;b">'), (8, "http://c.org/y?a=2&b", '<link rel="canonical" href="w">'),
    (9, "HTTP://C.ORG/w", "x"), (9, "HTTP://C.ORG/w#f", "<meta http-equiv=refresh content=\"5;URL='http://b.net/es/'\">"), (10, "http://net/es/", ""),
    (11, "http://WWW.example.com/en/", ""), (12, "http://m.example.com/en/?x", ""), (13, "http://x.com", ""), (14, "a://b://c/d", ""), (None, "http://c.org/w", ""),
]


def test_aliases_share_verdicts(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, host string")
    found = redirects.judge_urls(pages)
    rows = sorted(map(tuple, found.collect()), key=str)
    connection = duckdb.connect()
    connection.register("pages", pages.drop("host").toPandas().astype({"page_id": "Int64"}))
    assert rows == sorted(connection.execute(redirects.SQL).fetchall(), key=str)
    verdict = {(r[0], r[2]): r[4] for r in rows}
    assert verdict[(0, "/x")] == verdict[(1, "/y")] == verdict[(2, "/z")] == verdict[(8, "/y")] == "block"
    assert verdict[(3, "/p")] == verdict[(4, "/p")] == "allow"
    assert redirects.judge_urls(pages.where("false")).count() == 0


def test_a_redirect_log_adds_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", None), (2, "http://b.org/2", None)], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://a.org/1", "http://bad.net/es/9")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in redirects.judge_urls(pages, redirects=log).collect()} == {1: "block", 2: "allow"}
