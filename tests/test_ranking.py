"""Top k by packed queries against the relational scores and plain Python."""

import random

import pytest

from pliego.operators import ranking as rk
from pliego.operators import search as se
from pliego.plans import queries as core
from test_oracle import DATA

WORDS = ["contrato", "trato", "renta", "Ítem", "x1", "año", "arrenda", "mora", "plazo", "penal", "fianza", "a-b"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(rng, n):
    return [" ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.choice([0, 1, 3, 20]))).lower() for _ in range(n)]


@pytest.mark.parametrize("per_block,dense", [(10_000, 0.3), (4, 2)])
def test_bm25_top(spark, monkeypatch, per_block, dense):
    monkeypatch.setattr(rk, "QUERIES_PER_BLOCK", per_block)
    monkeypatch.setattr(rk, "DENSE", dense)
    monkeypatch.setattr(rk, "SLICE", 7)
    rng = random.Random(2)
    rows = [(i, t.split()) for i, t in enumerate(texts(rng, 90))] + [(3, ["mora"]), (4, ["mora", "renta"]), (None, ["mora"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    queries = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts(rng, 11))] + [(50, ["nada"]), (None, ["mora"])], "query_id long, terms array<string>")
    got = sorted(tuple(r) for r in rk.bm25_top(docs, queries, "doc_id", 5).where("doc_id is not null").collect())
    want = sorted(tuple(r) for r in se.top_k(se.bm25(docs, queries.where("query_id is not null"), "doc_id"), 5, "query_id", "doc_id").select("query_id", "doc_id", "score", "rank").where("doc_id is not null").collect())
    assert got == want and len({r[0] for r in got}) > 5


def test_hybrid_makes_no_pairs(spark):
    """The postings of texts against whole texts as queries were a join as large as both multiplied."""
    plan = plan_of(core.hybrid_topk(spark, DATA))
    assert "explode(tokens" not in plan and "MapInArrow" in plan


def test_substring_top(spark, monkeypatch):
    monkeypatch.setattr(rk, "QUERIES_PER_BLOCK", 4)
    rng = random.Random(3)
    rows = list(enumerate(texts(rng, 60))) + [(60, "Pre-Arrenda-b."), (61, None), (None, "mora")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = {i: [rng.choice(["trat", "mora", "a", "ño", "x", "a-b", "re-a", "nta"]) for _ in range(rng.choice([0, 1, 3, 7]))] for i in range(12)}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    want = set()
    for q, terms in asked.items():
        scored = sorted(((-round(sum(x in t.lower() for x in terms) / len(terms), 6), i) for i, t in rows if t is not None and i is not None), key=lambda p: p) if terms else []
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(scored[:5], 1) if s < 0}
    got = {tuple(r) for r in rk.substring_top(docs.where("doc_id is not null"), queries, "doc_id", "text", 5).collect()}
    assert got == want
    everything = rk.substring_top(docs, queries, "doc_id", "text", 99)
    assert everything.where("doc_id is null").count() > 0


def test_keyword_makes_no_pairs(spark):
    """The terms found in texts were joined to every query that has them."""
    plan = plan_of(core.keyword_substring_topk(spark, DATA))
    assert "Join" not in plan and "MapInArrow" in plan
