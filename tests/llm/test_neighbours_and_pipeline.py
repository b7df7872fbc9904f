import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from xylem.llm import neighbours, toxicity
from xylem.llm.common import written

SF = "/root/testdata/sf0.01"


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = (x * np.array(v, float)).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_hilbert_order_is_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = neighbours.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("range_rows", [8192, 60])
def test_neighbours(spark, monkeypatch, range_rows):
    monkeypatch.setattr(neighbours, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(80)]  # a crowd of equal vectors
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, score double")
    want, got = brute(rows, 20, 20), {}
    for r in neighbours.neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want)
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found)
    hits = sum(len(set(dict(want[q])) & set(dict(got[q]))) for q in want)
    assert hits / (20 * len(want)) >= (1 if range_rows == 8192 else 0.9)


@pytest.mark.parametrize("range_rows", [8192, 40])
def test_repeated_rows_and_ids(spark, monkeypatch, range_rows):
    """Repeated rows crowd nobody out; an id on several vectors counts once, by its best product."""
    monkeypatch.setattr(neighbours, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(neighbours, "WANTED", 1.0)
    rng = np.random.default_rng(8)
    vector = lambda: rng.standard_normal(4).round(2).tolist()
    rows = [(i, vector()) for i in range(1, 38)] + [(100, [9.0, 9.0, 9.0, 9.0])] * 30 + [(i, vector()) for i in (20, 20, 40, 40, 41, 41, 41) for _ in range(2)]
    want = {}
    for q, a in rows:
        if q % 20 == 0:
            for i, b in rows:
                if i != q:
                    score = (np.array(b) * np.array(a)).sum()
                    want.setdefault(q, {})[i] = max(score, want.get(q, {}).get(i, -np.inf))
    got = {}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for r in neighbours.neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: sorted(x.items(), key=lambda y: (-y[1], y[0]))[:20] for q, x in want.items()} == got


def test_recall_on_embeddings(spark):
    """All queries of a table of several ranges, against brute force."""
    sf = SF.replace("0.01", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows, 20, 20), {}
    for r in neighbours.op5(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(set(dict(w)) & got[q]) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.neighbours(spark.createDataFrame([], schema)).collect() == []
    got = neighbours.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 0.5)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    counts = [docs.count()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if name == "toxicity":
            model = toxicity.ToxicityModel(before, labels)
            keep = {r.doc_id for r in model.score(before, keep=["doc_id"]).where(F.col("score") < 0.3).collect()}
            assert {r.doc_id for r in docs.collect()} == keep
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
