import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest
import sentencepiece as library
import tiktoken

from xylem.llm import fingerprints, mixing, sentencepiece, suffix_dedup, token_counts


def test_length_histogram_is_brute_force(documents, no_documents):
    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = np.array([len(enc.encode_ordinary(r.text or "")) for r in documents.select("text").collect()])
    h = token_counts.length_histogram(token_counts.token_lengths(documents))
    rows = h.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n.tolist()))
    for r in rows:
        k = r.n_tokens
        assert (r.n_docs, r.docs_upto, r.docs_over) == ((n == k).sum(), (n <= k).sum(), (n > k).sum())
        assert (r.tokens_upto, r.tokens_over, r.truncated_tokens) == (n[n <= k].sum(), n[n > k].sum(), np.minimum(n, k).sum())
    for k in (0, 17, 10**6):
        r = token_counts.at_limit(h, k).first()
        assert (r.total_tokens, r.truncated_tokens, r.docs_fitting) == (n.sum(), np.minimum(n, k).sum(), (n <= k).sum())
    assert token_counts.length_histogram(token_counts.token_lengths(no_documents)).collect() == []


def test_pieces_are_the_librarys(documents, no_documents):
    sp = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    for chunk in (sentencepiece.CHUNK, 40):
        got = sentencepiece.encoded(documents, ["doc_id", "score"], chunk=chunk)
        want = sorted((str(r.doc_id), sp.encode(r.text or "")) for r in documents.collect())
        assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == want
        assert got.where("NOT round_trip").count() == 0
    assert sentencepiece.encoded(no_documents, ["doc_id"]).collect() == []
    back = sentencepiece.decoded(sentencepiece.encoded(documents, ["doc_id", "text"]).withColumnRenamed("text", "was")).collect()
    assert all((r.was or "") == r.text for r in back)


def test_max_plus_scan_over_any_cuts():
    with open(sentencepiece.MODEL, "rb") as f:
        enc = sentencepiece.Encoder(f.read())
    sp = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice(["the", "in", "a", "r", "é", "#", "\n", " ", "  ", "漢", "▁", "tion"]) for _ in range(rng.randint(1, 80)))
        chunks = [sentencepiece.Chunk(enc, *c) for c in sentencepiece.pieces_of(sentencepiece.escaped(text), enc.longest, rng.choice([2, 5, 30]))]
        states = sentencepiece.states_at_cuts([c.matrix() for c in chunks])
        assert [i for c, a, b in zip(chunks, states, states[1:]) for i in c.trace(a, b)] == sp.encode(text)


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (-(fingerprints._LOWEST_ID if r[0] is None else r[0]), r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in rows]
    for (i, _), a, b in zip(rows, texts, texts[1:] + texts[:1]):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        of = lambda x, y: (lambda p, q: len(p & q) / len(p | q) if p | q else 1.0)(set(fingerprints.digests(x)), set(fingerprints.digests(y)))
        yield str(i), len(a), hashlib.sha256(edited.encode()).hexdigest(), round(of(a, edited), 9), round(of(a, b), 9)


def test_fingerprints_are_brute_force(documents, plain, no_documents):
    for d in (documents, plain, plain.where("doc_id = 3")):
        rows = d.collect()
        got = fingerprints.fingerprints(d).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(brute_fingerprints([(r.doc_id, r.text) for r in rows]))
    assert fingerprints.fingerprints(no_documents).collect() == []


def test_equal_texts_have_equal_fingerprints(plain):
    texts = {r.doc_id: r.text or "" for r in plain.collect()}
    by = {}
    for r in fingerprints.fingerprints(plain).collect():
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by.values())) == len(by)


def test_peeling_recovers_differences():
    rng = random.Random(0)
    keys = [rng.getrandbits(64) for _ in range(900)]
    a, b = keys[:600], keys[300:]
    m, diff = fingerprints.FIRST, None
    while diff is None:
        diff = fingerprints.Sketch(a, m).differences(fingerprints.Sketch(b, m))
        m *= fingerprints.GROWTH
    assert sorted(diff) == sorted(set(a) ^ set(b))


def test_mixing_meets_targets(spark, documents, no_documents):
    rows = mixing.copies(documents).collect()
    assert len(rows) == documents.count() and all(r["__copies"] in (0, 1, 2) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r["__size"] for r in rows)
    assert abs(sum(v[0]["__target"] for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        taken = sum(r["__size"] * r["__copies"] for r in v)
        assert v[0]["__target"] <= 2 * v[0]["__source_size"] + 1e-9
        assert abs(taken - v[0]["__target"]) <= 0.5 * max(r["__size"] for r in v) + 1e-9
    assert sorted(map(str, mixing.copies(documents).collect())) == sorted(map(str, rows))
    assert mixing.mixed(documents).columns == documents.columns
    assert mixing.mixed(documents).count() == sum(r["__copies"] for r in rows)
    assert mixing.copies(no_documents).collect() == []


@pytest.mark.parametrize("few", [100_000, 0])
def test_mixing_of_repeated_rows(spark, monkeypatch, few):
    """Sources of null ids, of one row repeated and of distinct ids all meet their targets, and every row comes back."""
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(None, "w " * (i % 9 + 1) + str(i), "a", 1) for i in range(200)] + [(7, "one two three", "b", i % 2) for i in range(150)] + [(i, "w " * (i % 9 + 1), "c", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").repartition(5)
    got = mixing.copies(docs).collect()
    assert sorted((str(r.doc_id), r.text, r.source, r.other) for r in got) == sorted((str(i), *x) for i, *x in rows)
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r["__size"] * r["__copies"] for r in own) - own[0]["__target"]) <= 5 and {r["__copies"] for r in own} <= {0, 1, 2}
    assert sorted(map(str, mixing.copies(docs.repartition(3)).collect())) == sorted(map(str, got))


def test_mixing_orders_by_the_pareto_statistic(spark):
    """Longer documents are likelier, as their inclusion odds say; the hash alone would take all sizes alike."""
    rows = [(i, "w " * (4 if i % 2 else 1), "s", ) for i in range(6000)] + [(10_000 + i, "w " * 40, "t") for i in range(600)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9), share=0.5).collect()
    s = [r for r in got if r.source == "s"]
    share = {n: np.mean([r["__copies"] for r in s if r["__size"] == n]) for n in (1, 4)}
    assert 3.2 < share[4] / share[1] < 4.8  # one class is four times the other
    assert abs(sum(r["__size"] * r["__copies"] for r in s) - s[0]["__target"]) <= 2


@pytest.mark.parametrize("op,sql", [(mixing.op10, mixing.OP10_SQL), (suffix_dedup.op3, suffix_dedup.OP3_SQL)])
def test_against_sql(spark, op, sql):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(sql).fetch_df().sort_values("doc_id").reset_index(drop=True)
    got = op(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and (got == want).all().all()
