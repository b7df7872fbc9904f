import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from xylem.llm import chunks, simhash, suffix_dedup
from xylem.llm.components import components


def brute_cut(texts):
    """{id: (bytes, removed, spans, kept)}; ids ascend, a null id is largest."""
    by_id = sorted(((suffix_dedup.NO_ID if i is None else i, (t or "").encode()) for i, t in texts), key=lambda x: x[0])
    least, out = {}, []
    for i, b in by_id:
        for p in range(len(b) - 49):
            least.setdefault(b[p : p + 50], i)
    for i, b in by_id:
        cut = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                cut[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(b, cut) if not x)
        out.append((i, len(b), cut.count(1), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found_cut(d):
    return sorted((suffix_dedup.NO_ID if r[0] is None else r[0], *r[1:]) for r in d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("chunk,common", [(chunks.CHUNK, suffix_dedup.COMMON), (3000, 2)])
def test_suffix_dedup_is_brute_force(documents, monkeypatch, chunk, common):
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    d = suffix_dedup.without_repeats(documents, ["doc_id", "score", "id"])
    assert found_cut(d) == brute_cut([(r.doc_id, r.text) for r in documents.collect()])


def test_cut_repeats_keeps_columns_and_nulls(documents, no_documents):
    d = suffix_dedup.cut_repeats(documents)
    assert d.columns == documents.columns
    rows = d.collect()
    assert [r.text for r in rows if r.doc_id == 60] == [None]
    assert all(r.text is None or len(r.text) == r.n_chars for r in rows)
    assert suffix_dedup.cut_repeats(no_documents).collect() == []


def test_loser_tree_merges_sorted_runs():
    rng = random.Random(2)

    class R:
        def __init__(self):
            self.strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))})
            self.lcp = [0, *(suffix_dedup.common_prefix(a, b, 0) for a, b in zip(self.strings, self.strings[1:]))]

    for n in (1, 2, 3, 7, 8):
        for _ in range(30):
            runs = [R() for _ in range(n)]
            out, before = [], None
            for r, i, h in suffix_dedup.merged(runs):
                s = runs[r].strings[i]
                if before is not None:
                    assert h == suffix_dedup.common_prefix(before, s, 0)
                out.append(s)
                before = s
            assert out == sorted(s for r in runs for s in r.strings)


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def united(nodes, links):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_is_brute_force(plain, no_documents):
    rows = {r.doc_id: brute_fingerprint(r.text) for r in plain.collect()}
    links = [(a, b) for a in rows for b in rows if a < b and bin(rows[a] ^ rows[b]).count("1") <= 2]
    want = united(rows, links)
    got = simhash.classes(plain).collect()
    assert {r.doc_id: r["__class"] for r in got} == want
    assert {r.doc_id: r["__fp"] % (1 << 64) for r in got} == rows
    assert simhash.classes(no_documents).collect() == []


def test_simhash_with_nulls_and_repeats(documents):
    got = simhash.classes(documents).collect()
    assert len(got) == documents.count()
    assert all(r["__class"] is not None for r in got)
    stays = simhash.one_of_each(documents)
    assert stays.columns == documents.columns
    ids = [r.doc_id for r in stays.collect()]
    assert len(ids) == len(set(ids)) == len({r["__class"] for r in got})


def test_one_of_each_class_stays_whatever_the_ids(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    own, shared, twin = [text() for _ in range(6)], [text() for _ in range(2)], text()
    rows = [(None, t) for t in own] + [(None, own[0])] * 2 + [(1, shared[0]), (1, shared[1]), (1, shared[1]), (None, twin), (2, twin), (3, None), (None, "")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, t) for t in own] + [(1, t) for t in shared] + [(2, twin), (3, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_crowded_keys_lose_no_link(spark):
    rng, fps = random.Random(1), set()
    for base in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(120):
            x = base
            for i in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << i
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    assert all(near(a, b) for a, b in links)
    assert united(fps, links) == united(fps, [(a, b) for a in fps for b in fps if a < b and near(a, b)])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
