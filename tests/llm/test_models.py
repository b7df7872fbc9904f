import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from xylem.llm import language_id, lm_scoring, toxicity
from xylem.llm.common import remainder
from xylem.llm.words import Hasher, lower_ascii, separators, spans

SF = "/root/testdata/sf0.01"


def test_remainder_is_crc32_of_the_text(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 123456, None)], "id long").select("id", remainder("id", 7).alias("m")).collect()
    assert all(r.m == (0 if r.id is None else zlib.crc32(str(r.id).encode()) % 7) for r in rows)


def test_words_hash_alike_wherever_they_stand():
    buf = lower_ascii(np.frombuffer(b"The cat\x0bthe  CAT\xc2\xa0 the\n", np.uint8))
    s, e = spans(buf, separators())
    h = Hasher().hashes(buf, s, e)[0]
    assert [bytes(buf[a:b]) for a, b in zip(s, e)] == [b"the", b"cat", b"the", b"cat\xc2\xa0", b"the"]
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_language_mixture_is_found():
    rng = np.random.default_rng(0)
    likelihood = rng.dirichlet(np.full(200, 0.1), 3).T + 1e-6
    likelihood /= likelihood.sum(0)
    for share in ([1, 0, 0], [0, 0.6, 0.4]):
        counts = rng.multinomial(3000, likelihood @ share)
        k, s = language_id.infer(counts, likelihood)
        assert k == int(np.argmax(share)) and abs(s - max(share)) < 0.05


def test_language_id_edges(documents, no_documents):
    model = language_id.LanguageModel(documents)
    got = model.predict(documents, ["doc_id", "score"]).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (60, 61, 62, 63)} == {"und"}
    nothing = language_id.LanguageModel(no_documents)
    assert {r.lang_pred for r in nothing.predict(documents.select("doc_id", "text"), ["doc_id"]).collect()} == {"und"}
    assert model.predict(no_documents.select("doc_id", "text"), ["doc_id"]).collect() == []


def test_language_id_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in language_id.op1(spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_toxicity_finds_planted_expressions(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows = []
    for i in range(400):
        words = list(rng.choice(plain, 40))
        if i % 5 == 0:
            words[rng.integers(40)] = "grok" + str(rng.choice(["o", "ix", "ule"]))
            words[rng.integers(40)] = "snarl"
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "snarl snarl grokix")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.ToxicityModel(docs, labels)
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95
    assert got[1000] == got[1001] and got[None] > 0.3 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"] and {1000, 1001} <= {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("text", ["", " a ", "donaudampfschifffahrtsgesellschaft kurz", "这是一个没有空格的句子吗", "ภาษาไทย“word”漢字ok", "x" * 40 + "привет, превосходительство"])
def test_toxicity_expressions_cover_every_byte(text):
    buf, table = np.frombuffer(text.encode() + b"\n", np.uint8), separators(True)
    s, e = toxicity.pieces(buf, table)
    covered = np.zeros(len(buf), bool)
    for a, b in zip(s, np.minimum(s + toxicity.LEVELS[-1], e), strict=True):
        covered[a:b] = True
    assert (covered == ~table[buf]).all() and len(set(s.tolist())) == len(s)


def test_toxicity_finds_expressions_in_long_runs(spark):
    rng = np.random.default_rng(5)
    hanzi, parts = [chr(0x4E00 + i) for i in range(60)], ["haus", "boot", "fahrt", "wagen", "licht", "stein", "kraft"]
    rows = []
    for i in range(400):
        run, word = list(rng.choice(hanzi, 30)), list(rng.choice(parts, 6))
        if i % 5 == 0:
            run[rng.integers(8, 28)] = "鬱龘"
            word[rng.integers(3, 6)] = "snarlgrok"
        rows.append((i, "".join(run if i % 2 else word), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.ToxicityModel(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    held = {r.doc_id: r.score for r in model.score(docs).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    for odd in (0, 1):
        assert np.mean([(s >= 0.3) == (i % 5 == 0) for i, s in held.items() if i % 2 == odd]) > 0.9


def test_toxicity_keeps_long_clean_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.ToxicityModel(docs, labels)
    singly = model.score(docs.join(labels, "doc_id").where((F.col("toxic") == 0) & (remainder("doc_id", 4) == 2)), keep=["doc_id", "text"])
    clean = [r.text for r in singly.where("score < 0.3").orderBy("doc_id").collect()]
    long_ = spark.createDataFrame([(n, " ".join(clean[:n])) for n in (20, 40, len(clean))], "doc_id long, text string")
    assert len(clean) > 40 and all(r.score < 0.3 for r in model.score(long_).collect())


def test_toxicity_hears_every_expression():
    evidence = {b"bad": 3.0, b"sly": 1.0}
    cell = lambda w: toxicity.cells([w], Hasher(), separators(True))[0][:, 0]
    model = [(np.zeros(1 << toxicity.CELL_BITS, np.float32), np.zeros(1 << toxicity.CELL_BITS, np.float32)) for _ in toxicity.LEVELS]
    for w, x in evidence.items():
        model[1][0][cell(w)[1]] = x
    texts = [b"bad bad " + t for t in (b"one two six", b"one two sly", b"one sly sly", b"sly sly sly")]
    got = toxicity.evidence(texts, model, Hasher(), separators(True))
    assert (np.diff(got) > 0).all()


def test_toxicity_counts_are_brute_force(spark):
    """Words of up to 12 bytes: class counts and continuation counts of every prefix, and probabilities that sum to one."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), rng.integers(2, 7))) for _ in range(60)]
    texts = [(" ".join(rng.choice(words, 30)), int(i % 3 == 0)) for i in range(20)] + [(None, 1), ("", 0)]
    got = toxicity.class_counts(spark.createDataFrame(texts, "__text string, __label int").repartition(3)).toPandas()
    cell = lambda w: toxicity.cells([w.encode()], Hasher(), separators(True))[0][:, 0].tolist()
    n, seen = Counter(), {}
    for t, y in texts:
        before = None
        for w in (t or "").split():
            c = cell(w)
            for level in range(len(toxicity.LEVELS)):
                key = (level, c[level], c[level - 1] if level else 0)
                n[*key, y] += 1
                seen.setdefault(key, set()).add(before)
            before = w
    assert len(got) == len(seen)
    for r in got.itertuples():
        key = (r.level, r.cell, r.parent)
        assert (r.ordinary, r.toxic, r.contexts) == (n[*key, 0], n[*key, 1], len(seen[key]))
    for level in range(len(toxicity.LEVELS)):
        rows, above = got[got.level == level], got[got.level == level - 1]
        for side in ("ordinary", "toxic"):
            total = np.bincount(above.cell, weights=above[side], minlength=1 << toxicity.CELL_BITS) if level else np.array([float(rows[side].sum())])
            p, _ = toxicity.extended(rows[side].to_numpy(float), total, rows.parent.to_numpy(), rows.contexts.to_numpy(float))
            sums = np.bincount(rows.parent, weights=p)
            assert np.allclose(sums[np.unique(rows.parent)], 1)


def test_logistic_settles_where_classes_part():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1.2, 1.2, 3000), rng.normal(5, 0.5, 1000)])
    y = np.repeat([0.0, 1.0], [3000, 1000])
    a, b = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(p.mean() - 0.25) < 0.01 and ((p >= 0.3) == y).mean() > 0.97


def test_toxicity_held_out(spark):
    large = SF.replace("0.01", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    held = [r for r in toxicity.op7(spark, large).collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = ([r.score for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean([[x > y for y in clean] for x in toxic]) > 0.93 and np.mean([x < 0.3 for x in clean]) > 0.97


def test_toxicity_without_labels(spark, documents, no_documents):
    model = toxicity.ToxicityModel(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.3 for r in model.score(documents, keep=["doc_id"]).collect())
    assert model.score(no_documents, keep=["doc_id"]).collect() == []


def lm_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def test_lm_scores(documents, no_documents):
    learns = remainder("doc_id", 7) != 2
    got = lm_scoring.scores(documents, learns, ["doc_id", "score"]).toDF("doc_id", "old", "n_tokens", "n_known", "n", "base", "log", "bits").collect()
    rows = documents.select("doc_id", "text", learns.alias("learns")).collect()
    count = Counter(w for r in rows if r.learns for w in [*lm_words(r.text), b"\0"])
    n, v = sum(count.values()), len(count)
    want = sorted((str(r.doc_id), len(w), sum(x in count for x in w), n, round(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for r in rows for w in [[*lm_words(r.text), b"\0"]])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.n, round(r.base, 6)) for r in got) == want
    assert all(r.log < 0 and np.isfinite(r.log) and r.old == 0.5 for r in got)
    size = {str(r.doc_id): sum(len(w) + 1 for w in lm_words(r.text)) + 1 for r in rows}
    assert all(abs(r.bits + r.log / np.log10(2) / size[str(r.doc_id)]) < 1e-9 for r in got)
    assert lm_scoring.scores(no_documents, learns, ["doc_id"]).collect() == []


def lm_model(texts):
    """Vocabulary, tree, spelling, counts and weights of one chunk whose texts all teach."""
    words = Counter(w for t in texts for w in t.lower().split())
    order = sorted(words)
    spelt = b"".join(w + b" " for w in order) + b"\n"
    tree = lm_scoring.Tree(np.bincount(np.frombuffer(spelt, np.uint8), minlength=256))
    spelling = lm_scoring.Spelling(spelt, tree, Hasher())
    times = np.array([*(words[w] for w in order), len(texts)])
    return order, times, tree, spelling, lm_scoring.own_counts(spelling, times, tree)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    texts = [b" ".join(b"a" + bytes([b]) for b in rng.choice([x for x in range(256) if x not in (9, 10, 11, 12, 13, 32)], 300)) + b" a b ab a" for _ in range(3)]
    words, _, tree, _, _ = lm_model(texts)
    every = sorted({b"a", *(b"a" + bytes([b]) for b in range(256) if b != 0x20)})  # after "a" any byte may follow
    spelt = b"".join(w + b" " for w in every) + b"\n"
    spelling = lm_scoring.Spelling(spelt, tree, Hasher())
    totals = rng.integers(0, 40, len(spelling.keys))
    counts = lm_scoring.codes_of(spelling.keys, totals, tree)
    mixer = lm_scoring.Mixer(rng.uniform(0.1, 0.6, (lm_scoring.GATES, len(lm_scoring.ORDERS))))
    cost = mixer.costs(spelling, counts, tree)
    begins = np.concatenate(([0], spelling.ends[:-1] + 1))
    second = np.unique(spelling.edge[begins[:-1] + 1])  # the edges behind "a"
    assert len(second) == 256 and np.allclose(np.exp(-cost[:, second].astype(float)).sum(1), 1, atol=1e-4)


def test_lm_edges_and_counts_are_brute_force(documents):
    texts = [(r.text or "").encode() for r in documents.where("text IS NULL OR length(text) < 3000").select("text").collect()]
    words, times, tree, spelling, counts = lm_model(texts)
    want, edges, total = Counter(), set(), Counter()
    for w, n in [*zip(words, times.tolist()), (None, len(texts))]:
        body = b"\n" if w is None else w + b" "
        for p, byte in enumerate(body):
            edges.add((body[:p], byte))
            total[body[:p], byte] += n
            for order, size in enumerate(lm_scoring.ORDERS):
                context = body[max(0, p - size) : p] if size else body[:p]
                for level in range(tree.depth[byte]):
                    want[order, context, int(tree.node[level, byte]), bool(tree.turn[level, byte])] += n
    assert len(edges) == len(spelling.byte)
    passed, at = spelling.edge_counts(times), 0
    for w in [*words, None]:
        body = b"\n" if w is None else w + b" "
        for p, byte in enumerate(body):
            edge = spelling.edge[at + p]
            assert spelling.byte[edge] == byte and passed[edge] == total[body[:p], byte]
            for order, size in enumerate(lm_scoring.ORDERS):
                context = body[max(0, p - size) : p] if size else body[:p]
                for level in range(tree.depth[byte]):
                    key = (order, context, int(tree.node[level, byte]))
                    turn = bool(tree.turn[level, byte])
                    assert counts[level][spelling.places[order][edge]] == lm_scoring.both(*(np.array([want[*key, t]]) for t in (turn, not turn)))[0]
        at += len(body)


def test_lm_counts_come_back_from_ranges(documents, monkeypatch):
    """Many chunks and ranges find the same counts as one chunk that holds all texts."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 20_000)
    docs = documents.where("text IS NULL OR length(text) < 3000")
    chunks = lm_scoring.written(lm_scoring.vocabularies(docs, ["doc_id"], F.lit(True), "text"), "test-chunks")
    words, times, tree, spelling, counts = lm_model([(r.text or "").encode() for r in docs.select("text").collect()])
    of_key = {k: [c[i] for c in counts] for i, k in enumerate(spelling.keys.tolist())}
    of_word = dict(zip([*words, b""], times.tolist()))
    rows = lm_scoring.totals(chunks, tree, 4, 53).join(chunks.select("chunk", "spelt"), "chunk", "left").collect()
    assert len(rows) > 3 and sum(r.words for r in rows if not r.chunk) == len(words) + 1 - (b"" in words)
    tool = lm_scoring.zstandard.ZstdDecompressor()
    for r in rows:
        if not r.chunk:
            continue
        spelt = tool.decompress(bytes(r.spelt))
        own = lm_scoring.Spelling(spelt, tree, Hasher())
        codes = lm_scoring.read_codes(own.keys, r.found, 4, tree, tool)
        depth = tree.depth_of(own.keys)
        for i, k in enumerate(own.keys.tolist()):
            assert [c[i] for c in codes[: depth[i]]] == of_key[k][: depth[i]]
        n = lm_scoring.read_times(lm_scoring.word_keys(spelt, Hasher()), r.found, 4, tool)
        assert n[:-1].tolist() == [of_word[w] for w in spelt[:-1].split()]


def test_lm_scores_sum_to_one_at_most(spark):
    words = ["a", "b", "ab", "ba", "aa", "bb"]
    texts = ["", *words, *(f"{x} {y}" for x in words for y in words), *(f"{x} {y} {z}" for x in words for y in words for z in words)]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)] + [(-1 - i, "a ab a b", True) for i in range(20)], "doc_id long, text string, learns boolean")
    got = [r for r in lm_scoring.scores(docs, F.col("learns"), ["doc_id"]).collect() if r.doc_id >= 0]
    assert len(got) == len(texts) and 0.01 < sum(10**r.score for r in got) <= 1


def test_lm_scores_know_the_word_before(spark):
    """Texts of the same words, in the order that was taught and in others."""
    taught, other = "red fox runs home. blue owl flies away.", "owl red home. flies fox away. runs blue"
    docs = spark.createDataFrame([(0, taught, False), (1, other, False)] + [(i + 2, taught, True) for i in range(30)], "doc_id long, text string, learns boolean")
    score = {r.doc_id: r.score for r in lm_scoring.scores(docs, F.col("learns"), ["doc_id"]).collect()}
    assert score[0] > score[1] + 1


def lm_reading(texts):
    words, times, tree, spelling, _ = lm_model(texts)
    spelt, number = b"".join(w + b" " for w in words) + b"\n", {w: i for i, w in enumerate(words)}
    split = [t.lower().split() for t in texts]
    reading = lm_scoring.Reading(spelling, spelt, np.array([number[w] for t in split for w in t], np.uint32), np.array([len(t) for t in split]), tree, Hasher())
    passed = reading.edge_counts(times, np.ones(len(texts), bool))
    across = reading.pair_counts(passed)
    codes = reading.codes(lm_scoring.own_counts(spelling, times, tree), lm_scoring.codes_of(reading.keys, across, tree))
    return [(b"".join(w + b" " for w in t) + b"\n", t) for t in split], tree, reading, passed, across, codes


def test_lm_contexts_across_words_are_brute_force(documents):
    streams, _, reading, passed, across, _ = lm_reading([(r.text or "").encode() for r in documents.where("text IS NULL OR length(text) < 3000").select("text").collect()])
    want, places = Counter(), []
    for stream, words in streams:
        p = 0
        for i, w in enumerate([*words, None]):
            for into in range(1 if w is None else len(w) + 1):
                here = [(k, stream[max(0, p - size) : p], stream[p]) for k, size in enumerate(lm_scoring.ACROSS) if into < size]
                here += [] if into else [(len(lm_scoring.ACROSS), words[i - 1] if i else None, stream[p])]
                want.update(here)
                places.append({h[0]: h for h in here})
                p += 1
    edges, ends = reading.stream()
    assert ends.tolist() == np.cumsum([len(s) for s, _ in streams]).tolist()
    assert bytes(reading.byte[edges]) == b"".join(s for s, _ in streams)
    assert np.bincount(edges, minlength=len(passed)).tolist() == passed.tolist()
    for k, place in enumerate(reading.places[len(lm_scoring.ORDERS) :]):
        cell = place[edges] - len(reading.spelling.keys)
        assert all((across[c] == want[h[k]]) if k in h else c == len(reading.keys) for c, h in zip(cell.tolist(), places, strict=True))


def test_lm_second_layer_steps_through_a_text():
    """Texts together cost what each costs when read bit by bit, a step of learning after every block."""
    rng = np.random.default_rng(0)
    texts = [b" ".join(rng.choice([b"an", b"ant", b"bee", b"be", b"crow"], n)) for n in (0, 1, 40, 200, 3)]
    streams, tree, reading, _, _, codes = lm_reading(texts)
    mixer = lm_scoring.Mixer(rng.uniform(0.1, 0.6, (lm_scoring.GATES, lm_scoring.PREDICTORS)))
    logits = {(int(e), level): row for level, edges, rows in mixer.weighed(reading, codes, tree) for e, row in zip(edges, rows, strict=True)}
    refined, plain = mixer.text_costs(reading, codes, tree)
    edges, ends = reading.stream()
    for t, (stream, _) in enumerate(streams):
        own, factors, square, total, even = edges[ends[t] - len(stream) : ends[t]], np.ones(4), np.ones(4), 0.0, 0.0
        for lo in range(0, len(own), lm_scoring.STEP):
            rows = np.array([logits[int(e), level] for e in own[lo : lo + lm_scoring.STEP] for level in range(tree.depth[reading.byte[e]])], float)
            z = rows @ factors
            total, even = total + np.log1p(np.exp(-z)).sum(), even + np.log1p(np.exp(-rows.sum(1))).sum()
            step = (rows / (1 + np.exp(z))[:, None]).sum(0)
            square += step**2
            factors += lm_scoring.STEP_RATE * step / np.sqrt(square)
        assert abs(refined[t] - total) < 1e-2 + 1e-3 * total and abs(plain[t] - even) < 1e-2 + 1e-3 * even
    assert refined[3] != plain[3]


def test_lm_orders_and_groups_are_numpys():
    rng = np.random.default_rng(0)
    for width in (24, 40, 64 - lm_scoring.LOW):
        for n in (0, 1, 1000, 100_000):
            keys = rng.integers(0, 1 << 12, n).astype(np.uint64) << np.uint64(64 - width) | rng.integers(0, 1 << lm_scoring.LOW, n).astype(np.uint64)
            assert (keys[lm_scoring.ordered(keys, width)] == np.sort(keys)).all()
            back, one = lm_scoring.grouped(keys)
            assert (keys[one][back] == keys).all() and len(one) == len(np.unique(keys)) and (np.diff(one) > 0).all()


def test_lm_freed_memory_stays_while_a_chunk_is_worked_on():
    """Arrays that come and go cost few new pages, until memory is given back."""
    resource, ctypes = pytest.importorskip("resource"), pytest.importorskip("ctypes")
    if not hasattr(ctypes.CDLL(None), "mallopt"):
        pytest.skip("another C library")

    def pages():
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        for _ in range(50):
            np.ones(1 << 18)
        return resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before

    lm_scoring.let_go()
    given = pages()
    lm_scoring.keep_freed()
    kept = pages()
    lm_scoring.let_go()
    assert kept < given / 5


def test_lm_bits_of_held_out_texts(spark):
    held = [r for r in lm_scoring.op6(spark, SF).collect() if r.held_out]
    assert 2 < np.mean([r.bits_per_byte for r in held]) < 2.45


def test_lm_words_are_split_at_ascii_white_space(spark):
    odd = "".join(map(chr, range(1, 128))) + " Ünï\u00a0cödé\x85漢\u3000字 É"
    docs = spark.createDataFrame([(odd,), (" ",), ("",), (None,), ("a  b\n",)], "text string").coalesce(1)
    r = lm_scoring.vocabularies(docs, ["text"], F.lit(True), "text").collect()[0]
    tool = lm_scoring.zstandard.ZstdDecompressor()
    words = tool.decompress(bytes(r.spelt))[:-1].split(b" ")[:-1]
    want = [lm_words(t) for t in (odd, " ", "", None, "a  b\n")]
    tokens = [words[i] for i in lm_scoring.opened(bytes(r.tokens), np.uint32, tool)]
    assert words == sorted({w for t in want for w in t}) and tokens == [w for t in want for w in t]
    assert np.frombuffer(r.sizes, np.int64).tolist() == list(map(len, want))


@pytest.mark.parametrize("n", [np.arange(100), np.array([5, 4095, 4096, 10**6, 10**9])])
def test_lm_codes_keep_counts(n):
    back = lm_scoring._COUNT[lm_scoring.coded(n)]
    assert (back[n <= 32] == n[n <= 32]).all() and (abs(back - n) <= 0.05 * n).all()


def test_pairs_and_codes_travel_small_and_come_back(spark):
    chunks = lm_scoring.written(lm_scoring.vocabularies(spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id"], F.lit(True), "text"), "test-chunks")
    rows = chunks.select("chunk", "spelt", "tokens", "sizes", "teach", "frequency").collect()
    tree, tool = lm_scoring.Tree(np.sum([r.frequency for r in rows], 0)), lm_scoring.zstandard.ZstdDecompressor()
    bits, width = lm_scoring.ranges(chunks)
    found = {r.chunk: r.found for r in lm_scoring.totals(chunks, tree, bits, width).collect() if r.chunk}
    back = n = 0
    for r in rows:
        reading, _ = lm_scoring.reading_of(tool.decompress(bytes(r.spelt)), bytes(r.tokens), bytes(r.sizes), bytes(r.teach), tree, Hasher(), width, tool)
        for kind, keys in (("codes", reading.spelling.keys), ("across", reading.keys)):
            back += sum(len(f[kind]) for f in found[r.chunk])
            n += len(keys)
            level = 0
            for level, codes in enumerate(lm_scoring.read_codes(keys, found[r.chunk], bits, tree, tool, kind), 1):
                deep = tree.depth_of(keys) >= level
                assert (codes[deep] > 0).all()  # every pair was counted, so one turn of two at least
            assert level == tree.depth_of(keys).max()
            sent = lm_scoring.squeezed_pairs(keys, width, lm_scoring.zstandard.ZstdCompressor(level=1))
            assert len(sent) < 0.85 * len(lm_scoring.squeezed_keys(keys, lm_scoring.zstandard.ZstdCompressor(level=1)))
            assert (lm_scoring.opened_pairs(sent, width, tool) == keys).all()
    assert 8 * back < 7.5 * n  # bits a pair; 9 where each level has two streams of its own


def test_codes_of_several_chunks_are_packed_apart():
    rng = np.random.default_rng(5)
    tree = lm_scoring.Tree(rng.integers(1, 1000, 256))
    keys = np.unique(lm_scoring.numbered(rng.integers(0, 40, 3000).astype(np.uint64), 3, rng.integers(0, 256, 3000).astype(np.uint64), 40))
    levels = lm_scoring.codes_of(keys, np.rint(rng.pareto(0.4, len(keys))).clip(0, 10**9).astype(np.int64), tree)
    own = [np.arange(len(keys)), np.array([], np.int64), np.flatnonzero(rng.random(len(keys)) < 0.3), np.array([7]), np.array([7])]  # neighbours that share a context
    at, of = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    raws = lm_scoring.packed_codes([x[at] for x in levels], of, len(own), keys[at], tree, lm_scoring.zstandard.ZstdCompressor())
    for raw, x in zip(raws, own, strict=True):
        deep, got = tree.depth_of(keys[x]), list(lm_scoring.unpacked_codes([raw], np.zeros(len(x), int), keys[x], tree, lm_scoring.zstandard.ZstdDecompressor()))
        assert len(got) == deep.max(initial=0)
        for level, codes in enumerate(got):
            assert (codes == levels[level][x])[deep > level].all()
