"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A segmentation is a path over positions whose states are the pieces that end
there; two pieces may follow one another only if the model, given both
together, would leave them apart. For pieces merged by rank exactly one path
through a text satisfies this everywhere, and it is the model's own encoding.

A giant document is cut into chunks wherever the size says. Each chunk yields,
without knowing its neighbours, a max-plus matrix from the states at its left
cut (which piece crosses it, and how far) to those at its right cut, weighing a
path by minus its pieces. The matrices combine associatively; with the states
at every cut known, each chunk traces its own pieces. Between two word starts a
path has no choice, so there whole words are looked up or given to the model.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, lean, read_table, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, and of a text that is not cut.
CHUNK = 1 << 15
#: Words remembered by a worker.
REMEMBERED = 150_000
SPACE = "▁"
#: A word with the spaces before it; line feeds are in no piece, so they part words too.
WORDS = re.compile("\n|[▁]*[^▁\n]+|[▁]+")
START = (0, 0)


class Encoder:
    """The model in a worker: words, pieces and which pairs of pieces stay apart."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        # Field 3, normalizer_spec, once more: its field 3, add_dummy_prefix, off. Later fields of a message win.
        self.sp = SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        sp = self.sp
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.piece))
        self.words: dict[str, tuple[int, ...]] = {}
        self.apart: dict[tuple[str, str], bool] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = list(words)
        if new:
            self.words.update(zip(new, map(tuple, self.sp.encode(new, num_threads=1)), strict=True))

    def encode(self, escaped: list[str]) -> list[list[int]]:
        cut = [WORDS.findall(t) for t in escaped]
        self.learn({w for words in cut for w in words})
        get, out = self.words.__getitem__, []
        for words in cut:
            ids: list[int] = []
            for w in map(get, words):
                ids += w
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)[1:] if ids else ""

    def ids(self, piece: str) -> list[int]:
        i = self.piece.get(piece)
        return [i] if i is not None else self.sp.encode(piece)  # a lone character outside the vocabulary: its bytes

    def stay_apart(self, a: str, b: str) -> bool:
        if not a or a[-1] == "\n" or b[0] == "\n" or (b[0] == SPACE and a[-1] != SPACE):
            return True
        key = (a, b)
        if key not in self.apart:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            self.apart[key] = self.sp.encode(a + b) == self.ids(a) + self.ids(b)
        return self.apart[key]

    def ends(self, s: str, at: int) -> list[int]:
        """Where pieces that begin at ``at`` end."""
        found = [at + 1] if at < len(s) else []
        return found + [e for e in range(at + 2, min(len(s), at + self.longest) + 1) if s[at:e] in self.piece]

    def paths(self, s: str, at: int, before: str, stop: int) -> tuple[dict, list]:
        """From ``at`` after piece ``before``: back pointers {(position, length): (position, length)} and the first states at or beyond ``stop``."""
        begin = (at, len(before))
        back, done, frontier = {begin: None}, [], {at: [begin]}
        if at >= stop:
            return back, [begin]
        for i in range(at, stop):
            for state in frontier.pop(i, ()):
                a = s[i - state[1] : i]
                for e in self.ends(s, i):
                    if self.stay_apart(a, s[i:e]) and (e, e - i) not in back:
                        back[(e, e - i)] = state
                        if e >= stop:
                            done.append((e, e - i))
                        else:
                            frontier.setdefault(e, []).append((e, e - i))
        return back, done


def encoder(model: bytes) -> Encoder:
    """The worker's encoder for this model, kept between its tasks."""
    import sentencepiece

    kept = getattr(sentencepiece, "_kept_encoder", None)
    if kept is None or kept[0] != model:
        kept = sentencepiece._kept_encoder = (model, Encoder(model))
    return kept[1]


def is_start(s: str, i: int) -> bool:
    """Whether a word starts at ``i``, so that every path has a piece start there."""
    return i == 0 or i == len(s) or s[i] == "\n" or s[i - 1] == "\n" or (s[i] == SPACE and s[i - 1] != SPACE)


def next_start(s: str, i: int, stop: int) -> int | None:
    while i <= stop and not is_start(s, i):
        i += 1
    return i if i <= stop else None


def last_start(s: str, i: int, least: int) -> int:
    while i > least and not is_start(s, i):
        i -= 1
    return i


class Chunk:
    """Text around [left, right) of a document, with the model's reach on both sides; cuts are relative to ``s``."""

    def __init__(self, enc: Encoder, s: str, left: int, right: int) -> None:
        self.enc, self.s, self.left, self.right = enc, s, left, right
        self.first = next_start(s, left, right)
        self.last = None if self.first is None else last_start(s, right, self.first)

    def state(self, where: tuple[int, int], cut: int) -> tuple[int, int]:
        return START if is_start(self.s, cut) else (where[0] - cut, where[1])

    def entries(self) -> list[tuple[int, int]]:
        if is_start(self.s, self.left):
            return [START]
        out = []
        for o in range(min(self.enc.longest, len(self.s) - self.left + 1)):
            end = self.left + o
            for n in range(o + 1 if o else 1, min(self.enc.longest, end) + 1):
                if (n == 1 or self.s[end - n : end] in self.enc.piece) and (end == self.left or end - n < self.left):
                    out.append((o, n))
        return out

    def before(self, state: tuple[int, int]) -> tuple[int, str]:
        end = self.left + state[0]
        return end, self.s[end - state[1] : end]

    def inner(self) -> list[int]:
        return self.enc.encode([self.s[self.first : self.last]])[0]

    def matrix(self) -> list[tuple[int, int, int, int, int]]:
        """(in offset, in length, out offset, out length, score); pairs that are left out score minus infinity."""
        out = []
        if self.first is None:
            for state in self.entries():
                at, piece = self.before(state)
                back, done = self.enc.paths(self.s, at, piece, self.right)
                out += [(*state, *self.state(d, self.right), -self.steps(back, d)) for d in done]
            return out
        middle = -len(self.inner())
        back, done = self.enc.paths(self.s, self.last, "", self.right)
        tails = [(self.state(d, self.right), -self.steps(back, d)) for d in done]
        for state in self.entries():
            at, piece = self.before(state)
            if at > self.first:
                continue  # a piece doesn't reach over a word's start
            back, done = self.enc.paths(self.s, at, piece, self.first)
            for d in done:
                if d[0] == self.first:
                    head = -self.steps(back, d)
                    out += [(*state, *tail, head + middle + score) for tail, score in tails]
        return out

    def steps(self, back: dict, state) -> int:
        n = 0
        while back[state] is not None:
            n += len(self.enc.ids(self.s[state[0] - state[1] : state[0]]))
            state = back[state]
        return n

    def traced(self, back: dict, state) -> list[int]:
        pieces = []
        while back[state] is not None:
            pieces.append(self.enc.ids(self.s[state[0] - state[1] : state[0]]))
            state = back[state]
        return [i for p in reversed(pieces) for i in p]

    def trace(self, enter: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """The chunk's own pieces: those after the one that crosses the left cut, with the one that crosses the right."""
        at, piece = self.before(enter)

        def fits(d):
            return self.state(d, self.right) == leave

        if self.first is None:
            back, done = self.enc.paths(self.s, at, piece, self.right)
            return self.traced(back, next(d for d in done if fits(d)))
        back, done = self.enc.paths(self.s, at, piece, self.first)
        head = self.traced(back, next(d for d in done if d[0] == self.first))
        back, done = self.enc.paths(self.s, self.last, "", self.right)
        return head + self.inner() + self.traced(back, next(d for d in done if fits(d)))


def max_plus(vector: dict, matrix: list) -> tuple[dict, dict]:
    """A row vector {state: score} times a matrix, and which state each result came from."""
    out, came = {}, {}
    for a, b, c, d, score in matrix:
        if (a, b) in vector and vector[(a, b)] + score > out.get((c, d), float("-inf")):
            out[(c, d)] = vector[(a, b)] + score
            came[(c, d)] = (a, b)
    return out, came


def states_at_cuts(matrices: list[list]) -> list[tuple[int, int]]:
    """The best path's state at every cut: forward products, then back from the document's end."""
    vector, steps = {START: 0}, []
    for m in matrices:
        vector, came = max_plus(vector, m)
        steps.append(came)
    state = max(vector, key=vector.get)
    states = [state]
    for came in reversed(steps):
        state = came[state]
        states.append(state)
    return states[::-1]


def escaped(text: str) -> str:
    return (" " + text).replace(" ", SPACE) if text else ""


def pieces_of(s: str, longest: int, size: int) -> list[tuple[str, int, int]]:
    """(text with margins, left, right) of each chunk."""
    out = []
    for a in range(0, len(s), size):
        b, lo = min(a + size, len(s)), max(0, a - longest)
        out.append((s[lo : b + longest], a - lo, b - lo))
    return out


def encoded(docs: DataFrame, keep: list[str], text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``keep`` columns, n_chars, ids and round_trip (whether the ids decode to the text) of each row.

    Null and empty texts have no pieces. Repeated rows stay. The text's own
    U+2581 is a space to the model, so such texts don't decode to themselves.
    """
    with open(model, "rb") as f:  # a fixed file of under 1 MB
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [f"k{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kept = d.select(*names).schema
    result = T.StructType([*kept.fields, T.StructField("n_chars", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    last = result.fieldNames()[-3:]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(len(names)).to_pylist()
                ids = enc.encode([escaped(t) for t in texts])
                ok = [enc.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(list(map(len, texts)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(ok)], [*names, *last])
        give_back()

    small = d.where(F.length("text") <= chunk).mapInArrow(lean(short), result)
    cut_schema = T.StructType([*kept.fields, *T._parse_datatype_string("row string, k int, n_chars long, s string, lo int, hi int").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = encoder(held.value).longest
        for batch in batches:
            for i, text in enumerate(batch.column(len(names)).to_pylist()):
                row = uuid.uuid4().hex
                chunks = pieces_of(escaped(text), longest, chunk)
                n = len(chunks)
                same = [c.slice(i, 1).take(pa.array([0] * n)) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*same, pa.array([row] * n), pa.array(range(n), pa.int32()), pa.array([len(text)] * n, pa.int64()), *(pa.array([c[j] for c in chunks], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32())))], cut_schema.fieldNames())

    chunks = written(d.where(F.length("text") > chunk).mapInArrow(lean(cut), cut_schema), "piece-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            m = [[x for entry in Chunk(enc, s, lo, hi).matrix() for x in entry] for s, lo, hi in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m, pa.list_(pa.int64()))], ["row", "k", "m"])

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        states = states_at_cuts([list(zip(*[iter(m)] * 5)) for m in table["m"].to_pylist()])
        flat = [[*a, *b] for a, b in zip(states, states[1:])]
        return pa.table({"row": table["row"], "k": table["k"], "states": pa.array(flat, pa.list_(pa.int32()))})

    cells = chunks.select("row", "k", "s", "lo", "hi")
    states = cells.mapInArrow(lean(matrices), "row string, k int, m array<long>").groupBy("row").applyInArrow(combine, "row string, k int, states array<int>")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            ids = [Chunk(enc, s, lo, hi).trace((a, b), (c, e)) for s, lo, hi, (a, b, c, e) in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
            own = [s[lo:hi] for s, lo, hi in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["row", "k", "own", "ids"])

    traced = cells.join(states, ["row", "k"]).select("row", "k", "s", "lo", "hi", "states").mapInArrow(lean(trace), "row string, k int, own string, ids array<int>")
    whole = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids", "own"))).alias("p")).select("row", F.flatten(F.col("p.ids")).alias("ids"), F.concat_ws("", F.col("p.own")).alias("text"))
    heads = chunks.where("k = 0").select(*names, "row", "n_chars")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            at = len(names) + 1
            ok = [enc.decode(i) == t[1:].replace(SPACE, " ") for i, t in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], pa.array(ok)], [*names, *last])

    giant = heads.join(whole, "row").select(*names, "n_chars", "ids", "text").mapInArrow(lean(decoded), result)
    return small.unionByName(giant).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *last)


def decoded(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with ``out_col``: each array of ids as text; null stays null."""
    with open(model, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())
    names = rows.columns
    at, schema = names.index(ids_col), T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            text = [None if i is None else enc.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*names, out_col])

    return rows.mapInArrow(lean(run), schema)


def op8(spark, sf_dir):
    d = encoded(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return d.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
