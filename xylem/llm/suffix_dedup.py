"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A 50-byte string is filed under the least-hashed K-gram inside it, so equal
strings meet under equal K-grams; consecutive strings under one K-gram make one
stretch, and its suffix is the text from that K-gram on (what precedes it is
kept behind). In the order of the work:

1. Documents are packed into chunks, written once to the shared folder.
2. Every chunk sends hashes of its K-grams; those in one document only are
   dropped. This is one step of prefix doubling: such suffixes are told apart
   by their first K bytes, so no more of them need be exchanged.
3. Every chunk sorts the suffixes that are left and sends them front-coded, a
   run for each range of hashes. Equal ones travel once a run, with their least and greatest
   id, and their places stay at home. K-grams common
   enough to crowd a range send each 50-byte string on its own, under its own hash.
4. Every range merges its runs with a loser tree whose nodes hold common
   prefix lengths: bytes known to agree are never compared again. Stretches
   that share a K-gram come out together; each of their strings gets the
   smallest document it starts in.
5. Which suffixes are covered, and from which id on, goes back to the chunks,
   which find their places anew and cut them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import NO_ID, opened, packed_chunks, range_bits
from .common import give_back, lean, read_table, written
from .words import mix

LENGTH, K = 50, 20
#: Bytes in which hashes are computed at once.
BLOCK = 1 << 16
#: A K-gram is common if one chunk has it this often, or this many chunks have it.
COMMON, COMMON_CHUNKS = 1024, 4096
#: Bytes of text that a range of hashes stands for, rows handled at once, and bytes of text handed on at once.
RANGE_TEXT, SLICE, OUT_BYTES = 4 << 20, 1 << 14, 1 << 20
#: Bytes of hash before a suffix; a suffix with its left context and length.
HASH_BYTES, WIDE = 3, 2 * LENGTH - K + 1
_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def kgram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes at each position."""
    n = len(buf) - K + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, width, at, out, done = buf.astype(np.uint64), 1, K, None, 0
    while True:
        if at & width:  # append the next `width` bytes
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(_B, width, 1 << 64)) + part
            done += width
        if 2 * width > at:
            break
        h = h[:-width] * np.uint64(pow(_B, width, 1 << 64)) + h[width:]
        width *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def stretches(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first string, last string, K-gram, its hash, document) of each stretch of the documents that begin at ``begins``."""
    found = []
    i = 0
    while i < len(begins) - 1:
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + BLOCK, "right")) - 1)
        lo, hi = int(begins[i]), int(begins[j])
        h = kgram_hashes(buf[lo:hi])
        n = hi - lo - LENGTH + 1
        if n > 0:
            bits = np.uint64(max(1, (hi - lo).bit_length()))
            key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
            at = (sliding_least(key, LENGTH - K + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            doc = np.repeat(np.arange(i, j), np.diff(begins[i : j + 1]))[:n]
            inside = np.arange(n) + LENGTH <= begins[doc + 1] - lo
            w = np.flatnonzero(inside)
            if len(w):
                new = np.flatnonzero((np.diff(at[w]) != 0) | (np.diff(w) != 1)) + 1
                first = np.concatenate(([0], new))
                last = np.concatenate((new, [len(w)])) - 1
                a = at[w[first]]
                found.append((w[first] + lo, w[last] + lo, a + lo, h[a], doc[w[first]]))
        i = j
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sorted_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, and where each distinct hash begins and ends in it."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    return order, begin, np.append(begin[1:], len(h))


def shared_kgrams(chunks: DataFrame, bits: int) -> DataFrame:
    """(chunk, codes): per chunk, ranges and for each of its distinct K-grams there 0, 1 (in several documents) or 2 (common)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, blob, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, _, _, h, doc = stretches(*opened(blob, sizes))
                order, begin, end = sorted_keys(h)
                several = doc[order[begin]] != doc[order[end - 1]]
                code = np.where(end - begin >= COMMON, 2, 1) * several
                key = h[order[begin]]
                to = (key >> np.uint64(64 - bits)).astype(np.int64)
                low = (key << np.uint64(bits)).byteswap().view(np.uint8).reshape(-1, 8)[:, :5]  # 40 more bits
                cut = np.searchsorted(to, np.arange((1 << bits) + 1))
                del h, doc, order, begin, end, several, key, to
                rows = [(r, low[a:b].tobytes(), squeeze.compress(code[a:b].astype(np.uint8).tobytes())) for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([chunk] * len(rows), pa.string()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], ["r", "chunk", "keys", "codes"])

    def meet(table: pa.Table) -> pa.Table:
        keys, codes = table["keys"].to_pylist(), table["codes"].to_pylist()
        n = np.array([len(k) // 5 for k in keys])
        wide = np.zeros((n.sum(), 8), np.uint8)
        wide[:, 3:] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 5)
        key = wide.view(">u8").ravel().astype(np.uint64)
        opener = zstandard.ZstdDecompressor()
        code = np.frombuffer(b"".join(map(opener.decompress, codes)), np.uint8)
        order = np.argsort(key, kind="stable")
        k = key[order]
        begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        times = np.diff(np.append(begin, len(k)))
        best = np.maximum.reduceat(code[order], begin)
        best = np.where(times >= COMMON_CHUNKS, 2, np.where((times > 1) & (best == 0), 1, best)).astype(np.uint8)
        out = np.empty(len(key), np.uint8)
        out[order] = np.repeat(best, times)
        squeeze = zstandard.ZstdCompressor(level=1)
        found = [squeeze.compress(x.tobytes()) for x in np.split(out, np.cumsum(n)[:-1])]
        return pa.table({"chunk": table["chunk"], "r": table["r"], "codes": pa.array(found, pa.binary())})

    sent = chunks.select("chunk", "blob", "sizes").mapInArrow(lean(send), "r int, chunk string, keys binary, codes binary")
    met = sent.groupBy("r").applyInArrow(meet, "chunk string, r int, codes binary")
    return met.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("r", "codes"))).alias("codes"))


def suffixes(buf: np.ndarray, begins: np.ndarray, codes: list[dict]) -> tuple[np.ndarray, ...]:
    """What a chunk has to compare: as ``stretches``, of K-grams that several documents have; each string of a common one on its own."""
    opener = zstandard.ZstdDecompressor()
    first, last, at, h, doc = stretches(buf, begins)
    order, begin, end = sorted_keys(h)
    code = np.frombuffer(b"".join(opener.decompress(f["codes"]) for f in codes or ()), np.uint8)
    each = np.empty(len(h), np.uint8)
    each[order] = np.repeat(code, end - begin)
    crowd = np.flatnonzero(each == 2)
    n = last[crowd] - first[crowd] + 1
    alone = np.repeat(first[crowd] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # each string of a common K-gram
    some = each == 1
    lone_hash = np.empty(0, np.uint64)
    if len(alone):
        lone_hash = np.zeros(len(alone), np.uint64)
        for i in range(LENGTH):
            lone_hash = lone_hash * np.uint64(_B) + buf[alone + i]
        lone_hash = mix(lone_hash)
    return tuple(np.concatenate(x) for x in ((first[some], alone), (last[some], alone), (at[some], alone), (h[some], lone_hash), (doc[some], np.repeat(doc[crowd], n))))


class Arranged:
    """Suffixes in order, equal ones together, by range of hashes."""

    def __init__(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, h: np.ndarray, bits: int) -> None:
        right, wide = last + LENGTH - at, HASH_BYTES + WIDE
        top = (h >> np.uint64(64 - bits)).astype(np.int64)
        matrix = np.zeros((len(h), wide), np.uint8)
        matrix[:, :HASH_BYTES] = (h << np.uint64(bits)).byteswap().view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
        column = np.arange(WIDE - 1)
        for lo in range(0, len(h), SLICE):
            s = slice(lo, lo + SLICE)
            source = np.where(column < right[s, None], at[s, None] + column, first[s, None] + column - right[s, None])
            used = column < (last[s] + LENGTH - first[s])[:, None]
            matrix[s, HASH_BYTES:-1] = np.where(used, buf[np.minimum(source, len(buf) - 1)], 0)
        matrix[:, -1] = right  # not 0, so that what a row holds has no trailing zeros
        order = np.argsort(matrix.view(f"S{wide}").ravel(), kind="stable")
        order = order[np.argsort(top[order], kind="stable")]
        common = np.zeros(len(h), np.uint8)
        for lo in range(1, len(h), SLICE):
            hi = min(lo + SLICE, len(h))
            rows = matrix[order[lo - 1 : hi]]
            differ = rows[1:] != rows[:-1]
            common[lo:hi] = np.where(differ.any(1), differ.argmax(1), wide)
        top = top[order]
        common[1:][top[1:] != top[:-1]] = 0
        #: The occurrences in order, and where those of each distinct suffix begin and end.
        self.order, self.begin = order, np.flatnonzero(common < wide)
        self.end = np.append(self.begin[1:], len(order))
        self.matrix, self.lcp = matrix, common[self.begin]
        self.size = (HASH_BYTES + (last + LENGTH - first)[order[self.begin]]).astype(np.uint8)
        self.cut = np.searchsorted(top[self.begin], np.arange((1 << bits) + 1))

    def coded(self, a: int, b: int) -> bytes:
        """The distinct suffixes from ``a`` to ``b``, front-coded."""
        tail, rows = np.arange(self.matrix.shape[1]), self.matrix[self.order[self.begin[a:b]]]
        lcp, size = self.lcp[a:b], self.size[a:b]
        sent = (tail >= lcp[:, None]) & (tail < size[:, None])
        return np.stack([np.minimum(lcp, size), size, rows[:, -1]], 1).tobytes() + rows[sent].tobytes()


def runs(chunks: DataFrame, bits: int) -> DataFrame:
    """(r, chunk, n, coded, ids): every chunk's sorted, front-coded suffixes for each range, each once with the least and greatest id it has there."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for chunk, ids, blob, sizes, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf, begins = opened(blob, sizes)
                first, last, at, h, doc = suffixes(buf, begins, codes)
                if len(h):
                    got = Arranged(buf, first, last, at, h, bits)
                    id_ = np.frombuffer(ids, np.int64)[doc[got.order]]
                    least, most = np.minimum.reduceat(id_, got.begin), np.maximum.reduceat(id_, got.begin)
                    some = [(r, a, b) for r, (a, b) in enumerate(zip(got.cut.tolist(), got.cut[1:].tolist(), strict=False)) if b > a]
                    coded = [squeeze.compress(got.coded(a, b)) for _, a, b in some]
                    bounds = [squeeze.compress(least[a:b].tobytes() + (most[a:b] - least[a:b]).tobytes()) for _, a, b in some]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([chunk] * len(some)), pa.array([b - a for _, a, b in some], pa.int32()), pa.array(coded, pa.binary()), pa.array(bounds, pa.binary())], ["r", "chunk", "n", "coded", "ids"])
                    del got, id_, least, most, coded, bounds
                del buf, first, last, at, h, doc
                give_back()

    schema = "r int, chunk string, n int, coded binary, ids binary"
    return chunks.select("chunk", "ids", "blob", "sizes", "codes").mapInArrow(lean(send), schema)


class Run:
    """A front-coded run: common prefix lengths, strings, and the least and greatest id of each."""

    def __init__(self, n: int, coded: bytes, ids: bytes) -> None:
        head = np.frombuffer(coded, np.uint8, 3 * n).reshape(n, 3)
        self.lcp, self.right = head[:, 0].tolist(), head[:, 2].tolist()
        ends = np.cumsum(head[:, 1].astype(np.int64) - head[:, 0]) + 3 * n
        self.strings, before, at = [], b"", 3 * n
        for common, end in zip(self.lcp, ends.tolist(), strict=True):
            before = before[:common] + coded[at:end]
            self.strings.append(before)
            at = end
        least = np.frombuffer(ids, np.int64, n)
        self.least, self.most = least.tolist(), (least + np.frombuffer(ids, np.int64, n, 8 * n)).tolist()


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree before ``at``."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - ((x.bit_length() + 7) >> 3)


def merged(all_runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the string before) in sorted order.

    A loser tree: every node keeps the run that lost there and the prefix it
    shares with the winner. A string that shares more with the last winner than
    a loser does is smaller without a look at either; only equal lengths are
    compared, from that length on (Ng and Kakehi 2008; Bingmann et al. 2017).
    """
    k = 1
    while k < len(all_runs):
        k *= 2
    strings = [r.strings for r in all_runs] + [[]] * (k - len(all_runs))
    lcps = [r.lcp for r in all_runs] + [[]] * (k - len(all_runs))
    size = [len(s) for s in strings]
    at = [0] * k
    loser, shared = [0] * k, [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if at[b] >= size[b]:
            win, lose, common = a, b, -1
        elif at[a] >= size[a]:
            win, lose, common = b, a, -1
        else:
            x, y = strings[a][at[a]], strings[b][at[b]]
            common = common_prefix(x, y, 0)
            win, lose = (a, b) if x <= y else (b, a)
        loser[node], shared[node] = lose, common
        return win

    win, h = play(1), 0
    while at[win] < size[win]:
        yield win, at[win], h
        at[win] += 1
        i = at[win]
        h = lcps[win][i] if i < size[win] else -1
        node = (win + k) >> 1
        while node:
            other = shared[node]
            if other > h:
                win, loser[node] = loser[node], win
                shared[node], h = h, other
            elif other == h and h >= 0:
                b = loser[node]
                x, y = strings[win][at[win]], strings[b][at[b]]
                common = common_prefix(x, y, h)
                if x > y:
                    loser[node], win = win, b
                shared[node] = common
            node >>= 1


def covered(all_runs: list[Run]) -> list[list[tuple[int, int, int, int]]]:
    """Per run: (index, first, last string covered, smallest id), for strings that also start in a document with that id."""
    out: list[list] = [[] for _ in all_runs]

    def close(group: list[list[tuple[int, int]]]) -> None:
        """``group``: distinct stretches under one K-gram, each with the runs that hold it."""
        if len(group) == 1:
            same = group[0]
            least = min(all_runs[r].least[i] for r, i in same)
            for r, i in same:
                run = all_runs[r]
                if run.most[i] > least:
                    out[r].append((i, 0, len(run.strings[i]) - HASH_BYTES - LENGTH, least))
            return
        smallest: dict[tuple[int, bytes], int] = {}
        keys = []
        for same in group:
            r, i = same[0]
            s, right = all_runs[r].strings[i], all_runs[r].right[i] + HASH_BYTES
            suffix, left = s[HASH_BYTES:right], s[right:]
            whole, n = left + suffix, len(left)
            least = min(all_runs[r].least[i] for r, i in same)
            own = [(n - t, whole[t : t + LENGTH]) for t in range(len(whole) - LENGTH + 1)]
            for key in own:
                if smallest.get(key, NO_ID) >= least:
                    smallest[key] = least
            keys.append(own)
        for same, own in zip(group, keys, strict=True):
            best = [smallest[key] for key in own]
            t = 0
            while t < len(best):
                u = t
                while u + 1 < len(best) and best[u + 1] == best[t]:
                    u += 1
                for r, i in same:
                    if all_runs[r].most[i] > best[t]:
                        out[r].append((i, t, u, best[t]))
                t = u + 1

    group: list[list[tuple[int, int]]] = []
    before, before_right = b"", -1
    for r, i, h in merged(all_runs):
        s, right = all_runs[r].strings[i], all_runs[r].right[i]
        if h < HASH_BYTES + K:
            if group:
                close(group)
            group = [[(r, i)]]
        elif h == len(s) == len(before) and right == before_right:
            group[-1].append((r, i))
        else:
            group.append([(r, i)])
        before, before_right = s, right
    if group:
        close(group)
    return out


def covers(run_rows: DataFrame) -> DataFrame:
    """(chunk, covers): per range, which of a chunk's suffixes there have strings to cut, and from which id on."""

    def merge(table: pa.Table) -> pa.Table:
        opener, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        all_runs = [Run(n, opener.decompress(c), opener.decompress(p)) for n, c, p in zip(*(table[x].to_pylist() for x in ("n", "coded", "ids")), strict=True)]
        found = [squeeze.compress(np.array(x, np.int64).T.tobytes()) if x else None for x in covered(all_runs)]
        del all_runs
        give_back()
        return pa.table({"chunk": table["chunk"], "r": table["r"], "found": pa.array(found, pa.binary())})

    met = run_rows.groupBy("r").applyInArrow(merge, "chunk string, r int, found binary").where("found IS NOT NULL")
    return met.groupBy("chunk").agg(F.collect_list(F.struct("r", "found")).alias("covers"))


def spans_of(buf: np.ndarray, begins: np.ndarray, ids: np.ndarray, codes: list[dict], found: list[dict], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal covered runs of a chunk begin and end, ascending; none crosses documents."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    opener = zstandard.ZstdDecompressor()
    first, last, at, h, doc = suffixes(buf, begins, codes)
    got = Arranged(buf, first, last, at, h, bits)
    del got.matrix
    starts, ends = [], []
    for f in found:
        i, t, u, least = np.frombuffer(opener.decompress(f["found"]), np.int64).reshape(4, -1)
        i = i + got.cut[f["r"]]
        n = got.end[i] - got.begin[i]
        row = got.order[np.repeat(got.begin[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        later = ids[doc[row]] > np.repeat(least, n)
        row, t, u = row[later], np.repeat(t, n)[later], np.repeat(u, n)[later]
        starts.append(first[row] + t)
        ends.append(first[row] + u + LENGTH)
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    opens = np.ones(len(start), bool)
    opens[1:] = start[1:] > end[:-1]
    edge = np.searchsorted(begins, start, "right")  # runs that touch where documents meet stay two
    opens[1:] |= edge[1:] != edge[:-1]
    opens = np.flatnonzero(opens)
    return start[opens], end[np.append(opens[1:], len(start)) - 1] if len(start) else end


def without_repeats(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", binary: bool = True, as_text: bool = True) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) and kept_text of each row.

    ``kept_text`` leaves out characters that were cut in two. Null texts are empty and stay null in both. Rows with equal ids never
    cut each other; a null id counts as larger than any. Texts under 50 bytes
    keep all. Repeated rows each get a row. ``binary`` and ``as_text`` turn those two columns
    to nulls where they aren't wanted.
    """
    chunks = written(packed_chunks(docs, keep, text_col, id_col), "suffix-chunks")
    bits = range_bits(chunks, RANGE_TEXT)
    codes = written(shared_kgrams(chunks, bits), "suffix-codes")
    some = chunks.join(codes, "chunk", "left")
    names = [f"k{i}" for i in range(len(keep))]
    rest = chunks.schema["rest"].dataType.elementType
    schema = T.StructType([*rest.fields, *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, sizes, ids, codes_, found, i in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), range(batch.num_rows), strict=True):
                buf, begins = opened(blob, sizes)
                start, end = spans_of(buf, begins, np.frombuffer(ids, np.int64), codes_, found, bits)
                fields, null, raw = batch.column(3)[i].values, np.frombuffer(sizes, np.int64) < 0, buf.tobytes()
                del buf
                give_back()
                place = np.searchsorted(start, begins)
                total = np.concatenate(([0], np.cumsum(end - start)))
                removed, n_spans = np.diff(total[place]), np.diff(place)
                lo = 0
                while lo < len(null):  # some texts at a time
                    hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + OUT_BYTES, "right")) - 1)
                    kept = []
                    for d in range(lo, hi):
                        s, p, q = int(begins[d]), int(place[d]), int(place[d + 1])
                        around = [s, *(x for pair in zip(start[p:q].tolist(), end[p:q].tolist(), strict=True) for x in pair), int(begins[d + 1])]
                        kept.append(None if null[d] else b"".join(raw[a:b] for a, b in zip(around[::2], around[1::2], strict=True)))
                    n = hi - lo
                    yield pa.RecordBatch.from_arrays([
                        *(fields.field(j).slice(lo, n) for j in range(len(names))), pa.array(np.diff(begins[lo : hi + 1])), pa.array(removed[lo:hi]), pa.array(n_spans[lo:hi]),
                        pa.array([hashlib.sha256(k or b"").hexdigest() for k in kept]), pa.array(kept if binary else [None] * n, pa.binary()),
                        pa.array([None if k is None else k.decode("utf-8", "ignore") for k in kept] if as_text else [None] * n, pa.string())], schema.fieldNames())
                    lo = hi
                del raw, kept
                give_back()

    done = some.join(covers(runs(some, bits)), "chunk", "left").select("blob", "sizes", "ids", "rest", "codes", "covers").mapInArrow(lean(cut), schema)
    return done.select(*[F.col(a).alias(b) for a, b in zip(names, keep, strict=True)], *schema.fieldNames()[len(names):])


def op3(spark, sf_dir):
    d = without_repeats(read_table(spark, sf_dir, "documents"), ["doc_id"], binary=False, as_text=False)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from the text (and n_chars, if there is one, to match); a row of which nothing but white space is left goes."""
    names = docs.columns
    keep = [c for c in names if c != "text"]
    d = without_repeats(docs, keep, binary=False)
    d = d.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    at = {c: i for i, c in enumerate(keep)}
    return d.select(*[new[c].alias(c) if c in new and (c == "text" or c in at) else F.col(c) for c in names])


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, UNNEST(range(0, len(h) // 2 - 49)) AS p, h FROM d WHERE len(h) >= 100),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM w),
f AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT s.doc_id, s.p FROM s JOIN f USING (s) WHERE s.doc_id > f.least),
o AS (SELECT *, COALESCE(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, TRUE) AS opens FROM c),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM spans GROUP BY doc_id),
ends AS (SELECT doc_id, k, a, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM
         (SELECT doc_id, k, a, b FROM spans UNION ALL
          SELECT doc_id, 1000000000, (SELECT len(h) // 2 FROM d WHERE d.doc_id = cuts.doc_id), 0 FROM cuts)),
kept AS (SELECT e.doc_id, string_agg(substr(d.h, (2 * e.before + 1)::BIGINT, (2 * (e.a - e.before))::BIGINT), '' ORDER BY e.k) AS h FROM ends e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, COALESCE(cuts.n_removed, 0)::BIGINT AS n_removed, COALESCE(cuts.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(COALESCE(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
