"""XPointer and XInclude over collections of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions.uri import resolve, split
from xylem.operators.serialize import _children, escape_attribute, escape_text, serialize, start_tag, walked
from xylem.operators.storage import written
from xylem.plans.batches import Paths
from xylem.sources.batch import Batch, pieces_of
from xylem.sources.parser import parse

XI = "http://www.w3.org/2001/XInclude"
_NC = re.compile(r"[^\W\d][\w.\-·]*")
_PART = re.compile(r"\s*([^\s()]+)\(")


class PointerError(ValueError):
    pass


def pointer_parts(text: str) -> list[tuple[str, str]]:
    """(scheme, data) of a pointer; a bare name is a shorthand."""
    if _NC.fullmatch(text):
        return [("shorthand", text)]
    out, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise PointerError(text)
        depth, i, data = 1, m.end(), []
        while depth:
            if i >= len(text):
                raise PointerError(text)
            c = text[i]
            if c == "^":
                i += 1
                if i >= len(text) or text[i] not in "^()":
                    raise PointerError(text)
                c = text[i]
            else:
                depth += (c == "(") - (c == ")")
            if depth:
                data.append(c)
            i += 1
        out.append((m[1], "".join(data)))
        at = i
    if not out:
        raise PointerError(text)
    return out


def point(nodes: list, pointer: str) -> int | None:
    """The first node that a part of the pointer finds: names of ids, element() sequences."""
    for scheme, data in pointer_parts(pointer):
        at = None
        if scheme == "shorthand":
            at = by_id(nodes, data)
        elif scheme == "element":
            name, _, steps = data.partition("/")
            if name and not _NC.fullmatch(name) or not all(s.isdigit() and s[0] != "0" for s in steps.split("/") if steps) or data.endswith("/"):
                raise PointerError(pointer)
            at = by_id(nodes, name) if name else 0
            for s in steps.split("/") if steps else ():
                if at is None:
                    break
                children = [n[0] for n in nodes[at + 1 : at + nodes[at][1] + 1] if n[3] == at and n[4] == "element"]
                at = children[int(s) - 1] if int(s) <= len(children) else None
        if at is not None:
            return at
    return None


def by_id(nodes: list, name: str) -> int | None:
    return next((n[3] for n in nodes if n[12] and n[9] == name), None)


def sequence(pointer: str | None) -> list[int] | None:
    """The steps of a pointer that is one element() sequence from the root; None for any other."""
    m = re.fullmatch(r"\s*element\(((?:/[1-9][0-9]*)+)\)", pointer or "", re.ASCII)
    return [int(s) for s in m[1][1:].split("/")] if m else None


def pointed(docs: DataFrame, pointer_col: str, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(doc_id, pre, value, state): what each document's pointer finds; state is found, unresolvable or unparsable.
    Element sequences are followed in all plain documents at once, other pointers in one document after another."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("pre int, value string, state string").fields])

    def one(nodes, pointer):
        try:
            at = point(nodes, pointer or "")
        except PointerError:
            return None, None, "unparsable"
        if at is None:
            return None, None, "unresolvable"
        return at, "".join(n[9] or "" for n in nodes[at : at + nodes[at][1] + 1] if n[4] in ("text", "cdata")), "found"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces_of(batch):
                coded = part.column(2).dictionary_encode()
                steps = [sequence(x) for x in coded.dictionary.to_pylist()]
                code = pc.fill_null(coded.indices, -1).to_numpy()
                easy = np.array([s is not None for s in steps] + [False], bool)[code]  # null is the last
                b = Batch(part.column(0).filter(pa.array(easy)), part.column(1).filter(pa.array(easy)))
                code = code[easy][b.rows]
                p, found = Paths(b), np.full(b.n_plain, -1, np.int64)
                for c in np.unique(code[: b.n_plain]):
                    rows = np.flatnonzero(code[: b.n_plain] == c)
                    nodes = b.starts[rows]
                    for s in steps[c]:
                        at, nodes = p.step(np.arange(len(nodes)), nodes, "child", ("name", None, None), (("number", float(s)),))
                        rows = rows[at]
                    found[rows] = nodes
                some = np.flatnonzero(found >= 0)
                values = b.strings(found[some]).cast(pa.string())
                place = np.full(b.n_plain, -1, np.int64)
                place[some] = np.arange(len(some))
                none = place < 0
                yield pa.RecordBatch.from_arrays([
                    b.ids.slice(0, b.n_plain).cast(arrow.types[0]), pa.array(np.where(none, 0, found - b.starts[: b.n_plain]), pa.int32(), mask=none), values.take(pa.array(place, mask=none)),
                    pc.if_else(pa.array(none), "unresolvable", "found"),
                ], schema=arrow)
                texts = part.column(2).filter(pa.array(easy)).take(pa.array(b.rows[b.n_plain :])).to_pylist()
                rest = [(i, *one(x.nodes, t)) for i, x, t in zip(b.ids.slice(b.n_plain).to_pylist(), b.odd, texts, strict=True)]
                hard = part.filter(pa.array(~easy))
                rest += [(i, *one(parse(x).nodes, t)) for i, x, t in zip(*(c.to_pylist() for c in hard.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in rest], t) for i, t in enumerate(arrow.types)], schema=arrow)

    return docs.select(id_col, xml_col, pointer_col).mapInArrow(run, schema)


def edges(docs: DataFrame, id_col: str = "uri", xml_col: str = "xml") -> DataFrame:
    """(uri, pre, href, target, parse, xpointer, has_fallback): each include of each document, its target resolved against the base."""
    schema = T.StructType([T.StructField("uri", T.StringType()), *T._parse_datatype_string("pre int, href string, target string, parse string, xpointer string, has_fallback boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, *i) for u, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in includes(parse(x, base_uri=u).nodes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()))], schema.fieldNames())

    return docs.select(id_col, xml_col).mapInArrow(run, schema)


#: Attribute that an include brought in by another carries: what it was read from, innermost last. No document keeps it.
CHAIN = "xylem-chain"


def includes(nodes: list) -> list[tuple]:
    out = []
    for n in nodes:
        if n[4] == "element" and n[5] == XI and n[7] == "include":
            own = [m for m in nodes[n[0] + 1 : n[0] + n[1] + 1] if m[3] == n[0]]
            a = {m[7]: m[9] for m in own if m[4] == "attribute" and m[5] is None}
            out.append((n[0], a.get("href", ""), resolve(a.get("href", ""), n[13] or ""), a.get("parse", "xml"), a.get("xpointer"), any(m[4] == "element" and m[5] == XI and m[7] == "fallback" for m in own)))
    return out


def with_attributes(nodes: list, more: dict[int, dict[str, str]], at: int) -> str:
    """A subtree's text, with attributes set on some of its elements."""

    def tags(i: int) -> tuple[str, str]:
        start = start_tag(nodes, i)
        for name, value in more.get(i, {}).items():
            text, q = escape_attribute(value)
            start = re.sub(rf" {name}=(\"[^\"]*\"|'[^']*')", "", start)[:-1] + f" {name}={q}{text}{q}>"
        return start, f"</{nodes[i][8]}>"

    return walked(nodes, at, tags, lambda n: "" if n[4] == "doctype" else serialize([[0, 0, *n[2:]]]))


def brought(source: str, target: str, pointer: str | None, chain: list[str], base: str, lang: str | None) -> str | None:
    """What an include brings in: base and language fixed up where they differ, and its own includes told where they come from."""
    inner = parse(source, base_uri=target).nodes
    top = point(inner, pointer) if pointer else 0
    if top is None:
        return None
    more: dict[int, dict[str, str]] = {}
    for i in includes(inner):
        more.setdefault(i[0], {})[CHAIN] = " ".join(chain)
    roots = [top] if inner[top][4] == "element" else [n[0] for n in inner if n[3] == top and n[4] == "element"]
    for r in roots:
        if inner[r][13] != base:
            more.setdefault(r, {})["xml:base"] = inner[r][13] or ""
        if (inner[r][14] or "") != (lang or ""):
            more.setdefault(r, {})["xml:lang"] = inner[r][14] or ""
    return with_attributes(inner, more, top)


def spliced(xml: str, uri: str, found: dict[str, str | None]) -> tuple[str | None, str | None]:
    """(document with its includes replaced once, error). What is included is looked up by (target); inner includes stay for the next round."""
    nodes = parse(xml, base_uri=uri).nodes
    by_pre = {i[0]: i for i in includes(nodes)}
    errors: list[str] = []
    here = uri.replace(" ", "%20")

    def replaced(at: int) -> tuple[str, list[int]]:
        """An include's text, or what to copy in its place."""
        n = nodes[at]
        _, href, target, how, pointer, _ = by_pre[at]
        own = [m for m in nodes[at + 1 : at + n[1] + 1] if m[3] == at]
        given = {m[7]: m[9] for m in own if m[4] == "attribute" and m[5] is None}
        if split(href)[4]:
            errors.append(f"fragment in {href!r}")
        if not href and not pointer:
            errors.append("neither href nor xpointer")
        if how not in ("xml", "text"):
            errors.append(f"parse={how!r}")
        for name in ("accept", "accept-language"):
            if any(not " " <= c <= "~" for c in given.get(name, "")):
                errors.append(f"{name} isn't a header's value")
        chain = given[CHAIN].split(" ") if CHAIN in given else [here]
        step = (target if href else uri).replace(" ", "%20") + (f"#{pointer.replace(' ', '%20')}" if pointer else "")
        if how == "xml" and (step in chain or step == here):
            errors.append("includes itself")
            return "", []
        source = xml if not href else found.get(target)
        if source is not None:
            if how == "text":
                return escape_text(source), []
            up = nodes[n[3]]
            text = brought(source, target if href else uri, pointer, [*chain, step], up[13] or "", up[14])
            if text is not None:
                return text, []
        fall = [m for m in own if m[4] == "element" and m[7] == "fallback" and m[5] == XI]
        if len(fall) != 1:
            errors.append(f"{target!r} isn't there" if not fall else "more than one fallback")
            return "", []
        return "", [m[0] for m in nodes[fall[0][0] + 1 : fall[0][0] + fall[0][1] + 1] if m[3] == fall[0][0] and m[4] not in ("attribute", "namespace")]

    out: list[str] = []
    todo: list = [n[0] for n in reversed(nodes) if n[3] == 0 and n[4] != "doctype"]  # nodes to copy, and text that closes what is open
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif at in by_pre:
            text, instead = replaced(at)
            out.append(text)
            todo += reversed(instead)
        elif nodes[at][4] != "element":
            out.append(serialize([[0, 0, *nodes[at][2:]]]))
        else:
            out.append(start_tag(nodes, at))
            todo.append(f"</{nodes[at][8]}>")
            todo += [c for c in reversed([*_children(nodes, at)]) if nodes[c][4] not in ("attribute", "namespace")]
    return (None, errors[0]) if errors else ("".join(out), None)


def expanded(docs: DataFrame, resources: DataFrame, uri_col: str = "uri", xml_col: str = "xml") -> DataFrame:
    """(uri, xml, error): documents with all includes expanded. ``resources`` has (uri, xml).

    A round joins every document's targets to the resources and splices them in;
    it ends when no document has an include. Includes that were brought in know
    the chain of what they were read from, and one that leads back into it is an error,
    so chains of any length end. What is brought in gets xml:base and xml:lang
    where its own differ from those of the place.
    """
    now = docs.select(F.col(uri_col).cast("string").alias("uri"), F.col(xml_col).alias("xml"), F.lit(None).cast("string").alias("error"))
    have = resources.select(F.col("uri").alias("target"), F.col("xml").alias("source"))
    schema = "uri string, xml string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri, xml, error, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if error is None and xml is not None and "include" in xml:
                    text, error = spliced(xml, uri, {f["target"]: f["source"] for f in found or ()})
                    out.append((uri, text, error))
                else:
                    out.append((uri, xml, error))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], ["uri", "xml", "error"])

    while True:
        links = edges(now.where("error IS NULL"), "uri", "xml").select("uri", "target").distinct()
        if links.limit(1).count() == 0:
            return now
        found = links.join(have, "target").groupBy("uri").agg(F.collect_list(F.struct("target", "source")).alias("found"))
        now = written(now.join(found, "uri", "left").select("uri", "xml", "error", "found").mapInArrow(run, schema), "include")
