"""Nodes back to text: plain serialization, canonical XML, a checking writer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.sources.batch import ATTRIBUTE, ELEMENT, NAMESPACE, TEXT, Batch, per_batch, run_together
from xylem.sources.parser import parse

PRE, SIZE, LEVEL, PARENT, KIND, NS, PREFIX, LOCAL, QNAME, VALUE = range(10)


def escape_text(s: str) -> str:
    """Every special character as a decimal reference of two digits."""
    return "".join(f"&#{ord(c):02d};" if c in "\r\"&'<>" else c for c in s)


def escape_attribute(s: str) -> tuple[str, str]:
    """The value, and the quote that it needs least escaping in."""
    quote = "'" if '"' in s and "'" not in s else '"'
    return "".join(f"&#{ord(c):02d};" if c in ("\r", "&", "<", quote) else c for c in s), quote


def quoted(s: str) -> str:
    return f'"{s}"' if '"' not in s else f"'{s}'" if "'" not in s else '"' + s.replace('"', "&quot;") + '"'


def _children(nodes: list, at: int) -> Iterator[int]:
    i, end = at + 1, at + nodes[at][SIZE]
    while i <= end:
        yield i
        i += nodes[i][SIZE] + 1


def walked(nodes: list, at: int, tags, leaf) -> str:
    """Text of a subtree of any depth. ``tags`` gives an element's start and end, ``leaf`` any other node's text."""
    out: list[str] = []
    ends: list[tuple[int, str]] = []  # last node and end tag of each open element
    i, stop = at, at + nodes[at][SIZE]
    while i <= stop:
        while ends and i > ends[-1][0]:
            out.append(ends.pop()[1])
        n = nodes[i]
        if n[KIND] == "element":
            start, end = tags(i)
            out.append(start)
            ends.append((i + n[SIZE], end))
        elif n[KIND] not in ("document", "namespace", "attribute"):
            out.append(leaf(n))
        i += 1
    return "".join(out) + "".join(end for _, end in reversed(ends))


def start_tag(nodes: list, at: int) -> str:
    out = [f"<{nodes[at][QNAME]}"]
    for c in _children(nodes, at):
        m = nodes[c]
        if m[KIND] not in ("namespace", "attribute"):
            break
        value, q = escape_attribute(m[VALUE])
        name = m[QNAME] if m[KIND] == "attribute" else f"xmlns{':' + m[LOCAL] if m[LOCAL] else ''}"
        out.append(f" {name}={q}{value}{q}")
    return "".join(out) + ">"


def _leaf(n: list) -> str:
    kind = n[KIND]
    if kind == "text":
        return escape_text(n[VALUE])
    if kind == "cdata":
        return f"<![CDATA[{n[VALUE]}]]>"
    if kind == "comment":
        return f"<!--{n[VALUE]}-->"
    if kind == "pi":
        return f"<?{n[LOCAL]} {n[VALUE]}?>" if n[VALUE] else f"<?{n[LOCAL]}?>"
    return f"&{n[LOCAL]};" if kind == "entity_ref" else f"<!DOCTYPE {n[LOCAL]}>"


def serialize(nodes: list, at: int = 0) -> str:
    if nodes[at][KIND] in ("namespace", "attribute"):
        return ""
    return walked(nodes, at, lambda i: (start_tag(nodes, i), f"</{nodes[i][QNAME]}>"), _leaf)


_TEXT = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#xD;"}
_ATTRIBUTE = {"&": "&amp;", "<": "&lt;", '"': "&quot;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"}


def canonical(nodes: list, comments: bool = False) -> str:
    """Canonical XML of a whole document: 1.0 and 1.1 agree there."""
    scopes: dict[int, dict[str, str]] = {}

    def tags(at: int) -> tuple[str, str]:
        n, spaces, attrs = nodes[at], [], []
        for c in _children(nodes, at):
            m = nodes[c]
            if m[KIND] not in ("namespace", "attribute"):
                break
            (spaces if m[KIND] == "namespace" else attrs).append(m)
        scope = scopes.get(n[PARENT], {"": ""})
        new = {m[LOCAL]: m[VALUE] for m in spaces if scope.get(m[LOCAL]) != m[VALUE] and m[LOCAL] != "xml"}
        scopes[at] = scope | new if new else scope
        out = [f"<{n[QNAME]}"]
        for prefix in sorted(new):
            out.append(f' xmlns{":" + prefix if prefix else ""}="{"".join(_ATTRIBUTE.get(c, c) for c in new[prefix])}"')
        for m in sorted(attrs, key=lambda m: (m[NS] or "", m[LOCAL])):
            out.append(f' {m[QNAME]}="{"".join(_ATTRIBUTE.get(c, c) for c in m[VALUE])}"')
        return "".join(out) + ">", f"</{n[QNAME]}>"

    def leaf(n: list) -> str:
        if n[KIND] in ("text", "cdata"):
            return "".join(_TEXT.get(c, c) for c in n[VALUE])
        return _leaf(n) if n[KIND] == "pi" or (n[KIND] == "comment" and comments) else ""

    out: list[str] = []
    seen_root = False
    for c in _children(nodes, 0):
        kind = nodes[c][KIND]
        if kind == "element":
            out.append(walked(nodes, c, tags, leaf))
            seen_root = True
        elif text := leaf(nodes[c]) if kind in ("pi", "comment") else "":
            out += ["\n", text] if seen_root else [text, "\n"]
    return "".join(out)


class Writer:
    """Writes a document piece by piece; what is written must stay well-formed."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.open: list[str] = []
        self.in_tag = self.in_dtd = False

    def _content(self) -> None:
        if self.in_tag:
            self.out.append(">")
            self.in_tag = False

    def declaration(self, version="1.0", encoding=None, standalone=None):
        self.out.append(f'<?xml version="{version}"' + (f' encoding="{encoding}"' if encoding else "") + (f' standalone="{"yes" if standalone else "no"}"' if standalone is not None else "") + "?>")

    def start_dtd(self, name, public_id=None, system_id=None):
        where = f" PUBLIC {quoted(public_id)} {quoted(system_id)}" if public_id else f" SYSTEM {quoted(system_id)}" if system_id else ""
        self.out.append(f"<!DOCTYPE {name}{where} [")
        self.in_dtd = True

    def end_dtd(self):
        self.out.append("]>")
        self.in_dtd = False

    def element_decl(self, name, content):
        self.out.append(f"<!ELEMENT {name} {content}>")

    def attribute_decl(self, element, name, kind, default):
        self.out.append(f"<!ATTLIST {element} {name} {kind} {default}>")

    def internal_entity_decl(self, name, value):
        self.out.append(f"<!ENTITY {name} {quoted(value)}>")

    def external_entity_decl(self, name, system_id, public_id=None, notation=None):
        where = f"PUBLIC {quoted(public_id)} {quoted(system_id)}" if public_id else f"SYSTEM {quoted(system_id)}"
        self.out.append(f"<!ENTITY {name} {where}{f' NDATA {notation}' if notation else ''}>")

    def unparsed_entity_decl(self, name, system_id, notation, public_id=None):
        self.external_entity_decl(name, system_id, public_id, notation)

    def notation_decl(self, name, system_id=None, public_id=None):
        where = f"PUBLIC {quoted(public_id)}" + (f" {quoted(system_id)}" if system_id else "") if public_id else f"SYSTEM {quoted(system_id)}"
        self.out.append(f"<!NOTATION {name} {where}>")

    def start_element(self, name):
        self._content()
        self.open.append(name)
        self.out.append(f"<{name}")
        self.in_tag = True

    def start_element_ns(self, uri, prefix, local):
        self.start_element(f"{prefix}:{local}" if prefix else local)

    def attribute(self, name, value):
        if not self.in_tag:
            raise ValueError("an attribute outside a start tag")
        text, q = escape_attribute(value)
        self.out.append(f" {name}={q}{text}{q}")

    def attribute_ns(self, uri, prefix, local, value):
        self.attribute(f"{prefix}:{local}" if prefix else local, value)

    def namespace_decl(self, prefix, uri):
        self.attribute(f"xmlns:{prefix}" if prefix else "xmlns", uri)

    def end_element(self):
        name = self.open.pop()
        self._content()
        self.out.append(f"</{name}>")

    def characters(self, text):
        self._content()
        self.out.append(escape_text(text))

    def cdata(self, text):
        self._content()
        self.out.append(f"<![CDATA[{text}]]>")

    def comment(self, text):
        self._content()
        self.out.append(f"<!--{text}-->")

    def processing_instruction(self, target, data=None):
        self._content()
        self.out.append(f"<?{target}{' ' + data if data else ''}?>")

    def general_entity_reference(self, name):
        self._content()
        self.out.append(f"&{name};")

    def parameter_entity_reference(self, name):
        self.out.append(f"%{name};")

    def finish(self) -> str:
        while self.open:
            self.end_element()
        text = "".join(self.out)
        if bad := [e for e in parse(text).errors if e[0] == "fatal error"]:
            raise ValueError(f"not well-formed: {bad[0][5]}")
        return text


def texts(docs: DataFrame, how: str, id_col: str = "doc_id", xml_col: str = "xml", comments: bool = False) -> DataFrame:
    """(doc_id, text) of each document, ``how``: serialize or canonical; null if malformed."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def one(xml):
        p = parse(xml, coalescing=how != "serialize")
        if any(e[0] == "fatal error" for e in p.errors):
            return None
        return canonical(p.nodes, comments) if how == "canonical" else serialize(p.nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col), F.col(xml_col)).mapInArrow(run, schema)


def serialized_nodes(nodes: DataFrame) -> DataFrame:
    """(doc_id, xml) from a node table; the rows of one document meet in one task, as its text does."""
    schema = T.StructType([T.StructField("doc_id", nodes.schema["doc_id"].dataType), T.StructField("xml", T.StringType())])
    names = ["pre", "size", "level", "parent", "kind", "ns", "prefix", "local", "qname", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], schema_type), pa.array([serialize(held)])], ["doc_id", "xml"])

        for b in batches:
            schema_type = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != now:
                    yield done()
                    held = []
                now = row[0]
                held.append(list(row[1:]))
        if held:
            yield done()

    return nodes.select("doc_id", *names).repartition("doc_id").sortWithinPartitions("doc_id", "pre").mapInArrow(run, schema)


def _plain_texts(b: Batch) -> pa.Array:
    """Text of a batch's plain documents: three pieces a node, and an end tag behind the last node of each element."""
    n = int(b.starts[b.n_plain])
    kind, name, rows = b.kind[:n], b.name[:n], np.arange(n)
    inner = (kind == ATTRIBUTE) | (kind == NAMESPACE)
    last = np.ones(n, bool)  # of a start tag
    last[:-1] = ~inner[1:]
    qnames = [(q or "") if k != "xmlns" else f"xmlns{':' + p if p else ''}" for *_, p, q in b.names for k in ("", "xmlns")]
    n_names = len(b.names)
    markup = ["", ">", '"', '">', *(f"<{q}" for q in qnames[::2]), *(f"</{q}>" for q in qnames[::2]), *(f' {q}="' for q in qnames[::2]), *(f' {q}="' for q in qnames[1::2])]
    lead = np.select([kind == ELEMENT, kind == ATTRIBUTE, kind == NAMESPACE], [4 + name, 4 + 2 * n_names + name, 4 + 3 * n_names + name], 0)
    tail = np.where(kind == ELEMENT, np.where(last, 1, 0), np.where(inner, np.where(last, 3, 2), 0))
    held = np.flatnonzero(inner | (kind == TEXT))
    values = b.pool.take(pa.array(b.value[:n][held]))
    is_text = kind[held] == TEXT
    hard = np.flatnonzero(pc.match_substring_regex(values, "[\\r\"&'<>]").to_numpy(zero_copy_only=False))
    body = np.full(n, len(values), np.int64)
    body[held] = np.arange(len(held))
    extra: list[str] = []
    for i, v in zip(hard.tolist(), values.take(pa.array(hard)).to_pylist(), strict=True):
        text, quote = (escape_text(v), '"') if is_text[i] else escape_attribute(v)
        g = held[i]
        if quote == "'":  # its quotes go with its text
            text = f"{text}'" + (">" if last[g] else "")
            tail[g] = 0
            extra.append(markup[lead[g]][:-1] + "'" + text)
            lead[g] = 0
        else:
            extra.append(text)
        body[g] = len(values) + len(markup) + len(extra) - 1
    pool = pa.concat_arrays([values, pa.array([*markup, *extra], pa.large_string())])
    elements = np.flatnonzero(kind == ELEMENT)
    end = elements + b.size[elements]
    order = np.lexsort((-elements, end))
    elements, end = elements[order], end[order]
    slot = 3 * rows + np.searchsorted(end, rows)
    where = np.zeros(3 * n + len(elements), np.int64)
    where[slot], where[slot + 1], where[slot + 2] = lead + len(values), body, tail + len(values)
    where[slot[end] + 3 + np.arange(len(end)) - np.searchsorted(end, end)] = len(values) + 4 + n_names + name[elements]
    cuts = slot[b.starts[: b.n_plain]] if n else np.zeros(0, np.int64)
    return run_together(pool.take(pa.array(where)), np.concatenate([cuts, [len(where)]]))


def serialized(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(doc_id, xml) of each well-formed document from its nodes; ``serialized_nodes`` where there is a table of them."""

    def run(b: Batch):
        texts = [serialize(p.nodes) for p in b.odd if not any(e[0] == "fatal error" for e in p.errors)]
        return np.flatnonzero(np.diff(b.starts)), [pa.concat_arrays([_plain_texts(b).cast(pa.string()), pa.array(texts, pa.string())])]

    return per_batch(docs, run, "xml string", id_col, xml_col)
