"""DTD validity of each document: one row a violated constraint."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions.xsd import LEXICAL
from xylem.operators.serialize import escape_attribute, escape_text, serialize
from xylem.sources.batch import ATTRIBUTE, ELEMENT, TEXT, Batch, pieces_of
from xylem.sources.parser import Parser, parse
from xylem.sources.shred import per_document

_NMTOKEN, _NAME = re.compile(LEXICAL["NMTOKEN"]), re.compile(LEXICAL["Name"])
_EMPTY, _ANY, _MIXED, _NAME_TYPE, _CHOICE, _SEQ = 1, 2, 3, 4, 5, 6
_TIMES = ("", "?", "*", "+")


class ContentModel:
    """A content model as its positions (Glushkov): which may come first and last, and which may follow each."""

    def __init__(self, model) -> None:
        self.names: list[str] = []
        self.follow: list[set[int]] = []
        self.empty, self.first, self.last = self._of(model)

    def _of(self, model) -> tuple[bool, set[int], set[int]]:
        kind, times, name, children = model
        if kind == _NAME_TYPE:
            at = len(self.names)
            self.names.append(name)
            self.follow.append(set())
            empty, first, last = False, {at}, {at}
        elif kind in (_CHOICE, _MIXED):
            parts = [self._of(c) for c in children]
            empty, first, last = any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        else:
            empty, first, last = True, set(), set()
            for e, f, l in map(self._of, children):
                for x in last:
                    self.follow[x] |= f
                first, last = first | f if empty else first, last | l if e else l
                empty = empty and e
        repeats = _TIMES[times] in ("*", "+") or kind == _MIXED
        if repeats:
            for x in last:
                self.follow[x] |= first
        return empty or kind == _MIXED or _TIMES[times] in ("?", "*"), first, last

    def allows(self, names: list[str]) -> bool:
        """Every name moves a set of positions on; nothing is tried twice."""
        now: set[int] | None = None
        for n in names:
            may = self.first if now is None else set().union(*(self.follow[x] for x in now))
            now = {x for x in may if self.names[x] == n}
            if not now:
                return False
        return self.empty if now is None else bool(now & self.last)

    def deterministic(self) -> bool:
        return all(len(x) == len({self.names[i] for i in x}) for x in [self.first, *self.follow])


def violations(p: Parser) -> list[tuple[str, str]]:
    """(constraint, what) of a parsed document; none without a document type declaration."""
    if any(e[0] == "fatal error" for e in p.errors) or p.dtd.name is None:
        return []
    return declared_violations(p) + element_violations(p, [n for n in p.nodes if n[4] == "element"]) + [("notation declared", name) for name, (_, _, _, notation) in p.dtd.entities.items() if notation and notation not in p.dtd.notations]


def declared_violations(p: Parser) -> list[tuple[str, str]]:
    """Those of the declarations, and of the root's type."""
    out: list[tuple[str, str]] = [(f"unique {kind} declaration", name) for kind, name in p.dtd.repeated]
    elements = [n for n in p.nodes if n[4] == "element"]
    if elements and elements[0][8] != p.dtd.name:
        out.append(("root element type", elements[0][8]))
    for e, attrs in p.dtd.attributes.items():
        ids = [a for a, (kind, _, _) in attrs.items() if kind == "ID"]
        if len(ids) > 1:
            out.append(("one ID per element type", e))
        for a, (kind, default, required) in attrs.items():
            if kind == "ID" and default is not None:
                out.append(("ID attribute default", f"{e}/{a}"))
            if kind.startswith(("(", "NOTATION")):
                names = re.findall(r"[^()|\s]+", kind.removeprefix("NOTATION"))
                if len(names) != len(set(names)):
                    out.append(("no duplicate tokens", f"{e}/{a}"))
            if default is not None and not fits(kind, default, p):
                out.append(("attribute default value", f"{e}/{a}"))
        if sum(kind.startswith("NOTATION") for kind, _, _ in attrs.values()) > 1:
            out.append(("one notation per element type", e))
        if any(kind.startswith("NOTATION") for kind, _, _ in attrs.values()) and p.dtd.elements.get(e, (0,))[0] == _EMPTY:
            out.append(("no notation on empty element", e))
    models = {e: ContentModel(m) for e, m in p.dtd.elements.items() if m[0] not in (_EMPTY, _ANY)}
    for e, m in p.dtd.elements.items():
        if m[0] == _MIXED and len(models[e].names) != len(set(models[e].names)):
            out.append(("no duplicate types", e))
        elif m[0] not in (_EMPTY, _ANY, _MIXED) and not models[e].deterministic():
            out.append(("deterministic content model", e))
    return out


def element_violations(p: Parser, elements: list) -> list[tuple[str, str]]:
    """Those of some elements, in document order; identifiers are held against each other among these."""
    out: list[tuple[str, str]] = []
    models = {e: ContentModel(m) for e, m in p.dtd.elements.items() if m[0] not in (_EMPTY, _ANY)}
    seen: set[str] = set()
    refs: list[str] = []
    children: dict[int, list] = {}
    for n in p.nodes:
        children.setdefault(n[3], []).append(n)
    for n in elements:
        own = children.get(n[0], [])
        model = p.dtd.elements.get(n[8])
        inner = [m for m in own if m[4] in ("element", "text", "cdata", "comment", "pi", "entity_ref")]
        if model is None:
            out.append(("element declared", n[8]))
        elif model[0] == _EMPTY:
            if inner:
                out.append(("element valid", n[8]))
        elif model[0] != _ANY:
            text = any(m[4] in ("text", "cdata") and (m[9].strip(" \t\r\n") or m[4] == "cdata") for m in inner)
            if (text and model[0] != _MIXED) or not models[n[8]].allows([m[8] for m in inner if m[4] == "element"]):
                out.append(("element valid", n[8]))
        declared = p.dtd.attributes.get(n[8], {})
        given = {m[8]: m for m in own if m[4] == "attribute"}
        for a, (_, default, required) in declared.items():
            if required and default is None and a not in given and not (a == "xmlns" or a.startswith("xmlns:")):
                out.append(("required attribute", f"{n[8]}/{a}"))
            if required and default is not None and a in given and given[a][9] != default:
                out.append(("fixed attribute default", f"{n[8]}/{a}"))
        for a, m in given.items():
            if a not in declared:
                out.append(("attribute declared", f"{n[8]}/{a}"))
                continue
            kind, value = declared[a][0], m[9]
            if not fits(kind, value, p):
                out.append(("enumeration" if kind.startswith("(") else "notation attributes" if kind.startswith("NOTATION") else f"{kind} value", f"{n[8]}/{a}"))
            elif kind == "ID":
                if value in seen:
                    out.append(("ID unique", value))
                seen.add(value)
            elif kind in ("IDREF", "IDREFS"):
                refs += value.split()
            if p.standalone and not m[11]:
                out.append(("standalone", f"{n[8]}/{a}")) if p.dtd.system_id else None
    out += [("IDREF", r) for r in refs if r not in seen]
    return out


def fits(kind: str, value: str, p: Parser) -> bool:
    if kind.startswith(("(", "NOTATION")):
        return value in re.findall(r"[^()|\s]+", kind.removeprefix("NOTATION"))
    words = value.split()
    if kind in ("IDREFS", "ENTITIES", "NMTOKENS"):
        return bool(words) and all(fits(kind[:-1] if kind != "ENTITIES" else "ENTITY", w, p) for w in words)
    if kind == "NMTOKEN":
        return _NMTOKEN.fullmatch(value) is not None
    if kind in ("ID", "IDREF", "ENTITY"):
        return _NAME.fullmatch(value) is not None and (kind != "ENTITY" or bool(p.dtd.entities.get(value, (None,) * 4)[3]))
    return True


#: A document type declaration that adds no text, default of other form or entity: element and attribute declarations alone.
_SIMPLE = re.compile(r"<!DOCTYPE[ \t\n]+[A-Za-z_][\w.\-]*[ \t\n]*\[(?:<!(?:ELEMENT|ATTLIST)[ \t\n][^<>%&\[\]]*>|[ \t\n])*\]>", re.ASCII)
#: Declarations that batches read apart from their documents, at most; documents with others are read one by one.
_MOST = 16


class Declared:
    """Validity of plain documents that begin with the same declaration. What is wrong in a subtree follows from its names and from whether its
    attributes fit and its texts hold more than space; so it is found once, by a document of that subtree alone, for all that agree."""

    #: Bytes of remembered subtrees at most; then all are forgotten.
    MOST = 64_000_000

    def __init__(self, head: str) -> None:
        self.head, self.memo, self.held = head, {}, 0
        self.p = parse(f"{head}<x/>")
        self.names: dict[tuple, int] = {}
        declared = self.p.dtd.attributes.items()
        # identifiers and entities hold over a whole document: where one is given, it is read whole
        self.whole = {(e, a) for e, d in declared for a, (kind, _, _) in d.items() if kind.startswith(("ID", "ENTIT"))}
        self.apart = not any(e[0] == "fatal error" for e in self.p.errors) and not any(a.startswith("xml") or ((e, a) in self.whole and default is not None) for e, d in declared for a, (_, default, _) in d.items())

    def classes(self, b: Batch, n: int) -> np.ndarray:
        """Of each attribute whether it fits its type and whether it is its default; of each text whether it is only space."""
        kind, out = b.kind[:n], np.zeros(n, np.int64)
        text = np.flatnonzero(kind == TEXT)
        out[text] = pc.equal(pc.utf8_trim(b.pool.take(pa.array(b.value[text])), " \t\r\n"), "").to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(kind == ATTRIBUTE)
        key = b.name[b.parent[rows]].astype(np.int64) * len(b.names) + b.name[rows]
        for k in np.unique(key):
            kind_of, default, _ = self.p.dtd.attributes.get(b.names[k // len(b.names)][3], {}).get(b.names[k % len(b.names)][3], ("CDATA", None, False))
            if kind_of == "CDATA" and default is None:
                continue
            at = rows[key == k]
            coded = b.pool.take(pa.array(b.value[at])).dictionary_encode()
            each = []
            for v in coded.dictionary.to_pylist():
                v = v if kind_of == "CDATA" else " ".join(x for x in v.split(" ") if x)
                each.append(fits(kind_of, v, self.p) | (v == default) << 1)
            out[at] = np.array(each, np.int64)[coded.indices.to_numpy()]
        return out

    def violations(self, b: Batch) -> list[tuple]:
        """Of each plain document of a batch of bodies; None where it has to be read with its declaration."""
        n = int(b.starts[b.n_plain])
        if not n:
            return []
        if self.held > self.MOST:
            self.memo.clear()
            self.held = 0
        ids = np.array([self.names.setdefault(x, len(self.names)) for x in b.names], np.int64)
        attributes = np.flatnonzero(b.kind[:n] == ATTRIBUTE)
        broken = pc.match_substring_regex(b.pool.take(pa.array(b.value[attributes])), "[\\t\\n\\r]").to_numpy(zero_copy_only=False)
        if self.whole:
            given = np.unique(b.name[b.parent[attributes]].astype(np.int64) * len(b.names) + b.name[attributes], return_inverse=True)
            broken = broken | np.array([(b.names[k // len(b.names)][3], b.names[k % len(b.names)][3]) in self.whole for k in given[0]], bool)[given[1]]
        odd = set(b.doc[attributes[broken]].tolist())
        tokens = b.kind[:n].astype(np.int64) | self.classes(b, n) << 4 | b.size[:n] << 32
        tokens = np.stack([tokens, ids[b.name[:n]]], axis=1)
        root = b.starts[: b.n_plain] + 1
        tokens[root, 0] &= (1 << 32) - 1
        inner = np.flatnonzero((b.level[:n] == 2) & b.real[:n])
        first = np.searchsorted(inner, root)
        last = np.append(first[1:], len(inner))
        until = np.where(first < last, inner[np.minimum(first, len(inner) - 1)] if len(inner) else 0, root + b.size[root] + 1)
        brief = tokens[inner]  # the root's content: its children's kinds and names, and which texts are space
        brief[:, 0] = np.where(b.kind[inner] == TEXT, brief[:, 0] & 0xFF, b.kind[inner])
        data, words = tokens.tobytes(), brief.tobytes()
        ends, kinds = (inner + b.size[inner] + 1).tolist(), (b.kind[inner] == ELEMENT).tolist()
        inner = inner.tolist()
        out, memo = [], self.memo
        for i, (r, u, f, l) in enumerate(zip(root.tolist(), until.tolist(), first.tolist(), last.tolist(), strict=True)):
            if i in odd:
                out.append(None)
                continue
            key = (data[16 * r : 16 * u], words[16 * f : 16 * l])
            got = memo.get(key)
            if got is None:
                rows = b.node_rows(r, u)
                content = "".join(escape_text(b.strings(np.array([g])).to_pylist()[0]) if b.kind[g] == TEXT else f"<{b.names[b.name[g]][3]}/>" for g in inner[f:l])
                p = parse(f"{self.head}{self.tag(rows)}{content}</{rows[0][8]}>")
                got = memo[key] = (tuple(declared_violations(p)), tuple(element_violations(p, [m for m in p.nodes if m[4] == "element"][:1])))
                self.held += len(key[0]) + len(key[1])
            found = got[0] + got[1]
            for g in range(f, l):
                if kinds[g]:
                    key = data[16 * inner[g] : 16 * ends[g]]
                    got = memo.get(key)
                    if got is None:
                        rows = b.node_rows(inner[g], ends[g])
                        for m in rows:
                            m[0], m[3] = m[0] - (low := inner[g] - int(b.starts[b.doc[inner[g]]])), None if m[0] == low else m[3] - low
                        p = parse(f"{self.head}{serialize(rows)}")
                        got = memo[key] = tuple(element_violations(p, [m for m in p.nodes if m[4] == "element"]))
                        self.held += len(key)
                    found += got
            out.append(found)
        return out

    @staticmethod
    def tag(rows: list) -> str:
        out = [f"<{rows[0][8]}"]
        for m in rows[1:]:
            if m[4] in ("attribute", "namespace"):
                value, q = escape_attribute(m[9])
                name = m[8] if m[4] == "attribute" else f"xmlns{':' + m[7] if m[7] else ''}"
                out.append(f" {name}={q}{value}{q}")
        return "".join(out) + ">"


def validated(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> DataFrame:
    """(doc_id, constraint, what)"""
    if options:
        return per_document(docs, violations, "constraint string, what string", id_col, xml_col, options)
    heads: dict[str, Declared] = {}  # of one task
    kind = docs.schema[id_col].dataType
    full = T.StructType([T.StructField("doc_id", kind), T.StructField("constraint", T.StringType()), T.StructField("what", T.StringType())])

    def found(ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        """(id, constraint, what)"""
        left = np.arange(len(texts))
        while len(left):
            own = texts.take(pa.array(left))
            head = next((m[0] for x in own[:1].to_pylist() if x and (m := _SIMPLE.match(x))), None)
            if head is None or (head not in heads and len(heads) >= _MOST):
                take, bodies = np.arange(len(left)) == 0, None
            else:
                if head not in heads:
                    heads[head] = Declared(head)
                d = heads[head]
                take = pc.fill_null(pc.starts_with(own, head), False).to_numpy(zero_copy_only=False)
                bodies = pc.utf8_slice_codeunits(own.filter(pa.array(take)), len(head)) if d.apart else None
            part = left[take]
            if bodies is not None:
                b = Batch(ids.take(pa.array(part)), bodies)
                got = d.violations(b)
                for i, v in zip(b.ids.to_pylist(), got, strict=False):
                    for x in v or ():
                        yield (i, *x)
                part = np.concatenate([part[b.rows[[i for i, v in enumerate(got) if v is None]]], part[b.rows[b.n_plain :]]]).astype(np.int64)
            for i, x in zip(ids.take(pa.array(part)).to_pylist(), texts.take(pa.array(part)).to_pylist(), strict=True):
                for v in violations(parse(x)):
                    yield (i, *v)
            left = left[~take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            for part in pieces_of(batch):
                held = list(found(part.column(0), part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(arrow.types)], schema=arrow)

    return docs.select(F.col(id_col), F.col(xml_col)).mapInArrow(run, full)
