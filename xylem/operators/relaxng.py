"""RELAX NG: schemas in XML or compact syntax, validation by derivatives.

A schema is compiled on the driver to a pattern whose definitions are looked up
by name, and travels with the job. Validation follows Clark's derivatives: each
event turns the pattern into the pattern of what may still come. Patterns are
tuples; derivatives are remembered by pattern within a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from xylem.functions import xsd
from xylem.functions.uri import resolve
from xylem.operators.relaxng_checks import Checker, Restriction
from xylem.operators.relaxng_compact import Compact, CompactError
from xylem.sources import batch
from xylem.sources.batch import ATTRIBUTE, ELEMENT, Batch, per_batch
from xylem.sources.parser import parse

RNG = "http://relaxng.org/ns/structure/1.0"
XSD = "http://www.w3.org/2001/XMLSchema-datatypes"

EMPTY, NOT_ALLOWED, TEXT = ("empty",), ("notAllowed",), ("text",)


class SchemaError(ValueError):
    pass


def choice(a, b):
    return b if a == NOT_ALLOWED or a == b else a if b == NOT_ALLOWED else ("choice", a, b)


def group(a, b):
    return NOT_ALLOWED if NOT_ALLOWED in (a, b) else b if a == EMPTY else a if b == EMPTY else ("group", a, b)


def interleave(a, b):
    return NOT_ALLOWED if NOT_ALLOWED in (a, b) else b if a == EMPTY else a if b == EMPTY else ("interleave", a, b)


def one_or_more(a):
    return a if a in (NOT_ALLOWED, EMPTY) else ("oneOrMore", a)


def after(a, b):
    return NOT_ALLOWED if NOT_ALLOWED in (a, b) else ("after", a, b)


class Schema:
    """A start pattern and definitions. Patterns: empty, notAllowed, text, (choice|group|interleave|after, a, b),
    (oneOrMore|list, a), (data, library, type, parameters, except), (value, library, type, text), (attribute|element, names, a), (ref, name).
    Names: (name, ns, local), (any, except), (ns, uri, except), (or, a, b)."""

    def __init__(self, start, definitions: dict) -> None:
        self.start, self.definitions = start, definitions

    # Schema documents

    @classmethod
    def from_xml(cls, xml: str, resources: dict[str, str] | None = None, base: str = "") -> Schema:
        return _Loader(resources or {}).load(xml, base, False)

    @classmethod
    def from_compact(cls, text: str, resources: dict[str, str] | None = None, base: str = "") -> Schema:
        return _Loader(resources or {}).load(text, base, True)


_KINDS = {"group": group, "interleave": interleave, "choice": choice}


class _Loader:
    def __init__(self, resources: dict[str, str]) -> None:
        self.resources, self.scopes, self.definitions, self.grammars = resources, [], {}, 0
        self.reading: list[str] = []  # schemas that are being read, each from the one before

    def load(self, text: str, base: str, compact: bool) -> Schema:
        if base:
            self.reading.append(base)
        start = self.pattern(self.tree(text, base, compact))
        try:
            Checker(start, self.definitions).check()
        except Restriction as e:
            raise SchemaError(str(e)) from e
        return Schema(start, self.definitions)

    def tree(self, xml: str, base: str, compact: bool | None = None) -> dict:
        """A schema's root element; a name that ends in .rnc tells compact syntax where nothing else does."""
        if compact if compact is not None else base.endswith(".rnc"):
            try:
                return Compact(xml, base).tree
            except CompactError as e:
                raise SchemaError(str(e)) from e
        p = parse(xml, base_uri=base)
        if p.errors:
            raise SchemaError(p.errors[0][5])
        nodes = p.nodes
        scopes: dict[int, dict] = {}
        built: dict[int, dict] = {}
        root = None
        for n in nodes:
            if n[4] == "element":
                up = scopes.get(n[3], {})
                scopes[n[0]] = dict(up)
                e = {"ns": n[5], "name": n[7], "attrs": {}, "children": [], "text": n[9] or "", "scope": scopes[n[0]], "base": n[13] or base}
                built[n[0]] = e
                if n[3] in built:
                    if n[5] == RNG:
                        built[n[3]]["children"].append(e)
                elif root is None:
                    root = e
            elif n[4] == "namespace":
                scopes[n[3]][n[7]] = n[9]
            elif n[4] == "attribute" and n[5] is None:
                built[n[3]]["attrs"][n[7]] = n[9] if n[7] == "datatypeLibrary" else n[9].strip() if n[7] in ("name", "type", "combine") else n[9]
        if root is None or root["ns"] != RNG:
            raise SchemaError("no RELAX NG element")
        return self.inherit(root, "", "")

    def inherit(self, e: dict, ns: str, library: str) -> dict:
        e["nsuri"] = ns = e["attrs"].get("ns", ns)
        e["library"] = library = e["attrs"].get("datatypeLibrary", library)
        for c in e["children"]:
            self.inherit(c, ns, library)
        return e

    def document(self, xml: str, base: str):
        return self.pattern(self.tree(xml, base))

    def fetch(self, e: dict) -> tuple[str, str]:
        uri = resolve(e["attrs"]["href"], e["base"])
        if uri not in self.resources:
            raise SchemaError(f"no resource {uri!r}")
        if uri in self.reading:
            raise SchemaError(f"{uri!r} refers to itself")
        return self.resources[uri], uri

    def all(self, es: list[dict], join=group):
        if not es:
            raise SchemaError("a pattern is missing")
        out = self.pattern(es[0])
        for e in es[1:]:
            out = join(out, self.pattern(e))
        return out

    def pattern(self, e: dict):
        k, a, c = e["name"], e["attrs"], e["children"]
        if k in ("element", "attribute"):
            if "name" in a:
                names, rest = self.qname(a["name"], e, k == "attribute"), c
            else:
                if not c:
                    raise SchemaError(f"{k} has no name")
                names, rest = self.names(c[0]), c[1:]
            body = self.all(rest) if rest else TEXT if k == "attribute" else None
            if body is None:
                raise SchemaError("an element has no pattern")
            if k == "element":
                self.grammars += 1
                key = f"element {self.grammars}"
                self.definitions[key] = ("element", names, body)
                return ("ref", key)
            return ("attribute", names, body)
        if k in _KINDS:
            return self.all(c, _KINDS[k])
        if k == "optional":
            return choice(self.all(c), EMPTY)
        if k == "zeroOrMore":
            return choice(one_or_more(self.all(c)), EMPTY)
        if k == "oneOrMore":
            return one_or_more(self.all(c))
        if k == "mixed":
            return interleave(TEXT, self.all(c))
        if k == "list":
            return ("list", self.all(c))
        if k in ("empty", "notAllowed", "text"):
            return (k,)
        if k == "data":
            params = tuple((p["attrs"]["name"], p["text"]) for p in c if p["name"] == "param")
            without = [self.all(x["children"], choice) for x in c if x["name"] == "except"]
            self.type_of(e["library"], a.get("type", ""), params)
            return ("data", e["library"], a["type"], params, without[0] if without else None)
        if k == "value":
            return ("value", e["library"] if "type" in a else "", a.get("type", "token"), e["text"], e["nsuri"])
        if k == "externalRef":
            text, uri = self.fetch(e)
            self.reading.append(uri)
            out = self.document(text, uri)
            self.reading.pop()
            return out
        if k == "ref":
            return ("ref", f"{self.scopes[-1]} {a['name']}")
        if k == "parentRef":
            if len(self.scopes) < 2:
                raise SchemaError("parentRef has no parent")
            return ("ref", f"{self.scopes[-2]} {a['name']}")
        if k == "grammar":
            return self.grammar(e)
        raise SchemaError(f"no pattern {k!r}")

    def grammar(self, e: dict):
        self.grammars += 1
        scope = f"grammar {self.grammars}"
        self.scopes.append(scope)
        parts: dict[str, list] = {}
        for name, how, part in self.components(e["children"]):
            parts.setdefault(name, []).append((how, part))
        used: dict[str, tuple] = {}
        for name, found in parts.items():
            hows = {h for h, _ in found if h}
            if len(hows) > 1 or sum(h is None for h, _ in found) > 1:
                raise SchemaError(f"{name!r} is defined more than once")
            out = None
            for _, part in found:
                p = self.all(part)
                out = p if out is None else (choice if hows == {"choice"} else interleave)(out, p)
            used[name] = out
        self.scopes.pop()
        for name, p in used.items():
            self.definitions[f"{scope} {name}"] = p
        if "start" not in used:
            raise SchemaError("a grammar has no start")
        return used["start"]

    def components(self, children: list[dict]) -> Iterator[tuple]:
        for c in children:
            if c["name"] == "start":
                yield "start", c["attrs"].get("combine"), c["children"]
            elif c["name"] == "define":
                yield c["attrs"]["name"], c["attrs"].get("combine"), c["children"]
            elif c["name"] == "div":
                yield from self.components(c["children"])
            elif c["name"] == "include":
                text, uri = self.fetch(c)
                self.reading.append(uri)
                inner = list(self.components(self.tree(text, uri)["children"]))
                self.reading.pop()
                own = list(self.components(c["children"]))
                names = {n for n, _, _ in own}
                if names - {n for n, _, _ in inner}:
                    raise SchemaError(f"include overrides what isn't there: {names}")
                yield from (x for x in inner if x[0] not in names)
                yield from own
            else:
                raise SchemaError(f"{c['name']!r} in a grammar")

    def qname(self, text: str, e: dict, attribute: bool):
        prefix, colon, local = text.partition(":")
        if colon:
            uri = "http://www.w3.org/XML/1998/namespace" if prefix == "xml" else e["scope"].get(prefix)
            if uri is None:
                raise SchemaError(f"unbound prefix {prefix!r}")
            return ("name", uri, local)
        return ("name", e["attrs"].get("ns", "") if attribute else e["nsuri"], text)

    def names(self, e: dict):
        k, c = e["name"], e["children"]
        if k == "name":
            return self.qname(e["text"].strip(), e, False)
        if k == "choice":
            out = self.names(c[0])
            for x in c[1:]:
                out = ("or", out, self.names(x))
            return out
        without = None
        for x in c:
            if x["name"] == "except":
                for y in x["children"]:
                    without = self.names(y) if without is None else ("or", without, self.names(y))
        if k == "anyName":
            return ("any", without)
        if k == "nsName":
            return ("ns", e["nsuri"], without)
        raise SchemaError(f"no name class {k!r}")

    @staticmethod
    def type_of(library: str, name: str, params) -> xsd.SimpleType:
        return datatype(library, name, params)


_FACETS = {"length", "minLength", "maxLength", "totalDigits", "fractionDigits"}


def datatype(library: str, name: str, params=()) -> xsd.SimpleType:
    if library == "":
        if name not in ("string", "token") or params:
            raise SchemaError(f"no datatype {name!r} with {params}")
        return xsd.builtin(name)
    if library != XSD:
        raise SchemaError(f"no datatype library {library!r}")
    try:
        t = xsd.builtin(name)
    except xsd.XsdError as e:
        raise SchemaError(str(e)) from e
    facets: dict = {}
    for k, v in params:
        if k in ("enumeration", "whiteSpace"):
            raise SchemaError(f"no parameter {k!r}")
        if k == "pattern":
            facets.setdefault("pattern", []).append(v)
        else:
            facets[k] = int(v) if k in _FACETS else v
    return t.restrict(**facets) if facets else t


class Validator:
    """Derivatives of one schema's patterns, remembered."""

    def __init__(self, schema: Schema) -> None:
        self.schema, self.memo, self.types = schema, {}, {}

    def of(self, p):
        while p[0] == "ref":
            p = self.schema.definitions.get(p[1], NOT_ALLOWED)
        return p

    def nullable(self, p) -> bool:
        p = self.of(p)
        k = p[0]
        if k in ("empty", "text"):
            return True
        if k == "choice":
            return self.nullable(p[1]) or self.nullable(p[2])
        if k in ("group", "interleave"):
            return self.nullable(p[1]) and self.nullable(p[2])
        return k == "oneOrMore" and self.nullable(p[1])

    def named(self, names, ns: str, local: str) -> bool:
        k = names[0]
        if k == "name":
            return names[1] == ns and names[2] == local
        if k == "or":
            return self.named(names[1], ns, local) or self.named(names[2], ns, local)
        if k == "any":
            return names[1] is None or not self.named(names[1], ns, local)
        return names[1] == ns and (names[2] is None or not self.named(names[2], ns, local))

    def type(self, *key) -> xsd.SimpleType:
        if key not in self.types:
            self.types[key] = datatype(*key)
        return self.types[key]

    def text(self, p, s: str):
        p = self.of(p)
        k = p[0]
        if k == "choice":
            return choice(self.text(p[1], s), self.text(p[2], s))
        if k == "interleave":
            return choice(interleave(self.text(p[1], s), p[2]), interleave(p[1], self.text(p[2], s)))
        if k == "group":
            x = group(self.text(p[1], s), p[2])
            return choice(x, self.text(p[2], s)) if self.nullable(p[1]) else x
        if k == "after":
            return after(self.text(p[1], s), p[2])
        if k == "oneOrMore":
            return group(self.text(p[1], s), choice(p, EMPTY))
        if k == "text":
            return p
        if k == "value":
            t = self.type(p[1], p[2], ())
            return EMPTY if t.is_valid(s) and xsd.compare(t.parse(s), t.parse(p[3])) == 0 else NOT_ALLOWED
        if k == "data":
            ok = self.type(p[1], p[2], p[3]).is_valid(s) and (p[4] is None or not self.nullable(self.text(p[4], s)))
            return EMPTY if ok else NOT_ALLOWED
        if k == "list":
            q = p[1]
            for word in s.split():
                q = self.text(q, word)
            return EMPTY if self.nullable(q) else NOT_ALLOWED
        return NOT_ALLOWED

    def after_each(self, f, p):
        if p[0] == "choice":
            return choice(self.after_each(f, p[1]), self.after_each(f, p[2]))
        return after(p[1], f(p[2])) if p[0] == "after" else NOT_ALLOWED

    def remembered(self, what, f, p, *key):
        k = (what, p, *key)
        if k not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[k] = f(p, *key)
        return self.memo[k]

    def open(self, p, ns: str, local: str):
        return self.remembered("open", self._open, p, ns, local)

    def _open(self, p, ns, local):
        p = self.of(p)
        k = p[0]
        if k == "choice":
            return choice(self.open(p[1], ns, local), self.open(p[2], ns, local))
        if k == "element":
            return after(p[2], EMPTY) if self.named(p[1], ns, local) else NOT_ALLOWED
        if k == "interleave":
            return choice(self.after_each(lambda q: interleave(q, p[2]), self.open(p[1], ns, local)), self.after_each(lambda q: interleave(p[1], q), self.open(p[2], ns, local)))
        if k == "oneOrMore":
            return self.after_each(lambda q: group(q, choice(p, EMPTY)), self.open(p[1], ns, local))
        if k == "group":
            x = self.after_each(lambda q: group(q, p[2]), self.open(p[1], ns, local))
            return choice(x, self.open(p[2], ns, local)) if self.nullable(p[1]) else x
        if k == "after":
            return self.after_each(lambda q: after(q, p[2]), self.open(p[1], ns, local))
        return NOT_ALLOWED

    def attribute(self, p, ns: str, local: str, value: str):
        p = self.of(p)
        k = p[0]
        if k == "after":
            return after(self.attribute(p[1], ns, local, value), p[2])
        if k == "choice":
            return choice(self.attribute(p[1], ns, local, value), self.attribute(p[2], ns, local, value))
        if k in ("group", "interleave"):
            f = group if k == "group" else interleave
            return choice(f(self.attribute(p[1], ns, local, value), p[2]), f(p[1], self.attribute(p[2], ns, local, value)))
        if k == "oneOrMore":
            return group(self.attribute(p[1], ns, local, value), choice(p, EMPTY))
        if k == "attribute":
            return EMPTY if self.named(p[1], ns, local) and self.matches(p[2], value) else NOT_ALLOWED
        return NOT_ALLOWED

    def matches(self, p, s: str) -> bool:
        return (self.nullable(p) and not s.strip(" \t\r\n")) or self.nullable(self.text(p, s))

    def close_tag(self, p):
        return self.remembered("close", self._close_tag, p)

    def _close_tag(self, p):
        p = self.of(p)
        k = p[0]
        if k == "after":
            return after(self.close_tag(p[1]), p[2])
        if k in ("choice", "group", "interleave"):
            return {"choice": choice, "group": group, "interleave": interleave}[k](self.close_tag(p[1]), self.close_tag(p[2]))
        if k == "oneOrMore":
            return one_or_more(self.close_tag(p[1]))
        return NOT_ALLOWED if k == "attribute" else p

    def end(self, p):
        if p[0] == "choice":
            return choice(self.end(p[1]), self.end(p[2]))
        return p[2] if p[0] == "after" and self.nullable(p[1]) else NOT_ALLOWED

    def errors(self, nodes: list) -> list[tuple[str, str]]:
        """(code, what) where the pattern allows nothing; validation goes on from the pattern before."""
        out: list[tuple[str, str]] = []
        root = next((n for n in nodes if n[4] == "element"), None)
        if root is None:
            return [("element", "")]
        p = self.walked(root, children_of(nodes), self.schema.start, out)
        if not out and not self.nullable(p):
            out.append(("incomplete", root[8]))
        return out

    def opened(self, p, n, own: list, out: list):
        """The pattern of an element's content, or None; and its children that are elements, with text between where both are."""
        name = n[8]
        p = self.open(p, n[5] or "", n[7])
        if p == NOT_ALLOWED:
            out.append(("element", name))
            return None, ()
        for a in own:
            if a[4] == "attribute":
                q = self.attribute(p, a[5] or "", a[7], a[9])
                if q == NOT_ALLOWED:
                    out.append(("attribute", f"{name}/{a[8]}"))
                else:
                    p = q
        q = self.close_tag(p)
        if q == NOT_ALLOWED:
            out.append(("missing attribute", name))
        else:
            p = q
        inner = [c for c in own if c[4] in ("element", "text", "cdata")]
        if any(c[4] == "element" for c in inner):
            return p, inner
        s = "".join(c[9] for c in inner)
        q = self.text(p, s)
        if not s.strip(" \t\r\n"):
            q = choice(p, q)
        if q == NOT_ALLOWED:
            out.append(("text", name))
        else:
            p = q
        return p, ()

    def closed(self, p, n, out: list):
        q = self.end(p)
        if q == NOT_ALLOWED:
            if not out or out[-1][1] != n[8]:
                out.append(("incomplete", n[8]))
            q = self.forced_end(p)
        return q

    def between(self, p, n, s: str, out: list):
        """After text between the elements in ``n``."""
        if s.strip(" \t\r\n"):
            q = self.text(p, s)
            if q == NOT_ALLOWED:
                out.append(("text", n[8]))
            else:
                return q
        return p

    def walked(self, root, children: dict[int, list], p, out: list):
        """The pattern after an element and all in it."""
        stack = [(None, iter([root]))]  # elements that are open, and what is left of their content
        while stack:
            n, rest = stack[-1]
            c = next(rest, None)
            if c is None:
                stack.pop()
                if n is not None:
                    p = self.closed(p, n, out)
            elif c[4] == "element":
                q, inner = self.opened(p, c, children.get(c[0], []), out)
                if q is not None:
                    p = q
                    stack.append((c, iter(inner)))
            else:
                p = self.between(p, n, c[9], out)
        return p

    def forced_end(self, p):
        if p[0] == "choice":
            return choice(self.forced_end(p[1]), self.forced_end(p[2]))
        return p[2] if p[0] == "after" else NOT_ALLOWED


def children_of(nodes: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for n in nodes:
        out.setdefault(n[3], []).append(n)
    return out


_SHORT = r"\A[0-9]{1,14}\z"
#: Datatypes of which short decimal numerals are told by their size alone: least and greatest, and whether a fraction is allowed.
_NUMERALS = {"double": (0, 1e15, True), "decimal": (0, 1e15, True), "integer": (0, 1e15, False), "long": (0, 1e15, False), "int": (0, 2147483647, False), "nonNegativeInteger": (0, 1e15, False), "positiveInteger": (1, 1e15, False)}
_BOUNDS = {"minInclusive": np.greater_equal, "maxInclusive": np.less_equal, "minExclusive": np.greater, "maxExclusive": np.less}


class Batches:
    """Validation of plain documents in batches. What a value does to a pattern follows from which of the schema's atoms (data, value, list)
    under its name it fits; so the errors of a subtree follow from its names and its values' classes, and are found once for all that agree."""

    #: Bytes of remembered subtrees at most; then all are forgotten.
    MOST = 64_000_000

    def __init__(self, schema: Schema) -> None:
        self.v, self.names, self.atoms = Validator(schema), {}, {}
        self.states: list[tuple] = []
        self.state_of: dict[tuple, int] = {}
        self.memo: dict[tuple, tuple] = {}
        self.held = 0

    def state(self, p, last) -> int:
        if (p, last) not in self.state_of:
            self.state_of[p, last] = len(self.states)
            self.states.append((p, last))
        return self.state_of[p, last]

    def atoms_of(self, kind: str, ns: str, local: str) -> list[tuple]:
        """The atoms that a value under this name can meet."""
        if (kind, ns, local) in self.atoms:
            return self.atoms[kind, ns, local]
        found: dict[tuple, None] = {}
        todo, seen = [self.v.schema.start, *self.v.schema.definitions.values()], set()
        inside: list = []
        while todo:
            p = todo.pop()
            if not isinstance(p, tuple) or p in seen:
                continue
            seen.add(p)
            if p[0] in ("element", "attribute"):
                if p[0] == kind and self.v.named(p[1], ns, local):
                    inside.append(p[2])
                todo.append(p[2])
            elif p[0] in ("choice", "group", "interleave", "oneOrMore"):
                todo += p[1:]
        seen.clear()
        while inside:
            p = self.v.of(inside.pop())
            if p in seen:
                continue
            seen.add(p)
            if p[0] in ("data", "value", "list"):
                found[p] = None
            elif p[0] in ("choice", "group", "interleave", "oneOrMore"):
                inside += p[1:]
        self.atoms[kind, ns, local] = list(found)
        return self.atoms[kind, ns, local]

    def fits(self, atom: tuple, s: pa.Array) -> np.ndarray:
        ok, left = np.zeros(len(s), bool), np.arange(len(s))
        if len(s) > 64 and atom[0] == "data" and atom[1] == XSD and atom[2] in _NUMERALS and atom[4] is None and all(k in _BOUNDS and re.fullmatch(r"[0-9]{1,7}(\.[0-9]{1,7})?", v) for k, v in atom[3]):
            low, high, fraction = _NUMERALS[atom[2]]
            short = pc.match_substring_regex(s, r"\A[0-9]{1,7}(\.[0-9]{1,7})?\z" if fraction else _SHORT).to_numpy(zero_copy_only=False)
            at, left = np.flatnonzero(short), np.flatnonzero(~short)
            x = pc.cast(s.take(pa.array(at)), pa.float64()).to_numpy()
            good = (x >= low) & (x <= high)
            for k, v in atom[3]:
                good &= _BOUNDS[k](x, float(v))
            ok[at] = good
        if len(left):
            coded = s.take(pa.array(left)).dictionary_encode()
            each = np.array([self.v.text(atom, x) != NOT_ALLOWED for x in coded.dictionary.to_pylist()], bool)
            ok[left] = each[coded.indices.to_numpy()]
        return ok

    def tokens(self, b: Batch, n: int) -> np.ndarray | None:
        """A number a node that tells its kind, name, size and value's class; None where the schema has too many names or atoms."""
        kind, name = b.kind[:n], b.name[:n].copy()
        text = np.flatnonzero(kind == batch.TEXT)
        name[text] = b.name[b.parent[text]]
        ids = np.array([self.names.setdefault((x[0], x[2]), len(self.names)) for x in b.names], np.int64)
        if len(self.names) > 4000:
            return None
        classes = np.zeros(n, np.int64)
        for of, rows in (("attribute", np.flatnonzero(kind == ATTRIBUTE)), ("element", text)):
            order = np.argsort(name[rows], kind="stable")
            rows = rows[order]
            cuts = [0, *(np.flatnonzero(np.diff(name[rows])) + 1).tolist(), len(rows)] if len(rows) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                at = rows[low:high]
                ns, _, local, _ = b.names[name[at[0]]]
                atoms, s = self.atoms_of(of, ns or "", local), b.pool.take(pa.array(b.value[at]))
                if len(atoms) > 14:
                    return None
                classes[at] = pc.equal(pc.utf8_trim(s, " \t\r\n"), "").to_numpy(zero_copy_only=False)
                for i, atom in enumerate(atoms, 1):
                    classes[at] |= self.fits(atom, s).astype(np.int64) << i
        return kind.astype(np.int64) | ids[name] << 4 | classes << 16 | b.size[:n] << 31

    def errors(self, b: Batch) -> list[list[tuple[str, str]]]:
        """Of each plain document."""
        n = int(b.starts[b.n_plain])
        if not n:
            return []
        tokens = self.tokens(b, n)
        if tokens is None:
            return [self.v.errors(b.node_rows(int(x), int(y))) for x, y in zip(b.starts[: b.n_plain], b.starts[1 : b.n_plain + 1], strict=True)]
        if self.held > self.MOST:
            self.memo.clear()
            self.states.clear()
            self.state_of.clear()
            self.held = 0
        # a root: its token without its size, its attributes, and its text where it has no element
        root = b.starts[: b.n_plain] + 1
        parts = np.flatnonzero((b.level[:n] == 2) & b.real[:n])
        has = np.zeros(n, bool)
        has[b.parent[parts[b.kind[parts] == ELEMENT]]] = True
        tokens[root] &= (1 << 31) - 1
        tokens[root] |= has[root].astype(np.int64) << 31
        first = np.searchsorted(parts, root)
        last = np.append(first[1:], len(parts))
        until = np.where(has[root] & (first < last), parts[np.minimum(first, max(len(parts) - 1, 0))] if len(parts) else 0, root + b.size[root] + 1)
        data, memo, ends = tokens.tobytes(), self.memo, (parts + b.size[parts] + 1).tolist()
        parts = parts.tolist()
        out = []
        for r, u, f, l, deep in zip(root.tolist(), until.tolist(), first.tolist(), last.tolist(), has[root].tolist(), strict=True):
            key = data[8 * r : 8 * u]
            got = memo.get(key)
            if got is None:
                got = memo[key] = self.started(b, r, u, deep)
                self.held += len(key)
            at, errors, n_root = got
            found = list(errors)
            if at is not None:
                for i in range(f, l if deep else f):
                    g, e = parts[i], ends[i]
                    key = (at, data[8 * g : 8 * e])
                    got = memo.get(key)
                    if got is None:
                        got = memo[key] = self.moved(b, g, e, at, n_root)
                        self.held += len(key[1])
                    at, errors = got
                    if errors:
                        found += errors
                key = (at, n_root[8])
                got = memo.get(key)
                if got is None:
                    p, before = self.states[at]
                    more = [before] if before else []
                    k = len(more)
                    p = self.v.closed(p, n_root, more)
                    got = memo[key] = (tuple(more[k:]), self.v.nullable(p))
                found += got[0]
                if not found and not got[1]:
                    found.append(("incomplete", n_root[8]))
            out.append(found)
        return out

    def started(self, b: Batch, r: int, u: int, deep: bool) -> tuple:
        rows = b.node_rows(r, u)
        own, out = rows[1:], []
        if deep:  # only that there is one matters
            own = [*own, [0, 0, 0, 0, "element", *[None] * 5]]
        p, _ = self.v.opened(self.v.schema.start, rows[0], own, out)
        return (None if p is None else self.state(p, out[-1] if out else None)), tuple(out), rows[0]

    def moved(self, b: Batch, g: int, e: int, at: int, n_root: list) -> tuple:
        rows = b.node_rows(g, e)
        p, before = self.states[at]
        out = [before] if before else []
        k = len(out)
        p = self.v.walked(rows[0], children_of(rows), p, out) if rows[0][4] == "element" else self.v.between(p, n_root, rows[0][9], out)
        return self.state(p, out[-1] if out else None), tuple(out[k:])


def validated(docs: DataFrame, schema: Schema, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(doc_id, valid, errors); a malformed document is not valid."""
    held: list[Batches] = []  # one a task

    def rows(b: Batch):
        if not held:
            held.append(Batches(schema))
        found = [[f"{c}: {w}" for c, w in x] for x in held[0].errors(b)]
        for p in b.odd:
            found.append([f"{c}: {w}" for c, w in held[0].v.errors(p.nodes)] if not p.errors else [p.errors[0][5]])
        return np.arange(len(found)), [pa.array([not f for f in found], pa.bool_()), pa.array(found, pa.list_(pa.string()))]

    return per_batch(docs, rows, "valid boolean, errors array<string>", id_col, xml_col)
