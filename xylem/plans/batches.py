"""XPath over documents in place: array operations on the nodes of a batch of whole documents.

The language is the planner's. What moves is documents in and results out; no
node leaves its task, so nothing is shuffled, broadcast or written. A node-set
is two arrays, (context, node), in order and without repeats; steps are searches
in the order of nodes, positions are ranks within a context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from xylem.functions.xpath_eval import ARITY, Evaluator, text_of_number
from xylem.plans.xpath import REVERSE, XPathError, compile_xpath, kind_of, uses_position
from xylem.sources.batch import ATTRIBUTE, CDATA, COMMENT, ELEMENT, NAMESPACE, PI, TEXT, Batch, expanded, per_batch

NODE = ("pre", "size", "level", "parent", "kind", "ns", "local", "qname", "value", "lang")
_TYPES = {"pre": "int", "size": "int", "level": "int", "parent": "int"}
_NUMBER = r"\A[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*\z"
_COMPARED = {"=": np.equal, "!=": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def numbers(s: pa.Array) -> np.ndarray:
    ok = pc.match_substring_regex(s, _NUMBER)
    s = s if pc.all(ok).as_py() is not False else pc.if_else(ok, s, pa.scalar("NaN", s.type))
    return pc.cast(pc.utf8_trim(s, " \t\r\n"), pa.float64()).to_numpy()


def in_order(rows: np.ndarray, nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs sorted, each once."""
    key = rows * np.int64(n + 1) + nodes
    if len(key) < 2 or (key[1:] > key[:-1]).all():
        return rows, nodes
    key = np.unique(key)
    return key // (n + 1), key % (n + 1)


class Paths:
    """Expressions over one batch. A scalar is (kind, values): numbers and Booleans as arrays of numpy, strings as one of Arrow."""

    def __init__(self, batch: Batch, namespaces: dict[str, str] | None = None, variables: dict | None = None) -> None:
        self.b, self.variables, self.functions = batch, variables or {}, Evaluator([])
        self.namespaces = {"xml": "http://www.w3.org/XML/1998/namespace"} | (namespaces or {})
        self.doc_end = batch.starts[1:][batch.doc] if batch.n else np.zeros(0, np.int64)

    def roots(self) -> np.ndarray:
        b = self.b
        return b.starts[:-1][np.diff(b.starts) > 0]

    # Node-sets

    def tested(self, axis: str, test) -> np.ndarray:
        b = self.b
        if test[0] == "type":
            if test[1] == "node":
                return np.ones(b.n, bool)
            kinds = {"text": (TEXT, CDATA), "comment": (COMMENT,), "processing-instruction": (PI,)}[test[1]]
            on = np.isin(b.kind, kinds)
            return on & np.array([x[2] == test[2] for x in b.names], bool)[b.name] if test[2] is not None else on
        on = b.kind == {"attribute": ATTRIBUTE, "namespace": NAMESPACE}.get(axis, ELEMENT)
        _, prefix, local = test
        if prefix is None:
            return on
        if prefix and prefix not in self.namespaces:
            raise XPathError(f"unbound prefix {prefix!r}")
        ns = self.namespaces[prefix] if prefix else None
        return on & np.array([x[0] == ns and local in (None, x[2]) for x in b.names], bool)[b.name]

    def axis(self, u: np.ndarray, axis: str, test) -> tuple[np.ndarray, np.ndarray]:
        """(place in u, node) for distinct nodes in order; pairs in order."""
        b, m = self.b, self.tested(axis, test)
        if axis == "self":
            at = np.flatnonzero(m[u])
            return at, u[at]
        if axis == "parent":
            p = b.parent[u]
            at = np.flatnonzero(p >= 0)
            at = at[m[p[at]]]
            return at, p[at]
        if axis in ("child", "attribute"):
            found = np.flatnonzero(m & (b.kind == ATTRIBUTE if axis == "attribute" else b.real) & (b.parent >= 0))
            place = np.full(b.n, -1, np.int64)
            place[u] = np.arange(len(u))
            at = place[b.parent[found]]
            return in_order(at[at >= 0], found[at >= 0], b.n)
        if axis in ("ancestor", "ancestor-or-self", "namespace"):
            at, now = np.arange(len(u)), u
            if axis == "namespace":
                at = at[b.kind[u] == ELEMENT]
                now = u[at]
            elif axis == "ancestor":
                now = b.parent[now]
            ats, ups = [], []
            while len(now):
                keep = now >= 0
                at, now = at[keep], now[keep]
                ats.append(at)
                ups.append(now)
                now = b.parent[now]
            at, up = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ats, ups))
            if axis != "namespace":
                keep = m[up]
                return in_order(at[keep], up[keep], b.n)
            return self.in_scope(at, up, np.flatnonzero(m & (b.kind == NAMESPACE)))
        end = u + b.size[u]
        if axis in ("following-sibling", "preceding-sibling"):
            found = np.flatnonzero(m & b.real & (b.parent >= 0))
            key = np.sort(b.parent[found] * np.int64(b.n + 1) + found)
            p = np.where(b.real[u], b.parent[u], -1)
            low = np.searchsorted(key, p * (b.n + 1) + (u + 1 if axis[0] == "f" else 0))
            high = np.searchsorted(key, p * (b.n + 1) + (b.n if axis[0] == "f" else u))
            at, i = expanded(low, np.where(p >= 0, high, low))
            return at, key[i] % (b.n + 1)
        found = np.flatnonzero(m & b.real)
        if axis == "following":
            low, high = np.searchsorted(found, end + 1), np.searchsorted(found, self.doc_end[u])
        elif axis == "preceding":
            low, high = np.searchsorted(found, b.starts[b.doc[u]]), np.searchsorted(found, u)
        else:
            low, high = np.searchsorted(found, u + 1), np.searchsorted(found, end, "right")
        at, i = expanded(low, high)
        nodes = found[i]
        if axis == "preceding":
            keep = nodes + b.size[nodes] < u[at]
            return at[keep], nodes[keep]
        if axis == "descendant-or-self":
            own = np.flatnonzero(m[u])
            return in_order(np.concatenate([at, own]), np.concatenate([nodes, u[own]]), b.n)
        return at, nodes

    def in_scope(self, at, up, spaces) -> tuple[np.ndarray, np.ndarray]:
        """Declarations of the contexts' ancestors, of each prefix the nearest, unless that undeclares it."""
        b = self.b
        i, j = expanded(np.searchsorted(b.parent[spaces], up), np.searchsorted(b.parent[spaces], up, "right"))
        at, found = at[i], spaces[j]
        locals_ = {x: k for k, x in enumerate(dict.fromkeys(x[2] for x in b.names))}
        prefix = np.array([locals_[x[2]] for x in b.names], np.int64)[b.name[found]]
        order = np.lexsort((found, prefix, at))
        at, found, prefix = at[order], found[order], prefix[order]
        last = np.ones(len(at), bool)
        last[:-1] = (at[1:] != at[:-1]) | (prefix[1:] != prefix[:-1])
        at, found = at[last], found[last]
        keep = pc.not_equal(b.strings(found), "").to_numpy(zero_copy_only=False) if len(found) else np.zeros(0, bool)
        return in_order(at[keep], found[keep], b.n)

    def outermost(self, rows, nodes) -> tuple[np.ndarray, np.ndarray]:
        """Contexts that no other of their row contains: all descendants are theirs."""
        if len(nodes) < 2:
            return rows, nodes
        at = rows * np.int64(self.b.n + 1)
        ends = np.maximum.accumulate(at + nodes + self.b.size[nodes])
        keep = np.ones(len(nodes), bool)
        keep[1:] = at[1:] + nodes[1:] > ends[:-1]
        return rows[keep], nodes[keep]

    def step(self, rows, nodes, axis: str, test, preds) -> tuple[np.ndarray, np.ndarray]:
        if axis == "descendant" and not any(map(uses_position, preds)) and not any(kind_of(p) in ("number", "any") for p in preds):
            rows, nodes = self.outermost(rows, nodes)
        u, inverse = (nodes, None) if len(nodes) < 2 or (nodes[1:] > nodes[:-1]).all() else np.unique(nodes, return_inverse=True)
        at, found = self.axis(u, axis, test)
        at, found = self.kept(at, found, preds, axis in REVERSE)
        if inverse is None:
            return in_order(rows[at], found, self.b.n)
        low, high = np.searchsorted(at, inverse), np.searchsorted(at, inverse, "right")
        which, i = expanded(low, high)
        return in_order(rows[which], found[i], self.b.n)

    def kept(self, groups, nodes, preds, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose node satisfies the predicates; positions count within a group."""
        for p in preds:
            if not len(nodes):
                break
            if self.kind(p) == "number":
                p = ("binary", "=", ("call", "position", ()), p)
            position = size = None
            if uses_position(p):
                low, high = np.searchsorted(groups, groups), np.searchsorted(groups, groups, "right")
                at = np.arange(len(groups))
                position, size = (high - at if reverse else at - low + 1).astype(float), (high - low).astype(float)
                ok = self.boolean(self.scalar(p, nodes, position, size))
            else:
                u, inverse = (nodes, None) if len(nodes) < 2 or (nodes[1:] > nodes[:-1]).all() else np.unique(nodes, return_inverse=True)
                ok = self.boolean(self.scalar(p, u, None, None))
                ok = ok if inverse is None else ok[inverse]
            groups, nodes = groups[ok], nodes[ok]
        return groups, nodes

    def nodeset(self, e, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, rows = self.b, np.arange(len(context))
        if e[0] == "path":
            _, absolute, start, steps = e
            if start is not None:
                rows, nodes = self.nodeset(start, context)
            else:
                nodes = b.starts[b.doc[context]] if absolute else context
            for axis, test, preds in steps:
                rows, nodes = self.step(rows, nodes, axis, test, preds)
            return rows, nodes
        if e[0] == "filter":
            return self.kept(*self.nodeset(e[1], context), e[2])
        if e[0] == "binary" and e[1] == "|":
            (r, n), (s, m) = self.nodeset(e[2], context), self.nodeset(e[3], context)
            return in_order(np.concatenate([r, s]), np.concatenate([n, m]), b.n)
        if e[0] == "call" and e[1] == "id":
            return self.by_id(e[2][0], context)
        raise XPathError("a node-set is wanted")

    def by_id(self, arg, context) -> tuple[np.ndarray, np.ndarray]:
        b = self.b
        if kind_of(arg) == "nodes":
            rows, nodes = self.nodeset(arg, context)
            texts = b.strings(nodes)
        else:
            rows, texts = np.arange(len(context)), self.text(self.scalar(arg, context, None, None))
        words = pc.split_pattern_regex(pc.utf8_trim(texts, " \t\r\n"), "[ \\t\\r\\n]+")
        rows, words = rows[pc.list_parent_indices(words).to_numpy()], pc.list_flatten(words)
        ids = np.flatnonzero(b.is_id)
        keys = pa.concat_arrays([b.pool.take(pa.array(b.value[ids])), words.cast(pa.large_string())]).dictionary_encode()
        code = keys.indices.to_numpy().astype(np.int64)
        n = len(keys.dictionary) + 1
        have, first = np.unique(b.doc[ids] * n + code[: len(ids)], return_index=True)
        want = b.doc[context[rows]] * n + code[len(ids) :]
        at = np.searchsorted(have, want)
        hit = at < len(have)
        hit[hit] = have[at[hit]] == want[hit]
        return in_order(rows[hit], b.parent[ids[first[at[hit]]]], b.n)

    # Scalars

    def text(self, x) -> pa.Array:
        kind, v = x
        if kind == "string":
            return v
        if kind == "number":
            return pa.array([text_of_number(y) for y in v.tolist()], pa.large_string())
        return pc.if_else(pa.array(v), pa.scalar("true", pa.large_string()), pa.scalar("false", pa.large_string()))

    def number(self, x) -> np.ndarray:
        kind, v = x
        return v if kind == "number" else v.astype(float) if kind == "boolean" else numbers(v)

    def boolean(self, x) -> np.ndarray:
        kind, v = x
        return v if kind == "boolean" else (v != 0) & ~np.isnan(v) if kind == "number" else pc.not_equal(v, "").to_numpy(zero_copy_only=False)

    def value(self, e, context, position, size, kind: str):
        """``e`` cast to a number, string or Boolean."""
        if kind_of(e) == "nodes":
            rows, nodes = self.nodeset(e, context)
            if kind == "boolean":
                out = np.zeros(len(context), bool)
                out[rows] = True
                return out
            x = ("string", self.first(rows, nodes, len(context)))
        else:
            x = self.scalar(e, context, position, size)
        return {"number": self.number, "string": self.text, "boolean": self.boolean}[kind](x)

    def first(self, rows, nodes, n: int, of=None) -> pa.Array:
        """The string of each context's first node, empty where there is none."""
        at = np.searchsorted(rows, np.arange(n))
        some = at < len(rows)
        some[some] = rows[at[some]] == np.flatnonzero(some)
        texts = (of or self.b.strings)(nodes[at[some]]).cast(pa.large_string())
        if some.all():
            return texts
        place = np.cumsum(some) - 1
        return pc.fill_null(texts.take(pa.array(place, mask=~some)), "")

    def scalar(self, e, context, position, size):
        k, n = e[0], len(context)
        if k == "number":
            return "number", np.full(n, e[1])
        if k == "string":
            return "string", pa.array([e[1]], pa.large_string()).take(pa.array(np.zeros(n, np.int64)))
        if k == "variable":
            if e[1] not in self.variables:
                raise XPathError(f"unbound variable ${e[1]}")
            v = self.variables[e[1]]
            return ("boolean", np.full(n, v)) if isinstance(v, bool) else ("number", np.full(n, float(v))) if isinstance(v, (int, float)) else self.scalar(("string", str(v)), context, position, size)
        if kind_of(e) == "nodes":
            return "boolean", self.value(e, context, position, size, "boolean")
        if k == "negate":
            return "number", -self.value(e[1], context, position, size, "number")
        if k == "call":
            return self.call(e[1], e[2], context, position, size)
        op, left, right = e[1:]
        if op in ("and", "or"):
            a, b = (self.value(x, context, position, size, "boolean") for x in (left, right))
            return "boolean", a & b if op == "and" else a | b
        if op in _COMPARED:
            return "boolean", self.comparison(op, left, right, context, position, size)
        a, b = (self.value(x, context, position, size, "number") for x in (left, right))
        with np.errstate(all="ignore"):
            if op == "div":
                return "number", a / b
            if op == "mod":
                return "number", np.fmod(a, b)
            return "number", {"+": a + b, "-": a - b, "*": a * b}[op]

    def compared(self, op: str, a, b) -> np.ndarray:
        """Of numbers or of strings; nothing but inequality holds of NaN."""
        if isinstance(a, pa.Array):
            a, b = (x.cast(pa.large_string()) for x in (a, b))
            return (pc.equal if op == "=" else pc.not_equal)(a, b).to_numpy(zero_copy_only=False)
        return _COMPARED[op](a, b)

    def comparison(self, op, left, right, context, position, size) -> np.ndarray:
        a, b, order, n = self.kind(left), self.kind(right), op not in ("=", "!="), len(context)
        if a != "nodes" and b == "nodes":
            return self.comparison(_TURNED.get(op, op), right, left, context, position, size)
        if a == "nodes" and b == "boolean":
            x, y = self.value(left, context, position, size, "boolean"), self.value(right, context, position, size, "boolean")
            return self.compared(op, x.astype(float), y.astype(float))
        if a == "nodes" and b != "nodes":
            as_number = order or b == "number"
            y = self.value(right, context, position, size, "number" if as_number else "string")
            rows, nodes = self.nodeset(left, context)
            s = self.b.strings(nodes)
            out = np.zeros(n, bool)
            out[rows[self.compared(op, numbers(s), y[rows]) if as_number else self.compared(op, s, y.take(pa.array(rows)))]] = True
            return out
        if a == "nodes":
            (r, i), (s, j) = self.nodeset(left, context), self.nodeset(right, context)
            if order:
                low, high = (np.fmin, np.fmax) if op[0] == "<" else (np.fmax, np.fmin)
                x, y = np.full(n, np.nan), np.full(n, np.nan)
                low.at(x, r, numbers(self.b.strings(i)))
                high.at(y, s, numbers(self.b.strings(j)))
                return self.compared(op, x, y)
            codes = pa.concat_arrays([self.b.strings(i).cast(pa.large_string()), self.b.strings(j).cast(pa.large_string())]).dictionary_encode()
            code = codes.indices.to_numpy().astype(np.int64)
            x, y, m = code[: len(i)], code[len(i) :], len(codes.dictionary) + 1
            out = np.zeros(n, bool)
            if op == "=":
                out[r[np.isin(r * m + x, s * m + y)]] = True
                return out
            low, high, both = np.full(n, m), np.full(n, -1), np.zeros((2, n), bool)
            for k, (rows, values) in enumerate(((r, x), (s, y))):
                np.minimum.at(low, rows, values)
                np.maximum.at(high, rows, values)
                both[k, rows] = True
            return both.all(axis=0) & (low != high)
        kind = "boolean" if not order and "boolean" in (a, b) else "number" if order or "number" in (a, b) else "string"
        x, y = (self.value(e, context, position, size, kind) for e in (left, right))
        return self.compared(op, x, y)

    def kind(self, e) -> str:
        if e[0] == "variable":
            v = self.variables.get(e[1], "")
            return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
        return kind_of(e)

    def call(self, name, args, context, position, size):
        n, b = len(context), self.b
        if name in ("position", "last"):
            x = position if name == "position" else size
            return "number", x if x is not None else np.ones(n)
        if name in ("true", "false"):
            return "boolean", np.full(n, name == "true")
        low, high = ARITY.get(name, (0, -1))
        if not low <= len(args) <= high:
            raise XPathError(f"no function {name!r} of {len(args)} arguments")
        if name in ("count", "sum"):
            rows, nodes = self.nodeset(args[0], context)
            return "number", np.bincount(rows, None if name == "count" else numbers(b.strings(nodes)), minlength=n).astype(float)
        if name in ("local-name", "namespace-uri", "name"):
            field = {"local-name": "local", "namespace-uri": "ns", "name": "qname"}[name]
            of = lambda x: pc.if_else(pa.array(np.isin(b.kind[x], (ELEMENT, ATTRIBUTE, NAMESPACE, PI))), pc.fill_null(b.column(field, x), ""), "")
            rows, nodes = (np.arange(n), context) if not args else self.nodeset(args[0], context)
            return "string", self.first(rows, nodes, n, of)
        if name == "lang":
            own, want = b.column("lang", context).to_pylist(), self.value(args[0], context, position, size, "string").to_pylist()
            return "boolean", np.array([x is not None and (x.lower() == w.lower() or x.lower().startswith(w.lower() + "-")) for x, w in zip(own, want, strict=True)], bool)
        if not args:
            args = (("path", False, None, ()),)
        if name in ("boolean", "not"):
            x = self.value(args[0], context, position, size, "boolean")
            return "boolean", x if name == "boolean" else ~x
        if name in ("number", "floor", "ceiling", "round"):
            x = self.value(args[0], context, position, size, "number")
            if name == "round":
                with np.errstate(invalid="ignore"):
                    return "number", np.where(np.isfinite(x) & (np.abs(x) < 2**52), np.where((x < 0) & (x >= -0.5), -0.0, np.floor(x + 0.5)), x)
            return "number", x if name == "number" else (np.floor if name == "floor" else np.ceil)(x)
        xs = [self.value(a, context, position, size, "number" if name == "substring" and i else "string") for i, a in enumerate(args)]
        if name == "string":
            return "string", xs[0]
        if name == "concat":
            return "string", pc.binary_join_element_wise(*[x.cast(pa.large_string()) for x in xs], pa.scalar("", pa.large_string()))
        if name == "string-length":
            return "number", pc.utf8_length(xs[0]).to_numpy().astype(float)
        f = getattr(self.functions, "fn_" + name.replace("-", "_"))
        out = [f(0, *row) for row in zip(*(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in xs), strict=True)]
        return ("boolean", np.array(out, bool)) if kind_of(("call", name, ())) == "boolean" else ("string", pa.array(out, pa.large_string()))


def _arrow(x) -> pa.Array:
    return x[1] if isinstance(x[1], pa.Array) else pa.array(x[1])


class Documents:
    """Expressions over a table of documents; the interface of ``Planner``."""

    def __init__(self, docs: DataFrame, namespaces: dict[str, str] | None = None, variables: dict | None = None, id_col: str = "doc_id", xml_col: str = "xml", **options) -> None:
        self.docs, self.namespaces, self.variables = docs, namespaces, variables
        self.columns, self.options = {"id_col": id_col, "xml_col": xml_col}, options

    def found(self, xpaths: tuple[str, ...], join, columns: tuple[str, ...]) -> DataFrame:
        compiled, namespaces, variables = [compile_xpath(x) for x in xpaths], self.namespaces, self.variables

        def run(b: Batch):
            p = Paths(b, namespaces, variables)
            roots = p.roots()
            nodes = join(*(np.sort(p.nodeset(e, roots)[1]) for e in compiled))
            return b.doc[nodes], [b.strings(nodes) if c == "string_value" else b.column(c, nodes) for c in columns]

        return per_batch(self.docs, run, ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in columns), **self.columns, **self.options)

    def select(self, xpath: str, columns: tuple[str, ...] = (*NODE, "string_value")) -> DataFrame:
        """The nodes an expression selects in every document; name the columns that are wanted."""
        return self.found((xpath,), lambda x: x, columns)

    def nodes_of(self, xpath: str) -> DataFrame:
        return self.select(xpath, NODE)

    def intersection(self, a: str, b: str, columns: tuple[str, ...] = (*NODE, "string_value")) -> DataFrame:
        return self.found((a, b), lambda x, y: np.intersect1d(x, y, True), columns)

    def difference(self, a: str, b: str, columns: tuple[str, ...] = (*NODE, "string_value")) -> DataFrame:
        """Nodes of either set that the other lacks."""
        return self.found((a, b), lambda x, y: np.setxor1d(x, y, True), columns)

    def counted(self, xpath: str) -> DataFrame:
        """(doc_id, n): how many nodes an expression selects, of the documents where there are any."""
        e, namespaces, variables = compile_xpath(xpath), self.namespaces, self.variables

        def run(b: Batch):
            p = Paths(b, namespaces, variables)
            n = np.bincount(b.doc[p.nodeset(e, p.roots())[1]], minlength=len(b.ids))
            return np.flatnonzero(n), [pa.array(n[n > 0])]

        return per_batch(self.docs, run, "n bigint", **self.columns, **self.options)

    def evaluate(self, xpath: str) -> DataFrame:
        """(doc_id, result): a number, string or Boolean per document; of a node-set its string."""
        e, namespaces, variables = compile_xpath(xpath), self.namespaces, self.variables
        kind = Paths(Batch(pa.array([], pa.int64()), pa.array([], pa.string())), namespaces, variables).kind(e)

        def run(b: Batch):
            p = Paths(b, namespaces, variables)
            roots = p.roots()
            return b.doc[roots], [_arrow(("string", p.value(e, roots, None, None, "string")) if kind == "nodes" else p.scalar(e, roots, None, None))]

        return per_batch(self.docs, run, f"result {'double' if kind == 'number' else 'boolean' if kind == 'boolean' else 'string'}", **self.columns, **self.options)
