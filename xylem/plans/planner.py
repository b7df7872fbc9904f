"""XPath as joins, windows and aggregations over the node table.

A frame is a DataFrame of context nodes. A step is an equi-join on the document
and, for child, parent, attribute and sibling axes, on the parent too; other
axes add a range condition on (pre, size). Predicates that count positions are
windows per context node; all others are decided once per distinct node.
Distinct nodes are kept after every step, before any later join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .xpath import REVERSE, XPathError, compile_xpath, kind_of, uses_position

NODE = ("doc_id", "pre", "size", "level", "parent", "kind", "ns", "local", "qname", "value", "lang")
_NUMBER = r"^[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*$"
NAN = float("nan")


def to_number(s: Column) -> Column:
    return F.when(s.rlike(_NUMBER), F.trim(F.translate(s, "\t\r\n", "   ")).cast("double")).otherwise(F.lit(NAN))


def number_to_text(x: Column) -> Column:
    """Positional decimal without an exponent; whole numbers without a point."""
    whole = x.cast("decimal(38,0)").cast("string")
    part = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,17)").cast("string"), "0+$", ""), r"\.$", "")
    shown = F.when(x.cast("string").contains("E"), part).otherwise(F.regexp_replace(x.cast("string"), r"\.0$", ""))
    return (
        F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, "0")
        .when((F.abs(x) < 1e18) & (x == F.floor(F.when(F.abs(x) < 1e18, x))), whole).otherwise(shown)
    )


def half_up(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2**52), x).when((x < 0) & (x >= -0.5), F.lit(-0.0)).otherwise(F.floor(F.when(F.abs(x) < 2**52, x) + F.lit(0.5)).cast("double"))


class Planner:
    """Plans expressions over one node table."""

    def __init__(self, nodes: DataFrame, namespaces: dict[str, str] | None = None, variables: dict | None = None) -> None:
        self.nodes = nodes.select(*NODE, "is_id").hint("merge")  # a table of nodes is small on disk, not in the driver: joins don't broadcast it
        self.namespaces = {"xml": "http://www.w3.org/XML/1998/namespace"} | (namespaces or {})
        self.variables, self.names = variables or {}, 0

    def fresh(self) -> str:
        self.names += 1
        return f"__x{self.names}"

    # Node-sets. A frame has the columns of NODE and, behind them, what it was asked to carry.

    def tested(self, axis: str, test) -> Column:
        kind, ns, local = (F.col(c) for c in ("n.kind", "n.ns", "n.local"))
        if test[0] == "type":
            on = {"node": F.lit(True), "text": kind.isin("text", "cdata"), "comment": kind == "comment", "processing-instruction": kind == "pi"}[test[1]]
            return on & (local == test[2]) if test[2] is not None else on
        on = kind == (axis if axis in ("attribute", "namespace") else "element")
        _, prefix, name = test
        if prefix is None:
            return on
        if prefix and prefix not in self.namespaces:
            raise XPathError(f"unbound prefix {prefix!r}")
        on &= ns == self.namespaces[prefix] if prefix else ns.isNull()
        return on if name is None else on & (local == name)

    def axis(self, axis: str) -> Column:
        c = {x: F.col(f"c.{x}") for x in NODE}
        n = {x: F.col(f"n.{x}") for x in NODE}
        real = ~n["kind"].isin("attribute", "namespace", "doctype")
        end = c["pre"] + c["size"]
        siblings = (n["parent"] == c["parent"]) & real & ~c["kind"].isin("attribute", "namespace")
        on = {
            "child": (n["parent"] == c["pre"]) & real,
            "attribute": (n["parent"] == c["pre"]) & (n["kind"] == "attribute"),
            "parent": n["pre"] == c["parent"],
            "descendant": (n["pre"] > c["pre"]) & (n["pre"] <= end) & real,
            "descendant-or-self": (n["pre"] >= c["pre"]) & (n["pre"] <= end) & (real | (n["pre"] == c["pre"])),
            "ancestor": (n["pre"] < c["pre"]) & (c["pre"] <= n["pre"] + n["size"]),
            "ancestor-or-self": (n["pre"] <= c["pre"]) & (c["pre"] <= n["pre"] + n["size"]),
            "following": (n["pre"] > end) & real,
            "preceding": (n["pre"] + n["size"] < c["pre"]) & real,
            "following-sibling": siblings & (n["pre"] > c["pre"]),
            "preceding-sibling": siblings & (n["pre"] < c["pre"]),
            "namespace": (n["kind"] == "namespace") & (n["parent"] <= c["pre"]) & (c["kind"] == "element"),
        }[axis]
        return (n["doc_id"] == c["doc_id"]) & on

    def step(self, frame: DataFrame, axis: str, test, preds, carry: list[str]) -> DataFrame:
        out = [F.col(f"n.{x}") for x in NODE] + [F.col(f"c.{x}") for x in carry]
        if axis == "self":
            found = frame.alias("n").where(self.tested(axis, test)).select(*[F.col(f"n.{x}") for x in (*NODE, *carry)], F.col("n.pre").alias("__c"))
        else:
            if axis == "descendant" and not carry and not preds:
                frame = self.outermost(frame)
            found = frame.alias("c").join(self.nodes.alias("n"), self.axis(axis)).where(self.tested(axis, test)).select(*out, F.col("c.pre").alias("__c"))
            if axis == "namespace":
                found = self.in_scope(found, frame, carry)
        for p in preds:
            found = self.kept(found, p, Window.partitionBy("doc_id", "__c", *carry).orderBy(F.desc("pre") if axis in REVERSE else F.asc("pre")), carry)
        return found.drop("__c").dropDuplicates(["doc_id", "pre", *carry])

    def in_scope(self, found: DataFrame, frame: DataFrame, carry) -> DataFrame:
        """Declarations of the context and its ancestors, of each prefix the nearest, unless that undeclares it."""
        up = found.alias("d").join(self.nodes.alias("e"), (F.col("d.doc_id") == F.col("e.doc_id")) & (F.col("d.parent") == F.col("e.pre")) & (F.col("d.__c") <= F.col("e.pre") + F.col("e.size"))).select("d.*")
        near = Window.partitionBy("doc_id", "__c", "local", *carry).orderBy(F.desc("level"))
        return up.withColumn("__r", F.row_number().over(near)).where((F.col("__r") == 1) & (F.col("value") != "")).drop("__r")

    def outermost(self, frame: DataFrame) -> DataFrame:
        """Contexts that no other context contains: all descendants are theirs."""
        before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn("__e", F.max(F.col("pre") + F.col("size")).over(before)).where(F.col("__e").isNull() | (F.col("pre") > F.col("__e"))).drop("__e")

    def kept(self, frame: DataFrame, pred, window, carry: list[str]) -> DataFrame:
        """Rows that satisfy a predicate; position and size come from the window."""
        position = size = None
        if kind_of(pred) == "number":
            pred = ("binary", "=", ("call", "position", ()), pred)
        if uses_position(pred):
            whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            position, size = self.fresh(), self.fresh()
            frame = frame.withColumn(position, F.row_number().over(window).cast("double")).withColumn(size, F.count(F.lit(1)).over(whole).cast("double"))
        names = frame.columns
        negated = pred[0] == "call" and pred[1] == "not"
        if (path := pred[2][0] if negated else pred) and self.is_below(path):  # whether something is there is a semi-join, whether not an anti-join
            origin = self.fresh()
            there = self.below(path, origin).select(F.col("doc_id").alias("__d"), origin)
            return frame.join(there, (F.col("doc_id") == F.col("__d")) & (F.col("pre") == F.col(origin)), "left_anti" if negated else "left_semi")
        frame, x = self.scalar(frame, pred, position, size)
        return frame.where(self.boolean(x, kind_of(pred))).select(*[n for n in names if n not in (position, size)])

    def roots(self, frame: DataFrame | None, carry: list[str]) -> DataFrame:
        if frame is None:
            return self.nodes.where("parent IS NULL").select(*NODE)
        at = self.nodes.where("parent IS NULL").select(*NODE)
        return frame.select("doc_id", *carry).distinct().join(at, "doc_id").select(*NODE, *carry)

    def nodeset(self, e, frame: DataFrame | None = None, carry: list[str] = ()) -> DataFrame:
        """The frame a node-set expression gives, from the context nodes of ``frame`` (None: each document's root)."""
        carry = list(carry)
        if e[0] == "path":
            _, absolute, start, steps = e
            if start is not None:
                now = self.nodeset(start, frame, carry)
            elif absolute or frame is None:
                now = self.roots(frame, carry)
            else:
                now = frame.select(*NODE, *carry)
            for axis, test, preds in steps:
                now = self.step(now, axis, test, preds, carry)
            return now
        if e[0] == "filter":
            now = self.nodeset(e[1], frame, carry)
            for p in e[2]:
                now = self.kept(now, p, Window.partitionBy("doc_id", *carry).orderBy("pre"), carry)
            return now
        if e[0] == "binary" and e[1] == "|":
            return self.nodeset(e[2], frame, carry).unionByName(self.nodeset(e[3], frame, carry)).dropDuplicates(["doc_id", "pre", *carry])
        if e[0] == "call" and e[1] == "id":
            return self.by_id(e[2][0], frame, carry)
        raise XPathError("a node-set is wanted")

    def by_id(self, arg, frame, carry) -> DataFrame:
        base = self.roots(None, []) if frame is None else frame.select(*NODE, *carry)
        if kind_of(arg) == "nodes":
            names = self.with_text(self.nodeset(arg, frame, carry)).select("doc_id", *carry, F.col("__s").alias("__n"))
        else:
            base, x = self.scalar(base, arg, None, None)
            names = base.select("doc_id", *carry, self.text(x, kind_of(arg)).alias("__n"))
        names = names.select("doc_id", *carry, F.explode(F.split(F.trim("__n"), r"[ \t\r\n]+")).alias("__n")).distinct()
        ids = self.nodes.where("is_id").groupBy("doc_id", F.col("value").alias("__n")).agg(F.min_by("parent", "pre").alias("pre"))
        return names.join(ids, ["doc_id", "__n"]).join(self.nodes.select(*NODE), ["doc_id", "pre"]).select(*NODE, *carry).dropDuplicates(["doc_id", "pre", *carry])

    def with_text(self, frame: DataFrame) -> DataFrame:
        """The frame with each node's string-value in ``__s``; leaves have theirs in the table."""
        deep = frame.where("value IS NULL AND kind IN ('element', 'document')").select("doc_id", "pre", "size").distinct().alias("c")
        inner = deep.join(self.nodes.where("kind IN ('text', 'cdata')").alias("n"), (F.col("c.doc_id") == F.col("n.doc_id")) & (F.col("n.pre") > F.col("c.pre")) & (F.col("n.pre") <= F.col("c.pre") + F.col("c.size")))
        joined = inner.groupBy("c.doc_id", "c.pre").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("n.pre", "n.value"))), lambda x: x["value"])).alias("__t"))
        return frame.join(joined, ["doc_id", "pre"], "left").withColumn("__s", F.coalesce("value", "__t", F.lit(""))).drop("__t")

    @staticmethod
    def is_below(e) -> bool:
        """Whether a path goes down by children and attributes alone, without predicates."""
        return e[0] == "path" and not e[1] and e[2] is None and bool(e[3]) and all(axis in ("child", "attribute") and not preds for axis, _, preds in e[3])

    def below(self, e, origin: str) -> DataFrame:
        """All nodes that such a path finds from any node, with the node it starts from; read bottom up, without the contexts."""
        found = None
        for axis, test, _ in reversed(e[3]):
            kind = F.col("n.kind")
            on = kind == "attribute" if axis == "attribute" else ~kind.isin("attribute", "namespace", "doctype")
            nodes = self.nodes.alias("n").where(on & self.tested(axis, test))
            if found is None:
                found = nodes.select(*[F.col(f"n.{x}") for x in NODE], F.col("n.parent").alias(origin))
            else:
                up = nodes.select(F.col("n.doc_id").alias("__d"), F.col("n.pre").alias("__p"), F.col("n.parent").alias("__up"))
                found = found.join(up, (F.col("doc_id") == F.col("__d")) & (F.col(origin) == F.col("__p"))).select(*NODE, F.col("__up").alias(origin))
        return found

    @staticmethod
    def has_text(e) -> bool:
        """Whether the nodes of a path surely hold their own string-values: attributes, text, comments, instructions."""
        if e[0] != "path" or not e[3]:
            return False
        axis, test, _ = e[3][-1]
        return axis in ("attribute", "namespace") or (test[0] == "type" and test[1] != "node")

    # Scalars: the frame, with columns joined on where needed, and a Column over it.

    def boolean(self, x: Column, kind: str) -> Column:
        return F.coalesce(x, F.lit(False)) if kind in ("boolean", "nodes") else (x != 0) & ~F.isnan(x) if kind == "number" else x != ""

    def text(self, x: Column, kind: str) -> Column:
        return number_to_text(x) if kind == "number" else x.cast("string") if kind == "boolean" else x

    def number(self, x: Column, kind: str) -> Column:
        return x if kind == "number" else x.cast("int").cast("double") if kind == "boolean" else to_number(x)

    def about(self, frame: DataFrame, e, with_text: bool, **aggregates: Column) -> tuple[DataFrame, dict[str, Column]]:
        """Aggregates over a node-set of each of the frame's nodes; null where it is empty."""
        origin = self.fresh()
        if self.is_below(e):
            found = self.below(e, origin)
        else:
            sources = frame.select(*NODE).dropDuplicates(["doc_id", "pre"]).withColumn(origin, F.col("pre"))
            found = self.nodeset(e, sources, [origin])
        if with_text:
            found = found.withColumn("__s", F.coalesce("value", F.lit(""))) if self.has_text(e) else self.with_text(found)
        names = {k: self.fresh() for k in aggregates}
        doc = self.fresh()
        agg = found.groupBy(F.col("doc_id").alias(doc), origin).agg(*[v.alias(names[k]) for k, v in aggregates.items()])
        out = frame.join(agg, (frame["doc_id"] == agg[doc]) & (frame["pre"] == agg[origin]), "left").drop(doc, origin)
        return out, {k: F.col(n) for k, n in names.items()}

    def value(self, frame, e, kind: str, position, size) -> tuple[DataFrame, Column]:
        """``e`` cast to number, string or boolean."""
        own = kind_of(e)
        if own == "nodes":
            if kind == "boolean":
                frame, x = self.about(frame, e, False, n=F.max(F.lit(True)))
                return frame, F.coalesce(x["n"], F.lit(False))
            frame, x = self.about(frame, e, True, s=F.min_by("__s", "pre"))
            s = F.coalesce(x["s"], F.lit(""))
            return frame, to_number(s) if kind == "number" else s
        frame, x = self.scalar(frame, e, position, size)
        return frame, {"number": self.number, "string": self.text, "boolean": self.boolean}[kind](x, own)

    def scalar(self, frame: DataFrame, e, position: str | None, size: str | None) -> tuple[DataFrame, Column]:
        k = e[0]
        if k == "number":
            return frame, F.lit(e[1])
        if k == "string":
            return frame, F.lit(e[1])
        if k == "variable":
            raise XPathError(f"unbound variable ${e[1]}")
        if kind_of(e) == "nodes":
            return self.value(frame, e, "boolean", position, size)
        if k == "negate":
            frame, x = self.value(frame, e[1], "number", position, size)
            return frame, -x
        if k == "call":
            return self.call(frame, e[1], e[2], position, size)
        op, left, right = e[1:]
        if op in ("and", "or"):
            frame, a = self.value(frame, left, "boolean", position, size)
            frame, b = self.value(frame, right, "boolean", position, size)
            return frame, (a & b) if op == "and" else (a | b)
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return self.comparison(frame, op, left, right, position, size)
        frame, a = self.value(frame, left, "number", position, size)
        frame, b = self.value(frame, right, "number", position, size)
        zero = b == 0
        safe = F.when(~zero, b)
        if op == "div":
            return frame, F.when(zero, F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(float("inf")))).otherwise(a / safe)
        if op == "mod":
            return frame, F.when(zero, F.lit(NAN)).otherwise(a % safe)
        return frame, {"+": a + b, "-": a - b, "*": a * b}[op]

    @staticmethod
    def compared(op: str, a: Column, b: Column, numbers: bool) -> Column:
        x = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if not numbers:
            return x
        odd = F.isnan(a) | F.isnan(b)  # Spark has NaN equal to itself and above all else
        return F.when(odd, F.lit(op == "!=")).otherwise(x)

    def comparison(self, frame, op, left, right, position, size) -> tuple[DataFrame, Column]:
        a, b = kind_of(left), kind_of(right)
        if a != "nodes" and b == "nodes":
            turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            return self.comparison(frame, turned, right, left, position, size)
        order = op not in ("=", "!=")
        if a == "nodes" and b == "boolean":
            kind = "number" if order else "boolean"
            frame, y = self.value(frame, right, kind, position, size)
            frame, x = self.value(frame, left, "boolean", position, size)
            return frame, self.compared(op, x.cast("int").cast("double") if order else x, y, order)
        if a == "nodes" and b != "nodes":
            numbers = order or b == "number"
            if right[0] in ("number", "string"):
                y = to_number(F.lit(right[1])) if numbers and right[0] == "string" else F.lit(right[1])
                s = to_number(F.col("__s")) if numbers else F.col("__s")
                frame, x = self.about(frame, left, True, hit=F.max(self.compared(op, s, y, numbers)))
                return frame, F.coalesce(x["hit"], F.lit(False))
            frame, y = self.value(frame, right, "number" if numbers else "string", position, size)
            name = self.fresh()
            frame = frame.withColumn(name, y)
            frame, x = self.about(frame, left, True, all=F.collect_set("__s"))
            hit = F.exists(x["all"], lambda s: self.compared(op, to_number(s) if numbers else s, F.col(name), numbers))
            return frame, F.coalesce(hit, F.lit(False))
        if a == "nodes":
            s = to_number(F.col("__s")) if order else F.col("__s")
            s = F.when(~F.isnan(s), s) if order else s
            if op == "=":
                frame, x = self.about(frame, left, True, all=F.collect_set("__s"))
                frame, y = self.about(frame, right, True, all=F.collect_set("__s"))
                return frame, F.coalesce(F.arrays_overlap(x["all"], y["all"]), F.lit(False))
            frame, x = self.about(frame, left, True, lo=F.min(s), hi=F.max(s))
            frame, y = self.about(frame, right, True, lo=F.min(s), hi=F.max(s))
            hit = (x["lo"] != y["hi"]) | (x["hi"] != y["lo"]) if op == "!=" else self.compared(op, x["lo"] if op[0] == "<" else x["hi"], y["hi"] if op[0] == "<" else y["lo"], False)
            return frame, F.coalesce(hit, F.lit(False))
        kind = "number" if order or "number" in (a, b) else "boolean" if "boolean" in (a, b) else "string"
        if not order and "boolean" in (a, b):
            kind = "boolean"
        frame, x = self.value(frame, left, kind, position, size)
        frame, y = self.value(frame, right, kind, position, size)
        return frame, self.compared(op, x, y, kind == "number")

    def call(self, frame, name, args, position, size) -> tuple[DataFrame, Column]:
        if name in ("position", "last"):
            column = position if name == "position" else size
            return frame, F.col(column) if column else F.lit(1.0)
        if name in ("true", "false"):
            return frame, F.lit(name == "true")
        if name == "count":
            frame, x = self.about(frame, args[0], False, n=F.count(F.lit(1)))
            return frame, F.coalesce(x["n"], F.lit(0)).cast("double")
        if name == "sum":
            frame, x = self.about(frame, args[0], True, n=F.sum(to_number(F.col("__s"))))
            return frame, F.coalesce(x["n"], F.lit(0.0))
        if name in ("local-name", "namespace-uri", "name"):
            field = {"local-name": "local", "namespace-uri": "ns", "name": "qname"}[name]
            if not args:
                return frame, F.coalesce(F.when(F.col("kind").isin("element", "attribute", "pi", "namespace"), F.col(field)), F.lit(""))
            frame, x = self.about(frame, args[0], False, v=F.min_by(F.when(F.col("kind").isin("element", "attribute", "pi", "namespace"), F.coalesce(F.col(field), F.lit(""))), "pre"))
            return frame, F.coalesce(x["v"], F.lit(""))
        if name == "lang":
            frame, x = self.value(frame, args[0], "string", position, size)
            own, want = F.lower("lang"), F.lower(x)
            return frame, F.coalesce((own == want) | own.startswith(F.concat(want, F.lit("-"))), F.lit(False))
        if not args and name in ("string", "string-length", "normalize-space", "number"):
            args = (("path", False, None, ()),)
        want = {"boolean": "boolean", "not": "boolean", "number": "number", "floor": "number", "ceiling": "number", "round": "number"}.get(name, "string")
        xs = []
        for i, a in enumerate(args):
            frame, x = self.value(frame, a, "number" if name == "substring" and i else want, position, size)
            xs.append(x)
        return frame, FUNCTIONS[name](*xs)

    # Whole expressions.

    def bound(self, e):
        if not isinstance(e, tuple) or not e:
            return e
        if e[0] == "variable" and e[1] in self.variables:
            v = self.variables[e[1]]
            return ("call", "true" if v else "false", ()) if isinstance(v, bool) else ("number", float(v)) if isinstance(v, (int, float)) else ("string", str(v))
        return tuple(self.bound(x) if isinstance(x, tuple) else x for x in e)

    def select(self, xpath: str) -> DataFrame:
        """The nodes an expression selects in every document: NODE columns and string_value."""
        e = self.bound(compile_xpath(xpath))
        found = self.nodeset(e)
        return found.withColumn("string_value", F.coalesce("value", F.lit(""))) if self.has_text(e) else self.with_text(found).withColumnRenamed("__s", "string_value")

    def nodes_of(self, xpath: str) -> DataFrame:
        """The nodes alone, without their string-values, which may cost a join."""
        return self.nodeset(self.bound(compile_xpath(xpath)))

    def evaluate(self, xpath: str) -> DataFrame:
        """(doc_id, result): a number, string or Boolean per document; of a node-set its string."""
        e = self.bound(compile_xpath(xpath))
        frame = self.roots(None, [])
        if kind_of(e) == "nodes":
            frame, x = self.value(frame, e, "string", None, None)
        else:
            frame, x = self.scalar(frame, e, None, None)
        return frame.select("doc_id", x.alias("result"))


def _substring(s: Column, start: Column, length: Column | None = None) -> Column:
    first = half_up(start)
    low = F.greatest(first, F.lit(1.0))
    n = F.char_length(s).cast("double") + 1
    end = F.least(n, first + half_up(length)) if length is not None else n
    ok = ~F.isnan(first) & ~F.isnan(end) & (first < n) & (low < end)
    return F.when(ok, F.substring(s, F.when(ok, low).cast("int"), F.when(ok, end - low).cast("int"))).otherwise("")


FUNCTIONS = {
    "string": lambda x: x,
    "concat": lambda *xs: F.concat(*xs),
    "starts-with": lambda a, b: F.startswith(a, b),
    "contains": lambda a, b: F.contains(a, b),
    "substring-before": lambda a, b: F.when(F.instr(a, b) > 1, F.substring(a, F.lit(1), F.instr(a, b) - 1)).otherwise(""),
    "substring-after": lambda a, b: F.when(F.instr(a, b) > 0, F.substring(a, F.instr(a, b) + F.char_length(b), F.char_length(a))).otherwise(""),
    "substring": _substring,
    "string-length": lambda s: F.char_length(s).cast("double"),
    "normalize-space": lambda s: F.btrim(F.regexp_replace(s, "[ \t\r\n]+", " "), F.lit(" ")),
    "translate": lambda s, a, b: F.call_function("translate", s, a, b),
    "boolean": lambda x: x,
    "not": lambda x: ~x,
    "number": lambda x: x,
    "floor": lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2**52), x).otherwise(F.floor(F.when(F.abs(x) < 2**52, x)).cast("double")),
    "ceiling": lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2**52), x).otherwise(F.ceil(F.when(F.abs(x) < 2**52, x)).cast("double")),
    "round": half_up,
}
