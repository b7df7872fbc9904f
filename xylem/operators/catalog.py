"""XML Catalogs: entries from catalog documents, and resolution against them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions.uri import resolve, unescape
from xylem.sources.parser import parse

NS = "urn:oasis:names:tc:entity:xmlns:xml:catalog"
#: Entry element, its key attribute, its target attribute.
ENTRIES = {
    "public": ("publicId", "uri"), "system": ("systemId", "uri"), "rewriteSystem": ("systemIdStartString", "rewritePrefix"), "systemSuffix": ("systemIdSuffix", "uri"),
    "delegatePublic": ("publicIdStartString", "catalog"), "delegateSystem": ("systemIdStartString", "catalog"), "uri": ("name", "uri"), "rewriteURI": ("uriStartString", "rewritePrefix"),
    "uriSuffix": ("uriSuffix", "uri"), "delegateURI": ("uriStartString", "catalog"), "nextCatalog": (None, "catalog"),
}


def public_id(s: str) -> str:
    """Normalised: urn:publicid: unwrapped, white space collapsed."""
    if s.startswith("urn:publicid:"):
        s = s[13:]
        for a, b in (("+", " "), ("::", "\x00"), (":", "//"), (";", "::"), ("\x00", "::")):
            s = s.replace(a, b)
        s = unescape(s)
    return " ".join(s.split())


def entries(xml: str, base: str = "") -> list[tuple]:
    """(kind, key, target, prefer) in order; xml:base and prefer are inherited."""
    nodes = parse(xml, base_uri=base).nodes
    out, prefer = [], {}
    for n in nodes:
        if n[4] != "element" or n[5] != NS:
            continue
        attrs = {m[7]: m[9] for m in nodes[n[0] + 1 : n[0] + n[1] + 1] if m[3] == n[0] and m[4] == "attribute"}
        prefer[n[0]] = attrs.get("prefer", prefer.get(n[3], "public"))
        if n[7] in ENTRIES:
            key, target = ENTRIES[n[7]]
            if target in attrs and (key is None or key in attrs):
                k = attrs.get(key) if key else None
                out.append((n[7], public_id(k) if k is not None and "ublic" in n[7] else k, resolve(attrs[target], n[13] or base), prefer[n[0]]))
    return out


class Catalog:
    """Catalog documents by URI; the first is where resolution starts. Only given documents are read."""

    def __init__(self, documents: dict[str, str]) -> None:
        self.files = {uri: entries(xml, uri) for uri, xml in documents.items()}
        self.start = list(documents)[:1]

    def _in_file(self, found: list[tuple], exact: str, rewrite: str, suffix: str | None, delegate: str, value: str, prefer: str | None = None):
        """("is", target) or ("ask", catalogs) from one file, or None: exact, then the longest rewrite, suffix, delegates by length."""
        for kind, key, target, p in found:
            if kind == exact and key == value and prefer in (None, p):
                return "is", target
        at = [(len(k), v) for kind, k, v, _ in found if kind == rewrite and value.startswith(k)]
        if at:
            n, target = max(at, key=lambda x: x[0])
            return "is", target + value[n:]
        at = [(len(k), v) for kind, k, v, _ in found if kind == suffix and value.endswith(k)]
        if at:
            return "is", max(at, key=lambda x: x[0])[1]
        ask = sorted(((len(k), v) for kind, k, v, p in found if kind == delegate and value.startswith(k) and prefer in (None, p)), key=lambda x: -x[0])
        return ("ask", list(dict.fromkeys(v for _, v in ask))) if ask else None

    def _walk(self, start: list[str], look, seen: set[str]):
        todo = list(start)
        while todo:
            uri = todo.pop(0)
            if uri in seen or uri not in self.files:
                continue
            seen.add(uri)
            hit = look(self.files[uri])
            if hit is not None:
                return hit[1] if hit[0] == "is" else self._walk(hit[1], look, set())
            todo += [t for kind, _, t, _ in self.files[uri] if kind == "nextCatalog"]
        return None

    def external_id(self, public: str | None = None, system: str | None = None, prefer: str | None = None) -> str | None:
        if system and system.startswith("urn:publicid:"):
            public, system = public or system, None
        public = public_id(public) if public else None

        def look(found):
            hit = self._in_file(found, "system", "rewriteSystem", "systemSuffix", "delegateSystem", system) if system else None
            if hit is None and public:
                hit = self._in_file(found, "public", "", None, "delegatePublic", public, prefer or ("public" if system else None))
            return hit

        return self._walk(self.start, look, set())

    def uri(self, uri: str) -> str | None:
        return self._walk(self.start, lambda found: self._in_file(found, "uri", "rewriteURI", "uriSuffix", "delegateURI", uri), set())


def resolved(rows: DataFrame, documents: dict[str, str], public_col: str | None = None, system_col: str | None = None, uri_col: str | None = None) -> DataFrame:
    """``rows`` with ``resolved``; null where the catalogs say nothing. Catalogs are files a user wrote, so they travel with the job."""
    catalog = Catalog(documents)
    schema = T.StructType([*rows.schema.fields, T.StructField("resolved", T.StringType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(names.index(c)).to_pylist() if c else [None] * b.num_rows  # noqa: E731, B023
            out = [catalog.uri(u) if u is not None else catalog.external_id(p, s) if p or s else None for p, s, u in zip(get(public_col), get(system_col), get(uri_col), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, "resolved"])

    return rows.mapInArrow(run, schema)


def rewritten(rows: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """One file's exact, rewrite and suffix rules (kind, key, target) as a join: the best rule for each value in ``resolved``.

    A value looks up itself, and its beginnings and ends of every length that a
    rule has, so all joins are on equality; those lengths are few, whatever the rules.
    """
    k = F.col("kind")
    how = F.when(k.isin("system", "uri"), 3).when(k.startswith("rewrite"), 2).when(k.endswith("Suffix"), 1)
    r = rules.select(how.alias("__how"), F.col("key").alias("__key"), F.col("target").alias("__t")).where("__how IS NOT NULL AND __key IS NOT NULL")
    lengths = {h: sorted(x["n"] for x in r.where(F.col("__how") == h).select(F.length("__key").alias("n")).distinct().collect()) for h in (2, 1)}
    v = F.col(column)
    distinct = rows.select(column).where(v.isNotNull()).distinct()
    look = [F.struct(F.lit(3).alias("how"), v.alias("key"))]
    look += [F.when(F.length(v) >= n, F.struct(F.lit(2).alias("how"), F.substring(v, 1, n).alias("key"))) for n in lengths[2]]
    look += [F.when(F.length(v) >= n, F.struct(F.lit(1).alias("how"), (F.substring(v, -n, n) if n else F.lit("")).alias("key"))) for n in lengths[1]]
    asked = distinct.select(column, F.explode(F.filter(F.array(*look), lambda x: x.isNotNull())).alias("x")).select(column, F.col("x.how").alias("__how"), F.col("x.key").alias("__key"))
    hits = asked.join(r, ["__how", "__key"])
    value = F.when(F.col("__how") == 2, F.concat("__t", F.substring(v, F.length("__key") + 1, F.length(v)))).otherwise(F.col("__t"))
    best = hits.groupBy(column).agg(F.max_by(value, F.struct("__how", F.length("__key"))).alias("resolved"))
    return rows.join(best, column, "left")
