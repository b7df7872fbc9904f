"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target over its size is the number of copies it needs on average.
The whole copies are certain for every document. The words that are left are a
sample without replacement in which longer documents are likelier: a document
of 2**j words or more, but less than twice as many, has inclusion probability
p = min(1, c * 2**j), where c makes the expected words the ones wanted. Documents are ranked by
the Pareto statistic (u / (1 - u)) / (p / (1 - p)), u uniform from a hash of id and
text, and taken in that order until the words are reached (Rosen 1997);
those of p = 1 come first. The sample's size in words is fixed, to within half a document.

No source is ever gathered into one task: ranks are first cut into slots whose
sizes are summed before the shuffle, and only the one slot in which a source's
target falls is ranked row by row. What is left per source is one row, which is
broadcast if sources are few and else joined on the source and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, written

#: Slots that ranks are cut into.
SLOTS = 1 << 14
#: Sources whose rows may be broadcast (about 100 bytes each); salts where they are more.
FEW_SOURCES, SALTS = 100_000, 64
#: Copies that are written out of one row at a time.
RUN = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """Not null, and in order of code points with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def draw(id_col: Column, text_digest: Column, seed: int) -> Column:
    """52 hashed bits of the id and the text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), text_digest)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def size_class(size: Column) -> Column:
    """The power of two below the size; 1 for 0."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(size)) - 1)


def pareto(k: Column, p: Column) -> Column:
    """The statistic by which documents rank: 0 if certain, null if they can't be taken."""
    u = (k.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p)))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share=1.5, cap=2.0) -> DataFrame:
    """(skey, source_size, target): ``share`` of all sizes, split by weight, none above ``cap`` times its source.

    The level at which uncapped sources fill is found from prefix sums over
    sources in the order in which they reach their caps; one row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    s = (
        sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
        .withColumn("pos", F.row_number().over(everything.orderBy("skey")) - 1)
        .withColumn("w", w)
        .withColumn("most", F.lit(cap) * F.col("source_size").cast("double"))
        .withColumn("full_at", F.col("most") / F.col("w"))
    )
    order = everything.orderBy("full_at", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    s = (
        s.withColumn("total", F.lit(share) * F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "pos", "level"))).over(everything)["level"])
    )
    return s.select("skey", "source_size", F.least(F.col("most"), F.col("level") * F.col("w")).alias("target"))


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with whole, rest and c: a document of size class v is sampled with probability min(1, c * v).

    The level c at which the classes' expected words add up to the rest is found from
    prefix sums over a source's classes, of which there are 63 at most.
    """
    t = (
        targets.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("ratio").cast("bigint"))
        .withColumn("rest", F.when(F.col("ratio") > F.col("whole"), F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))
    )
    larger = Window.partitionBy("skey").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("skey").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    per_class = (
        sizes.where("size > 0").groupBy("skey", size_class(F.col("size")).cast("double").alias("v")).agg(F.sum("size").cast("double").alias("s"))
        .withColumn("certain", F.coalesce(F.sum("s").over(larger), F.lit(0.0)))
        .withColumn("spread", F.sum(F.col("s") * F.col("v")).over(upto))
    )
    level = (
        per_class.join(t.select("skey", "rest"), "skey")
        .withColumn("c", (F.col("rest") - F.col("certain")) / F.col("spread"))
        .where("c * v <= 1").groupBy("skey").agg(F.max(F.struct("v", "c"))["c"].alias("c"))
    )
    return t.join(level, "skey", "left").select("skey", "source_size", "target", "whole", "rest", F.coalesce("c", F.lit(0.0)).alias("c"))


class Sources:
    """Rows of a table with one row a source, for joins by source."""

    def __init__(self, rows: DataFrame, few: bool) -> None:
        self.rows, self.few = rows, few

    def join(self, docs: DataFrame, key: str, how: str = "inner") -> DataFrame:
        if self.few:
            return docs.join(F.broadcast(self.rows), key, how)
        salted = self.rows.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return docs.withColumn("__salt", F.pmod(F.xxhash64(*docs.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def thresholds(sizes: DataFrame, t: DataFrame, few: bool) -> DataFrame:
    """``t`` with the slot in which a source's rest ends, the last rank (q, k, id, size) taken, and, if that is not all rows of that rank, how many.

    ``sizes`` has skey, id, size, k.
    """
    ranked = Sources(t.select("skey", "rest", "c"), few).join(sizes, "skey").withColumn("q", pareto(F.col("k"), F.least(F.lit(1.0), F.col("c") * size_class(F.col("size"))))).where("q IS NOT NULL").withColumn("slot", slot_of(F.col("q")))
    upto = Window.partitionBy("skey").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        ranked.groupBy("skey", "slot").agg(F.sum("size").alias("size"), F.max("rest").alias("rest"))
        .withColumn("base", F.sum("size").over(upto) - F.col("size"))
        .where((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("size") > F.col("rest")))
        .select("skey", F.col("slot").alias("cut"), "base")
    )
    rank = Window.partitionBy("skey").orderBy("q", "k", "id", "size")
    edge = (
        Sources(cut, few).join(ranked, "skey").where("slot = cut")
        .groupBy("skey", "q", "k", "id", "size").agg(F.count(F.lit(1)).alias("rows"), F.max("base").alias("base"), F.max("rest").alias("rest"))
        .withColumn("before", F.col("base") + F.sum(F.col("size") * F.col("rows")).over(rank.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("rows"))
        .withColumn("taken", F.when(F.col("before") > F.col("rest"), 0).when(F.col("size") == 0, F.col("rows")).otherwise(
            F.least(F.col("rows"), F.floor((F.col("rest") - F.col("before")) / F.greatest(F.col("size"), F.lit(1)) + 0.5))))
        .where("taken > 0").groupBy("skey").agg(F.max(F.struct("q", "k", "id", "size", F.when(F.col("taken") < F.col("rows"), F.col("taken")).alias("short"))).alias("last"))
    )
    return t.join(cut.select("skey", "cut"), "skey", "left").join(edge, "skey", "left")


def slot_of(q: Column) -> Column:
    return F.floor(q / (q + 1) * SLOTS).cast("int")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
           size_col: str | None = None, digest_col: str | None = None, weights=(3, 1, 2), share=1.5, cap=2.0, seed=42) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    Null text has size 0; null sources form one source, the last. Rows of size
    0 are sampled like others and add nothing. Rows that repeat an id are told
    apart by their texts; of rows equal in both, as many are taken as the target needs,
    whichever. Empty tables give empty results. Texts of any length are read whole. Other columns pass
    through. ``size_col`` and ``digest_col`` name columns that already hold the sizes and digests.
    """
    spark = docs.sparkSession
    size = F.col(size_col) if size_col else n_words(F.col(text_col))
    mark = F.col(digest_col) if digest_col else digest(F.col(text_col))
    slim = docs.select(source_key(F.col(source_col)).alias("skey"), F.col(id_col).alias("id"), size.alias("size"), draw(F.col(id_col), mark, seed).alias("k"))
    if not size_col:
        slim = written(slim, "mix-sizes")
    t = written(inclusion(slim, source_targets(slim, weights, share, cap)), "mix-sources")
    few = t.count() <= FEW_SOURCES
    t = written(thresholds(slim, t, few), "mix-thresholds")
    named = t.select(*[F.col(c).alias(f"__{c}") for c in t.columns])
    d = docs.withColumn("__skey", source_key(F.col(source_col))).withColumn("__size", size).withColumn("__k", draw(F.col(id_col), mark, seed))
    d = Sources(named, few).join(d, "__skey")
    d = d.withColumn("__q", pareto(F.col("__k"), F.least(F.lit(1.0), F.col("__c") * size_class(F.col("__size")))))
    at = slot_of(F.col("__q"))
    rank, last = F.struct("__q", "__k", F.col(id_col), "__size"), F.struct("__last.q", "__last.k", "__last.id", "__last.size")
    sampled = F.col("__q").isNotNull() & (F.col("__cut").isNull() | (at < F.col("__cut")) | ((at == F.col("__cut")) & F.coalesce(rank <= last, F.lit(False))))
    d = d.withColumn("__copies", F.col("__whole") + F.when(sampled, 1).otherwise(0))
    d = d.withColumn("__short", F.when(sampled & (at == F.col("__cut")) & (rank == last), F.col("__last.short")))
    plain = [*docs.columns, "__size", "__source_size", "__target", "__copies"]
    if t.where("last.short IS NOT NULL").limit(1).count() == 0:
        return d.select(*plain)
    # equal rows of which some are taken: counted before they meet, then written out again
    tied = [c for c in plain if c != "__copies"]
    groups = d.where("__short IS NOT NULL").groupBy(*tied, "__skey", "__whole", "__short").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("__skey").orderBy(F.xxhash64(*tied)).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__free", F.greatest(F.lit(0), F.col("__short") - F.coalesce(F.sum("__rows").over(before), F.lit(0))))
    runs = groups.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__rows") - 1, F.lit(RUN).cast("bigint"))))
    each = runs.withColumn("__row", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + RUN, F.col("__rows")) - 1)))
    each = each.withColumn("__copies", F.col("__whole") + F.when(F.col("__row") < F.col("__free"), 1).otherwise(0))
    return d.where("__short IS NULL").select(*plain).unionByName(each.select(*plain))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, columns as they were."""
    d = copies(docs, **options).where("__copies > 0")
    return d.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op10(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest(F.col("text")).alias("mark")), "mix-sizes")
    d = copies(slim, size_col="size", digest_col="mark")
    return d.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, COALESCE('0' || source, '1') AS skey,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || COALESCE(doc_id::VARCHAR, '') || ':' || md5(COALESCE(text, ''))), 1, 13))::BIGINT AS k
  FROM documents),
e AS (SELECT *, (1::BIGINT << (length(bin(size)) - 1)::INT)::DOUBLE AS v, (k::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) - 1 AS pos FROM d GROUP BY skey),
s1 AS (SELECT *, CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s0),
s2 AS (SELECT *, most / w AS full_at FROM s1),
s3 AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
          - COALESCE(sum(most) OVER (ORDER BY full_at, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY full_at, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
lv AS (SELECT level FROM s3 WHERE level <= full_at ORDER BY full_at, pos LIMIT 1),
t0 AS (SELECT skey, source_size, least(most, (SELECT level FROM lv) * w) AS target FROM s3),
t1 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t0),
t AS (SELECT *, floor(ratio) AS whole, CASE WHEN ratio > floor(ratio) THEN target - floor(ratio) * source_size ELSE 0 END AS rest FROM t1),
c0 AS (SELECT skey, v, sum(size)::DOUBLE AS s FROM e WHERE size > 0 GROUP BY skey, v),
c1 AS (
  SELECT *, COALESCE(sum(s) OVER (PARTITION BY skey ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS certain,
         sum(s * v) OVER (PARTITION BY skey ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spread FROM c0),
c2 AS (SELECT c1.skey, v, (rest - certain) / spread AS c FROM c1 JOIN t USING (skey)),
lc AS (SELECT skey, max_by(c, v) AS c FROM c2 WHERE c * v <= 1 GROUP BY skey),
p AS (SELECT e.*, t.source_size, t.target, t.whole, t.rest, least(1.0::DOUBLE, COALESCE(lc.c, 0.0::DOUBLE) * e.v) AS p FROM e JOIN t USING (skey) LEFT JOIN lc USING (skey)),
q AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q FROM p),
r AS (SELECT *, sum(size) OVER (PARTITION BY skey, q IS NULL ORDER BY q, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS mid FROM q)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN q IS NOT NULL AND mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
