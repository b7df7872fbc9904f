"""XML documents built from relational tables, in DataFrame operations: what the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def escaped(c):
    """Text for content and attributes: markup escaped, characters that XML doesn't have dropped."""
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_documents(spark, sf_dir: str) -> DataFrame:
    """(doc_id, xml): <order id= status= total=><item n= part= flag=><qty/><price/><note/>?</item>...</order>, items in a total order."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    line = line.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate").alias("i"))
    items = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items"))  # an order's items, a few each
    item = F.transform(
        "items",
        lambda i, n: F.concat(
            F.lit('<item n="'), (n + 1).cast("string"), F.lit('" part="'), i["l_partkey"].cast("string"), F.lit('" flag="'), i["l_returnflag"], F.lit('"><qty>'), i["l_quantity"].cast("string"),
            F.lit("</qty><price>"), i["l_extendedprice"].cast("string"), F.lit("</price>"), F.when(i["l_discount"] > 0.05, F.lit("<note>sale</note>")).otherwise(""), F.lit("</item>")),
    )
    d = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    head = F.concat(F.lit('<order id="'), F.col("o_orderkey").cast("string"), F.lit('" status="'), F.col("o_orderstatus"), F.lit('" total="'), F.col("o_totalprice").cast("string"), F.lit('">'))
    return d.select(F.col("o_orderkey").alias("doc_id"), F.concat(head, F.concat_ws("", item), F.lit("</order>")).alias("xml"))


ITEMS_SQL = """
WITH items AS (
  SELECT l.*, o.o_orderstatus, o.o_totalprice,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n,
         count(*) OVER (PARTITION BY l_orderkey) AS m
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)
"""


def region_documents(spark, sf_dir: str) -> DataFrame:
    """(doc_id, xml), one a region: <region name=><nation key= name=><customer id= acct=/>...</nation>...</region>"""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    c = F.struct("c_custkey", F.concat(F.lit('<customer id="'), F.col("c_custkey").cast("string"), F.lit('" acct="'), F.col("c_acctbal").cast("string"), F.lit('"/>')).alias("x"))
    c = customer.groupBy("c_nationkey").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(c)), lambda s: s["x"])).alias("inner"))
    n = nation.join(c, nation["n_nationkey"] == c["c_nationkey"], "left")
    x = F.concat(F.lit('<nation key="'), F.col("n_nationkey").cast("string"), F.lit('" name="'), escaped(F.col("n_name")), F.lit('">'), F.coalesce("inner", F.lit("")), F.lit("</nation>"))
    n = n.groupBy("n_regionkey").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", x.alias("x")))), lambda s: s["x"])).alias("inner"))
    d = region.join(n, region["r_regionkey"] == n["n_regionkey"], "left")
    return d.select(F.col("r_regionkey").cast("bigint").alias("doc_id"), F.concat(F.lit('<region name="'), escaped(F.col("r_name")), F.lit('">'), F.coalesce("inner", F.lit("")), F.lit("</region>")).alias("xml"))


def part_documents(spark, sf_dir: str) -> DataFrame:
    """(doc_id, xml): <p:part xmlns:p="urn:part" xml:id= size=><p:name>..</p:name><price>..</price></p:part>"""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").repartition("p_partkey")  # the file may be one split
    return p.select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(F.lit('<p:part xmlns:p="urn:part" xml:id="p'), F.col("p_partkey").cast("string"), F.lit('" size="'), F.col("p_size").cast("string"), F.lit('" xml:lang="en-US"><p:name>'), escaped(F.col("p_name")),
                 F.lit("</p:name><price>"), F.col("p_retailprice").cast("string"), F.lit("</price></p:part>")).alias("xml"))


def article_documents(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text, xml): <doc xml:lang= source=><p>..</p></doc>, the text escaped."""
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    return d.select("doc_id", text.alias("text"), F.concat(F.lit('<doc xml:lang="'), F.coalesce("lang", F.lit("")), F.lit('"><p>'), escaped(text), F.lit("</p></doc>")).alias("xml"))
