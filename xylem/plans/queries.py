"""Registered queries over documents built from the tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.plans.batches import Documents
from xylem.sources.fixtures import ITEMS_SQL, order_documents, part_documents, region_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NS = {"p": "urn:part"}


def orders(spark, sf):
    return Documents(order_documents(spark, sf))


def regions(spark, sf):
    return Documents(region_documents(spark, sf))


def parts(spark, sf):
    return Documents(part_documents(spark, sf), NS)


def register(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def values(name: str, plan, xpath: str, kind: str, sql: str) -> None:
    """The string-values a path selects, one row a node."""
    register(name, lambda spark, sf: plan(spark, sf).select(xpath, ("string_value",)).select("doc_id", F.col("string_value").cast(kind).alias("value")), sql)


def result(name: str, plan, xpath: str, sql: str, change=None) -> None:
    """A number, string or Boolean for each document."""
    register(name, lambda spark, sf: plan(spark, sf).evaluate(xpath).select("doc_id", (change(F.col("result")) if change else F.col("result")).alias("value")), sql)


def item_sql(value: str, where: str = "TRUE", more: str = "") -> str:
    return f"{ITEMS_SQL}{more} SELECT l_orderkey AS doc_id, {value} AS value FROM items WHERE {where}"


# Axes
values("xp_child", orders, "/order/item/@part", "bigint", item_sql("l_partkey"))
values("xp_descendant", orders, "//item[qty>30]/@n", "bigint", item_sql("n", "l_quantity > 30"))
values("xp_attribute", orders, "/order/@status", "string", f"{ITEMS_SQL} SELECT DISTINCT l_orderkey AS doc_id, o_orderstatus AS value FROM items")
values("xp_parent", orders, "//qty[.>45]/../@n", "bigint", item_sql("n", "l_quantity > 45"))
values("xp_ancestor", orders, "//qty[.>45]/ancestor::order/@id", "bigint", f"{ITEMS_SQL} SELECT DISTINCT l_orderkey AS doc_id, l_orderkey AS value FROM items WHERE l_quantity > 45")
values("xp_self", orders, "//item/self::item[@flag='A']/@n", "bigint", item_sql("n", "l_returnflag = 'A'"))
values("xp_following_sibling", orders, "/order/item[@flag='R'][1]/following-sibling::item/@n", "bigint", item_sql("n", "n > f", ", r AS (SELECT l_orderkey AS k, min(n) AS f FROM items WHERE l_returnflag = 'R' GROUP BY 1)").replace("FROM items WHERE n > f", "FROM items JOIN r ON l_orderkey = k WHERE n > f"))
values("xp_preceding_sibling", orders, "/order/item[@flag='R'][last()]/preceding-sibling::item/@n", "bigint", item_sql("n", "n < f", ", r AS (SELECT l_orderkey AS k, max(n) AS f FROM items WHERE l_returnflag = 'R' GROUP BY 1)").replace("FROM items WHERE n < f", "FROM items JOIN r ON l_orderkey = k WHERE n < f"))
values("xp_following", orders, "//item[2]/following::qty", "double", item_sql("l_quantity", "n > 2"))
values("xp_preceding", orders, "//item[3]/preceding::qty", "double", item_sql("l_quantity", "n < 3 AND m >= 3"))
values("xp_descendant_or_self", orders, "/order/descendant-or-self::*[@n or @id]/@*[name()='n' or name()='id']", "bigint", f"{ITEMS_SQL} SELECT l_orderkey AS doc_id, n AS value FROM items UNION ALL SELECT DISTINCT l_orderkey, l_orderkey FROM items")
values("xp_ancestor_or_self", regions, "//customer[@acct<0]/ancestor-or-self::*/@name", "string", "SELECT DISTINCT n_regionkey::BIGINT AS doc_id, x AS value FROM (SELECT n_regionkey, UNNEST([r_name, n_name]) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0)")
values("xp_namespace", parts, "//price/namespace::p", "string", "SELECT p_partkey AS doc_id, 'urn:part' AS value FROM part")
# Predicates and positions
values("xp_pred_value", orders, "/order/item[price>20000]/@n", "bigint", item_sql("n", "l_extendedprice > 20000"))
values("xp_pred_exists", orders, "//item[note]/@n", "bigint", item_sql("n", "l_discount > 0.05"))
values("xp_pred_not", orders, "//item[not(note)]/@n", "bigint", item_sql("n", "NOT l_discount > 0.05"))
values("xp_pred_and_or", orders, "//item[@flag='R' and (qty>40 or note)]/@n", "bigint", item_sql("n", "l_returnflag = 'R' AND (l_quantity > 40 OR l_discount > 0.05)"))
values("xp_pred_position", orders, "/order/item[2]/@part", "bigint", item_sql("l_partkey", "n = 2"))
values("xp_pred_last", orders, "/order/item[last()]/@part", "bigint", item_sql("l_partkey", "n = m"))
values("xp_top_k", orders, "/order/item[position()<=2]/@n", "bigint", item_sql("n", "n <= 2"))
values("xp_chained_pred", orders, "/order/item[@flag='R'][2]/@n", "bigint", f"{ITEMS_SQL} SELECT l_orderkey AS doc_id, n AS value FROM items WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n) = 2")
values("xp_filter_expr", orders, "(//qty)[3]", "double", item_sql("l_quantity", "n = 3"))
values("xp_reverse_position", orders, "/order/item[last()]/preceding-sibling::item[1]/@n", "bigint", item_sql("n", "n = m - 1"))
values("xp_nodeset_eq", orders, "/order/item[@part=../item[1]/@part]/@n", "bigint", f"{ITEMS_SQL} SELECT a.l_orderkey AS doc_id, a.n AS value FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND b.n = 1 AND a.l_partkey = b.l_partkey")
values("xp_nodeset_ne", orders, "/order[item/@flag!=item/@flag]/@id", "bigint", f"{ITEMS_SQL} SELECT l_orderkey AS doc_id, l_orderkey AS value FROM items GROUP BY 1 HAVING min(l_returnflag) <> max(l_returnflag)")
values("xp_nodeset_lt", orders, "/order[@total < item/price]/@id", "bigint", f"{ITEMS_SQL} SELECT l_orderkey AS doc_id, l_orderkey AS value FROM items GROUP BY 1 HAVING min(o_totalprice) < max(l_extendedprice)")
values("xp_text", orders, "//note/text()", "string", item_sql("'sale'", "l_discount > 0.05"))
values("xp_qname_test", parts, "/p:part/p:name", "string", "SELECT p_partkey AS doc_id, p_name AS value FROM part")
values("xp_any_in_namespace", parts, "//p:*[@size>25]/@xml:id", "string", "SELECT p_partkey AS doc_id, 'p' || p_partkey AS value FROM part WHERE p_size > 25")
values("xp_id", parts, "id(concat('p',substring-after(/*/@xml:id,'p')))/price", "double", "SELECT p_partkey AS doc_id, p_retailprice AS value FROM part")
values("xp_union", orders, "//item[qty>40]/@n | //item[note]/@n", "bigint", item_sql("n", "l_quantity > 40 OR l_discount > 0.05"))


def set_query(operation: str, a: str, b: str):
    def run(spark, sf):
        return getattr(orders(spark, sf), operation)(a, b, ("string_value",)).select("doc_id", F.col("string_value").cast("bigint").alias("value"))

    return run


register("xp_intersection", set_query("intersection", "//item[qty>40]/@n", "//item[note]/@n"), item_sql("n", "l_quantity > 40 AND l_discount > 0.05"))
register("xp_difference", set_query("difference", "//item[qty>40]/@n", "//item[note]/@n"), item_sql("n", "(l_quantity > 40) <> (l_discount > 0.05)"))

# Aggregates
GROUPED = "{0} SELECT l_orderkey AS doc_id, {1} AS value FROM items GROUP BY 1"
result("xp_count", orders, "count(//item[qty>30])", GROUPED.format(ITEMS_SQL, "count(*) FILTER (l_quantity > 30)::DOUBLE"))
result("xp_sum", orders, "sum(//qty)", GROUPED.format(ITEMS_SQL, "sum(l_quantity)"))
result("xp_exists", orders, "boolean(//item[@flag='R'])", GROUPED.format(ITEMS_SQL, "bool_or(l_returnflag = 'R')"))
result("xp_string_value", orders, "string-length(string(/order/item[1]))", GROUPED.format(ITEMS_SQL, "max(CASE WHEN n = 1 THEN length(l_quantity::VARCHAR) + length(l_extendedprice::VARCHAR) + CASE WHEN l_discount > 0.05 THEN 4 ELSE 0 END END)::DOUBLE"))

# Functions, over parts
PART = "SELECT p_partkey AS doc_id, {} AS value FROM part"
for _name, _xpath, _sql in (
    ("concat", "concat(/*/p:name,'/',/*/@size)", "p_name || '/' || p_size"),
    ("contains", "contains(/*/p:name,'a')", "contains(p_name, 'a')"),
    ("starts_with", "starts-with(/*/p:name,'p')", "starts_with(p_name, 'p')"),
    ("substring", "substring(/*/p:name,2,3)", "substr(p_name, 2, 3)"),
    ("substring_before", "substring-before(/*/p:name,' ')", "CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, 1, strpos(p_name, ' ') - 1) ELSE '' END"),
    ("substring_after", "substring-after(/*/p:name,' ')", "CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END"),
    ("string_length", "string-length(/*/p:name)", "length(p_name)::DOUBLE"),
    ("normalize_space", "normalize-space(concat('  ',/*/p:name,'  x '))", "trim(p_name) || ' x'"),
    ("translate", "translate(/*/p:name,'abc','AB')", "translate(p_name, 'abc', 'AB')"),
    ("floor", "floor(//price)", "floor(p_retailprice)"),
    ("ceiling", "ceiling(//price)", "ceil(p_retailprice)"),
    ("round", "round(//price)", "floor(p_retailprice + 0.5)"),
    ("number", "number(/*/@size) * 2 - 1", "p_size * 2.0::DOUBLE - 1"),
    ("mod", "/*/@size mod 7", "(p_size % 7)::DOUBLE"),
    ("div", "//price div 4", "p_retailprice / 4"),
    ("boolean", "boolean(/*/@size > 20)", "p_size > 20"),
    ("not", "not(/*/@size = 20)", "p_size <> 20"),
    ("lang", "boolean(//price[lang('en')])", "TRUE"),
    ("name", "concat(name(/*),' ',local-name(/*),' ',namespace-uri(/*))", "'p:part part urn:part'"),
):
    result(f"xp_fn_{_name}", parts, _xpath, PART.format(_sql))


def flagship(spark, sf):
    """Items of over 30 per order document."""
    return orders(spark, sf).counted("//item[qty>30]").withColumnRenamed("n", "n_items")


register("m0_items", flagship, "SELECT l_orderkey AS doc_id, count(*) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 30 GROUP BY 1")
