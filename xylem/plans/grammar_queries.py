"""Registered queries that validate documents against a RELAX NG schema."""

from __future__ import annotations

from xylem.operators.relaxng import Schema, validated
from xylem.sources.fixtures import ITEMS_SQL, order_documents, part_documents

QUERIES, SQL = {}, {}

ORDER_SCHEMA = """<grammar xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes">
  <start><element name="order"><attribute name="id"><data type="long"/></attribute><attribute name="status"/><attribute name="total"><data type="double"/></attribute><oneOrMore><ref name="item"/></oneOrMore></element></start>
  <define name="item"><element name="item"><attribute name="n"><data type="positiveInteger"/></attribute><attribute name="part"><data type="integer"/></attribute>
    <attribute name="flag"><choice><value>R</value><value>A</value><value>N</value></choice></attribute>
    <interleave><element name="price"><data type="double"/></element><element name="qty"><data type="double"><param name="maxInclusive">48</param></data></element><optional><element name="note"><text/></element></optional></interleave></element></define>
</grammar>"""
PART_SCHEMA = """<element name="part" ns="urn:part" xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes">
  <zeroOrMore><attribute><nsName ns="http://www.w3.org/XML/1998/namespace"/></attribute></zeroOrMore>
  <attribute name="size"><data type="int"><except><value>7</value></except></data></attribute>
  <element name="name"><text/></element><element name="price" ns=""><data type="decimal"><param name="minExclusive">1000</param></data></element></element>"""


ORDER_COMPACT = """
# the same language
datatypes xsd = "http://www.w3.org/2001/XMLSchema-datatypes"
start = element order { attribute id { xsd:long }, attribute status { text }, attribute total { xsd:double }, item+ }
item = element item { attribute n { xsd:positiveInteger }, attribute part { xsd:integer }, attribute flag { "R" | "A" | "N" },
  (element price { xsd:double } & element qty { xsd:double { maxInclusive = "48" } } & element note { text }?) }
"""


def rng_valid(spark, sf):
    return validated(order_documents(spark, sf), Schema.from_xml(ORDER_SCHEMA)).select("doc_id", "valid")


def rng_names_and_except(spark, sf):
    return validated(part_documents(spark, sf), Schema.from_xml(PART_SCHEMA)).select("doc_id", "valid")


def rnc_valid(spark, sf):
    return validated(order_documents(spark, sf), Schema.from_compact(ORDER_COMPACT)).select("doc_id", "valid")


QUERIES["rng_valid"], SQL["rng_valid"] = rng_valid, f"{ITEMS_SQL} SELECT l_orderkey AS doc_id, max(l_quantity) <= 48 AS valid FROM items GROUP BY 1"
QUERIES["rng_names_and_except"], SQL["rng_names_and_except"] = rng_names_and_except, "SELECT p_partkey AS doc_id, p_size <> 7 AND p_retailprice > 1000 AS valid FROM part"
QUERIES["rnc_valid"], SQL["rnc_valid"] = rnc_valid, SQL["rng_valid"]
