import math
import random

import pytest

from xylem.functions.xpath_eval import evaluate, text_of_number
from xylem.plans.planner import Planner
from xylem.plans.xpath import XPathError, compile_xpath
from xylem.sources.parser import parse
from xylem.sources.shred import shred

DOCS = [
    '<r xmlns:p="u" xml:lang="en"><a k="1" xml:id="i1">x<b>2</b><b>3</b></a><a k="2"><b n="q">10</b><!--c--><?t d?></a><p:a xml:lang="en-US">z<c><b>2</b></c></p:a></r>',
    "<r><a><a><b>5</b></a></a>tail</r>",
    "<r/>",
]
NODESETS = [
    "/r/a", "//b", "//b[1]", "(//b)[1]", "//b[last()]", "//a[b]", "//a[not(b)]", "//a[b>2]", "//a[b='2']", "//a[@k]/b[2]", "//a[@k=2]", "//b/..", "//b/ancestor::*", "//b/ancestor::*[1]",
    "//b/ancestor-or-self::*[2]", "//b/preceding::*", "//b/preceding::b[1]", "//b/following::node()", "//a/following-sibling::*", "//a/preceding-sibling::*[1]", "//@*", "//@k/..", "//text()",
    "//comment()|//processing-instruction('t')", "//p:a", "//p:*/c//b", "//a[count(b)=2]", "//a[b=../a/b]", "//*[b<..//b]", "//a[b!=b]", "//*[name()='p:a']", "//*[lang('en')]", "//a[position()=2 or @k='1']",
    "//a[position()<2][last()]", "id('i1')/b", "//b[string-length()>1]", "/r//a[.//b]", "/", "//r/descendant-or-self::node()", "//a/namespace::*", "//b[.=10]", "//a[sum(b)>4]", "//b[ancestor::a/@k]", "//node()[self::b]",
]
SCALARS = [
    "count(//b)", "sum(//b)", "sum(//a)", "string(//b)", "concat(//b,'-',count(//a))", "substring('12345',2,3)", "substring('12345',1.5,2.6)", "substring('12345',0 div 0,3)", "substring('12345',-42,1 div 0)",
    "substring-before('1999/04','/')", "substring-after('1999/04','/')", "substring-before('a','z')", "normalize-space('  a  b ')", "translate('--aaa--','abc-','ABC')", "boolean(//zz)", "not(//b)",
    "string-length(/r)", "floor(-1.5)", "ceiling(1.2)", "round(2.5)", "round(-2.5)", "number('x')", "number(' 12.5 ')", "7 mod -3", "-7 mod 3", "1 div 0", "-1 div 0", "3 + 4 * 2", "string(1 div 3)", "string(1e0)" if False else "string(100000000000)",
    "string(0.000001)", "true() = //b", "//b = false()", "'a' < 'b'", "2 >= '2'", "local-name(//p:*)", "namespace-uri(//*[3])", "name(//@k)", "starts-with('abc','ab')", "contains('abc','')", "-(-3)", "//b > 9 and //b < 3", "string(true())",
]
NS = {"p": "u"}


@pytest.fixture(scope="module")
def nodes(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, xml string")
    return shred(docs).cache()


@pytest.mark.parametrize("xpath", NODESETS)
def test_planner_selects_what_the_evaluator_selects(nodes, xpath):
    got = sorted((r.doc_id, r.pre, r.string_value) for r in Planner(nodes, NS).select(xpath).select("doc_id", "pre", "string_value").collect())
    from xylem.functions.xpath_eval import Evaluator

    want = []
    for i, xml in enumerate(DOCS):
        e = Evaluator(parse(xml).nodes, NS)
        want += [(i, n, e.string_value(n)) for n in e.eval(compile_xpath(xpath))]
    assert got == want


@pytest.mark.parametrize("xpath", SCALARS)
def test_planner_computes_what_the_evaluator_computes(nodes, xpath):
    got = {r.doc_id: r.result for r in Planner(nodes, NS).evaluate(xpath).collect()}
    for i, xml in enumerate(DOCS):
        want = evaluate(xpath, parse(xml).nodes, 0, NS)
        assert got[i] == want or (isinstance(want, float) and math.isnan(want) and math.isnan(got[i])), (i, xpath)


def test_random_paths(nodes):
    rng = random.Random(8)
    axes = ["child", "descendant", "parent", "ancestor", "following", "preceding", "following-sibling", "preceding-sibling", "self", "descendant-or-self", "ancestor-or-self"]
    from xylem.functions.xpath_eval import Evaluator

    for _ in range(6):
        xpath = "/" + "/".join(f"{rng.choice(axes)}::{rng.choice(['node()', '*', 'a', 'b'])}{rng.choice(['', '', '[1]', '[last()]', '[b]'])}" for _ in range(rng.randint(1, 2)))
        xpath = "//*" + xpath
        got = sorted((r.doc_id, r.pre) for r in Planner(nodes, NS).select(xpath).select("doc_id", "pre").collect())
        assert got == [(i, n) for i, xml in enumerate(DOCS) for n in Evaluator(parse(xml).nodes, NS).eval(compile_xpath(xpath))], xpath


@pytest.mark.parametrize("bad", ["", "//", "a[", "a]", "foo::b", "f(", "a b", "#", "1 +"])
def test_malformed_expressions(bad):
    with pytest.raises(XPathError):
        compile_xpath(bad)


def test_variables_and_numbers(nodes):
    assert Planner(nodes, NS, {"v": 2}).select("//a[@k=$v]").count() == 1
    assert evaluate("$v + 1", parse("<a/>").nodes, variables={"v": 2}) == 3
    assert [text_of_number(x) for x in (1e21, 1e-7, -0.0, 0.5, math.nan)] == ["1000000000000000000000", "0.0000001", "0", "0.5", "NaN"]
