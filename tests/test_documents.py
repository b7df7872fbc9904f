import itertools
import re

import pytest

from xylem.functions import uri, xsd
from xylem.operators import catalog, dtd, inclusion, serialize
from xylem.operators.relaxng import Schema, SchemaError, Validator
from xylem.sources import parser
from xylem.sources.parser import parse
from xylem.streaming.push import advance


def test_events_of_a_small_document():
    p = parse('<?xml version="1.0" encoding="UTF-8"?>\n<root attr="foo" attr2="bar"></root>')
    assert [e[1] for e in p.events] == ["startDocument", "declaration", "startElement", "endElement", "endDocument"]
    assert [(a[2], a[3]) for a in p.events[2][7]] == [("attr", "foo"), ("attr2", "bar")]


def test_nodes_are_in_document_order():
    p = parse('<!DOCTYPE a [<!ATTLIST a k CDATA "d" i ID #IMPLIED>]><a xmlns:p="u" i=" 7 "><p:b>x<![CDATA[<]]></p:b><!--c--><?t d?></a>')
    assert [(n[4], n[8], n[9]) for n in p.nodes[2:]] == [("element", "a", None), ("namespace", "p", "u"), ("attribute", "i", "7"), ("attribute", "k", "d"), ("element", "p:b", "x<"), ("text", None, "x<"), ("comment", None, "c"), ("pi", "t", "d")]
    assert [n[11] for n in p.nodes if n[4] == "attribute"] == [True, False]
    assert p.nodes[0][1] == len(p.nodes) - 1
    kinds = [n[4] for n in parse("<a>x<![CDATA[y]]>z</a>", coalescing=False).nodes]
    assert kinds[2:] == ["text", "cdata", "text"]


@pytest.mark.parametrize("xml", ["", "<a>", "<a b='<'/>", "<a b='1' b='2'/>", "<a>&x;</a>", "<a>]]></a>", "<a/><b/>", "<a>\x01</a>", None])
def test_malformed(xml):
    p = parse(xml)
    assert p.errors[-1][0] == "fatal error"


@pytest.mark.parametrize("xml", ["<p:a/>", '<a xmlns:p=""/>', '<a xmlns:xml="u"/>', '<a xmlns:p="u" xmlns:q="u" p:x="1" q:x="2"/>'])
def test_namespace_errors(xml):
    assert [e[1] for e in parse(xml).errors][:1] in (["namespace"], ["parser"])


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-32", "iso-8859-1", "shift_jis", "euc_jp", "cp037"])
def test_encodings(codec):
    text = f'<?xml version="1.0" encoding="{codec if codec != "utf-8-sig" else "utf-8"}"?><a>' + ("é" if codec in ("iso-8859-1",) else "abc") + "</a>"
    assert parse(text.encode(codec)).nodes[-1][9] == ("é" if codec == "iso-8859-1" else "abc")
    parser.register_encoding("mine", "iso-8859-1")
    assert parser.resolve_encoding("MINE") == "iso8859-1"
    parser.unregister_encoding("mine")
    assert parser.resolve_encoding("mine") is None


def test_external_entities_come_from_resources_alone():
    xml = '<!DOCTYPE a [<!ENTITY e SYSTEM "e.xml">]><a>&e;</a>'
    assert "x" in "".join(n[9] or "" for n in parse(xml, external=True, resources={"e.xml": "x"}).nodes)
    assert any(e[1] == "skippedEntity" for e in parse(xml).events)


def test_serialization():
    assert serialize.escape_text("\r\"&'<>") == "&#13;&#34;&#38;&#39;&#60;&#62;"
    assert serialize.escape_attribute('a"b') == ('a"b', "'") and serialize.quoted("a\"'") == '"a&quot;\'"'
    xml = '<a xmlns:p="u" p:k="1"><b>x&#38;</b><!--c--><?t d?></a>'
    assert serialize.serialize(parse(xml).nodes) == xml
    assert [n[1:] for n in parse(serialize.serialize(parse(xml).nodes)).nodes] == [n[1:] for n in parse(xml).nodes]


def test_canonical_xml():
    xml = '<?xml version="1.0"?>\n<?p x?><!--c-->\n<a z="1" b:y="2" a="\t&lt;&quot;" xmlns:b="urn:b" xmlns="urn:a" ><c xmlns="urn:a" xmlns:d="urn:d"/><![CDATA[>&]]></a>\n<?q?>'
    want = '<?p x?>\n<a xmlns="urn:a" xmlns:b="urn:b" a=" &lt;&quot;" z="1" b:y="2"><c xmlns:d="urn:d"></c>&gt;&amp;</a>\n<?q?>'
    assert serialize.canonical(parse(xml).nodes) == want
    assert "<!--c-->\n<a" in serialize.canonical(parse(xml).nodes, comments=True)


def test_writer():
    w = serialize.Writer()
    w.declaration()
    w.start_dtd("a")
    w.element_decl("a", "ANY")
    w.internal_entity_decl("e", "v")
    w.end_dtd()
    w.start_element_ns("u", "p", "a")
    w.namespace_decl("p", "u")
    w.attribute("k", '<"')
    w.characters("x<")
    w.cdata("y")
    w.comment("c")
    w.processing_instruction("t", "d")
    w.general_entity_reference("e")
    text = w.finish()
    assert text == "<?xml version=\"1.0\"?><!DOCTYPE a [<!ELEMENT a ANY><!ENTITY e \"v\">]><p:a xmlns:p=\"u\" k='&#60;\"'>x&#60;<![CDATA[y]]><!--c--><?t d?>&e;</p:a>"
    w = serialize.Writer()
    w.start_element("a b")
    with pytest.raises(ValueError):
        w.finish()


def test_dtd_constraints():
    head = "<!DOCTYPE a [<!ELEMENT a (b|c)*><!ELEMENT b (#PCDATA|c)*><!ELEMENT c EMPTY><!ATTLIST b i ID #IMPLIED r IDREFS #IMPLIED f CDATA #FIXED 'x' k NMTOKENS #IMPLIED>]>"
    assert dtd.violations(parse(head + "<a><b i='p' r='p q' k='1 2'>t<c/></b><b i='q'/></a>")) == []
    found = {c for c, _ in dtd.violations(parse(head + "<a z='1'>t<b i='p' f='y' r='n'/><b i='p'/><c>x</c></a>"))}
    assert found == {"attribute declared", "element valid", "fixed attribute default", "ID unique", "IDREF"}


@pytest.mark.parametrize("pointer,want", [("id_root", "success"), ("bad_id", None), ("element(/1)", "success"), ("element(id_root/1)", "in"), ("xmlns(p=u)element(/9)element(/1/1)", "in"), ("element(/1/3)", None)])
def test_xpointer(pointer, want):
    nodes = parse('<root xml:id="id_root"><a>in</a>success</root>').nodes
    at = inclusion.point(nodes, pointer)
    got = None if at is None else "".join(n[9] for n in nodes[at : at + nodes[at][1] + 1] if n[4] == "text")
    assert got == ("insuccess" if want == "success" else want)


@pytest.mark.parametrize("bad", ["id:root", "element(", "element(/0)", "a b", ""])
def test_unparsable_pointers(bad):
    with pytest.raises(inclusion.PointerError):
        inclusion.point(parse("<a/>").nodes, bad)


def test_xinclude(spark):
    xi = 'xmlns:xi="http://www.w3.org/2001/XInclude"'
    docs = {
        "http://x/a.xml": f'<a {xi}><xi:include href="b.xml"/><xi:include href="t.txt" parse="text"/></a>',
        "http://x/b.xml": f'<b {xi}><xi:include href="none.xml"><xi:fallback>fell</xi:fallback></xi:include></b>',
        "http://x/t.txt": "1 < 2",
        "http://x/loop.xml": f'<l {xi}><xi:include href="loop.xml"/></l>',
        "http://x/gone.xml": f'<g {xi}><xi:include href="none.xml"/></g>',
    }
    table = spark.createDataFrame(list(docs.items()), "uri string, xml string")
    got = {r.uri: r for r in inclusion.expanded(table.where("uri NOT LIKE '%txt'"), table).collect()}
    assert "fell" in got["http://x/a.xml"].xml and "1 &#60; 2" in got["http://x/a.xml"].xml and "include" not in got["http://x/a.xml"].xml.replace(xi, "")
    assert got["http://x/gone.xml"].error and got["http://x/loop.xml"].error == "includes itself"


def test_catalogs():
    c = catalog.Catalog({
        "http://c/1": f'<catalog xmlns="{catalog.NS}" xml:base="http://b/"><system systemId="s" uri="exact"/><rewriteSystem systemIdStartString="http://e/" rewritePrefix="short/"/><rewriteSystem systemIdStartString="http://e/long/" rewritePrefix="long/"/><systemSuffix systemIdSuffix="tail" uri="suffix"/><delegateSystem systemIdStartString="urn:d" catalog="http://c/2"/><group prefer="system"><public publicId="P  Q" uri="pub"/></group><nextCatalog catalog="http://c/3"/></catalog>',
        "http://c/2": f'<catalog xmlns="{catalog.NS}"><system systemId="urn:d1" uri="http://delegated"/></catalog>',
        "http://c/3": f'<catalog xmlns="{catalog.NS}"><uri name="u" uri="http://next"/><public publicId="R" uri="http://r"/></catalog>',
    })
    assert c.external_id(system="s") == "http://b/exact" and c.external_id(system="http://e/long/x") == "http://b/long/x" and c.external_id(system="xtail") == "http://b/suffix"
    assert c.external_id(system="urn:d1") == "http://delegated" and c.external_id(system="urn:d2") is None
    assert c.external_id(public=" P Q ") == "http://b/pub" and c.external_id(public="P Q", system="other") is None and c.external_id(public="R", system="other") == "http://r"
    assert c.uri("u") == "http://next" and c.uri("nobody") is None and catalog.public_id("urn:publicid:-:OASIS:DTD+x") == "-//OASIS//DTD x"


@pytest.mark.parametrize("reference,want", [("g", "http://a/b/c/g"), ("./g/.", "http://a/b/c/g/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("?y", "http://a/b/c/d;p?y"), ("#s", "http://a/b/c/d;p?q#s"), ("//g", "http://g"), ("/g", "http://a/g"), ("g;x=1/../y", "http://a/b/c/y"), ("http:g", "http:g"), ("", "http://a/b/c/d;p?q"), ("..", "http://a/b/"), ("g?y/./x", "http://a/b/c/g?y/./x")])
def test_uri_resolution(reference, want):
    assert uri.resolve(reference, "http://a/b/c/d;p?q") == want


def test_uri_normalisation():
    assert uri.normalise("HTTP://Ex.COM/%7euser/a/./b/../c%2f") == "http://ex.com/~user/a/c%2F" and uri.unescape(uri.escape("é /")) == "é /"


@pytest.mark.parametrize("name,good,bad", [("boolean", "1", "yes"), ("decimal", "-01.50", "1e3"), ("float", "-INF", "1e99"), ("double", "1e99", "inf"), ("byte", "127", "128"), ("unsignedLong", "18446744073709551615", "-1"), ("hexBinary", "0aFF", "abc"), ("base64Binary", "YWI=", "YWI"), ("duration", "-P1Y2MT3.5S", "P"), ("dateTime", "2000-02-29T24:00:00Z", "1999-02-29T00:00:00"), ("date", "-0001-01-01+14:00", "0000-01-01"), ("gMonthDay", "--02-29", "--02-30"), ("NCName", "a-b", "a:b"), ("language", "en-US", "e_n"), ("NMTOKENS", "1 2", ""), ("QName", "a:b", "a:b:c")])
def test_datatypes(name, good, bad):
    t = xsd.builtin(name)
    assert t.is_valid(good) and not t.is_valid(bad) and not t.is_valid(None)


def test_facets_lists_and_unions():
    d = xsd.builtin("decimal").restrict(totalDigits=4, fractionDigits=2).restrict(maxInclusive="12.5", minExclusive=1)
    assert [d.is_valid(s) for s in ("12.50", "12.51", "1", "1.001", "9.25")] == [True, False, False, False, True]
    ints = xsd.list_of(xsd.builtin("int")).restrict(maxLength=2)
    assert ints.parse(" 1  2 ") == (1, 2) and not ints.is_valid("1 2 3")
    u = xsd.union_of(xsd.builtin("int"), xsd.builtin("boolean"))
    assert u.parse("1") == 1 and u.parse("true") is True and not u.is_valid("x")
    assert xsd.builtin("token").restrict(enumeration=["a b"]).is_valid(" a  b ") and xsd.compare(xsd.duration("P1M"), xsd.duration("P30D")) is None
    assert xsd.added_text("2000-01-31T10:00:00Z", "P1M") == "2000-02-29T10:00:00Z" and xsd.added_text("2001-03-31T00:00:00", "-P1M") == "2001-02-28T00:00:00"


def test_relaxng():
    v = Validator(Schema.from_xml('<grammar xmlns="http://relaxng.org/ns/structure/1.0"><start combine="choice"><ref name="a"/></start><start combine="choice"><element name="z"><empty/></element></start><define name="a"><element name="a"><interleave><zeroOrMore><ref name="a"/></zeroOrMore><optional><attribute name="k"><list><oneOrMore><value>x</value></oneOrMore></list></attribute></optional><mixed><optional><element><anyName><except><name>a</name></except></anyName><text/></element></optional></mixed></interleave></element></define></grammar>'))
    ok = lambda xml: not v.errors(parse(xml).nodes)
    assert ok("<a k='x x'>t<a/>u<b>v</b><a><a/></a></a>") and ok("<z/>") and not ok("<a k='y'/>") and not ok("<a><b/><b/></a>") and not ok("<z>t</z>") and not ok("<q/>")
    for bad in ("<element xmlns='http://relaxng.org/ns/structure/1.0' name='a'/>", "<nope/>", "<grammar xmlns='http://relaxng.org/ns/structure/1.0'/>", "<data xmlns='http://relaxng.org/ns/structure/1.0' type='q'/>"):
        with pytest.raises(SchemaError):
            Schema.from_xml(bad)


GRAMMAR = "<grammar xmlns='http://relaxng.org/ns/structure/1.0' datatypeLibrary='http://www.w3.org/2001/XMLSchema-datatypes'>{}</grammar>"


def start(inner, more=""):
    return GRAMMAR.format(f"<start><element name='r'>{inner}</element></start>{more}")


@pytest.mark.parametrize("bad", [
    start("<ref name='a'/>", "<define name='a'><ref name='a'/></define>"),
    start("<ref name='a'/>", "<define name='a'><optional><ref name='b'/></optional></define><define name='b'><group><ref name='a'/><text/></group></define>"),
    start("<ref name='nowhere'/>"),
    start("<list><element name='x'><empty/></element></list>"),
    start("<list><text/></list>"),
    start("<attribute name='a'><attribute name='b'/></attribute>"),
    start("<attribute name='a'/><attribute name='a'/>"),
    start("<attribute name='a'/><oneOrMore><attribute><anyName/></attribute></oneOrMore>"),
    start("<attribute><anyName/></attribute>"),
    start("<oneOrMore><group><attribute name='a'/><attribute name='b'/></group></oneOrMore>"),
    start("<data type='int'><except><text/></except></data>"),
    start("<data type='int'/><data type='int'/>"),
    start("<data type='int'/><element name='x'><empty/></element>"),
    start("<interleave><text/><text/></interleave>"),
    start("<interleave><element name='x'><empty/></element><element><anyName><except><name>y</name></except></anyName><empty/></element></interleave>"),
    GRAMMAR.format("<start><text/></start>"),
    GRAMMAR.format("<start><attribute name='a'/></start>"),
])
def test_relaxng_restrictions(bad):
    with pytest.raises(SchemaError):
        Schema.from_xml(bad)


@pytest.mark.parametrize("good", [
    start("<ref name='a'/>", "<define name='a'><element name='a'><optional><ref name='a'/></optional></element></define>"),
    start("<choice><attribute name='a'/><attribute name='a'/></choice>"),
    start("<attribute name='a'/><oneOrMore><attribute><anyName><except><name>a</name></except></anyName></attribute></oneOrMore>"),
    start("<attribute name='n'><data type='int'/></attribute><data type='int'/>"),
    start("<interleave><element name='x'><empty/></element><element><anyName><except><name>x</name></except></anyName><empty/></element><text/></interleave>"),
    GRAMMAR.format("<start><choice><element name='a'><empty/></element><notAllowed/></choice></start>"),
])
def test_relaxng_restrictions_allow(good):
    Schema.from_xml(good)


def test_schemas_that_read_themselves():
    one, two = (GRAMMAR.format(f"<start><element name='a'><externalRef href='{h}'/></element></start>") for h in ("two", "one"))
    with pytest.raises(SchemaError):
        Schema.from_xml(one, {"one": one, "two": two}, "one")
    with pytest.raises(SchemaError):
        Schema.from_xml(GRAMMAR.format("<include href='me'/>"), {"me": GRAMMAR.format("<include href='me'/>")}, "me")


def test_encoding_is_taken_from_a_declaration_only():
    text = '<a><![CDATA[<?xml version="1.0" encoding="x"?>]]></a>'
    assert [n[9] for n in parse(text).nodes if n[4] == "text"] == ['<?xml version="1.0" encoding="x"?>']
    assert not parse('<?xml version="1.0"    encoding="no-such"?><a/>').errors


def test_language_and_base_do_not_hang_on_the_order_of_attributes():
    nodes = parse('<a k="1" xml:lang="en" j="2" xml:base="x/y"/>', base_uri="http://h/d").nodes
    assert {(n[13], n[14]) for n in nodes if n[4] == "attribute"} == {("http://h/x/y", "en")}


def test_deep_documents():
    depth = 20_000
    xml = "<a>" * depth + "t" + "</a>" * depth
    nodes = parse(xml).nodes
    assert serialize.serialize(nodes) == serialize.canonical(nodes) == xml
    v = Validator(Schema.from_xml(start("<text/>").replace("'r'", "'a'")))
    assert v.errors(nodes)


@pytest.mark.parametrize("model", ["((b?,b?)*,c)", "((b|b)*,c)", "((b*)*,c)", "((b+)+,c)"])
def test_content_models_take_linear_time(model):
    xml = lambda body: f"<!DOCTYPE a [<!ELEMENT a {model}><!ELEMENT b EMPTY><!ELEMENT c EMPTY>]><a>{body}</a>"
    found = lambda body: [v for v in dtd.violations(parse(xml(body))) if v[0] == "element valid"]
    assert found("<b/>" * 2000) == [("element valid", "a")] and not found("<b/>" * 2000 + "<c/>") and bool(found("<c/>")) == ("+" in model) and found("<c/><b/>")


@pytest.mark.parametrize("model,words", [("(a,b?,(c|d)*,e+)", "abcde"), ("((a|b)+,c?)", "abc"), ("(a*,(b,c)?)", "abc")])
def test_content_models_are_regular_expressions(model, words):
    p = parse(f"<!DOCTYPE r [<!ELEMENT r {model}>]><r/>")
    m, pattern = dtd.ContentModel(p.dtd.elements["r"]), re.compile(model.replace(",", ""))
    for n in range(5):
        for names in itertools.product(words, repeat=n):
            assert m.allows(list(names)) == bool(pattern.fullmatch("".join(names)))


def test_declarations_that_are_not_valid():
    found = lambda d: [c for c, _ in dtd.violations(parse(f"<!DOCTYPE a [{d}]><a/>"))]
    assert "deterministic content model" in found("<!ELEMENT a ((b,c)|(b,d))?>") and "no duplicate types" in found("<!ELEMENT a (#PCDATA|b|b)*>")
    assert found("<!ELEMENT a (b,(c|d))?><!ELEMENT b EMPTY>") == []


def test_includes_of_any_depth_and_loops(spark):
    xi = 'xmlns:i="http://www.w3.org/2001/XInclude"'
    chain = [(f"http://h/{k}", f'<d{k} {xi}><i:include href="{k + 1}"/></d{k}>') for k in range(20)] + [("http://h/20", "<end/>")]
    loop = [("http://h/x", f'<x {xi}><i:include href="y"/></x>'), ("http://h/y", f'<y {xi}><i:include href="x"/></y>'), ("http://h/me", f'<me {xi}><i:include href="me"/></me>')]
    other = [("http://h/sub/l", f'<l xml:lang="de" {xi}><i:include href="p"/></l>'), ("http://h/sub/p", '<p xml:lang="fr"/>'), ("http://h/top", f'<top {xi}><i:include href="sub/l"/></top>'), ("http://h/acc", f'<a {xi}><i:include href="20" accept="\u00e9"/></a>')]
    all_ = spark.createDataFrame(chain + loop + other, "uri string, xml string")
    got = {r.uri: r for r in inclusion.expanded(all_, all_).collect()}
    assert got["http://h/0"].error is None and "<end" in got["http://h/0"].xml and "include" not in got["http://h/0"].xml.replace("XInclude", "")
    assert {got[f"http://h/{k}"].error for k in ("x", "y", "me")} == {"includes itself"} and "accept" in got["http://h/acc"].error
    nodes = parse(got["http://h/top"].xml, base_uri="http://h/top").nodes
    assert {n[7]: (n[13], n[14]) for n in nodes if n[4] == "element"} == {"top": ("http://h/top", None), "l": ("http://h/sub/l", "de"), "p": ("http://h/sub/p", "fr")}
    assert inclusion.CHAIN not in "".join(r.xml or "" for r in got.values())


def test_relaxng_compact():
    text = """
    default namespace d = "urn:d"
    namespace x = "urn:x"
    include "more.rnc" { b = element b { empty } }
    a.name = attribute \\x{6b} { xsd:int - "3" } | attribute x:* { text }+ [ x:note [ "y" ] ]
    start |= element z { grammar { start = element q { parent b } } }   # a comment
    """.replace("\\\\x", "\\x")
    more = "start |= element d:a { a.name, b*, (element * - d:b { list { xsd:token+ } | empty })? }\na.name &= empty\nb = notAllowed\n"
    more = 'namespace d = "urn:d"\n' + more.replace("a.name &= empty\n", "")
    v = Validator(Schema.from_compact(text, {"more.rnc": more}))
    ok = lambda xml: not v.errors(parse(xml).nodes)
    assert ok("<a xmlns='urn:d' k='4'><b/><b/></a>") and ok("<a xmlns='urn:d' xmlns:x='urn:x' x:p='1' x:q='2'/>") and ok("<z xmlns='urn:d'><q><b/></q></z>")
    assert not ok("<a xmlns='urn:d' k='3'/>") and not ok("<a k='4'/>") and not ok("<z xmlns='urn:d'/>") and not ok("<a xmlns='urn:d'/>")
    for bad in ("element a", "element a { b | c, d }", "start = q:x", "a = ", "element p:a { empty }", "\x01"):
        with pytest.raises(SchemaError):
            Schema.from_compact(bad)


def test_pushed_text_gives_the_events_of_the_whole():
    xml = '<a k="1">te<b/>xt<![CDATA[&]]></a>'
    events, given = [], 0
    for n in range(1, len(xml) + 1):
        new, failed = advance(xml[:n], given, n == len(xml))
        given += len(new)
        events += new
        assert not failed
    assert [(e[1], e[3]) for e in events] == [(e[1], e[6]) for e in parse(xml).events]
    assert advance("<a></b>", 0, True)[1]


def test_push_stream(spark, tmp_path):
    from xylem.streaming.push import push_events

    rows = [("d", 1, "x</a>", True), ("d", 0, "<a>", False), ("e", 0, "<b", False), ("e", 1, "></c>", True), ("d", 0, "<a>", False)]
    spark.createDataFrame(rows, "doc_id string, chunk_no int, data string, last boolean").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, chunk_no int, data string, last boolean").json(str(tmp_path / "in"))
    q = push_events(stream).writeStream.format("memory").queryName("pushed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.sql("SELECT * FROM pushed ORDER BY doc_id, seq").collect():
        got.setdefault(r.doc_id, []).append(r.event)
    assert got == {"d": ["startDocument", "startElement", "characters", "endElement", "endDocument"], "e": ["startDocument", "startElement", "fatalError"]}


def test_media_types():
    from xylem.functions.mediatype import media_type

    m = media_type('Application/Atom+XML; Charset="a\\"b"; v=1')
    assert (m.top, m.sub, m.suffix, m.is_xml, m.parameters) == ("application", "atom+xml", "xml", True, (("charset", 'a"b'), ("v", "1")))
    assert media_type("text/xml").is_xml and not media_type("text/html").is_xml and media_type("text") is None and media_type("a/b; c") is None


def test_command_line(tmp_path):
    import io

    from xylem.__main__ import main

    f, s = tmp_path / "a.xml", tmp_path / "s.rnc"
    f.write_text("<a><b>1</b><b>2</b></a>")
    s.write_text('element a { element b { "1" }+ }')
    run = lambda *a: (o := io.StringIO(), main([*map(str, a)], o), o.getvalue())[1:]
    assert run("xpath", f, "-e", "sum(//b)") == (0, "3\n") and run("xpath", f, "-e", "//b") == (0, "1\n2\n")
    assert run("show", f) == (0, "<a><b>1</b><b>2</b></a>\n") and run("show", "--c14n", f)[0] == 0 and "startElement" in run("inspect", f)[1]
    assert run("validate", f, "--relaxng", s) == (1, "text: b\n")
    f.write_text("<a>")
    assert run("show", f)[0] == 1
