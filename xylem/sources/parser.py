"""One document: bytes to events, nodes and errors, on expat.

Node rows are numbered document, element, its namespace declarations, its
attributes, its children, which is document order. Malformed documents give
the rows read so far and an error; nothing raises.
"""

from __future__ import annotations

import codecs
import re
from xml.parsers import expat

from xylem.functions.uri import resolve

XML_NS = "http://www.w3.org/XML/1998/namespace"
XMLNS_NS = "http://www.w3.org/2000/xmlns/"

#: First bytes that tell an encoding before any declaration is read.
SIGNATURES = (
    (b"\x00\x00\xfe\xff", "utf-32-be"),
    (b"\xff\xfe\x00\x00", "utf-32-le"),
    (b"\x00\x00\x00<", "utf-32-be"),
    (b"<\x00\x00\x00", "utf-32-le"),
    (b"\xef\xbb\xbf", "utf-8"),
    (b"\xfe\xff", "utf-16-be"),
    (b"\xff\xfe", "utf-16-le"),
    (b"\x00<\x00?", "utf-16-be"),
    (b"<\x00?\x00", "utf-16-le"),
    (b"\x4c\x6f\xa7\x94", "cp037"),
)
_DECLARED = re.compile(rb"<\?xml\s[^>]*?encoding\s*=\s*[\"']([A-Za-z][A-Za-z0-9._-]*)[\"']")
_DECLARATION = re.compile(r"\A(<\?xml\s[^>]*?)\s+encoding\s*=\s*([\"'])[^\"']*\2")

#: Names under which further codecs are known; ``register_encoding`` adds to them.
ALIASES: dict[str, str] = {}


def register_encoding(alias: str, codec: str) -> None:
    ALIASES[alias.lower()] = codec


def unregister_encoding(alias: str) -> None:
    ALIASES.pop(alias.lower(), None)


def resolve_encoding(name: str) -> str | None:
    try:
        return codecs.lookup(ALIASES.get(name.lower(), name)).name
    except LookupError:
        return None


def detect_encoding(raw: bytes) -> str:
    """From a signature, else the declaration, else UTF-8."""
    for head, name in SIGNATURES:
        if raw.startswith(head):
            if name == "cp037":
                m = _DECLARED.search(raw[:512].decode("cp037", "replace").encode("utf-8", "replace"))
                return resolve_encoding(m[1].decode()) or name if m else name
            return name
    m = _DECLARED.match(raw[:1024].lstrip())
    return (resolve_encoding(m[1].decode()) if m else None) or "utf-8"


def decode(raw: bytes, encoding: str | None = None) -> str:
    text = raw.decode(resolve_encoding(encoding) or encoding if encoding else detect_encoding(raw))
    return text.removeprefix("﻿")


NODE_FIELDS = ("pre", "size", "level", "parent", "kind", "ns", "prefix", "local", "qname", "value", "att_type", "specified", "is_id", "base_uri", "lang")
NODE_SCHEMA = "pre int, size int, level int, parent int, kind string, ns string, prefix string, local string, qname string, value string, att_type string, specified boolean, is_id boolean, base_uri string, lang string"
EVENT_SCHEMA = "seq int, event string, ns string, prefix string, local string, qname string, value string, attrs array<struct<ns:string,local:string,qname:string,value:string,specified:boolean>>"
ERROR_SCHEMA = "level string, domain string, code string, line int, col int, message string"


class Dtd:
    """Declarations of a document's subsets."""

    def __init__(self) -> None:
        self.name = self.system_id = self.public_id = None
        self.elements: dict[str, tuple] = {}
        self.attributes: dict[str, dict[str, tuple]] = {}
        self.entities: dict[str, tuple] = {}
        self.notations: dict[str, tuple] = {}
        self.repeated: list[tuple[str, str]] = []


class Parser:
    """Parses one document; chunks may be fed as they come.

    ``resources`` maps system identifiers to text; external entities are read
    from there alone and only with ``external``.
    """

    def __init__(self, namespaces: bool = True, coalescing: bool = True, keep_comments: bool = True, resources: dict[str, str] | None = None, external: bool = False, base_uri: str | None = None, expand_entities: bool = True, record: bool = True) -> None:
        self.namespaces, self.coalescing, self.keep_comments = namespaces, coalescing, keep_comments
        self.resources, self.external, self.base_uri = resources or {}, external, base_uri
        self.nodes: list[list] = []
        self.events: list[tuple] = []
        self.errors: list[tuple] = []
        self.dtd = Dtd()
        self.standalone = None
        self.open: list[int] = []
        self.leaves: list[list[str] | None] = [None]  # of each open element its text, None once it has a child element
        self.record = record
        self.scopes: list[dict[str, str]] = [{"xml": XML_NS}]
        self.text: list[str] = []
        self.cdata = False
        p = self.p = expat.ParserCreate("utf-8")
        p.ordered_attributes = True
        p.specified_attributes = True  # defaults are added below, so that they can be told apart
        p.buffer_text = True
        p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_ALWAYS if external else expat.XML_PARAM_ENTITY_PARSING_NEVER)
        p.XmlDeclHandler = self.declaration
        p.StartElementHandler, p.EndElementHandler = self.start, self.end
        p.CharacterDataHandler = self.characters
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = self.start_cdata, self.end_cdata
        p.CommentHandler, p.ProcessingInstructionHandler = self.comment, self.instruction
        p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = self.start_doctype, self.end_doctype
        p.ElementDeclHandler, p.AttlistDeclHandler = self.element_decl, self.attribute_decl
        p.EntityDeclHandler, p.NotationDeclHandler = self.entity_decl, self.notation_decl
        p.ExternalEntityRefHandler, p.SkippedEntityHandler = self.external_entity, self.skipped
        if not expand_entities:
            p.DefaultHandler = self.unexpanded
        self.row("document", None, None, None, None, None)
        self.open.append(0)
        self.event("startDocument")

    def row(self, kind, ns, prefix, local, qname, value, att_type=None, specified=None, is_id=None) -> int:
        pre = len(self.nodes)
        parent = self.open[-1] if self.open else None
        up = self.nodes[parent] if parent is not None else None
        self.nodes.append([pre, 0, up[2] + 1 if up else 0, parent, kind, ns, prefix, local, qname, value, att_type, specified, is_id, up[13] if up else self.base_uri, up[14] if up else None])
        return pre

    def event(self, event, ns=None, prefix=None, local=None, qname=None, value=None, attrs=None) -> None:
        if not self.record:
            return
        self.events.append((len(self.events), event, ns, prefix, local, qname, value, attrs))

    def error(self, code: str, message: str, domain: str = "parser", level: str = "error") -> None:
        self.errors.append((level, domain, code, self.p.CurrentLineNumber, self.p.CurrentColumnNumber + 1, message))

    def flush(self) -> None:
        if self.text:
            text = "".join(self.text)
            self.text.clear()
            kind = "cdata" if self.cdata and not self.coalescing else "text"
            if len(self.open) > 1:
                self.row(kind, None, None, None, None, text)
                if self.leaves[-1] is not None:
                    self.leaves[-1].append(text)
            self.event("cdata" if kind == "cdata" else "characters", value=text)

    def declaration(self, version, encoding, standalone) -> None:
        self.standalone = {1: True, 0: False}.get(standalone)
        self.event("declaration", value=f"{version}, {encoding}, {self.standalone}")

    def resolve(self, qname: str, attribute: bool = False) -> tuple[str | None, str | None, str]:
        prefix, colon, local = qname.partition(":")
        if not colon:
            return (None if attribute else self.scopes[-1].get("") or None), None, qname
        ns = self.scopes[-1].get(prefix)
        if ns is None:
            self.error("UndefinedPrefix", f"The prefix {prefix!r} isn't bound.", "namespace")
        return ns, prefix, local

    def start(self, name: str, flat: list[str]) -> None:
        self.flush()
        pairs = list(zip(flat[::2], flat[1::2], strict=True))
        declared, n_specified = self.dtd.attributes.get(name, {}), len(pairs)
        given = {k for k, _ in pairs}
        pairs += [(k, default) for k, (_, default, _) in declared.items() if default is not None and k not in given]
        scope = self.scopes[-1]
        bound = [(k[6:] if k != "xmlns" else "", v) for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")] if self.namespaces else []
        if bound:
            scope = scope | dict(bound)
            for prefix, uri in bound:
                if prefix == "xmlns" or (prefix == "xml") != (uri == XML_NS) or uri == XMLNS_NS or (prefix and not uri):
                    self.error("ReservedNamespace", f"{prefix!r} can't be bound to {uri!r}.", "namespace")
        self.scopes.append(scope)
        ns, prefix, local = self.resolve(name) if self.namespaces else (None, None, name)
        pre = self.row("element", ns, prefix, local, name, None)
        self.open.append(pre)
        self.leaves[-1] = None
        self.leaves.append([])
        for k, v in pairs:  # before any attribute has a row, whatever their order
            if k == "xml:lang":
                self.nodes[pre][14] = v
            elif k == "xml:base":
                self.nodes[pre][13] = resolve(v, self.nodes[pre][13] or "")
        for p, uri in bound:
            self.row("namespace", None, None, p, p, uri)
        attrs, seen = [], set()
        for i, (k, v) in enumerate(pairs):
            if self.namespaces and (k == "xmlns" or k.startswith("xmlns:")):
                continue
            a_ns, a_prefix, a_local = self.resolve(k, True) if self.namespaces else (None, None, k)
            if (a_ns, a_local) in seen:
                self.error("DuplicateAttribute", f"The attribute {k!r} is given twice.", "namespace")
            seen.add((a_ns, a_local))
            kind = declared.get(k, ("CDATA",))[0]
            is_id = kind == "ID" or k == "xml:id"
            if k == "xml:id":
                v = " ".join(v.split())
            self.row("attribute", a_ns, a_prefix, a_local, k, v, kind, i < n_specified, is_id)
            attrs.append((a_ns, a_local, k, v, i < n_specified))
        self.event("startElement", ns, prefix, local, name, None, attrs)

    def end(self, name: str) -> None:
        self.flush()
        pre = self.open.pop()
        node = self.nodes[pre]
        node[1] = len(self.nodes) - 1 - pre
        text = self.leaves.pop()
        if text is not None:
            node[9] = "".join(text)
        self.scopes.pop()
        self.event("endElement", node[5], node[6], node[7], node[8])

    def characters(self, data: str) -> None:
        self.text.append(data)

    def start_cdata(self) -> None:
        if not self.coalescing:
            self.flush()
            self.cdata = True

    def end_cdata(self) -> None:
        if not self.coalescing:
            self.flush()
            self.cdata = False

    def comment(self, data: str) -> None:
        if self.keep_comments:
            self.flush()
            self.row("comment", None, None, None, None, data)
            self.event("comment", value=data)

    def instruction(self, target: str, data: str) -> None:
        self.flush()
        self.row("pi", None, None, target, target, data)
        self.event("processingInstruction", local=target, qname=target, value=data)

    def start_doctype(self, name, system_id, public_id, has_internal) -> None:
        self.dtd.name, self.dtd.system_id, self.dtd.public_id = name, system_id, public_id
        self.row("doctype", None, None, name, name, None)
        self.event("startDTD", local=name, qname=name, value=system_id)

    def end_doctype(self) -> None:
        self.event("endDTD")

    def element_decl(self, name, model) -> None:
        if name in self.dtd.elements:
            self.dtd.repeated.append(("element", name))
        self.dtd.elements.setdefault(name, model)

    def attribute_decl(self, element, name, kind, default, required) -> None:
        self.dtd.attributes.setdefault(element, {}).setdefault(name, (kind, default, bool(required)))

    def entity_decl(self, name, is_parameter, value, base, system_id, public_id, notation) -> None:
        self.dtd.entities.setdefault(("%" if is_parameter else "") + name, (value, system_id, public_id, notation))

    def notation_decl(self, name, base, system_id, public_id) -> None:
        if name in self.dtd.notations:
            self.dtd.repeated.append(("notation", name))
        self.dtd.notations.setdefault(name, (system_id, public_id))

    def external_entity(self, context, base, system_id, public_id) -> int:
        if self.external and system_id in self.resources:
            sub = self.p.ExternalEntityParserCreate(context)
            sub.Parse(self.resources[system_id], True)
        else:
            self.event("skippedEntity", value=system_id)
        return 1

    def skipped(self, name, is_parameter) -> None:
        self.event("skippedEntity", qname=name)

    def unexpanded(self, data: str) -> None:
        if data.startswith("&") and data.endswith(";") and len(self.open) > 1:
            self.flush()
            self.row("entity_ref", None, None, data[1:-1], data[1:-1], None)
            self.event("startEntity", qname=data[1:-1])
            self.event("endEntity", qname=data[1:-1])

    def feed(self, text: str | bytes, last: bool = False) -> bool:
        """Whether the document can still be well-formed."""
        if self.errors and self.errors[-1][0] == "fatal error":
            return False
        try:
            self.p.Parse(text, last)
        except expat.ExpatError as e:
            self.flush()
            self.errors.append(("fatal error", "parser", expat.ErrorString(e.code), e.lineno, e.offset + 1, str(e)))
            return False
        if last:
            self.flush()
            self.nodes[0][1] = len(self.nodes) - 1
            self.event("endDocument")
        return True


def parse(xml: str | bytes | None, encoding: str | None = None, **options) -> Parser:
    """A string is taken as it is, whatever encoding it declares; bytes are decoded. Null is an empty, malformed document."""
    p = Parser(**options)
    try:
        text = decode(xml, encoding) if isinstance(xml, (bytes, bytearray)) else xml or ""
        p.feed(_DECLARATION.sub(r"\1", text, count=1), True)  # at the very start alone
    except (UnicodeDecodeError, LookupError) as e:
        p.errors.append(("fatal error", "encoder", "UnsupportedEncoding", 1, 1, str(e)))
    return p
