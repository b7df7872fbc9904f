"""``python -m xylem show|inspect|validate|xpath`` on one document, from a file or standard input."""

from __future__ import annotations

import argparse
import sys

from xylem.functions.xpath_eval import Evaluator
from xylem.operators import dtd, serialize
from xylem.operators.relaxng import Schema, Validator
from xylem.plans.xpath import compile_xpath
from xylem.sources.parser import parse


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    a = argparse.ArgumentParser(prog="xylem", description=__doc__)
    a.add_argument("command", choices=["show", "inspect", "validate", "xpath"])
    a.add_argument("file", nargs="?", help="standard input if absent or -")
    a.add_argument("--c14n", action="store_true", help="show: canonical form")
    a.add_argument("--relaxng", help="validate: a schema, compact if its name ends in .rnc; else the document's own DTD")
    a.add_argument("--expression", "-e", help="xpath: the expression")
    a.add_argument("--namespace", "-n", action="append", default=[], metavar="PREFIX=URI")
    o = a.parse_intermixed_args(argv)
    if o.file in (None, "-"):
        raw = sys.stdin.buffer.read()
    else:
        with open(o.file, "rb") as f:
            raw = f.read()
    p = parse(raw, base_uri=o.file, coalescing=o.command != "show")
    for level, domain, _, line, column, message in p.errors:
        print(f"{o.file or '-'}[line:{line},column:{column}][{domain}][{level}] {message}", file=sys.stderr)
    if any(e[0] == "fatal error" for e in p.errors):
        return 1
    if o.command == "show":
        print(serialize.canonical(p.nodes) if o.c14n else serialize.serialize(p.nodes), file=out)
    elif o.command == "inspect":
        for _, event, ns, prefix, local, qname, value, attrs in p.events:
            print(event, *(x for x in (ns, prefix, local, qname, value) if x is not None), *(f"{k[2]}={k[3]!r}" for k in attrs or ()), file=out)
    elif o.command == "validate":
        if o.relaxng:
            with open(o.relaxng, encoding="utf-8") as f:
                text = f.read()
            found = Validator(Schema.from_compact(text) if o.relaxng.endswith(".rnc") else Schema.from_xml(text)).errors(p.nodes)
        else:
            found = dtd.violations(p)
        for what in found:
            print(": ".join(what), file=out)
        return int(bool(found))
    else:
        e = Evaluator(p.nodes, dict(n.split("=", 1) for n in o.namespace))
        x = e.eval(compile_xpath(o.expression or "/"))
        for line in [e.string_value(i) for i in x] if isinstance(x, list) else [e.string(x)]:
            print(line, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
