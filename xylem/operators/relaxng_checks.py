"""What a RELAX NG schema may not say: references that never end, and the standard's restrictions (section 7).

Patterns are those of ``relaxng.Schema``, with every element behind a reference.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Fixed values of the standard: below each pattern, what may not occur at any depth before an element (7.1).
FORBIDDEN = {
    "attribute": {"attribute", "element"},
    "list": {"list", "element", "attribute", "text", "interleave"},
    "except": {"attribute", "element", "list", "text", "empty", "group", "interleave", "oneOrMore"},
    "start": {"attribute", "data", "value", "list", "text", "group", "interleave", "oneOrMore", "empty"},
}


class Restriction(ValueError):
    pass


def parts(p) -> list:
    """The patterns directly inside one, but for an exception."""
    k = p[0]
    if k in ("choice", "group", "interleave", "after"):
        return [p[1], p[2]]
    if k in ("oneOrMore", "list"):
        return [p[1]]
    return [p[2]] if k == "attribute" else []


class Checker:
    def __init__(self, start, definitions: dict) -> None:
        self.start, self.definitions = start, definitions
        self.elements = {k: p for k, p in definitions.items() if p[0] == "element"}

    def check(self) -> None:
        used = self.reachable()
        self.paths(self.start, ("start",))
        for name in used:
            if name in self.elements:
                body = self.elements[name][2]
                self.paths(body, ())
                if self.content(body) is None:
                    raise Restriction("a group of text or data with what isn't (7.2)")

    def reachable(self) -> set[str]:
        """Names of the elements in use; every reference is looked at once, and none may lead to itself without an element between."""
        seen: set[str] = set()
        stack = [self.start]
        state: dict[str, int] = {}
        while stack:
            for name in self.references(stack.pop(), state):
                if name not in seen:
                    seen.add(name)
                    stack.append(self.elements[name][2])
        return seen

    def references(self, p, state: dict[str, int]) -> list[str]:
        found, todo = [], [(p, False)]
        while todo:
            q, leaving = todo.pop()
            if leaving:
                state[q] = 2
            elif q[0] == "ref":
                name = q[1]
                if name in self.elements:
                    found.append(name)
                elif name not in self.definitions:
                    raise Restriction(f"{name.split(' ')[-1]!r} isn't defined")
                elif state.get(name) == 1:
                    raise Restriction(f"{name.split(' ')[-1]!r} refers to itself without an element between")
                elif name not in state:  # else its elements were found before
                    state[name] = 1
                    todo += [(name, True), (self.definitions[name], False)]
            else:
                todo += [(x, False) for x in parts(q)]
                if q[0] == "data" and q[4] is not None:
                    todo.append((q[4], False))
        return found

    def of(self, p):
        while p[0] == "ref" and p[1] not in self.elements:
            p = self.definitions[p[1]]
        return p

    def paths(self, p, above: tuple[str, ...], repeated: bool = False) -> None:
        """Forbidden paths, and attributes and names that clash, down to the next elements."""
        p = self.of(p)
        k = "element" if p[0] == "ref" else p[0]
        for a in above:
            if k in FORBIDDEN.get(a, ()):
                raise Restriction(f"{a}//{k}")
        if k == "attribute":
            if {"oneOrMore//group", "oneOrMore//interleave"} & set(above):
                raise Restriction("oneOrMore//group//attribute")
            if infinite(p[1]) and not repeated:
                raise Restriction("an attribute of infinitely many names needs oneOrMore (7.3)")
        if k in ("group", "interleave"):
            self.attributes_differ(p)
            if k == "interleave":
                self.interleaved(p)
        if k == "data" and p[4] is not None:
            self.paths(p[4], ("except",))
        inner = (*above, k)
        if k in ("group", "interleave") and "oneOrMore" in above:
            inner = (*inner, f"oneOrMore//{k}")
        for q in parts(p):
            self.paths(q, ("attribute",) if k == "attribute" else inner, repeated or k == "oneOrMore")

    def leaves(self, p, kind: str) -> Iterator:
        """Attributes, elements or text of a pattern, not inside attributes or elements."""
        p = self.of(p)
        if p[0] == "ref":
            if kind == "element":
                yield self.elements[p[1]][1]
        elif p[0] == kind:
            yield p[1] if kind == "attribute" else p
        elif p[0] not in ("attribute", "list"):
            for q in parts(p):
                yield from self.leaves(q, kind)

    def attributes_differ(self, p) -> None:
        right = list(self.leaves(p[2], "attribute"))
        for a in self.leaves(p[1], "attribute"):
            if any(overlap(a, b) for b in right):
                raise Restriction("an attribute is given twice (7.3)")

    def interleaved(self, p) -> None:
        right = list(self.leaves(p[2], "element"))
        if any(overlap(a, b) for a in self.leaves(p[1], "element") for b in right):
            raise Restriction("elements of one name on both sides of interleave (7.4)")
        if all(next(self.leaves(q, "text"), None) for q in (p[1], p[2])):
            raise Restriction("text on both sides of interleave (7.4)")

    def content(self, p) -> int | None:
        """The content type: 0 empty, 1 complex, 2 simple; None if there is none."""
        p = self.of(p)
        k = p[0]
        if k in ("value", "list", "data"):
            return 2
        if k in ("text", "ref"):
            return 1
        if k == "attribute":
            return None if self.content(p[2]) is None else 0
        if k in ("empty", "notAllowed"):
            return 0
        types = [self.content(q) for q in parts(p)]
        if None in types:
            return None
        if k == "choice":
            return max(types)
        if k == "oneOrMore":
            types = types * 2
        return max(types) if 0 in types or types == [1, 1] else None


def infinite(names) -> bool:
    return names[0] in ("any", "ns") or (names[0] == "or" and (infinite(names[1]) or infinite(names[2])))


def contains(names, ns: str, local: str) -> bool:
    k = names[0]
    if k == "name":
        return names[1:] == (ns, local)
    if k == "or":
        return contains(names[1], ns, local) or contains(names[2], ns, local)
    if k == "any":
        return names[1] is None or not contains(names[1], ns, local)
    return names[1] == ns and (names[2] is None or not contains(names[2], ns, local))


def witnesses(names) -> set[tuple[str, str]]:
    """Names that stand for every region a name class tells apart; no real name holds a line feed."""
    k, other = names[0], "\n"
    if k == "name":
        return {names[1:]}
    if k == "or":
        return witnesses(names[1]) | witnesses(names[2])
    own = {(other, other)} if k == "any" else {(names[1], other)}
    without = names[1] if k == "any" else names[2]
    return own if without is None else own | witnesses(without)


def overlap(a, b) -> bool:
    """Whether some name is in both classes."""
    return any(contains(a, *w) and contains(b, *w) for w in witnesses(a) | witnesses(b))
