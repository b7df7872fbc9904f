"""URI references: parse, resolve and normalise (RFC 3986)."""

from __future__ import annotations

import re

_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
_UNRESERVED = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def split(uri: str) -> tuple[str | None, str | None, str, str | None, str | None]:
    """scheme, authority, path, query, fragment; parts that are absent are None."""
    return _PARTS.match(uri).groups()


def join(scheme, authority, path, query, fragment) -> str:
    return (f"{scheme}:" if scheme is not None else "") + (f"//{authority}" if authority is not None else "") + path + (f"?{query}" if query is not None else "") + (f"#{fragment}" if fragment is not None else "")


def without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == ".." and (len(out) > 1 or (out and out[0] != "")):
            out.pop()
        if part in (".", ".."):
            if last:
                out.append("")
        else:
            out.append(part)
    joined = "/".join(out)
    return "/" + joined.lstrip("/") if path.startswith("/") and not joined.startswith("/") else joined


def resolve(reference: str, base: str) -> str:
    scheme, authority, path, query, fragment = split(reference)
    b_scheme, b_authority, b_path, b_query, _ = split(base)
    if scheme is not None or not base:
        return join(scheme, authority, without_dots(path) if scheme is not None else path, query, fragment)
    if authority is None:
        if not path:
            path, query = b_path, query if query is not None else b_query
        elif path.startswith("/"):
            path = without_dots(path)
        else:
            stem = "/" if b_authority is not None and not b_path else b_path[: b_path.rfind("/") + 1]
            path = without_dots(stem + path)
        authority = b_authority
    else:
        path = without_dots(path)
    return join(b_scheme, authority, path, query, fragment)


def escape(text: str, keep: str = "") -> str:
    safe = _UNRESERVED | set(keep)
    return "".join(c if c in safe else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def unescape(text: str) -> str:
    return re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)


def normalise(uri: str) -> str:
    """Lower-case scheme and host, upper-case escapes, unescaped unreserved characters, no dot segments."""
    scheme, authority, path, query, fragment = split(uri)

    def fix(part):
        if part is None:
            return None
        return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)) if chr(int(m[1], 16)) in _UNRESERVED else m[0].upper(), part)

    return join(scheme and scheme.lower(), fix(authority) and fix(authority).lower(), without_dots(fix(path)) if scheme is not None else fix(path), fix(query), fix(fragment))


def is_absolute(uri: str) -> bool:
    return split(uri)[0] is not None
