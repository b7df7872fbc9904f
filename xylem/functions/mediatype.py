"""Media types: parse, suffix, and whether one is XML."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+"
_TYPE = re.compile(rf"\s*({_TOKEN})/({_TOKEN})\s*")
_PARAMETER = re.compile(rf';\s*({_TOKEN})=({_TOKEN}|"(?:[^"\\]|\\.)*")\s*')


@dataclass(frozen=True)
class MediaType:
    top: str
    sub: str
    parameters: tuple[tuple[str, str], ...] = ()

    @property
    def suffix(self) -> str | None:
        return self.sub.rpartition("+")[2] if "+" in self.sub else None

    @property
    def is_xml(self) -> bool:
        return self.suffix == "xml" or (self.top in ("text", "application") and self.sub in ("xml", "xml-external-parsed-entity", "xml-dtd"))

    def __str__(self) -> str:
        return f"{self.top}/{self.sub}" + "".join(f"; {k}={v}" for k, v in self.parameters)


def media_type(text: str) -> MediaType | None:
    """Types and parameter names in lower case; None if malformed."""
    m = _TYPE.match(text)
    if not m:
        return None
    at, found = m.end(), []
    while at < len(text):
        p = _PARAMETER.match(text, at)
        if not p:
            return None
        value = p[2]
        found.append((p[1].lower(), re.sub(r"\\(.)", r"\1", value[1:-1]) if value[0] == '"' else value))
        at = p.end()
    return MediaType(m[1].lower(), m[2].lower(), tuple(found))
