"""XML Schema datatypes: parse, compare and restrict.

``validity`` and the facet predicates that Spark can express are Columns;
``SimpleType`` does the rest a value at a time inside Arrow batches.
"""

from __future__ import annotations

import base64
import calendar
import math
import re
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

#: Integer types and their bounds.
INTEGERS: dict[str, tuple[int | None, int | None]] = {
    "integer": (None, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "long": (-(1 << 63), (1 << 63) - 1), "int": (-(1 << 31), (1 << 31) - 1), "short": (-(1 << 15), (1 << 15) - 1), "byte": (-128, 127),
    "unsignedLong": (0, (1 << 64) - 1), "unsignedInt": (0, (1 << 32) - 1), "unsignedShort": (0, (1 << 16) - 1), "unsignedByte": (0, 255),
}
_START = r"A-Z_a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C-\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD"
_NEXT = _START + r"\-.0-9\u00B7\u0300-\u036F\u203F-\u2040"
#: Lexical forms, as regular expressions for both Java and Python.
LEXICAL = {
    "boolean": "true|false|1|0",
    "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
    "float": r"([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)|-?INF|NaN",
    "double": r"([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)|-?INF|NaN",
    "integer": "[+-]?[0-9]+",
    "hexBinary": "([0-9a-fA-F]{2})*",
    "base64Binary": r"(([A-Za-z0-9+/] ?){4})*((([A-Za-z0-9+/] ?){2}= ?=)|(([A-Za-z0-9+/] ?){3}=))?",
    "language": "[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*",
    "Name": f"[:{_START}][:{_NEXT}]*",
    "NCName": f"[{_START}][{_NEXT}]*",
    "NMTOKEN": f"[:{_NEXT}]+",
    "QName": f"([{_START}][{_NEXT}]*:)?[{_START}][{_NEXT}]*",
    "duration": r"-?P(?=.)([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?",
    "dateTime": r"-?([1-9][0-9]{3,}|0[0-9]{3})-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    "date": r"-?([1-9][0-9]{3,}|0[0-9]{3})-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?",
    "time": r"[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gYear": r"-?([1-9][0-9]{3,}|0[0-9]{3})(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gYearMonth": r"-?([1-9][0-9]{3,}|0[0-9]{3})-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gMonth": r"--[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gMonthDay": r"--[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gDay": r"---[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?",
}
LEXICAL |= {t: LEXICAL["integer"] for t in INTEGERS} | {t: LEXICAL["NCName"] for t in ("ID", "IDREF", "ENTITY")} | {"NOTATION": LEXICAL["QName"]}
LISTS = {"IDREFS": "IDREF", "ENTITIES": "ENTITY", "NMTOKENS": "NMTOKEN"}
TEXTS = {"string", "normalizedString", "token", "anyURI", "anySimpleType"}
PRESERVE, REPLACE = {"string", "anySimpleType"}, {"normalizedString"}
DATES = {"dateTime", "date", "time", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay"}


class XsdError(ValueError):
    pass


def white_space(s: str, how: str) -> str:
    if how == "preserve":
        return s
    s = re.sub("[\t\r\n]", " ", s)
    return s if how == "replace" else re.sub(" +", " ", s).strip(" ")


@dataclass(frozen=True)
class Moment:
    """A date or time: fields that its type lacks are None; ``tz`` in minutes, None without one."""

    kind: str
    year: int | None = None
    month: int | None = None
    day: int | None = None
    seconds: Decimal | None = None  # of the day
    tz: int | None = None

    def line(self, tz: int | None = None) -> Decimal:
        """Seconds on a common line, in UTC, with ``tz`` where the value has none."""
        y, m, d = self.year if self.year is not None else 2000, self.month or 1, self.day or 1
        days = days_from_civil(y, m, d)
        return Decimal(days) * 86400 + (self.seconds or 0) - Decimal(60) * (self.tz if self.tz is not None else tz or 0)

    def compare(self, other: Moment) -> int | None:
        """-1, 0, 1, or None where a zone within 14 hours could tip it."""
        if (self.tz is None) == (other.tz is None):
            return _sign(self.line() - other.line())
        signs = {_sign(self.line(z) - other.line(z)) for z in (-840, 840)}
        return signs.pop() if len(signs) == 1 and 0 not in signs else None


def _sign(x) -> int:
    return (x > 0) - (x < 0)


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar."""
    y -= m <= 2
    era = y // 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    yoe = y - era * 400
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def month_length(y: int, m: int) -> int:
    return 29 if m == 2 and calendar.isleap(y) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


_FIELDS = {
    "dateTime": r"(?P<y>-?\d+)-(?P<m>\d\d)-(?P<d>\d\d)T(?P<t>[\d:.]+)", "date": r"(?P<y>-?\d+)-(?P<m>\d\d)-(?P<d>\d\d)", "time": r"(?P<t>[\d:.]+)", "gYear": r"(?P<y>-?\d+)",
    "gYearMonth": r"(?P<y>-?\d+)-(?P<m>\d\d)", "gMonth": r"--(?P<m>\d\d)", "gMonthDay": r"--(?P<m>\d\d)-(?P<d>\d\d)", "gDay": r"---(?P<d>\d\d)",
}


def moment(kind: str, s: str) -> Moment:
    g = re.fullmatch(_FIELDS[kind] + r"(?P<z>Z|[+-]\d\d:\d\d)?", s).groupdict()
    tz = seconds = None
    if z := g["z"]:
        tz = 0 if z == "Z" else (int(z[1:3]) * 60 + int(z[4:])) * (-1 if z[0] == "-" else 1)
        if abs(tz) > 840 or (z != "Z" and int(z[4:]) > 59):
            raise XsdError(s)
    y, m, d = (int(g[k]) if g.get(k) is not None else None for k in "ymd")
    if y == 0 or (m is not None and not 1 <= m <= 12) or (d is not None and not 1 <= d <= month_length(y if y is not None else 2000, m or 1)):
        raise XsdError(s)
    if t := g.get("t"):
        h, mi, sec = t.split(":")
        seconds = Decimal(int(h) * 3600 + int(mi) * 60) + Decimal(sec)
        if int(mi) > 59 or Decimal(sec) >= 60 or seconds > 86400:
            raise XsdError(s)
        if seconds == 86400 and d is not None:  # midnight at the day's end
            seconds, d = Decimal(0), d + 1
            if d > month_length(y, m):
                d, m = 1, m + 1
            if m > 12:
                m, y = 1, y + 1
    return Moment(kind, y, m, d, seconds, tz)


@dataclass(frozen=True)
class Duration:
    months: int
    seconds: Decimal

    def compare(self, other: Duration) -> int | None:
        """By addition to the four moments the specification names; None if they disagree."""
        signs = {_sign(added(b, self).line() - added(b, other).line()) for b in (moment("dateTime", s) for s in ("1696-09-01T00:00:00Z", "1697-02-01T00:00:00Z", "1903-03-01T00:00:00Z", "1903-07-01T00:00:00Z"))}
        return signs.pop() if len(signs) == 1 else None


def duration(s: str) -> Duration:
    m = re.fullmatch(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?)?", s)
    sign = -1 if m[1] else 1
    y, mo, d, h, mi = (int(x or 0) for x in m.groups()[1:6])
    return Duration(sign * (12 * y + mo), sign * (Decimal(86400 * d + 3600 * h + 60 * mi) + Decimal(m[7] or 0)))


def added(at: Moment, by: Duration) -> Moment:
    """Months first, the day clamped to the month, then seconds."""
    m = at.year * 12 + at.month - 1 + by.months
    y, m = m // 12, m % 12 + 1
    d = min(at.day, month_length(y, m))
    total = Decimal(days_from_civil(y, m, d)) * 86400 + (at.seconds or 0) + by.seconds
    days, seconds = int(total // 86400), total % 86400
    z = days + 719468
    era = z // 146097
    doe = z - era * 146097
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    month = mp + (3 if mp < 10 else -9)
    return Moment(at.kind, yoe + era * 400 + (month <= 2), month, doy - (153 * mp + 2) // 5 + 1, seconds if at.seconds is not None else None, at.tz)


def java_pattern(pattern: str) -> str:
    r"""An XSD regular expression as one for Java and Spark: \i and \c spelt out, subtraction as intersection, the rest literal."""
    out, i, depth = [], 0, 0
    names = {"i": f":{_START}", "c": f":{_NEXT}"}
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n.lower() in names:
                inner = names[n.lower()]
                out.append(inner if depth and n in names else f"[^{inner}]" if n.isupper() else f"[{inner}]")
            elif n in "pP" and pattern[i + 2 : i + 5] == "{Is":
                end = pattern.index("}", i)
                out.append(f"\\{n}{{In{pattern[i + 5 : end]}}}")
                i = end - 1
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[":
            depth += 1
            if depth > 1 and out and out[-1] == "-":  # [a-z-[aeiou]]
                out[-1] = "&&[^"
                i += 1
                continue
        elif c == "]":
            depth -= 1
        elif c in "^$" and not depth:
            out.append("\\")
        out.append(c)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class SimpleType:
    """A datatype: a built-in one, or one derived by restriction, list or union."""

    name: str
    base: SimpleType | None = None
    item: SimpleType | None = None
    members: tuple[SimpleType, ...] = ()
    facets: dict = field(default_factory=dict)

    def restrict(self, **facets) -> SimpleType:
        """length, minLength, maxLength, pattern, enumeration, whiteSpace, min/maxInclusive, min/maxExclusive, totalDigits, fractionDigits."""
        return SimpleType(self.name, self, self.item, self.members, facets)

    def space(self) -> str:
        if "whiteSpace" in self.facets:
            return self.facets["whiteSpace"]
        if self.base:
            return self.base.space()
        return "preserve" if self.name in PRESERVE else "replace" if self.name in REPLACE else "collapse"

    def parse(self, text: str):
        """The value, or XsdError."""
        s = white_space(text, self.space())
        if self.base:
            value = self.base.parse(s)
            self.check(s, value)
            return value
        if self.members:
            for m in self.members:
                try:
                    return m.parse(text)
                except XsdError:
                    pass
            raise XsdError(text)
        if self.item:
            return tuple(self.item.parse(x) for x in s.split())
        return self.primitive(s)

    def primitive(self, s: str):
        n = self.name
        if n in LISTS:
            if not s:
                raise XsdError(s)
            return tuple(builtin(LISTS[n]).parse(x) for x in s.split(" "))
        if n in TEXTS:
            return s
        if not re.fullmatch(LEXICAL[n], s):
            raise XsdError(f"{s!r} is no {n}")
        if n == "boolean":
            return s in ("true", "1")
        if n == "decimal":
            return Decimal(s)
        if n in INTEGERS:
            low, high = INTEGERS[n]
            v = int(s)
            if (low is not None and v < low) or (high is not None and v > high):
                raise XsdError(f"{s} is out of {n}")
            return v
        if n in ("float", "double"):
            v = float(s.replace("INF", "inf"))
            if n == "float" and math.isfinite(v):
                import struct

                try:
                    v = struct.unpack("f", struct.pack("f", v))[0]
                except OverflowError as e:
                    raise XsdError(s) from e
            if math.isinf(v) and "INF" not in s:
                raise XsdError(s)
            return v
        if n == "hexBinary":
            return bytes.fromhex(s)
        if n == "base64Binary":
            return base64.b64decode(s.replace(" ", ""))
        if n == "duration":
            return duration(s)
        return moment(n, s) if n in DATES else s

    def check(self, s: str, value) -> None:
        f = self.facets
        size = len(value) if isinstance(value, (str, bytes, tuple)) else None
        digits = value.as_tuple() if isinstance(value, Decimal) else Decimal(value).as_tuple() if isinstance(value, int) and not isinstance(value, bool) else None
        plain = Decimal(value).normalize().as_tuple() if digits else None
        ok = (
            ("length" not in f or size == f["length"]) and ("minLength" not in f or size >= f["minLength"]) and ("maxLength" not in f or size <= f["maxLength"])
            and all(_full_match(p, s) for p in _many(f.get("pattern")))
            and ("enumeration" not in f or any(compare(value, self.base.parse(e)) == 0 for e in f["enumeration"]))
            and ("minInclusive" not in f or compare(value, self.base.parse(str(f["minInclusive"]))) in (0, 1)) and ("maxInclusive" not in f or compare(value, self.base.parse(str(f["maxInclusive"]))) in (0, -1))
            and ("minExclusive" not in f or compare(value, self.base.parse(str(f["minExclusive"]))) == 1) and ("maxExclusive" not in f or compare(value, self.base.parse(str(f["maxExclusive"]))) == -1)
            and ("fractionDigits" not in f or -plain.exponent <= f["fractionDigits"]) and ("totalDigits" not in f or max(len(plain.digits) + max(plain.exponent, 0), -plain.exponent) <= f["totalDigits"])
        )
        if not ok:
            raise XsdError(f"{s!r} breaks {sorted(f)}")

    def is_valid(self, text: str | None) -> bool:
        try:
            return text is not None and (self.parse(text), True)[1]
        except XsdError:
            return False


def _many(x) -> list:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _full_match(pattern: str, s: str) -> bool:
    import regex

    return regex.fullmatch(java_pattern(pattern).replace("\\p{In", "\\p{Block="), s, regex.V1) is not None


def compare(a, b) -> int | None:
    """-1, 0, 1 or None for values that have no order."""
    if isinstance(a, (Moment, Duration)):
        return a.compare(b) if type(a) is type(b) else None
    if isinstance(a, float) and (math.isnan(a) or math.isnan(b)):
        return 0 if math.isnan(a) and math.isnan(b) else None
    if a == b:
        return 0
    return _sign(a - b) if isinstance(a, (int, float, Decimal)) and not isinstance(a, bool) else None


def builtin(name: str) -> SimpleType:
    if name not in LEXICAL and name not in TEXTS and name not in LISTS:
        raise XsdError(f"no type {name!r}")
    return SimpleType(name)


def list_of(item: SimpleType) -> SimpleType:
    return SimpleType("list", item=item)


def union_of(*members: SimpleType) -> SimpleType:
    return SimpleType("union", members=members)


def valid_column(column, simple: SimpleType):
    """Validity as an Arrow-batched function; null is not valid."""
    @F.pandas_udf("boolean")
    def check(s: pd.Series) -> pd.Series:
        return s.map(simple.is_valid, na_action=None)

    return check(column)


def lexical_column(column, name: str):
    """Whether text has a type's lexical form, in the JVM; bounds of integers included where they fit a decimal."""
    c = F.btrim(F.regexp_replace(column, "[ \t\r\n]+", " "))
    ok = c.rlike(f"^(?:{LEXICAL[name]})$")
    if name in INTEGERS:
        v = F.when(F.length(c) <= 38, c).try_cast("decimal(38,0)")
        low, high = INTEGERS[name]
        ok &= (v >= F.lit(Decimal(low)) if low is not None else F.lit(True)) & (v <= F.lit(Decimal(high)) if high is not None else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def added_text(s: str, by: str) -> str:
    """A dateTime plus a duration, as text."""
    m = added(moment("dateTime", s), duration(by))
    sec = m.seconds
    whole = int(sec)
    frac = str(sec - whole)[1:].rstrip("0").rstrip(".") if sec != whole else ""
    zone = "" if m.tz is None else "Z" if m.tz == 0 else f"{'-' if m.tz < 0 else '+'}{abs(m.tz) // 60:02d}:{abs(m.tz) % 60:02d}"
    return f"{m.year:04d}-{m.month:02d}-{m.day:02d}T{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}{frac}{zone}"
