"""Filter expressions as Columns: grammar, lists of facet, numeric and tag filters, and secured keys."""

from __future__ import annotations

import base64
import fnmatch
import hashlib
import hmac
import re
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qs, quote

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEX = re.compile(r"""\s*(?:(?P<number>-?\d+(?:\.\d+)?(?![\w.]))|(?P<op>!=|>=|<=|=|>|<|:)|(?P<paren>[()])|"(?P<dq>(?:\\.|[^"\\])*)"|'(?P<sq>[^']*)'|(?P<word>[^\s()=!<>:"']+))""")


class FilterError(ValueError):
    """A filter that does not parse."""


@dataclass
class Settings:
    """What filters need to know of an index."""

    #: attributes declared as facets, or None where undeclared facets are allowed
    facets: Collection[str] | None = None
    #: attributes whose column is an array
    arrays: Collection[str] = ()
    case_sensitive: bool = False
    columns: Mapping[str, Column] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return self.columns[name] if name in self.columns else F.col(".".join(f"`{p}`" for p in name.split(".")))


def declared_facets(attributes: Sequence[str]) -> dict[str, str]:
    """Attribute and modifier ('', filterOnly, searchable) of attributesForFaceting."""
    out = {}
    for a in attributes:
        m = re.fullmatch(r"(filterOnly|searchable)\((.*)\)", a.strip())
        out[m[2] if m else a.strip()] = m[1] if m else ""
    return out


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise FilterError(f"unexpected character at {at} of {text!r}")
        at = m.end()
        kind = m.lastgroup
        out.append(("string" if kind in ("dq", "sq") else kind, m[kind]) if kind else ("string", ""))
        if kind == "dq":
            out[-1] = ("quoted", m[kind].replace('\\"', '"'))
    return out


class Parser:
    """or -> and -> NOT | ( ... ) | comparison; keywords in any case, only as whole words and unquoted."""

    def __init__(self, text: str, settings: Settings):
        self.toks, self.at, self.s = _tokens(text), 0, settings

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else ("end", "")

    def keyword(self, word: str) -> bool:
        kind, v = self.peek()
        if kind == "word" and v.upper() == word and self.peek(1)[0] != "op":
            self.at += 1
            return True
        return False

    def parse(self) -> Column:
        out = self.either()
        if self.peek()[0] != "end":
            raise FilterError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.keyword("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.atom()
        while self.keyword("AND"):
            out = out & self.atom()
        return out

    def atom(self) -> Column:
        if self.keyword("NOT"):
            return ~F.coalesce(self.atom(), F.lit(False))  # a missing attribute does not have the value
        if self.peek() == ("paren", "("):
            self.at += 1
            out = self.either()
            if self.peek() != ("paren", ")"):
                raise FilterError("a bracket is not closed")
            self.at += 1
            return out
        return self.comparison()

    def value(self) -> str | float | int:
        kind, v = self.peek()
        if kind not in ("number", "word", "string", "quoted"):
            raise FilterError(f"a value is missing at {v!r}")
        self.at += 1
        if kind == "number":
            return float(v) if "." in v else int(v)
        return v

    def comparison(self) -> Column:
        kind, name = self.peek()
        if kind not in ("word", "quoted", "string"):
            raise FilterError(f"an attribute is missing at {name!r}")
        self.at += 1
        kind, op = self.peek()
        if kind != "op":
            raise FilterError(f"an operator is missing after {name!r}")
        self.at += 1
        v = self.value()
        if op == ":":
            k, word = self.peek()
            if k == "word" and word.upper() == "TO" and not isinstance(v, str):
                self.at += 1
                return self.s.column(name).between(v, self.value())
            return facet(name, str(v), self.s)
        c = self.s.column(name)
        if isinstance(v, str) and not self.s.case_sensitive:
            c, v = F.lower(c), v.lower()
        return {"=": c == v, "!=": ~c.eqNullSafe(F.lit(v)), ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]


def facet(name: str, value: str, s: Settings) -> Column:
    """attribute:value; an undeclared attribute matches nothing."""
    if s.facets is not None and name not in s.facets:
        return F.lit(False)
    c = s.column(name)
    if name in s.arrays:
        return F.exists(c, lambda x: F.lower(x.cast("string")) == value.lower()) if not s.case_sensitive else F.array_contains(c, value)
    text = c.cast("string")
    return (text == value) if s.case_sensitive else (F.lower(text) == value.lower())


def parse_filter(text: str | None, settings: Settings | None = None) -> Column:
    """A filter expression as a Column; an empty one matches everything."""
    return Parser(text, settings or Settings()).parse() if text and text.strip() else F.lit(True)


def _fold(items: Sequence | str | None, one: Callable[[str], Column]) -> Column:
    """Outer list AND, inner lists OR."""
    if not items:
        return F.lit(True)
    outer = [items] if isinstance(items, str) else items
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [one(y) for y in x]) if not isinstance(x, str) else one(x)
        for x in outer])


def facet_filters(items: Sequence | str | None, settings: Settings | None = None) -> Column:
    """["a:x", ["b:y", "b:-z"]]: a minus before the value negates, a backslash before the minus does not."""
    s = settings or Settings()

    def one(text: str) -> Column:
        name, _, value = text.partition(":")
        if value.startswith("-"):
            return ~F.coalesce(facet(name, value[1:], s), F.lit(False))
        return facet(name, value[1:] if value.startswith("\\-") else value, s)

    return _fold(items, one)


def numeric_filters(items: Sequence | str | None, settings: Settings | None = None) -> Column:
    """The same lists of comparisons and ranges, at a precision of 3 decimals."""
    s = settings or Settings()

    def one(text: str) -> Column:
        m = re.fullmatch(r"\s*([\w.]+)\s*(?:(<=|>=|!=|=|<|>)\s*(-?[\d.]+)|:\s*(-?[\d.]+)\s+TO\s+(-?[\d.]+))\s*", text, re.IGNORECASE)
        if not m:
            raise FilterError(f"not a numeric filter: {text!r}")
        c = F.round(s.column(m[1]), 3)
        if m[2] is None:
            return c.between(float(m[4]), float(m[5]))
        v = round(float(m[3]), 3)
        return {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[m[2]]

    return _fold(items, one)


def tag_filters(items: Sequence | str | None, column: str = "_tags") -> Column:
    return _fold(items, lambda t: ~F.array_contains(column, t[1:]) if t.startswith("-") else F.array_contains(column, t))


def optional_score(items: Sequence | str | None, settings: Settings | None = None, sum_or: bool = False) -> Column:
    """How many optional filters a row fits; `<score=n>` weighs one. Groups count their best, or their sum."""
    s = settings or Settings()

    def one(text: str) -> Column:
        m = re.fullmatch(r"(.*?)(?:<score=(\d+)>)?", text)
        name, _, value = m[1].partition(":")
        hit = facet(name, value.lstrip("-"), s)
        return F.when(~hit if value.startswith("-") else hit, int(m[2] or 1)).otherwise(0)

    total = F.lit(0)
    for x in [items] if isinstance(items, str) else items or []:
        scores = [one(y) for y in ([x] if isinstance(x, str) else x)]
        total = total + (reduce(lambda a, b: a + b, scores) if sum_or or len(scores) == 1 else F.greatest(*scores))
    return total


# --- secured keys


def secured_key(parent: str, restrictions: Mapping[str, object]) -> str:
    """A key that carries its restrictions, signed with the parent key."""
    params = "&".join(f"{k}={quote(','.join(v) if isinstance(v, list | tuple) else str(v), safe='')}" for k, v in sorted(
        restrictions.items()))
    return base64.b64encode((hmac.new(parent.encode(), params.encode(), hashlib.sha256).hexdigest() + params).encode()).decode()


class KeyRefused(PermissionError):
    """The key does not allow the request."""


def open_key(key: str, parent: str, index: str, now: int, allowed: Sequence[str] = ()) -> dict[str, str]:
    """The restrictions of a key that allows the index at the time `now` (epoch seconds)."""
    raw = base64.b64decode(key).decode()
    if not hmac.compare_digest(raw[:64], hmac.new(parent.encode(), raw[64:].encode(), hashlib.sha256).hexdigest()):
        raise KeyRefused("the signature differs")
    got = {k: v[0] for k, v in parse_qs(raw[64:]).items()}
    if "validUntil" in got and int(got["validUntil"]) < now:
        raise KeyRefused("the key has expired")
    for patterns in ([*allowed], got.get("restrictIndices", "").split(",") if "restrictIndices" in got else []):
        if patterns and not any(fnmatch.fnmatchcase(index, p) for p in patterns):
            raise KeyRefused(f"the key does not open {index}")
    return got


def secured_filter(restrictions: Mapping[str, str], user: str | None, settings: Settings | None = None) -> Column:
    """The key's filter AND the user's; each is parsed alone, so that neither changes the other."""
    return parse_filter(restrictions.get("filters"), settings) & parse_filter(user, settings)
