"""Token conditions ``<name +attr=value -attr=/regex/i>`` as boolean Columns over a feature map."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"/(?:[^/\\]|\\.)*/i?|[^\s=<>/]+"
_TERM = re.compile(rf"\s*([+-])({_PART})=({_PART})")
_CLAUSE = re.compile(r"<\s*([^\s+\-<>=]*)((?:\s*[+-](?:[^<>]|\\.)*)?)>")
_MACRO = re.compile(r"@(\w+)@")


@dataclass(frozen=True)
class Term:
    positive: bool
    attribute: str
    value: str


@dataclass(frozen=True)
class Clause:
    """A conjunction of terms; with a ``span`` name it holds of spans rather than of tokens."""

    span: str
    terms: tuple[Term, ...]


def with_macros(code: str, macros: dict[str, str]) -> str:
    """``@name@`` replaced by its text; an unknown name is an error."""

    def text(m: re.Match) -> str:
        if m[1] not in macros:
            raise ValueError(f"unknown macro {m[1]}")
        return macros[m[1]]

    return _MACRO.sub(text, code)


def parse_clauses(code: str) -> list[Clause]:
    """The alternatives of a condition, divided by line ends or bars, in their order."""
    out, at = [], 0
    for m in _CLAUSE.finditer(code):
        if code[at : m.start()].strip(" \t\r\n|"):
            raise ValueError(f"bad condition: {code[at : m.start()]!r}")
        terms, end, at = [], 0, m.end()
        for t in _TERM.finditer(m[2]):
            if m[2][end : t.start()].strip():
                raise ValueError(f"bad condition: {m[0]!r}")
            terms.append(Term(t[1] == "+", t[2], t[3]))
            end = t.end()
        if m[2][end:].strip():
            raise ValueError(f"bad condition: {m[0]!r}")
        out.append(Clause(m[1], tuple(terms)))
    if not out or code[at:].strip(" \t\r\n|"):
        raise ValueError(f"bad condition: {code!r}")
    return out


def pattern_of(part: str) -> str | None:
    """The regular expression of ``/.../`` or ``/.../i``, for a match of the whole value."""
    if part.startswith("/") and part.rstrip("i").endswith("/") and len(part) > 1:
        body, flags = part[1:].rsplit("/", 1)
        return rf"\A(?:{'(?i)' if flags == 'i' else ''}{body})\z"
    return None


def matches(value: Column, part: str) -> Column:
    """Whether a value is the one named, or fits the pattern."""
    pattern = pattern_of(part)
    return value == part if pattern is None else value.rlike(pattern)


def term_column(term: Term, features: Column | dict[str, Column]) -> Column:
    """A missing attribute fails a positive term and passes a negative one; ``features`` is a map column or the attributes' own columns."""
    if isinstance(features, dict):
        name = pattern_of(term.attribute)
        names = [k for k in features if (k == term.attribute if name is None else re.fullmatch(name[2:-2], k))]
        found = F.lit(False)
        for k in names:
            found = found | F.coalesce(matches(features[k], term.value), F.lit(False))
    elif pattern_of(term.attribute) is None:
        found = matches(F.try_element_at(features, F.lit(term.attribute)), term.value)
    else:
        found = F.exists(F.map_entries(features), lambda e: matches(e["key"], term.attribute) & matches(e["value"], term.value))
    found = F.coalesce(found, F.lit(False))
    return found if term.positive else ~found


def clause_column(clause: Clause, features: Column | dict[str, Column]) -> Column:
    out = F.lit(True)
    for term in clause.terms:
        out = out & term_column(term, features)
    return out


def condition(code: str, features: Column, macros: dict[str, str] | None = None) -> Column:
    """A whole condition: any of its clauses."""
    out = F.lit(False)
    for clause in parse_clauses(with_macros(code, macros or {})):
        if clause.span:
            raise ValueError("a span clause is no condition of a token")
        out = out | clause_column(clause, features)
    return out


def generic(features: Column, wanted: dict[str, str]) -> Column:
    """Whether a token has all the features wanted."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(features, F.lit(k)) == v, F.lit(False))
    return out


def visible(features: Column, hidden: str) -> Column:
    """The feature map without internal entries."""
    return F.map_filter(features, lambda k, _: ~k.startswith(hidden))
