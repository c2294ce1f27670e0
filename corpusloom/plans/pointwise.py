"""Conditions of one token tested in Python, where they are known only along a path."""

from __future__ import annotations

from collections.abc import Callable

import regex

from ..operators.predicates import Clause, pattern_of


def _whole(part: str) -> Callable[[str | None], bool]:
    """A test of a whole string against a value or a pattern."""
    if (pattern := pattern_of(part)) is None:
        return lambda v: v == part
    compiled = regex.compile(pattern.replace("\\z", "\\Z"))
    return lambda v: v is not None and compiled.search(v) is not None


def test_of(clause: Clause) -> Callable[[dict[str, str]], bool]:
    """Whether a clause holds of a token's attributes: a positive term of one that is there, a negative one of none that fits."""
    terms = [(t.positive, _whole(t.attribute) if pattern_of(t.attribute) else t.attribute, _whole(t.value)) for t in clause.terms]

    def holds(own: dict[str, str]) -> bool:
        for positive, name, fits in terms:
            values = [own.get(name)] if isinstance(name, str) else [v for k, v in own.items() if name(k)]
            if any(v is not None and fits(v) for v in values) != positive:
                return False
        return True

    return holds
