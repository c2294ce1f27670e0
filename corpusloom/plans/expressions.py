"""Small expressions between dollar signs in a grammar's conditions and outputs, over the variables of a path."""

from __future__ import annotations

import ast
import operator
import re

#: ``$expression$``; neither sign of a macro nor a dollar stands inside.
FRAGMENT = re.compile(r"\$([^@$]+)\$")
#: Longer ones are refused, so that none costs more than its length.
MOST = 1000
#: How operators of scripts are written in Python.
_WRITTEN = (("===", "=="), ("!==", "!="), ("&&", " and "), ("||", " or "))
_NAMES = {"true": True, "false": False, "null": None, "undefined": None}
_NUMBERS = {ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_ORDER = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


class ExpressionError(ValueError):
    """An expression that cannot be read."""


def _number(x: object) -> int | float | None:
    if isinstance(x, (int, float)):
        return x
    try:
        return float(x) if not re.fullmatch(r"\s*-?\d+\s*", x) else int(x)
    except (TypeError, ValueError):
        return None


def shown(value: object) -> str:
    """A value as text: whole numbers without a fraction, nothing for null."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def read(text: str) -> ast.expr:
    """An expression of names, attributes, numbers, strings, arithmetic, comparisons, and, or, not; nothing is called."""
    if len(text) > MOST:
        raise ExpressionError(f"an expression of more than {MOST} signs")
    parts = re.split(r"(\"[^\"]*\"|'[^']*')", text)
    for k in range(0, len(parts), 2):
        for said, written in _WRITTEN:
            parts[k] = parts[k].replace(said, written)
        parts[k] = re.sub(r"!(?!=)", " not ", parts[k])
    try:
        found = ast.parse("".join(parts).strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as reason:
        raise ExpressionError(f"{text!r}: {reason}") from None
    kinds = (ast.Constant, ast.Name, ast.Attribute, ast.BinOp, ast.Add, *_NUMBERS, ast.UnaryOp, ast.USub, ast.Not, ast.BoolOp, ast.And, ast.Or, ast.Compare, ast.Eq, ast.NotEq, *_ORDER, ast.Load)
    for node in ast.walk(found):
        if not isinstance(node, kinds) or isinstance(node, ast.Constant) and not isinstance(node.value, (int, float, str)):
            raise ExpressionError(f"{text!r}: {type(node).__name__} is not allowed")
    return found


def value(node: ast.expr, variables: dict[str, object]) -> object:
    """What an expression comes to; a name that does not exist, and arithmetic without numbers, is null."""
    of = lambda n: value(n, variables)
    match node:
        case ast.Constant():
            return node.value
        case ast.Name():
            return _NAMES[node.id] if node.id in _NAMES else variables.get(node.id)
        case ast.Attribute():
            held = of(node.value)
            return len(held) if node.attr == "length" and isinstance(held, (str, list)) else held.get(node.attr) if isinstance(held, dict) else None
        case ast.UnaryOp(op=ast.Not()):
            return not of(node.operand)
        case ast.UnaryOp():
            return None if (x := _number(of(node.operand))) is None else -x
        case ast.BoolOp():
            for n in node.values:
                held = of(n)
                if bool(held) != isinstance(node.op, ast.And):
                    break
            return held
        case ast.BinOp(op=ast.Add()):
            a, b = of(node.left), of(node.right)
            x, y = _number(a), _number(b)
            return x + y if x is not None and y is not None else shown(a) + shown(b)
        case ast.BinOp():
            x, y = _number(of(node.left)), _number(of(node.right))
            if x is None or y is None or y == 0 and isinstance(node.op, (ast.Div, ast.Mod)):
                return None
            return _NUMBERS[type(node.op)](x, y)
    left = of(node.left)
    for op, n in zip(node.ops, node.comparators, strict=True):
        right = of(n)
        x, y = _number(left), _number(right)
        a, b = (x, y) if x is not None and y is not None else (shown(left), shown(right))
        if not (a == b if isinstance(op, ast.Eq) else a != b if isinstance(op, ast.NotEq) else _ORDER[type(op)](a, b)):
            return False
        left = right
    return True


def filled(code: str, variables: dict[str, object]) -> str:
    """A code with its fragments replaced by what they come to."""
    return FRAGMENT.sub(lambda m: shown(value(read(m[1]), variables)), code)
