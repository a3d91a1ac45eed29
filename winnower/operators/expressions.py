"""A small boolean expression language compiled to a Column.

AND, OR, NOT, the six comparisons (also chained), names and constants; names and keywords in any case.  Comparisons with
a missing value are false; a number in the place of a condition means that it is not zero.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.functions.columns import all_of, any_of, closed

_KEYWORD = re.compile(r"\b(and|or|not|true|false)\b", re.IGNORECASE)
_PYTHON = {"and": "and", "or": "or", "not": "not", "true": "True", "false": "False"}
_COMPARE = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}


class ExpressionError(ValueError):
    """The text is not an expression of the language, or names an unknown column."""


def parse(text: str) -> ast.expr:
    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", text)  # quoted text stays as it is
    source = "".join(p if k % 2 else _KEYWORD.sub(lambda m: _PYTHON[m[1].lower()], p) for k, p in enumerate(parts))
    try:
        return ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"can't read {text!r}: {e.msg}") from e


def names(text: str) -> set[str]:
    return {n.id for n in ast.walk(parse(text)) if isinstance(n, ast.Name)}


class _Compiler:
    def __init__(self, df: DataFrame):
        self.fields = {f.name.lower(): f for f in df.schema}

    def value(self, node: ast.expr) -> tuple[Column, bool]:
        """(column, whether it is a condition)"""
        match node:
            case ast.Name():
                if node.id.lower() not in self.fields:
                    raise ExpressionError(f"unknown name {node.id!r}")
                f = self.fields[node.id.lower()]
                return F.col(f"`{f.name}`"), isinstance(f.dataType, T.BooleanType)
            case ast.Constant(value=bool(v)):
                return F.lit(v), True
            case ast.Constant(value=int(v) | float(v) | str(v)):
                return F.lit(v), False
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int(v) | float(v))):
                return F.lit(-v), False
            case ast.UnaryOp(op=ast.Not()) | ast.BoolOp() | ast.Compare():
                return self.condition(node), True
        raise ExpressionError(f"{type(node).__name__} is not part of the language")

    def condition(self, node: ast.expr) -> Column:
        match node:
            case ast.BoolOp(op=ast.And(), values=parts):
                return all_of([self.condition(p) for p in parts])
            case ast.BoolOp(op=ast.Or(), values=parts):
                return any_of([self.condition(p) for p in parts])
            case ast.UnaryOp(op=ast.Not(), operand=part):
                return ~self.condition(part)
            case ast.Compare(left=left, ops=ops, comparators=right):
                if any(type(o) not in _COMPARE for o in ops):
                    raise ExpressionError("only < <= > >= == != compare")
                sides = [self.value(s)[0] for s in (left, *right)]
                return all_of([closed(_COMPARE[type(o)](a, b)) for o, a, b in zip(ops, sides, sides[1:])])
        column, boolean = self.value(node)
        return closed(column if boolean else column != 0)


def compile_expression(df: DataFrame, text: str) -> Column:
    """The expression as a condition over the columns of ``df``, never NULL."""
    return _Compiler(df).condition(parse(text))
