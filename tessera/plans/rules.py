"""Rules written as Python-like expressions, compiled to columns. Only a few forms are allowed."""

from __future__ import annotations

import ast
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnsafeExpressionError(ValueError):
    """The rule holds something that rules may not hold."""


_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Mod: operator.mod,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_MOST_POWER = 10


def compile_rule(rule: str, fields: Iterable[str]) -> Column:
    """A column for a rule over ``fields``: numbers, texts, fields (also as ``row.field``), + - * / % **, chained
    comparisons, and / or / not. Anything else raises UnsafeExpressionError."""
    known = set(fields)
    try:
        tree = ast.parse(rule, mode="eval")
    except SyntaxError as e:
        raise UnsafeExpressionError(str(e)) from e

    def build(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return build(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str, bool)):
            return F.lit(n.value)
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and not n.attr.startswith("_") and n.value.id not in known:
            n = ast.Name(n.attr)
        if isinstance(n, ast.Name):
            if n.id not in known:
                raise UnsafeExpressionError(f"unknown field {n.id}")
            return F.col(f"`{n.id}`")
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Pow):
            if not isinstance(n.right, ast.Constant) or not isinstance(n.right.value, (int, float)) or abs(n.right.value) > _MOST_POWER:
                raise UnsafeExpressionError("powers must be small constants")
            return F.pow(build(n.left), build(n.right))
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](build(n.left), build(n.right))
        if isinstance(n, ast.UnaryOp):
            if isinstance(n.op, ast.Not):
                return ~build(n.operand)
            if isinstance(n.op, ast.USub):
                return -build(n.operand)
        if isinstance(n, ast.BoolOp):
            parts = [build(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(n.op, ast.And) else (out | p)
            return out
        if isinstance(n, ast.Compare) and all(type(o) in _COMPARE for o in n.ops):
            sides = [build(x) for x in (n.left, *n.comparators)]
            tests = [_COMPARE[type(o)](a, b) for o, a, b in zip(n.ops, sides, sides[1:])]
            out = tests[0]
            for t in tests[1:]:
                out = out & t
            return out
        raise UnsafeExpressionError(f"{type(n).__name__} is not allowed")

    return build(tree)


def evaluate(df: DataFrame, rules: dict[str, str], storm: int = 5) -> DataFrame:
    """A row per rule and row it holds on; a rule that holds on more than ``storm`` rows becomes one summary."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(compile_rule(r, df.columns), F.lit(False)), F.lit(n)) for n, r in rules.items())))
    rows = df.withColumn("rule", F.explode(hits))
    counts = rows.groupBy("rule").agg(F.count("*").alias("hits"))
    return rows.join(counts, "rule").withColumn("summary", F.col("hits") > storm)
