"""Arithmetic formulas over named inputs, compiled to a column expression.

Only numbers, names, + - * / **, signs and the functions abs, sqrt, log, exp, min and max are allowed; anything else is
refused when the formula is compiled, so no text of a user reaches the SQL parser. A result that isn't finite, a division
by zero or a null input gives null.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of a formula, of its exponents and bases, and the digits of a result.
MAX_LENGTH, MAX_NODES, MAX_DEPTH, MAX_VARIABLES, MAX_EXPONENT, MAX_BASE, DIGITS = 500, 100, 20, 30, 100.0, 1e50, 10
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
}
_CALLS = {
    "abs": (1, 1, lambda a: F.abs(a)),
    "sqrt": (1, 1, lambda a: F.when(a >= 0, F.sqrt(a))),
    "log": (1, 2, lambda a, b=None: F.when(a > 0, F.log(a)) if b is None else F.when((a > 0) & (b > 0) & (b != 1), F.try_divide(F.log(a), F.log(b)))),
    "exp": (1, 1, lambda a: F.exp(a)),
    "min": (2, 20, lambda *a: F.when(F.forall(F.array(*a), lambda x: x.isNotNull()), F.least(*a))),
    "max": (2, 20, lambda *a: F.when(F.forall(F.array(*a), lambda x: x.isNotNull()), F.greatest(*a))),
}


def compile_formula(text: str, inputs: dict[str, Column]) -> Column:
    """The value of the formula for the given columns; ValueError for anything that is not allowed."""
    if not text or len(text) > MAX_LENGTH:
        raise ValueError("formula is empty or too long")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError("formula can't be read") from error
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise ValueError("formula has too many parts")

    def depth(node: ast.AST) -> int:
        return 1 + max(map(depth, ast.iter_child_nodes(node)), default=0)

    if depth(tree.body) > MAX_DEPTH:
        raise ValueError("formula is nested too deeply")
    if not 1 <= len(inputs) <= MAX_VARIABLES:
        raise ValueError(f"formula needs 1 to {MAX_VARIABLES} inputs")

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in inputs:
            return inputs[node.id].cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            value = build(node.operand)
            return -value if isinstance(node.op, ast.USub) else value
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            base, power = build(node.left), build(node.right)
            return F.when((F.abs(power) <= MAX_EXPONENT) & (F.abs(base) <= MAX_BASE), F.pow(base, power))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            least, most, make = _CALLS[node.func.id]
            if least <= len(node.args) <= most:
                return make(*[build(a) for a in node.args])
        raise ValueError(f"formula holds a part that is not allowed: {type(node).__name__}")

    value = build(tree.body)
    return F.when(~F.isnan(value) & (F.abs(value) <= 1e100), F.round(value, DIGITS))
