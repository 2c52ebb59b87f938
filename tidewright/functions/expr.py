"""Two small arithmetic languages, parsed by Python's grammar against a whitelist and compiled to Columns.

Numbers follow IEEE rules: division by zero gives infinity or NaN, comparisons with NaN are false (!= is true), remainders
take the divisor's sign. NULL stays NULL and is never true.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


class ExpressionError(ValueError):
    pass


def _div(a: Column, b: Column) -> Column:
    inf = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, inf).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def _floor_div(a: Column, b: Column) -> Column:
    q = _div(a, b)
    return F.when(F.isnan(q) | (F.abs(q) == float("inf")), q).otherwise(F.floor(q).cast("double"))


def _mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, NAN).otherwise(a - F.floor(a / F.when(b == 0, 1.0).otherwise(b)) * b)


def _domain(f: Callable[[Column], Column], ok: Callable[[Column], Column], at_zero: float | None = None) -> Callable[[Column], Column]:
    def g(x: Column) -> Column:
        out = F.when(x.isNull(), None)
        if at_zero is not None:
            out = out.when(x == 0, at_zero)
        return out.when(ok(x), f(x)).otherwise(NAN)

    return g


def _rounded(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(f(x).cast("double"))


def _least(*xs: Column) -> Column:
    return F.when(_any(F.isnan, xs), NAN).otherwise(_strict(F.least, xs))


def _greatest(*xs: Column) -> Column:
    return F.when(_any(F.isnan, xs), NAN).otherwise(_strict(F.greatest, xs))


def _any(test: Callable[[Column], Column], xs: tuple[Column, ...]) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | test(x)
    return out


def _strict(f: Callable[..., Column], xs: tuple[Column, ...]) -> Column:
    return F.when(_any(lambda x: x.isNull(), xs), None).otherwise(f(*xs))


_POSITIVE, _UNIT = (lambda x: x > 0), (lambda x: F.abs(x) <= 1)
PREDICATE_FUNCTIONS: dict[str, tuple[int | None, Callable[..., Column]]] = {
    "abs": (1, F.abs), "sqrt": (1, _domain(F.sqrt, lambda x: x >= 0)), "log": (1, _domain(F.ln, _POSITIVE, float("-inf"))),
    "log2": (1, _domain(F.log2, _POSITIVE, float("-inf"))), "log10": (1, _domain(F.log10, _POSITIVE, float("-inf"))),
    "exp": (1, F.exp), "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "floor": (1, _rounded(F.floor)), "ceil": (1, _rounded(F.ceil)), "pow": (2, F.pow), "hypot": (2, F.hypot),
}
FORMULA_FUNCTIONS = PREDICATE_FUNCTIONS | {
    "asin": (1, _domain(F.asin, _UNIT)), "acos": (1, _domain(F.acos, _UNIT)), "atan": (1, F.atan),
    "round": (1, _rounded(lambda x: F.floor(x + 0.5))), "min": (None, _least), "max": (None, _greatest),
}
# The names of the two languages
PREDICATE_VARIABLES = ("v", "mean", "std", "median", "q1", "q3", "min", "max")
FORMULA_VARIABLES = ("hour", "day", "month", "weekday", "idx")
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: _div, ast.FloorDiv: _floor_div, ast.Mod: _mod, ast.Pow: F.pow}
_COMPARE = {
    ast.Lt: lambda a, b: (a < b) & ~F.isnan(b), ast.LtE: lambda a, b: (a <= b) & ~F.isnan(a) & ~F.isnan(b), ast.Gt: lambda a, b: (a > b) & ~F.isnan(a),
    ast.GtE: lambda a, b: (a >= b) & ~F.isnan(a) & ~F.isnan(b), ast.Eq: lambda a, b: (a == b) & ~F.isnan(a), ast.NotEq: lambda a, b: (a != b) | F.isnan(a),
}


class _Compiler:
    def __init__(self, variables: dict[str, Column], functions: dict):
        self.variables, self.functions = variables, functions

    def number(self, node: ast.expr) -> Column:
        kind, c = self.visit(node)
        return c.cast("double") if kind == "bool" else c

    def truth(self, node: ast.expr) -> Column:
        kind, c = self.visit(node)
        return c if kind == "bool" else (c != 0)

    def visit(self, node: ast.expr) -> tuple[str, Column]:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return ("bool", F.lit(node.value)) if isinstance(node.value, bool) else ("num", F.lit(float(node.value)))
        if isinstance(node, ast.Name):
            if node.id not in self.variables:
                raise ExpressionError(f"unknown name: {node.id}")
            return "num", self.variables[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return "num", _BINARY[type(node.op)](self.number(node.left), self.number(node.right))
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.Not):
                return "bool", ~self.truth(node.operand)
            if isinstance(node.op, (ast.USub, ast.UAdd)):
                x = self.number(node.operand)
                return "num", -x if isinstance(node.op, ast.USub) else x
        if isinstance(node, ast.BoolOp):
            out = self.truth(node.values[0])
            for x in node.values[1:]:
                out = out & self.truth(x) if isinstance(node.op, ast.And) else out | self.truth(x)
            return "bool", out
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            return "bool", _COMPARE[type(node.ops[0])](self.number(node.left), self.number(node.comparators[0]))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in self.functions and not node.keywords:
            count, f = self.functions[node.func.id]
            if len(node.args) != count and not (count is None and node.args):
                raise ExpressionError(f"{node.func.id} takes {count} arguments")
            return "num", f(*map(self.number, node.args)).cast("double")
        raise ExpressionError(f"not allowed: {type(node).__name__}")


def _parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise ExpressionError(str(e)) from None


# How the signs of the condition language are written in Python's grammar
WORDS = {"&&": "and", "||": "or", "!": "not", "!=": "!="}
_SIGNS = re.compile("|".join(map(re.escape, sorted(WORDS, key=len, reverse=True))))


def predicate(text: str, variables: dict[str, Column]) -> Column:
    """An anomaly condition on v and the column's statistics; false where v is missing."""
    python, at = [], 0
    for sign in _SIGNS.finditer(text):
        python += [text[at : sign.start()], WORDS[sign[0]]]
        at = sign.end()
    tree = _parse(" ".join([*python, text[at:]]))
    return F.coalesce(_Compiler(variables, PREDICATE_FUNCTIONS).truth(tree), F.lit(False)) & variables["v"].isNotNull()


def formula(text: str, variables: dict[str, Column]) -> Column:
    """A number from the parts of a timestamp; infinities and NaN are NULL."""
    import math

    x = _Compiler(variables | {"PI": F.lit(math.pi), "E": F.lit(math.e)}, FORMULA_FUNCTIONS).number(_parse(text))
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def time_parts(ts: Column, pos: Column) -> dict[str, Column]:
    return {"hour": (F.hour(ts) + F.minute(ts) / 60.0).cast("double"), "day": F.dayofmonth(ts).cast("double"), "month": F.month(ts).cast("double"), "weekday": (F.dayofweek(ts) - 1).cast("double"), "idx": F.when(ts.isNotNull(), pos).cast("double")}
