"""Filter expressions: Python text over column names, evaluated on Spark columns.

Python itself parses the text and applies the operators; this module only checks
that nothing but column arithmetic, comparisons and the listed methods occur, and
binds every column name to an object whose operators build Spark expressions with
two-valued logic (a comparison with a missing value is False, ``!=`` is True).
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions.nulls import is_float, missing

# The method names an expression may call.
SERIES_METHODS = {"isin", "notnull", "notna", "isnull", "isna", "between", "abs", "str"}
STRING_METHODS = {"contains", "startswith", "endswith", "len", "lower", "upper", "strip"}

_ALLOWED_NODES = (
    ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Name, ast.Load,
    ast.Constant, ast.Attribute, ast.Call, ast.keyword, ast.List, ast.Tuple,
    ast.operator, ast.unaryop, ast.boolop, ast.cmpop,
)

_AMBIGUOUS = (
    "The truth value of a Series is ambiguous. Use '&' for 'and', '|' for 'or', '~' for "
    "'not', and split chained comparisons."
)


class Series:
    """A Spark column with element-wise operators of a dataframe series."""

    __hash__ = None

    def __init__(self, column: Column, kind: str, nullable: bool = True):
        self.column = column
        self.kind = kind  # float, int, decimal, bool, str or other
        self.nullable = nullable

    def __bool__(self):
        raise ValueError(_AMBIGUOUS)

    # -- comparisons ---------------------------------------------------------
    # Written as plain conjunctions, not CASE, so that scans still receive them.
    def _gaps(self) -> list[Column]:
        tests = [self.column.isNull()] if self.nullable else []
        if self.nullable and self.kind == "float":
            tests.append(F.isnan(self.column))
        return tests

    def _compare(self, other, op) -> "Series":
        right = _wrap(other)
        result = op(self.column, right.column)
        for gap in self._gaps() + right._gaps():
            result = ~gap & result
        return Series(result, "bool", nullable=False)

    def __eq__(self, other):
        return self._compare(other, lambda a, b: a == b)

    def __ne__(self, other):
        return ~(self == other)

    def __lt__(self, other):
        return self._compare(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._compare(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._compare(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._compare(other, lambda a, b: a >= b)

    # -- logic ---------------------------------------------------------------
    def truth(self) -> Column:
        if self.kind != "bool":
            raise TypeError("a filter expression must give true or false for each row")
        return F.coalesce(self.column, F.lit(False)) if self.nullable else self.column

    def __and__(self, other):
        return Series(self.truth() & _wrap(other).truth(), "bool", nullable=False)

    def __or__(self, other):
        return Series(self.truth() | _wrap(other).truth(), "bool", nullable=False)

    def __xor__(self, other):
        return Series(self.truth() != _wrap(other).truth(), "bool", nullable=False)

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __invert__(self):
        return Series(~self.truth(), "bool", nullable=False)

    # -- arithmetic ----------------------------------------------------------
    def _arith(self, other, op, reverse=False, whole=None) -> "Series":
        a, b = self, _wrap(other)
        if reverse:
            a, b = b, a
        if a.kind == "str" and b.kind == "str" and whole == "add":
            return Series(F.concat(a.column, b.column), "str")
        for side in (a, b):
            if side.kind not in ("int", "float", "decimal", "bool"):
                raise TypeError(f"arithmetic needs numbers, got a {side.kind} value")
        whole_numbers = all(side.kind in ("int", "bool") for side in (a, b))
        kind = "int" if whole and whole_numbers else "float"
        cast = "bigint" if kind == "int" else "double"
        return Series(op(a.column.cast(cast), b.column.cast(cast)), kind)

    def __add__(self, other):
        return self._arith(other, lambda a, b: a + b, whole="add")

    def __radd__(self, other):
        return self._arith(other, lambda a, b: a + b, reverse=True, whole="add")

    def __sub__(self, other):
        return self._arith(other, lambda a, b: a - b, whole="sub")

    def __rsub__(self, other):
        return self._arith(other, lambda a, b: a - b, reverse=True, whole="sub")

    def __mul__(self, other):
        return self._arith(other, lambda a, b: a * b, whole="mul")

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self._arith(other, _divide)

    def __rtruediv__(self, other):
        return self._arith(other, _divide, reverse=True)

    def __floordiv__(self, other):
        return self._arith(other, _floor_divide)

    def __rfloordiv__(self, other):
        return self._arith(other, _floor_divide, reverse=True)

    def __mod__(self, other):
        return self._arith(other, _floor_mod)

    def __rmod__(self, other):
        return self._arith(other, _floor_mod, reverse=True)

    def __pow__(self, other):
        return self._arith(other, F.pow)

    def __rpow__(self, other):
        return self._arith(other, F.pow, reverse=True)

    def __neg__(self):
        return Series(-self.column, self.kind)

    def __pos__(self):
        return self

    def abs(self):
        return Series(F.abs(self.column), self.kind)

    # -- tests ---------------------------------------------------------------
    def isin(self, values):
        known = [v for v in values if v is not None]
        found = self._compare(self, lambda a, _: a.isin(known)) if known else _wrap(False)
        return found | self.isnull() if len(known) < len(values) else found

    def isnull(self):
        return Series(missing(self.column, self.kind == "float"), "bool", nullable=False)

    def notnull(self):
        return ~self.isnull()

    isna, notna = isnull, notnull

    def between(self, left, right, inclusive="both"):
        low = self >= left if inclusive in ("both", "left") else self > left
        high = self <= right if inclusive in ("both", "right") else self < right
        return low & high

    @property
    def str(self):
        if self.kind != "str":
            raise AttributeError("Can only use .str accessor with string values")
        return StringMethods(self.column)


class StringMethods:
    """The ``.str`` methods an expression may use."""

    def __init__(self, column: Column):
        self.column = column

    def contains(self, pattern, regex=True):
        hit = F.rlike(self.column, F.lit(pattern)) if regex else self.column.contains(pattern)
        return Series(hit, "bool")

    def startswith(self, prefix):
        return Series(self.column.startswith(prefix), "bool")

    def endswith(self, suffix):
        return Series(self.column.endswith(suffix), "bool")

    def len(self):
        return Series(F.length(self.column), "int")

    def lower(self):
        return Series(F.lower(self.column), "str")

    def upper(self):
        return Series(F.upper(self.column), "str")

    def strip(self):
        return Series(F.regexp_replace(self.column, r"^\s+|\s+$", ""), "str")


def _divide(a: Column, b: Column) -> Column:
    # IEEE division: x/0 is an infinity, 0/0 is NaN
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def _floor_mod(a: Column, b: Column) -> Column:
    rest = a % b
    signed = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    return F.when(b == 0, F.lit(float("nan"))).otherwise(signed)


def _floor_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.round((a - _floor_mod(a, b)) / b))


def _kind(dtype: T.DataType) -> str:
    if is_float(dtype):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "str" if isinstance(dtype, T.StringType) else "other"


def _wrap(value) -> Series:
    if isinstance(value, Series):
        return value
    if isinstance(value, bool):
        return Series(F.lit(value), "bool", nullable=False)
    if isinstance(value, int):
        return Series(F.lit(value), "int", nullable=False)
    if isinstance(value, float):
        return Series(F.lit(value), "float", nullable=False)
    if isinstance(value, str):
        return Series(F.lit(value), "str", nullable=False)
    if value is None:
        return Series(F.lit(None), "other")
    raise TypeError(f"unsupported value in a filter expression: {value!r}")


def _check(tree: ast.AST) -> None:
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED_NODES):
            raise ValueError(f"not allowed in a filter expression: {type(node).__name__}")
        if isinstance(node, ast.Attribute) and node.attr not in SERIES_METHODS | STRING_METHODS:
            raise ValueError(f"unknown method in a filter expression: {node.attr}")
        if isinstance(node, ast.Call) and not isinstance(node.func, ast.Attribute):
            raise ValueError("only column methods can be called in a filter expression")


def predicate(df: DataFrame, expression: str) -> Column:
    """The boolean column a filter expression stands for on ``df``."""
    tree = ast.parse(expression.strip(), mode="eval")
    _check(tree)
    names = {
        f.name: Series(F.col(f"`{f.name}`"), _kind(f.dataType)) for f in df.schema.fields
    }
    result = eval(compile(tree, "<filter>", "eval"), {"__builtins__": {}}, names)
    if not isinstance(result, Series):
        raise TypeError("a filter expression must use at least one column")
    return result.truth()
