"""Conditions of analysis rules, compiled to column expressions.

A string condition knows and, or, not, one comparison, names, literals, unary minus and brackets. A name alone asks
whether the field is set; in a comparison, on either side, it stands for its value. A comparison with a null on the
left, or of types that have no order, is false; unequal types are not equal. Anything else is an error.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class ConditionError(ValueError):
    pass


#: The fixed operators of the condition language.
COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}
NAMED = {"==": ast.Eq, "!=": ast.NotEq, "<": ast.Lt, "<=": ast.LtE, ">": ast.Gt, ">=": ast.GtE}
NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


class Fields:
    """The fields that a condition may name: attributes as columns of a wide table, relations as columns of targets."""

    def __init__(self, kinds: Mapping[str, str], relations: set[str] | frozenset[str] = frozenset()) -> None:
        self.kinds, self.relations = kinds, relations

    def set(self, name: str) -> Column:
        if name not in self.kinds:
            return F.lit(False)
        c, kind = F.col(f"`{name}`"), self.kinds[name]
        if kind.startswith("array"):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()

    def compared(self, name: str, op: type[ast.cmpop], value: object) -> Column:
        return comparison(self.value(name), op, literal(value))

    def value(self, name: str) -> tuple[str, Column]:
        """The kind (number, flag, text or none) and the value of a field; a field that is not known has none."""
        if name in self.relations:
            raise ConditionError(f"the relation {name} can only be asked for, not compared")
        kind = self.kinds.get(name)
        if kind is None:
            return "none", F.lit(None)
        c = F.col(f"`{name}`")
        return ("number" if kind in NUMERIC or kind.startswith("decimal") else "flag" if kind == "boolean" else "text"), c


def literal(value: object) -> tuple[str, Column]:
    kind = "none" if value is None else "flag" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"
    return kind, F.lit(value)


def comparison(left: tuple[str, Column], op: type[ast.cmpop], right: tuple[str, Column]) -> Column:
    """False for a null on the left. A null on the right differs from what is set, and has no order with it."""
    (kind, a), (other, b) = left, right
    if kind == "none":
        return F.lit(False)
    differs = op is ast.NotEq
    if other == "none":
        return a.isNotNull() & F.lit(differs)
    number = {"number": lambda c: c, "flag": lambda c: c.cast("int")}
    if kind != other:
        if kind not in number or other not in number:
            return a.isNotNull() & F.lit(differs)
        a, b = number[kind](a), number[other](b)
    return F.when(a.isNull(), False).otherwise(F.coalesce(COMPARE[op](a, b), F.lit(differs)))


def compiled(text: str, fields: Fields) -> Column:
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ConditionError(f"cannot read {text!r}") from e
    return _truth(tree, fields)


def _truth(node: ast.expr, fields: Fields) -> Column:
    if isinstance(node, ast.BoolOp):
        parts = [_truth(v, fields) for v in node.values]
        return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), parts)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_truth(node.operand, fields)
    if isinstance(node, ast.Name):
        return fields.set(node.id)
    if isinstance(node, ast.Constant):
        return F.lit(bool(node.value))
    if isinstance(node, ast.Compare):
        if len(node.ops) != 1 or type(node.ops[0]) not in COMPARE:
            raise ConditionError("one comparison at a time, of == != < <= > >=")
        return comparison(_value(node.left, fields), type(node.ops[0]), _value(node.comparators[0], fields))
    raise ConditionError(f"{type(node).__name__} is not allowed")


def _value(node: ast.expr, fields: Fields) -> tuple[str, Column]:
    if isinstance(node, ast.Name):
        return fields.value(node.id)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        kind, c = _value(node.operand, fields)
        return kind, -c if kind == "number" else c
    if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str, type(None))):
        return literal(node.value)
    raise ConditionError("a comparison has names and literals")


def compiled_mapping(condition: object, fields: Fields) -> Column:
    """Conditions as mappings; a list means all of them. A malformed one is not met."""
    if isinstance(condition, list):
        return reduce(lambda a, b: a & b, [compiled_mapping(c, fields) for c in condition], F.lit(True))
    if not isinstance(condition, Mapping) or len(condition) != 1:
        return F.lit(False)
    ((kind, spec),) = condition.items()
    if kind in ("attribute_set", "relation_set") and isinstance(spec, str):
        return fields.set(spec)
    if kind in ("attribute_unset", "relation_unset") and isinstance(spec, str):
        return ~fields.set(spec)
    if isinstance(spec, Mapping) and kind == "attribute_equals" and {"attribute", "value"} <= set(spec):
        return fields.compared(spec["attribute"], ast.Eq, spec["value"])
    if isinstance(spec, Mapping) and kind == "attribute_compare" and spec.get("op") in NAMED and {"attribute", "value"} <= set(spec):
        return fields.compared(spec["attribute"], NAMED[spec["op"]], spec["value"])
    return F.lit(False)


def when(condition: object, fields: Fields) -> Column:
    return F.lit(True) if condition is None else compiled(condition, fields) if isinstance(condition, str) else compiled_mapping(condition, fields)
