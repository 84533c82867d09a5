"""Scalar functions of the algebra as Columns; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.plans.tree import AlgebraError, Literal

TYPES = {"int": "bigint", "fixed": "double", "string": "string", "bool": "boolean", "date": "date"}
COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
INTERVALS = ("day", "month", "year")


def literal(e: Literal) -> Column:
    if e.value is None:
        return F.lit(None).cast(TYPES[e.type]) if e.type else F.lit(None)
    return F.lit(e.value).cast("bigint") if e.kind == "int" else F.lit(e.value)


def interval(op: str, date: Column, unit: str, n: Column) -> Column:
    """date plus or minus an interval; months clamp to the last day."""
    n = n.cast("int") if op == "+" else -n.cast("int")
    if unit == "day":
        return F.date_add(date, n)
    return F.add_months(date, n * 12 if unit == "year" else n)


def binary(op: str, a: Column, b: Column) -> Column:
    if op in COMPARE:
        return COMPARE[op](a, b)
    if op == "&&":
        return a & b
    if op == "||":
        return a | b
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":  # a true division
        return a.cast("double") / b.cast("double")
    if op == "%":  # with the sign of the dividend
        return a % b
    if op == "strpos":  # from 1; 0 if absent
        return F.instr(a, b).cast("bigint")
    raise AlgebraError(f"unknown operator {op}")


def unary(op: str, a: Column) -> Column:
    if op == "not":
        return ~a
    if op == "strlen":  # characters
        return F.char_length(a).cast("bigint")
    if op in ("to_year", "to_mon", "to_day"):
        return {"to_year": F.year, "to_mon": F.month, "to_day": F.dayofmonth}[op](a).cast("bigint")
    if op in INTERVALS:
        raise AlgebraError(f"{op}() is only for date + or -")
    raise AlgebraError(f"unknown function {op}")


def substring(text: Column, start: Column, length: Column) -> Column:
    """From start (1 is the first) length characters; what lies before the first character counts towards the length."""
    start, length = start.cast("int"), length.cast("int")
    return F.when(start >= 1, F.substring(text, start, length)).otherwise(F.substring(text, F.lit(1), F.greatest(start + length - 1, F.lit(0))))
