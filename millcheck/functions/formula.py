"""Formulas and conditions of rules, compiled to columns once per distinct text, so rows stay in generated code."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:([0-9]+(?:\.[0-9]*)?|\.[0-9]+)|([A-Za-z_][A-Za-z0-9_.]*)|([-+*/(),]))")


class FormulaError(ValueError):
    pass


def compile_formula(text: str, variable: Callable[[str], Column | None]) -> Column:
    """A column of double: + - * / ( ), signs, min, max, sqrt, and names that `variable` turns to columns.

    Division by zero, the root of a negative number and null variables make null. Text that is no formula, or names
    what variable does not know, raises FormulaError."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"{text!r} at {at}")
        tokens.append(m.group(m.lastindex))
        at = m.end()
    tokens.append("")
    pos = 0

    def take(*options: str) -> str:
        nonlocal pos
        if tokens[pos] in options:
            pos += 1
            return tokens[pos - 1]
        return ""

    def need(s: str) -> None:
        if not take(s):
            raise FormulaError(f"{text!r}: {s} expected")

    def total() -> Column:
        x = product()
        while op := take("+", "-"):
            y = product()
            x = x + y if op == "+" else x - y
        return x

    def product() -> Column:
        x = signed()
        while op := take("*", "/"):
            y = signed()
            x = x * y if op == "*" else F.try_divide(x, y)
        return x

    def signed() -> Column:
        if op := take("+", "-"):
            return -signed() if op == "-" else signed()
        return atom()

    def atom() -> Column:
        nonlocal pos
        if take("("):
            x = total()
            need(")")
            return x
        word = tokens[pos]
        pos += bool(word)
        if re.match(r"[0-9.]", word):
            return F.lit(float(word))
        if not re.match(r"[A-Za-z_]", word):
            raise FormulaError(f"{text!r}: unexpected {word!r}")
        if take("("):
            args = [total()]
            while take(","):
                args.append(total())
            need(")")
            known = args[0]
            for a in args[1:]:
                known = known + a
            if word == "sqrt" and len(args) == 1:
                return F.when(args[0] >= 0, F.sqrt(args[0]))
            if word in ("min", "max") and args:
                pick = {"min": F.least, "max": F.greatest}[word](*args) if len(args) > 1 else args[0]
                return F.when(known.isNotNull(), pick)
            raise FormulaError(f"{text!r}: unknown function {word}")
        column = variable(word)
        if column is None:
            raise FormulaError(f"{text!r}: unknown name {word}")
        return column.cast("double")

    out = total()
    if tokens[pos]:
        raise FormulaError(f"{text!r}: {tokens[pos]!r} left over")
    return out


TERM = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*)\s*(<=|>=|==|!=|<|>)\s*(?:'([^']*)'|\"([^\"]*)\"|([-+]?[0-9]+(?:\.[0-9]+)?))")


def trigger(text: str | None, variable: Callable[[str], Column | None]) -> Column:
    """Whether a rule's condition, terms joined by &&, holds. No condition or one that cannot be read holds; a term on
    a missing value or one of another type does not."""
    if not text or not text.strip():
        return F.lit(True)
    out = F.lit(True)
    for part in text.split("&&"):
        m = TERM.search(part)
        if not m:
            continue
        name, op, *literals = m.groups()
        left = variable(name)
        if left is None:
            out = out & F.lit(False)
            continue
        number = literals[2]
        if number is not None:
            left, right = left.try_cast("double"), F.lit(float(number))
        else:
            left, right = left.cast("string"), F.lit(literals[0] if literals[0] is not None else literals[1])
            if op not in ("==", "!="):
                out = out & F.lit(False)
                continue
        holds = {"<=": left <= right, ">=": left >= right, "==": left == right, "!=": left != right, "<": left < right, ">": left > right}[op]
        out = out & F.coalesce(holds, F.lit(False))
    return out


def adjustment(text: str | None, variable: Callable[[str], Column | None]) -> Column:
    """As trigger for one == or != term on a text; what cannot be read does not hold."""
    m = TERM.fullmatch((text or "").strip())
    if not m or m[2] not in ("==", "!=") or m[5] is not None:
        return F.lit(False)
    return trigger(text, variable)
