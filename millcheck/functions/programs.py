"""Formulas and conditions as data: columns of a catalogue, evaluated row by row inside the plan.

A formula becomes a list of steps, each a number, a name to look up, or an operation on the results of two earlier steps; a
fold over the list works a row's formula out. The plan is the same for one formula and for a million, and texts never leave
the executors: they are compiled where the catalogue is, each distinct text once per task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millcheck.functions.formula import TERM, TOKEN

STEPS = "array<struct<op:string,x:int,y:int,number:double,source:string,name:string>>"
TERMS = "array<struct<source:string,name:string,op:string,text:string,number:double>>"
OFFSETS = "array<struct<name:string,equal:boolean,text:string,min_offset:double,max_offset:double>>"
BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}
SHORT = {"S": "wall_thickness_mm", "D": "outer_diameter_mm", "L": "length_mm"}
#: Fixed value: the condition under which limits are moved.
MOVED = re.compile(r"ctx\.header\.(\w+)\s*(==|!=)\s*['\"]([^'\"]+)['\"]")


def resolve(name: str) -> tuple[str, str]:
    """Where a name is looked up (dimension, record, header, or nowhere) and its key there."""
    last = name.rpartition(".")[2]
    if name in SHORT or name.startswith(("ctx.header.dimensions.", "ctx.dimensions.")):
        return "dimension", SHORT.get(name, last)
    if name.startswith(("ctx.chemical.", "ctx.mechanical.")):
        return "record", last
    return ("header", last) if name.startswith("ctx.header.") else ("", name)


class Steps:
    """Turns a formula's tokens to steps, by precedence."""

    def __init__(self) -> None:
        self.steps, self.values, self.open = [], [], []

    def emit(self, op: str, x: int | None = None, y: int | None = None, number: float | None = None, source: str | None = None, name: str | None = None) -> None:
        self.steps.append({"op": op, "x": x, "y": y, "number": number, "source": source, "name": name})
        self.values.append(len(self.steps) - 1)

    def apply(self, op: str) -> None:
        y = self.values.pop()
        self.emit(op, y) if op in ("neg", "sqrt") else self.emit(op, self.values.pop(), y)

    def close(self, least: int = 0) -> None:
        """Applies what binds at least so strongly, back to the last bracket."""
        while self.open and BINDS.get(self.open[-1], -1) >= least and self.open[-1] in BINDS:
            self.apply(self.open.pop())

    def bracket(self) -> bool:
        """Closes a bracket; says whether that was right."""
        self.close()
        if not self.open:
            return False
        _, function, n = self.open.pop()
        if function is None:
            return n == 1
        if function == "sqrt":
            self.apply("sqrt")
        elif function in ("min", "max"):
            for _ in range(n - 1):
                self.apply(function)
        return function in ("min", "max") or (function == "sqrt" and n == 1)


@lru_cache(100_000)
def steps_of(text: str | None) -> str | None:
    """The steps of a formula as JSON, null if it is none."""
    if text is None:
        return None
    made, at, operand, call = Steps(), 0, True, None
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        at, (number, name, sign) = m.end(), m.groups()
        if call is not None and sign != "(":
            made.emit("name", source=resolve(call)[0], name=resolve(call)[1])
            operand, call = False, None
        if operand and number:
            made.emit("number", number=float(number))
            operand = False
        elif operand and name:
            call = name
        elif operand and sign == "(":
            made.open.append(("(", call, 1))
            call = None
        elif operand and sign in ("+", "-"):
            if sign == "-":
                made.open.append("neg")
        elif not operand and sign in ("+", "-", "*", "/") and sign:
            made.close(BINDS[sign])
            made.open.append(sign)
            operand = True
        elif not operand and sign == ",":
            made.close()
            if not made.open or made.open[-1][1] is None:
                return None
            _, function, n = made.open.pop()
            made.open.append(("(", function, n + 1))
            operand = True
        elif operand or sign != ")" or not made.bracket():
            return None
    if call is not None:
        made.emit("name", source=resolve(call)[0], name=resolve(call)[1])
        operand = False
    if operand:
        return None
    made.close()
    return None if made.open else json.dumps(made.steps)


@lru_cache(100_000)
def terms_of(text: str | None) -> str | None:
    """The terms of a condition as JSON; parts that cannot be read say nothing."""
    if text is None or not text.strip():
        return None
    found = [m for part in text.split("&&") if (m := TERM.search(part))]
    made = []
    for name, op, single, double, number in (m.groups() for m in found):
        source, key = resolve(name)
        made.append({"source": source if source in ("header", "dimension") else "", "name": key, "op": op, "text": single if single is not None else double, "number": None if number is None else float(number)})
    return json.dumps(made)


@lru_cache(100_000)
def offsets_of(text: str | None) -> str | None:
    """The offsets of limits whose condition can be read, as JSON."""
    made = []
    for a in json.loads(text) if text else []:
        if m := MOVED.search((a or {}).get("when") or ""):
            made.append({"name": m[1], "equal": m[2] == "==", "text": m[3], "min_offset": a.get("min_offset"), "max_offset": a.get("max_offset")})
    return json.dumps(made) if made else None


@F.pandas_udf(T.StringType())
def steps_json(texts: pd.Series) -> pd.Series:
    return texts.map(steps_of)


@F.pandas_udf(T.StringType())
def terms_json(texts: pd.Series) -> pd.Series:
    return texts.map(terms_of)


@F.pandas_udf(T.StringType())
def offsets_json(texts: pd.Series) -> pd.Series:
    return texts.map(offsets_of)


def compiled(formula: Column) -> Column:
    """The steps of a column of formulas, null where there is none or it cannot be read."""
    return F.from_json(steps_json(formula), STEPS)


def conditions(text: Column) -> Column:
    """The terms of a column of conditions, null where there is none."""
    return F.from_json(terms_json(text), TERMS)


def moved(adjustments: Column) -> Column:
    """The readable ones of a column of array<struct<when, min_offset, max_offset>>, null if there is none."""
    return F.from_json(offsets_json(F.to_json(adjustments)), OFFSETS)


def evaluate(steps: Column, lookup: Callable[[Column, Column], Column]) -> Column:
    """The value of each row's formula, a double. lookup(source, name) is the double of a name, null if it has none.

    Division by zero, the root of a negative number and null make null, as does a formula that could not be read."""

    def step(done: Column, s: Column) -> Column:
        op, x, y = s["op"], F.get(done, s["x"]), F.get(done, s["y"])
        both = x.isNotNull() & y.isNotNull()
        value = (
            F.when(op == "number", s["number"]).when(op == "name", lookup(s["source"], s["name"])).when(op == "+", x + y).when(op == "-", x - y).when(op == "*", x * y).when(op == "/", F.try_divide(x, y))
            .when(op == "neg", -x).when(op == "sqrt", F.when(x >= 0, F.sqrt(x))).when(op == "min", F.when(both, F.least(x, y))).when(op == "max", F.when(both, F.greatest(x, y)))
        )
        return F.array_append(done, value)

    # cast from text: so that the fold's first list may hold nulls like the later ones
    none = F.from_json(F.lit("[]"), "array<double>")
    return F.try_element_at(F.aggregate(steps, none, step), F.lit(-1))


def holds(terms: Column, header: Column, dimensions: Column) -> Column:
    """Whether all terms hold; none at all holds. A term on a missing value or one of another type does not."""

    def term(t: Column) -> Column:
        of_header, of_dimension = F.try_element_at(header, t["name"]), F.try_element_at(dimensions, t["name"])
        is_header = t["source"] == "header"
        number = F.when(is_header, of_header.try_cast("double")).when(t["source"] == "dimension", of_dimension)
        words = F.when(is_header, of_header).when(t["source"] == "dimension", of_dimension.cast("string"))
        compared = lambda a, b: F.when(t["op"] == "==", a == b).when(t["op"] == "!=", a != b)
        ordered = F.when(t["op"] == "<=", number <= t["number"]).when(t["op"] == ">=", number >= t["number"]).when(t["op"] == "<", number < t["number"]).when(t["op"] == ">", number > t["number"])
        return F.coalesce(F.when(t["number"].isNotNull(), F.coalesce(compared(number, t["number"]), ordered)).otherwise(compared(words, t["text"])), F.lit(False))

    return F.coalesce(F.forall(terms, term), F.lit(True))


def move(bound: Column, offsets: Column, which: str, header: Column) -> Column:
    """A bound with the offsets that hold added one after the other; no bound stays none."""

    def step(so_far: Column, a: Column) -> Column:
        same = F.try_element_at(header, a["name"]) == a["text"]
        # what is missing differs from any text
        applies = F.when(a["equal"], F.coalesce(same, F.lit(False))).otherwise(~F.coalesce(same, F.lit(False)))
        return F.when(applies & a[which].isNotNull(), so_far + a[which]).otherwise(so_far)

    return F.when(offsets.isNull(), bound).otherwise(F.aggregate(offsets, bound, step))
