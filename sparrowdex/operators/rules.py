"""Rules as data: what a rule tests, and what it adds.

A rule is a dict.  ``when`` lists tests that must all hold; a test is
(what, how, values): *what* names a column of the row, *how* is one of ``contains`` (any value is
somewhere in it), ``starts``, ``ends``, ``is``, ``matches`` (a regular expression), ``has`` (the array holds any value),
``has all``, ``lacks`` (holds none), ``under``, ``over``.  ``not`` before *how* turns a test round.
Rules with one ``group`` exclude each other: the first that holds counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def test(what: str, how: str, values) -> Column:
    if how.startswith("not "):
        return ~test(what, how[4:], values)
    values = list(values) if isinstance(values, list | tuple | set) else [values]
    c = F.col(what)
    if how in ("under", "over"):
        return F.coalesce(c < values[0] if how == "under" else c > values[0], F.lit(False))
    each = {
        "contains": lambda v: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(v)),
        "starts": lambda v: F.startswith(F.lower(F.coalesce(c, F.lit(""))), F.lit(v)),
        "ends": lambda v: F.endswith(F.lower(F.coalesce(c, F.lit(""))), F.lit(v)),
        "is": lambda v: F.coalesce(c == F.lit(v), F.lit(False)),
        "matches": lambda v: F.coalesce(F.lower(c).rlike(v), F.lit(False)),
        "has": lambda v: F.coalesce(F.array_contains(c, v), F.lit(False)),
    }
    if how == "has all":
        return reduce(lambda a, b: a & b, map(each["has"], values))
    if how == "lacks":
        return ~reduce(lambda a, b: a | b, map(each["has"], values))
    return reduce(lambda a, b: a | b, map(each[how], values))


def holds(rule: dict) -> Column:
    return reduce(lambda a, b: a & b, (test(*t) for t in rule["when"]), F.lit(True))


def total(rules: list[dict]) -> Column:
    """The sum of what the rules add; of a group, only the first that holds."""
    out = F.lit(0.0)
    groups: dict = {}
    for n, r in enumerate(rules):
        groups.setdefault(r.get("group", n), []).append(r)
    for members in groups.values():
        chain = None
        for r in members:
            chain = F.when(holds(r), F.lit(float(r["add"]))) if chain is None else chain.when(holds(r), F.lit(float(r["add"])))
        out = out + chain.otherwise(0.0)
    return out


def first(rules: list[dict], otherwise: str) -> Column:
    """The ``label`` of the first rule that holds."""
    chain = F.when(F.lit(False), F.lit(otherwise))
    for r in rules:
        chain = chain.when(holds(r), F.lit(r["label"]))
    return chain.otherwise(F.lit(otherwise))


def labels(rules: list[dict]) -> Column:
    """The labels of all rules that hold, in the rules' order."""
    each = F.array(*(F.when(holds(r), F.lit(r["label"])) for r in rules)) if rules else F.array().cast("array<string>")
    return F.filter(each, lambda x: x.isNotNull())
