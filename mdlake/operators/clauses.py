"""Clauses with applicability conditions in three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def applies(rule: dict, dimensions: dict[str, list[str]]) -> Column:
    """A boolean column over string columns named by dimension: null where a
    dimension is missing, its value isn't declared, or ranks can't be compared.

    ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": r}``, ``{"eq": [d, v]}``,
    ``{"in": [d, [v, ...]]}``, ``{"at_least": [d, v]}`` (by declared order).
    """
    ((op, arg),) = rule.items()
    if op in ("all", "any"):
        parts = [applies(r, dimensions) for r in arg]
        return reduce(lambda a, b: a & b, parts, F.lit(True)) if op == "all" else reduce(lambda a, b: a | b, parts, F.lit(False))
    if op == "not":
        return ~applies(arg, dimensions)
    name, value = arg
    if name not in dimensions:
        return F.lit(None).cast("boolean")
    declared = dimensions[name]
    known = F.when(F.col(name).isin(*declared), F.col(name))
    if op == "eq":
        return known == value if value in declared else F.lit(None).cast("boolean")
    if op == "in":
        return known.isin(*value)
    if op == "at_least":
        if value not in declared:
            return F.lit(None).cast("boolean")
        return F.array_position(F.array(*[F.lit(d) for d in declared]), known) >= declared.index(value) + 1
    raise ValueError(f"unknown operator {op!r}")


def reasons(rule: dict, dimensions: dict[str, list[str]]) -> Column:
    """Sorted reason codes of what is undecided below a rule."""
    ((op, arg),) = rule.items()
    none = F.array().cast("array<string>")
    if op in ("all", "any"):
        out = F.array_sort(F.array_distinct(F.flatten(F.array(*[reasons(r, dimensions) for r in arg])))) if arg else none
        return F.when(applies(rule, dimensions).isNull(), out).otherwise(none)
    if op == "not":
        return reasons(arg, dimensions)
    name, value = arg
    if name not in dimensions:
        return F.array(F.lit("missing_dimension"))
    if op == "at_least" and value not in dimensions[name]:
        return F.array(F.lit("incomparable_value"))
    code = F.when(F.col(name).isNull(), "missing_dimension").when(~F.col(name).isin(*dimensions[name]), "unknown_value")
    return F.when(code.isNotNull(), F.array(code)).otherwise(none)


def evaluate(rows: DataFrame, clauses: list[dict], dimensions: dict[str, list[str]]) -> DataFrame:
    """Each row with each clause: ``clause, outcome, reasons``; without a condition a clause binds."""
    parts = []
    for c in clauses:
        rule = c.get("applies")
        holds = applies(rule, dimensions) if rule else F.lit(True)
        why = reasons(rule, dimensions) if rule else F.array().cast("array<string>")
        outcome = F.when(holds, "binding").when(~holds, "not_binding").otherwise("unresolved")
        parts.append(F.struct(F.lit(c["id"]).alias("clause"), outcome.alias("outcome"), why.alias("reasons")))
    return rows.select("*", F.inline(F.array(*parts)))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, change`` between two versions of a clause set (``id, text``)."""
    j = old.select("id", F.col("text").alias("old")).join(new.select("id", F.col("text").alias("new")), "id", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select("id", change.alias("change")).where("change IS NOT NULL").orderBy("id")


def publishable(clauses: list[dict], restricted: set[str], dimensions: dict[str, list[str]]) -> list[str]:
    """Problems that keep a clause set from publication: repeated ids, empty texts,
    unknown dimensions and restricted identifiers."""
    out, seen = [], set()

    def names(rule: dict) -> set[str]:
        ((op, arg),) = rule.items()
        return set().union(*map(names, arg)) if op in ("all", "any") else names(arg) if op == "not" else {arg[0]}

    for c in clauses:
        if c["id"] in seen:
            out.append(f"duplicate {c['id']}")
        seen.add(c["id"])
        if not c.get("text", "").strip():
            out.append(f"empty {c['id']}")
        if c["id"] in restricted:
            out.append(f"restricted {c['id']}")
        out += [f"unknown dimension {d} in {c['id']}" for d in sorted(names(c["applies"]) - set(dimensions))] if c.get("applies") else []
    return out
