"""Row rules: small declarations compiled to a chain of lazy transformations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key


@dataclass(frozen=True)
class Rule:
    """``kind``: exclude, filter, dedupe, fill, map, adjust, scale or pair. ``where``: a SQL predicate (null is
    false). ``metrics``: totals that it holds for; empty means all."""

    kind: str
    where: str = "true"
    column: str = ""
    args: dict = field(default_factory=dict)
    metrics: tuple[str, ...] = ()


def _match(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.where), F.lit(False))


def _fresh(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"_rule{i}" for i in range(n + len(taken))) if c not in taken][:n]


def _keys(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns under the equality of all groups and joins."""
    types = dict(df.dtypes)
    return [norm_key(F.col(c), types[c]) for c in names]


def _dedupe(df: DataFrame, r: Rule) -> DataFrame:
    """Of matching rows with an equal key one stays, by ``order``; the others of the table stay, and so does a row
    whose key is blank in any column."""
    keys, (rank,) = _keys(df, r.args["key"]), _fresh(df, 1)
    whole = reduce(lambda a, b: a & b, (k.isNotNull() for k in keys))
    w = Window.partitionBy(*keys, _match(r)).orderBy(*r.args["order"])
    first = F.when(whole & _match(r), F.row_number().over(w)).otherwise(1)
    return df.withColumn(rank, first).filter(f"{rank} = 1").drop(rank)


def _fill(df: DataFrame, r: Rule) -> DataFrame:
    """A matching row takes, instead of its own, the last value that isn't blank of the rows before it in its group
    that don't match; one with nothing above it stays as it is."""
    w = Window.partitionBy(*_keys(df, r.args["key"])).orderBy(*r.args["order"]).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(r.column)
    filled = c.isNotNull() & (F.trim(c.cast("string")) != "")
    above = F.last(F.when(~_match(r) & filled, c), True).over(w)
    return df.withColumn(r.column, F.when(_match(r), F.coalesce(above, c)).otherwise(c))


def _map(df: DataFrame, r: Rule) -> DataFrame:
    c, pairs = F.col(r.column), r.args["values"]
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return df.withColumn(r.column, F.when(_match(r), F.coalesce(table[c], c)).otherwise(c))


def _pair(df: DataFrame, r: Rule) -> DataFrame:
    """Drop matching rows (reversals) with one partner each: a row that doesn't match, of the same key and the same
    amount, sign aside. Blank keys and amounts are equal to each other."""
    keys, (rank, named, others) = _keys(df, r.args["key"]), _fresh(df, 3)
    size = F.round(F.abs(F.col(r.args["amount"])), 2)
    w = Window.partitionBy(*keys, size, _match(r)).orderBy(*r.args["order"])
    n = Window.partitionBy(*keys, size)
    d = df.withColumns({rank: F.row_number().over(w), named: F.sum(_match(r).cast("int")).over(n), others: F.sum((~_match(r)).cast("int")).over(n)})
    return d.filter(F.col(rank) > F.least(named, others)).drop(rank, named, others)


_APPLY = {
    "exclude": lambda df, r: df.filter(~_match(r)),
    "filter": lambda df, r: df.filter(_match(r)),
    "dedupe": _dedupe, "fill": _fill, "map": _map, "pair": _pair,
    "adjust": lambda df, r: df.withColumn(r.column, F.when(_match(r), F.col(r.column) - F.expr(r.args["less"])).otherwise(F.col(r.column))),
    "scale": lambda df, r: df.withColumn(r.column, F.when(_match(r), F.col(r.column) / r.args["by"]).otherwise(F.col(r.column))),
}


def apply_rules(df: DataFrame, rules: list[Rule], metric: str | None = None) -> DataFrame:
    """``df`` under the rules that hold for ``metric`` (None: those for all), in the given order."""
    held = [r for r in rules if not r.metrics or metric in r.metrics]
    return reduce(lambda d, r: _APPLY[r.kind](d, r), held, df)


def rule_effect(df: DataFrame, rule: Rule, amount: str) -> DataFrame:
    """Rows that a rule matches, their money, and its share of all money by size."""
    m = _match(rule)
    return df.agg(F.count_if(m).alias("n_rows"), F.round(F.sum(F.when(m, F.col(amount))), 2).alias("amount"),
                  F.round(F.sum(F.when(m, F.abs(amount)).otherwise(0.0)) / F.sum(F.abs(amount)), 6).alias("share"))
