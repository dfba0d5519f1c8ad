"""Foreign keys as one declared graph: checks and referential actions
(Q-3, M-8, M-9).

The tables and what a delete does to the rows that point at a deleted one are
stated once, below; checks and deletes walk them, parents before children.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.operators.skew import join_per_key
from tillbook.operators.windows import materialize


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    key: str
    on_delete: str      # "cascade" or "set null"


# fixed values: the schema's foreign keys
REFERENCES = (
    Reference("product", "supplier_id", "supplier", "id", "set null"),
    Reference("inventory", "product_id", "product", "pro_id", "cascade"),
    Reference("add_item", "product_id", "product", "pro_id", "cascade"),
    Reference("add_item", "supplier_id", "supplier", "id", "set null"),
    Reference("invoice", "customer_id", "customer", "id", "set null"),
    Reference("supplier_invoice", "supplier_id", "supplier", "id", "set null"),
    Reference("supplier_invoice", "product_id", "product", "pro_id", "cascade"),
    Reference("lines", "invoice_no", "invoice", "invoice_no", "cascade"),
    Reference("lines", "product_id", "product", "pro_id", "cascade"),
    Reference("payment", "invoice_no", "invoice", "invoice_no", "cascade"),
    Reference("ledger", "customer_mobile", "customer", "mobile", "cascade"),
)


def in_order(references=REFERENCES) -> list[str]:
    """All tables, parents first; a cycle is refused."""
    left = {t for r in references for t in (r.child, r.parent)}
    out: list[str] = []
    while left:
        ready = sorted(t for t in left if not any(r.child == t and r.parent in left for r in references))
        if not ready:
            raise ValueError(f"references form a cycle: {sorted(left)}")
        out += ready
        left -= set(ready)
    return out


# Q-3
def violations(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """Values that name no parent row: ``child``, ``column``, ``value`` (text)
    and the number of ``rows`` that hold it.  NULL refers to nothing and
    passes.  References of tables that are not given are not checked.

    A child's values are counted first (a partial aggregate), so the join with
    the parent sees each value once, however many rows hold it.
    """
    found = []
    for r in references:
        if r.child in tables and r.parent in tables:
            values = (tables[r.child].filter(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("_v"))
                      .agg(F.count(F.lit(1)).alias("rows")))
            parents = tables[r.parent].select(F.col(r.key).alias("_k"))
            found.append(values.join(parents, F.col("_v") == F.col("_k"), "left_anti").select(
                F.lit(r.child).alias("child"), F.lit(r.column).alias("column"),
                F.col("_v").cast("string").alias("value"), "rows"))
    return reduce(DataFrame.unionByName, found)


def _marked(rows: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag`` where ``column`` is one of ``keys`` (its one
    column, each value once); a value held by very many rows is dealt over
    tasks."""
    kind = rows.schema[column].dataType
    named = keys.select(F.col(keys.columns[0]).cast(kind).alias(column)).distinct().withColumn(flag, F.lit(True))
    return join_per_key(rows, named, [column]).withColumn(flag, F.coalesce(flag, F.lit(False)))


# M-8 / M-9
def delete(tables: dict[str, DataFrame], table: str, keys: DataFrame, key: str,
           references=REFERENCES) -> dict[str, DataFrame]:
    """The new content of ``table`` without the rows whose ``key`` is in
    ``keys`` (one column), and of every table that this changes: rows that
    refer to a deleted row go with it (and so do those that refer to them) or
    lose the reference, as the graph says.  Tables not given are left out.
    """
    gone: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for name in in_order(references):
        if name not in tables:
            continue
        rows, flags, cleared = tables[name], [], []
        columns = rows.columns
        if name == table:
            rows = _marked(rows, key, keys, "_own")
            flags.append("_own")
        for i, r in enumerate(references):
            if r.child == name and r.parent in gone:
                rows = _marked(rows, r.column, gone[r.parent].select(r.key), f"_hit{i}")
                if r.on_delete == "cascade":
                    flags.append(f"_hit{i}")
                else:
                    cleared.append((f"_hit{i}", r.column))
        if not flags and not cleared:
            continue
        dead = reduce(lambda a, b: a | b, [F.col(f) for f in flags], F.lit(False))
        nulled = {c: F.when(F.col(f), F.lit(None)).otherwise(F.col(c)) for f, c in cleared}
        rows = materialize(rows.withColumn("_dead", dead))
        out[name] = rows.filter("not _dead").select(*[nulled.get(c, F.col(c)).alias(c) for c in columns])
        needed = sorted({r.key for r in references if r.parent == name})
        if flags and needed:
            gone[name] = rows.filter("_dead").select(*needed)
    return out
