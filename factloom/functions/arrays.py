"""Arrays inside a row: folds in linear time, and exploding computed arrays without computing them twice.

Spark copies the whole accumulator of a fold at every step, so a fold that carries what it has built takes time with the square of the
length.  ``scan`` and ``scan_sql`` fold in two levels: the inner accumulator holds a part of about the square root of the items, and
only whole parts meet in the outer one.

For ``explode(column)`` the optimizer adds ``size(column) > 0`` as a filter and pushes it down, below the projection that
computes the column and even below exchanges; an expensive array is then evaluated once more per row, possibly on fewer
tasks.  It does so only for plain columns, so the helpers wrap the column in a trivial filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 64


def _present(column: str) -> Column:
    return F.filter(column, lambda item: item.isNotNull())


def explode_once(column: str) -> Column:
    return F.explode(_present(column))


def posexplode_once(column: str) -> Column:
    return F.posexplode(_present(column))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it (lambdas know no common subexpressions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(items: Column) -> Column:
    """``items`` as an array of arrays of about the square root of their number (PART at least)."""

    def cut(array: Column) -> Column:
        width = F.greatest(F.lit(PART), F.ceil(F.sqrt(F.size(array))).cast("int"))
        return let(width, lambda w: F.transform(
            F.sequence(F.lit(0), F.call_function("div", F.size(array) - 1, w).cast("int")), lambda i: F.slice(array, i * w + 1, w)))

    return let(items, cut)


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emitted: str) -> Column:
    """What ``step(state, item)`` emits along ``items``: it returns struct<state, value>, and a null value emits nothing.

    ``emitted`` is the SQL type of a value.  The number of copied references is n * sqrt(n), not n * n.
    """
    part, parts = (F.expr(f"cast(array() as {t})") for t in (f"array<{emitted}>", f"array<array<{emitted}>>"))

    def merge(s: Column, item: Column) -> Column:
        return let(step(s["state"], item), lambda b: F.struct(
            b["state"].alias("state"), F.when(b["value"].isNull(), s["part"]).otherwise(F.array_append(s["part"], b["value"])).alias("part")))

    def outer(acc: Column, chunk: Column) -> Column:
        built = F.aggregate(chunk, F.struct(acc["state"].alias("state"), part.alias("part")), merge)
        return let(built, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["part"]).alias("out")))

    return F.flatten(F.aggregate(chunks(items), F.struct(start.alias("state"), parts.alias("out")), outer, lambda acc: acc["out"]))


def scan_sql(items: str, start: str, state: str, value: str, emitted: str) -> str:
    """SQL text of :func:`scan`; ``state`` and ``value`` are SQL over ``s.state`` and the item ``x``.  Every item emits."""
    return f"""flatten(aggregate(
        transform(array({items}), a -> transform(array(greatest({PART}, cast(ceil(sqrt(size(a))) AS int))), w ->
            transform(sequence(0, cast((size(a) - 1) div w AS int)), i -> slice(a, i * w + 1, w)))[0])[0],
        named_struct('state', {start}, 'out', cast(array() AS array<array<{emitted}>>)),
        (acc, chunk) -> transform(array(aggregate(chunk, named_struct('state', acc.state, 'part', cast(array() AS array<{emitted}>)),
            (s, x) -> named_struct('state', {state}, 'part', array_append(s.part, {value})))),
            r -> named_struct('state', r.state, 'out', array_append(acc.out, r.part)))[0],
        acc -> acc.out))"""
