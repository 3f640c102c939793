"""Column helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def literal_map(mapping: dict) -> Column:
    """A small fixed dict as a literal map column (plan constant, never shuffled)."""
    return F.expr("map(" + ", ".join(sql_literal(x) for pair in mapping.items() for x in pair) + ")")


def lookup(mapping: dict, key: Column) -> Column:
    """Value for ``key`` in a fixed dict, null when absent."""
    return F.try_element_at(literal_map(mapping), key)


def first_match(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """First value whose condition holds, in the order given."""
    out = default
    for cond, value in reversed(pairs):
        out = F.when(cond, value).otherwise(out)
    return out


def fence(c: Column) -> Column:
    """Compute an expensive column exactly once per row.

    Catalyst copies a column's whole definition into every filter it pushes below the projection.  For
    a column that combines hundreds of expressions this means evaluating all of them twice and plans
    that take minutes to build; a non-deterministic guard keeps such filters above the projection.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def contains_any(text: Column, needles: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(n.lower())) for n in needles])


def compact(*cols: Column) -> Column:
    """Array of the non-null arguments, order kept."""
    return F.array_compact(F.array(*cols))


def chosen(*pairs: tuple[Column, Column]) -> Column:
    """Array of the values whose condition holds, in the order given.

    Like ``compact`` of ``F.when`` columns, but in generated code: Spark evaluates the whole argument of
    ``array_compact``, as of any function that takes a lambda, expression by expression for every row.
    """
    return F.concat(*[F.when(cond, F.array(value)).otherwise(F.array()) for cond, value in pairs])


def joined(arr: Column, sep: str = ",") -> Column:
    return F.array_join(arr, sep)


def sorted_union(*arrays: Column) -> Column:
    """Sorted set union of array columns."""
    merged = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_sort(F.array_distinct(merged))


def round_plain(c: Column, digits: int) -> Column:
    """Round half up by arithmetic on the double, so ties fall the same way in every engine."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def micros(ts: Column) -> Column:
    """Epoch microseconds; the integer time axis used by all window operators."""
    return F.unix_micros(ts.cast("timestamp"))


def stable_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def entity_id(node_type: str | Column, key: Column, tenant: Column) -> Column:
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat_ws(":", tenant, kind, stable_hash(F.trim(F.lower(key))))


def edge_key(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws("|", src, kind, dst)


def one_row(*frames):
    """Join one-row frames side by side without a cross join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
