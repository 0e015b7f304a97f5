"""Column values and cascading facets in one scan.

For each target column the answer is its distinct non-null values under the
date range and the filters of every *other* column, sorted, first 1000.
Instead of one query per column, each row is tested against every column
predicate once:

* ``fail_c``  = row fails column c's filter (null counts as fail);
* ``fails``   = number of failed columns; a row failing two or more
  columns cannot contribute to any facet and is dropped before exploding;
* for target t the row contributes iff ``fails - fail_t == 0``.

The row then generates one ``(column, value)`` row per target (``inline``), which
a partial aggregate de-duplicates per task before the single shuffle
(hashed on column *and* value, so a high-cardinality or hot column spreads
over all reducers). The cap is a ``row_number() <= cap`` per column, which
Spark plans as ``WindowGroupLimit`` so each task ships at most ``cap`` rows
per column to the final window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    FractionalType,
    IntegralType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from eventlens.operators.filters import FilterSpec, column_predicates, qcol
from eventlens.schema import FACET_VALUE_CAP, TIME_COLUMN


def _sort_keys(c: Column, dtype: DataType) -> tuple[Column, Column]:
    """Typed ordering carried beside the string value ('10' sorts after '9')."""
    null_long = F.lit(None).cast("long")
    null_double = F.lit(None).cast("double")
    if isinstance(dtype, BooleanType):
        return c.cast("int").cast("long"), null_double
    if isinstance(dtype, IntegralType):
        return c.cast("long"), null_double
    if isinstance(dtype, FractionalType):
        return null_long, c.cast("double")
    if isinstance(dtype, DateType):
        return F.unix_date(c).cast("long"), null_double
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c), null_double
    if isinstance(dtype, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")), null_double
    return null_long, null_double


def target_columns(rows: DataFrame, columns: Sequence[str] | None) -> list[str]:
    if columns is None:
        return [c for c in rows.columns if c != TIME_COLUMN]
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"unknown facet column(s) {missing}; available: {rows.columns}")
    return list(dict.fromkeys(columns))


def _exploded(
    rows: DataFrame,
    spec: FilterSpec | None,
    columns: Sequence[str] | None,
    prefilter: bool,
    validate: bool,
) -> DataFrame:
    """``column_name, value, sort_long, sort_double, ok`` per (row, target column)."""
    targets = target_columns(rows, columns)
    if not targets:
        raise ValueError("no facet columns")
    preds = column_predicates(rows, spec or FilterSpec(), validate)
    # Each predicate (regexes included) is evaluated once per row, in a
    # projection below the generator, not once per exploded struct.
    fail_names = {c: f"__fail_{i}" for i, c in enumerate(preds)}
    cols = [qcol(c) for c in targets] + [
        (~F.coalesce(p, F.lit(False))).cast("int").alias(fail_names[c]) for c, p in preds.items()
    ]
    base = rows.select(*cols)
    if preds:
        base = base.withColumn("__fails", sum((F.col(n) for n in fail_names.values()), F.lit(0)))
        if prefilter:
            base = base.where(F.col("__fails") <= 1)
    structs = []
    for c in targets:
        dtype = rows.schema[c].dataType
        sort_long, sort_double = _sort_keys(qcol(c), dtype)
        if not preds:
            ok = F.lit(True)
        elif c in fail_names:
            ok = (F.col("__fails") - F.col(fail_names[c])) == 0
        else:
            ok = F.col("__fails") == 0
        structs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                qcol(c).cast("string").alias("value"),
                sort_long.alias("sort_long"),
                sort_double.alias("sort_double"),
                ok.alias("ok"),
            )
        )
    return base.select(F.inline(F.array(*structs))).where(F.col("value").isNotNull())


PRELIMIT_SCHEMA = StructType(
    [
        StructField("column_name", StringType()),
        StructField("value", StringType()),
        StructField("sort_long", LongType()),
        StructField("sort_double", DoubleType()),
    ]
)


def _first_distinct_per_task(cap: int):
    """Arrow function for ``mapInArrow``: per task, per column, the first ``cap``
    distinct (value, sort keys) in Spark's order (sort_long, sort_double nulls
    last; value by UTF-8 bytes). Exact: a value among the global first ``cap``
    is among the first ``cap`` of every task that holds it."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        order = [("sort_long", "ascending"), ("sort_double", "ascending"), ("value", "ascending")]
        best: dict[str, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in pc.unique(table["column_name"]).to_pylist():
                part = table.filter(pc.equal(table["column_name"], name))
                if name in best:
                    part = pa.concat_tables([best[name], part])
                part = part.group_by(["column_name", "value", "sort_long", "sort_double"]).aggregate([])
                idx = pc.sort_indices(part, sort_keys=order, null_placement="at_end")
                best[name] = part.take(idx[:cap]).select(["column_name", "value", "sort_long", "sort_double"])
        for table in best.values():
            yield from table.cast(pa.schema(
                [("column_name", pa.string()), ("value", pa.string()),
                 ("sort_long", pa.int64()), ("sort_double", pa.float64())]
            )).to_batches()

    return run


def facet_values(
    rows: DataFrame,
    spec: FilterSpec | None = None,
    columns: Sequence[str] | None = None,
    cap: int = FACET_VALUE_CAP,
    validate: bool = True,
    prelimit: bool = False,
) -> DataFrame:
    """``column_name, value, value_rank``: per column, its first ``cap`` distinct values
    (typed order) among rows passing every other column's filter.

    ``prelimit=True`` cuts each task's candidates to its first ``cap``
    distinct values per column before the shuffle (Arrow-batched
    ``mapInArrow``), so a high-cardinality column ships at most ``cap``
    rows per task instead of all its distinct values. Same result.
    """
    ex = _exploded(rows, spec, columns, prefilter=True, validate=validate).where(F.col("ok"))
    candidates = ex.select("column_name", "value", "sort_long", "sort_double")
    if prelimit:
        candidates = candidates.mapInArrow(_first_distinct_per_task(cap), PRELIMIT_SCHEMA)
    return _capped_values(candidates.distinct(), cap)


def column_values(
    rows: DataFrame, columns: Sequence[str] | None = None, cap: int = FACET_VALUE_CAP,
    prelimit: bool = False,
) -> DataFrame:
    """Distinct non-null values per column (all but ``timestamp``), sorted, first ``cap``."""
    return facet_values(rows, None, columns, cap, prelimit=prelimit)


def _target_rows(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """``column_name`` of each target, so that columns without a value are listed too."""
    return rows.sparkSession.createDataFrame([(c,) for c in targets], "column_name string")


def column_metadata_values(
    rows: DataFrame, columns: Sequence[str] | None = None, cap: int = FACET_VALUE_CAP,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Column metadata with its values, one row per (column, value), one with a
    null value for a column without any: ``column_name, data_type, label, value, value_rank``."""
    from eventlens.functions.text import column_label

    targets = target_columns(rows, columns)
    meta = F.create_map(
        *[x for c in targets for x in (F.lit(c), F.lit(rows.schema[c].dataType.simpleString()))]
    )
    names = F.create_map(*[x for c in targets for x in (F.lit(c), F.lit(column_label(c, labels)))])
    values = _target_rows(rows, targets).join(facet_values(rows, None, targets, cap), "column_name", "left")
    return values.select(
        "column_name",
        meta[F.col("column_name")].alias("data_type"),
        names[F.col("column_name")].alias("label"),
        "value",
        "value_rank",
    )


def facet_counts(
    rows: DataFrame,
    spec: FilterSpec | None = None,
    columns: Sequence[str] | None = None,
    cap: int = FACET_VALUE_CAP,
    validate: bool = True,
    approx: bool = False,
    rsd: float = 0.01,
) -> DataFrame:
    """``column_name, available_values, total_values, count_label`` in one pass.

    Every target has a row, also one without a value. Counts are exact; ``count_label`` uses lists capped at ``cap`` like a
    filter panel does: ``(a of m)`` when fewer are available, else ``(m)``.
    ``approx=True`` estimates both counts with HyperLogLog++ (relative
    standard deviation ``rsd``), so no distinct value crosses the shuffle;
    use it for high-cardinality columns when an estimate is acceptable.
    """
    ex = _exploded(rows, spec, columns, prefilter=False, validate=validate)
    if approx:
        # HyperLogLog++ sketches: one partial sketch per column per task crosses
        # the shuffle instead of every distinct value. Relative error ~rsd.
        per_column = ex.groupBy("column_name").agg(
            F.approx_count_distinct(F.when(F.col("ok"), F.col("value")), rsd).alias("available_values"),
            F.approx_count_distinct("value", rsd).alias("total_values"),
        )
    else:
        per_value = ex.groupBy("column_name", "value").agg(F.max(F.col("ok").cast("int")).alias("avail"))
        per_column = per_value.groupBy("column_name").agg(
            F.sum("avail").cast("long").alias("available_values"),
            F.count(F.lit(1)).alias("total_values"),
        )
    every = _target_rows(rows, target_columns(rows, columns)).join(per_column, "column_name", "left")
    return _labels_from_counts(every.fillna(0, ["available_values", "total_values"]), cap)


def _capped_values(per_value: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("column_name").orderBy(
        F.col("sort_long").asc_nulls_last(), F.col("sort_double").asc_nulls_last(), F.col("value").asc()
    )
    ranked = per_value.withColumn("value_rank", F.row_number().over(order))
    return ranked.where(F.col("value_rank") <= cap).select(
        "column_name", "value", F.col("value_rank").cast("long").alias("value_rank")
    )


def _labels_from_counts(per_column: DataFrame, cap: int) -> DataFrame:
    a = F.least(F.col("available_values"), F.lit(cap))
    m = F.least(F.col("total_values"), F.lit(cap))
    label = F.when(
        a < m, F.concat(F.lit("("), a.cast("string"), F.lit(" of "), m.cast("string"), F.lit(")"))
    ).otherwise(F.concat(F.lit("("), m.cast("string"), F.lit(")")))
    return per_column.select("column_name", "available_values", "total_values", label.alias("count_label"))


@dataclass(frozen=True)
class FacetPanel:
    """A filter panel's cascading values and their "(a of m)" counts."""

    values: DataFrame  # column_name, value, value_rank (available values, capped)
    counts: DataFrame  # column_name, available_values, total_values, count_label


def facet_panel(
    rows: DataFrame,
    spec: FilterSpec | None = None,
    columns: Sequence[str] | None = None,
    cap: int = FACET_VALUE_CAP,
    validate: bool = True,
    approx: bool = False,
) -> FacetPanel:
    """Values *and* counts of a filter panel, each lazy and from its own scan.

    The distinct values of a column can be as many as the rows, so they are
    not stored between the two.

    ``approx=True`` is the mode for high-cardinality columns: values through
    the exact per-task cut (``prelimit``), counts from HyperLogLog sketches;
    then no column's distinct values cross a shuffle.
    """
    return FacetPanel(
        facet_values(rows, spec, columns, cap, validate, prelimit=approx),
        facet_counts(rows, spec, columns, cap, validate=False, approx=approx),
    )


def value_search(
    rows: DataFrame,
    column: str,
    term: str,
    spec: FilterSpec | None = None,
    cap: int = FACET_VALUE_CAP,
) -> DataFrame:
    """Facet values of ``column`` containing ``term``, case-insensitively."""
    values = facet_values(rows, spec, [column], cap)
    return values.where(F.lower(F.col("value")).contains(term.lower()))
