"""As-of joins: the last mark at or before a value, found by equal joins on cells of the axis.

The axis of the marks is cut into cells of equal width, about four for each mark of a group. A table of the cells holds
the few marks of each and how many came before, so a row meets one row of that table, whatever the number of marks,
and no range comparison reaches the join. Rows aren't sorted and not shuffled where the table of cells may be broadcast.
Marks that crowd into one cell are compared one by one in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks up to which the table of cells is broadcast; it has five rows a mark at most.
BROADCAST = 20_000


def _axis(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def marks_before(rows: DataFrame, at: str, marks: DataFrame, mark: str, by: tuple[str, ...], name: str, closed: bool = True) -> DataFrame:
    """rows with `name`: how many marks of the row's group `by` are at most (closed) or below its value `at`.

    at and mark are both integers or both timestamps. Groups without marks and rows without a value count none.
    """
    time = dict(marks.dtypes)[mark].startswith("timestamp")
    value = (lambda c: _axis(F.col(c))) if time else (lambda c: F.col(c).cast("long"))
    marks = marks.filter(F.col(mark).isNotNull()).select(*by, value(mark).alias("_m"))
    low, high, n, groups = marks.agg(F.min("_m"), F.max("_m"), F.count("_m"), F.count_distinct(F.struct(*by))).first()
    if not n:
        return rows.withColumn(name, F.lit(0).cast("long"))
    width = max(1, (high - low) // (4 * (n // groups)))
    last = (high - low) // width
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(last), F.call_function("div", F.least(c, F.lit(high)) - F.lit(low), F.lit(width)))).cast("long")
    held = marks.groupBy(*by, cell(F.col("_m")).alias("_cell")).agg(F.sort_array(F.collect_list("_m")).alias("_held"))
    order = Window.partitionBy(*by).orderBy("_cell")
    before = F.coalesce(F.sum(F.size("_held")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*by, "_cell", "_held", before.alias("_base"), F.coalesce(F.lead("_cell").over(order), F.lit(last + 1)).alias("_next"))
    cells = held.select(*[F.col(k).alias(f"_{k}") for k in by], F.explode(F.sequence("_cell", F.col("_next") - 1)).alias("_of"), "_cell", "_held", "_base")
    # a cell without marks of its own counts all that came before it
    own = F.col("_of") == F.col("_cell")
    cells = cells.select(*[f"_{k}" for k in by], "_of", F.when(own, F.col("_held")).otherwise(F.array().cast("array<long>")).alias("_held"), F.when(own, F.col("_base")).otherwise(F.col("_base") + F.size("_held")).alias("_base"))
    cells = F.broadcast(cells) if n <= BROADCAST else cells
    rows = rows.withColumn("_at", value(at))
    rows = rows.withColumn("_in", F.when(F.col("_at") >= low, cell(F.col("_at"))))
    met = rows.join(cells, [*[F.col(k) == F.col(f"_{k}") for k in by], F.col("_in") == F.col("_of")], "left")
    inside = F.size(F.filter("_held", lambda m: (m <= F.col("_at")) if closed else (m < F.col("_at"))))
    return met.withColumn(name, F.coalesce(F.col("_base") + inside, F.lit(0)).cast("long")).drop("_at", "_in", "_of", "_held", "_base", *[f"_{k}" for k in by])


def as_of(rows: DataFrame, at: str, table: DataFrame, mark: str, by: tuple[str, ...], take: list[str]) -> DataFrame:
    """rows with the columns `take` of the group's last row of table whose mark is at most `at`; nulls if there is none.

    Of rows with equal marks any may be the last; marks that are null are left out.
    """
    table = table.filter(F.col(mark).isNotNull())
    numbered = table.select(*[F.col(k).alias(f"_{k}") for k in by], *take, F.row_number().over(Window.partitionBy(*by).orderBy(mark)).alias("_nth"))
    rows = marks_before(rows, at, table, mark, by, "_place")
    return rows.join(numbered, [*[F.col(k) == F.col(f"_{k}") for k in by], F.col("_place") == F.col("_nth")], "left").drop("_place", "_nth", *[f"_{k}" for k in by])
