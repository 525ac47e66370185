"""Exact quantiles that never gather a whole column in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.session import materialize

CELLS_PER_LEVEL = 4096
ROWS_PER_TASK = 100_000  # a cell with more rows is cut again before it is sorted


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group: ``by..., n, quantiles``.

    The narrow input is stored once and the wanted ranks are located by
    counting. Values are first counted by sign and power of two, then the range
    that holds a rank is cut into equal cells, and so on until no such cell has
    more than ``rows_per_task`` rows; only those are sorted. Counts combine
    within each input partition, so no shuffle carries the values themselves.
    NULL and NaN values are ignored, and so are rows whose group is NULL.
    ``weight`` names a column with the number of copies of each row.
    """
    by, probs = list(by), [float(p) for p in probs]
    value = F.col(value) if isinstance(value, str) else value
    copies = F.col(weight) if weight else F.lit(1)
    # `_all` is a stored constant, so that "no grouping" also joins on a key.
    rows = materialize(
        df.select(*by, (value.cast("double") + 0.0).alias("_v"), copies.cast("long").alias("_n"), F.lit(0).alias("_all"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_n") > 0))
        .dropna(subset=by or None),
        "values",
    )
    keys = [*by, "_all"]
    cell_keys, placed = [*keys, "_c0"], rows.withColumn("_c0", _magnitude(F.col("_v")))
    cells = materialize(_count_cells(placed, keys, "_c0"), "cells")
    n = F.sum("_cn").over(Window.partitionBy(*keys))
    position = lambda total, p: (total - 1) * F.lit(p)
    with_n = cells.withColumn("n", n)
    ranks = F.array_distinct(
        F.flatten(F.array(*[F.array(F.floor(position(F.col("n"), p)), F.ceil(position(F.col("n"), p))) for p in probs]))
    )
    # One row per wanted rank; `_k` is the rank still to go inside its cell.
    spread = with_n.withColumn("_rank", F.explode(ranks)).withColumn("_k", F.col("_rank"))
    wanted = materialize(_cells_of_ranks(spread), "ranks")
    level = 0
    while True:
        open_cells = wanted.where("_lo < _hi")
        largest = open_cells.agg(F.max("_rows")).first()[0]
        if largest is None or largest <= rows_per_task:
            break
        level += 1
        cell = f"_c{level}"
        ranges = open_cells.select(*cell_keys, "_lo", "_hi").distinct()
        placed = placed.join(ranges, cell_keys).withColumn(cell, _cell_of(F.col("_v"))).drop("_lo", "_hi")
        cut = wanted.drop("_rows", "_lo", "_hi").join(_count_cells(placed, cell_keys, cell), cell_keys)
        settled = wanted.where("_lo = _hi").withColumn(cell, F.lit(0))
        wanted = materialize(_cells_of_ranks(cut).unionByName(settled), "ranks")
        cell_keys.append(cell)
    inside = Window.partitionBy(*cell_keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    sorted_cells = placed.join(wanted.where("_lo < _hi").select(*cell_keys).distinct(), cell_keys).withColumn(
        "_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    within = (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_n"))
    found = wanted.where("_lo < _hi").join(sorted_cells, cell_keys).where(within).select(*keys, "_rank", "_v")
    found = found.unionByName(wanted.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_v")))
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def interpolate(p: float) -> Column:
        place = position(F.col("n"), p)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.col("_at")[low], F.col("_at")[high]
        mixed = (high - place) * a + (place - low) * b
        return F.when(a == b, a).otherwise(mixed)

    totals = cells.groupBy(*keys).agg(F.sum("_cn").alias("n"))
    filled = totals.join(at, keys).select(*by, "n", F.array(*[interpolate(p) for p in probs]).alias("quantiles"))
    if by:
        return filled
    # Without groups there is always one row, also for an empty column.
    return filled.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("quantiles").alias("quantiles"))


#: Ranks a sketch may be off, as a share of the rows, and the share kept on either side of a wanted rank.
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 2 / SKETCH_ACCURACY


@dataclass
class _Bracket:
    """Values of one column strictly between two others, which hold wanted ranks (``below`` copies come before them)."""

    column: int
    ranks: list[int]
    below: int
    rows: int
    low: float | None = None
    high: float | None = None

    def inside(self) -> Column:
        value = F.col(f"_{self.column}")
        within = value.isNotNull()
        if self.low is not None:
            within = within & (value > F.lit(self.low))
        return within if self.high is None else within & (value < F.lit(self.high))

    def sketch(self, shares: Sequence[float]) -> Column:
        wanted = [x for p in shares for x in (max(0.0, p - SKETCH_MARGIN), min(1.0, p + SKETCH_MARGIN))]
        return F.percentile_approx(F.when(self.inside(), F.col(f"_{self.column}")), wanted, SKETCH_ACCURACY)


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], rows_per_task: int = ROWS_PER_TASK
) -> dict[str, tuple[int, list[float | None]]]:
    """Exact, linearly interpolated quantiles of many columns: ``{column: (n, quantiles)}``.

    The columns are stored once, side by side; no row is turned into one row per
    column. One aggregation sketches all columns and so brackets every wanted
    rank, a second one counts what lies below, on and between the brackets'
    ends. A rank on an end is settled, however many copies that value has;
    otherwise the bracket's inside, a few ten-thousandths of the rows, is
    bracketed again until it has at most ``rows_per_task`` rows, which are sorted.
    The counts are exact, so a poor sketch costs another round and never a wrong rank.
    NULL and NaN are ignored; a column without values has n = 0 and no quantiles.
    A few numbers per column and probability reach the driver.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    if not columns:
        return {}

    def clean(c: str) -> Column:
        value = F.col(f"`{c}`").cast("double") + 0.0
        return F.when(~F.isnan(value), value)

    rows = materialize(df.select(*[clean(c).alias(f"_{i}") for i, c in enumerate(columns)]), "columns")
    whole = [_Bracket(i, [], 0, 0) for i in range(len(columns))]
    first = rows.agg(
        *[F.count(f"_{i}").alias(f"n{i}") for i in range(len(columns))],
        *[b.sketch(probs).alias(f"s{b.column}") for b in whole],
    ).first()
    n = [first[f"n{i}"] for i in range(len(columns))]
    settled: dict[tuple[int, int], float] = {}
    brackets: list[tuple[_Bracket, float, float]] = []  # with the ends a sketch proposes
    small: list[_Bracket] = []
    for i, total in enumerate(n):
        wanted = [sorted({math.floor((total - 1) * p), math.ceil((total - 1) * p)}) for p in probs] if total else []
        if total and total <= rows_per_task:
            small.append(_Bracket(i, sorted({r for ranks in wanted for r in ranks}), 0, total))
            continue
        for j, ranks in enumerate(wanted):
            brackets.append((_Bracket(i, ranks, 0, total), first[f"s{i}"][2 * j], first[f"s{i}"][2 * j + 1]))
    while brackets:
        cut = [part for b in _cut(rows, brackets) for part in b]
        for part in cut:
            if part.low is not None and part.low == part.high:
                settled.update({(part.column, r): part.low for r in part.ranks})
        open_parts = [part for part in cut if part.low is None or part.low != part.high]
        small += [part for part in open_parts if part.rows <= rows_per_task]
        large = [part for part in open_parts if part.rows > rows_per_task]
        if not large:
            break
        shares = [(part.ranks[0] - part.below) / (part.rows - 1) for part in large]
        ends = rows.agg(*[part.sketch([p]).alias(f"s{k}") for k, (part, p) in enumerate(zip(large, shares))]).first()
        brackets = [(part, ends[k][0], ends[k][1]) for k, part in enumerate(large)]
    settled |= _sorted_ranks(rows, small)

    def quantile(i: int, p: float) -> float | None:
        if not n[i]:
            return None
        place = (n[i] - 1) * p
        low, high = math.floor(place), math.ceil(place)
        a, b = settled[i, low], settled[i, high]
        return a if a == b else (high - place) * a + (place - low) * b

    return {c: (n[i], [quantile(i, p) for p in probs]) for i, c in enumerate(columns)}


def _cut(rows: DataFrame, brackets: list[tuple[_Bracket, float, float]]) -> Iterator[list[_Bracket]]:
    """Split every bracket at two of its values and keep the parts with wanted ranks; a part that is one value has equal ends."""
    counts = []
    for k, (b, low, high) in enumerate(brackets):
        value, inside = F.col(f"_{b.column}"), b.inside()
        parts = [value < low, value == low, (value > low) & (value < high), (value == high) & F.lit(low != high)]
        counts.append(F.array(*[F.count_if(inside & part) for part in parts]).alias(f"c{k}"))
    found = rows.agg(*counts).first()
    for k, (b, low, high) in enumerate(brackets):
        sizes = [*found[f"c{k}"], b.rows - sum(found[f"c{k}"])]
        ends = [(b.low, low), (low, low), (low, high), (high, high), (high, b.high)]
        below, parts = b.below, []
        for size, (a, z) in zip(sizes, ends):
            ranks = [r for r in b.ranks if below <= r < below + size]
            if ranks:
                parts.append(_Bracket(b.column, ranks, below, size, a, z))
            below += size
        yield parts


def _sorted_ranks(rows: DataFrame, brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    """Values of the wanted ranks of brackets small enough to be sorted, one group each."""
    if not brackets:
        return {}
    held = [
        F.when(b.inside(), F.struct(F.lit(k).alias("k"), F.col(f"_{b.column}").alias("v"))) for k, b in enumerate(brackets)
    ]
    values = rows.select(F.explode(F.array_compact(F.array(*held))).alias("_h")).select("_h.k", "_h.v")
    ordered = values.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("v"))
    places = F.create_map(*[x for k, b in enumerate(brackets) for x in (F.lit(k), F.array(*[F.lit(r - b.below) for r in b.ranks]))])
    picked = ordered.select("k", F.transform(places[F.col("k")], lambda r: F.get("v", r)).alias("v")).collect()
    return {(brackets[r["k"]].column, rank): v for r in picked for rank, v in zip(brackets[r["k"]].ranks, r["v"])}


def _count_cells(placed: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Copies, rows and limits of every cell, and the copies in lower cells of the same keys."""
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy(*keys, cell)
        .agg(F.sum("_n").alias("_cn"), F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_before", F.coalesce(F.sum("_cn").over(earlier), F.lit(0)))
    )


def _cells_of_ranks(spread: DataFrame) -> DataFrame:
    """Keep for every rank the cell it lies in, and count the rank from there."""
    within = (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_cn"))
    return spread.where(within).withColumn("_k", F.col("_k") - F.col("_before")).drop("_cn", "_before", "n")


def _magnitude(value: Column) -> Column:
    """A number that grows with the value: its sign and power of two (at most some 4,300 different)."""
    power = F.when(F.abs(value) == float("inf"), F.lit(1100)).otherwise(F.floor(F.log2(F.abs(value)))) + 1100
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * power).cast("int")


def counts_below(hist: DataFrame, by: Sequence[str], value: str, count: str, out: str) -> DataFrame:
    """Append to counted distinct values the number of smaller ones in their group.

    The values are range-partitioned, which is balanced for any distribution,
    and stored with their partition. Running totals of the partitions and
    of the values inside one partition are added, so no window holds a whole group.
    """
    by = list(by)
    ranged = hist.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id())
    stored = materialize(ranged, "ranges")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy(*by, "_part").agg(F.sum(count).alias("_total"))
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_offset") + F.coalesce(F.sum(count).over(inside), F.lit(0))
    return stored.join(parts, [*by, "_part"]).select(*hist.columns, below.alias(out))


def _cell_of(value: Column) -> Column:
    """Equal-width cell of a value between the columns ``_lo`` and ``_hi``, which have one sign and power of two."""
    span = F.col("_hi") - F.col("_lo")
    place = F.floor((value - F.col("_lo")) / span * F.lit(float(CELLS_PER_LEVEL)))
    return F.when(span > 0, F.least(F.lit(CELLS_PER_LEVEL - 1), place)).otherwise(F.lit(0)).cast("int")
