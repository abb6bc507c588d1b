"""Global order without a single-task sort: tiles, quantiles, positions and running totals.

A window over a whole table moves every row to one task. Here the rows are range-partitioned on a
unique composite key and stored together with the number of the range ("slot") they fell in. Row
counts per slot give every slot's offset, so a global position needs only an in-slot sort, and the
few rows that sit at given positions need only the slots that hold them.

What reaches the driver is bounded by the cluster's settings and the request, never by the data:
one count per slot (there are as many as shuffle partitions) and one row per requested position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from mercantile.functions.expressions import row_count
from mercantile.sources.scratch import Scratch


def range_layout(df: DataFrame, keys: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` stored in ranges of ``keys``, with the range number in ``slot``."""
    laid = df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("slot", F.spark_partition_id())
    return scratch.store(laid, name)


def slot_offsets(layout: DataFrame, group: str, sums: Sequence[str]) -> DataFrame:
    """Per group and slot: how much of each summed column lies in the slots before it, and the group total.

    The window runs over one row per slot, so its size is the number of shuffle partitions.
    """
    per_slot = layout.groupBy(group, "slot").agg(*[F.sum(c).alias(f"{c}_slot") for c in sums])
    before = Window.partitionBy(group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    zero = F.lit(0)
    return per_slot.select(
        group,
        "slot",
        *[F.col(f"{c}_slot") for c in sums],
        *[F.coalesce(F.sum(f"{c}_slot").over(before), zero).alias(f"{c}_before") for c in sums],
        *[F.sum(f"{c}_slot").over(whole).alias(f"{c}_total") for c in sums],
    )


def rows_at_positions(
    layout: DataFrame, order: Sequence[str], positions: Callable[[str, int], Mapping[str, int]]
) -> tuple[dict[tuple[str, str], Row], dict[str, int]]:
    """The rows of a weighted layout that cover given 0-based positions, and the weight per ordering.

    ``layout`` has columns ``ordering``, ``slot``, ``weight`` and those in ``order``. ``positions``
    maps an ordering and its total weight to positions by tag. A row covers the positions from the
    weight before it up to, but without, that plus its own weight. Positions past the end are
    left out of the result, which is keyed by (ordering, tag).
    """
    counts = layout.groupBy("ordering", "slot").agg(F.sum("weight").alias("n")).orderBy("ordering", "slot").collect()
    totals: dict[str, int] = {}
    for c in counts:
        totals[c["ordering"]] = totals.get(c["ordering"], 0) + c["n"]
    requests = {o: positions(o, total) for o, total in totals.items()}

    before: dict[str, int] = dict.fromkeys(totals, 0)
    places = []
    for c in counts:
        ordering, begin = c["ordering"], before[c["ordering"]]
        places += [
            (ordering, c["slot"], tag, at - begin)
            for tag, at in requests[ordering].items()
            if begin <= at < begin + c["n"]
        ]
        before[ordering] = begin + c["n"]
    if not places:
        return {}, totals

    # Literal slot numbers reach the scan and skip the files of all other slots. The list of places
    # has one row per requested position, which bounds both broadcasts.
    targets = layout.sparkSession.createDataFrame(places, "ordering string, slot int, tag string, at long")
    inside = Window.partitionBy("ordering", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        layout.where(F.col("slot").isin(sorted({slot for _, slot, _, _ in places})))
        .join(F.broadcast(targets.select("ordering", "slot").distinct()), ["ordering", "slot"], "left_semi")
        .withColumn("upto", F.sum("weight").over(inside))
        .join(F.broadcast(targets), ["ordering", "slot"])
        .where("at < upto AND at >= upto - weight")
        .select("ordering", "tag", *order)
    )
    return {(r["ordering"], r["tag"]): r for r in found.collect()}, totals


def _stacked(df: DataFrame, keys: Mapping[str, Column], key_type: str, *carried: str) -> DataFrame:
    """One row per input row and ordering: ``ordering``, ``key`` and the carried columns (NULL keys left out)."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(o).alias("ordering"), k.cast(key_type).alias("key")) for o, k in keys.items()])
    )
    return df.select(pairs.alias("p"), *carried).select("p.ordering", "p.key", *carried).where("key IS NOT NULL")


def _reaches(df: DataFrame, key: Column, key_type: str, tiebreak: str, cut: Row | None) -> Column:
    """Whether a row sorts at or after the cut row; there is none past the end."""
    if cut is None:
        return F.lit(False)
    key, at = key.cast(key_type), F.lit(cut["key"]).cast(key_type)
    last = F.lit(cut[tiebreak]).cast(df.schema[tiebreak].dataType)
    return (key > at) | ((key == at) & (F.col(tiebreak) >= last))


def add_tiles(
    df: DataFrame,
    keys: Mapping[str, Column],
    tiebreak: str,
    tiles: int,
    scratch: Scratch,
    key_type: str = "decimal(38,2)",
) -> DataFrame:
    """Adds NTILE numbers: column ``o`` holds the tile of the row when sorted by ``keys[o]``, then ``tiebreak``.

    Only the first row of every tile is looked up. All rows then get their tile by comparing
    (key, tiebreak) with those cut rows, without a shuffle or a join back. Pass a stored ``df``,
    for it is read twice. Keys must not be NULL, and ``tiebreak`` must be unique.
    """
    layout = range_layout(
        _stacked(df, keys, key_type, tiebreak).withColumn("weight", F.lit(1).cast("long")),
        ["ordering", "key", tiebreak],
        scratch,
        "tiles",
    )

    def first_rows(_: str, total: int) -> dict[str, int]:
        whole, extra = divmod(total, tiles)
        return {str(t): whole * t + min(extra, t) for t in range(1, tiles)}

    cuts, _ = rows_at_positions(layout, ["key", tiebreak], first_rows)
    numbers = {}
    for o, key in keys.items():
        number = None
        for t in range(tiles - 1, 0, -1):
            cut = cuts.get((o, str(t)))
            if cut is not None:
                reached = _reaches(df, key, key_type, tiebreak, cut)
                number = F.when(reached, t + 1) if number is None else number.when(reached, t + 1)
        numbers[o] = F.lit(1) if number is None else number.otherwise(1)
    return df.withColumns(numbers)


def _rows_of_the_bucket(rows: DataFrame, bucket: Column, position: Callable[[int], int]) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """By ordering: the rows of the bucket that holds ``position(row count)``, that place within the bucket, and the row count.

    A bucket of NULL comes first, as NULL keys do. One count per ordering and bucket reaches the driver.
    """
    counts = rows.groupBy("ordering", bucket.alias("bucket")).agg(row_count().alias("n")).collect()
    counts.sort(key=lambda c: (c["bucket"] is not None, 0 if c["bucket"] is None else c["bucket"]))
    totals: dict[str, int] = {}
    for c in counts:
        totals[c["ordering"]] = totals.get(c["ordering"], 0) + c["n"]
    places = {name: position(total) for name, total in totals.items()}
    held, passed = F.lit(False), set()
    for c in counts:
        name = c["ordering"]
        if name in passed:
            continue
        if places[name] < c["n"]:
            held = held | ((F.col("ordering") == name) & bucket.eqNullSafe(F.lit(c["bucket"])))
            passed.add(name)
        else:
            places[name] -= c["n"]
    return rows.where(held), places, totals


def split_at_position(
    df: DataFrame,
    key: Column,
    tiebreak: str,
    position: Callable[[int], int],
    scratch: Scratch,
    names: tuple[str, str] = ("train", "test"),
    within: str | None = None,
    key_type: str = "decimal(38,2)",
    bucket: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds ``split``: the first name for rows before ``position(row count)`` by key, else the second.

    With ``within`` the rows of each value of that column are split on their own; use it for columns
    of few values, such as class labels. ``bucket`` maps a key to one of a few values in the order of the keys (a number, or
    ASCII text): then rows are counted by bucket, and only those of the bucket that holds the position are laid out in order.
    Pass a stored ``df``, for it is read three times.
    """
    group = F.lit("all") if within is None else F.coalesce(F.col(within).cast("string"), F.lit("missing"))
    rows = df.select(
        group.alias("ordering"), key.cast(key_type).alias("key"), tiebreak, F.lit(1).cast("long").alias("weight")
    )
    if bucket is None:
        layout = range_layout(rows, ["ordering", "key", tiebreak], scratch, "split")
        cuts, totals = rows_at_positions(layout, ["key", tiebreak], lambda _, total: {"cut": position(total)})
    else:
        held, places, totals = _rows_of_the_bucket(rows, bucket(F.col("key")), position)
        # Stored first, as ranges are found by one more read.
        layout = range_layout(scratch.store(held, "split_bucket"), ["ordering", "key", tiebreak], scratch, "split")
        cuts, _ = rows_at_positions(layout, ["key", tiebreak], lambda name, _: {"cut": places[name]})
    later = F.lit(False)
    for name in totals:
        reached = _reaches(df, key, key_type, tiebreak, cuts.get((name, "cut")))
        later = later | ((group == name) & reached)
    return df.withColumn("split", F.when(later, names[1]).otherwise(names[0]))


#: Buckets of one pass over the values of an interval.
QUANTILE_BUCKETS = 1024
_LARGEST = 1.7976931348623157e308


def _bucket(value: Column, lo: float, hi: float, logarithmic: bool) -> Column:
    """The bucket of a value from ``lo`` to ``hi``, in the order of the values: 0 for lo, the last but one for hi, -1 and the last for infinite ones.

    Buckets are evenly wide, or ever wider on a logarithmic scale for values of very different sizes. All steps are
    monotone also where they are rounded, so a bucket never holds a value that belongs before or behind another one's.
    """
    last = QUANTILE_BUCKETS - 1
    low, high = (F.lit(max(-_LARGEST, min(_LARGEST, x))) for x in (lo, hi))
    inner = F.greatest(low, F.least(high, value))
    if math.isinf(hi - lo) or math.isinf(max(-_LARGEST, lo) * 2) or math.isinf(min(_LARGEST, hi) * 2):
        # Differences could overflow: a logarithm on both sides of zero.
        inner, low, high = (F.signum(x) * F.log1p(F.abs(x)) for x in (inner, low, high))
        share = (inner - low) / (high - low)
    elif logarithmic:
        share = F.log1p(inner - low) / F.log1p(high - low)
    else:
        share = (inner - low) / (high - low)
    place = F.least(F.lit(last).cast("long"), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * QUANTILE_BUCKETS))
    return F.when(value == float("-inf"), -1).when(value == float("inf"), last + 1).otherwise(place).cast("int")


def values_at_ranks(df: DataFrame, columns: Mapping[str, Column], ranks: Callable[[str, int], Iterable[int]]) -> dict[str, dict[int, float]]:
    """The values at 0-based ranks of numeric columns, exactly; ``ranks`` maps a column's name and its number of values to ranks.

    By refinement: a pass counts the values by bucket, for all columns and wanted ranks at once, and goes on within the
    bucket that holds the rank, from its smallest to its largest value, until these are equal: two or three passes for most
    columns. Tasks send counts and bounds of at most ``QUANTILE_BUCKETS`` buckets an interval, never values. NULL and NaN are no values.
    """
    names = list(columns)
    if not names:
        return {}
    values = {n: F.when(~F.isnan(columns[n].cast("double")), columns[n].cast("double")) for n in names}
    rows = df.select(*[v.alias(f"v{k}") for k, v in enumerate(values.values())])
    facts = rows.agg(
        *[f(F.col(f"v{k}")).alias(f"{tag}{k}") for k in range(len(names)) for tag, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    found: dict[str, dict[int, float]] = {n: {} for n in names}
    # By column and rank: the interval that holds it, and how many values stand before the interval.
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}
    for k, name in enumerate(names):
        if facts[f"n{k}"]:
            for rank in set(ranks(name, facts[f"n{k}"])):
                open_[k, rank] = (facts[f"lo{k}"], facts[f"hi{k}"], 0)
    logarithmic = False
    while open_:
        for (k, rank), (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[names[k]][rank] = lo
                del open_[k, rank]
        if not open_:
            break
        intervals = sorted({(k, lo, hi) for (k, _), (lo, hi, _) in open_.items()})
        cells = [
            F.when(F.col(f"v{k}").between(lo, hi), F.struct(F.lit(i).alias("i"), _bucket(F.col(f"v{k}"), lo, hi, logarithmic).alias("bucket"), F.col(f"v{k}").alias("v")))
            for i, (k, lo, hi) in enumerate(intervals)
        ]
        held = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
        counted: dict[tuple[int, float, float], list[Row]] = {x: [] for x in intervals}
        for r in held.groupBy("i", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counted[intervals[r["i"]]].append(r)
        for (k, rank), (lo, hi, before) in list(open_.items()):
            for r in sorted(counted[k, lo, hi], key=lambda r: r["bucket"]):
                if rank < before + r["n"]:
                    open_[k, rank] = (r["lo"], r["hi"], before)
                    break
                before += r["n"]
        logarithmic = not logarithmic
    return found


def quantile_values(
    df: DataFrame, wanted: Mapping[str, tuple[str | Column, float]], scratch: Scratch | None = None
) -> dict[str, float | None]:
    """Exact, linearly interpolated quantiles by name: ``{name: (column, share)}``; None without values.

    Pass a stored ``df``: it is read once for the bounds of all columns and once for each pass of the refinement.
    """
    columns: dict[str, Column] = {}
    requests: dict[str, list[tuple[str, float]]] = {}
    for name, (column, share) in wanted.items():
        ordering = column if isinstance(column, str) else name
        columns[ordering] = F.col(column) if isinstance(column, str) else column
        requests.setdefault(ordering, []).append((name, share))
    totals: dict[str, int] = {}

    def neighbours(ordering: str, total: int) -> list[int]:
        totals[ordering] = total
        spots = [(total - 1) * share for _, share in requests[ordering]]
        return [place(spot) for spot in spots for place in (math.floor, math.ceil)]

    found = values_at_ranks(df, columns, neighbours)
    result: dict[str, float | None] = dict.fromkeys(wanted)
    for ordering, total in totals.items():
        for name, share in requests[ordering]:
            spot = (total - 1) * share
            lo, hi = found[ordering][math.floor(spot)], found[ordering][math.ceil(spot)]
            result[name] = lo + (hi - lo) * (spot - math.floor(spot)) if hi != lo else lo
    return result


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[str | Column, float]], scratch: Scratch | None = None) -> DataFrame:
    """``quantile_values`` as a frame of one row."""
    values = quantile_values(df, wanted, scratch)
    return one_row(df, {name: F.lit(value).cast("double") for name, value in values.items()})


def one_row(df: DataFrame, columns: Mapping[str, Any]) -> DataFrame:
    return df.sparkSession.range(1).select(*[c.alias(name) for name, c in columns.items()])


def running_totals(df: DataFrame, key: str, sums: Sequence[str], scratch: Scratch) -> DataFrame:
    """Adds ``{c}_upto`` (total of ``c`` up to and with this row, by ascending key) and ``{c}_all``.

    ``key`` must be unique: aggregate to one row per key first.
    """
    layout = range_layout(df.withColumn("ordering", F.lit(0)), [key], scratch, "running")
    offsets = slot_offsets(layout, "ordering", sums).drop("ordering")
    inside = Window.partitionBy("slot").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    # One row per slot: bounded by the number of shuffle partitions.
    joined = layout.join(F.broadcast(offsets), "slot")
    return joined.select(
        *df.columns,
        *[(F.col(f"{c}_before") + F.sum(c).over(inside)).alias(f"{c}_upto") for c in sums],
        *[F.col(f"{c}_total").alias(f"{c}_all") for c in sums],
    )


def add_positions(
    df: DataFrame, key: Column, tiebreak: str, scratch: Scratch, within: str | None = None, key_type: str = "string"
) -> DataFrame:
    """Adds ``position``: the row's 0-based place by key, then ``tiebreak``, among all rows or those of its value of ``within``.

    Rows are laid out in ranges; a row's place is its number within its range, which one task sorts, plus the rows of the
    ranges before it. With ``within`` use a column of few values. ``tiebreak`` must be unique.
    """
    group = F.lit("all") if within is None else F.coalesce(F.col(within).cast("string"), F.lit("missing"))
    keyed = df.withColumns({"_group": group, "_key": key.cast(key_type), "_one": F.lit(1).cast("long")})
    layout = range_layout(keyed, ["_group", "_key", tiebreak], scratch, "positions")
    # One row per range and group.
    before = slot_offsets(layout, "_group", ["_one"]).select("_group", "slot", "_one_before")
    inside = F.row_number().over(Window.partitionBy("_group", "slot").orderBy("_key", tiebreak)) - 1
    placed = layout.join(F.broadcast(before), ["_group", "slot"])
    return placed.select(*df.columns, (F.col("_one_before") + inside).cast("long").alias("position"))
