"""Sums over range joins, without forming the pairs.

``sums_before`` and ``sums_after`` give every distinct probe row the sum of each measure over
the events of its key on one side of its tick, and the number of its copies: what grouping
an equi-plus-inequality join by its probe would give, at a cost linear in events and probes.

Events and probes of a key meet in one task, and a running sum answers the probes. Rows that
are equal but for their measures are combined first, map-side where they can be. A key whose
rows have more ticks than one task should take is cut along its time axis into slices of
nearly as many ticks each, wherever on the axis these lie. An event of such a key also goes,
as a total, to the edge of every slice that it comes before; those copies are combined
map-side too, so that few of them travel. So every input is read and exchanged once, whether
or not keys are cut.

Cuts come from a sample of the keys' ticks, drawn by hash within the same lazy plan. At most
one tick in ``SAMPLE`` distinct ones is drawn, and keys with fewer than ``PER_SLICE`` draws
need no cut, so the cuts may be broadcast: at most one value per two million rows. The sample
only decides where rows meet; sums have the type of Spark's ``sum`` and are rounded nowhere.
Decimal and whole sums are the same under any cuts; doubles are added in another order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_HOUR = 3_600_000_000

# One distinct tick of so many is drawn; a slice has so many draws, about two million ticks.
SAMPLE = 125_000
PER_SLICE = 16
# A key has at most so many slices; beyond about a thousand million ticks they grow.
MOST_SLICES = 512

COPIES = "copies"

#: Tables that hold all rows of a key, with their key columns and their ticks as SQL.
Sampled = Sequence[tuple[DataFrame, str, str]]


def tick_sql(column: str) -> str:
    """Microseconds since the epoch, UTC."""
    return f"unix_micros(cast({column} as timestamp))"


def tick_of(column: str) -> Column:
    return F.expr(tick_sql(column))


def sums_before(
    events: DataFrame,
    probes: DataFrame,
    key: str,
    measures: Sequence[str],
    sampled: Sampled | None = None,
) -> DataFrame:
    """Distinct probe rows with the sums over strictly earlier events, and ``copies``."""
    return _sums(events, probes, key, measures, sampled, later=False)


def sums_after(
    events: DataFrame,
    probes: DataFrame,
    key: str,
    measures: Sequence[str],
    sampled: Sampled | None = None,
) -> DataFrame:
    """Distinct probe rows with the sums over strictly later events, and ``copies``."""
    return _sums(events, probes, key, measures, sampled, later=True)


def summed_type(kind: T.DataType) -> str:
    """The type that sums of sums of a column keep: Spark's, at full precision."""
    if isinstance(kind, T.DecimalType):
        return f"decimal(38,{kind.scale})"
    return "double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "bigint"


def summed_kind(kind: T.DataType) -> str:
    """The type of Spark's ``sum`` of a column."""
    if isinstance(kind, T.DecimalType):
        return f"decimal({min(38, kind.precision + 10)},{kind.scale})"
    return summed_type(kind)


def cut_points(sampled: Sampled) -> DataFrame:
    """``cut_key`` and ``cuts``, the ticks at which its slices but the first begin."""
    drawn = [table.selectExpr(f"{key} as cut_key", f"{tick} as tick") for table, key, tick in sampled]
    keys = (
        reduce(DataFrame.unionAll, drawn)
        .where(
            "cut_key is not null and tick is not null "
            f"and pmod(xxhash64(cut_key, tick), {SAMPLE}) = 0"
        )
        .groupBy("cut_key")
        .agg(F.expr("sort_array(collect_set(tick)) as ticks"))
    )
    step = f"greatest({PER_SLICE}, cast(ceil(size(ticks) / {MOST_SLICES}) as int))"
    cuts = f"transform(sequence({step}, size(ticks) - 1, {step}), i -> ticks[i]) as cuts"
    return keys.where(f"size(ticks) > {step}").selectExpr("cut_key", cuts)


def _places(later: bool) -> str:
    """Where a row goes: to its slice, and an event to the edges of those it comes before."""
    at = "size(filter(cuts, cut -> cut <= tick))"
    if later:
        any_passed, passed = f"{at} > 0", f"sequence(0, {at} - 1)"
        edge = "cuts[s]"  # after the last tick of the slice
    else:
        any_passed, passed = f"{at} < size(cuts)", f"sequence({at} + 1, size(cuts))"
        edge = "cuts[s - 1] - 1"  # before its first tick

    def place(number: str, tick: str) -> str:
        return f"named_struct('slice', {number}, 'tick', {tick})"

    return (
        f"case when cuts is null then array({place('0', 'tick')}) "
        f"when probed is null and {any_passed} then concat(array({place(at, 'tick')}), "
        f"transform({passed}, s -> {place('s', edge)})) "
        f"else array({place(at, 'tick')}) end"
    )


def _sums(
    events: DataFrame,
    probes: DataFrame,
    key: str,
    measures: Sequence[str],
    sampled: Sampled | None,
    later: bool,
) -> DataFrame:
    """``events`` has key, tick and the measures; ``probes`` key, tick and more.

    Probes without key or tick match nothing and are left out. ``sampled`` names tables whose
    rows bound those of a key, by default events and probes.
    """
    types = {f.name: summed_type(f.dataType) for f in events.schema if f.name in measures}
    matchable = f"{key} is not null and tick is not null"
    cuts = F.broadcast(cut_points(sampled or [(events, key, "tick"), (probes, key, "tick")]))
    rows = probes.withColumn("probed", F.lit(1)).unionByName(
        events.select(key, "tick", *measures), allowMissingColumns=True
    )
    rows = rows.where(matchable).join(cuts, F.col(key) == F.col("cut_key"), "left")
    shown = [name for name in probes.columns if name != "tick"]
    placed = rows.selectExpr("probed", *shown, *measures, f"explode({_places(later)}) as at")
    combined = placed.groupBy("probed", *shown, "at").agg(
        F.expr(f"count(1) as {COPIES}"),
        *(F.expr(f"cast(sum({name}) as {kind}) as {name}") for name, kind in types.items()),
    )
    order = f"order by at.tick {'desc' if later else 'asc'}"
    passed = f"over (partition by {key}, at.slice {order} range between unbounded preceding and 1 preceding)"
    answers = (
        f"cast(coalesce(sum({name}) {passed}, 0) as {kind}) as {name}"
        for name, kind in types.items()
    )
    # The filter on the mark is not pushed below the window, whose rows it needs.
    return (
        combined.selectExpr("probed", *shown, "at.tick as tick", COPIES, *answers)
        .where("probed = 1")
        .selectExpr(*probes.columns, *measures, COPIES)
    )
