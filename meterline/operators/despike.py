"""Repair of upward spikes in the cumulative energy counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.operators.pinning import pin
from meterline.operators.timeline import STRIP, Frame, Layout
from meterline.params import EFFECTIVE, Params, Profile, Scale
from meterline.schema import METER, require


def _with_runs(df: DataFrame, layout: Layout, margin: float) -> DataFrame:
    """Number the rows of each window group from its end (``_at``) and mark the runs to repair.

    A reading is settled when nothing that follows it, up to a missing one, is lower by more than the
    margin: it is never lowered, and hides what follows from the readings before. The others
    form runs that end at a settled one, whose number is ``_close``. ``_gaps`` counts missing readings from here to
    the end, ``_ahead`` is the lowest reading that follows.
    """
    back = Window.partitionBy(*layout.keys).orderBy(*[F.col(c).desc() for c in layout.order])
    here = back.rowsBetween(Window.unboundedPreceding, 0)
    energy = F.col("energy")
    df = df.withColumns({"_at": F.row_number().over(back), "_gaps": F.count(F.when(energy.isNull(), 1)).over(here)})
    # The least of (-gaps, energy) is the lowest reading behind the latest gap.
    reading = F.when(energy.isNotNull(), F.struct((-F.col("_gaps")).alias("s"), energy.alias("e")))
    df = df.withColumn("_ahead", F.min(reading).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    ahead = F.when(F.col("_ahead")["s"] == -F.col("_gaps"), F.col("_ahead")["e"])
    df = df.withColumn("_ahead", ahead)
    settled = F.coalesce(energy <= F.col("_ahead") + margin, F.lit(True))
    return df.withColumn("_close", F.max(F.when(settled, F.col("_at"))).over(here))


def _repair(df: DataFrame, layout: Layout, margin: float, rounds: int) -> DataFrame:
    """``rounds`` rounds in one pass over a bounded look-ahead.

    A round lowers a value to its successor when it exceeds it by more than ``margin``. After
    ``rounds`` rounds a value is a right-to-left fold over itself and ``rounds`` successors, none of
    them beyond the end of its run. Runs are single rows except around spikes, so the fold
    touches few rows.
    """
    df = _with_runs(df, layout, margin)
    run = Window.partitionBy(*layout.keys, "_close").orderBy("_at")
    values = F.collect_list(F.struct("energy")).over(run.rowsBetween(-rounds, 0))
    in_run = F.col("_at") > F.col("_close")
    df = df.withColumn("_values", F.when(in_run, values))

    def lower(later: Column, entry: Column) -> Column:
        return F.when(entry["energy"] > later + margin, later).otherwise(entry["energy"])

    values = F.col("_values")
    folded = F.aggregate(F.slice(values, 2, rounds), values[0]["energy"], lower)
    return df.withColumn("energy", F.when(in_run, folded).otherwise(F.col("energy"))).drop(
        "_at", "_gaps", "_ahead", "_close", "_values"
    )


#: Rows of a run that are folded at once; a run of up to BLOCK ** 3 rows takes three levels.
BLOCK = 200


def _after(state: Column, step: Column, margin: float) -> Column:
    """Two stretches of rows as one, ``state`` being the later one.

    What a stretch makes of the value that follows it is always of one kind: values that its lowest
    reading ``lo`` exceeds by more than the margin come through, all others (and none) give
    ``c``. So two numbers stand for a stretch of any length. A null ``lo`` lets every value through.
    """
    through = step["lo"] > state["c"] + F.lit(margin)
    lower = state["lo"].isNull() | (step["lo"] < state["lo"])
    value = F.when(lower, step["c"]).when(through, state["c"]).otherwise(step["c"])
    return F.struct(F.when(lower, step["lo"]).otherwise(state["lo"]).alias("lo"), value.alias("c"))


_NO_ROWS = "named_struct('lo', CAST(NULL AS DOUBLE), 'c', CAST(NULL AS DOUBLE))"


def _repair_fully(df: DataFrame, layout: Layout, margin: float, longest: int) -> DataFrame:
    """All rounds there can be, for the rows of each window group by itself.

    A run's readings take the value that a fold from its end to the left gives. Runs are folded in blocks, blocks of blocks and so on, each level
    by one window over the same sort, so the plan does not depend on how long spikes are. Adds
    ``_low``, the lowest reading from here to the group's end, null where a missing one lies in between.
    """
    df, energy = _with_runs(df, layout, margin), F.col("energy")
    levels = 1
    while BLOCK**levels < longest:
        levels += 1
    place = F.col("_at") - F.col("_close")
    blocks = {f"_b{k}": F.floor(place / F.lit(BLOCK**k)) for k in range(1, levels)}
    df = df.withColumns(blocks)
    names = [*reversed(blocks)]
    fold = F.lit(None)
    for level in range(levels):
        # All levels are sorted alike: by block of the highest level first, then down to the row.
        inner = names[len(names) - level :]
        window = Window.partitionBy(*layout.keys, "_close", *names[: len(names) - level]).orderBy(*inner, "_at")
        if level == 0:
            steps = F.collect_list(F.struct(energy.alias("lo"), energy.alias("c"))).over(
                window.rowsBetween(Window.unboundedPreceding, 0)
            )
        else:
            ends = F.pmod(place + 1, F.lit(BLOCK**level)) == 0
            steps = F.collect_list(F.when(ends, F.col("_fold"))).over(window.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("_steps", steps)
        whole = F.aggregate("_steps", F.expr(_NO_ROWS), lambda state, step: _after(state, step, margin))
        fold = whole if level == 0 else _after(whole, F.col("_fold"), margin)
        df = df.withColumn("_fold", fold)
    low = F.when(F.col("_gaps") == 0, F.least(energy, F.col("_ahead")))
    return df.withColumns({"_low": low, "energy": F.when(energy.isNotNull(), F.col("_fold")["c"])}).drop(
        "_gaps", "_ahead", "_close", "_steps", "_fold", *blocks
    )


def _repair_strips(df: DataFrame, layout: Layout, margin: float) -> DataFrame:
    """The same for meters cut into strips: each strip by itself, then by what follows it.

    One row per strip says what the strip makes of a value that follows; these rows are scanned from the
    right. A reading then takes the value that comes in at its strip's end if that gets through to it.
    """
    df = pin(_repair_fully(df, layout, margin, layout.strip_rows))
    strips = df.groupBy(*layout.keys).agg(
        F.max_by(F.struct(F.col("_low").alias("lo"), F.col("energy").alias("c")), "_at").alias("_step")
    )
    later = Window.partitionBy(*layout.group).orderBy(F.col(STRIP).desc()).rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.withColumn("_steps", F.collect_list("_step").over(later))

    def through(value: Column, step: Column) -> Column:
        return F.when(step["lo"] > value + F.lit(margin), value).otherwise(step["c"])

    coming = F.aggregate("_steps", F.lit(None).cast("double"), through)
    carried = strips.select(*layout.keys, coming.alias("_coming"))
    df = df.join(carried, layout.keys, "left")
    lowered = F.col("_low") > F.col("_coming") + F.lit(margin)
    return df.withColumn("energy", F.when(lowered, F.col("_coming")).otherwise(F.col("energy"))).drop(
        "_at", "_low", "_coming"
    )


def despike_frame(frame: Frame, params: Params, profile: Profile) -> Frame:
    rounds, margin = params.spike_rounds, params.min_size_of_spikes
    if margin < 0:
        raise ValueError("min_size_of_spikes must not be negative")

    def work(df: DataFrame, layout: Layout) -> DataFrame:
        if not profile.spikes_to_fixpoint:
            return layout.neighbours(df, 0, rounds, lambda rows: _repair(rows, layout, margin, rounds))
        if layout.striped:
            return _repair_strips(df, layout, margin)
        return _repair_fully(df, layout, margin, frame.scale.hot_meter_rows).drop("_at", "_low")

    return frame.map(work)


def remove_spikes(
    df: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Lower spikes above ``min_size_of_spikes`` kWh to the reading that follows them."""
    require(df, METER, "timestamp", "id", "energy")
    return despike_frame(Frame.split(df, scale), params, profile).union()
