"""Extension of events by the energy used just outside their recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.exprs import MINUTE_US, add_micros, is_true, minutes_to_micros, ne
from meterline.operators.sessions import event_group
from meterline.operators.timeline import Frame, Layout
from meterline.params import EFFECTIVE, Params, Profile, Scale
from meterline.schema import EVENT, METER, TS, require


def add_gap(df: DataFrame, layout: Layout, name: str, forward: bool) -> DataFrame:
    """Energy between an event's boundary row and the neighbouring row of the same meter."""

    def work(rows: DataFrame) -> DataFrame:
        def beside(c: str) -> Column:
            return (F.lead(c) if forward else F.lag(c)).over(layout.window)

        boundary = (
            F.col(EVENT).isNotNull()
            & ne(F.col(EVENT), beside(EVENT))
            & is_true(F.col(METER) == beside(METER))
        )
        step = beside("energy") - F.col("energy")
        return rows.withColumn(name, F.when(boundary, step if forward else -step))

    return layout.neighbours(df, 0 if forward else 1, 1 if forward else 0, work)


def _split(gap: Column, params: Params) -> tuple[Column, Column, Column]:
    """Minutes the gap takes at full power, and whether it fits one recording interval."""
    minutes = gap / F.lit(float(params.power_capacity)) * F.lit(60)
    return minutes, (minutes <= params.time_resolution) & (minutes > 0), (
        minutes > params.time_resolution
    )


def _energy_rows(minutes: Column, large: Column, limit: float, profile: Profile) -> Column:
    """Large gaps whose energy is updated.

    The notebook variant first takes the covered interval off the gap and then asks again whether
    it is large, so gaps of up to two intervals keep their energy.
    """
    return large & (minutes - limit > limit) if profile.notebook_mask_order else large


def _double_rows(df: DataFrame, extended: Column, added: str, source: str) -> DataFrame:
    """Every row once, plus a second copy of rows to extend; the copy is marked ``added``.

    Exploding keeps the partitioning, where a union with a filtered copy would not.
    """
    copies = F.when(extended, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.drop(added, source).withColumn(added, F.explode(copies)).withColumn(
        source, F.when(F.col(added) == 1, F.col(TS))
    )


def _settle_gap(
    df: DataFrame, name: str, new: Column, params: Params, profile: Profile
) -> DataFrame:
    """Added rows carry no gap, except in the notebook variant, which keeps what is left of it."""
    if not profile.notebook_mask_order:
        return df.withColumn(name, F.when(~new, F.col(name)))
    rest = residual_minutes(F.col(name), params)
    kept = F.col("energy_gap_time") if "energy_gap_time" in df.columns else F.lit(None)
    return df.withColumn("energy_gap_time", F.when(new, rest).otherwise(kept))


def residual_minutes(gap: Column, params: Params = Params()) -> Column:
    """Minutes of full power a gap holds beyond the one interval an extension may cover."""
    minutes, small, large = _split(gap, params)
    return F.when(large, minutes - params.time_resolution).when(small, F.lit(0.0))


def _adopt(
    df: DataFrame, layout: Layout, added: str, columns: list[str], profile: Profile
) -> DataFrame:
    """Give all rows of an event the bounds of its added row; the latest added row wins."""
    new = F.col(added) == 1
    found = {
        f"_new_{c}": F.when(
            new, F.struct(F.col("_seq"), F.col(c).alias("v"))
        )
        for c in columns
    }
    df = layout.per_event(df, event_group(df), largest=found)
    for c in columns:
        value = F.when(F.col(EVENT).isNotNull(), F.col(f"_new_{c}")["v"])
        kept = value if profile.forget_unextended else F.coalesce(value, F.col(c))
        df = df.withColumn(c, kept)
    return df.drop(*found)


def extend_ending_frame(frame: Frame, params: Params, profile: Profile) -> Frame:
    resolution = params.time_resolution
    energy_step = resolution / 60 * (1 if profile.fixed_extension_energy else params.power_capacity)

    def work(df: DataFrame, layout: Layout) -> DataFrame:
        df = add_gap(df, layout, "energy_gap_to_next", forward=True)
        gap = F.col("energy_gap_to_next")
        df = df.withColumn("_seq", layout.key)
        df = _double_rows(df, gap > profile.min_gap, "end_added", "end_source")
        new = F.col("end_added") == 1
        minutes, small, large = _split(gap, params)
        small, large = new & small, new & large

        updated = _energy_rows(minutes, large, resolution, profile)

        def moved(c: str, by_small: Column, by_large: Column, rows: Column = large) -> Column:
            return F.when(small, by_small).when(rows, by_large).otherwise(F.col(c))

        def later(c: str) -> Column:
            return moved(
                c,
                add_micros(F.col(c), minutes_to_micros(minutes)),
                add_micros(F.col(c), F.lit(resolution * MINUTE_US)),
            )

        def raised(c: str, by: Column, step: float, rows: Column = large) -> Column:
            return moved(c, F.col(c) + by, F.col(c) + F.lit(step), rows)

        end_step = -energy_step if profile.large_end_gap_lowers_energy_end else energy_step
        df = df.withColumns(
            {
                TS: later(TS),
                "time_end": later("time_end"),
                "cooking_time": raised("cooking_time", minutes, float(resolution)),
                "seq_time": raised("seq_time", minutes, float(resolution)),
                "energy": raised("energy", gap, energy_step, updated),
                "energy_end": raised("energy_end", gap, end_step, updated),
            }
        )
        df = _settle_gap(df, "energy_gap_to_next", new, params, profile)
        bounds = ["time_end", "cooking_time", "energy_end"]
        return _adopt(df, layout, "end_added", bounds, profile).drop("_seq")

    return frame.map(work).arrange()


def extend_beginning_frame(frame: Frame, params: Params, profile: Profile) -> Frame:
    # Observed behaviour uses a literal 5 here, whatever the resolution.
    step = 5 if profile.fixed_extension_energy else params.time_resolution
    energy_step = step / 60 * (1 if profile.fixed_extension_energy else params.power_capacity)

    def work(df: DataFrame, layout: Layout) -> DataFrame:
        df = add_gap(df, layout, "energy_gap_to_prev", forward=False)
        gap = F.col("energy_gap_to_prev")
        df = df.withColumn("_seq", layout.key)
        df = _double_rows(df, gap > profile.min_gap, "start_added", "start_source")
        new = F.col("start_added") == 1
        minutes, small, large = _split(gap, params)
        small, large = new & small, new & large
        back = -minutes_to_micros(minutes)
        fixed = F.lit(-step * MINUTE_US)

        def earlier(c: str) -> Column:
            if profile.shift_small_start_gaps:
                return F.when(small, add_micros(F.col(c), back + fixed)).otherwise(F.col(c))
            return (
                F.when(small, add_micros(F.col(c), back))
                .when(large, add_micros(F.col(c), fixed))
                .otherwise(F.col(c))
            )

        updated = _energy_rows(minutes, large, step, profile)

        def changed(c: str, by: Column, by_step: float, rows: Column = large) -> Column:
            return (
                F.when(small, F.col(c) + by)
                .when(rows, F.col(c) + F.lit(by_step))
                .otherwise(F.col(c))
            )

        df = df.withColumns(
            {
                TS: earlier(TS),
                "time_start": earlier("time_start"),
                "cooking_time": changed("cooking_time", minutes, float(step)),
                "seq_time": changed("seq_time", -minutes, -float(step)),
                "energy": changed("energy", -gap, -energy_step, updated),
                "energy_start": changed("energy_start", -gap, -energy_step, updated),
            }
        )
        df = _settle_gap(df, "energy_gap_to_prev", new, params, profile)
        bounds = ["time_start", "cooking_time", "energy_start"]
        return _adopt(df, layout, "start_added", bounds, profile).drop("_seq")

    return frame.map(work).arrange()


def addtoevent_ending(
    df: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Add a row behind each event whose meter counted on before the next reading."""
    require(df, METER, TS, "id", "energy", EVENT, "time_end", "cooking_time", "energy_end")
    return extend_ending_frame(Frame.split(df, scale), params, profile).union()


def addtoevent_beginning(
    df: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Add a row before each event whose meter had counted on since the reading before."""
    require(df, METER, TS, "id", "energy", EVENT, "time_start", "cooking_time", "energy_start")
    return extend_beginning_frame(Frame.split(df, scale), params, profile).union()
