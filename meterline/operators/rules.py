"""Start and end flags of sessions, from each reading and its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.exprs import MINUTE_US, is_true, micros_between
from meterline.operators.timeline import Layout
from meterline.params import Params, Profile
from meterline.schema import METER, TS

REACH = 6  # rows on either side that can influence the flags of a row
START, END = "cooking_start", "cooking_end"


def add_loads(df: DataFrame, layout: Layout, params: Params, profile: Profile) -> DataFrame:
    """Energy and time differences to the neighbours and the load of each reading."""

    def work(rows: DataFrame) -> DataFrame:
        w = layout.window
        rows = rows.withColumns(
            {
                "_has_prev": is_true(F.lag(METER).over(w) == F.col(METER)),
                "_has_next": is_true(F.lead(METER).over(w) == F.col(METER)),
                "_is_last_row": F.lead(METER).over(w).isNull(),
                "_prev_energy": F.lag("energy").over(w),
                "_next_energy": F.lead("energy").over(w),
                "_prev_power": F.lag("power").over(w),
                "_prev_ts": F.lag(TS).over(w),
                "_next_ts": F.lead(TS).over(w),
            }
        )
        gain = F.col("energy") - F.col("_prev_energy")
        loaded = (gain > params.energy_threshold) | (F.col("power") > params.power_threshold)
        prev_known = "_has_next" if profile.prev_diff_needs_next_row else "_has_prev"

        def fresh_or_stale(name: str, known: Column, value: Column) -> Column:
            fresh = F.when(known, value)
            stale = profile.keep_stale_columns and name in rows.columns
            return fresh.otherwise(F.col(name)) if stale else fresh

        return rows.withColumns(
            {
                "_gain": gain,
                "load": fresh_or_stale("load", loaded & F.col("_has_prev"), gain),
                "diff_prev_timestamp": fresh_or_stale(
                    "diff_prev_timestamp",
                    F.col(prev_known),
                    micros_between(F.col("_prev_ts"), F.col(TS)),
                ),
                "diff_next_timestamp": fresh_or_stale(
                    "diff_next_timestamp",
                    F.col("_has_next"),
                    micros_between(F.col(TS), F.col("_next_ts")),
                ),
            }
        ).drop("_prev_energy", "_prev_ts")

    return layout.neighbours(df, 1, 1, work)


def _own_signs(params: Params, profile: Profile) -> dict[str, str]:
    """What a reading says by itself: first guesses of start and end, and its surroundings."""
    limit = params.t_between * MINUTE_US
    pause = f"INTERVAL '{params.t_between}' MINUTE"
    load_pause = f"INTERVAL '{params.t_between + params.time_resolution}' MINUTE"
    powered = f"power >= {params.power_threshold!r}D"
    idle = f"power < {params.power_threshold!r}D"
    gained = f"_gain >= {params.energy_threshold!r}D"
    since_load = "(timestamp - timestamp_load)"
    since_prev_load = "(timestamp - _prev_load_ts)"
    load_step = "(timestamp_load - _prev_load_ts)"
    near = f"diff_prev_timestamp < {limit}"

    # A start after a pause in loads; the later of the conflicting conditions is asked first.
    start = f"""
        CASE WHEN {since_load} > {pause} AND {powered} THEN true
             WHEN {load_step} > {load_pause} AND {powered} THEN true
             WHEN {gained} AND {near} THEN false
             ELSE ({since_prev_load} > {pause} AND {gained}) <=> true OR NOT _has_prev END"""
    end = f"""
        ({since_load} > {pause} AND {idle} AND _prev_power < {params.power_threshold!r}D
         AND _has_prev) <=> true"""
    if profile.equal_energy_ends:
        end += " OR (energy = _next_energy) <=> true"
    closing = "NOT _has_next" + (
        " AND NOT _is_last_meter" if profile.last_frame_row_stays_open else ""
    )
    return {
        "start": start,
        "end": f"{end} OR ({closing})",
        "first": "NOT _has_prev",
        "after_meter": "NOT _has_prev AND _has_prev_meter",
        "near_before": f"({near}) <=> true",
        "within_before": f"(diff_prev_timestamp <= {limit}) <=> true",
        "far_before": f"(diff_prev_timestamp > {limit}) <=> true",
        "within_after": f"(diff_next_timestamp <= {limit}) <=> true",
        "far_after": f"(diff_next_timestamp > {limit}) <=> true",
        "prev_powered": f"(_prev_power >= {params.power_threshold!r}D) <=> true",
    }


def add_flags(df: DataFrame, layout: Layout, params: Params, profile: Profile) -> DataFrame:
    """Start and end flags. Needs the load columns, ``timestamp_load`` and the meter context.

    Each refinement reads its neighbours' flags as the refinement before left them. Together
    they reach no further than a few rows, so one window fetches the signs of all rows in reach
    and the refinements are plain expressions on them.
    """

    def at(name: str, k: int) -> str:
        """Name of a value of the row ``k`` rows ahead."""
        return f"_{name}_{'m' if k < 0 else 'p'}{abs(k)}"

    def sign(name: str, k: int) -> str:
        """A sign of the row ``k`` rows ahead; rows beyond the edge have none."""
        return f"({at('row', k)}.{name} <=> true)"

    def stage(rows: DataFrame, reach: range, **flags) -> DataFrame:
        """Evaluate each flag for all rows in reach of the current one."""
        return rows.selectExpr(
            "*", *[f"{rule(k)} AS {at(name, k)}" for name, rule in flags.items() for k in reach]
        )

    def work(rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in HELPERS]
        signs = [f"{e} AS {n}" for n, e in _own_signs(params, profile).items()]
        rows = rows.selectExpr("*", f"struct({', '.join(signs)}) AS {at('row', 0)}")
        w, own = layout.window, F.col(at("row", 0))
        rows = rows.withColumns(
            {at("row", k): F.lead(own, k).over(w) for k in range(1, 5)}
            | {at("row", -k): F.lag(own, k).over(w) for k in range(1, 5)}
        )

        # An end before the next start, and before an end that comes after a pause.
        rows = stage(
            rows,
            range(-3, 4),
            end1=lambda k: f"{sign('end', k)} OR {sign('start', k + 1)}",
        )
        rows = stage(
            rows,
            range(-3, 3),
            end2=lambda k: f"{at('end1', k)} OR ({at('end1', k + 1)} AND {sign('far_after', k)})",
        )

        # Two ends in a row: the second one is an event of its own ...
        def both(k: int) -> str:
            return f"(({at('end2', k - 1)} OR {sign('after_meter', k)}) AND {at('end2', k)})"

        rows = stage(
            rows,
            range(-2, 3),
            start2=lambda k: f"{sign('start', k)} OR {both(k)}",
            end3=lambda k: f"{at('end2', k)} AND NOT "
            f"({both(k)} AND {sign('far_before', k)} AND {sign('within_after', k)})",
        )
        # ... unless the second of two starts belongs to the first.
        rows = stage(
            rows,
            range(-1, 2),
            start3=lambda k: f"{at('start2', k)} AND NOT "
            f"({at('start2', k - 1)} AND {sign('within_before', k)} AND {sign('far_after', k)})",
        )

        def final(k: int) -> str:
            kept = (
                f"({at('start3', k)} AND NOT ({at('start3', k - 1)} AND {sign('near_before', k)} "
                f"AND {sign('prev_powered', k)}))"
            )
            return f"({kept} OR {sign('first', k)})" if profile.force_start_at_meter else kept

        previous, following = f"{at('row', -1)} IS NOT NULL", f"{at('row', 1)} IS NOT NULL"
        lone_end = (
            f"({previous} AND {following} AND NOT {at('end3', -1)} AND NOT {at('end3', 1)} "
            f"AND {sign('far_after', 0)})"
        )
        return rows.selectExpr(
            *columns,
            f"{final(0)} AS {START}",
            f"({at('end3', 0)} OR {lone_end}) AND NOT {sign('first', 0)} AS {END}",
            f"CASE WHEN {following} THEN {final(1)} END AS _next_start",
        )

    return layout.neighbours(df, REACH, REACH, work)


# Columns that only the flags need.
HELPERS = ("_prev_load_ts", "_prev_power", "_next_energy")
