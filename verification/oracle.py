"""DuckDB SQL for every query, written as frame-wide window steps.

The text is assembled from named common table expressions. Where a profile lets values run on
from one meter to the next, the windows here simply span the whole frame.
"""

from __future__ import annotations

from meterline.params import DOCUMENTED, EFFECTIVE, Params, Profile
from meterline.plans.pipelines import DEFINITION_PARAMS, DEFINITION_PROFILE

RAW_ORDER = ["timestamp", "id"]
END_ORDER = ["timestamp", "end_added", "end_source", "id"]
BOTH_ORDER = ["timestamp", "start_added", "start_source", "end_added", "end_source", "id"]
START_ORDER = ["timestamp", "start_added", "start_source", "id"]


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def fixed(column: str) -> str:
    """Six decimals; the bias keeps exact halves away from the rounding edge."""
    return f"floor({column} * 1000000 + 0.501::DOUBLE) / 1000000"


def micros(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b})"


def plus(ts: str, us: str) -> str:
    return f"({ts} + to_microseconds({us}))"


class Query:
    """A chain of common table expressions over readings."""

    def __init__(self, params: Params = Params(), profile: Profile = EFFECTIVE):
        self.ctes: list[tuple[str, str]] = []
        self.p, self.q = params, profile
        self.order = list(RAW_ORDER)

    @property
    def last(self) -> str:
        return self.ctes[-1][0]

    def step(self, select: str, source: str | None = None, window: str = "") -> Query:
        name = f"t{len(self.ctes)}"
        body = select if source == "" else f"SELECT {select} FROM {source or self.last} {window}"
        self.ctes.append((name, body))
        return self

    def windows(self) -> str:
        rows = ", ".join(self.order)
        return (
            f"WINDOW f AS (ORDER BY meter_number, {rows}), "
            f"m AS (PARTITION BY meter_number ORDER BY {rows}), "
            f"fr AS (ORDER BY meter_number, {rows} ROWS UNBOUNDED PRECEDING), "
            f"mr AS (PARTITION BY meter_number ORDER BY {rows} ROWS UNBOUNDED PRECEDING)"
        )

    def add(self, **columns: str) -> Query:
        """New columns from the last step; existing ones are replaced."""
        return self.step(
            "*, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()), window=self.windows()
        )

    def change(self, **columns: str) -> Query:
        inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
        return self.step(f"* REPLACE ({inner})", window=self.windows())

    def select(self, columns: str, tail: str = "") -> str:
        with_ = ",\n".join(f"{n} AS ({b})" for n, b in self.ctes)
        return f"WITH {with_}\nSELECT {columns} FROM {self.last} {tail}".strip()

    # -- steps ---------------------------------------------------------------------------------

    def readings(self, whole_seconds: bool = False, compress: int = 100) -> Query:
        offset = f"date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // {compress}"
        if whole_seconds:
            offset = f"(({offset}) // 1000000) * 1000000"
        self.step(f"user_id AS meter_number, event_id AS id, event_type, value, {offset} AS off_us",
                  "events")
        self.step(
            "meter_number, id, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(off_us) AS timestamp, "
            "CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value / 5) AS BIGINT) * 5 END AS wh, "
            "CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE floor(value) / 200 END AS power, "
            "CASE WHEN id % 97 = 0 THEN 5000 ELSE 0 END AS spike_wh, "
            "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(230 + id % 7 AS DOUBLE) END AS voltage"
        )
        return self.step(
            "meter_number, id, timestamp, 'UTC+03:00' AS timezone, "
            "CAST(sum(wh) OVER (PARTITION BY meter_number ORDER BY timestamp, id "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + spike_wh AS DOUBLE) / 1000 AS energy, "
            "power, voltage, power * 1000 / voltage AS current"
        )

    def despike(self) -> Query:
        reach = "UNBOUNDED" if self.q.spikes_to_fixpoint else str(self.p.spike_rounds)
        self.step(
            "*, list(energy) OVER (PARTITION BY meter_number ORDER BY timestamp, id "
            f"ROWS BETWEEN CURRENT ROW AND {reach} FOLLOWING) AS ahead"
        )
        margin = d(self.p.min_size_of_spikes)
        return self.step(
            "* EXCLUDE (ahead) REPLACE (CASE WHEN meter_number IS NULL THEN energy ELSE list_reduce(list_reverse(ahead), "
            f"lambda acc, x: CASE WHEN x > acc + {margin} THEN acc ELSE x END) END AS energy)"
        )

    def long_spikes(self) -> Query:
        """Three long meters, and a counter that is 20 kWh too high during every fourth half hour."""
        high = "date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', timestamp) // 30 % 4 = 1"
        return self.change(
            meter_number="meter_number % 3", energy=f"energy + CASE WHEN {high} THEN 20::DOUBLE ELSE 0::DOUBLE END"
        )

    def replays(self) -> Query:
        """Two hours in eight of each meter are sent again, 125 minutes late, with new ids."""
        again = "(meter_number + date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', timestamp) // 2) % 4 = 0"
        late = "id + 100000000 AS id, timestamp + INTERVAL 125 MINUTE AS timestamp"
        base = self.last
        return self.step(
            f"SELECT * FROM {base} UNION ALL SELECT * REPLACE ({late}) FROM {base} WHERE {again}", ""
        )

    def sent_twice(self) -> Query:
        """Every tenth reading arrives twice, equal in all columns."""
        base = self.last
        self.order.append("twin")
        return self.step(
            f"SELECT *, 0 AS twin FROM {base} UNION ALL SELECT *, 1 AS twin FROM {base} WHERE id % 10 = 0", ""
        )

    def lose_meters(self) -> Query:
        """Every fiftieth reading without its meter number; such readings come last."""
        return self.change(meter_number="CASE WHEN id % 50 = 0 THEN NULL ELSE meter_number END")

    def zone(self) -> Query:
        shifted = "timestamp + INTERVAL 3 HOUR"
        if self.q.zone_match == "always":
            return self.change(timestamp=shifted, timezone="'UTC+03:00'")
        if self.q.zone_match == "regex":
            hit = "regexp_matches(timezone, 'UTC+00:00')"
        else:
            hit = "contains(timezone, 'UTC+00:00')"
        flag = f"(SELECT coalesce(bool_or({hit}), false) FROM {self.last})"
        return self.change(
            timestamp=f"CASE WHEN {flag} THEN {shifted} ELSE timestamp END",
            timezone=f"CASE WHEN {flag} THEN 'UTC+03:00' ELSE timezone END",
        )

    def loads(self, second: bool = False) -> Query:
        p, q = self.p, self.q
        et, pt = d(p.energy_threshold), d(p.power_threshold)
        if second:
            stale = "load_count, timestamp_load, cooking_start, cooking_end, cooking_event, time_start, " \
                "time_end, energy_start, energy_end, cooking_time, seq_time"
            if not q.keep_stale_columns:
                stale += ", load, diff_prev_timestamp, diff_next_timestamp"
            self.step(f"* EXCLUDE ({stale})")
        self.add(
            has_prev="coalesce(lag(meter_number) OVER f = meter_number, false)",
            has_next="coalesce(lead(meter_number) OVER f = meter_number, false)",
            frame_first="row_number() OVER f = 1",
            frame_last="lead(meter_number) OVER f IS NULL",
            de="energy - lag(energy) OVER f",
            p_power="lag(power) OVER f",
            n_energy="lead(energy) OVER f",
            p_ts="lag(timestamp) OVER f",
            n_ts="lead(timestamp) OVER f",
        )
        if not q.diff_crosses_meters:
            self.change(de="CASE WHEN has_prev THEN de END")
        keep = second and q.keep_stale_columns
        prev_mask = "has_next" if q.prev_diff_needs_next_row else "has_prev"
        fresh = {
            "load": (f"(de > {et} OR power > {pt}) AND has_prev", "de"),
            "diff_prev_timestamp": (prev_mask, micros("p_ts", "timestamp")),
            "diff_next_timestamp": ("has_next", micros("timestamp", "n_ts")),
        }
        columns = {
            n: f"CASE WHEN {mask} THEN {value} {'ELSE ' + n if keep else ''} END"
            for n, (mask, value) in fresh.items()
        }
        (self.change if keep else self.add)(**columns)
        over, first = ("fr", "frame_first") if q.loads_cross_meters else ("mr", "NOT has_prev")
        self.add(
            load_count=f"CAST(sum(CASE WHEN load IS NULL THEN 0 ELSE 1 END) OVER {over} AS BIGINT)",
            timestamp_load=f"last_value(CASE WHEN load IS NOT NULL OR {first} THEN timestamp END "
            f"IGNORE NULLS) OVER {over}",
        )
        return self.add(p_tl="lag(timestamp_load) OVER " + ("f" if q.loads_cross_meters else "m"))

    def rules(self) -> Query:
        p, q = self.p, self.q
        et, pt = d(p.energy_threshold), d(p.power_threshold)
        limit = p.t_between * 60_000_000
        load_limit = (p.t_between + p.time_resolution) * 60_000_000
        since, since_prev = micros("timestamp_load", "timestamp"), micros("p_tl", "timestamp")
        dp, dn = "diff_prev_timestamp", "diff_next_timestamp"
        self.add(s=f"coalesce(({since_prev} > {limit} AND de >= {et}), false) OR NOT has_prev")
        self.change(s=f"CASE WHEN de >= {et} AND {dp} < {limit} THEN false ELSE s END")
        self.change(
            s=f"CASE WHEN {micros('p_tl', 'timestamp_load')} > {load_limit} AND power >= {pt} "
            "THEN true ELSE s END"
        )
        idle = f"({since} > {limit} AND power < {pt} AND p_power < {pt} AND has_prev)"
        same = " OR energy - n_energy = 0" if q.equal_energy_ends else ""
        if not q.diff_crosses_meters and same:
            same += " AND has_next"
        self.add(e=f"coalesce({idle}{same}, false)")
        self.change(s=f"CASE WHEN {since} > {limit} AND power >= {pt} THEN true ELSE s END")
        closes = "NOT has_next" + (" AND NOT frame_last" if q.last_frame_row_stays_open else "")
        self.change(e=f"e OR coalesce(lead(s) OVER f, false) OR ({closes})")
        self.change(e=f"e OR coalesce(lead(e) OVER f AND {dn} > {limit}, false)")
        self.change(s="s OR coalesce(lag(e) OVER f AND e, false)")
        self.change(
            s=f"s AND NOT coalesce(lag(s) OVER f AND s AND {dp} <= {limit} AND {dn} > {limit}, false)"
        )
        self.change(
            e=f"e AND NOT coalesce(lag(e) OVER f AND e AND {dp} > {limit} AND {dn} <= {limit}, false)"
        )
        self.change(
            s=f"s AND NOT coalesce(lag(s) OVER f AND s AND {dp} < {limit} AND p_power >= {pt}, false)"
        )
        self.change(
            e="e OR coalesce(lead(e) OVER f = false AND lag(e) OVER f = false "
            f"AND {dn} > {limit}, false)"
        )
        start = "s OR NOT has_prev" if q.force_start_at_meter else "s"
        return self.add(cooking_start=start, cooking_end="e AND has_prev")

    def events(self) -> Query:
        """Numbers, bounds, durations and disqualification."""
        p, q = self.p, self.q
        rows = ", ".join(["meter_number", *self.order])
        low, weak = d(p.min_cooking_event), d(p.power_mean_min)
        self.add(ev="CAST(sum(cooking_start::INT) OVER fr AS BIGINT)")
        self.add(rn="row_number() OVER f")
        flagged = "timestamp IS NOT NULL AND cooking_end"
        group = (
            f"ev, arg_min(timestamp, rn) AS first_ts, arg_max(timestamp, rn) AS last_ts, "
            "arg_min(energy, rn) FILTER (energy IS NOT NULL) AS first_e, "
            "arg_max(energy, rn) FILTER (energy IS NOT NULL) AS last_e, "
            "bool_or(cooking_end) AS flagged, "
            f"arg_min(timestamp, rn) FILTER ({flagged}) AS flag_ts, "
            "arg_min(energy, rn) FILTER (energy IS NOT NULL AND cooking_end) AS flag_e"
        )
        base = self.last
        self.step(f"SELECT {group} FROM {base} GROUP BY ev", "")
        bounds = self.last
        if q.end_at_last_row:
            end_ts, end_e = "last_ts", "last_e"
        else:
            end_ts = "CASE WHEN flagged THEN flag_ts ELSE last_ts END"
            end_e = "CASE WHEN flagged THEN flag_e ELSE last_e END"
        self.step(
            f"SELECT a.*, first_ts AS time_start, first_e AS energy_start, {end_ts} AS time_end, "
            f"{end_e} AS energy_end FROM {base} a JOIN {bounds} b USING (ev)",
            "",
        )
        self.add(cooking_event="CASE WHEN timestamp > time_end THEN NULL ELSE ev END")
        self.change(time_start="CASE WHEN timestamp > time_end THEN NULL ELSE time_start END")
        self.add(
            cooking_time=f"{micros('time_start', 'time_end')} / 6e7",
            seq_time=f"{micros('time_start', 'timestamp')} / 6e7",
        )
        single = (
            "cooking_event IS NOT NULL AND coalesce(cooking_event <> lag(cooking_event) OVER f, true) "
            "AND coalesce(cooking_event <> lead(cooking_event) OVER f, true) "
            f"AND de < {low}"
        )
        self.change(cooking_event=f"CASE WHEN {single} THEN NULL ELSE cooking_event END")
        gain = "(energy_end - energy_start)"
        self.change(
            cooking_event=f"CASE WHEN {gain} < {low} OR (cooking_time <> 0 AND "
            f"{gain} / (cooking_time / 60) < {weak}) THEN NULL ELSE cooking_event END"
        )
        self.change(
            cooking_time="CASE WHEN cooking_event IS NOT NULL THEN cooking_time END",
            seq_time="CASE WHEN cooking_event IS NOT NULL THEN seq_time END",
        )
        return self.step(
            "* EXCLUDE (has_prev, has_next, frame_first, frame_last, de, p_power, n_energy, p_ts, "
            "n_ts, p_tl, s, e, ev, rn)"
        )

    def sessions(self, second: bool = False) -> Query:
        return self.loads(second).rules().events()

    def flag_duplicates(self) -> Query:
        self.add(rn="row_number() OVER f")
        base = self.last
        margin = d(self.p.error_margin)

        def edges(pick: str) -> str:
            return (
                "SELECT cooking_event AS ev, arg_max(hit, edge) AS hit FROM (SELECT *, "
                f"coalesce(energy - {margin} <= lag(energy) OVER (ORDER BY edge) "
                "AND meter_number = lag(meter_number) OVER (ORDER BY edge), false) AS hit FROM ("
                f"SELECT meter_number, cooking_event, {pick}(rn) AS edge, arg_{pick}(energy, rn) AS energy "
                f"FROM {base} WHERE cooking_event IS NOT NULL GROUP BY ALL)) GROUP BY 1"
            )

        self.step(edges("max"), "")
        last = self.last
        hit = "l.hit"
        join = f"LEFT JOIN {last} l ON a.cooking_event = l.ev"
        if not self.q.check_last_rows_only:
            self.step(edges("min"), "")
            join += f" LEFT JOIN {self.last} b ON a.cooking_event = b.ev"
            hit = "(l.hit OR b.hit)"
        return self.step(
            f"SELECT a.* EXCLUDE (rn), CASE WHEN {hit} THEN true END AS timestamp_issue "
            f"FROM {base} a {join}",
            "",
        )

    def drop_duplicates(self) -> Query:
        if self.q.drop_by_timestamp:
            base = self.last
            return self.step(
                f"SELECT * FROM {base} WHERE timestamp NOT IN "
                f"(SELECT timestamp FROM {base} WHERE timestamp_issue)",
                "",
            )
        return self.step(f"SELECT * FROM {self.last} WHERE timestamp_issue IS NULL", "")

    def _extend(self, name: str, added: str, source: str, values: dict[str, str],
                bounds: list[str], forward: bool, new_order: list[str]) -> Query:
        move = "lead" if forward else "lag"
        self.add(
            beside=f"{move}(meter_number) OVER f",
            beside_event=f"{move}(cooking_event) OVER f",
            step=f"{move}(energy) OVER f - energy" if forward else "energy - lag(energy) OVER f",
            rn="row_number() OVER f",
        )
        self.add(
            **{
                name: "CASE WHEN cooking_event IS NOT NULL AND "
                "coalesce(cooking_event <> beside_event, true) "
                "AND beside = meter_number THEN step END"
            }
        )
        self.add(minutes=f"{name} / {d(self.p.power_capacity)} * 60")
        base = self.last
        replaced = ", ".join(f"{v} AS {c}" for c, v in values.items())
        if self.q.notebook_mask_order:
            r = self.p.time_resolution
            rest = f"CASE WHEN minutes > {r} THEN minutes - {r} WHEN minutes > 0 THEN 0 END"
            extra_old, extra_new = ", CAST(NULL AS DOUBLE) AS energy_gap_time", f", {rest} AS energy_gap_time"
            if "energy_gap_time" in self.known:
                extra_old = ""
                extra_new = ""
                replaced += f", {rest} AS energy_gap_time"
            self.known.add("energy_gap_time")
        else:
            extra_old = extra_new = ""
            replaced += f", NULL AS {name}"
        self.step(
            f"SELECT *, 0 AS {added}, CAST(NULL AS TIMESTAMP) AS {source}{extra_old} FROM {base} UNION ALL "
            f"SELECT * REPLACE ({replaced}), 1, timestamp{extra_new} FROM {base} "
            f"WHERE {name} > {d(self.q.min_gap)}",
            "",
        )
        rows = self.last
        picks = ", ".join(f"arg_max(struct_pack(v := {b}), rn) AS new_{b}" for b in bounds)
        self.step(
            f"SELECT cooking_event AS ev, {picks} FROM {rows} WHERE {added} = 1 GROUP BY 1", ""
        )
        new = self.last
        adopt = ", ".join(
            (f"new_{b}.v AS {b}" if self.q.forget_unextended else f"coalesce(new_{b}.v, a.{b}) AS {b}")
            for b in bounds
        )
        self.step(
            f"SELECT a.* EXCLUDE (beside, beside_event, step, rn, minutes) REPLACE ({adopt}) "
            f"FROM {rows} a LEFT JOIN {new} n ON a.cooking_event = n.ev",
            "",
        )
        self.order = new_order
        return self

    known: set = set()

    def extend_ending(self) -> Query:
        p, q = self.p, self.q
        self.known = set()
        r = p.time_resolution
        step = d(r / 60 * (1 if q.fixed_extension_energy else p.power_capacity))
        span = "CAST(trunc(minutes * 60.0::DOUBLE * 1e6) AS BIGINT)"
        r_us = r * 60_000_000
        large = f"minutes > {r}"
        updated = f"minutes - {r} > {r}" if q.notebook_mask_order else large

        def pick(c: str, small: str, big: str, mask: str = large) -> str:
            return f"CASE WHEN minutes <= {r} THEN {small} WHEN {mask} THEN {big} ELSE {c} END"

        sign = "-" if q.large_end_gap_lowers_energy_end else "+"
        values = {
            "timestamp": pick("timestamp", plus("timestamp", span), plus("timestamp", str(r_us))),
            "time_end": pick("time_end", plus("time_end", span), plus("time_end", str(r_us))),
            "cooking_time": pick("cooking_time", "cooking_time + minutes", f"cooking_time + {d(r)}"),
            "seq_time": pick("seq_time", "seq_time + minutes", f"seq_time + {d(r)}"),
            "energy": pick("energy", "energy + energy_gap_to_next", f"energy + {step}", updated),
            "energy_end": pick(
                "energy_end", "energy_end + energy_gap_to_next", f"energy_end {sign} {step}", updated
            ),
        }
        return self._extend(
            "energy_gap_to_next", "end_added", "end_source", values,
            ["time_end", "cooking_time", "energy_end"], True, END_ORDER,
        )

    def extend_beginning(self) -> Query:
        p, q = self.p, self.q
        r = p.time_resolution
        fixed_step = 5 if q.fixed_extension_energy else r
        step = d(fixed_step / 60 * (1 if q.fixed_extension_energy else p.power_capacity))
        span = "CAST(trunc(minutes * 60.0::DOUBLE * 1e6) AS BIGINT)"
        s_us = fixed_step * 60_000_000
        large = f"minutes > {r}"
        updated = f"minutes - {fixed_step} > {fixed_step}" if q.notebook_mask_order else large

        def pick(c: str, small: str, big: str, mask: str = large) -> str:
            return f"CASE WHEN minutes <= {r} THEN {small} WHEN {mask} THEN {big} ELSE {c} END"

        def earlier(c: str) -> str:
            if q.shift_small_start_gaps:
                return pick(c, plus(c, f"-{span} - {s_us}"), c)
            return pick(c, plus(c, f"-{span}"), plus(c, f"-{s_us}"))

        values = {
            "timestamp": earlier("timestamp"),
            "time_start": earlier("time_start"),
            "cooking_time": pick("cooking_time", "cooking_time + minutes", f"cooking_time + {d(fixed_step)}"),
            "seq_time": pick("seq_time", "seq_time - minutes", f"seq_time - {d(fixed_step)}"),
            "energy": pick("energy", "energy - energy_gap_to_prev", f"energy - {step}", updated),
            "energy_start": pick(
                "energy_start", "energy_start - energy_gap_to_prev", f"energy_start - {step}", updated
            ),
        }
        order = BOTH_ORDER if self.order == END_ORDER else START_ORDER
        return self._extend(
            "energy_gap_to_prev", "start_added", "start_source", values,
            ["time_start", "cooking_time", "energy_start"], False, order,
        )

    def event_table(self) -> Query:
        count = "count(voltage)" if self.q.count_voltages else "count(*)"
        self.step(
            "SELECT meter_number, cooking_event, max(energy) AS energy, "
            "max(energy) - min(energy) AS energy_gen, avg(power) AS power, "
            "max(cooking_time) AS cooking_time, min(timestamp) AS timestamp, avg(current) AS current, "
            f"{count} AS no_recordings, avg(id) AS id FROM {self.last} "
            "WHERE cooking_event IS NOT NULL GROUP BY 1, 2",
            "",
        )
        self.step(
            "SELECT *, CASE WHEN cooking_time <> 0 THEN energy_gen / (cooking_time / 60) END "
            f"AS power_mean, energy_gen * {d(self.p.tzs_per_kwh)} AS cooking_cost, "
            "CASE WHEN cooking_event IS DISTINCT FROM lag(cooking_event) "
            f"OVER (ORDER BY meter_number, cooking_event) THEN 1 ELSE 0 END AS changed FROM {self.last}",
            "",
        )
        return self.step(
            "SELECT * EXCLUDE (changed), CAST(sum(changed) OVER (ORDER BY meter_number, cooking_event "
            f"ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_count FROM {self.last}",
            "",
        )

    def period(self, start: str, end: str) -> Query:
        nulls = " OR timestamp IS NULL" if self.q.keep_null_timestamps else ""
        return self.step(
            f"SELECT * FROM {self.last} WHERE (timestamp >= TIMESTAMP '{start} 00:00:00' "
            f"AND timestamp < TIMESTAMP '{end} 00:00:00'){nulls}",
            "",
        )


# -- column lists shared with the Spark side ---------------------------------------------------

DOUBLES = (
    "energy power voltage current load energy_start energy_end cooking_time seq_time "
    "energy_gap_to_next energy_gap_to_prev energy_gap_time gaps_to_next_server_issue energy_gen "
    "power_mean cooking_cost id_mean energy_gap_total"
).split()

RAW_COLUMNS = "meter_number id timestamp timezone energy power voltage current".split()
FLAG_COLUMNS = (
    "meter_number id timestamp load load_count timestamp_load diff_prev_timestamp "
    "diff_next_timestamp cooking_start cooking_end"
).split()
SESSION_COLUMNS = (
    "meter_number id timestamp energy power load load_count timestamp_load diff_prev_timestamp "
    "diff_next_timestamp cooking_start cooking_end cooking_event time_start time_end energy_start "
    "energy_end cooking_time seq_time"
).split()
END_COLUMNS = SESSION_COLUMNS + ["energy_gap_to_next", "end_added"]
BOTH_COLUMNS = END_COLUMNS + ["energy_gap_to_prev", "start_added"]
EVENT_COLUMNS = (
    "meter_number cooking_event energy energy_gen power cooking_time timestamp current no_recordings "
    "id_mean power_mean cooking_cost event_count"
).split()


def shown(columns: list[str]) -> str:
    out = []
    for c in columns:
        source = "id" if c == "id_mean" else c
        out.append(f"{fixed(source)} AS {c}" if c in DOUBLES else (c if c == source else f"{source} AS {c}"))
    return ", ".join(out)


def base(profile: Profile = EFFECTIVE, params: Params = Params(), **kw) -> Query:
    return Query(params, profile).readings(**kw)


def clean(profile: Profile = EFFECTIVE, params: Params = Params(), **kw) -> Query:
    return base(profile, params, **kw).despike().zone()


def extended(profile: Profile = EFFECTIVE, **kw) -> Query:
    q = clean(profile, **kw).sessions().flag_duplicates().drop_duplicates()
    return q.extend_ending().extend_beginning()


__all__ = ["DOCUMENTED", "DEFINITION_PARAMS", "DEFINITION_PROFILE", "Query", "base", "clean", "extended"]
