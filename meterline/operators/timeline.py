"""Ordered work over meter timelines, in tasks of bounded size.

A ``Frame`` holds readings in one or two parts. Ordinary meters form one part that is hash
partitioned by meter: a window per meter is exact and the whole chain of operators shares one
exchange. Meters too long for one task form a second part in which every reading has a dense
position and belongs to a strip of ``strip_rows`` consecutive positions:

* operators that look a bounded number of rows around (``neighbours``) get copies of the rows
  just outside the strip, and the copies are dropped afterwards;
* running values (``running``) are computed per strip and completed from the strips before,
  through a summary of one row per strip;
* values of a whole event (``per_event``) are reduced per strip first, then across strips.

Missing equals nothing, so a reading without a meter number has no neighbours: ordinary parts are grouped by meter
and ``_lone``, which makes each such row a group of its own and spreads them over all tasks.

The row order is total although ids may be missing or repeated: a digest of the whole row orders rows with
equal time and id, and ``_place`` fixes the order of rows that are equal throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from meterline.operators.pinning import pin
from meterline.operators.scan import exclusive_scan
from meterline.params import Scale
from meterline.schema import EVENT, METER, TS

POS = "_pos"
STRIP = "_strip"
LONE = "_lone"  # tells rows without a meter number apart, 0 for all others
PLACE = "_place"  # rises with the row order of the meter; tells rows with equal time and id apart
CONTENT = "_content"  # digest of the whole row, until the place is known
FEW_STRIPS = 1 << 20  # so many strips have their values broadcast
STRIP_BITS = 12  # strips of a stacked frame are scanned in blocks of so many bits
HALF = 33  # monotonically_increasing_id keeps the partition in the bits above this one


def row_order(df: DataFrame) -> list[str]:
    """Columns that order one meter's rows: time, then originals before added rows, then id and place."""
    order = [TS]
    for added, source in (("start_added", "start_source"), ("end_added", "end_source")):
        if added in df.columns:
            order += [added, source]
    return [*order, "id", *[c for c in (CONTENT, PLACE) if c in df.columns]]


def with_content(df: DataFrame) -> DataFrame:
    """Add a digest of the whole row; columns that cannot be hashed (maps, variants) are left out.

    Equal readings may belong to successive events by now, so the event's start and number come first.
    """
    fields = sorted((f for f in df.schema if not re.search("map<|variant", f.dataType.simpleString())), key=lambda f: f.name)
    # A hash skips nulls, so where they are is hashed as well.
    missing = [F.col(f.name).isNull() for f in fields if f.nullable]
    digest = F.xxhash64(*[f.name for f in fields], *missing)
    if not {"time_start", EVENT} <= set(df.columns):
        return df.withColumn(CONTENT, digest)
    # Rows behind an event's end have no start; another event that starts at their time follows them.
    return df.withColumn(CONTENT, F.struct(F.coalesce("time_start", TS).alias("start"), EVENT, digest.alias("digest")))


def with_positions(df: DataFrame, order: list[str], name: str = POS) -> DataFrame:
    """Dense 0-based position of every row in the total order, without a single-task window.

    Range partitioning splits any key, however heavy; the id of a sorted partition plus the
    sizes of the partitions before it give the position. The sizes are one row per partition.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = pin(ordered.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(name), HALF)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    placed = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    local = F.col(name).bitwiseAND(F.lit((1 << HALF) - 1))
    return placed.withColumn(name, local + F.col("_offset")).drop("_part", "_offset")


@dataclass(frozen=True)
class Layout:
    """How one part of a frame is partitioned and ordered."""

    order: tuple[str, ...]
    strip_rows: int | None = None
    stacked: bool = False  # rows see their neighbours across meters
    lone: bool = False  # some rows may lack a meter number
    tasks: int | None = None  # partitions that keep a task small, None where any size does

    @property
    def striped(self) -> bool:
        return self.strip_rows is not None

    @property
    def group(self) -> list[str]:
        """Rows of different groups never see each other."""
        return [] if self.stacked else [METER, LONE] if self.lone else [METER]

    @property
    def keys(self) -> list[str]:
        return [*self.group, STRIP] if self.striped else self.group

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def key(self) -> Column:
        """Comparable position of a row within its meter."""
        return F.struct(*self.order)

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows partitioned by the keys. Left to itself, Spark joins partitions until a task holds as many
        megabytes as the whole shuffle has for one core, and all windows of a pass keep that many rows."""
        return df if self.tasks is None else df.repartition(self.tasks, *self.keys)

    def neighbours(
        self, df: DataFrame, before: int, after: int, work: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        """Run ``work``, which may look ``before``/``after`` rows around through ``window``."""
        if not self.striped:
            return work(df)
        length = self.strip_rows
        if length < max(before, after):
            raise ValueError(f"strip_rows={length} is below the {max(before, after)} rows needed")
        home = F.floor(F.col(POS) / F.lit(length))
        place = F.pmod(F.col(POS), F.lit(length))
        strips = F.array_compact(
            F.array(
                home,
                F.when(place < after, home - 1),
                F.when(place >= length - before, home + 1),
            )
        )
        done = work(self.dealt(df.withColumn(STRIP, F.explode(strips))))
        return done.filter(F.col(STRIP) == home)

    def running(
        self,
        df: DataFrame,
        lasts: dict[str, Column] | None = None,
        sums: dict[str, Column] | None = None,
        lasts_before: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Latest non-null value and running sum from the meter's first row to this one.

        ``lasts_before`` stops one row earlier.
        """
        lasts, sums, lasts_before = lasts or {}, sums or {}, lasts_before or {}
        here = self.window.rowsBetween(Window.unboundedPreceding, 0)
        found = {n: F.last(c, ignorenulls=True).over(here) for n, c in lasts.items()}
        found |= {n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()}
        above = self.window.rowsBetween(Window.unboundedPreceding, -1)
        found |= {n: F.last(c, ignorenulls=True).over(above) for n, c in lasts_before.items()}
        lasts = lasts | lasts_before
        if not self.striped:
            return df.withColumns(found)
        # Windows come before the rows are stored: here they share the shuffle by strip of the step before.
        df = pin(df.withColumns(found))
        edges = df.groupBy(*self.keys).agg(
            *[
                F.max(F.when(c.isNotNull(), F.struct(F.col(POS), c.alias("v")))).alias(n)
                for n, c in lasts.items()
            ],
            *[F.sum(c).alias(n) for n, c in sums.items()],
        )
        edges = pin(edges)  # one row per strip, counted before it is broadcast
        few = edges.count() <= FEW_STRIPS
        if self.stacked:
            # The strips of all meters follow each other: scanned in blocks, and blocks of blocks.
            scanned = exclusive_scan(edges, list(sums), list(lasts), 1, 0, STRIP, STRIP_BITS)
            carried = scanned.select(
                STRIP,
                *[F.col(f"before_{n}")["v"].alias(f"_c_{n}") for n in lasts],
                *[F.col(f"before_{n}").alias(f"_c_{n}") for n in sums],
            )
        else:
            earlier = (
                Window.partitionBy(*self.group).orderBy(STRIP).rowsBetween(Window.unboundedPreceding, -1)
            )
            carried = edges.select(
                *self.keys,
                *[F.last(n, ignorenulls=True).over(earlier)["v"].alias(f"_c_{n}") for n in lasts],
                *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
            )
        df = df.join(F.broadcast(carried) if few else carried, self.keys, "left")
        df = df.withColumns(
            {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in lasts}
            | {n: F.col(n) + F.col(f"_c_{n}") for n in sums}
        )
        return df.drop(*[f"_c_{n}" for n in (*lasts, *sums)])

    def per_event(
        self,
        df: DataFrame,
        event: str,
        smallest: dict[str, Column] | None = None,
        largest: dict[str, Column] | None = None,
        within_meter: bool = False,
        stored: bool = False,
    ) -> DataFrame:
        """Attach the smallest/largest value within the row's event; null outside events.

        Events never leave their group; ``within_meter`` keeps them apart by meter in a
        stacked frame too. ``stored`` says that strips come from ``running``, which has just stored them.
        """
        smallest, largest = smallest or {}, largest or {}
        inside = F.col(event).isNotNull()
        by = [METER, event] if within_meter else [*self.group, event]
        if not self.striped:
            # Ordered although minimum and maximum need no order: the sort then also serves
            # windows over the meter that order by event first.
            rest = [c for c in self.order if c != event]
            whole = Window.partitionBy(*by).orderBy(*rest).rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing
            )
            return df.withColumns(
                {n: F.when(inside, F.min(c).over(whole)) for n, c in smallest.items()}
                | {n: F.when(inside, F.max(c).over(whole)) for n, c in largest.items()}
            )
        df = df if stored else pin(df)
        keys = [STRIP, *by]
        pieces = (
            df.filter(inside)
            .groupBy(*keys)
            .agg(
                *[F.min(c).alias(n) for n, c in smallest.items()],
                *[F.max(c).alias(n) for n, c in largest.items()],
            )
        )
        whole = pieces.groupBy(*by).agg(
            *[F.min(n).alias(n) for n in smallest], *[F.max(n).alias(n) for n in largest]
        )
        spread = pieces.select(*keys).join(whole, by)
        return df.join(spread, keys, "left")


@dataclass(frozen=True)
class Part:
    df: DataFrame
    layout: Layout


@dataclass(frozen=True)
class Frame:
    """Readings in their parts; operators map over the parts with the matching layout."""

    parts: tuple[Part, ...]
    scale: Scale
    hot: DataFrame | None = None  # the heavy meters, at most ``max_hot_meters`` rows

    @staticmethod
    def split(df: DataFrame, scale: Scale) -> Frame:
        """Separate meters too long for one task. Costs one pre-aggregated count per meter."""
        counts = df.groupBy(METER).agg(F.count("*").alias("_rows"))
        known = F.col(METER).isNotNull()
        rows, total, longest = counts.agg(
            F.sum("_rows"), F.sum(F.when(known, F.col("_rows"))), F.max(F.when(known, F.col("_rows")))
        ).first()
        tasks = None
        if rows and rows > scale.task_rows:
            tasks = max(-(-rows // scale.task_rows), df.sparkSession.sparkContext.defaultParallelism)
        if not scale.unique_ids:
            df = with_content(df)
        layout = Layout(tuple(row_order(df)), lone=(rows or 0) > (total or 0), tasks=tasks)
        if layout.lone:
            told_by = [c for c in (*layout.order, "energy") if c in df.columns]
            lone = F.when(F.col(METER).isNull(), F.xxhash64(*told_by))
            df = df.withColumn(LONE, F.coalesce(lone, F.lit(0).cast("bigint")))
        # At most max_hot_meters meters can be above this limit, whatever the data.
        limit = max(scale.hot_meter_rows, (total or 0) // scale.max_hot_meters)
        if not longest or longest <= limit:
            return Frame((Frame._placed(layout.dealt(df), layout),), scale)
        hot = pin(counts.filter(known & (F.col("_rows") > limit)).select(METER))
        cold = df.join(F.broadcast(hot), METER, "left_anti")
        long = df.join(F.broadcast(hot), METER, "left_semi").drop(LONE)
        return Frame(
            (
                Frame._placed(layout.dealt(cold), layout),
                Part(long, replace(layout, strip_rows=scale.strip_rows, lone=False)),
            ),
            scale,
            hot,
        ).arrange()

    @staticmethod
    def _placed(df: DataFrame, layout: Layout) -> Part:
        """Replace the digest by the row's place in its meter, over the partitioning that later steps use."""
        if CONTENT not in df.columns:
            return Part(df, layout)
        df = df.withColumn(PLACE, F.row_number().over(layout.window)).drop(CONTENT)
        return Part(df, replace(layout, order=tuple(row_order(df))))

    @staticmethod
    def stacked(df: DataFrame, scale: Scale) -> Frame:
        """One sequence of all meters' rows, in strips: neighbours may belong to other meters."""
        if not scale.unique_ids:
            df = with_content(df)
        layout = Layout(tuple(row_order(df)), scale.strip_rows, stacked=True)
        # Stored, as finding the bounds of the ranges would compute the rows a second time.
        return Frame((Part(pin(df), layout),), scale).arrange()

    def arrange(self) -> Frame:
        """Adopt the row order of the current columns; positions are renewed after rows moved."""
        placed = []
        for part in self.parts:
            order = row_order(part.df)
            if not part.layout.striped:
                placed.append(Part(part.df, replace(part.layout, order=tuple(order))))
                continue
            df = with_positions(part.df.drop(POS, STRIP), [METER, *order])
            length = self.scale.strip_rows
            df = df.withColumn(STRIP, F.floor(F.col(POS) / F.lit(length)))
            if CONTENT in df.columns:
                df = df.withColumn(PLACE, F.col(POS)).drop(CONTENT)
            placed.append(Part(df, replace(part.layout, order=(POS,))))
        return replace(self, parts=tuple(placed))

    def by_event(self, event: str) -> Frame:
        """Order by event number first. Same rows in the same order as long as numbers rise
        with time, but event and meter windows then share one sort."""
        return replace(
            self,
            parts=tuple(
                p
                if p.layout.striped
                else Part(p.df, replace(p.layout, order=(event, *p.layout.order)))
                for p in self.parts
            ),
        )

    def map(self, work: Callable[[DataFrame, Layout], DataFrame]) -> Frame:
        return replace(self, parts=tuple(Part(work(p.df, p.layout), p.layout) for p in self.parts))

    def join_meters(self, context: DataFrame, size: int) -> Frame:
        """Attach one row per meter, ``size`` rows in all; rows without a meter number get nulls.

        Broadcast while that is few. Above, ordinary parts are joined by meter; the strips of heavy
        meters get the rows of those meters alone, which are few by construction, so that a heavy
        meter never meets in one task.
        """
        if size <= self.scale.scan_rows:
            few = F.broadcast(context)
            return self.map(lambda df, _: df.join(few, METER, "left"))
        heavy = None if self.hot is None else F.broadcast(context.join(F.broadcast(self.hot), METER, "left_semi"))

        def attach(df: DataFrame, layout: Layout) -> DataFrame:
            if layout.striped:
                return df.join(heavy, METER, "left")
            if layout.lone:
                return df.join(context.withColumn(LONE, F.lit(0).cast("bigint")), [METER, LONE], "left")
            return df.join(context, METER, "left")

        return self.map(attach)

    def dealt(self) -> Frame:
        """Ordinary parts partitioned anew after they were stored; strips are dealt when neighbours are looked at."""
        return self.map(lambda df, layout: df if layout.striped else layout.dealt(df))

    def pin(self) -> Frame:
        return self.map(lambda df, _: pin(df))

    def union(self) -> DataFrame:
        """All parts as one DataFrame without the layout columns."""
        layout = (POS, STRIP, LONE, PLACE)
        whole = self.parts[0].df.drop(*layout)
        for part in self.parts[1:]:
            whole = whole.unionByName(part.df.drop(*layout))
        return whole
