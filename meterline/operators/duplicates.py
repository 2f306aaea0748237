"""Removal of events that were sent twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.exprs import ne
from meterline.operators.pinning import pin
from meterline.operators.sessions import event_group
from meterline.operators.timeline import Frame, Layout
from meterline.params import EFFECTIVE, Params, Profile, Scale
from meterline.schema import EVENT, METER, TS, require

FLAG = "timestamp_issue"


def _flag(df: DataFrame, layout: Layout, margin: float, edge: str, name: str) -> DataFrame:
    """Flag events whose edge row gained at most ``margin`` over the previous event's edge row.

    The rows of an event follow each other, as sessionising leaves them, so the edge is where
    the neighbour has another event.
    """
    last = edge == "last"
    inside = F.col(EVENT).isNotNull()

    def find_edge(rows: DataFrame) -> DataFrame:
        def beside(c: str) -> Column:
            return (F.lead(c) if last else F.lag(c)).over(layout.window)

        outer = ne(F.col(EVENT), beside(EVENT)) | ne(F.col(METER), beside(METER))
        counter = F.struct(F.col(METER).alias("m"), F.col("energy").alias("v"))
        return rows.withColumn("_edge", F.when(inside & outer, counter))

    df = layout.neighbours(df, 0 if last else 1, 1 if last else 0, find_edge)
    df = layout.running(df, lasts_before={"_previous": F.col("_edge")})
    before = F.col("_previous")
    repeated = (F.col("energy") - F.lit(margin) <= before["v"]) & (before["m"] == F.col(METER))
    verdict = F.struct(layout.key.alias("at"), F.when(repeated, F.lit(True)).alias("v"))
    df = df.withColumn("_verdict", F.when(F.col("_edge").isNotNull(), verdict))
    df = layout.per_event(df, event_group(df), largest={name: F.col("_verdict")}, stored=True)
    df = df.withColumn(name, F.when(inside, F.col(name)["v"]))
    return df.drop("_edge", "_previous", "_verdict")


def flag_frame(frame: Frame, params: Params, profile: Profile) -> Frame:
    margin = params.error_margin

    def flag(df: DataFrame, layout: Layout) -> DataFrame:
        df = _flag(df.drop(FLAG), layout, margin, "last", FLAG)
        if not profile.check_last_rows_only:
            df = _flag(df, layout, margin, "first", "_first_issue")
            df = df.withColumn(FLAG, F.coalesce(FLAG, "_first_issue")).drop("_first_issue")
        return df

    return frame.map(flag)


def drop_frame(frame: Frame, profile: Profile) -> Frame:
    """Remove flagged events, or every row that shares a timestamp with one."""
    if not profile.drop_by_timestamp:
        return frame.map(lambda df, _: df.filter(F.col(FLAG).isNull())).arrange()
    frame = frame.pin()
    flagged = [p.df.filter(FLAG).select(TS).distinct() for p in frame.parts]
    stamps = flagged[0]
    for more in flagged[1:]:
        stamps = stamps.unionByName(more)
    # Counted first: an estimate would come from the whole frame and shuffle all of it by time.
    stamps = pin(stamps.distinct())
    return frame.map(_without(stamps, frame.scale.scan_rows)).arrange()


#: A bitmap stands for 32,768 seconds in 4 kilobytes; so many of them (64 MB, 17 years) are broadcast at most.
BITMAPS = 1 << 14


def _without(stamps: DataFrame, few: int) -> Callable[[DataFrame, Layout], DataFrame]:
    """Drops the rows at ``stamps`` (distinct, pinned) without moving the others.

    Up to ``few`` stamps are broadcast. More are compressed to one bit per second. If all of them
    are whole seconds, as recordings are, the bits decide; else only rows whose second has its bit set are shuffled
    and compared exactly.
    """
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(TS))
    whole = F.date_trunc("second", TS) == F.col(TS)
    total, all_whole = stamps.agg(F.count("*"), F.min(whole)).first()
    if total <= few:
        return lambda df, _: df.join(F.broadcast(stamps), TS, "left_anti")
    bucket, bit = F.bitmap_bucket_number(second), F.bitmap_bit_position(second)
    bitmaps = pin(stamps.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits")))
    if bitmaps.count() > BITMAPS:
        return lambda df, _: df.join(stamps, TS, "left_anti")

    def marked(df: DataFrame) -> DataFrame:
        byte = F.expr("CAST(conv(hex(substring(_bits, CAST(_bit DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
        rows = df.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(bitmaps), "_bucket", "left")
        hit = F.coalesce(F.getbit(byte, F.pmod("_bit", F.lit(8))) == 1, F.lit(False))
        return rows.withColumn("_hit", hit).drop("_bucket", "_bit", "_bits")

    def drop(df: DataFrame, _: Layout) -> DataFrame:
        rows = marked(df)
        if all_whole:
            return rows.filter(~(F.col("_hit") & whole)).drop("_hit")
        near = rows.filter("_hit").drop("_hit").join(stamps, TS, "left_anti")
        return rows.filter("NOT _hit").drop("_hit").unionByName(near)

    return drop


def timestamp_issue(
    df: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Sessionised readings without duplicated events."""
    require(df, METER, TS, "id", "energy", EVENT)
    return drop_frame(flag_frame(Frame.split(df, scale), params, profile), profile).union()
