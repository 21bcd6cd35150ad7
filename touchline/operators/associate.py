"""Nearest-neighbour association per frame, zones, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.geometry import distance


def _pairs(ball: DataFrame, players: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the frame; a frame that holds many players is split by adaptive execution."""
    return ball.join(players, keys, how)


def nearest(ball: DataFrame, players: DataFrame, *, keys: list[str], row: str, x: str = "center_x", y: str = "center_y", px: str = "foot_x", py: str = "foot_y", player: str = "player_id", keep: list[str] = (), prefer: Column | None = None, limit: float = 150.0) -> DataFrame:
    """Adds to every ball row its frame's nearest player (equal distances: the smaller id), nulls where it has none.

    With ``prefer``, players that meet it come first as long as the nearest of them is within ``limit``.
    """
    return ball.join(nearest_met(ball, players, keys=keys, row=row, x=x, y=y, px=px, py=py, player=player, keep=keep, prefer=prefer, limit=limit), row, "left")


def nearest_met(ball: DataFrame, players: DataFrame, *, keys: list[str], row: str, x: str = "center_x", y: str = "center_y", px: str = "foot_x", py: str = "foot_y", player: str = "player_id", keep: list[str] = (), prefer: Column | None = None, limit: float = 150.0) -> DataFrame:
    """``row`` and the nearest player, as ``nearest`` has it, of the ball rows that have one."""
    cand = ball.select(*keys, row, x, y).join(players, keys).withColumn("_d", distance(x, y, px, py))
    found = F.struct("_d", player, *[c for c in (px, py, *keep)])
    aggs = [F.min(found).alias("_any")]
    if prefer is not None:
        aggs.append(F.min(F.when(prefer, found)).alias("_first"))
    best = cand.filter("_d is not null").groupBy(row).agg(*aggs)
    pick = F.col("_any") if prefer is None else F.when(F.col("_first._d") <= limit, F.col("_first")).otherwise(F.col("_any"))
    best = best.select(row, pick.alias("_b"))
    return best.select(row, F.col(f"_b.{player}").alias("nearest_player_id"), F.col("_b._d").alias("nearest_player_distance_px"), *[F.col(f"_b.{c}").alias(f"nearest_player_{c}") for c in (px, py, *keep)])


def k_nearest(ball: DataFrame, players: DataFrame, k: int, *, keys: list[str], row: str, x: str = "center_x", y: str = "center_y", px: str = "foot_x", py: str = "foot_y", player: str = "player_id") -> DataFrame:
    """The ``k`` nearest players of every ball row with their rank."""
    cand = ball.select(*keys, row, x, y).join(players.select(*keys, player, px, py), keys).withColumn("distance_px", distance(x, y, px, py)).filter("distance_px is not null")
    rank = F.row_number().over(Window.partitionBy(row).orderBy("distance_px", player))
    return cand.withColumn("rank", rank).filter(F.col("rank") <= k).select(row, *keys, player, "distance_px", "rank")


def ball_state(speed: Column, dist: Column, zone: Column | None = None, *, zones: tuple[str, ...] = ("strict", "tolerant"), max_distance: float = 150.0, control_distance: float = 80.0, controlled_speed: float = 500.0, transit_speed: float = 700.0) -> tuple[Column, Column]:
    """Association status and ball state; a fast ball comes before a far one."""
    allowed = F.lit(True) if zone is None else F.coalesce(zone.isin(*zones), F.lit(False))
    slow = speed.isNull() | (speed <= controlled_speed)
    cases = [
        (dist.isNull(), "no_on_field_players", "unknown"), (speed >= transit_speed, "near_player_but_fast", "in_transit"),
        (dist > max_distance, "too_far", "loose_or_unclear"), (allowed & (dist <= control_distance) & slow, "associated", "controlled"),
    ]
    status, state = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for when, a, b in cases[1:]:
        status, state = status.when(when, a), state.when(when, b)
    return status.otherwise("near_player_unclear"), state.otherwise("loose_or_unclear")


def asof_backward(df: DataFrame, states: DataFrame, *, by: list[str], order: str, columns: list[str], block: int = 4096) -> DataFrame:
    """Adds ``columns`` of the latest row of ``states`` at or before each row's ``order`` (of equal ones any, so keep
    states unique). One union and one window a block; a carry of each block's last state spans blocks."""
    blk = F.floor(F.col(order) / block)
    packed = F.struct(F.col(order).alias("_so"), *columns)
    left = df.withColumns({"_blk": blk, "_side": F.lit(1), "_state": F.lit(None).cast(states.select(packed.alias("s")).schema["s"].dataType)})
    right = states.filter(F.col(order).isNotNull()).select(*by, order, packed.alias("_state")).withColumns({"_blk": blk, "_side": F.lit(0)})
    for c in left.columns:
        if c not in right.columns:
            right = right.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = left.unionByName(right.select(*left.columns))
    inside = Window.partitionBy(*by, "_blk").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_here", F.last("_state", ignorenulls=True).over(inside))
    tails = both.groupBy(*by, "_blk").agg(F.max("_state").alias("_tail"))
    over = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*by, "_blk", F.last("_tail", ignorenulls=True).over(over).alias("_carry"))
    both = both.filter("_side = 1").join(tails, [*by, "_blk"], "left")
    return both.withColumns({c: F.coalesce(F.col("_here"), F.col("_carry"))[c] for c in columns}).drop("_blk", "_side", "_state", "_here", "_carry")


def range_join(left: DataFrame, right: DataFrame, *, by: list[str], order: str, reach: int, right_order: str | None = None) -> DataFrame:
    """Pairs whose orders differ by at most ``reach``: an equi-join on buckets of 2 * reach + 1, of which each left row meets at most two."""
    width, r = 2 * reach + 1, right_order or order
    lo, hi = F.floor((F.col(order) - reach) / width), F.floor((F.col(order) + reach) / width)
    a = left.withColumn("_bucket", F.explode(F.when(lo == hi, F.array(lo)).otherwise(F.array(lo, hi))))
    b = right.withColumn("_bucket", F.floor(F.col(r) / width)).withColumnRenamed(r, "_ro") if r == order else right.withColumn("_bucket", F.floor(F.col(r) / width)).withColumn("_ro", F.col(r))
    out = a.join(b, [*by, "_bucket"]).filter(F.abs(F.col(order) - F.col("_ro")) <= reach).drop("_bucket")
    return out.withColumnRenamed("_ro", f"right_{order}")


def player_penalty(ball: DataFrame, players: DataFrame, *, by: list[str], row: str, reach: int = 5, foot: float = 300.0, body: float = 100.0, foot_zone: float = 0.62) -> DataFrame:
    """Adds what a ball reading inside players' boxes of the frames around costs it: ``foot`` in the lowest part, else ``body``."""
    boxes = players.select(*by, "frame", *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = range_join(ball.select(*by, "frame", row, "center_x", "center_y"), boxes, by=by, order="frame", reach=reach)
    inside = F.col("center_x").between(F.col("px1"), F.col("px2")) & F.col("center_y").between(F.col("py1"), F.col("py2"))
    low = F.col("center_y") >= F.col("py1") + F.lit(foot_zone) * (F.col("py2") - F.col("py1"))
    cost = pairs.filter(inside).groupBy(row).agg(F.sum(F.when(low, foot).otherwise(body)).alias("player_penalty"))
    return ball.join(cost, row, "left").fillna({"player_penalty": 0.0})


def local_motion(rows: DataFrame, players: DataFrame, *, by: list[str], row: str, reach: int = 15, radius: float = 45.0) -> DataFrame:
    """How a place (foot_x, foot_y at frame) is followed in the frames around: the nearest player of each frame within ``radius``."""
    near = players.select(*by, "frame", F.col("foot_x").alias("qx"), F.col("foot_y").alias("qy"), F.col("field_zone").alias("qz"))
    pairs = range_join(rows.select(*by, "frame", row, "foot_x", "foot_y"), near, by=by, order="frame", reach=reach)
    pairs = pairs.withColumn("d", distance("foot_x", "foot_y", "qx", "qy")).filter("d is not null")
    best = pairs.groupBy(row, F.col("frame").alias("at"), "right_frame").agg(F.min(F.struct("d", "qx", "qy", "qz")).alias("m")).filter(F.col("m.d") <= radius)
    first, last = F.min_by("m", "right_frame"), F.max_by("m", "right_frame")
    span = F.greatest(F.max("right_frame") - F.min("right_frame"), F.lit(1))
    n = F.count(F.lit(1))
    moved = F.when(n >= 2, distance(last["qx"], last["qy"], first["qx"], first["qy"]))
    return best.groupBy(row).agg(
        n.alias("match_frames"), (n / F.lit(2 * reach + 1)).alias("match_ratio"), F.max((F.col("right_frame") < F.col("at")).cast("int")).alias("prev_match"),
        F.max((F.col("right_frame") > F.col("at")).cast("int")).alias("next_match"), F.count_if(F.col("m.qz") == "strict").alias("strict_frames"),
        F.count_if(F.col("m.qz") == "tolerant").alias("tolerant_frames"), F.min("m.d").alias("min_distance"), F.median("m.d").alias("median_distance"),
        moved.alias("displacement"), (moved / span).alias("displacement_per_frame"),
    )


def interval_buckets(lo: Column, hi: Column, width: float, *, coarser: bool = False, factor: int = 64, levels: int = 3) -> Column:
    """Array of (level, bucket) that an interval lies in. A level's buckets are ``factor`` times as wide as those of the level below; an interval is put where it
    needs ``factor`` + 1 of them at most (or at the top), and with ``coarser`` at all levels above as well. A point lies in one bucket of every level."""
    own = F.lit(levels - 1)
    for at in range(levels - 2, -1, -1):
        own = F.when(hi - lo <= width * factor ** (at + 1), F.lit(at)).otherwise(own)
    parts = []
    for at in range(levels):
        w = width * factor**at
        level = F.lit(at).alias("level")
        here = F.transform(F.sequence(F.floor(lo / w), F.floor(hi / w)), lambda b: F.struct(level, b.alias("bucket")))
        parts.append(F.when(F.lit(at) >= own if coarser else F.lit(at) == own, here).otherwise(F.array().cast("array<struct<level: int, bucket: bigint>>")))
    return F.concat(*parts)


def overlap_join(left: DataFrame, right: DataFrame, *, by: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width: float = 60.0) -> DataFrame:
    """Pairs of intervals that share a point (ends count), each once or more: an equi-join on buckets at the level of the longer one."""
    a = left.withColumn("_at", F.explode(interval_buckets(F.col(left_ends[0]), F.col(left_ends[1]), width, coarser=True)))
    b = right.filter(F.col(right_ends[0]) <= F.col(right_ends[1])).withColumn("_at", F.explode(interval_buckets(F.col(right_ends[0]), F.col(right_ends[1]), width, coarser=True)))
    return a.join(b, [*by, "_at"]).filter((F.col(right_ends[0]) <= F.col(left_ends[1])) & (F.col(right_ends[1]) >= F.col(left_ends[0]))).drop("_at")


def stamp_intervals(df: DataFrame, intervals: DataFrame, *, by: list[str], time: str, start: str, end: str, rank: str, columns: list[str], row: str, width: float = 60.0, last_wins: bool = True) -> DataFrame:
    """Adds ``columns`` of the interval that holds ``time`` (both ends count); of several the one with the greatest (or smallest) ``rank``.

    Intervals are put into buckets of ``width`` time units, long ones into coarser buckets, so this is an equi-join however long the sequence or an interval.
    """
    iv = intervals.filter(F.col(start) <= F.col(end))
    iv = iv.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(rank).alias("_r"), *[F.col(c).alias(f"_v_{c}") for c in columns], F.explode(interval_buckets(F.col(start), F.col(end), width)).alias("_b"))
    points = df.filter(F.col(time).isNotNull()).select(*by, row, F.col(time).alias("_t"), F.explode(interval_buckets(F.col(time), F.col(time), width, coarser=True)).alias("_b"))
    pairs = points.join(iv, [*by, "_b"]).filter(F.col("_t").between(F.col("_s"), F.col("_e")))
    value = F.struct(*[F.col(f"_v_{c}") for c in columns])
    hit = pairs.groupBy(row).agg((F.max_by if last_wins else F.min_by)(value, "_r").alias("_hit"))
    return df.join(hit, row, "left").withColumns({c: F.col(f"_hit._v_{c}") for c in columns}).drop("_hit")


def participant_features(ball: DataFrame, players: DataFrame, readings: DataFrame, *, by: list[str], most: int = 5) -> DataFrame:
    """The ``most`` nearest players of each frame's ball (one row a frame): rank, the frame's players, box geometry, and places as shares of the picture.

    A sequence's picture is as wide and high as the farthest box of players or ``readings``; edges are the nearer ones. A box without height has no aspect.
    """
    keys = [*by, "frame"]
    size = [t.groupBy(*by).agg(F.max("x2").alias("w"), F.max("y2").alias("h")) for t in (players, readings)]
    size = size[0].unionByName(size[1]).groupBy(*by).agg(F.max("w").alias("_w"), F.max("h").alias("_h"))
    count = players.groupBy(*keys).agg(F.count(F.lit(1)).alias("players_in_frame"), F.count_if(F.col("field_zone") == "strict").alias("strict_in_frame"))
    near = ball.select(*keys, "center_x", "center_y").join(players, keys).withColumn("ball_distance", distance("center_x", "center_y", "foot_x", "foot_y")).filter("ball_distance is not null")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ball_distance", "player_id"))).filter(F.col("rank") <= most)
    w, h, x, y = F.col("_w"), F.col("_h"), F.col("foot_x"), F.col("foot_y")
    tall = F.col("y2") - F.col("y1")
    out = near.join(size, by).join(count, keys)
    return out.withColumns({
        "ball_distance_norm": F.try_divide("ball_distance", h), "foot_x_norm": F.try_divide(x, w), "foot_y_norm": F.try_divide(y, h), "edge_x_norm": F.try_divide(F.least(x, w - x), w),
        "edge_y_norm": F.try_divide(F.least(y, h - y), h), "aspect": F.try_divide(F.col("x2") - F.col("x1"), F.when(tall > 0, tall)), "height_norm": F.try_divide(tall, h),
    }).drop("_w", "_h")
