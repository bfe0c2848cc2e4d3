"""Movement statistics along tracks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Cruising speeds in metres a second that a mean is held against, and the outliers' bounds.
CRUISING, FAST, SLOW = (0.67, 1.34), 5.0, 0.1


def steps(cells: DataFrame, keys: tuple[str, ...] = ("animal_id",), order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``dx, dy, step, bearing, dt`` from each point to the next, and ``turn`` from the step before, in (-pi, pi]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = cells.select(
        *keys, *order, (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"),
        (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))).alias("dt"),
    ).where("dx is not null")
    rows = rows.withColumns({"step": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "bearing": F.atan2("dy", "dx")})
    d = F.col("bearing") - F.lag("bearing").over(w)
    return rows.withColumn("turn", F.atan2(F.sin(d), F.cos(d)))


def summary(walk: DataFrame, keys: tuple[str, ...] = ("animal_id",), prior_weight: float = 0.5, use_prior: bool = False) -> DataFrame:
    """Per track: mean bearing, concentration, speeds and their label, diffusivity, intervals, counts.

    ``speed`` is the median of positive speeds, weighed with the middle of
    the cruising range if ``use_prior``; the label is TOO HIGH whenever the
    mean isn't in that range.
    """
    v = F.try_divide("step", "dt")
    rows = walk.withColumn("v", v)
    got = rows.groupBy(*keys).agg(
        F.count("*").alias("n_steps"),
        F.pmod(F.atan2(F.sum(F.sin("bearing")), F.sum(F.cos("bearing"))), F.lit(2 * math.pi)).alias("mean_bearing"),
        F.sqrt(F.pow(F.avg(F.cos("turn")), 2) + F.pow(F.avg(F.sin("turn")), 2)).alias("r"),
        F.median(F.when(F.col("v") > 0, F.col("v"))).alias("median_speed"), F.min("v").alias("min_speed"), F.max("v").alias("max_speed"),
        F.try_divide(F.avg(F.col("step") * F.col("step")), 4 * F.median("dt")).alias("diffusivity"),
        F.avg("dt").alias("mean_dt"), F.stddev_pop("dt").alias("std_dt"),
        F.count_if(F.col("v") > FAST).alias("n_fast"), F.count_if(F.col("v") < SLOW).alias("n_slow"),
    )
    r = F.col("r")
    kappa = (
        F.when(r < 0.53, 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6)
        .when(r < 0.85, -0.4 + 1.39 * r + F.try_divide(F.lit(0.43), 1 - r))
        .otherwise(F.try_divide(F.lit(1.0), F.pow(r, 3) - 4 * F.pow(r, 2) + 3 * r))
    )
    speed = (1 - prior_weight) * F.col("median_speed") + prior_weight * sum(CRUISING) / 2 if use_prior else F.col("median_speed")
    out = got.withColumns({"kappa": kappa, "speed": speed})
    return out.withColumns({
        "speed_kmh": F.col("speed") * 3.6, "status": F.when(F.col("speed").between(*CRUISING), "REALISTIC").when(F.col("speed").isNotNull(), "TOO HIGH"),
    })
