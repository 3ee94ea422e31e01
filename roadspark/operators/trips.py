"""Trips: edge visits, edge KPIs, occupancy, positions and trajectories from vehicle sample logs.

``samples`` has (vehicle_id, t, seq, edge, offset_m, advance_m); ``seq`` orders samples of one time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def traversals(samples: DataFrame) -> DataFrame:
    """One row per edge visit: (vehicle_id, visit, edge, enter_t, exit_t, distance_m).

    A visit is a run of samples on one edge; it ends when the next one starts (null for the last).  Rows
    without a vehicle, time or edge are left out.
    """
    by = Window.partitionBy("vehicle_id").orderBy("t", "seq")
    new = F.coalesce((F.lag("edge").over(by) != F.col("edge")).cast("int"), F.lit(1))
    runs = samples.dropna(subset=["vehicle_id", "t", "edge"]).withColumn("new", new).withColumn("visit", F.sum("new").over(by))
    visits = runs.groupBy("vehicle_id", "visit").agg(F.first("edge").alias("edge"), F.min("t").alias("enter_t"), F.sum("advance_m").alias("distance_m"))
    left = F.lead("enter_t").over(Window.partitionBy("vehicle_id").orderBy("visit"))
    return visits.select("vehicle_id", "visit", "edge", "enter_t", left.alias("exit_t"), "distance_m")


def edge_kpis(visits: DataFrame) -> DataFrame:
    """(edge, entries, vehicle_seconds, distance_m, mean_speed): seconds of completed visits, 0 speed below 1e-9 s."""
    sums = visits.groupBy("edge").agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.col("exit_t") - F.col("enter_t")), F.lit(0.0)).alias("vehicle_seconds"),
        F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("distance_m"),
    )
    speed = F.when(F.col("vehicle_seconds") > 1e-9, F.col("distance_m") / F.col("vehicle_seconds")).otherwise(0.0)
    return sums.withColumn("mean_speed", speed)


def occupancy_at(visits: DataFrame, t: float) -> DataFrame:
    """(edge, vehicles) at ``t``: entered, not yet left."""
    there = (F.col("enter_t") <= t) & (F.col("exit_t").isNull() | (F.col("exit_t") > t))
    return visits.where(there).groupBy("edge").agg(F.count("*").alias("vehicles"))


def occupancy(visits: DataFrame) -> DataFrame:
    """(edge, t, vehicles): the count after each change."""
    ends = visits.select("edge", F.col("enter_t").alias("t"), F.lit(1).alias("d")).unionByName(visits.where("exit_t IS NOT NULL").select("edge", F.col("exit_t").alias("t"), F.lit(-1).alias("d")))
    changes = ends.groupBy("edge", "t").agg(F.sum("d").alias("d"))
    return changes.select("edge", "t", F.sum("d").over(Window.partitionBy("edge").orderBy("t")).alias("vehicles"))


def summary(vehicles: DataFrame) -> DataFrame:
    """One row of counts by state, travel times of the arrived, and the distance of all.

    ``vehicles`` has (depart_t, arrive_t, distance_m, unroutable).
    """
    arrived = F.col("arrive_t").isNotNull()
    travel = F.when(arrived, F.col("arrive_t") - F.col("depart_t"))
    lost = F.coalesce(F.col("unroutable"), F.lit(False))
    return vehicles.agg(
        F.count_if(arrived).alias("arrived"),
        F.count_if(lost).alias("unroutable"),
        F.count_if(~lost & ~arrived & F.col("depart_t").isNull()).alias("waiting"),
        F.count_if(~lost & ~arrived & F.col("depart_t").isNotNull()).alias("driving"),
        F.avg(travel).alias("avg_travel_s"),
        F.min(travel).alias("min_travel_s"),
        F.max(travel).alias("max_travel_s"),
        F.sum("distance_m").alias("distance_m"),
    )


def interpolate(samples: DataFrame, times: DataFrame, values: list[str]) -> DataFrame:
    """``times`` (vehicle_id, t) with each of ``values`` interpolated linearly between the samples around.

    Before the first and behind the last sample the value is held; at equal times the last sample counts.
    """
    point = F.struct("t", *values)
    rows = samples.select("vehicle_id", "t", F.lit(0).alias("ask"), F.col("seq"), point.alias("p")).unionByName(
        times.select("vehicle_id", "t", F.lit(1).alias("ask"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(samples.select(point.alias("p")).schema["p"].dataType).alias("p"))
    )
    by = Window.partitionBy("vehicle_id").orderBy("t", "ask", "seq")
    a = F.last("p", True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("p", True).over(by.rowsBetween(1, Window.unboundedFollowing))
    around = rows.withColumns({"a": a, "b": b}).where("ask = 1")
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    span = b["t"] - a["t"]
    share = F.when((span <= 0) | (F.col("t") <= a["t"]), F.lit(0.0)).otherwise(F.least((F.col("t") - a["t"]) / span, F.lit(1.0)))
    return around.select("vehicle_id", "t", *((a[v] + (b[v] - a[v]) * share).alias(v) for v in values))


def frames(samples: DataFrame, vehicles: DataFrame, step: float, until: float, values: list[str]) -> DataFrame:
    """Visible vehicles at each multiple of ``step`` up to ``until``: depart <= t <= arrive (or the end)."""
    last = F.least(F.coalesce("arrive_t", F.lit(until)), F.lit(until))
    ticks = F.sequence(F.ceil(F.col("depart_t") / step).cast("long"), F.floor(last / step).cast("long"))
    has = F.ceil(F.col("depart_t") / step) <= F.floor(last / step)
    times = vehicles.where(has).select("vehicle_id", F.explode(ticks).alias("k")).select("vehicle_id", (F.col("k") * step).alias("t"))
    return interpolate(samples, times, values)


def downsample(samples: DataFrame, interval: float) -> DataFrame:
    """The first sample at or after each multiple of ``interval``, each once."""
    due = F.floor(F.col("t") / interval)
    first = F.min(F.struct("t", "seq", "edge", "offset_m")).alias("s")
    return samples.groupBy("vehicle_id", due.alias("due")).agg(first).select("vehicle_id", "s.t", "s.seq", "s.edge", "s.offset_m")


def trajectories(points: DataFrame) -> DataFrame:
    """One line per vehicle with two samples or more: its (t, x, y) in order, ends, travel time and distance."""
    line = F.array_sort(F.collect_list(F.struct("t", "x", "y")))
    lines = points.groupBy("vehicle_id").agg(line.alias("line")).where(F.size("line") >= 2)
    lines = lines.withColumns({"depart_t": F.col("line")[0]["t"], "arrive_t": F.element_at("line", -1)["t"]})
    steps = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))
    return lines.withColumns({"travel_s": F.col("arrive_t") - F.col("depart_t"), "distance_m": F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d)})


def affected_vehicles(progress: DataFrame, route_edges: DataFrame, changed: DataFrame, recovery: bool = False) -> DataFrame:
    """Vehicles not yet arrived whose edges ahead are closed or changed.

    ``progress`` has (vehicle_id, route_id, pos), pos null when waiting (then the whole route is ahead);
    ``route_edges`` (route_id, pos, edge); ``changed`` (edge, improved).  With ``recovery``, an improved edge makes
    every active vehicle a candidate.
    """
    ahead = progress.select("vehicle_id", "route_id", F.coalesce("pos", F.lit(-1)).alias("at")).join(route_edges, "route_id").where("pos > at")
    hit = ahead.join(changed.select("edge").distinct(), "edge", "left_semi").select("vehicle_id").distinct()
    if not recovery:
        return hit
    better = changed.agg(F.coalesce(F.bool_or("improved"), F.lit(False)).alias("better"))
    every = progress.select("vehicle_id").join(F.broadcast(better), F.col("better"), "left_semi")
    return hit.union(every).distinct()


def reroute_benefit(offers: DataFrame, min_gain: float, cooldown: float) -> DataFrame:
    """Which offered routes are taken: (vehicle_id, t, accepted, reason), in time order.

    ``offers`` has (vehicle_id, t, blocked, same_path, new_s, remaining_s).  A blocked vehicle takes any route; else
    the path has to differ, save ``min_gain`` seconds, and ``cooldown`` seconds have to lie behind the last take.
    """
    offered = offers.select("vehicle_id", "t", F.coalesce("blocked", F.lit(False)).alias("blocked"), "same_path", "new_s", "remaining_s")
    saves = ~F.col("same_path") & (F.col("new_s") + min_gain + 1e-9 < F.col("remaining_s"))
    offered = offered.withColumn("gain", F.coalesce(saves, F.lit(False)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        group = group.sort_values(["t", "blocked", "same_path", "new_s", "remaining_s"], na_position="first")
        for t, blocked, gain in zip(group["t"], group["blocked"], group["gain"], strict=True):
            yes = bool(blocked or gain and (last is None or t - last >= cooldown))
            out.append((group["vehicle_id"].iloc[0], t, yes, "blocked" if blocked else "gain" if yes else "cooldown" if gain else "no_gain"))
            last = t if yes else last
        return pd.DataFrame(out, columns=["vehicle_id", "t", "accepted", "reason"])

    return offered.groupBy("vehicle_id").applyInPandas(run, "vehicle_id long, t double, accepted boolean, reason string")


def reroute_counts(reroutes: DataFrame) -> DataFrame:
    """(vehicle_id, attempts, succeeded, failed), with one more row of null vehicle for all."""
    counts = [F.count("*").alias("attempts"), F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed")]
    return reroutes.rollup("vehicle_id").agg(*counts)
