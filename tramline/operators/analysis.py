"""Accessibility, distributions, comparisons, grids and Monte Carlo sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.measures import decay_weight
from tramline.operators.shared import materialize


def percentile_ranks(samples: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles with unreachable (null) above every number, and the count of reachable samples."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    total = Window.partitionBy(*keys)
    ranked = samples.select(*keys, value, F.row_number().over(w).alias("rn"), F.count("*").over(total).alias("n"), F.count(value).over(total).alias("reachable"))
    asked = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percentile")
    return (
        ranked.select("*", asked)
        .where("rn = greatest(1, (percentile * n + 99) div 100)")
        .select(*keys, "percentile", F.col(value), "reachable")
    )


def all_day(samples: DataFrame, keys: list[str], value: str, cutoffs: list[int]) -> DataFrame:
    """Samples, mean of the reachable ones (null without any), and how many are within each cutoff."""
    within = [F.count_if(F.col(value) <= c).alias(f"within_{c}") for c in cutoffs]
    return samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.count(value).alias("reachable"), F.round(F.avg(value), 6).alias("mean"), *within)


def accessibility(times: DataFrame, opportunities: DataFrame, cutoffs: list[int], kind: str = "step", rate: float = 0.0) -> DataFrame:
    """Weighted sum of opportunities by origin and cutoff. times: origin_id, stop_id, minutes."""
    asked = times.join(opportunities, "stop_id").withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    weight = decay_weight(kind, F.col("minutes"), F.col("cutoff"), rate)
    return asked.groupBy("origin_id", "cutoff").agg(F.round(F.sum(F.col("count") * weight), 4).alias("score"))


def dual_access(times: DataFrame, opportunities: DataFrame, threshold: int) -> DataFrame:
    """Least minutes to reach at least the threshold of opportunities."""
    w = Window.partitionBy("origin_id").orderBy("minutes").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = times.where("minutes IS NOT NULL").join(opportunities, "stop_id").withColumn("total", F.sum("count").over(w))
    return joined.where(F.col("total") >= threshold).groupBy("origin_id").agg(F.min("minutes").alias("minutes"))


def compare(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Change of every key in either side; null is unreachable."""
    a, b = before.withColumnRenamed(value, "before"), after.withColumnRenamed(value, "after")
    return a.join(b, keys, "full").withColumn("change", F.col("after") - F.col("before"))


def comparison_counts(changes: DataFrame) -> DataFrame:
    """Counts of what changed and the mean change of what both sides reach."""
    change = F.col("change")
    return changes.agg(
        F.count("change").alias("comparable"),
        F.count_if(change < -1e-9).alias("faster"),
        F.count_if(change > 1e-9).alias("slower"),
        F.count_if(F.abs(change) <= 1e-9).alias("unchanged"),
        F.count_if(F.col("before").isNull() & F.col("after").isNotNull()).alias("newly_reached"),
        F.count_if(F.col("before").isNotNull() & F.col("after").isNull()).alias("lost"),
        F.round(F.avg("change"), 3).alias("mean_change"),
    )


# ---- grids -----------------------------------------------------------------------------------------

def cell_of(lat: Column, lon: Column, bounds: tuple[float, float, float, float], width: int, height: int) -> tuple[Column, Column]:
    """Column and row (north first) of a point: floored, and clamped to the last cell."""
    west, south, east, north = bounds
    x = F.floor((lon - west) / (east - west) * width)
    y = F.floor((north - lat) / (north - south) * height)
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    return clamp(x, width), clamp(y, height)


def raster(points: DataFrame, value: str, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """The least value of the points in every cell that has one."""
    x, y = cell_of(F.col("lat"), F.col("lon"), bounds, width, height)
    return points.select(x.alias("x"), y.alias("y"), value).groupBy("x", "y").agg(F.min(value).alias(value))


def grid(spark, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Every cell with its center."""
    west, south, east, north = bounds
    cells = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    return cells.select(
        "x", "y", (F.lit(north) - (F.col("y") + 0.5) * ((north - south) / height)).alias("lat"), (F.lit(west) + (F.col("x") + 0.5) * ((east - west) / width)).alias("lon")
    )


def sample_at(surface: DataFrame, points: DataFrame, value: str, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """OP17: the surface's value at each point's cell, null where unreached."""
    x, y = cell_of(F.col("lat"), F.col("lon"), bounds, width, height)
    return points.withColumn("x", x).withColumn("y", y).join(surface.select("x", "y", value), ["x", "y"], "left")


def area_edges(surface: DataFrame, value: str, cutoff: int) -> DataFrame:
    """Directed edges around the cells within the cutoff, interior on the left: those whose neighbour isn't within."""
    inside = surface.where(F.col(value) <= cutoff).select("x", "y")
    sides = F.array(
        *[
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), (F.col("x") + a).alias("x1"), (F.col("y") + b).alias("y1"), (F.col("x") + c).alias("x2"), (F.col("y") + d).alias("y2"))
            for dx, dy, a, b, c, d in ((0, -1, 1, 0, 0, 0), (-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0))
        ]
    )
    edges = inside.select("x", "y", F.explode(sides).alias("e"))
    edges = edges.select((F.col("x") + F.col("e.dx")).alias("x"), (F.col("y") + F.col("e.dy")).alias("y"), "e.x1", "e.y1", "e.x2", "e.y2")
    return edges.join(inside, ["x", "y"], "left_anti").select("x1", "y1", "x2", "y2")


def rings(edges: DataFrame) -> DataFrame:
    """Edges put together to rings: ring, its points in order, and whether it is a hole. Where two corners touch, a ring stays with its cell.

    Every edge doubles the stretch that it knows of its ring, so rounds grow with the logarithm of a ring's length;
    a ring is named after its least edge and begins there.
    """
    name = (F.col("y1").cast("long") * 100_000 + F.col("x1")) * 10 + (F.col("x2") - F.col("x1") + 1) * 3 + F.col("y2") - F.col("y1") + 1
    given = materialize(edges.withColumn("id", name))
    other = given.select(F.col("id").alias("next"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"))
    turn = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y2")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x2"))
    w = Window.partitionBy("id").orderBy(turn)
    following = given.join(other, ["x2", "y2"]).withColumn("rank", F.row_number().over(w)).where("rank = 1").select("id", "next")
    # The least edge ahead within 2^k steps, and the edge 2^k steps ahead.
    known = materialize(following.select("id", F.col("next").alias("to"), F.least("id", "next").alias("ring")))
    while True:
        ahead = known.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("ring").alias("then"))
        step = materialize(known.join(ahead, "to").select("id", F.col("further").alias("to"), F.least("ring", "then").alias("ring"), (F.col("then") < F.col("ring")).alias("new")))
        known = step.drop("new")
        if not step.where("new").limit(1).count():
            break
    # The ring is cut before its least edge; an edge's place is told by its steps to the end.
    named = known.select("id", "ring")
    end = F.when(F.col("next") != F.col("ring"), F.col("next"))
    left = materialize(following.join(named, "id").select("id", "ring", end.alias("to"), F.when(end.isNull(), 0).otherwise(1).cast("long").alias("steps")))
    while left.where("to IS NOT NULL").limit(1).count():
        ahead = left.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        left = materialize(left.join(ahead, "to", "left").select("id", "ring", F.col("further").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    placed = left.join(given, "id").withColumn("twice", F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    point = F.struct((-F.col("steps")).alias("place"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    found = placed.groupBy("ring").agg(F.sort_array(F.collect_list(point)).alias("p"), (F.sum("twice") > 0).alias("hole"))
    return found.select("ring", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"), "hole")


def contour_segments(surface: DataFrame, value: str, level: float) -> DataFrame:
    """Marching squares over the cells' centers: where the level crosses the sides of every full square of four cells."""
    at = lambda dx, dy, name: surface.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col(value).cast("double").alias(name))
    squares = at(0, 0, "a").join(at(1, 0, "b"), ["x", "y"]).join(at(1, 1, "c"), ["x", "y"]).join(at(0, 1, "d"), ["x", "y"])
    corners = (("a", "b", 0, 0, 1, 0), ("b", "c", 1, 0, 1, 1), ("c", "d", 1, 1, 0, 1), ("d", "a", 0, 1, 0, 0))
    crossings = []
    for p, q, x1, y1, x2, y2 in corners:
        t = (level - F.col(p)) / (F.col(q) - F.col(p))
        crosses = (F.col(p) <= level) != (F.col(q) <= level)
        crossings.append(F.when(crosses, F.struct((F.col("x") + x1 + t * (x2 - x1)).alias("px"), (F.col("y") + y1 + t * (y2 - y1)).alias("py"))))
    points = F.filter(F.array(*crossings), lambda p: p.isNotNull())
    found = squares.select("x", "y", points.alias("p")).where(F.size("p") >= 2)
    pair = lambda i: F.struct(F.col("p")[i].alias("s"), F.col("p")[i + 1].alias("e"))
    segments = F.when(F.size("p") == 4, F.array(pair(0), pair(2))).otherwise(F.array(pair(0)))
    rounded = [F.round(F.col(f"g.{s}.{c}"), 6).alias(n) for s, c, n in (("s", "px", "x1"), ("s", "py", "y1"), ("e", "px", "x2"), ("e", "py", "y2"))]
    return found.select("x", "y", F.explode(segments).alias("g")).select("x", "y", *rounded)


# ---- Monte Carlo -----------------------------------------------------------------------------------

def phases(services: DataFrame, samples: int, seed: int) -> DataFrame:
    """One uniform phase below the headway for every service and sample, from a hash of seed, sample and service."""
    drawn = services.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return drawn.withColumn("phase", F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col("service_id"))), F.col("headway")).cast("int"))


def coordinated(drawn: DataFrame, links: DataFrame) -> DataFrame:
    """Services coordinated with a parent take its phase of the sample plus an offset."""
    parents = drawn.select(F.col("service_id").alias("parent_id"), "sample", F.col("phase").alias("parent_phase"))
    rows = drawn.join(links, "service_id", "left").join(parents, ["parent_id", "sample"], "left")
    return rows.select("service_id", "sample", F.coalesce(F.pmod(F.col("parent_phase") + F.col("offset"), F.col("headway")), F.col("phase")).cast("int").alias("phase"))


def sampled_departures(drawn: DataFrame, start: int, end: int) -> DataFrame:
    """Departures of every sample: phase, phase + headway, ... in [start, end)."""
    return drawn.select("service_id", "sample", F.explode(F.sequence(F.lit(start) + F.col("phase"), F.lit(end - 1), F.col("headway"))).alias("departure"))
