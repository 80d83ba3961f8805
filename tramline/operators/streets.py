"""Street graphs: bounded shortest paths, traffic weights and road attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators.shared import materialize, maybe_broadcast


def shortest_paths(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """G1: least cost of every (source, node) within the limit; each round relaxes the edges of what has improved, until nothing does.

    edges: u, v, cost (not negative, so that the rounds end). seeds: source, node, cost. A round's frontier is broadcast if it is small by count.
    """
    best = materialize(seeds.select("source", "node", F.col("cost").cast("long").alias("cost")))
    frontier = best
    weights = materialize(edges.groupBy("u", "v").agg(F.min("cost").cast("long").alias("w")))
    if weights.where("w < 0").limit(1).count():
        raise ValueError("an edge's cost is negative")
    while True:
        ahead = weights.join(maybe_broadcast(frontier.withColumnRenamed("node", "u")), "u")
        found = ahead.groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("cost")).where(F.col("cost") <= limit)
        known = best.withColumnRenamed("cost", "old")
        frontier = materialize(found.join(known, ["source", "node"], "left").where("old IS NULL OR cost < old").select("source", "node", "cost"))
        if not frontier.limit(1).count():
            return best
        best = materialize(best.unionByName(frontier).groupBy("source", "node").agg(F.min("cost").alias("cost")))


def apply_traffic(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Weights after observations: a factor or a speed, never faster than the base; of overlapping ones the slowest; closed edges go.

    updates: u, v, and one of factor, kmh, closed. edges: u, v, metres, seconds.
    """
    own = updates.join(edges, ["u", "v"])
    slow = F.greatest(F.col("seconds"), F.coalesce(F.ceil(F.col("seconds") * F.col("factor")), F.ceil(F.col("metres") * 3.6 / F.col("kmh")), F.col("seconds")))
    merged = own.groupBy("u", "v").agg(F.max(slow).cast("long").alias("slow"), F.max(F.coalesce("closed", F.lit(False))).alias("closed"))
    rows = edges.join(merged, ["u", "v"], "left").where("NOT coalesce(closed, false)")
    return rows.select("u", "v", "metres", F.coalesce("slow", F.col("seconds").cast("long")).alias("seconds"))


def attach(points: DataFrame, edges: DataFrame, max_km: float) -> DataFrame:
    """The nearest edge of each point within reach. Edges and points meet by grid cell.

    points: point_id, lat, lon. edges: u, v, lat1, lon1, lat2, lon2.
    """
    cell = 0.01
    reach = int(max_km / (111.19 * cell * 0.5)) + 1
    ends = F.array(F.floor(F.col("lat1") / cell), F.floor(F.col("lat2") / cell)), F.array(F.floor(F.col("lon1") / cell), F.floor(F.col("lon2") / cell))
    spans = lambda c, pad: F.explode(F.sequence(F.array_min(c) - pad, F.array_max(c) + pad))
    placed = edges.withColumn("y", spans(ends[0], reach)).withColumn("x", spans(ends[1], reach))
    asked = points.withColumn("y", F.floor(F.col("lat") / cell)).withColumn("x", F.floor(F.col("lon") / cell))
    km = geo.segment_km(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")])
    pairs = asked.join(placed, ["y", "x"]).select("point_id", "u", "v", km.alias("km")).where(F.col("km") <= max_km)
    return pairs.groupBy("point_id").agg(F.min(F.struct(F.round("km", 6).alias("km"), "u", "v")).alias("b")).select("point_id", "b.u", "b.v", "b.km")


def path_surface(paths: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Earliest time at the far end of each reached directed edge."""
    return paths.withColumnRenamed("node", "u").join(edges, "u").select("source", "u", "v", (F.col("cost") + F.col("seconds")).alias("cost")).where(F.col("cost") <= limit)


def monotone_alignment(costs: DataFrame) -> DataFrame:
    """Of each (shape, stop) the shape point that a monotone alignment of least cost takes.

    costs: shape_id, stop_no, point_no, cost. Dynamic programming with prefix minima, folded by an aggregate over the stops of a shape.
    """
    rows = costs.groupBy("shape_id", "stop_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("point_no", "cost"))), lambda x: x["cost"]).alias("c"))
    shapes = rows.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop_no", "c"))), lambda x: x["c"]).alias("m"))

    def python(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = {"shape_id": [], "stop_no": [], "point_no": []}
            for shape, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cost = np.array(m, dtype=float)
                total, back = cost[0].copy(), []
                for row in cost[1:]:
                    prefix = np.minimum.accumulate(total)
                    first = np.maximum.accumulate(np.where(total <= prefix, np.arange(len(total)), 0))
                    back.append(first)
                    total = prefix + row
                at = int(total.argmin())
                taken = [at]
                for first in reversed(back):
                    at = int(first[at])
                    taken.append(at)
                out["shape_id"] += [shape] * len(taken)
                out["stop_no"] += range(len(taken))
                out["point_no"] += reversed(taken)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("shape_id", batch.schema.field(0).type), ("stop_no", pa.int32()), ("point_no", pa.int32())]))

    return shapes.mapInArrow(python, f"shape_id {costs.schema['shape_id'].dataType.simpleString()}, stop_no int, point_no int")


def cumulative_shape(points: DataFrame) -> DataFrame:
    """Distance along a shape up to each of its points."""
    w = Window.partitionBy("shape_id").orderBy("point_no")
    step = geo.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("km", F.sum("step").over(w)).drop("step")
