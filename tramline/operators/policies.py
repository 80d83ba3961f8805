"""Smaller rules: permissions, weekly windows, caps, budgets, closures, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.measures import alert_severity, scope_of

WEEK_MINUTES = 10_080


def in_scopes(rows: DataFrame, column: str, scopes: list[str]) -> DataFrame:
    """Rows whose id belongs to one of the feeds."""
    return rows.where(scope_of(F.col(column)).isin(scopes))


def legal_boardings(conns: DataFrame) -> DataFrame:
    """Connections that may be boarded; riding through stays legal on the others."""
    return conns.where("can_board")


def wheelchair_connections(conns: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Connections of accessible trips, boarded and left only at accessible stops; 0 asks the parent."""
    own = F.when(F.col("wheelchair") == 0, F.col("parent_wheelchair")).otherwise(F.col("wheelchair"))
    parents = stops.select(F.col("stop_id").alias("parent_id"), F.col("wheelchair").alias("parent_wheelchair"))
    access = stops.join(parents, "parent_id", "left").select("stop_id", (F.coalesce(own, F.lit(0)) == 1).alias("ok"))
    side = lambda c, n: access.select(F.col("stop_id").alias(c), F.col("ok").alias(n))
    rows = conns.join(trips.where("wheelchair_accessible = 1").select("trip_id"), "trip_id", "left_semi")
    rows = rows.join(side("from_stop_id", "from_ok"), "from_stop_id", "left").join(side("to_stop_id", "to_ok"), "to_stop_id", "left")
    return rows.withColumns({"can_board": F.col("can_board") & F.coalesce("from_ok", F.lit(False)), "can_alight": F.col("can_alight") & F.coalesce("to_ok", F.lit(False))}).drop("from_ok", "to_ok")


def active_windows(windows: DataFrame, asks: DataFrame) -> DataFrame:
    """Whether an id is open at a minute of the week, half-open windows, and the minutes until that changes next."""
    w = windows.select("id", "start_minute", "end_minute")
    joined = asks.join(w, "id", "left")
    inside = (F.col("minute") >= F.col("start_minute")) & (F.col("minute") < F.col("end_minute"))
    wait = lambda c: F.pmod(F.col(c) - F.col("minute"), F.lit(WEEK_MINUTES))
    rolled = joined.groupBy("ask_id", "id", "minute").agg(
        F.coalesce(F.bool_or(inside), F.lit(False)).alias("active"),
        F.min(F.when(inside, F.col("end_minute") - F.col("minute"))).alias("until_end"),
        F.min(wait("start_minute")).alias("until_start"),
    )
    return rolled.select("ask_id", "active", F.when(F.col("active"), F.col("until_end")).otherwise(F.col("until_start")).alias("change_in"))


def capped(options: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first options of each key, with a flag on all of them where there were more."""
    rows = options.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("total", F.count("*").over(Window.partitionBy(*keys)))
    return rows.where(F.col("rank") <= most).withColumn("truncated", F.col("total") > most).drop("total")


def fair_budget(wishes: DataFrame, total: int) -> DataFrame:
    """Water-filling: all get their wish or the same level, the greatest that the total allows.

    By wishes in rising order, the level at a wish is what is left over those that want more.
    """
    upto = Window.partitionBy(F.lit(1)).orderBy("wish", "id").rowsBetween(Window.unboundedPreceding, -1)  # one row a feed
    rows = wishes.select("id", "wish", F.coalesce(F.sum("wish").over(upto), F.lit(0)).alias("before"), (F.count("*").over(Window.partitionBy(F.lit(1))) - F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("wish", "id")) + 1).alias("left"))
    level = F.floor((F.lit(total) - F.col("before")) / F.col("left"))
    first_short = F.min(F.when(F.col("wish") > level, F.struct(F.col("wish"), F.col("id"), level.alias("level")))).over(Window.partitionBy(F.lit(1)))
    return rows.select("id", F.least(F.col("wish"), F.coalesce(first_short["level"], F.col("wish"))).cast("long").alias("share"))


def largest_remainder(weights: DataFrame, total: int) -> DataFrame:
    """Proportional shares in whole units; what rounding leaves goes to the largest remainders."""
    sums = F.broadcast(weights.agg(F.sum("weight").alias("all")))  # one row
    exact = F.lit(total) * F.col("weight")
    rows = weights.crossJoin(sums).select("id", F.floor(exact / F.col("all")).alias("base"), (exact % F.col("all")).alias("rest"))
    given = F.broadcast(rows.agg((F.lit(total) - F.sum("base")).alias("spare")))  # one row
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), "id"))
    return rows.withColumn("rank", rank).crossJoin(given).select("id", (F.col("base") + (F.col("rank") <= F.col("spare")).cast("int")).cast("long").alias("share"))


def close_stops(conns: DataFrame, closures: DataFrame) -> DataFrame:
    """No boarding or alighting at a stop while a closure of it is in force; its end belongs to it.

    closures: stop_id, start, end, null for open bounds. A ride may still pass.
    """
    def hit(column: str, time: str) -> DataFrame:
        c = closures.select(F.col("stop_id").alias(column), "start", "end")
        rows = conns.join(c, column).where((F.col("start").isNull() | (F.col("start") <= F.col(time))) & (F.col("end").isNull() | (F.col(time) <= F.col("end"))))
        return rows.select("trip_id", "stop_sequence").distinct()

    no_board = hit("from_stop_id", "departure").withColumn("nb", F.lit(True))
    no_alight = hit("to_stop_id", "arrival").withColumn("na", F.lit(True))
    rows = conns.join(no_board, ["trip_id", "stop_sequence"], "left").join(no_alight, ["trip_id", "stop_sequence"], "left")
    return rows.withColumns({"can_board": F.col("can_board") & F.col("nb").isNull(), "can_alight": F.col("can_alight") & F.col("na").isNull()}).drop("nb", "na")


def delay_events(calls: DataFrame, now: int, window: int = 1800) -> DataFrame:
    """OP2, T6: calls of the last half hour with a delay worth telling, the worst first."""
    rows = calls.where((F.col("time") > now - window) & (F.col("time") <= now)).withColumn("severity", alert_severity(F.col("delay")))
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.where("severity <> 'none'").withColumn("order", rank).orderBy("order", F.desc("delay"), "trip_id", "time")


def trip_status(updates: DataFrame, predictions: DataFrame, departures: DataFrame, now: int, window: int = 1800) -> DataFrame:
    """OP2: of every update what it says of its trip, and the trip's next predicted departure within the window.

    updates: update_id, trip_id (null: no trip matches), day, relationship, fresh. predictions: update_id,
    stop_sequence, relationship, departure. departures: trip_id, day, stop_sequence, stop_id, scheduled. Updates that
    claim one trip and day, and predictions that claim one call, decide nothing.
    """
    claims = F.count("trip_id").over(Window.partitionBy("trip_id", "day"))
    kind = F.coalesce("relationship", F.lit("SCHEDULED"))
    status = (
        F.when(F.col("trip_id").isNull() | (claims > 1) | ~F.col("fresh"), "unresolved")
        .when(kind == "DELETED", "deleted")
        .when(kind == "CANCELED", "cancelled")
        .when(kind != "SCHEDULED", "unresolved")
        .otherwise("matched")
    )
    rows = updates.withColumn("status", status)
    soon = told_calls(rows, predictions, departures).where((F.col("told") == "SCHEDULED") & F.col("predicted").between(now, now + window))
    next_ = soon.groupBy("update_id").agg(F.min(F.struct("predicted", "stop_sequence", "stop_id", "scheduled")).alias("n"))
    return rows.join(next_, "update_id", "left").select(
        "update_id", "trip_id", "day", "status", F.col("n.stop_sequence").alias("next_sequence"), F.col("n.stop_id").alias("next_stop"), F.col("n.predicted").alias("predicted"), (F.col("n.predicted") - F.col("n.scheduled")).alias("delay")
    )


def told_calls(rows: DataFrame, predictions: DataFrame, departures: DataFrame) -> DataFrame:
    """What matched updates say of single calls (told: SCHEDULED or SKIPPED, ...), each said once."""
    said = predictions.groupBy("update_id", "stop_sequence").agg(F.count("*").alias("n"), F.first(F.coalesce("relationship", F.lit("SCHEDULED"))).alias("told"), F.first("departure").alias("predicted"))
    matched = rows.where("status = 'matched'").select("update_id", "trip_id", "day")
    return matched.join(said.where("n = 1").drop("n"), "update_id").join(departures, ["trip_id", "day", "stop_sequence"])


def trip_events(statuses: DataFrame, predictions: DataFrame, departures: DataFrame, now: int, window: int = 1800, fresh: int = 180) -> DataFrame:
    """OP2: what is worth telling: cancelled trips, calls that are skipped about now, and trips whose next departure is late."""
    nothing = [F.lit(None).cast("int").alias("stop_sequence"), F.lit(None).cast("long").alias("delay")]
    cancelled = statuses.where("status = 'cancelled'").select("update_id", F.lit("cancellation").alias("kind"), *nothing, F.lit("warning").alias("severity"))
    skipped = told_calls(statuses, predictions, departures).where((F.col("told") == "SKIPPED") & F.col("scheduled").between(now - fresh, now + window))
    skipped = skipped.select("update_id", F.lit("skipped-stop").alias("kind"), "stop_sequence", nothing[1], F.lit("warning").alias("severity"))
    severity = F.when(F.col("delay") >= 900, "critical").when(F.col("delay") >= 300, "warning").otherwise("info")
    late = statuses.where("delay > 0").select("update_id", F.lit("delay").alias("kind"), F.col("next_sequence").alias("stop_sequence"), "delay", severity.alias("severity"))
    return cancelled.unionByName(skipped).unionByName(late)


def next_prediction(calls: DataFrame, reports: DataFrame) -> DataFrame:
    """OP6: of each vehicle the delay at the stop it reports, and its next call after it."""
    at = calls.join(reports.select("trip_id", F.col("stop_sequence").alias("at")), "trip_id")
    rolled = at.groupBy("trip_id").agg(
        F.max(F.when(F.col("stop_sequence") == F.col("at"), F.col("delay"))).alias("delay_here"),
        F.min(F.when(F.col("stop_sequence") > F.col("at"), F.struct("stop_sequence", "stop_id", "departure"))).alias("n"),
    )
    return rolled.select("trip_id", "delay_here", F.col("n.stop_id").alias("next_stop"), F.col("n.departure").alias("next_departure"))


def preserved_trips(conns: DataFrame, day_offset: int, seconds: int) -> DataFrame:
    """Trips kept for a replacement service, moved by days (-3 to 3) and seconds."""
    if not -3 <= day_offset <= 3:
        raise ValueError("serviceDayOffset is -3 to 3")
    shift = day_offset * 86400 + seconds
    return conns.withColumns({"departure": F.col("departure") + shift, "arrival": F.col("arrival") + shift}).where("departure >= 0")


def journey_groups(legs: DataFrame) -> DataFrame:
    """OP18: journeys by the hash of their rides' routes and stops."""
    path = F.array_sort(F.collect_list(F.struct("leg", "route_id", "from_stop_id", "to_stop_id")))
    rows = legs.groupBy("journey_id").agg(path.alias("p"), F.min("departure").alias("departure"))
    signed = rows.withColumn("path", F.sha2(F.to_json("p"), 256))
    return signed.groupBy("path").agg(F.count("*").alias("journeys"), F.min("departure").alias("first_departure"))


def nearest_places(points: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """The nearest place of each point within a radius, by grid cells; ties by name."""
    from tramline.functions import geo

    cell = 0.01
    reach = int(radius_km / (111.19 * cell * 0.5)) + 1
    key = lambda c: F.floor(F.col(c) / cell)
    spread = F.sequence(F.lit(-reach), F.lit(reach))
    near = places.select("name", F.col("lat").alias("plat"), F.col("lon").alias("plon")).withColumn("dy", F.explode(spread)).withColumn("dx", F.explode(spread))
    near = near.withColumn("y", key("plat") + F.col("dy")).withColumn("x", key("plon") + F.col("dx"))
    pairs = points.withColumn("y", key("lat")).withColumn("x", key("lon")).join(near, ["y", "x"])
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    rows = pairs.select("point_id", "name", F.round(km, 6).alias("km")).where(F.col("km") <= radius_km)
    return rows.groupBy("point_id").agg(F.min(F.struct("km", "name")).alias("b")).select("point_id", "b.name", "b.km")
