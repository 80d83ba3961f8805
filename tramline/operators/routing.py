"""Earliest arrivals, latest departures, matrices and trade-offs by boarding rounds.

A round boards every run at the calls that a label of the round before allows, rides it to its later calls, and
walks at most one transfer. Labels carry the origin, so many origins share a round; the kind of label (origin,
ride, transfer) decides when it is ready to board. A label is kept if none of its kind at its stop, of this or
an earlier round, arrives no later with no more walking; without `skyline` just the least arrival is kept.
Each round is one table in the shared folder; rounds end when nothing improves or at the cap of boardings.

Only labels that can still improve a stop go into the next round, so a round's work follows the frontier. A run
is one row with its calls, so a round joins the frontier to the boardable calls and the boarded runs to their
rows. A frontier that is small by count is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.shared import materialize, maybe_broadcast, size

DAY = 86400


#: Pairs of a matrix.
MOST_PAIRS = 65_536


@dataclass(frozen=True)
class Options:
    same_stop: int = 120
    buffer: int = 60
    horizon: int = DAY
    boardings: int = 3
    post_walk: bool = True
    #: Walk a transfer before the first ride.
    pre_walk: bool = False
    #: Seconds between the arrival and the time by which one must be there.
    reserve: int = 0
    #: Keep labels that arrive later with less walking.
    skyline: bool = True
    #: Labels carry their legs.
    legs: bool = False


LEG = "struct<mode: string, run: string, from_stop: string, to_stop: string, departure: bigint, arrival: bigint>"


def prepare(conns: DataFrame) -> DataFrame:
    """Connections with a run: here a trip is a run unless it already has one."""
    run = F.concat_ws("#", "trip_id", F.col("run").cast("string")) if "run" in conns.columns else F.col("trip_id")
    return conns.select(
        run.alias("run"), "stop_sequence", "from_stop_id", "to_stop_id", F.col("departure").cast("long"), F.col("arrival").cast("long"), "can_board", "can_alight"
    )


def seeds(origins: DataFrame) -> DataFrame:
    """Labels of round 0: origin_id, stop_id, arrival and walking of the stops that can be boarded; walking, if origins have it, is that of the access."""
    walking = F.col("walking").cast("long") if "walking" in origins.columns else F.lit(0).cast("long")
    return origins.select("origin_id", "stop_id", F.col("arrival").cast("long").alias("arrival"), walking.alias("walking"), F.lit("origin").alias("kind"))


def access(points: DataFrame, stops: DataFrame, limit_km: float) -> DataFrame:
    """Origins for `labels`: the stops within a walk of each point (origin_id, lat, lon, departure), reached on foot."""
    from tramline.operators import transfers

    near = transfers.near_points(points, stops, limit_km)
    seconds = transfers.walk_seconds(F.col("km")).cast("long")
    return near.select("origin_id", "stop_id", (F.col("departure").cast("long") + seconds).alias("arrival"), seconds.alias("walking"))


def ready(opt: Options, minimum=None):
    """When a label may board: an origin at once, a ride after the stop's own minimum (without one the general) and the buffer, a transfer after the buffer."""
    least = F.lit(opt.same_stop) if minimum is None else F.coalesce(minimum, F.lit(opt.same_stop))
    return F.col("arrival") + F.when(F.col("kind") == "ride", least + opt.buffer).when(F.col("kind") == "transfer", opt.buffer).otherwise(0)


def leg(mode: str, run, from_stop, to_stop, departure, arrival):
    return F.array(F.struct(F.lit(mode).alias("mode"), run.alias("run"), from_stop.cast("string").alias("from_stop"), to_stop.cast("string").alias("to_stop"), departure.alias("departure"), arrival.alias("arrival"))).cast(f"array<{LEG}>")


def _path(opt: Options) -> list[str]:
    return ["path"] if opt.legs else []


@dataclass(frozen=True)
class Network:
    """What every round reads, written once: the calls that can be boarded, a row for each run with its calls, and a row for each stop with its walks."""

    board: DataFrame
    runs: DataFrame
    walks: DataFrame
    minima: DataFrame | None

    @classmethod
    def of(cls, conns: DataFrame, transfers: DataFrame, opt: Options, minima: DataFrame | None = None) -> Network:
        """minima: stop_id, minimum seconds between two rides there (null: the general one), and forbidden where none may be made."""
        calls = materialize(prepare(conns).where(F.col("departure") <= opt.horizon))
        call = F.struct("stop_sequence", "to_stop_id", "arrival", "can_alight")
        runs = materialize(calls.groupBy("run").agg(F.sort_array(F.collect_list(call)).alias("calls")))
        walk = F.struct("to_stop_id", F.col("seconds").cast("long").alias("seconds"))
        walks = materialize(transfers.groupBy(F.col("from_stop_id").alias("stop_id")).agg(F.sort_array(F.collect_list(walk)).alias("walks")))
        board = calls.where("can_board").select("from_stop_id", "run", "stop_sequence", "departure")
        return cls(board, runs, maybe_broadcast(walks), None if minima is None else maybe_broadcast(minima))


def walked(rides: DataFrame, net: Network, opt: Options, keep: str = "ride") -> DataFrame:
    """Labels as they are (kind keep), and after one transfer."""
    own = F.array(F.struct(F.col("stop_id").alias("to_stop_id"), F.lit(0).cast("long").alias("seconds")))
    # The first is the label itself.
    on = rides.join(net.walks, "stop_id", "left").select("*", F.posexplode(F.concat(own, F.coalesce("walks", F.slice(own, 1, 0)))).alias("at", "to"))
    arrival = F.col("arrival") + F.col("to.seconds")
    columns = [F.col("to.to_stop_id").alias("stop_id"), arrival.alias("arrival"), (F.col("walking") + F.col("to.seconds")).alias("walking"), F.when(F.col("at") == 0, keep).otherwise("transfer").alias("kind")]
    if opt.legs:
        walk = leg("walk", F.lit(None), F.col("stop_id"), F.col("to.to_stop_id"), F.col("arrival"), arrival)
        columns.append(F.when(F.col("at") == 0, F.col("path")).otherwise(F.concat("path", walk)).alias("path"))
    return on.select("origin_id", *columns)


def ride_round(net: Network, frontier: DataFrame, opt: Options) -> DataFrame:
    """Ride labels of every (origin, stop) that one more boarding reaches."""
    minimum = None
    if net.minima is not None:
        frontier = frontier.join(net.minima, "stop_id", "left").where("kind <> 'ride' OR NOT coalesce(forbidden, false)")
        minimum = F.col("minimum")
    at = frontier.select("origin_id", F.col("stop_id").alias("from_stop_id"), ready(opt, minimum).alias("ready"), "walking", *_path(opt))
    boarding = F.struct(F.col("stop_sequence").alias("seq"), "walking", *([F.col("from_stop_id").alias("stop"), "departure", "path"] if opt.legs else []))
    boarded = net.board.join(at, "from_stop_id").where("departure >= ready").groupBy("origin_id", "run")
    # Of equal boardings the least walking; aboard, what counts at a call is the least walking of the boardings up to it.
    rides = boarded.agg(F.collect_set(boarding).alias("boardings")).join(net.runs, "run")
    calls = rides.select("origin_id", "run", F.explode("calls").alias("c"), "boardings").where("c.can_alight")
    usable = F.filter("boardings", lambda x: x["seq"] <= F.col("c.stop_sequence"))
    best = F.array_min(F.transform(usable, lambda x: F.struct(x["walking"].alias("walking"), (-x["seq"]).alias("late"), *([x["stop"].alias("stop"), x["departure"].alias("departure"), x["path"].alias("path")] if opt.legs else []))))
    reached = calls.select("origin_id", "run", F.col("c.to_stop_id").alias("stop_id"), F.col("c.arrival").alias("arrival"), best.alias("b")).where("b IS NOT NULL")
    if not opt.legs and not opt.skyline:
        # Just the least counts, and a walk from it is the least after that walk: the others needn't walk at all.
        least = F.min(F.struct("arrival", F.col("b.walking").alias("walking"))).alias("least")
        return reached.groupBy("origin_id", "stop_id").agg(least).select("origin_id", "stop_id", "least.*")
    if not opt.legs:
        return reached.groupBy("origin_id", "stop_id", "arrival").agg(F.min("b.walking").alias("walking"))
    path = F.concat("b.path", leg("ride", F.col("run"), F.col("b.stop"), F.col("stop_id"), F.col("b.departure"), F.col("arrival")))
    rows = reached.select("origin_id", "stop_id", "arrival", F.struct("b.walking", path.alias("path")).alias("b"))
    return rows.groupBy("origin_id", "stop_id", "arrival").agg(F.min("b").alias("b")).select("origin_id", "stop_id", "arrival", "b.*")


KEYS = ("origin_id", "stop_id", "kind")


def improving(found: DataFrame, best: DataFrame | None, k: int, opt: Options) -> DataFrame:
    """The labels of round k that none of its kind, of this or an earlier round, is as good as."""
    columns = [*KEYS, "arrival", "walking", "boardings", *_path(opt)]
    rows = found.withColumn("boardings", F.lit(k)).select(*columns)
    if not opt.skyline:
        label = F.struct("arrival", "walking", "boardings", *_path(opt))
        least = rows.groupBy(*KEYS).agg(F.min(label).alias("b")).select(*KEYS, "b.*")
        rows = least.select(*columns)
        if best is None:
            return rows
        old = F.min(F.when(F.col("boardings") < k, F.struct("arrival", "walking"))).alias("old")
        new = F.min(F.when(F.col("boardings") == k, label)).alias("new")
        both = best.unionByName(rows).groupBy(*KEYS).agg(old, new)
        return both.where("new IS NOT NULL AND (old IS NULL OR struct(new.arrival, new.walking) < old)").select(*KEYS, "new.*").select(*columns)
    order = Window.partitionBy(*KEYS).orderBy("arrival", "walking", "boardings", *_path(opt)).rowsBetween(Window.unboundedPreceding, -1)
    every = rows if best is None else best.unionByName(rows)
    before = every.withColumn("before", F.min("walking").over(order))
    return before.where((F.col("boardings") == k) & (F.col("before").isNull() | (F.col("walking") < F.col("before")))).select(*columns)


def labels(conns: DataFrame, transfers: DataFrame, origins: DataFrame, opt: Options = Options(), minima: DataFrame | None = None) -> DataFrame:
    """every improving label (origin_id, stop_id, kind, arrival, walking, boardings) up to the cap."""
    net = Network.of(conns, transfers, opt, minima)
    frontier = seeds(origins)
    if opt.legs:
        frontier = frontier.withColumn("path", F.array().cast(f"array<{LEG}>"))
    if opt.pre_walk:
        frontier = walked(frontier, net, opt, "origin")
    frontier, best = maybe_broadcast(frontier), None
    for k in range(1, opt.boardings + 1):
        improved = materialize(improving(walked(ride_round(net, frontier, opt), net, opt), best, k, opt))
        best = improved if best is None else best.unionByName(improved)
        n, small = size(improved)
        if not n:
            break
        frontier = F.broadcast(improved) if small else improved
    return best


def earliest(found: DataFrame, opt: Options = Options()) -> DataFrame:
    """Of each (origin, stop) the least arrival, then boardings, then walking. Without post-ride walks only rides count."""
    rows = found if opt.post_walk else found.where("kind = 'ride'")
    best = rows.groupBy("origin_id", "stop_id").agg(F.min(F.struct("arrival", "boardings", "walking")).alias("b"))
    return best.select("origin_id", "stop_id", "b.arrival", "b.boardings", "b.walking")


def pareto(found: DataFrame) -> DataFrame:
    """Labels of a stop that no other beats in arrival, boardings and walking together.

    In the order of arrival a label is beaten if one before it has no more boardings and no more walking: the
    least walking so far for each number of boardings says so, and those numbers are few.
    """
    rows = found.groupBy("origin_id", "stop_id", "arrival", "boardings").agg(F.min("walking").alias("walking"))
    w = Window.partitionBy("origin_id", "stop_id").orderBy("arrival", "boardings").rowsBetween(Window.unboundedPreceding, -1)
    most = found.agg(F.max("boardings")).first()[0] or 0
    least = [F.min(F.when(F.col("boardings") <= k, F.col("walking"))).over(w).alias(f"w{k}") for k in range(most + 1)]
    beaten = F.lit(False)
    for k in range(most + 1):
        beaten = beaten | ((F.col("boardings") == k) & F.coalesce(F.col(f"w{k}") <= F.col("walking"), F.lit(False)))
    return rows.select("*", *least).where(~beaten).select("origin_id", "stop_id", "arrival", "boardings", "walking")


def generalized(options: DataFrame, transfer_penalty: int = 300, walk_reluctance: float = 2.0) -> DataFrame:
    """Options with one cost: the arrival, a penalty for every boarding after the first, and walking that counts more than riding."""
    cost = F.col("arrival") + transfer_penalty * F.greatest(F.col("boardings") - 1, F.lit(0)) + F.round((walk_reluctance - 1) * F.col("walking")).cast("long")
    return options.withColumn("cost", cost)


def ranked(options: DataFrame, most: int = 9, slack: int = 900) -> DataFrame:
    """Distinct options within the slack of the best arrival, by arrival, walking, boardings."""
    w = Window.partitionBy("origin_id", "stop_id").orderBy("arrival", "walking", "boardings")
    best = F.min("arrival").over(Window.partitionBy("origin_id", "stop_id"))
    rows = options.select("origin_id", "stop_id", "arrival", "boardings", "walking").distinct().withColumn("best", best)
    return rows.where(F.col("arrival") <= F.col("best") + slack).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("best")


def bounded_choice(options: DataFrame) -> DataFrame:
    """T4: the best option, the one with fewest boardings and the one with least walking of every pair."""
    by = lambda name, *order: options.withColumn("k", F.row_number().over(Window.partitionBy("origin_id", "stop_id").orderBy(*order))).where("k = 1").drop("k").withColumn("role", F.lit(name))
    return (
        by("best", "arrival", "boardings", "walking")
        .unionByName(by("fewest_boardings", "boardings", "arrival", "walking"))
        .unionByName(by("least_walking", "walking", "arrival", "boardings"))
    )


def mirrored(conns: DataFrame, horizon: int) -> DataFrame:
    """The timetable with time reversed: an arrive-by search is a depart-at search on it."""
    sequence = -F.col("stop_sequence")
    return conns.select(
        *[c for c in ("trip_id", "run") if c in conns.columns],
        sequence.alias("stop_sequence"),
        F.col("to_stop_id").alias("from_stop_id"),
        F.col("from_stop_id").alias("to_stop_id"),
        (horizon - F.col("arrival")).alias("departure"),
        (horizon - F.col("departure")).alias("arrival"),
        F.col("can_alight").alias("can_board"),
        F.col("can_board").alias("can_alight"),
    )


def latest_departures(conns: DataFrame, transfers: DataFrame, destinations: DataFrame, opt: Options = Options()) -> DataFrame:
    """Latest departure from every stop that reaches the destination by its deadline, then boardings, walking."""
    back = transfers.select(F.col("to_stop_id").alias("from_stop_id"), F.col("from_stop_id").alias("to_stop_id"), "seconds")
    at = destinations.select(F.col("destination_id").alias("origin_id"), "stop_id", (opt.horizon - F.col("deadline") + opt.reserve).alias("arrival"))
    found = earliest(labels(mirrored(conns, opt.horizon), back, at, opt), opt)
    return found.select(F.col("origin_id").alias("destination_id"), "stop_id", (opt.horizon - F.col("arrival")).alias("departure"), "boardings", "walking")


def matrix(conns: DataFrame, transfers: DataFrame, origins: DataFrame, destinations: DataFrame, departure: int, opt: Options = Options()) -> DataFrame:
    """Seconds of every asked pair, null where unreachable; equal endpoints are searched once. More than MOST_PAIRS pairs are refused."""
    if origins.limit(MOST_PAIRS + 1).count() * destinations.limit(MOST_PAIRS + 1).count() > MOST_PAIRS:
        raise ValueError(f"a matrix has at most {MOST_PAIRS} pairs")
    asked = origins.select("origin_id", F.col("stop_id").alias("from_stop")).crossJoin(destinations.select("destination_id", F.col("stop_id").alias("to_stop")))
    start = origins.select(F.col("stop_id").alias("origin_id"), "stop_id", F.lit(departure).alias("arrival")).distinct()
    found = earliest(labels(conns, transfers, start, opt), opt).select(F.col("origin_id").alias("from_stop"), F.col("stop_id").alias("to_stop"), (F.col("arrival") - departure).alias("seconds"))
    return asked.join(found, ["from_stop", "to_stop"], "left").select("origin_id", "destination_id", "seconds")


def walk_or_ride(rides: DataFrame, walks: DataFrame) -> DataFrame:
    """A direct walk wins where it takes no longer than transit."""
    both = rides.join(walks.withColumnRenamed("seconds", "walk_seconds"), ["origin_id", "destination_id"], "full")
    walks_win = F.col("walk_seconds").isNotNull() & (F.col("seconds").isNull() | (F.col("walk_seconds") <= F.col("seconds")))
    return both.select(
        "origin_id", "destination_id", F.when(walks_win, F.col("walk_seconds")).otherwise(F.col("seconds")).alias("seconds"), F.when(walks_win, "walk").otherwise("transit").alias("mode")
    )


def earliest_boardable(conns: DataFrame, asks: DataFrame) -> DataFrame:
    """Of each (stop, ready) the first departure at or after it, as an as-of join: both sides' distinct times in falling order, the next departure carried along.

    Time falls so that the frame grows at its end: one that ends with the partition is computed anew for every row. A
    stop has a row for each distinct time, however many ask at it.
    """
    asked = asks.select(F.col("ask_id").cast("long").alias("ask_id"), "stop_id", "ready")
    leaves = conns.where("can_board").select(F.col("from_stop_id").alias("stop_id"), F.col("departure").alias("ready"), F.lit(True).alias("leaves"))
    times = leaves.unionByName(asked.select("stop_id", "ready", F.lit(False).alias("leaves"))).groupBy("stop_id", "ready").agg(F.max("leaves").alias("leaves"))
    w = Window.partitionBy("stop_id").orderBy(F.desc("ready")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = times.withColumn("departure", F.min(F.when(F.col("leaves"), F.col("ready"))).over(w)).drop("leaves")
    return asked.join(found, ["stop_id", "ready"], "left").select("ask_id", "stop_id", "ready", "departure")


def last_before(conns: DataFrame, asks: DataFrame) -> DataFrame:
    """Of each (stop, ready) the last departure at or before it."""
    rows = (
        conns.select(F.col("from_stop_id").alias("stop_id"), F.col("departure").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("ask_id"))
        .distinct()
        .unionByName(asks.select("stop_id", F.col("ready").alias("t"), F.lit(1).alias("side"), F.col("ask_id").cast("long").alias("ask_id")))
    )
    w = Window.partitionBy("stop_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("departure", F.last(F.when(F.col("side") == 0, F.col("t")), ignorenulls=True).over(w))
    return found.where("side = 1").select("ask_id", "stop_id", F.col("t").alias("ready"), "departure")


def at_stops(conns: DataFrame, rows: list[tuple], origin: str) -> DataFrame:
    """Origins (origin_id of the type origin, stop_id of the timetable's type, arrival) of a few rows."""
    kind = conns.schema["from_stop_id"].dataType.simpleString()
    return conns.sparkSession.createDataFrame([(str(o), str(s), a) for o, s, a in rows], "origin_id string, stop_id string, arrival long").select(
        F.col("origin_id").cast(kind if origin == "stop" else origin).alias("origin_id"), F.col("stop_id").cast(kind).alias("stop_id"), "arrival"
    )


def windows(conns: DataFrame, transfers: DataFrame, stop_id, departures: list[int], opt: Options = Options()) -> DataFrame:
    """One search over many departures from a stop: each is an origin of its own. arrival by departure and stop."""
    origins = at_stops(conns, [(t, stop_id, t) for t in departures], "int")
    return earliest(labels(conns, transfers, origins, opt), opt).withColumnRenamed("origin_id", "departure_at")


def through_via(conns: DataFrame, transfers: DataFrame, origin, via, departure: int, opt: Options = Options()) -> DataFrame:
    """First to the via stop, then on from its arrival."""
    first = labels(conns, transfers, at_stops(conns, [(origin, origin, departure)], "stop"), opt)
    at = earliest(first, opt).where(F.col("stop_id").cast("string") == str(via)).select("origin_id", "stop_id", "arrival")
    return earliest(labels(conns, transfers, at, opt), opt)


def aligned_rides(conns: DataFrame) -> DataFrame:
    """Trips by their hash of ordered (from, to, board, alight): those of one group serve the same calls."""
    calls = F.array_sort(F.collect_list(F.struct("stop_sequence", "from_stop_id", "to_stop_id", "can_board", "can_alight")))
    return conns.groupBy("trip_id").agg(calls.alias("c"), F.min("departure").alias("departure")).select(
        "trip_id", "departure", F.sha2(F.to_json(F.transform("c", lambda x: F.struct(x["from_stop_id"].alias("f"), x["to_stop_id"].alias("t"), x["can_board"].alias("b"), x["can_alight"].alias("a")))), 256).alias("path")
    )


def journeys(conns: DataFrame, transfers: DataFrame, origins: DataFrame, opt: Options = Options()) -> DataFrame:
    """The legs of the best journey from every origin to every stop: labels carry them, so nothing is searched back."""
    found = labels(conns, transfers, origins, replace(opt, legs=True))
    rows = found if opt.post_walk else found.where("kind = 'ride'")
    best = rows.groupBy("origin_id", "stop_id").agg(F.min(F.struct("arrival", "boardings", "walking", "path")).alias("b"))
    return best.select("origin_id", "stop_id", F.posexplode("b.path").alias("leg", "x")).select("origin_id", "stop_id", (F.col("leg") + 1).alias("leg"), "x.*")


def journey(conns: DataFrame, transfers: DataFrame, origin, destination, departure: int, opt: Options = Options()) -> DataFrame:
    """The legs of the best journey to one stop."""
    kind = conns.schema["from_stop_id"].dataType.simpleString()
    found = journeys(conns, transfers, at_stops(conns, [(origin, origin, departure)], "stop"), opt).where(F.col("stop_id").cast("string") == str(destination))
    return found.select("leg", "mode", "run", *[F.col(c).cast(kind).alias(f"{c}_id") for c in ("from_stop", "to_stop")], "departure", "arrival").orderBy("leg")
