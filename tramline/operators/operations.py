"""Live operations: freshness, identity, delays, headways, boards, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.measures import LEAST_CLOSER, spacing_alert
from tramline.operators import calendar as service_calendar
from tramline.operators.shared import maybe_broadcast

FRESH_SECONDS, FUTURE_SECONDS = 180, 60


def feed_state(feeds: DataFrame, now: int) -> DataFrame:
    """OP1, P6: error, unknown without a timestamp, stale or fresh."""
    age = F.lit(now) - F.col("timestamp")
    state = F.when(F.col("failed"), "error").when(F.col("timestamp").isNull(), "unknown").when(F.abs(age) > FRESH_SECONDS, "stale").otherwise("fresh")
    return feeds.withColumn("state", state)


def usable(records: DataFrame, now: int) -> DataFrame:
    """Records for routing with the reason where one is rejected; nothing is dropped in silence."""
    age = F.lit(now) - F.col("timestamp")
    reason = F.when(F.col("timestamp").isNull(), "no_timestamp").when(age > FRESH_SECONDS, "stale").when(-age > FUTURE_SECONDS, "future")
    return records.withColumn("reason", reason)


def resolve_identity(records: DataFrame, trips: DataFrame) -> DataFrame:
    """The scheduled trip of each record by raw id, route and direction where they're given; none or many are unmatched."""
    from tramline.functions.measures import local_id

    asked = records.select("record_id", F.col("raw_trip_id"), F.col("route_id").alias("asked_route"), F.col("direction_id").alias("asked_direction"))
    known = trips.select("trip_id", local_id(F.col("trip_id")).alias("raw_trip_id"), "route_id", "direction_id")
    found = asked.join(known, "raw_trip_id", "left").withColumn(
        "fits",
        F.col("trip_id").isNotNull()
        & (F.col("asked_route").isNull() | (F.col("asked_route") == F.col("route_id")))
        & (F.col("asked_direction").isNull() | (F.col("asked_direction") == F.col("direction_id"))),
    )
    counted = found.groupBy("record_id").agg(F.count_if("fits").alias("n"), F.max(F.when(F.col("fits"), F.col("trip_id"))).alias("trip_id"))
    return counted.select(
        "record_id", F.when(F.col("n") == 1, F.col("trip_id")).alias("trip_id"), F.when(F.col("n") == 0, "no_match").when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("status")
    )


def match_calls(updates: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The call of each update: by sequence, else by a stop that the trip serves once; if both are given they must agree."""
    calls = stop_times.select("trip_id", F.col("stop_sequence").alias("seq"), F.col("stop_id").alias("stop"))
    unique = calls.groupBy("trip_id", "stop").agg(F.count("*").alias("n"), F.min("seq").alias("only")).where("n = 1")
    by_seq = updates.join(calls, (updates["trip_id"] == calls["trip_id"]) & (updates["stop_sequence"] == calls["seq"]), "left").select(updates["*"], "seq", "stop")
    both = by_seq.join(unique.select(F.col("trip_id").alias("t"), F.col("stop").alias("s"), "only"), (F.col("trip_id") == F.col("t")) & (F.col("stop_id") == F.col("s")), "left")
    matched = F.when(F.col("stop_sequence").isNotNull(), F.when(F.col("stop_id").isNull() | (F.col("stop_id") == F.col("stop")), F.col("seq"))).otherwise(F.col("only"))
    return both.withColumn("matched_sequence", matched).drop("seq", "stop", "t", "s", "only")


def propagate_delays(calls: DataFrame) -> DataFrame:
    """Each call's delay: its own report, else the last known one of the trip; a call without data resets it.

    calls: trip_id, stop_sequence, delay (null: no report), no_data.
    """
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    blocks = calls.withColumn("block", F.sum(F.coalesce(F.col("no_data"), F.lit(False)).cast("int")).over(w))
    inside = Window.partitionBy("trip_id", "block").orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(F.when(~F.coalesce(F.col("no_data"), F.lit(False)), F.col("delay")), ignorenulls=True).over(inside)
    return blocks.withColumn("predicted_delay", carried).drop("block")


SERVICE = ("route_id", "direction_id", "stop_id", "day")


def headways(departures: DataFrame) -> DataFrame:
    """W7, OP3: reporting neighbours at a stop on a service day, with their scheduled and predicted interval.

    departures has every expected one, predicted null where nothing is reported. A pair counts if no other
    departure is expected from the first to the second. A predicted interval that isn't shorter counts only
    between neighbours in predicted order; a shorter one counts also if the order is reversed.
    """
    at, before = Window.partitionBy(*SERVICE).orderBy("scheduled"), Window.partitionBy(*SERVICE, "reports").orderBy("scheduled", "trip_id")
    # A trip may serve the stop twice and be predicted there at one time: its scheduled order decides.
    predicted = Window.partitionBy(*SERVICE, "reports").orderBy("predicted", "trip_id", "scheduled")
    rows = departures.select(
        *SERVICE, "trip_id", "scheduled", "predicted", F.col("predicted").isNotNull().alias("reports"),
        F.count("*").over(at).alias("upto"), F.rank().over(at).alias("first"),
    )
    pairs = rows.withColumn("place", F.row_number().over(predicted)).select(
        *SERVICE, F.lag("trip_id").over(before).alias("before"), "trip_id",
        (F.col("scheduled") - F.lag("scheduled").over(before)).alias("planned"),
        F.abs(F.col("predicted") - F.lag("predicted").over(before)).alias("actual"),
        (F.col("predicted") < F.lag("predicted").over(before)).alias("reversed"),
        (F.col("upto") - F.lag("first").over(before) + 1).alias("expected"),
        (F.col("place") - F.lag("place").over(before)).alias("moved"),
        "reports",
    )
    kept = pairs.where("reports AND planned > 0 AND expected = 2 AND (actual < planned OR moved = 1)")
    kind = F.when(F.col("actual") < F.col("planned"), "bunching").when(F.col("actual") > F.col("planned"), "gap").otherwise("matches")
    return kept.select(*SERVICE, "before", "trip_id", "planned", "actual", "reversed", kind.alias("kind"), spacing_alert(F.col("planned"), F.col("actual")).alias("severity"))


def reordered_bunching(departures: DataFrame) -> DataFrame:
    """Neighbours in predicted order between which others were expected, closer than the least interval planned there.

    A departure in between counts as accounted for if it reports (then it is outside the pair, as they're
    neighbours) or its vehicle has passed (column passed).

    An alert asks that the least interval is LEAST_CLOSER longer than the predicted one, so no interval between the
    two may be shorter than that: a pair meets only the departures of its stretch, which ends at a shorter interval
    and has as many departures as such intervals fit into the service day.
    """
    scheduled = Window.partitionBy(*SERVICE).orderBy("scheduled", "trip_id")
    predicted = Window.partitionBy(*SERVICE, "reports").orderBy("predicted", "trip_id", "scheduled")
    rows = departures.select(
        *SERVICE, "trip_id", "scheduled", "predicted", F.col("predicted").isNotNull().alias("reports"), "passed",
        (F.col("scheduled") - F.lag("scheduled").over(scheduled)).alias("interval"), (F.lead("scheduled").over(scheduled) - F.col("scheduled")).alias("next"),
    )
    rows = rows.withColumn("stretch", F.sum((F.coalesce("interval", F.lit(0)) < LEAST_CLOSER).cast("int")).over(scheduled.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Departures at one time are an interval of 0: none of them can be an end.
    alone = F.coalesce(F.col("interval") > 0, F.lit(True)) & F.coalesce(F.col("next") > 0, F.lit(True))
    mine = F.struct("scheduled", "trip_id", "stretch", alone.alias("alone"))
    pairs = rows.select(*SERVICE, mine.alias("x"), F.lag(mine).over(predicted).alias("y"), (F.col("predicted") - F.lag("predicted").over(predicted)).alias("actual"), "reports")
    pairs = pairs.where("reports AND x.stretch = y.stretch AND x.alone AND y.alone AND x.scheduled <> y.scheduled")
    pairs = pairs.select(*SERVICE, F.col("x.stretch").alias("stretch"), F.least("x", "y").alias("before"), F.greatest("x", "y").alias("after"), "actual")
    between = rows.where((F.col("interval") >= LEAST_CLOSER) | (F.col("next") >= LEAST_CLOSER)).select(*SERVICE, "stretch", "trip_id", "scheduled", "interval", (F.col("reports") | F.col("passed")).alias("known"))
    lo, hi = F.col("before.scheduled"), F.col("after.scheduled")
    met = pairs.join(between, [*SERVICE, "stretch"]).where((F.col("scheduled") >= lo) & (F.col("scheduled") <= hi))
    pair = F.col("trip_id").isin(F.col("before.trip_id"), F.col("after.trip_id"))
    found = met.groupBy(*SERVICE, "before", "after").agg(
        F.first("actual").alias("actual"), F.count("*").alias("expected"), F.bool_and(pair | F.col("known")).alias("known"),
        F.min(F.when(F.col("scheduled") > lo, F.col("interval"))).alias("planned"),  # the first's interval begins before it
    )
    severity = spacing_alert(F.col("planned"), F.col("actual"))
    kept = found.where("expected > 2 AND known AND actual < planned").withColumn("severity", severity).where("severity <> 'info'")
    return kept.select(*SERVICE, F.col("before.trip_id").alias("before"), F.col("after.trip_id").alias("trip_id"), "planned", "actual", "severity")


def stop_board(
    calls: DataFrame, days: DataFrame, stop_id, date: str, now: int, until: int, updates: DataFrame, predictions: DataFrame, most: int = 100, next_per_route: bool = False
) -> DataFrame:
    """OP4, W10, T5: arrivals and departures of a stop from now until a time, in seconds of the date; services of days before and of the next one count.

    calls: a trip's times at its stops; days: service_id and day. updates: update_id, trip_id, day, relationship,
    fresh, passed (the stop_sequence up to which the vehicle has passed, or null), at_stop (the one that it stands
    at). predictions: update_id, stop_sequence, skipped, arrival, departure (seconds of the date). Two updates of
    one trip and day decide nothing, and so do two predictions of a call; one that isn't fresh is stale.
    """
    here = calls.where(F.col("stop_id") == stop_id)
    offset = F.datediff(F.col("day"), F.to_date(F.lit(date))) * 86400
    # The calendar is asked for each service day: a trip of another day leaves then or not at all.
    run = here.join(days.where(F.col("day") <= F.date_add(F.to_date(F.lit(date)), 1)), "service_id").select(
        "route_id", "direction_id", "trip_id", "day", "stop_sequence", (F.col("arrival") + offset).alias("s_arrival"), (F.col("departure") + offset).alias("s_departure")
    )
    reports = updates.groupBy("trip_id", "day").agg(
        F.count("*").alias("reports"), *[F.first(c).alias(c) for c in ("update_id", "relationship", "fresh", "passed", "at_stop")]
    )
    told = predictions.groupBy("update_id", "stop_sequence").agg(
        F.count("*").alias("told"), F.first("skipped").alias("skipped"), F.first("arrival").alias("p_arrival"), F.first("departure").alias("p_departure")
    )
    rows = run.join(reports, ["trip_id", "day"], "left").join(told, ["update_id", "stop_sequence"], "left")
    one = (F.col("reports") == 1) & F.col("fresh")
    by_call = F.coalesce(one & (F.col("relationship").isNull() | (F.col("relationship") == "SCHEDULED")), F.lit(False))
    usable = by_call & (F.col("told") == 1) & ~F.coalesce("skipped", F.lit(False))
    rows = rows.withColumn("c_arrival", F.when(usable, F.col("p_arrival"))).withColumn("c_departure", F.when(usable, F.col("p_departure")))
    status = (
        F.when(F.col("reports") > 1, "unresolved")
        .when(~F.col("fresh"), "stale")
        .when(one & (F.col("relationship") == "CANCELED"), "cancelled")
        .when(one & ~by_call, "unresolved")
        .when(F.col("told") > 1, "unresolved")
        .when(by_call & F.col("skipped"), "skipped")
        .when(F.coalesce("c_arrival", "c_departure").isNotNull(), "live")
        .otherwise("scheduled")
    )
    expected = F.coalesce("c_arrival", "c_departure", "s_arrival", "s_departure")
    leaves = F.coalesce("c_departure", "c_arrival", "s_departure", "s_arrival")
    rows = rows.withColumn("status", status).withColumn("expected", expected)
    stands = F.coalesce(one & (F.col("at_stop") == F.col("stop_sequence")) & ~F.col("status").isin("cancelled", "skipped"), F.lit(False))
    gone = F.coalesce(one & ((F.col("relationship") == "DELETED") | (F.col("passed") >= F.col("stop_sequence"))), F.lit(False))
    rows = rows.withColumn("stands", stands).where(~gone & (F.col("expected") <= until) & (F.col("stands") | (leaves >= now)))
    order = [F.desc("stands"), "expected", "trip_id", "day", "stop_sequence"]
    if next_per_route:
        w = Window.partitionBy("route_id", "direction_id").orderBy(*order)
        rows = rows.where(~F.col("status").isin("cancelled", "skipped")).withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return rows.orderBy(*order).limit(most).select("route_id", "direction_id", "trip_id", "day", "stop_sequence", "expected", "status", "stands")


def service_windows(spans: DataFrame, start: int, end: int) -> DataFrame:
    """J9, OP8: trips that run inside a window, and for how long."""
    overlap = F.least(F.col("last_arrival"), F.lit(end)) - F.greatest(F.col("first_departure"), F.lit(start))
    return spans.withColumn("seconds", overlap).where("seconds > 0")


def route_operations(trips: DataFrame) -> DataFrame:
    """Trips, reporting trips, greatest delay and its severity by route."""
    from tramline.functions.measures import alert_severity

    rolled = trips.groupBy("route_id").agg(F.count("*").alias("trips"), F.count("delay").alias("reporting"), F.max("delay").alias("max_delay"))
    return rolled.withColumn("severity", alert_severity(F.coalesce("max_delay", F.lit(0))))


def coverage_status(scopes: DataFrame, calendar: DataFrame, exceptions: DataFrame, spans: DataFrame, date: int, now: int) -> DataFrame:
    """OP9: what the calendar of every source scope says about a date (yyyymmdd) at a time in seconds of it.

    calendar, exceptions and spans (a trip's service_id, first_departure, last_arrival) have a scope. Outside its
    dates a scope may still have a trip of an earlier day on the road.
    """
    bounds = service_calendar.coverage(calendar, exceptions, F.col("scope"))
    scope_of = calendar.select("scope", "service_id").unionByName(exceptions.select("scope", "service_id")).distinct()
    active = service_calendar.active_on(calendar, exceptions, date).join(scope_of, "service_id").select("scope").distinct().withColumn("active", F.lit(True))
    days = service_calendar.service_days(calendar, exceptions)
    ahead = F.datediff(F.to_date(F.lit(str(date)), "yyyyMMdd"), F.col("day")) * 86400 + now
    on_road = spans.join(days, "service_id").where((F.col("first_departure") < ahead + 1) & (F.col("last_arrival") > ahead)).select("scope").distinct().withColumn("on_road", F.lit(True))
    rows = scopes.join(bounds, "scope", "left").join(active, "scope", "left").join(on_road, "scope", "left")
    status = (
        F.when(F.col("first_date").isNull(), "unknown")
        .when((F.col("first_date") <= date) & (F.col("last_date") >= date), F.when(F.col("active"), "scheduled_service").otherwise("no_service_today"))
        .when(F.col("on_road"), "continuing_service")
        .otherwise("outside_dates")
    )
    return rows.select("scope", status.alias("status"))


#: What a selector may give, the most telling first.
SELECTOR = ("trip_id", "stop_id", "route_id", "route_type", "direction_id")


def matching_alerts(selectors: DataFrame, asked: DataFrame, now: int, end_inclusive: bool = True) -> DataFrame:
    """Alerts with a selector all of whose given fields fit a call, in an active period; an open bound always holds.

    Both sides have those of SELECTOR that they know, and a scope where feeds are told apart: a selector fits calls of
    its scope only. One that gives no field fits all of these. Routing counts a period's end as inside it,
    operations don't.
    """
    known = [c for c in SELECTOR if c in selectors.columns and c in asked.columns]
    unknown = [c for c in SELECTOR if c in selectors.columns and c not in asked.columns]
    scope = ["scope"] if "scope" in selectors.columns and "scope" in asked.columns else []
    renamed = selectors.select("alert_id", *[F.col(c).alias(f"s_{c}") for c in known + scope], "start", "end", *unknown)
    ends = F.col("end") >= now if end_inclusive else F.col("end") > now
    active = renamed.where((F.col("start").isNull() | (F.col("start") <= now)) & (F.col("end").isNull() | ends))
    for c in unknown:  # a field that calls don't have can't fit
        active = active.where(F.col(c).isNull()).drop(c)
    fits = F.lit(True)
    for c in known:
        fits = fits & (F.col(f"s_{c}").isNull() | (F.col(f"s_{c}") == F.col(c)))
    for c in scope:
        fits = fits & (F.col(f"s_{c}") == F.col(c))
    # The first field that a selector gives decides the join; of selectors without any, the scope or nothing does.
    out, left = [], active
    for c in known:
        out.append(asked.join(left.where(F.col(f"s_{c}").isNotNull()), F.col(c) == F.col(f"s_{c}")).where(fits))
        left = left.where(F.col(f"s_{c}").isNull())
    every = asked.withColumn("every", F.lit(1)).join(left.withColumn("s_every", F.lit(1)), F.col("every") == F.col("s_every")).where(fits)
    found = every.select("call_id", "alert_id")
    for rows in out:
        found = found.unionByName(rows.select("call_id", "alert_id"))
    return found.distinct()


def realtime_view(conns: DataFrame, cancelled: DataFrame, replaced: DataFrame) -> DataFrame:
    """The timetable without cancelled trips and with replaced trips' own connections."""
    gone = cancelled.select("trip_id").unionByName(replaced.select("trip_id")).distinct()
    return conns.join(gone, "trip_id", "left_anti").unionByName(replaced.select(*conns.columns))


def added_trips(records: DataFrame, trips: DataFrame) -> DataFrame:
    """OP11, OP14: added trips whose identity is new; those that name more than one route are ambiguous."""
    rows = records.where("relationship IN ('ADDED', 'NEW')").join(trips.select("trip_id"), "trip_id", "left_anti")
    return rows.groupBy("trip_id").agg(F.countDistinct("route_id").alias("routes"), F.count("*").alias("reports")).withColumn("ambiguous", F.col("routes") != 1)


def vehicle_positions(spans: DataFrame, now: int) -> DataFrame:
    """Where each vehicle is at a time: moving with its share of the segment, dwelling, or arrived."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    rows = spans.withColumn("next_departure", F.lead("departure").over(w)).where((F.col("departure") <= now) & (F.coalesce("next_departure", F.lit(10**9)) > now))
    share = (F.lit(now) - F.col("departure")) / F.greatest(F.col("arrival") - F.col("departure"), F.lit(1))
    state = F.when(F.col("arrival") > now, "moving").when(F.col("next_departure").isNotNull(), "dwelling").otherwise("arrived")
    return rows.select("trip_id", state.alias("state"), "from_stop_id", "to_stop_id", F.round(F.least(share, F.lit(1.0)), 6).alias("share"))


def trip_progress(calls: DataFrame, now: int) -> DataFrame:
    """OP7: every call as passed, next or ahead."""
    w = Window.partitionBy("trip_id")
    first_ahead = F.min(F.when(F.col("departure") > now, F.col("stop_sequence"))).over(w)
    return calls.withColumn("ahead", first_ahead).select(
        "trip_id", "stop_sequence", F.when(F.col("ahead").isNull() | (F.col("stop_sequence") < F.col("ahead")), "passed").when(F.col("stop_sequence") == F.col("ahead"), "next").otherwise("ahead").alias("progress")
    )


def address_search(addresses: DataFrame, asked: DataFrame, most: int = 6) -> DataFrame:
    """OP12, OP13: per query the addresses that share most words, exactly or as a start; ties by text length, then id.

    The index has a row for every start of every word, of which the planner's estimate knows nothing: the asked words
    are broadcast if they are few, and the index never is.
    """
    from tramline.functions.measures import normalise_address

    tokens = addresses.select("address_id", normalise_address(F.col("name")).alias("text")).withColumn("word", F.explode(F.array_distinct(F.split("text", " "))))
    prefixes = F.explode(F.transform(F.sequence(F.lit(2), F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n)))
    index = tokens.where("length(word) >= 2").select("address_id", "text", "word", prefixes.alias("key"))
    words = asked.select("query_id", F.explode(F.array_distinct(F.split(normalise_address(F.col("query")), " "))).alias("key"))
    hits = maybe_broadcast(words).join(index.hint("merge"), "key").groupBy("query_id", "address_id", "text", "key").agg(F.max(F.when(F.col("word") == F.col("key"), 2).otherwise(1)).alias("points"))
    scored = hits.groupBy("query_id", "address_id", "text").agg(F.sum("points").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("text"), "address_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "address_id", "score", "rank")


def near_words(vocabulary: DataFrame, asked: DataFrame, most: int = 3) -> DataFrame:
    """Words at an edit distance of one, at most three for each asked word of four letters or more: candidates share a deletion."""
    deletions = lambda c: F.explode(F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.length(c)))))))
    a = asked.where("length(word) >= 4").select(F.col("word").alias("asked"), deletions(F.col("word")).alias("key"))
    b = vocabulary.select("word", deletions(F.col("word")).alias("key"))
    pairs = maybe_broadcast(a).join(b.hint("merge"), "key").select("asked", "word").distinct().where("levenshtein(asked, word) = 1")
    w = Window.partitionBy("asked").orderBy("word")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("asked", "word")
