"""Walking times, decay weights, thresholds and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCOPE = "\u001f"


def walking_seconds(km: Column, km_per_hour: float, padding: float = 1.0, overhead: float = 0.0) -> Column:
    return F.ceil(km / km_per_hour * 3600 * padding + overhead).cast("int")


def station_fallback_seconds(km: Column, km_per_hour: float) -> Column:
    """Between platforms of a station without a declared transfer: two minutes at least."""
    return F.greatest(F.lit(120), F.ceil(km / km_per_hour * 3600).cast("int"))


def decay_weight(kind: str, minutes: Column, cutoff: Column, rate: float = 0.0) -> Column:
    """Weight of an opportunity at a travel time; null minutes weigh nothing. The step is strictly below the cutoff."""
    weights = {
        "step": lambda: (minutes < cutoff).cast("double"),
        "linear": lambda: F.greatest(F.lit(0.0), 1 - minutes / cutoff),
        "exponential": lambda: F.exp(-F.log(F.lit(2.0)) * minutes / cutoff),
        "fixed-exponential": lambda: F.exp(-rate * minutes),
        "logistic": lambda: 1 / (1 + F.exp((minutes - cutoff) / rate)),
    }
    return F.coalesce(weights[kind](), F.lit(0.0))


def frequency_class(headway_minutes: Column) -> Column:
    """high up to 15 minutes, medium up to 30; 0 is no headway and low."""
    return F.when((headway_minutes > 0) & (headway_minutes <= 15), "high").when((headway_minutes > 0) & (headway_minutes <= 30), "medium").otherwise("low")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def scope_of(id_: Column) -> Column:
    return F.when(F.instr(id_, SCOPE) > 0, F.substring_index(id_, SCOPE, 1)).otherwise("")


def local_id(id_: Column) -> Column:
    return F.substring_index(id_, SCOPE, -1)


def scoped(scope: str, id_: Column) -> Column:
    return F.concat(F.lit(scope + SCOPE), id_)


def alert_severity(delay: Column) -> Column:
    """Seconds of delay: from 900 critical, from 300 warning."""
    return F.when(delay >= 900, "critical").when(delay >= 300, "warning").otherwise("none")


#: A closer interval is told from so many seconds less than planned.
LEAST_CLOSER = 180


def spacing_alert(planned: Column, actual: Column) -> Column:
    """How much a predicted interval of two departures departs from the planned one, both in seconds."""
    extra = actual - planned
    wider = F.when((actual >= 1200) & (actual >= 3 * planned) & (extra >= 600), "critical").when((2 * actual >= 3 * planned) & (extra >= 300), "warning")
    closer = F.when((4 * actual <= planned) & (actual <= 120) & (-extra >= 300), "critical").when((2 * actual <= planned) & (-extra >= LEAST_CLOSER), "warning")
    return F.coalesce(F.when((planned > 0) & (actual >= 0), F.when(extra > 0, wider).otherwise(closer)), F.lit("info"))


def normalise_address(text: Column) -> Column:
    """Lower case without accents and punctuation, common street abbreviations written out."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    words = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    for short, long in ABBREVIATIONS:
        padded = F.replace(padded, F.lit(f" {short} "), F.lit(f" {long} "))
    return F.trim(padded)


#: Street abbreviations.
ABBREVIATIONS = (("st", "street"), ("ave", "avenue"), ("av", "avenue"), ("rd", "road"), ("dr", "drive"), ("blvd", "boulevard"), ("ln", "lane"), ("sq", "square"), ("pl", "place"), ("ct", "court"))
