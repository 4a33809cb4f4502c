"""Risk score, its bands, what it rests on, and the back-test of early warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, Config
from emberline.operators.quality import hour


def _weight(config: Config) -> Column:
    out = F.lit(0.0)
    for tag, w in config.weights:
        out = F.when(F.col("tag") == tag, w).otherwise(out)
    return out


def contributions(z: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """tag, hr, part: what each tag adds to the hour's severity."""
    return z.select("tag", "hr", (_weight(config) * F.greatest(F.col("z"), F.lit(0.0))).alias("part"))


def severity(z: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return contributions(z, config).groupBy("hr").agg(F.sum("part").alias("raw"))


def likelihood(raw: DataFrame) -> DataFrame:
    """Severity as a risk between 0 and 100."""
    return raw.withColumn("risk", 100 / (1 + F.exp(-(F.col("raw") - 1))))


def banded(risk: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return risk.withColumn("band", F.when(F.col("risk") >= config.high, "HIGH").when(F.col("risk") >= config.medium, "MEDIUM").otherwise("LOW"))


def top_parts(z: DataFrame, k: int = 2, config: Config = DEFAULT) -> DataFrame:
    """The k tags that add most to each hour: hr, place, tag, part."""
    w = Window.partitionBy("hr").orderBy(F.desc("part"), "tag")
    return contributions(z, config).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def _near(alerts: DataFrame, events: DataFrame, hours: int) -> DataFrame:
    """alert_hr, event_hr: alerts up to `hours` before an event, the event's own hour excluded. Each event names the hours it can match, so the join is an equality."""
    early = events.select(F.col("hr").alias("event_hr"), F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("back")).select("event_hr", (F.col("event_hr") - F.make_interval(hours=F.col("back"))).cast("timestamp_ntz").alias("alert_hr"))
    return early.join(alerts.select(F.col("hr").alias("alert_hr")), "alert_hr")


def back_test(alerts: DataFrame, events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: alerts, events, true_alerts (an event follows in time), misses (no alert before), precision, recall.

    alerts and events: hr, each hour once. Feed hours after the cutoff only: those before it fitted the baseline.
    """
    near = _near(alerts, events, config.lead_hours)
    a, e = alerts.agg(F.count("*").alias("alerts")), events.agg(F.count("*").alias("events"))
    n = near.agg(F.count_distinct("alert_hr").alias("true_alerts"), F.count_distinct("event_hr").alias("warned"))
    out = a.join(e, how="cross").join(n, how="cross")  # three single rows
    ratio = lambda x, y: F.try_divide(F.col(x).cast("double"), F.col(y).cast("double"))
    return out.select("alerts", "events", "true_alerts", (F.col("events") - F.col("warned")).alias("misses"), ratio("true_alerts", "alerts").alias("precision"), ratio("warned", "events").alias("recall"))


def lead_time(alerts: DataFrame, events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: warned events, and the median of hours from an event's earliest alert to it."""
    first = _near(alerts, events, config.lead_hours).groupBy("event_hr").agg(F.min("alert_hr").alias("first"))
    hours = F.timestamp_diff("HOUR", F.col("first"), F.col("event_hr")).cast("double")
    return first.agg(F.count("*").alias("warned"), F.median(hours).alias("lead_hours"))


def rolling_origin(events: DataFrame, step_days: int = 5, folds: int = 4, config: Config = DEFAULT) -> DataFrame:
    """A row a fold: origin, alerts, events, true_alerts, misses, precision, recall, lead_hours.

    Origins lie step_days apart, from the cutoff on. A fold's baseline is fitted to
    all readings before its origin, and its alerts and events are those of the step_days
    after it; an alert counts for events of its own fold only, so no fold sees its
    future. Readings are first summed by tag and hour, and each hour then names the folds
    that it belongs to, so all folds are refitted in one pass over few rows.
    """
    cutoff = F.lit(config.cutoff).cast("timestamp_ntz")
    sums = events.groupBy(F.col("event_type").alias("tag"), hour().alias("hr")).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    origins = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: (cutoff + F.make_dt_interval(days=k * step_days)).cast("timestamp_ntz"))
    until = lambda o: o + F.make_dt_interval(days=F.lit(step_days))
    rows = sums.withColumn("origin", F.explode(F.filter(origins, lambda o: F.col("hr") < until(o))))
    fit = rows.where("hr < origin").groupBy("origin", "tag").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"), F.sum("q").alias("bq"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("bq") - F.col("bs") * F.col("bs") / F.col("bn"), F.col("bn") - 1)))
    fit = fit.select("origin", "tag", F.try_divide("bs", "bn").alias("mu"), spread.alias("sd"))
    z = rows.where("hr >= origin").join(F.broadcast(fit), ["origin", "tag"]).select("origin", "tag", "hr", F.try_divide(F.try_divide("s", "n") - F.col("mu"), F.col("sd")).alias("z"))
    part = F.sum(F.when(F.col("tag") != config.target, _weight(config) * F.greatest(F.col("z"), F.lit(0.0)))).alias("raw")
    alerts = likelihood(z.groupBy("origin", "hr").agg(part)).where(F.col("risk") >= config.medium).select("origin", F.col("hr").alias("alert_hr"))
    evs = z.where((F.col("tag") == config.target) & (F.col("z") > config.z_alert)).select("origin", F.col("hr").alias("event_hr"))
    early = evs.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(config.lead_hours)))).select("origin", "event_hr", (F.col("event_hr") - F.make_interval(hours=F.col("back"))).cast("timestamp_ntz").alias("alert_hr"))
    near = early.join(alerts, ["origin", "alert_hr"])
    lead = near.groupBy("origin", "event_hr").agg(F.min("alert_hr").alias("first")).groupBy("origin").agg(F.median(F.timestamp_diff("HOUR", F.col("first"), F.col("event_hr")).cast("double")).alias("lead_hours"))
    counts = [near.groupBy("origin").agg(F.count_distinct("alert_hr").alias("true_alerts"), F.count_distinct("event_hr").alias("warned")), alerts.groupBy("origin").agg(F.count("*").alias("alerts")), evs.groupBy("origin").agg(F.count("*").alias("events")), lead]
    out = events.sparkSession.range(1).select(F.explode(origins).alias("origin"))
    for c in counts:
        out = out.join(F.broadcast(c), "origin", "left")  # a row a fold
    out = out.fillna(0, ["true_alerts", "warned", "alerts", "events"])
    ratio = lambda x, y: F.try_divide(F.col(x).cast("double"), F.col(y).cast("double"))
    return out.select("origin", "alerts", "events", "true_alerts", (F.col("events") - F.col("warned")).alias("misses"), ratio("true_alerts", "alerts").alias("precision"), ratio("warned", "events").alias("recall"), "lead_hours")


def after_cutoff(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return rows.where(F.col("hr") >= F.lit(config.cutoff).cast("timestamp_ntz"))
