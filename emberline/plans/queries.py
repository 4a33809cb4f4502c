"""The registered queries: one or more for each operator, with its output rounded and typed for comparison."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.config import DEFAULT
from emberline.functions.numeric import rounded
from emberline.operators import anomaly, baseline, features, indicators, kpi, prediction, quality, risk, sketches
from emberline.operators.features import rounded_columns as r
from emberline.sources import sinks, workbooks
from emberline.sources.tables import EVENTS, read_text_table, split_corrupt, table
from emberline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def ev(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def zs(s: SparkSession, d: str) -> DataFrame:
    return baseline.deviations(ev(s, d))


# --- flagship

@query
def riskiest_hours(s: SparkSession, d: str) -> DataFrame:
    """Which hours were most abnormal, and how risky."""
    out = risk.banded(risk.likelihood(risk.severity(zs(s, d))))
    return r(out, "raw", "risk").orderBy(F.desc("risk"), "hr")


# --- A: sources, quality, cleaning

@query
def a1_scan(s, d):
    return ev(s, d).where("event_type = 'error' and value > 3").select("event_id", "value")


@query
def a2_delimited_text(s, d):
    """Rows through CSV text and back by the explicit schema."""
    stamp = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    line = ev(s, d).select(F.to_csv(F.struct("event_id", "ts", "user_id", "event_type", "value", "props"), stamp).alias("line"))
    return line.select(F.from_csv("line", EVENTS.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE", **stamp}).alias("x")).select("x.*").select("event_id", "ts", "user_id", "event_type", rounded(F.col("value")).alias("value"), "props")


@query
def a2_json_text(s, d):
    line = ev(s, d).select(F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("line"))
    schema = T.StructType([x for x in EVENTS.fields if x.name in ("event_id", "user_id", "event_type", "value")])
    return line.select(F.from_json("line", schema).alias("x")).select("x.event_id", "x.user_id", "x.event_type", rounded(F.col("x.value")).alias("value"))


def _through_files(s: SparkSession, d: str, kind: str) -> DataFrame:
    """The events written as text files of a raw tier, and read again by their schema; rows that don't fit are counted on the side."""
    path = f"{jobs.shared_dir(s)}/raw-{uuid.uuid4().hex}"
    stamp = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    ev(s, d).write.format(kind).options(**stamp, **({"header": "true"} if kind == "csv" else {})).save(path)
    good, _ = split_corrupt(read_text_table(s, path, EVENTS, kind, **stamp))
    return r(good.select("event_id", "ts", "user_id", "event_type", "value", "props"), "value")


@query
def a2_csv_files(s, d):
    return _through_files(s, d, "csv")


@query
def a2_json_files(s, d):
    return _through_files(s, d, "json")


@query
def a3_workbooks(s, d):
    """The events as workbooks, and read from them by their schema."""
    good, _ = split_corrupt(workbooks.parsed(workbooks.as_workbooks(ev(s, d).select(*EVENTS.fieldNames())), EVENTS))
    return r(good, "value")


@query
def a4_curated_tier(s, d):
    """Hourly means through the curated tier."""
    path = sinks.write_tier(quality.hourly(ev(s, d)), f"{jobs.shared_dir(s)}/tiers-{uuid.uuid4().hex}", "curated", "hourly", "hr")
    return r(s.read.parquet(path).select("tag", "hr", "v"), "v")


@query
def a5_profile(s, d):
    return r(quality.profile(ev(s, d)), "lo", "hi")


@query
def a6_coverage(s, d):
    return quality.coverage(ev(s, d))


@query
def a7_gap_fill(s, d):
    return r(quality.grid(ev(s, d)), "v")


@query
def a8_keep_first(s, d):
    return quality.keep_first(ev(s, d)).select("event_id", "user_id", "event_type")


@query
def a9_stuck(s, d):
    return quality.stuck(ev(s, d)).select("tag", F.col("run").cast("long").alias("run"), "n", "start", "until")


@query
def a10_json_attribute(s, d):
    return quality.json_attribute(ev(s, d)).groupBy("k").agg(F.count("*").alias("n"))


@query
def a11_tolerant(s, d):
    return r(quality.tolerant(ev(s, d)), "k")


# --- B: features

@query
def b1_tumbling(s, d):
    return r(features.tumbling(ev(s, d)), "v")


@query
def b2_sliding(s, d):
    return r(features.sliding(ev(s, d)), "v")


@query
def b3_sessions(s, d):
    return features.sessions(ev(s, d))


@query
def b4_rolling_rows(s, d):
    return r(features.rolling_rows(ev(s, d)), "roll")


@query
def b5_rolling_time(s, d):
    return r(features.rolling_time(ev(s, d)), "roll")


@query
def b6_difference(s, d):
    return r(features.differenced(ev(s, d)), "diff")


@query
def b7_ewma_last(s, d):
    return r(features.ewma_last(ev(s, d)), "ewma")


@query
def b7_ewma_series(s, d):
    return r(features.ewma_series(ev(s, d)), "ewma")


@query
def b8_pivot(s, d):
    return r(features.daily_pivot(ev(s, d)), *DEFAULT.tags)


@query
def b9_histogram(s, d):
    return features.histogram(ev(s, d)).select(F.col("bin").cast("long").alias("bin"), "n")


@query
def b10_unpivot(s, d):
    b = baseline.bands(ev(s, d))
    return r(features.unpivoted(b, ["tag"], ["med", "p05", "p95", "mu", "sd"]), "x")


# --- C: baseline

@query
def c1_bands(s, d):
    return r(baseline.bands(ev(s, d)), "med", "p05", "p95", "mu", "sd")


@query
def c2_mad(s, d):
    return r(baseline.mad(ev(s, d)), "med", "mad")


@query
def c3_deviation(s, d):
    return r(zs(s, d), "z")


@query
def c4_shape(s, d):
    return r(baseline.shape(ev(s, d)), "skew", "kurt")


@query
def c5_rolling_z(s, d):
    return r(baseline.rolling_z(ev(s, d)), "z")


@query
def c6_quick_p95(s, d):
    return r(baseline.quick_p95(ev(s, d)), "p95", digits=2)


def _sketch_tier(s: SparkSession, d: str) -> DataFrame:
    """Hourly sketches through the curated tier."""
    path = sinks.write_tier(sketches.hourly_sketches(ev(s, d)), f"{jobs.shared_dir(s)}/tiers-{uuid.uuid4().hex}", "curated", "sketches", "hr")
    return s.read.parquet(path).withColumn("day", F.date_trunc("day", "hr").cast("timestamp_ntz"))


@query
def c6_sketch_tags(s, d):
    """Hours merged to days, and days to tags: 95th percentile and distinct units against the exact ones."""
    days = sketches.merged(_sketch_tier(s, d), "tag", "day")
    found = sketches.estimates(sketches.merged(days, "tag"), "tag")
    return sketches.compared(found, ev(s, d), {"tag": F.col("event_type")})


@query
def c6_sketch_days(s, d):
    found = sketches.estimates(sketches.merged(_sketch_tier(s, d), "tag", "day"), "tag", "day")
    return sketches.compared(found, ev(s, d), {"tag": F.col("event_type"), "day": F.date_trunc("day", "ts").cast("timestamp_ntz")})


# --- D: KPI

@query
def d1_smoothed(s, d):
    return r(kpi.smoothed(zs(s, d)), "kpi")


@query
def d2_cusum(s, d):
    return r(kpi.cusum(zs(s, d)), "cs")


@query
def d3_rise(s, d):
    return r(kpi.rise(zs(s, d)), "rise")


@query
def d4_trend(s, d):
    return r(kpi.trend(zs(s, d)), "slope", digits=6)


@query
def d5_periods(s, d):
    return r(kpi.periods(zs(s, d)), "before", "after", "change")


# --- E: indicators

@query
def e1_lagged_correlation(s, d):
    return r(indicators.lagged_correlation(quality.hourly(ev(s, d)), "click", "error", 1), "r")


@query
def e2_precursors(s, d):
    return indicators.precursors(ev(s, d), "click", "error")


@query
def e3_precursor_rate(s, d):
    return r(indicators.precursor_rate(ev(s, d), "click", "error"), "rate", "base", "lift")


@query
def e4_as_of(s, d):
    return indicators.as_of(ev(s, d), "click", "error")


@query
def e5_fuel_share(s, d):
    return r(indicators.fuel_share(ev(s, d)), "share")


@query
def e6_fuel_impact(s, d):
    return r(indicators.fuel_impact(indicators.fuel_share(ev(s, d)), zs(s, d)), "mean_z", "sd_z")


@query
def e6_fuel_effect(s, d):
    """The effect of substitution, adjusted for the hour of the day and the load."""
    return r(indicators.fuel_effect(ev(s, d), zs(s, d)), "share", "se_share", "hour_of_day", "load", digits=6).select("tag", "n", "share", "se_share", "hour_of_day", "load")


@query
def e7_unit_regression(s, d):
    return r(r(indicators.unit_regression(ev(s, d)), "r", "r2"), "slope", digits=8)


# --- F: anomalies

@query
def f1_z_rule(s, d):
    return r(anomaly.by_z(zs(s, d)), "z")


@query
def f2_iqr_rule(s, d):
    return r(anomaly.by_iqr(ev(s, d)), "value")


@query
def f3_mad_rule(s, d):
    return r(anomaly.by_mad(ev(s, d)), "value")


@query
def f4_episodes(s, d):
    return r(anomaly.episodes(anomaly.by_z(zs(s, d))), "peak")


@query
def f5_unit_sessions(s, d):
    return anomaly.unit_sessions(ev(s, d))


@query
def f6_pareto(s, d):
    return r(anomaly.pareto(anomaly.episodes(anomaly.by_z(zs(s, d)))), "share")


@query
def f7_root_causes(s, d):
    return indicators.root_causes(ev(s, d), "error")


# --- G: relational coverage

@query
def g1_project_filter(s, d):
    return table(s, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_custkey", rounded(F.col("o_totalprice")).alias("price"))


@query
def g2_joins(s, d):
    c, o, n = table(s, d, "customer"), table(s, d, "orders"), table(s, d, "nation")
    joined = c.join(o.where("o_totalprice > 100000"), c["c_custkey"] == o["o_custkey"], "left").join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # nation is 25 rows
    return joined.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@query
def g3_semi(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    return c.join(o.where("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query
def g3_anti(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    return c.join(o.where("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query
def g4_cross(s, d):
    """Regions by order states: both lists are short by meaning."""
    return table(s, d, "region").select("r_name").crossJoin(table(s, d, "orders").select("o_orderstatus").distinct())


@query
def g5_grouping_sets(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("emberline_lineitem")
    return s.sql("""select l_returnflag, l_linestatus, year(l_shipdate) as y, count(*) as n, cast(grouping_id() as bigint) as g
        from emberline_lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag, year(l_shipdate)), ())""").withColumn("y", F.col("y").cast("long"))


@query
def g6_cube(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), rounded(F.sum("l_quantity"), 2).alias("quantity"))


@query
def g6_rollup(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_linestatus").cast("long").alias("total"))


@query
def g7_distinct(s, d):
    return ev(s, d).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query
def g7_approx_distinct(s, d):
    """The sketch's count beside the exact one: whether it is within 5 percent."""
    # beside an exact count in one aggregation, every pair of type and user would carry a sketch of its own; what a sketch holds is a set, so it may count the pairs
    pairs = ev(s, d).select("event_type", "user_id").distinct()
    both = pairs.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("about"), F.count("user_id").alias("users"))
    return both.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users")).alias("near"))


@query
def g8_ranking(s, d):
    """All rankings of a tag's readings by value, from positions along slices of the order."""
    return r(features.ranked(ev(s, d).select("event_id", "event_type", "value"), "event_type", ("value", "event_id"), 10), "pr", "cd").select("event_id", "rn", "rk", "dr", "tile", "pr", "cd")


@query
def g9_top_k(s, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return ev(s, d).withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 3").select("event_type", "rn", "event_id")


@query
def g10_sort_limit(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", rounded(F.col("o_totalprice")).alias("price"))


@query
def g11_union(s, d):
    return ev(s, d).where("event_type = 'click'").select("user_id").union(ev(s, d).where("event_type = 'error'").select("user_id")).distinct()


@query
def g11_union_all(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).unionAll(table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k")))


@query
def g11_intersect(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k")))


@query
def g11_except(s, d):
    hours = lambda tag: ev(s, d).where(F.col("event_type") == tag).select(quality.hour().alias("hr"))
    return hours("view").subtract(hours("error"))


@query
def g11_except_all(s, d):
    hours = lambda tag: ev(s, d).where(F.col("event_type") == tag).select(quality.hour().alias("hr"))
    return hours("view").exceptAll(hours("error"))


@query
def g12_math(s, d):
    return ev(s, d).select("event_id", rounded(F.exp(-F.col("value") / 100)).alias("e"), rounded(F.sqrt("value")).alias("q"), rounded(F.greatest(F.col("value"), F.lit(50.0))).alias("g"), rounded(F.log1p("value")).alias("l"))


@query
def g13_strings_dates(s, d):
    return table(s, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), F.upper(F.substring("o_orderpriority", 1, 3)).alias("p")).agg(F.count("*").alias("n"), F.sum(F.length("o_orderpriority").cast("long")).alias("letters"))


@query
def g14_star(s, d):
    l, o, c, n, g = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    joined = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"])
    return joined.groupBy("r_name").agg(rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.count("*").alias("n"))


# --- H: risk and validation

@query
def h1_severity(s, d):
    return r(risk.severity(zs(s, d)), "raw")


@query
def h2_likelihood(s, d):
    return r(risk.likelihood(risk.severity(zs(s, d))), "raw", "risk")


@query
def h3_bands(s, d):
    return risk.banded(risk.likelihood(risk.severity(zs(s, d)))).groupBy("band").agg(F.count("*").alias("n"))


def _alerts_events(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """After the cutoff: hours of high or medium risk, the target tag left out of the score; hours in which the target deviates."""
    z = risk.after_cutoff(zs(s, d))
    alerts = risk.likelihood(risk.severity(z.where(F.col("tag") != DEFAULT.target))).where(F.col("risk") >= DEFAULT.medium).select("hr")
    return alerts, z.where((F.col("tag") == DEFAULT.target) & (F.col("z") > DEFAULT.z_alert)).select("hr")


@query
def h4_back_test(s, d):
    return risk.back_test(*_alerts_events(s, d)).select("alerts", "events", "true_alerts", "misses")


@query
def h5_lead_time(s, d):
    return risk.lead_time(*_alerts_events(s, d))


@query
def h6_precision_recall(s, d):
    return r(risk.back_test(*_alerts_events(s, d)), "precision", "recall").select("precision", "recall")


@query
def h4_rolling_origin(s, d):
    """The back-test from several origins, each with its own baseline."""
    return r(risk.rolling_origin(ev(s, d)), "precision", "recall")


# --- I: prediction

@query
def i1_labels(s, d):
    return prediction.labels(ev(s, d))


@query
def i2_logistic(s, d):
    """Held against the optimum that SQL finds by its own Newton steps."""
    return r(prediction.logistic_predicted(prediction.hourly_features(zs(s, d)), one_label_steps=prediction.ONE_LABEL_STEPS), "p")


@query
def i3_boosted_trees(s, d):
    return r(prediction.predicted(prediction.hourly_features(zs(s, d)), "trees"), "p")


def _probabilities(s: SparkSession, d: str, kind: str) -> DataFrame:
    """Of the hours after the cutoff: how many, how many precede a deviation of the target, and whether all have a probability; of the hours before it: the log loss of their base rate, and whether the model's is below nine tenths of that (trees) or at least below it, as that of shuffled probabilities is not."""
    features = prediction.kept(prediction.hourly_features(zs(s, d)))
    model, rows, _ = prediction.fitted(features, kind)
    p = model.transform(rows).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    before = prediction.early(p).agg(prediction.log_loss(F.col("p")).alias("loss"), F.avg("label").alias("rate"))
    base = F.when((F.col("rate") > 0) & (F.col("rate") < 1), -F.col("rate") * F.log("rate") - (1 - F.col("rate")) * F.log(1 - F.col("rate"))).otherwise(F.lit(0.0))
    learns = (F.col("base_loss") == 0) | (F.col("loss") < F.col("base_loss") * (0.9 if kind == "trees" else 1.0))
    after = prediction.late(p).agg(F.count("*").alias("hours"), F.sum("label").cast("long").alias("positives"), F.min(F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("proper"))
    both = after.join(before.withColumn("base_loss", base), how="cross")  # two single rows
    return r(both.select("hours", "positives", "proper", "base_loss", learns.alias("learns")), "base_loss")


@query
def i2_logistic_hours(s, d):
    return _probabilities(s, d, "logistic")


@query
def i3_trees_hours(s, d):
    return _probabilities(s, d, "trees")


@query
def i4_importance_whole(s, d):
    """Importances are shares of one."""
    found = prediction.importances(prediction.hourly_features(zs(s, d)))
    return found.agg(F.count("*").alias("features"), rounded(F.sum("importance"), 6).alias("whole"), F.min(F.col("importance") >= 0).alias("shares"))


@query
def i4_importance(s, d):
    return r(prediction.importances(prediction.hourly_features(zs(s, d))), "importance")


@query
def i4_ablation(s, d):
    """Coefficients of the logistic model, and what the loss is without each feature."""
    return r(prediction.ablation(prediction.hourly_features(zs(s, d))), "coefficient", "increase")


@query
def i5_linear_parts(s, d):
    """What each hour's log-odds rest on, by the logistic model."""
    return r(prediction.explained(prediction.hourly_features(zs(s, d)), one_label_steps=prediction.ONE_LABEL_STEPS).select("hr", "name", "part", "log_odds"), "part", "log_odds")


@query
def i5_tree_parts(s, d):
    """The same by the boosted trees."""
    return r(prediction.explained(prediction.hourly_features(zs(s, d)), "trees"), "part", "base", "log_odds")


@query
def i5_tree_parts_add_up(s, d):
    """A row an hour: whether base and parts are the ensemble's log-odds."""
    found = prediction.explained(prediction.hourly_features(zs(s, d)), "trees")
    return found.groupBy("hr").agg(F.count("*").alias("parts"), (F.abs(F.sum("part") + F.first("base") - F.first("log_odds")) < 1e-9).alias("adds_up"))


@query
def i5_contributions(s, d):
    return r(risk.top_parts(zs(s, d)), "part")


# --- J: streaming, run over what is there

def replayed(s: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], name: str, *, late_share: float = 0.0, **how) -> DataFrame:
    """What a stream makes of the table, replayed in time order: its files may overlap in time, and rows of a later file would be late."""
    replay = jobs.time_sliced(s, f"{d}/events.parquet", late_share=late_share)
    return jobs.run_to_tier(build(replay.stream()), name, replay=replay, **how)


@query
def j1_stream_tumbling(s, d):
    out = replayed(s, d, jobs.tumbling, "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", rounded(F.col("v")).alias("v"))


@query
def j2_stream_sessions(s, d):
    out = replayed(s, d, jobs.sessions, "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query
def j3_stream_dedup(s, d):
    return replayed(s, d, lambda rows: jobs.deduplicated(rows).select("event_id", "event_type"), "dedup")


@query
def j4_stream_join(s, d):
    return replayed(s, d, lambda rows: jobs.precursor_pairs(rows, "click", "error"), "pairs")


@query
def j5_stream_ewma(s, d):
    """The last state of each user."""
    last = lambda rows: rows.where("known").groupBy("user_id").agg(F.max_by("ewma", "batch").alias("ewma"))
    return r(replayed(s, d, jobs.ewma, "ewma", mode="update", fold=last), "ewma")


@query
def j6_late_data(s, d):
    """Rows that come again behind the watermark change no closed window: the earliest tenth is sent once more at the end."""
    out = replayed(s, d, jobs.tumbling, "late", late_share=0.1)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", rounded(F.col("v")).alias("v"))


@query
def j7_stream_sink(s, d):
    """A stream that is stopped and started again from its checkpoint leaves every row in the tier once."""
    out = replayed(s, d, lambda rows: jobs.deduplicated(rows).select("event_id", "event_type"), "sink", restarts=1)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
