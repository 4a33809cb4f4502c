"""Cases worked by hand, and rows that the test tables lack: nulls, constants, gaps, ties, empty tables."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.config import Config
from emberline.operators import anomaly, baseline, features, indicators, kpi, prediction, quality, risk
from emberline.plans import queries
from emberline.sources import sinks, tables

H = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, rows):
    return spark.createDataFrame([(i, t, u, k, v, p) for i, (t, u, k, v, p) in enumerate(rows)], EVENT)


def hours(spark, values, tag="error"):
    return spark.createDataFrame([(tag, T0 + i * H, v) for i, v in enumerate(values)], "tag string, hr timestamp_ntz, z double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_cusum_and_rise_by_hand(spark):
    z = hours(spark, [1.0, -2.0, 3.0, 0.5, -4.0])
    assert column(kpi.cusum(z), "cs", "hr") == [1.0, -1.0, 2.0, 2.5, -1.5]
    assert column(kpi.rise(z), "rise", "hr") == [0.0, 0.0, 3.0, 3.5, 0.0]


def test_episodes_split_above_the_gap_only(spark):
    z = spark.createDataFrame([("a", T0 + h * H, 2.0) for h in (0, 1, 4, 8)], "tag string, hr timestamp_ntz, z double")
    found = anomaly.episodes(z, Config(episode_gap_hours=3)).orderBy("episode").collect()
    assert [(r["n"], r["until"] - r["start"]) for r in found] == [(3, 4 * H), (1, 0 * H)]


def test_back_test_and_lead_time_by_hand(spark):
    at = lambda *hs: spark.createDataFrame([(T0 + h * H,) for h in hs], "hr timestamp_ntz")
    alerts, evs = at(1, 4, 20, 40), at(5, 26, 50)
    r = risk.back_test(alerts, evs, Config(lead_hours=6)).first()
    assert (r["alerts"], r["events"], r["true_alerts"], r["misses"]) == (4, 3, 3, 1)
    assert (r["precision"], r["recall"]) == (0.75, pytest.approx(2 / 3))
    lead = risk.lead_time(alerts, evs, Config(lead_hours=6)).first()
    assert (lead["warned"], lead["lead_hours"]) == (2, 5.0)


def test_back_test_of_nothing(spark):
    none = spark.createDataFrame([], "hr timestamp_ntz")
    r = risk.back_test(none, none).first()
    assert (r["alerts"], r["events"], r["precision"], r["recall"]) == (0, 0, None, None)


def test_constant_series_give_null_not_an_error(spark):
    e = events(spark, [(T0 + i * H, 1, "error", 5.0, None) for i in range(5)])
    r = indicators.unit_regression(e).first()
    assert (r["r"], r["slope"]) == (None, 0.0)
    assert {x["z"] for x in baseline.deviations(e).collect()} == {None}
    assert anomaly.by_mad(e).count() == 0


def test_single_rows_and_nulls(spark):
    e = events(spark, [(T0, 1, "error", None, None), (T0, 2, "click", 3.0, "{}")])
    p = {r["tag"]: r for r in quality.profile(e).collect()}
    assert (p["error"]["n"], p["error"]["known"], p["click"]["known"]) == (1, 0, 1)
    assert {r["sd"] for r in baseline.bands(e).collect()} == {None}
    assert {r["skew"] for r in baseline.shape(e).collect()} == {None}
    assert {r["ratio"] for r in quality.tolerant(e).collect()} == {None}


def test_empty_events(spark):
    e = events(spark, [])
    for df in (quality.profile(e), quality.hourly(e), baseline.deviations(e), anomaly.by_iqr(e), features.sessions(e), indicators.as_of(e, "click", "error")):
        assert df.count() == 0


def test_session_gap_is_inclusive_in_both_forms(spark):
    m = dt.timedelta(minutes=1)
    e = events(spark, [(T0, 1, "a", 1.0, None), (T0 + 30 * m, 1, "a", 1.0, None), (T0 + 61 * m, 1, "a", 1.0, None)])
    assert sorted(column(features.sessions(e), "n", "start")) == sorted(column(anomaly.unit_sessions(e), "n", "start"))


def test_sessions_equal_the_session_window(spark):
    rng = random.Random(7)
    first = dt.datetime(1969, 12, 31, 6)  # times on both sides of 1970
    rows = [(first + dt.timedelta(minutes=rng.randrange(0, 3000, 5)), rng.choice([1, 2, None]), "view", 1.0, None) for _ in range(150)]
    e = events(spark, [*rows, *rows[:9], (None, 1, "view", 1.0, None)])
    window = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts"), F.max("ts"), F.count("*").alias("n"))
    want = sorted(((r[0], *r[2:]) for r in window.collect()), key=repr)
    assert sorted(map(tuple, features.sessions(e).collect()), key=repr) == want
    assert sum(r[3] for r in want) == 159


def test_rolling_time_by_brute_force(spark):
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), -float("inf"), 4e15]
    time = lambda: None if rng.random() < 0.05 else T0 + rng.randrange(120) * H / 2
    rows = [(time(), 1, rng.choice(["error", "view", None]), odd[i // 20 % 5] if i % 20 == 0 else round(rng.uniform(-50, 50), 3), None) for i in range(200)]

    def mean(t, tag):
        near = [v for u, _, k, v, _ in rows if k == tag and v is not None and (u is None if t is None else u is not None and t - 6 * H <= u <= t)]
        return sum(near) / len(near) if near else None

    want = [mean(t, tag) for t, _, tag, _, _ in rows]
    e = events(spark, rows)
    for n in (1000, 7):  # whole tags, and many slices of each
        got = column(features.rolling_time(e, slice_rows=n), "roll", "event_id")
        for g, x in zip(got, want, strict=True):
            assert g is None if x is None else g == pytest.approx(x, rel=1e-9, nan_ok=True)


def test_rolling_time_of_one_dense_hour_and_of_nothing(spark):
    dense = [(T0 + dt.timedelta(seconds=i // 3), 1, "error", 0.1, None) for i in range(3000)]
    got = features.rolling_time(events(spark, dense), slice_rows=50).select("roll").distinct().collect()
    assert all(r["roll"] == pytest.approx(0.1, rel=2e-16) for r in got)  # decimals add up without error
    assert features.rolling_time(events(spark, [])).collect() == []


def test_as_of_takes_the_last_at_or_before(spark):
    e = events(spark, [(T0, 1, "click", 1.0, None), (T0 + H, 1, "click", 1.0, None), (T0 + H, 1, "error", 1.0, None), (T0, 2, "error", 1.0, None)])
    assert {r["target_id"]: r["precursor_id"] for r in indicators.as_of(e, "click", "error").collect()} == {2: 1, 3: None}


def test_precursors_at_the_edges_of_the_range(spark):
    e = events(spark, [(T0, 1, "click", 1.0, None), (T0 + 24 * H, 1, "error", 1.0, None), (T0 + 24 * H, 1, "click", 1.0, None), (T0 + 48 * H + dt.timedelta(microseconds=1), 1, "error", 1.0, None)])
    assert {tuple(r) for r in indicators.precursors(e, "click", "error").collect()} == {(1, 0)}


def test_lagged_correlation_skips_holes(spark):
    rows = [("click", T0 + h * H, float(h)) for h in (0, 1, 2, 5)] + [("error", T0 + h * H, float(2 * h)) for h in (1, 2, 3, 9)]
    r = indicators.lagged_correlation(spark.createDataFrame(rows, "tag string, hr timestamp_ntz, v double"), "click", "error", 1).first()
    assert (r["n"], r["r"]) == (3, pytest.approx(1.0))


def test_gap_fill_starts_unknown_and_carries_on(spark):
    e = events(spark, [(T0 + 2 * H, 1, "error", 7.0, None)])
    assert column(quality.grid(e, Config(hours=4)), "v", "hr") == [None, None, 7.0, 7.0]


def test_labels_look_ahead_only(spark):
    e = events(spark, [(T0, 1, "click", 1.0, None), (T0 + H, 1, "error", 1.0, None), (T0 + 2 * H, 1, "click", 1.0, None)])
    assert column(prediction.labels(e), "label", "event_id") == [1, 0, 0]


def test_text_tables_keep_corrupt_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("event_id,ts,user_id,event_type,value,props\n1,2024-01-01 00:00:00,2,error,3.5,\nnone,x,y,z,w,\n")
    good, bad = tables.split_corrupt(tables.read_text_table(spark, str(tmp_path / "x.csv"), tables.EVENTS).cache())
    assert [r["event_id"] for r in good.collect()] == [1] and bad.count() == 1
    (tmp_path / "x.json").write_text('{"event_id": 1, "value": 2.5}\n{broken\n')
    good, bad = tables.split_corrupt(tables.read_text_table(spark, str(tmp_path / "x.json"), tables.EVENTS, "json").cache())
    assert (good.count(), bad.count()) == (1, 1)


def test_tier_replaces_its_own_dates_only(spark, tmp_path):
    row = lambda day, v: spark.createDataFrame([(T0 + dt.timedelta(days=day), v)], "hr timestamp_ntz, v double")
    for day, v in ((0, 1.0), (1, 2.0), (1, 3.0)):
        path = sinks.write_tier(row(day, v), str(tmp_path), "curated", "x", "hr")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1.0, 3.0]
    with pytest.raises(ValueError, match="tier"):
        sinks.write_tier(row(0, 1.0), str(tmp_path), "raw", "x", "hr")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-5, 5).map(lambda x: round(x, 3)), min_size=1, max_size=30))
def test_properties_of_sums_risk_and_episodes(spark, values):
    z = hours(spark, values)
    assert column(kpi.cusum(z), "cs", "hr")[-1] == pytest.approx(sum(values), abs=1e-9)
    assert all(x >= 0 for x in column(kpi.rise(z), "rise", "hr"))
    assert all(0 <= x <= 100 for x in column(risk.likelihood(risk.severity(z)), "risk", "hr"))
    flagged = anomaly.by_z(z)
    assert (anomaly.episodes(flagged).agg(F.sum("n")).first()[0] or 0) == flagged.count()


def test_ewma_of_a_series_in_many_chunks(spark):
    import pandas as pd

    value = lambda i: None if i % 13 in (4, 5) or 60 < i < 90 else float(i * i % 17)
    rows = [(T0 + i * H, None if i % 5 == 1 else 7 if i % 5 else 8 + i % 3, "view", value(i), None) for i in range(300)]
    e = events(spark, rows)
    pdf = pd.DataFrame([(i, -1 if u is None else u, v) for i, (_, u, _, v, _) in enumerate(rows)], columns=["i", "u", "v"])
    want = {(i, u): x for u, one in pdf.groupby("u") for i, x in zip(one["i"], one["v"].ewm(alpha=0.3, adjust=False).mean(), strict=True)}
    got = {(r["event_id"], -1 if r["user_id"] is None else r["user_id"]): r["ewma"] for r in features.ewma_series(e, chunk_rows=20).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], nan_ok=True) if got[k] is not None else pd.isna(want[k]) for k in want)
    last = {-1 if r["user_id"] is None else r["user_id"]: r["ewma"] for r in features.ewma_last(e, chunk_rows=20).collect()}
    known = pdf.dropna()
    assert last == {u: pytest.approx(one["v"].ewm(alpha=0.3, adjust=False).mean().iloc[-1]) for u, one in known.groupby("u")}


def test_ewma_scan_of_ten_chunks_of_ten_chunks(spark):
    """One user has nearly all rows: 100 chunks of 6 rows, composed over two levels of 10, with holes as long as chunks."""
    import pandas as pd

    values = [None if i % 97 < 15 or 200 < i < 214 else float(i * 7 % 23) for i in range(600)]
    rows = [(T0 + i * H, 1, "view", v, None) for i, v in enumerate(values)] + [(T0, 0, "view", 3.0, None), (T0, 2, "view", None, None)]
    e = events(spark, rows).select("event_id", "user_id", "ts", "value")
    got = {r["event_id"]: r["ewma"] for r in features._ewma_by_chunks(e, Config(), 6, fan=10).collect()}
    want = pd.Series(values, dtype=float).ewm(alpha=0.3, adjust=False).mean()
    assert len(got) == 602 and got[600] == 3.0 and pd.isna(got[601])
    assert all(got[i] == pytest.approx(x) if not pd.isna(x) else pd.isna(got[i]) for i, x in enumerate(want))


def test_one_unit_in_many_slices(spark):
    """A unit with all rows is cut up, and what lies before or after a slice is carried into it."""
    draw = [(i * 37 % 11, ("click", "error", "view")[i * 5 % 3]) for i in range(160)]
    at, rows = 0, []
    for step, tag in draw:
        at += step * 7
        rows.append((T0 + at * dt.timedelta(minutes=1), 1, tag, 1.0, None))
    rows += [(T0, 2, "error", 1.0, None), (T0 + H, 2, "click", 1.0, None), (T0, None, "error", 1.0, None), (T0, 1, None, 1.0, None)]
    e = events(spark, rows)
    plain = e.where("user_id = 1 and event_type is not null").collect()
    whole, cut = ({f.__name__: sorted(map(tuple, f(e, *x, slice_rows=n).collect()), key=repr) for f, *x in ((indicators.as_of, "click", "error"), (anomaly.unit_sessions,), (prediction.labels,), (indicators.root_causes, "error"), (indicators.precursor_rate, "click", "error"))} for n in (1000, 9))
    assert cut == whole
    us = {r["event_id"]: r["ts"] for r in plain}
    near = [(a["event_id"], b["event_id"], b["event_type"]) for a in plain for b in plain if a["event_type"] == "error" and dt.timedelta(0) < us[a["event_id"]] - us[b["event_id"]] <= 24 * H]
    assert dict((t, (n, m)) for t, n, m in cut["root_causes"])["click"] == (sum(k == "click" for *_, k in near), len({a for a, _, k in near if k == "click"}))
    label = dict(cut["labels"])
    for r in plain:
        assert label[r["event_id"]] == any(x["event_type"] == "error" and dt.timedelta(0) < x["ts"] - r["ts"] <= 6 * H for x in plain)


def test_keep_first_by_time_then_id(spark):
    e = events(spark, [(T0 + H, 1, "a", 1.0, None), (T0, 1, "a", 2.0, None), (T0, 1, "a", 3.0, None), (T0, None, "a", 4.0, None), (T0, None, "a", None, None)])
    assert sorted(column(quality.keep_first(e), "event_id", "event_id")) == [1, 3]
    assert quality.keep_first(e).columns == e.columns


def test_smoothing_goes_by_the_clock(spark):
    z = spark.createDataFrame([("a", T0, 10.0), ("a", T0 + 23 * H, 2.0), ("a", T0 + 24 * H, 4.0)], "tag string, hr timestamp_ntz, z double")
    assert column(kpi.smoothed(z), "kpi", "hr") == [10.0, 6.0, 3.0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 6), st.one_of(st.none(), st.integers(0, 4))), min_size=1, max_size=40))
def test_windows_over_blocks_equal_windows_over_tags(spark, rows):
    from pyspark.sql import Window

    e = events(spark, [(T0 + m * H, 1, k, None if v is None else float(v), None) for k, m, v in rows])
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    want = {r["event_id"]: (r["roll"], r["diff"]) for r in e.select("event_id", F.avg("value").over(w.rowsBetween(-5, -1)).alias("roll"), (F.col("value") - F.lag("value", 3).over(w)).alias("diff")).collect()}
    roll = {r["event_id"]: r["roll"] for r in features.rolling_rows(e, 5, block_rows=6).collect()}
    diff = {r["event_id"]: r["diff"] for r in features.differenced(e, 3, block_rows=6).collect()}
    assert {k: (pytest.approx(roll[k]) if roll[k] is not None else None, diff[k]) for k in roll} == want
    ranks = {r["event_id"]: tuple(r[c] for c in ("rn", "rk", "dr", "tile")) for r in features.ranked(e.select("event_id", "event_type", "ts", "value"), "event_type", ("ts", "value"), 3, slice_rows=5).collect()}
    v = Window.partitionBy("event_type").orderBy("ts", "value")
    exact = {r["event_id"]: (r["rk"], r["dr"]) for r in e.select("event_id", F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr")).collect()}
    assert {k: x[1:3] for k, x in ranks.items()} == exact
    for tag in ("a", "b"):
        n = sum(k == tag for k, _, _ in rows)
        assert sorted(ranks[i][0] for i, x in enumerate(rows) if x[0] == tag) == [*range(1, n + 1)]
        tiles = sorted(ranks[i][3] for i, x in enumerate(rows) if x[0] == tag)
        assert tiles == [t for t in (1, 2, 3) for _ in range(n // 3 + (t <= n % 3))]


def test_stuck_runs_across_blocks(spark):
    values = [1.0, 1.2, 1.4, 1.5, 9.0, 9.1, 9.2, 3.0]
    e = events(spark, [(T0 + i * H, 1, "error", v, None) for i, v in enumerate(values)])
    for rows in (1, 2, 3, 100):
        assert [(r["run"], r["n"]) for r in quality.stuck(e, block_rows=rows).orderBy("run").collect()] == [(1, 4), (2, 3)]


def test_quantiles_of_nulls_ties_and_single_rows(spark):
    from emberline.operators.ordered import quantiles

    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", None), ("b", 5.0), ("c", None), (None, 3.0), (None, 4.0)], "k string, v double")
    for size in (1, 2, 100):
        got = {r["k"]: (r["q"], r["m"]) for r in quantiles(rows, "k", "v", {"q": 0.25, "m": 0.5}, size).collect()}
        assert got == {"a": (1.0, 1.5), "b": (5.0, 5.0), None: (3.25, 3.5)}
    assert quantiles(rows.limit(0), "k", "v", {"m": 0.5}).count() == 0


def test_lift_by_hand(spark):
    e = events(spark, [(T0, 1, "click", 1.0, None), (T0 + H, 1, "error", 1.0, None), (T0 + 2 * H, 1, "view", 1.0, None), (T0 + 30 * H, 1, "error", 1.0, None), (T0, 2, "view", 1.0, None)])
    r = indicators.precursor_rate(e, "click", "error").first()
    assert (r["events"], r["hits"], r["rate"]) == (2, 1, 0.5) and r["base"] == pytest.approx(1 / 3) and r["lift"] == pytest.approx(1.5)


ALL = "n long, x double, s string, b boolean, ts timestamp_ntz, day date"


def test_workbooks_come_back_equal(spark, tmp_path):
    from emberline.sources import workbooks

    when = dt.datetime(2024, 2, 29, 23, 59, 59, 123456)
    rows = [(1, 0.1, "a <b> & \"c\"", True, when, when.date()), (-(2**53), -2.5e-300, " lead, trail ", False, T0, T0.date()), (None,) * 6, (7, None, "", None, None, None), (8, 1e300, "ä\n\u4e2d", None, None, None)]
    df = spark.createDataFrame(rows, ALL)
    for k, r in enumerate(workbooks.as_workbooks(df, rows_a_sheet=2).collect()):
        (tmp_path / f"{k}.xlsx").write_bytes(r["content"])
    (tmp_path / "note.txt").write_text("no workbook")
    good, bad = tables.split_corrupt(workbooks.read_workbooks(spark, str(tmp_path), df.schema))
    assert bad.count() == 0
    # a row of nulls only is no row of a sheet
    assert sorted(map(repr, map(tuple, good.collect()))) == sorted(repr(r) for r in rows if any(x is not None for x in r))
    assert workbooks.as_workbooks(df.limit(0)).count() == 0


def test_workbooks_of_other_makers(spark):
    """Shared strings with runs, serial dates of both calendars, cells without places, errors, several sheets, columns in another order."""
    import io
    import zipfile

    from emberline.sources import workbooks

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def book(props, *sheets):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}">{props}<sheets>' + "".join(f'<sheet name="s{k}" sheetId="{k}" r:id="r{k}"/>' for k in range(len(sheets))) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="t" Target="/xl/w/{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
            z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>s</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>guide</t></rPh></si><si><t>ts</t></si><si><t>n</t></si></sst>")
            for k, rows in enumerate(sheets):
                z.writestr(f"xl/w/{k}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        return out.getvalue()

    head = '<row><c t="s"><v>2</v></c><c t="s"><v>0</v></c><c t="s"><v>3</v></c></row>'
    one = head + '<row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2"><v>3.0</v></c></row><row r="3"><c r="A3"><v>45350.5</v></c><c r="C3" t="e"><v>#DIV/0!</v></c></row>'
    two = head + '<row><c><v>45350</v></c><c t="str"><v>x</v></c><c><v>1.5</v></c></row>'
    schema = spark.createDataFrame([], "s string, n long, ts timestamp_ntz, missing double").schema
    df = spark.createDataFrame([(bytearray(book("", one, two)),), (bytearray(book('<workbookPr date1904="1"/>', head + "<row><c><v>1</v></c></row>")),), (None,)], "content binary")
    got = sorted((tuple(r) for r in workbooks.parsed(df, schema).collect()), key=repr)
    want = [("two runs", 3, None, None, None), (None, None, dt.datetime(2024, 2, 28, 12), None, None), ("x", None, dt.datetime(2024, 2, 28), None, "45350\tx\t1.5"), (None, None, dt.datetime(1904, 1, 2), None, None)]
    assert got == sorted(want, key=repr)
    assert workbooks.parsed(df, schema, "s1").count() == 1 and workbooks.parsed(df, schema, 0).count() == 3


def test_sketches_merge_to_what_they_would_have_been(spark):
    from emberline.operators import sketches

    e = events(spark, [(T0 + (i % 50) * H, i % 700, "ab"[i % 3 == 0], None if i % 11 == 0 else float(i * 7919 % 5000), None) for i in range(5000)] + [(T0, None, "c", None, None)])
    hourly = sketches.hourly_sketches(e)
    days = sketches.merged(hourly.withColumn("day", F.date_trunc("day", "hr")), "tag", "day")
    for source in (hourly, days):
        found = {r["tag"]: r for r in sketches.estimates(sketches.merged(source, "tag"), "tag").collect()}
        assert found["c"]["quantile"] is None and found["c"]["n"] == 1
        for tag in "ab":
            values = sorted(float(i * 7919 % 5000) for i in range(5000) if "ab"[i % 3 == 0] == tag and i % 11)
            rank = sum(v <= found[tag]["quantile"] for v in values) / len(values)
            assert abs(rank - 0.95) <= sketches.RANK_ERROR
            assert abs(found[tag]["units"] - 700) <= sketches.COUNT_ERROR * 700


def subsets_by_brute_force(nodes, weights, x):
    """Base and Shapley parts by all subsets of the features; a feature outside of a subset takes each turn by its share of training rows."""
    import itertools
    import math

    def value(tree, node, known):
        r = nodes[tree, node]
        if r["leftChild"] < 0:
            return r["prediction"]
        f, at = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return value(tree, r["leftChild"] if x[f] <= at else r["rightChild"], known)
        return sum(nodes[tree, c]["rawCount"] / r["rawCount"] * value(tree, c, known) for c in (r["leftChild"], r["rightChild"]))

    game = lambda known: 2 * sum(w * value(t, 0, known) for t, w in enumerate(weights))
    m, parts = len(x), []
    for f in range(m):
        rest = [k for k in range(m) if k != f]
        parts.append(sum(math.factorial(len(s)) * math.factorial(m - 1 - len(s)) / math.factorial(m) * (game({*s, f}) - game(set(s))) for n in range(m) for s in itertools.combinations(rest, n)))
    return game(set()), parts


def test_shapley_parts_by_all_subsets(spark, tmp_path):
    import numpy as np

    from emberline.operators import explain

    rows = [(T0 + i * H, *(float((i * p) % 17) for p in (3, 5, 7, 11, 2)), float((i * 3 % 17 > 8) ^ (i * 7 % 17 > 5))) for i in range(200)]
    names = [f"z_{k}" for k in "abcde"]
    df = spark.createDataFrame(rows, "hr timestamp_ntz, " + ", ".join(f"{n} double" for n in names) + ", label double")
    model, assembled, _ = prediction.fitted(df, "trees", Config(cutoff="2024-01-07 00:00:00"))
    model.write().save(str(tmp_path / "model"))
    nodes = {(r["treeID"], r["id"]): r for r in spark.read.parquet(str(tmp_path / "model" / "data")).select("treeID", "nodeData.*").collect()}
    x = np.array([r[1:6] for r in rows[::9]])
    base, parts = explain.shapley(x, explain.leaves(model, spark))
    for k in range(len(x)):
        want_base, want = subsets_by_brute_force(nodes, model.treeWeights, x[k])
        assert base == pytest.approx(want_base) and parts[k] == pytest.approx(want, abs=1e-9)
    found = prediction.explained(df, "trees", Config(cutoff="2024-01-07 00:00:00"))
    sums = found.groupBy("hr").agg((F.sum("part") + F.first("base")).alias("a"), F.first("log_odds").alias("b")).collect()
    assert len(sums) == 200 - 6 * 24 and all(r["a"] == pytest.approx(r["b"]) for r in sums)


def test_regression_and_fit_without_a_solution(spark):
    from emberline.functions import linear

    rows = [("a", float(i), 2.0 * i, 3.0 * i) for i in range(9)] + [("b", float(i % 3), float(i), 1.0 + 2 * (i % 3) - i) for i in range(9)] + [("c", 1.0, 2.0, 3.0), ("d", None, 1.0, 1.0)]
    found = {r["k"]: r for r in linear.least_squares(spark.createDataFrame(rows, "k string, u double, v double, y double"), "k", "y", ["u", "v"]).collect()}
    assert set(found) == {"a", "b", "c"} and found["a"]["u"] is None and found["c"]["v"] is None
    assert (found["b"]["u"], found["b"]["v"], found["b"]["se_u"]) == (pytest.approx(2), pytest.approx(-1), pytest.approx(0, abs=1e-6))
    same = spark.createDataFrame([(T0 + i * H, float(i), 0.0) for i in range(300)], "hr timestamp_ntz, z_a double, label double")
    assert {r["p"] for r in prediction.logistic_predicted(same).collect()} == {0.0}
    assert {(r["part"], r["log_odds"]) for r in prediction.explained(same).collect()} == {(0.0, float("-inf"))}
    assert prediction.logistic_predicted(same.limit(0)).count() == 0


@pytest.mark.parametrize("label", [0.0, 1.0])
def test_a_fit_of_one_label_can_stop_after_newton_steps(spark, label):
    """No optimum: the steps themselves, in numpy with curvature and penalty, say where the model stands."""
    rows = [(T0 + i * H, float(i % 7), float(i * i % 11)) for i in range(300)]
    df = spark.createDataFrame([(*x, label) for x in rows], "hr timestamp_ntz, z_a double, z_b double, label double")
    x = np.array([(1, a, b) for t, a, b in rows if t < T0 + 240 * H])
    pull, beta = prediction.RIDGE * np.array([0, *x[:, 1:].var(axis=0, ddof=1)]), np.zeros(3)
    for _ in range(prediction.ONE_LABEL_STEPS):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(pull), x.T @ (p - label) / len(x) + pull * beta)
    found = prediction.explained(df, one_label_steps=prediction.ONE_LABEL_STEPS).collect()
    assert len(found) == 120 and {r["part"] for r in found} == {0.0} and [r["log_odds"] for r in found] == pytest.approx([beta[0]] * 120, abs=1e-9)
    chances = prediction.logistic_predicted(df, one_label_steps=prediction.ONE_LABEL_STEPS).collect()
    assert [r["p"] for r in chances] == pytest.approx([1 / (1 + np.exp(-beta[0]))] * 60, abs=1e-12)


def test_no_fold_sees_its_future(spark):
    e = events(spark, [(T0 + i * H, 1, ("click", "error")[i % 2], float(i * i % 29), None) for i in range(30 * 24)])
    before = lambda df: [tuple(r) for r in risk.rolling_origin(df).orderBy("origin").collect()]
    changed = e.withColumn("value", F.when(F.col("ts") >= F.lit(T0 + dt.timedelta(days=20)), F.col("value") * 50).otherwise(F.col("value")))
    a, b = before(e), before(changed)
    assert a[:2] == b[:2] and a[2] != b[2] and len(a) == 4
    assert before(e.limit(0)) == [(T0 + dt.timedelta(days=10 + 5 * k), 0, 0, 0, 0, None, None, None) for k in range(4)]


def test_distinct_counts_carry_a_sketch_a_type_only(spark, tmp_path):
    """And users that are null count in neither."""
    events(spark, [(T0 + i * H, None if i % 5 == 0 else i % 40, ("click", "error")[i % 2], 1.0, None) for i in range(400)]).write.parquet(f"{tmp_path}/events.parquet")
    df = queries.QUERIES["g7_approx_distinct"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    sketches = [x for x in plan.splitlines() if "approx_count_distinct(" in x]
    assert sketches and all(re.search(r"keys=\[event_type#\d+\]", x) for x in sketches)
    assert sorted(map(tuple, df.collect())) == [("click", 16, True), ("error", 16, True)]
