"""Operators on literal frames: the cases that need no data file."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.common import clip, hazard, word_number
from tidemark.functions.ewm import alpha_of, frame_rows, with_ewm_mean, with_ewm_recursive, with_ewm_var
from tidemark.operators import asof, book, changes, grid, labels, market, ranks, regress, resample, scan, shocks, stats, study, tape


def day(n, start=dt.date(2024, 1, 1)):
    return start + dt.timedelta(days=n)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, day(i), v) for i, v in enumerate(values)], "k string, day date, x double")


@pytest.mark.parametrize("date, hour", [("2024-03-15", 16), ("2024-04-15", 15), ("2024-10-30", 16)])
def test_snapshot_follows_summer_time(spark, date, hour):
    rows = [(f"{date} {hour - 1:02d}:59:59",), (f"{date} {hour:02d}:00:00",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tape.snapshot_date(F.col("t").cast("timestamp"))).collect()]
    d = dt.date.fromisoformat(date)
    assert got == [d, d + dt.timedelta(days=1)]


def test_archive_and_live_count_once(spark):
    t = spark.createDataFrame([(i, f"2024-01-0{1 + i} 00:00:00") for i in range(5)], "id int, s string").select("id", F.col("s").cast("timestamp").alias("ts"))
    assert sorted(r["id"] for r in tape.archive_and_live(t, t, "2024-01-03 00:00:00").collect()) == [0, 1, 2, 3, 4]


def test_panel_ties_nulls_and_empty(spark):
    rows = [("p", "1", dt.datetime(2024, 1, 1, 10), 1, 0.4, 10.0, True), ("p", "1", dt.datetime(2024, 1, 1, 10), 2, 0.6, 10.0, False), ("p", "1", dt.datetime(2024, 1, 1, 11), 3, 1.0, 1.0, True), ("p", "2", dt.datetime(2024, 1, 1, 15, 30), 4, None, 1.0, True)]
    t = spark.createDataFrame(rows, "platform string, platform_id string, ts timestamp, event_id long, price double, size double, is_yes boolean")
    got = tape.market_day_panel(tape.with_snapshot(tape.yes_trades(t))).collect()
    assert len(got) == 1 and got[0]["px_last"] == pytest.approx(0.4) and got[0]["n_trades"] == 2 and got[0]["px_vwap_1h"] is None
    assert tape.market_day_panel(tape.with_snapshot(tape.yes_trades(t.limit(0)))).count() == 0


def test_clip_keeps_null_and_hazard(spark):
    r = spark.createDataFrame([(None, 1.0), (9.0, 2.0), (0.5, 0.5)], "x double, y double").select(clip("x", -5, 5).alias("c"), hazard("x", "y").alias("h")).collect()
    assert [x["c"] for x in r] == [None, 5.0, 0.5]
    assert r[0]["h"] is None and r[2]["h"] == pytest.approx(-math.log(0.5) / 0.5)


def test_word_number(spark):
    got = [r[0] for r in spark.createDataFrame([("Three",), ("12",), ("many",), (None,)], "w string").select(word_number("w")).collect()]
    assert got == [3, 12, None, None]


def test_dense_days_skips_empty_spans(spark):
    k = spark.createDataFrame([("a", day(0), day(2)), ("b", day(3), day(1))], "k string, a date, b date")
    assert sorted((r["k"], r["day"]) for r in grid.dense_days(k, "a", "b").collect()) == [("a", day(i)) for i in range(3)]
    assert [r["day"].weekday() for r in grid.business_days(spark, "2024-01-05", "2024-01-09").orderBy("day").collect()] == [4, 0, 1]


def test_asof_strictness(spark):
    p = spark.createDataFrame([("k", 5), ("k", 1), ("z", 5)], "k string, p int")
    r = spark.createDataFrame([("k", 5, "five"), ("k", 3, "three")], "k string, t int, v string")
    for how, want in (("le", "five"), ("lt", "three"), ("ge", "five")):
        got = {(x["k"], x["p"]): x["v"] for x in asof.asof_join(p, r, ["k"], "p", "t", ["v"], how).collect()}
        assert got[("k", 5)] == want and got[("z", 5)] is None
        assert got[("k", 1)] == ("three" if how == "ge" else None)


def test_ewm_against_loops(spark):
    rng = random.Random(4)
    a = alpha_of(halflife=2)
    d, n = 1 - a, 3 * frame_rows(a) + 7  # over several blocks
    xs = [None if i and rng.random() < 0.2 else rng.gauss(0, 1) for i in range(n)]
    s = series(spark, xs)
    got = [r["y"] for r in with_ewm_mean(s, "y", F.col("x"), a, ["k"], "day").orderBy("day").collect()]
    num = den = 0.0
    for x, y in zip(xs, got):
        num, den = num * d + (x or 0.0), den * d + (x is not None)
        assert y == pytest.approx(num / den, abs=1e-12)
    full = [x or 0.0 for x in xs]
    got = [r["y"] for r in with_ewm_recursive(series(spark, full), "y", F.col("x"), a, ["k"], "day").orderBy("day").collect()]
    state = None
    for x, y in zip(full, got):
        state = x if state is None else d * state + a * x
        assert y == pytest.approx(state, abs=1e-12)
    got = [r["y"] for r in with_ewm_var(series(spark, full), "y", F.col("x"), a, ["k"], "day").orderBy("day").collect()]
    assert got[0] is None
    for last in (1, 40, n - 1):
        w = [d ** (last - i) for i in range(last + 1)]
        m = sum(p * q for p, q in zip(w, full)) / sum(w)
        var = sum(p * (q - m) ** 2 for p, q in zip(w, full)) / sum(w) * sum(w) ** 2 / (sum(w) ** 2 - sum(p * p for p in w))
        assert got[last] == pytest.approx(var)


def test_expanding_median_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(u, day(rng.randint(0, 12)), rng.choice([0.0, None, rng.gauss(0, 1), round(rng.gauss(0, 1), 1)])) for u in ("p", "q") for _ in range(90)]
    got = {(r["unit"], r["day"]): r["fallback"] for r in changes.fallback_scale(spark.createDataFrame(rows, "unit string, day date, dv double")).collect()}
    want = {}
    for u, d, _ in rows:
        past = [abs(v) for x, y, v in rows if x == u and y < d and v is not None]
        if past:
            want[u, d] = 1.4826 * float(np.median(past))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_gap_scaling_and_causality(spark):
    rows = [("c", day(0), 1.0), ("c", day(4), 3.0), ("c", day(20), 9.0)]
    df = spark.createDataFrame(rows, "contract_id string, day date, value double")
    got = [r["dv"] for r in changes.gap_scaled_changes(df).orderBy("day").collect()]
    assert got == [None, 1.0, None]
    many = [("c", day(i), math.sin(i)) for i in range(30)]
    later = [(k, d, v if i < 20 else 100 * v) for i, (k, d, v) in enumerate(many)]
    past = []
    for data in (many, later):
        d = changes.past_scale(changes.gap_scaled_changes(spark.createDataFrame(data, "contract_id string, day date, value double")))
        past.append([r["own_sd"] for r in d.orderBy("day").collect()][:21])
    assert past[0] == past[1]


def test_shock_parity_equals_the_loop(spark):
    rng = random.Random(2)
    for _ in range(3):
        flags = [(rng.random() < 0.3, rng.random() < 0.6) for _ in range(40)]
        rows = [("a", i, c, n and i > 0) for i, (c, n) in enumerate(flags)]
        got = [r["confirmed"] for r in changes.confirmed_shocks(spark.createDataFrame(rows, "k string, i int, c0 boolean, n boolean"), ["k"], "i").orderBy("i").collect()]
        want, last = [], False
        for _, _, c, n in rows:
            last = c or (n and not last)
            want.append(last)
        assert got == want


def test_total_losses_compound(spark):
    for rs in ([0.1, -1.0, 0.2], [0.1, -1.5, 0.2], [0.1, None, -0.4]):
        rows = series(spark, rs).withColumnRenamed("x", "r")
        wealth, want = 1.0, []
        for r in rs:
            wealth *= 1 + (r or 0)
            want.append(wealth)
        d = stats.drawdowns(rows, ["k"], "day").orderBy("day").collect()
        assert [round(r["wealth"], 9) for r in d] == [round(x, 9) for x in want]
        assert [round(r["dd"], 9) for r in d] == [round(x / max(want[: i + 1]) - 1, 9) for i, x in enumerate(want)]
        assert abs(stats.perf_stats(rows, ["k"]).head()["total_return"] - (want[-1] - 1)) < 1e-9


def test_drawdowns_against_a_loop(spark):
    rng = random.Random(8)
    rs = [rng.gauss(0, 0.03) for _ in range(60)]
    d = stats.drawdowns(series(spark, rs).withColumnRenamed("x", "r"), ["k"], "day")
    got = sorted((r["peak"], r["trough"], r["recovery"], round(r["depth"], 9)) for r in stats.drawdown_episodes(d, ["k"], "day").collect())
    wealth, want, at = np.cumprod(1 + np.array(rs)), [], 0
    while at < len(rs):
        end = at + 1
        while end < len(rs) and wealth[end] < wealth[at]:
            end += 1
        if end > at + 1:
            low = at + int(np.argmin(wealth[at:end]))
            want.append((day(at), day(low), day(end) if end < len(rs) else None, round(wealth[low] / wealth[at] - 1, 9)))
        at = end
    assert got == sorted(want)


def test_book_against_loops(spark):
    rng = random.Random(9)
    ws, rs = [rng.choice([0.0, rng.uniform(-2, 2)]) for _ in range(50)], [rng.gauss(0, 0.01) for _ in range(50)]
    df = spark.createDataFrame([("a", day(i), w, r) for i, (w, r) in enumerate(zip(ws, rs))], "k string, day date, w double, r double")
    got = book.position_pnl(df, ["k"], "day", half_spread=0.003).orderBy("day").collect()
    for i, row in enumerate(got):
        before = ws[i - 1] if i else 0.0
        assert row["pnl"] == pytest.approx(before * rs[i]) and row["cost"] == pytest.approx(abs(ws[i] - before) * 0.003)
    band = [r["held"] for r in book.no_trade_band(df, ["k"], "day", "w", 0.3).orderBy("day").collect()]
    last = 0.0
    for w, held in zip(ws, band):
        if last == 0 or w == 0 or abs(w - last) > 0.3 * abs(last):
            last = w
        assert held == last


@pytest.mark.parametrize("band", [0.0, 0.1, 0.5, 1.0, 2.5])
def test_band_by_chunks_against_a_loop(spark, band):
    rng = random.Random(int(band * 10))
    rows = []
    for k in ("a", "b", None):
        x = 1.0
        for i in range(120):
            x = rng.choice([x * rng.uniform(0.85, 1.2), x, -x, 0.0 if rng.random() < 0.2 else x + 0.01, rng.uniform(-2, 2)])
            rows.append((k, i, None if rng.random() < 0.1 or 40 <= i < 55 else x))
    df = spark.createDataFrame(rows, "k string, i int, w double")
    got = {(r["k"], r["i"]): r["held"] for r in book.no_trade_band(df, ["k"], "i", "w", band, chunk=F.floor(F.col("i") / 7)).collect()}
    for k in ("a", "b", None):
        last = 0.0
        for _, i, w in (r for r in rows if r[0] == k):
            if w is not None and (last == 0 or w == 0 or abs(w - last) > band * abs(last)):
                last = w
            assert got[k, i] == last
    assert len(got) == 360


@pytest.mark.parametrize("segment", ["i div 7", "i div 1000", "i"])
def test_scans_over_segments_against_loops(spark, segment):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, None, rng.randint(-9, 9)])) for k in ("a", None, "b") for i in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    both = scan.running_sum(scan.last_known(df, "f", "v", ["k"], ["i"], F.expr(segment)), "s", "v", ["k"], ["i"], F.expr(segment))
    got = {(r["k"], r["i"]): r.asDict() for r in scan.last_known(both, "n", "v", ["k"], ["i"], F.expr(segment), ahead=True).collect()}
    assert len(got) == len(rows) and set(next(iter(got.values()))) == {"k", "i", "v", "f", "s", "n"}
    for k, i, v in rows:
        mine = [(j, x) for q, j, x in rows if q == k and x is not None]
        past, later = [x for j, x in mine if j <= i], [x for j, x in mine if j >= i]
        r = got[k, i]
        assert r["v"] == v and r["f"] == (past[-1] if past else None) and r["n"] == (later[0] if later else None)
        assert r["s"] == (sum(past) if past else None)


def test_a_hot_key_is_spread_over_tasks(spark):
    n = 60000
    start = F.lit("2020-01-01").cast("timestamp").cast("long")
    t = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), (start + F.col("id") * 2000).cast("timestamp").alias("t"), F.col("id").alias("v"))
    p = t.select("k", (F.col("t") + F.expr("interval 1 second")).alias("p"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        out = asof.asof_join(p, t, ["k"], "p", "t", ["v"])
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("v")).collect()]
        assert sum(sizes) == n and max(sizes) < 2 * n / 16  # the hot key alone would be five shares
        assert out.where("k = 'hot' and v is not null").count() == n // 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_asof_ties_are_settled(spark):
    p = spark.createDataFrame([("k", 5)], "k string, p int")
    r = spark.createDataFrame([("k", 5, 3, "x"), ("k", 5, 9, "y"), ("k", 5, 1, "z")], "k string, t int, o int, v string")
    assert asof.asof_join(p, r, ["k"], "p", "t", ["v"], "le", ties=["o"]).head()["v"] == "y"
    assert asof.asof_join(p, r, ["k"], "p", "t", ["v"], "ge", ties=["o"]).head()["v"] == "z"


def test_asof_nulls_match_nothing(spark):
    p = spark.createDataFrame([("k", None), (None, 5), ("k", 5)], "k string, p int")
    r = spark.createDataFrame([("k", None, "a"), (None, 3, "b"), (None, 5, "c"), (None, 7, "d"), ("k", 9, "e")], "k string, t int, v string")
    for how, want in (("le", None), ("lt", None), ("ge", "e")):
        got = {(x["k"], x["p"]): (x["t_found"], x["v"]) for x in asof.asof_join(p, r, ["k"], "p", "t", ["v"], how).collect()}
        assert got == {("k", None): (None, None), (None, 5): (None, None), ("k", 5): (want and 9, want)}


def test_scans_ahead_compute_no_frame_anew_for_every_row(spark):
    n = 20000
    t = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 3).cast("int").alias("t"), F.col("id").alias("v"))  # one key and segment
    p = spark.range(n + 1).select(F.lit("k").alias("k"), (F.col("id") * 3 - 1).cast("int").alias("p"))
    out = asof.asof_join(p, t, ["k"], "p", "t", ["v"], "ge")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    assert out.where("v <=> if(p > 3 * 19999, null, (p + 1) div 3)").count() == n + 1


def test_caps_and_waterfill_against_loops(spark):
    rng = random.Random(10)
    legs = {leg: [rng.random() ** 3 + 1e-3 for _ in range(n)] for leg, n in (("x", 7), ("y", 3), ("z", 12))}
    legs = {leg: [v / sum(vs) for v in vs] for leg, vs in legs.items()}
    df = spark.createDataFrame([(leg, i, v) for leg, vs in legs.items() for i, v in enumerate(vs)], "leg string, i int, w double")
    got = {(r["leg"], r["i"]): r["filled"] for r in book.waterfill(df, ["leg"], "w", 0.25, "i").collect()}
    for leg, vs in legs.items():
        out = list(vs)
        if len(vs) * 0.25 < 1:
            out = [1 / len(vs)] * len(vs)
        else:
            for _ in range(len(vs) + 1):
                full = [v >= 0.25 - 1e-12 for v in out]
                free = sum(v for v, f in zip(vs, full) if not f)
                out = [0.25 if f else v * (1 - 0.25 * sum(full)) / free for v, f in zip(vs, full)]
        assert [got[leg, i] for i in range(len(vs))] == pytest.approx(out)
    capped = {(r["leg"], r["i"]): r["capped"] for r in book.cap_weights(df, ["leg"], 0.3, 0.8).collect()}
    for leg, vs in legs.items():
        out = [min(v, 0.3 * sum(vs)) for v in vs]
        scale = min(1.0, 0.8 / sum(out))
        assert [capped[leg, i] for i in range(len(vs))] == pytest.approx([v * scale for v in out])


def test_timing_and_legs_against_formulas(spark):
    got = [r[0] for r in spark.createDataFrame([(i,) for i in range(9)], "s int").select(book.timing_exposure("s", 0.4, 7)).collect()]
    assert got == pytest.approx([min(1.0, 0.4 + 0.6 * i / 7) for i in range(9)])
    ns = range(1, 23)
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n int").select(book.leg_sizes("n")).collect()]
    assert got == [max(1, n // 3) for n in ns]


def test_covariance_and_target_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, (40, 3))
    x[5, 1] = np.nan
    rows = [("abc"[j], day(i), None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "ticker string, day date, rx double")
    got = {(r["day"], r["a"], r["b"]): r["c"] for r in market.ewma_cov(df, span=9, min_rows=20).collect()}
    s, w, z = None, np.array([1.0, -0.5, 0.2]), np.nan_to_num(x)
    weights = spark.createDataFrame([("abc"[j], day(i), float(w[j])) for i in range(40) for j in range(3)] + [("a", day(50), 1.0)], "ticker string, day date, w double")
    scale = {r["day"]: r["k"] for r in market.target_scale(weights, market.ewma_cov(df, span=9, min_rows=20), 0.1).collect()}
    assert scale[day(50)] is None and scale[day(3)] is None
    for i in range(40):
        o = np.outer(z[i], z[i])
        s = o if s is None else 0.8 * s + 0.2 * o
        if i >= 19:
            assert got[day(i), "a", "c"] == pytest.approx(s[0, 2]) and got[day(i), "b", "b"] == pytest.approx(s[1, 1])
            assert scale[day(i)] == pytest.approx(0.1 / math.sqrt(252 * w @ s @ w))
    assert len(got) == 21 * 6


def test_held_weights_and_listed_tilt(spark):
    w = spark.createDataFrame([(day(2), "a", 1.0), (day(2), "b", -1.0), (day(5), "a", 0.5)], "day date, ticker string, w double")
    days = spark.createDataFrame([(day(i),) for i in range(8)], "day date")
    got = {(r["day"], r["ticker"]): r["w"] for r in market.held(w, days).collect()}
    want = {(day(i), t): v for i in (2, 3, 4) for t, v in (("a", 1.0), ("b", -1.0))} | {(day(i), "a"): 0.5 for i in (5, 6, 7)}
    assert got == want
    v = spark.createDataFrame([(day(i), t, None if (i, t) == (1, "b") else 0.1 * (j + 1)) for i in range(3) for j, t in enumerate("abcd")], "day date, ticker string, vol double")
    side = F.when(F.col("ticker").isin("a", "b"), 1).when(F.col("ticker") == "c", -1)
    got = {(r["day"], r["ticker"]): r["w"] for r in market.list_tilt(v, side).collect()}
    assert {d for d, _ in got} == {day(0), day(2)}
    assert [got[day(0), t] for t in "abc"] == pytest.approx([2 / 3, 1 / 3, -1.0])


def panel(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for j, p in enumerate("pqr"):
        x = rng.normal(0, 1, n)
        y = 0.3 * (j + 1) * x + rng.normal(0, 1, n) + j
        rows += [(p, i, float(y[i]), float(x[i]), float(3 * x[i]), 2.0) for i in range(n)]
    return rows


def lagged(h, lags):
    s = h.T @ h
    for l in range(1, lags + 1):
        g = h[l:].T @ h[:-l]
        s = s + (1 - l / (lags + 1)) * (g + g.T)
    return s


def test_panel_slopes_and_wald_against_numpy(spark):
    rows = panel(1)
    df = spark.createDataFrame(rows, "pair string, t int, y double, x double, triple double, flat double")
    y, x = (np.array([r[c] for r in rows]).reshape(3, -1) for c in (2, 3))
    yc, xc = y - y.mean(1, keepdims=True), x - x.mean(1, keepdims=True)
    b = (xc * yc).sum() / (xc * xc).sum()
    se = math.sqrt(lagged((xc * (yc - b * xc)).sum(0)[:, None], 4)[0, 0]) / (xc * xc).sum()
    fit = regress.panel_fit(df, "pair", "t", "y", ["x", "triple", "flat"], lags=4)
    assert [r["regressor"] for r in fit] == ["x"] and fit[0]["n"] == len(rows)
    assert fit[0]["coef"] == pytest.approx(b) and fit[0]["se"] == pytest.approx(se)
    one = regress.panel_slopes(df.withColumn("lags", F.lit(4)).withColumn("g", F.lit("all")), ["g"], "pair", "t", "y", "x", "lags").first()
    assert one["coef"] == pytest.approx(b) and one["t"] == pytest.approx(b / se) and one["n"] == len(rows)
    bs, xx = (xc * yc).sum(1) / (xc * xc).sum(1), (xc * xc).sum(1)
    v = lagged((xc * (yc - bs[:, None] * xc)).T, 4) / np.outer(xx, xx)
    r = np.array([[1.0, -1.0, 0.0], [0.0, 1.0, -1.0]])
    wald = (r @ bs) @ np.linalg.inv(r @ v @ r.T) @ (r @ bs)
    got = regress.wald_equal_slopes(df, "pair", "t", "y", "x", lags=4)
    assert got["n"] == 3 and got["wald"] == pytest.approx(wald) and got["p"] == pytest.approx(math.exp(-wald / 2))
    assert regress.wald_equal_slopes(df.where("pair = 'p'"), "pair", "t", "y", "x")["wald"] is None


def test_chi2_tail():
    for x in (0.5, 3.0, 9.0):
        assert regress.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)))
        assert regress.chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
        assert regress.chi2_tail(x, 3) == pytest.approx(math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2))


def test_newey_west_auto_against_numpy(spark):
    rows = [r for r in panel(2) if r[0] == "q"]
    df = spark.createDataFrame(rows, "pair string, t int, y double, x double, triple double, flat double")
    y, x = (np.array([r[c] for r in rows]) for c in (2, 3))
    m = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.solve(m.T @ m, m.T @ y)
    lags = math.floor(4 * (len(x) / 100) ** (2 / 9))
    inv = np.linalg.inv(m.T @ m)
    cov = inv @ lagged(m * (y - m @ b)[:, None], lags) @ inv
    got = regress.newey_west_auto(df, ["pair"], "t", "y", "x").first()
    assert got["lags"] == lags and got["beta"] == pytest.approx(b[1]) and got["alpha"] == pytest.approx(b[0])
    assert got["t"] == pytest.approx(b[1] / math.sqrt(cov[1, 1])) and got["t_alpha"] == pytest.approx(b[0] / math.sqrt(cov[0, 0]))


def test_cell_signal_waits_for_active_days(spark):
    rng = random.Random(12)
    rows = [("c", day(i), rng.gauss(0, 1), int(rng.random() < 0.8)) for i in range(70)]
    got = shocks.cell_signal(spark.createDataFrame(rows, "c string, day date, d double, n_contracts int"), ["c"], 4.0).orderBy("day").collect()
    d, s, num, den = 0.5 ** (1 / 4), [], 0.0, 0.0
    for _, _, x, n in rows:
        num, den = num * d + (x if n else 0.0), den * d + 1
        s.append(num / den)
    for i, r in enumerate(got):
        before = [n for _, _, _, n in rows[:i]]
        used = [s[j] for j in range(i) if sum(before[:j]) > 0]
        z = s[i] / np.std(used, ddof=1) if sum(before) >= 20 and len(used) >= 20 else 0.0
        assert r["z"] == pytest.approx(z)


def test_resampling_keeps_months_and_lengths(spark):
    s = series(spark, [float(i) for i in range(60)])
    sh = resample.shuffle_within_month(s, 2, ["k"], "day", "x").collect()
    for seed in (0, 1):
        jan = sorted(r["x"] for r in sh if r["seed"] == seed and r["day"].month == 1)
        assert jan == [float(i) for i in range(31)]
    assert resample.block_bootstrap(s.limit(30), 3, 20, ["k"], "day", "x").count() == 0


def test_bootstrap_against_exploded_blocks(spark):
    rng = random.Random(8)
    x = [rng.gauss(0.1, 1) for _ in range(67)]
    b = resample.block_bootstrap(series(spark, x), 40, 20, ["k"], "day", "x")
    got = {r["draw"]: (r["n"], r["sh"]) for r in b.withColumn("sh", resample.sharpe_of_sums()).collect()}
    for draw in range(40):
        values = []
        for n in range(4):
            start = int(hashlib.md5(f"boot|a|{draw}|{n}".encode()).hexdigest()[:8], 16) % 48
            values += x[start : start + min(20, 67 - 20 * n)]
        assert got[draw][0] == 67 and got[draw][1] == pytest.approx(np.mean(values) / np.std(values, ddof=1) * 252**0.5)


@pytest.mark.parametrize("strict", [True, False])
def test_running_quantiles_against_numpy(spark, strict):
    rng = random.Random(9)
    rows = [(k, rng.randint(0, 20), rng.choice([0.0, None, float("nan"), 5.0, -5.0, rng.gauss(0, 3), rng.gauss(0, 1) * 10 ** rng.randint(-300, 300)])) for k in "ab" for _ in range(150)]
    rows += [("a", 20, 1.0 + i * 2.0**-50) for i in range(40)]  # values of one narrow cell
    df = spark.createDataFrame(rows, "k string, t int, x double")
    points = spark.createDataFrame([(k, t) for k in "abc" for t in range(22)], "k string, t int")
    for q in (0.5, 0.9, 0.0, 1.0):
        got = {(r["k"], r["t"]): (r["n"], r["quantile"]) for r in ranks.running_quantile(df, points, ["k"], "t", "x", q, strict).collect()}
        want = {}
        for k in "abc":
            for t in range(22):
                past = [x for y, s, x in rows if y == k and (s < t or s == t and not strict) and x is not None and x == x]
                if past:
                    want[k, t] = (len(past), float(np.quantile(past, q)))
        assert got.keys() == want.keys()
        for k in got:
            assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12)


def test_running_quantiles_of_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate([inf, -inf, 1.0, inf, None])] + [(None, 0, 1.0)], "k string, t int, x double")
    got = {r["t"]: r["quantile"] for r in ranks.running_quantile(df, df, ["k"], "t", "x", 0.5, False).collect()}
    assert got[0] == inf and got[2] == 1.0 and got[3] == inf and got[4] == inf


def test_a_hot_cell_is_counted_not_gathered(spark):
    rows = spark.range(200000).select(F.lit("a").alias("k"), (F.col("id") % 40).cast("int").alias("t"), F.lit(2.5).alias("x"))
    got = ranks.running_quantile(rows, rows, ["k"], "t", "x", 0.5, True).collect()
    assert sorted((r["t"], r["n"], r["quantile"]) for r in got) == [(t, 5000 * t, 2.5) for t in range(1, 40)]


def test_runs_are_combinations_of_event_sums(spark):
    rng = random.Random(10)
    rows = [(f"c{c}", c // 3, c % 2 == 0, day(d), rng.choice([None, rng.gauss(0, 1)]), rng.choice([5.0, 40.0, 90.0]), rng.random()) for c in range(24) for d in range(60) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "contract_id string, event_no int, used boolean, day date, z double, vol7d double, vol1d double")
    runs = [("actual", "actual", 0.0, 5.0), ("reversed", "sign", -1.0, 5.0), ("equal", "equal", 0.0, 5.0), ("random", "random", 0.0, 5.0), ("volume:30", "volume", 30.0, 5.0), ("halflife:2", "actual", 0.0, 2.0)]
    sums = study.event_days(df, runs, F.col("used"))
    volume = {}
    for r in rows:
        if r[2]:
            volume[r[1]] = volume.get(r[1], 0) + r[6]
    removed = study.top_events(sums, 3)
    assert removed == sorted(volume, key=lambda e: (-round(volume[e], 6), e))[:3]
    for least in (1, 3):
        got = {(r["run"], r["day"]): (r["d"], r["n_contracts"]) for r in study.run_signals(sums, runs, 5.0, least, removed).collect()}
        days = sorted({r[3] for r in rows})
        every = [days[0] + dt.timedelta(days=i) for i in range((days[-1] - days[0]).days + 1)]
        assert {d for _, d in got} == set(every)
        for name, kind, p, _ in [*runs, *[(f"without:{e}", "without", e, 5.0) for e in removed]]:
            for d in every:
                mine = [r for r in rows if r[3] == d and r[4] is not None and r[2] == (kind != "random")]
                mine = [r for r in mine if not (kind == "volume" and r[5] < p) and not (kind == "without" and r[1] == p)]
                value = 0.0
                if len({r[1] for r in mine}) >= least and mine:
                    sign = lambda r: p if kind == "sign" else 1.0
                    if kind == "random":
                        sign = lambda r: 1.0 if int(hashlib.md5(f"placebo|{name}|{r[0]}".encode()).hexdigest()[:8], 16) % 2 == 0 else -1.0
                    weight = [1.0 if kind == "equal" else r[5] for r in mine]
                    value = sum(sign(r) * r[4] * w for r, w in zip(mine, weight)) / sum(weight)
                else:
                    mine = []
                assert got[name, d] == (pytest.approx(value, abs=1e-9), len(mine)), (name, d)


def test_labels(spark):
    df = spark.createDataFrame([(1, "Red ring page=3"), (2, None), (3, "nothing")], "id int, t string")
    a, b, c = labels.first_match("t", [("r1", "paged", r"page=\d+"), ("r2", "ring", "ring")])
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in df.select("id", a.alias("a"), b.alias("b"), c.alias("c")).collect()}
    assert got == {1: ("paged", "r1", "page=3"), 2: (None, None, None), 3: (None, None, None)}


def test_bucket_families_and_open_ends(spark):
    rows = [("e", 1, 3.0, 7.0, 1), ("e", 2, 5.0, 7.0, -1), ("e", 3, None, 6.0, 1), ("e", 4, None, 2.0, -1), ("e", 5, None, 2.0, 0)]
    rows += [("f", 6, 4.0, 1.0, 1), ("f", 7, 4.0, 2.0, 1), ("g", 8, 4.0, 1.0, -1)]
    df = spark.createDataFrame(rows, "e string, i int, a double, b double, direction int")
    out = labels.mark_families(df, "e", [("first", "a", "b"), ("second", "b", None)], "direction")
    got = {r["i"]: (r["partition"], r["unit"], r["bucket"], r["direction"]) for r in out.collect()}
    assert got[1] == (True, "first", 3.0, 0) and got[2] == (True, "first", 5.0, 0)
    assert got[3] == (True, "first", 7.0, 0) and got[4] == (True, "first", 1.0, 0)  # half the gap of 2 beyond the threshold
    assert got[5] == (False, None, None, 0)
    assert got[6] == (True, "second", 1.0, 0) and got[7] == (True, "second", 2.0, 0)
    assert got[8] == (False, None, None, -1)


def test_eligible_partitions(spark):
    rows = [("p", 1, day(0), True, 0.4), ("p", 1, day(0), True, 0.5), ("p", 2, day(0), True, 0.4), ("p", 1, day(1), True, 0.9), ("p", 1, day(1), True, 0.9), ("p", 1, day(2), True, 0.9), ("p", 1, day(2), True, None)]
    df = spark.createDataFrame([(*r, 50.0, 9.0) for r in rows], "platform string, event_no int, day date, partition boolean, px double, vol7d double, ttr_days double")
    got = sorted((r["event_no"], r["day"], r["ok"]) for r in grid.with_buckets(df, ["platform", "event_no"]).withColumn("ok", grid.eligible_partition(20.0)).collect())
    assert got == [(1, day(0), True), (1, day(0), True), (1, day(1), False), (1, day(1), False), (1, day(2), False), (1, day(2), False), (2, day(0), False)]


def test_partitioned_tape_reads_only_its_dates(spark, tmp_path):
    from tidemark.sources import files

    rows = [(i, "ab"[i % 2], day(i % 5)) for i in range(20)]
    files.write_tape(spark.createDataFrame(rows, "id int, venue string, date date"), f"{tmp_path}/tape")
    got = files.read_tape(spark, f"{tmp_path}/tape", "2024-01-02", "2024-01-03")
    assert sorted(r["id"] for r in got.collect()) == [i for i, _, d in rows if d in (day(1), day(2))]
    assert "PartitionFilters: [isnotnull(date" in got._jdf.queryExecution().toString()


def test_too_many_entities_are_refused(spark):
    rows = spark.range(60).selectExpr("id % 6 AS e", "id div 6 AS t", "CAST(id * id % 7 AS double) AS y", "CAST(id % 5 AS double) AS x")
    assert regress.wald_equal_slopes(rows, "e", "t", "y", "x", lags=1)["n"] == 6
    with pytest.raises(ValueError, match="too many"):
        regress.wald_equal_slopes(rows, "e", "t", "y", "x", most=5)
