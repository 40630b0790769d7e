"""Closed forms, invariants and awkward rows of the operators."""

from __future__ import annotations

import os
import datetime as dt
import json
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import fixed_income as fi, markdown as md
from quillon.functions.metrics import performance_summary
from quillon.functions.statistics import normal_cdf, safe_corr, student_t_two_sided
from quillon.operators import allocation, cross_section as xs, learning, optimizers as op, portfolio, timing, universe, validate
from quillon.operators.features import Segment, assign_splits
from quillon.plans import gates, state, verification as vf
from quillon.sources import market, paged, sinks


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def test_distributions(spark):
    z = [-9.0, -2.0, -0.5, 0.0, 1.0, 1.96, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z"))).collect()]
    from math import erf, sqrt

    assert got == pytest.approx([(1 + erf(x / sqrt(2))) / 2 for x in z], abs=1e-12)
    t = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (12.706204736, 1.0)], "t double, v double")
    assert [r[0] for r in t.select(student_t_two_sided(F.col("t"), F.col("v"))).collect()] == pytest.approx([0.0733880348, 1.0, 0.05], abs=1e-5)


def test_winsorize_and_standardize_edges(spark):
    rows = [(1, 0, 5.0), (1, 1, 5.0), (1, 2, 5.0), (1, 3, 90.0), (2, 0, 1.0), (3, 0, None), (3, 1, None)]
    df = spark.createDataFrame(rows, "date int, stock_code int, x double")
    got = {(r.date, r.stock_code): r.x for r in xs.winsorize(df, "x").collect()}
    assert got[1, 3] == 5.0 and got[2, 0] == 1.0 and got[3, 0] is None
    z = {(r.date, r.stock_code): r.z for r in xs.standardize(xs.winsorize(df, "x"), "x", out="z").collect()}
    assert z[1, 0] == 0.0 and z[2, 0] is None
    assert spark.createDataFrame([(1.0, 2.0)] * 6, "x double, y double").select(safe_corr(F.col("x"), F.col("y"))).first()[0] is None


def test_neutralize_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    n = 60
    pdf = pd.DataFrame({"date": 1, "stock_code": range(n), "f": rng.normal(size=n), "market_cap": rng.uniform(0.1, 1e4, n), "industry": [None if i % 13 == 0 else i % 4 for i in range(n)]})
    rows = [(1, i, float(f), float(c), None if k != k else int(k)) for i, f, c, k in zip(range(n), pdf.f, pdf.market_cap, pdf.industry)]
    got = xs.neutralize(spark.createDataFrame(rows, "date int, stock_code int, f double, market_cap double, industry int"), "f", out="r").toPandas().sort_values("stock_code")
    ind = pdf["industry"].fillna(0).astype(int).to_numpy()
    X = np.column_stack([np.ones(n), np.log(np.maximum(pdf.market_cap, 1)), *[(ind == k).astype(float) for k in (1, 2, 3)]])
    want = pdf.f - X @ np.linalg.lstsq(X, pdf.f, rcond=None)[0]
    assert got["r"].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-10)


@pytest.mark.parametrize("n,m", [(3, 4), (5, 7), (5, 5), (10, 23), (2, 9)])
def test_quantile_groups_equal_pandas(spark, n, m):
    values = np.random.default_rng(m).normal(size=m)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "date int, stock_code int, factor double")
    got = [r.group for r in xs.quantile_groups(df, n=n).orderBy("stock_code").collect()]
    assert got == (pd.qcut(pd.Series(values).rank(method="first"), n, labels=False) + 1).tolist()


def test_metrics_closed_form(spark):
    df = spark.createDataFrame([("a", day(i), r) for i, r in enumerate([0.1, -0.5, 0.2])] + [("b", day(0), 0.0), ("b", day(1), 0.0)], "k string, date date, ret double")
    got = {r.k: r for r in performance_summary(df, ["k"]).collect()}
    assert got["a"].max_drawdown == pytest.approx(0.5) and got["a"].total_return == pytest.approx(1.1 * 0.5 * 1.2 - 1)
    assert got["b"].sharpe == 0 and got["b"].calmar == 0 and got["b"].max_drawdown == 0


def test_timing_is_causal(spark):
    rows = [("s", day(i), 0.01 * ((i * 7) % 5 - 2), float(i % 2)) for i in range(30)]
    run = lambda rs: [(r.position, r.net) for r in timing.signal_backtest(spark.createDataFrame(rs, "series_id string, date date, ret double, signal double"), 5).orderBy("date").collect()]
    changed = rows[:20] + [(s, d, 9.0, 1 - x) for s, d, r, x in rows[20:]]
    assert run(rows)[:20] == run(changed)[:20]
    with pytest.raises(ValueError):
        timing.signal_backtest(spark.createDataFrame(rows, "series_id string, date date, ret double, signal double"), lag=0)


def covariance(n, seed=1):
    a = np.random.default_rng(seed).normal(size=(60, n)) * np.linspace(0.5, 2, n)
    return np.cov(a.T)


@pytest.mark.parametrize("method", sorted(op.METHODS))
@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_weights_are_long_and_whole(method, n):
    w = op.METHODS[method](np.atleast_2d(covariance(n)))
    assert w.sum() == pytest.approx(1) and (w >= -1e-12).all()


def test_optimizers_reach_their_aims():
    cov = covariance(6)
    w = op.risk_budget(cov)
    share = w * (cov @ w)
    assert share / share.sum() == pytest.approx(np.full(6, 1 / 6), abs=1e-6)
    mu = np.linspace(0, 0.5, 6)
    w = op.mean_variance(cov, mu)
    grad = mu - 2 * (cov + op.RIDGE * np.eye(6)) @ w
    assert grad[w > 1e-6] == pytest.approx(grad.max(), abs=1e-5)
    sd = np.array([1.0, 3.0])
    assert op.risk_budget(np.diag(sd**2)) == pytest.approx((1 / sd) / (1 / sd).sum(), abs=1e-6)
    v = np.array([0.9, 0.4, -0.2])
    assert op.project_simplex(v) == pytest.approx([0.75, 0.25, 0])


def test_portfolio_backtest_equals_loop(spark):
    rng = np.random.default_rng(2)
    days, assets = [day(i * 7) for i in range(12)], ["a", "b", "c"]
    r = {(d, a): float(rng.normal(0, 0.05)) for d in days for a in assets if rng.random() > 0.1}
    w = {(d, a): float(x) for d in days[::3] for a, x in zip(assets, rng.dirichlet(np.ones(3))) if rng.random() > 0.2}
    got = allocation.portfolio_backtest(spark.createDataFrame([(d, a, x) for (d, a), x in w.items()], "date date, asset string, weight double"), spark.createDataFrame([(d, a, x) for (d, a), x in r.items()], "date date, asset string, ret double"), 20).orderBy("rebalance_date").collect()
    before, nav, want = {}, 1.0, []
    for d in sorted({d for d, _ in w}):
        later = [x for x in days if x > d]
        if not later:
            continue
        own = {a: x for (e, a), x in w.items() if e == d}
        turn = sum(abs(own.get(a, 0) - before.get(a, 0)) for a in {*own, *before})
        gross = sum(x * r.get((later[0], a), 0) for a, x in own.items())
        nav *= 1 + gross - turn * 20 / 1e4
        grown = {a: x * (1 + r.get((later[0], a), 0)) for a, x in own.items()}
        before = {a: x / sum(grown.values()) for a, x in grown.items()}
        want.append((gross, turn, nav))
    assert [(x.gross, x.turnover, x.nav) for x in got] == [pytest.approx(x) for x in want]


def test_simulation_invariants(spark):
    rng = np.random.default_rng(8)
    days, codes = [day(i) for i in range(24)], list(range(30))
    pred = spark.createDataFrame([("m", c, d, float(rng.normal()), float(rng.normal())) for d in days[:16] for c in codes], "model string, stock_code long, date date, prediction double, label double")
    prices = [(c, d, float(np.exp(rng.normal(0, 0.1)) * 10), bool(rng.random() > 0.15)) for d in days for c in codes]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, trade_index long")
    s = validate.PortfolioSettings(n_groups=3)
    out = portfolio.run_backtest(pred, spark.createDataFrame(prices, "stock_code long, date date, price double, tradable boolean"), cal, s)
    nav, held, trades = out["nav"].toPandas(), out["holdings"].toPandas(), out["trades"].toPandas()
    assert len(nav.groupby(["model", "path", "group"])) == 9 and (nav.cash >= -1e-6).all()
    assert np.allclose(held.groupby(["model", "path", "group", "date"]).weight.sum(), 1)
    assert {"filled", "blocked"} <= set(trades.status) and (trades[trades.status == "blocked"].executed == 0).all()
    assert np.allclose(nav.sort_values("date").groupby(["model", "path", "group"]).daily_return.apply(lambda x: (1 + x).prod()), nav.sort_values("date").groupby(["model", "path", "group"]).nav.last())
    assert out["metrics"].count() > 0 and out["monotonicity"].count() == 1
    with pytest.raises(ValueError):
        validate.PortfolioSettings(exit_offset=9).validate()


def test_simulation_closed_form():
    events = pd.DataFrame({"execution_date": [1, 2], "targets": [["a", "b"], []]})
    m = pd.DataFrame({"stock_code": ["a", "b", "a", "b"], "date": [1, 1, 2, 2], "price": [10.0, 20.0, 11.0, 18.0], "tradable": [True] * 4})
    out = portfolio.simulate_events(events, m, validate.PortfolioSettings(initial_capital=100.0, sell_fee=0.01))
    last = [r for r in out if r["record"] == "nav"][-1]
    assert last["equity"] == pytest.approx((5 * 11 + 2.5 * 18) * 0.99) and last["fee"] == pytest.approx(1.0)


def test_intervals_and_suspension(spark):
    rows = spark.createDataFrame([("a", day(i)) for i in range(4)] + [("b", day(1))], "code string, date date")
    held = spark.createDataFrame([("a", day(1), day(3)), ("b", day(0), None)], "code string, start date, stop date")
    assert sorted((r.code, r.date) for r in universe.outside_intervals(rows, held).collect()) == [("a", day(0)), ("a", day(3))]
    status = spark.createDataFrame([("a", day(0), 1), ("a", day(1), None), ("a", day(2), 0)], "code string, date date, if_suspend int")
    assert universe.filter_suspended(rows, status, "code").count() == 4


def test_validation(spark):
    df = spark.createDataFrame([("m", 1, day(0), "x", 1.0), ("m", 2, day(0), "2.5", None), ("m", 3, day(0), "nan", 1.0)], "model string, stock_code int, date date, prediction string, label double")
    assert [r.stock_code for r in validate.prepare_factor_panel(df, 1).collect()] == [2]
    with pytest.raises(ValueError):
        validate.prepare_factor_panel(df.unionByName(df), 1)
    with pytest.raises(ValueError):
        validate.join_to_one(df, df.unionByName(df), ["stock_code"])
    with pytest.raises(ValueError):
        assign_splits(df, [Segment("a", day(0), day(5)), Segment("b", day(5), day(9))])


#: Tolerance cases: spec (rel, eps, same sign, magnitude, direction), report, reproduced, level, attribution, verdict.
CASES = [
    ((0.5, None, True, False, False), 0.08, -0.01, None, None, False), ((0.15, None, False, False, False), 1.0, 1.2, None, None, False), ((0.15, None, False, False, False), 1.0, 1.1, None, None, True),
    ((0.2, 0.005, False, False, False), 0.003, 0.004, None, None, True), ((0.2, 0.005, False, False, False), 0.003, 0.02, None, None, False), ((0.2, 0.005, True, False, False), 0.003, -0.002, None, None, True),
    ((0.2, 0.005, True, False, False), 0.08, -0.07, None, None, False), ((None, None, False, True, False), 5.0, 8.0, None, None, True), ((None, None, False, True, False), 5.0, 60.0, None, None, False),
    ((None, None, False, False, True), 1.0, 1.0, None, None, True), ((None, None, False, False, True), 1.0, -1.0, None, None, False), ((0.05, None, False, False, False), 0.1, 0.3, "directional", "assumption_linked", True),
    ((0.05, None, False, False, False), 0.1, -0.02, "directional", "assumption_linked", False), ((0.05, None, False, False, False), 100.0, 300.0, "magnitude", "assumption_linked", True), ((0.05, None, False, False, False), 100.0, 5000.0, "magnitude", "assumption_linked", False),
    ((0.05, None, False, False, False), None, None, "unverifiable", "assumption_linked", None), ((0.05, None, False, False, False), 1.0, 1.0, "directional", "accepted", False), ((0.05, None, False, False, False), 0.1, 0.101, "full", None, True), ((None, None, False, False, False), 1.0, 1.0, None, None, None),
]


def test_tolerances(spark):
    rows = [(i, *spec, a, b, level, attribution) for i, (spec, a, b, level, attribution, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, max_rel_dev double, abs_eps double, require_same_sign boolean, order_of_magnitude_only boolean, direction_only boolean, report_value double, reproduced_value double, verification_level string, attribution_status string")
    assert [r.passed for r in vf.decide(df).orderBy("id").collect()] == [c[-1] for c in CASES]
    with pytest.raises(ValueError):
        vf.lookup_tolerance(df, df, 2.0)


def test_cycles_and_gates(spark):
    ms = lambda rows: spark.createDataFrame(rows, "id string, deps array<string>")
    assert not vf.has_cycle(ms([("a", []), ("b", ["a"]), ("c", ["b", "zz"])]))
    assert vf.has_cycle(ms([("a", ["c"]), ("b", ["a"]), ("c", ["b"])])) and vf.has_cycle(ms([("a", ["a"])]))
    g = vf.gate(spark.createDataFrame([("v", "1", True), ("v", "2", False), ("w", "1", True)], "stage string, check_id string, passed boolean"))
    assert {r.stage: (r.verdict, r.failed) for r in g.collect()} == {"v": (False, ["2"]), "w": (True, [])}
    oos = spark.createDataFrame([("2020-01-01", "2020-02-01", "2020-01-15", 10, "continues", ""), ("2020-01-01", "2020-01-02", "2021-01-15", 200, "decayed", "")], "in_sample_end string, oos_start string, oos_end string, oos_days int, conclusion string, warning string")
    assert [r.problems for r in vf.check_out_of_sample(oos).collect()] == [["dates_out_of_order", "short_without_warning"], []]


def test_state(spark):
    e = spark.createDataFrame([("r001_a", "plan", "running", 1, 1), ("r001_a", "plan", "done", 2, 2), ("r002_b", "plan", "running", 1, 3), ("r002_b", "plan", "running", 5, 4)], "case_id string, stage string, status string, ts int, event_id int")
    s = state.fold(e)
    assert {(r.case_id, r.status, r.attempts) for r in s.collect()} == {("r001_a", "done", 1), ("r002_b", "running", 2)}
    full = state.back_fill(s, spark.createDataFrame([("plan",), ("build",)], "stage string"), spark.createDataFrame([("r001_a",)], "case_id string"))
    assert {(r.case_id, r.stage, r.status) for r in full.where("stage = 'build'").collect()} == {("r001_a", "build", "skipped"), ("r002_b", "build", "pending")}
    assert state.next_number(e).first()[0] == 3 and state.invalid_events(e).count() == 0
    assert state.resolve(e, "2") == "r002_b" and state.resolve(e, "r001") == "r001_a"
    with pytest.raises(ValueError):
        state.resolve(e, "r00")
    many = spark.range(5000).selectExpr("concat('r1_', id) AS case_id").unionByName(spark.createDataFrame([("r1",), ("r1x_b",), ("r2x",), ("r007_c",)], "case_id string"))
    assert state.resolve(many, "r1") == "r1" and state.resolve(many, "r1_4999") == "r1_4999" and state.resolve(many, "r2") == "r2x" and state.resolve(many, "7") == "r007_c"
    for unclear in ("1", "r1_", "zz"):
        with pytest.raises(ValueError):
            state.resolve(many, unclear)


AWKWARD = r'{bad} {"a": {"b": {"c": {"d": "}"}}}} then {"e": "\\\"{"} {'


def test_markdown(spark):
    t = "---\ntitle: A: b\npages: 3\n---\n## Data\n| a | b |\n|---|---|\n| x \\| y | 2 |\n### [D1] First\nline\n### [D2] Second\nmore\n## Next\nend"
    df = spark.createDataFrame([(1, t)], "id int, t string")
    assert df.select(md.front_matter(F.col("t"))).first()[0] == {"title": "A: b", "pages": "3"}
    assert [r.cells for r in md.table_rows(df, "t", ["id"]).collect()] == [["a", "b"], ["x | y", "2"]]
    assert [(r.block_id, r.title, r.body.strip()) for r in md.id_blocks(df, "t", ["id"]).collect()] == [("D1", "First", "line"), ("D2", "Second", "more")]
    assert df.select(md.section(F.col("t"), "Next")).first()[0] == "end"
    answers = spark.createDataFrame([('{"a": 1}',), ('so\n```json\n{"b": 2}\n```\n',), ('x {"c": {"d": 3}} y',), ("none",), (AWKWARD,)], "t string")
    assert [r[0] for r in answers.select(md.json_in(F.col("t"))).collect()] == ['{"a": 1}', '{"b": 2}', '{"c": {"d": 3}}', None, AWKWARD[-16:-2]]
    assert answers.select(md.bare_objects(F.col("t"))).collect()[4][0] == ["{bad}", '{"a": {"b": {"c": {"d": "}"}}}}', AWKWARD[-16:-2]]


def test_sinks_and_config(spark, tmp_path):
    df = spark.createDataFrame([("k", 1.0, 1.1, 0.1, True, "relative"), ("<b>", None, float("nan"), None, None, "x")], "key string, report_value double, reproduced_value double, rel_dev double, passed boolean, reason string")
    sinks.write_workbook({"one": df, "two": df}, tmp_path / "a.xlsx")
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert z.testzip() is None and "&lt;b&gt;" in z.read("xl/worksheets/sheet2.xml").decode()
    with pytest.raises(ValueError):
        sinks.write_workbook({"one": df}, tmp_path / "b.xlsx", row_limit=1)
    sinks.write_json({"x": float("nan"), "y": [1.5, {"z": np.float64(2)}]}, tmp_path / "a.json")
    assert json.loads((tmp_path / "a.json").read_text()) == {"x": None, "y": [1.5, {"z": 2.0}]}
    sinks.render_report("T <i>", df, tmp_path / "r.html", "# H\n- a\n\n| x | y |\n|---|---|\n| 1 | **2** |\n")
    page = (tmp_path / "r.html").read_text()
    assert "T &lt;i&gt;" in page and "&lt;b&gt;" in page and "<strong>2</strong>" in page and "<script" not in page
    assert sinks.markdown_html("a\n```py\n<x>\n```\n* b\n* `c`\n## T **u**\n|p\\|q|r|\n") == "<p>a</p>\n<pre>&lt;x&gt;</pre>\n<ul><li>b</li><li><code>c</code></li></ul>\n<h2>T <strong>u</strong></h2>\n<table><tr><td>p\\|q</td><td>r</td></tr></table>"
    sinks.write_json({"x": 2}, tmp_path / "a.json")  # over the first
    assert json.loads((tmp_path / "a.json").read_text()) == {"x": 2} and len(list(tmp_path.glob("*a.json"))) == 1
    sinks.write_tables({"t": df}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/t")).count() == 2
    inner = tmp_path / "p" / "q"
    inner.mkdir(parents=True)
    (tmp_path / market.CONFIG).write_text('{"data_root": "/far"}')
    assert market.data_root(inner) == "/far"
    (tmp_path / "p" / market.CONFIG).write_text("{}")
    assert market.data_root(inner).endswith("local_data")
    for bad in ("[1]", "{", '{"data_root": 3}'):
        (tmp_path / "p" / market.CONFIG).write_text(bad)
        with pytest.raises(ValueError):
            market.data_root(inner)
    pages = market.html_tables(spark.createDataFrame([(1, "<table><tr><th>a|b</th></tr><tr><td><b>1</b></td></tr></table>")], "id int, h string"), "h", ["id"])
    assert [r.line for r in market.markdown_table(pages, ["id"]).collect()] == ["| a\\|b |", "| 1 |"]


@pytest.mark.parametrize("kind", learning.KINDS)
def test_model_gradients(kind):
    rng = np.random.default_rng(0)
    m = learning.SequenceModel.create(kind, 3, 5, seed=1)
    x = rng.normal(size=(4, 6, 3))
    out, saved, h = m.forward(x)
    g, dx = m.backward(x, saved, h, np.ones(4))
    for name, p in m.params.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        e = 1e-6
        p[at] += e
        up = m.predict(x).sum()
        p[at] -= 2 * e
        down = m.predict(x).sum()
        p[at] += e
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-5), name
    xx = x.copy()
    xx[1, 2, 0] += 1e-6
    assert dx[1, 2, 0] == pytest.approx((m.predict(xx).sum() - out.sum()) / 1e-6, abs=1e-4)


def _labelled_windows(spark, parts):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5, 2))
    y = x[:, -1, 0] * 0.5 - x[:, -2, 1] * 0.3
    rows = [(a.tolist(), float(b), "train" if i < 200 else "valid" if i < 280 else "test") for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "window array<array<double>>, label double, split string").repartition(parts)


def test_training_by_brute_force(spark):
    """Weights after three steps are those of Adam on whole arrays, however the windows are partitioned."""
    s = learning.TrainingSettings(hidden=4, epochs=3, steps=1, rate=0.02, patience=9)
    x, y, _ = _labelled_windows(spark, 1)
    want = {}
    for kind in learning.KINDS:
        m = learning.SequenceModel.create(kind, 2, 4, s.seed)
        mean, square, best = 0.0, 0.0, (np.inf, None)
        for n in range(1, 4):
            out, saved, h = m.forward(x[:200])
            g = m.backward(x[:200], saved, h, 2 * (out - y[:200]) / 200)[0]
            g = np.concatenate([g[k].ravel() for k in m.params])
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            m.set_flat(m.flat() - 0.02 * (mean / (1 - 0.9**n)) / (np.sqrt(square / (1 - 0.999**n)) + 1e-8))
            best = min(best, (((m.predict(x[200:280]) - y[200:280]) ** 2).mean(), n, m.flat()), key=lambda b: b[0])
        want[kind] = best
    for parts in (1, 5):
        got = learning.loaded(learning.train_models(_labelled_windows(spark, parts)[2], learning.KINDS, s))
        for kind, m in got.items():
            assert np.allclose(m.flat(), want[kind][2], atol=1e-9) and min(r["valid_loss"] for r in m.history) == pytest.approx(want[kind][0])


def test_training_learns_and_stops(spark):
    x, y, rows = _labelled_windows(spark, 2)
    made = learning.loaded(learning.train_models(rows, learning.KINDS, learning.TrainingSettings(epochs=12, steps=3, rate=0.05)))
    for m in made.values():
        assert min(r["valid_loss"] for r in m.history) < 0.6 * y.var()
        assert np.allclose(learning.SequenceModel.from_json(m.to_json()).predict(x), m.predict(x))
    still = learning.loaded(learning.train_models(rows, ["gru"], learning.TrainingSettings(hidden=2, epochs=9, steps=1, patience=2, min_delta=1e9)))
    assert len(still["gru"].history) == 3
    for bad in (rows.where("split = 'train'"), rows.withColumn("label", F.lit(float("nan"))), rows.where("false")):
        with pytest.raises(ValueError):
            learning.train_models(bad, ["gru"], learning.TrainingSettings(hidden=2, epochs=1))


def test_rolling_training(spark):
    rng = np.random.default_rng(3)
    rows = [(c, day(i), rng.normal(size=(3, 2)).tolist(), float(rng.normal())) for c in range(6) for i in range(20)]
    w = spark.createDataFrame(rows, "stock_code long, date date, window array<array<double>>, label double")
    out = learning.rolling_train_predict(w, ["2020-01-08", "2020-01-14"], learning.TrainingSettings(hidden=2, epochs=2))
    assert out.count() == 6 * 12 and out.where("date <= '2020-01-08'").count() == 0


def test_long_chain_is_no_cycle(spark):
    chain = [(i, [i - 1] if i else []) for i in range(55)]
    assert not vf.has_cycle(spark.createDataFrame(chain, "id long, deps array<long>"))
    assert vf.has_cycle(spark.createDataFrame([*chain, (0, [54])], "id long, deps array<long>"))


def test_exact_quantiles(spark):
    from quillon.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=5000), "b": np.repeat([1.0, 2.0, 5.0], [4000, 10, 3]), "c": np.array([7.0]), "d": rng.integers(0, 9, 2000).astype(float)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double").repartition(5)
    probs = [0.0, 0.01, 0.333, 0.5, 0.99, 1.0]
    got = {r.g: list(r)[1:] for r in exact_quantiles(df, "g", "x", probs).collect()}
    for g, xs in groups.items():
        assert got[g] == pytest.approx([np.quantile(xs, p) for p in probs], abs=1e-12)


def test_student_t_against_integration(spark):
    import math

    cases = [(t, v) for t in (0.0, 0.3, 1.7, 4.2, 12.0) for v in (1, 2, 3, 4, 9, 50, 399, 400, 401, 3000)]
    got = [r[0] for r in spark.createDataFrame([(float(t), float(v)) for t, v in cases], "t double, v double").coalesce(1).select(student_t_two_sided(F.col("t"), F.col("v"))).collect()]
    for (t, v), p in zip(cases, got):
        u = np.linspace(0, math.atan(t / math.sqrt(v)), 200_001)
        f = np.cos(u) ** (v - 1)
        scale = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
        assert p == pytest.approx(max(0.0, 1 - 2 * scale * np.trapezoid(f, u)), abs=2e-9), (t, v)


def test_psr_far_from_zero(spark):
    """Skewness and kurtosis hold where the mean is large beside the spread."""
    from quillon.functions.metrics import psr_z

    x = np.random.default_rng(2).gamma(2.0, 1.0, 400)
    z = [spark.createDataFrame([(float(a + b),) for a in x], "r double").agg(psr_z(F.col("r") - b)).first()[0] for b in (0.0, 1e6)]
    assert z[1] == pytest.approx(z[0], rel=1e-6)


def test_state_documents(spark):
    import copy
    import json

    from quillon.plans import state

    good = {f: None for f in state.FIELDS} | {
        "report_id": "r001_a", "mode": "auto", "reproduction_mode": "strict", "status": "running", "current_stage": "init", "tags": [], "paths": {}, "coverage_stats": {}, "assumptions": {}, "blockers": [], "events": [], "external_reviews": [],
        "stages": {s: {"status": "pending", "attempts": 0} for s in state.STAGES}, "gates": [{"stage": "plan", "checks": [], "verdict": "PASS", "timestamp": "t"}],
        "milestones": [{"id": "m1", "name": "a", "deps": [], "implement": "done", "code_review": "pending", "verify": "pending"}], "iteration": {"current": 0, "max": 3, "history": []}, "verdict": {"result": None},
    }

    def changed(path, value):
        doc = copy.deepcopy(good)
        *way, last = path
        at = doc
        for step in way:
            at = at[step]
        at[last] = value
        return doc

    without, more = copy.deepcopy(good), good | {"extra": 1}
    del without["blockers"]
    cases = {
        "good": (good, []), "mode": (changed(["mode"], "x"), ["mode"]), "null": (changed(["status"], None), ["status"]), "may": (changed(["type"], 3), ["type"]), "extra": (more, ["unknown: extra"]),
        "less": (without, ["blockers: kind", "missing: blockers"]), "id": (changed(["report_id"], ""), ["report_id"]), "tags": (changed(["tags"], {}), ["tags: kind"]),
        "tries": (changed(["stages", "plan", "attempts"], -1), ["stages.plan.attempts"]), "bool": (changed(["stages", "plan", "attempts"], True), ["stages.plan.attempts"]), "stage": (changed(["stages", "plan"], 1), ["stages.plan: kind"]),
        "new": (changed(["stages", "odd"], {}), ["unknown stage: odd"]), "gate": (changed(["gates"], [{"stage": 1}, good["gates"][0] | {"verdict": "pass"}]), ["gates[0].fields", "gates[1].verdict"]),
        "twice": (changed(["milestones"], good["milestones"] * 2), ["milestones: repeated id"]), "deps": (changed(["milestones", 0, "deps"], "m0"), ["milestones[0].deps"]), "verify": (changed(["milestones", 0, "verify"], "ok"), ["milestones[0].verify"]),
        "current": (changed(["iteration", "current"], "1"), ["iteration.current: kind"]), "verdict": (changed(["verdict"], {}), ["verdict.result: missing"]), "result": (changed(["verdict", "result"], "won"), ["verdict.result"]), "list": ([], ["document"]),
    }
    rows = [(k, json.dumps(d)) for k, (d, _) in cases.items()] + [("text", "{no"), ("none", None)]
    found: dict[str, list[str]] = {}
    for r in state.state_problems(spark.createDataFrame(rows, "case_id string, state string")).collect():
        found.setdefault(r.case_id, []).append(r.problem)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(w) for k, (_, w) in cases.items() if w} | {"text": ["document"], "none": ["document"]}


def test_exact_quantiles_of_odd_values(spark):
    """Both zeros, infinities, denormals, one value many times over and nulls; no window over values."""
    from quillon.operators.quantiles import exact_quantiles

    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, np.nextafter(1.0, 2.0)]
    groups = {"odd": odd * 3, "hot": [3.5] * 4000 + [4.0], "neg": [-x for x in range(1, 200)], "inf": [1.0, float("inf"), 2.0, 3.0]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("odd", None), ("none", None)], "g string, x double")
    probs = [0.0, 0.25, 0.5, 1.0]
    got = {r.g: list(r)[1:] for r in exact_quantiles(df, "g", "x", probs).collect()}
    want = {r.g: list(r.q) for r in df.groupBy("g").agg(F.percentile("x", probs).alias("q")).where("q IS NOT NULL").collect()}
    assert got == {g: [x + 0.0 for x in q] for g, q in want.items()}


@pytest.mark.parametrize("tile", [3, 256])
def test_comoments(spark, tile):
    """Complete pairs with gaps, over tiles smaller than the number of members."""
    import pandas as pd

    from quillon.operators.allocation import covariance as long_covariance
    from quillon.operators.comoments import co_deviation, comoments

    rng = np.random.default_rng(2)
    x = pd.DataFrame(1e6 + rng.normal(size=(60, 8)), columns=[f"m{i}" for i in range(8)])
    x = x.mask(rng.random(x.shape) < 0.3)
    x["m7"] = np.nan
    x.loc[5, "m7"] = 1.0
    rows = [(str(m), int(d), None if np.isnan(v) else float(v)) for d, r in x.iterrows() for m, v in r.items()]
    df = spark.createDataFrame(rows, "asset string, date int, ret double").repartition(5)
    made = comoments(df, "asset", ["date"], "ret", tile=tile, rows=40).withColumn("cov", co_deviation() / (F.col("n") - 1))
    for r in made.where("n > 1").collect():
        both = x[[r.row, r.col]].dropna() if r.row != r.col else x[[r.row]].dropna()
        a, b = both[r.row].to_numpy(), both[r.col].to_numpy()
        assert r.row <= r.col and r.n == len(both)
        assert r["cov"] == pytest.approx(np.cov(a, b)[0, 1], abs=1e-9)
        assert r.x_high - r.x_low == pytest.approx(a.max() - a.min(), abs=1e-8)
    assert made.count() == 7 * 8 // 2 + sum(x.loc[5, [f"m{i}" for i in range(7)]].notna()) + 1
    cov = long_covariance(df)
    assert "m7" not in {r.row for r in cov.collect()} and cov.count() == 49
    plan = cov._jdf.queryExecution().executedPlan().toString()
    assert plan.count("date") and "Cartesian" not in plan


def test_market_store_needs_no_exchange(spark):
    from quillon.queries import catalogue

    from .conftest import SF

    plan = catalogue.queries()["market_store"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Window" in plan and "Exchange" not in plan


def test_state_of_wrong_kinds(spark):
    import json

    from quillon.plans import state

    docs = [("a", json.dumps({"iteration": 3})), ("b", json.dumps({"iteration": {"current": "x", "history": 1}}))]
    got = {(r.case_id, r.problem) for r in state.state_problems(spark.createDataFrame(docs, "case_id string, state string")).collect()}
    assert {p for c, p in got if c == "a" and p.startswith("iteration")} == {"iteration: kind"}
    assert {"iteration.current: kind", "iteration.history: kind", "iteration.max: missing"} <= {p for c, p in got if c == "b"}


@pytest.mark.parametrize("rows", [5, 8, 4096])
def test_window_blocks(spark, rows):
    """Windows over the borders of blocks equal those of the tensor; blocks hold about the panel's values once."""
    from quillon.operators import features as ft
    from quillon.operators import windows
    from quillon.queries import data
    from quillon.sources import synthetic as syn

    from .conftest import SF

    indexed = ft.window_index(syn.panel(spark, SF), syn.calendar(spark, SF), ["factor", "fwd"], 6)
    blocks = windows.window_blocks(indexed, ["factor", "fwd"], 6, rows=rows)
    kind = dict(indexed.dtypes)
    got = windows.map_windows(blocks, 6, data._steps, f"stock_code {kind['stock_code']}, date {kind['date']}, step long, factor double, fwd double")
    want = data.window_tensor_rows(spark, SF)
    shown = lambda df: sorted(tuple(r) for r in df.select("stock_code", "date", "step", "factor", "fwd").collect())
    assert shown(got) == shown(want) and got.count() > 100
    held = blocks.agg(F.sum(F.size("steps"))).first()[0]
    assert held <= indexed.count() * (1 + 5 / rows) + 1
    with pytest.raises(ValueError):
        windows.window_blocks(indexed, ["factor"], 9, rows=5)


def test_iteration_rounds(spark):
    """The exempting conclusions, those that only mention one, and the limit of rounds."""
    from quillon.plans import gates

    said = {"a": "结论: stop_partial\n", "b": "本轮结论：**blocked**（缺数据）", "c": "结论: continue（已排除 stop_partial 假设）", "d": "结论: stop_partialx"}
    files = [(c, 1, n, t if n == "diagnosis.md" else None) for c, t in said.items() for n in ("diagnosis.md", "comparison.json")]
    files += [("e", r, n, "已排除假设" if r == 2 else "x") for r in (1, 2, 3) for n in gates.ROUND_FILES]
    cases = [*[(c, 1, None) for c in said], ("e", 3, 2), ("f", 0, 5), ("g", None, None), ("h", 2, 2)]
    got = gates.iteration_gate(spark.createDataFrame(cases, "case_id string, current int, most int"), spark.createDataFrame(files, "case_id string, round int, name string, text string"))
    rows = {(r.case_id, r.check_id): (r.passed, r.missing) for r in got.collect()}
    assert [rows[c, "round_files"] for c in "abcdefgh"] == [(True, ""), (True, ""), (False, "1/changes.md"), (False, "1/changes.md"), (True, ""), (True, ""), (True, ""), (False, ",".join(sorted(f"{r}/{n}" for r in (1, 2) for n in gates.ROUND_FILES)))]
    assert [c for c in "abcdefgh" if not rows[c, "rounds_allowed"][0]] == ["e"]
    assert [c for c in "abcdefgh" if not rows[c, "excluded_hypotheses"][0]] == ["e", "h"]


def test_never_free(spark):
    """Deep chains in rounds of their depth's logarithm; the same milestones as by plain search on graphs at random."""
    from quillon.plans.graph import never_free

    chain = [("deep", i, [i - 1] if i else []) for i in range(5000)] + [("ring", i, [(i + 1) % 300]) for i in range(300)]
    got = never_free(spark.createDataFrame(chain, "case_id string, id long, deps array<long>"), ["case_id"])
    assert got.groupBy("case_id").count().collect() == [("ring", 300)]
    rng, rows = np.random.default_rng(5), []
    for case in [None, *map(str, range(60))]:
        n = int(rng.integers(1, 30))
        rows += [(case, i, [int(x) for x in rng.integers(0, n + 3, int(rng.integers(0, 4)))] + [None] * int(rng.integers(0, 2))) for i in range(n)]
    rows += [("x", None, [1]), ("x", 1, None), ("x", 2, [3]), ("x", 2, [1]), ("x", 3, [2])]
    graph: dict = {}
    for case, i, deps in rows:
        if i is not None:
            graph.setdefault((case, i), set()).update((case, x) for x in deps or [] if x is not None)
    graph = {k: {x for x in v if x in graph} for k, v in graph.items()}
    while free := {k for k, v in graph.items() if not v & graph.keys()}:
        graph = {k: v for k, v in graph.items() if k not in free}
    got = never_free(spark.createDataFrame(rows, "case_id string, id long, deps array<long>"), ["case_id"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(graph, key=str) and len(got) > 20
    assert never_free(spark.createDataFrame([], "id long, deps array<long>")).count() == 0


def test_nested_front_matter():
    from quillon.functions.markdown import nested_rows

    head = "a: \"x: y\" # note\nb: it's\nc:\n- name: X\n  more: {k: [1, 'u, v']}\n- - p\n  - q\nd:\n    e:\n      f: ~\n# none\nstray\na: 2\ng: []\nh: http://x/#y\n- top"
    assert nested_rows(head) == [
        ("a", "number", "2"), ("b", "string", "it's"), ("c", "list", "2"), ("c[0]", "map", "2"), ("c[0].name", "string", "X"), ("c[0].more", "map", "1"), ("c[0].more.k", "list", "2"), ("c[0].more.k[0]", "number", "1"), ("c[0].more.k[1]", "string", "u, v"),
        ("c[1]", "list", "2"), ("c[1][0]", "string", "p"), ("c[1][1]", "string", "q"), ("d", "map", "1"), ("d.e", "map", "1"), ("d.e.f", "null", None), ("g", "list", "0"), ("h", "list", "1"), ("h[0]", "string", "top"),
    ]
    assert nested_rows("") == []


def test_files_as_rows(spark, tmp_path):
    """Sizes and times come without content; sources that are newer than outputs aren't fresh, caches don't count."""
    from quillon.sources import files

    base = str(tmp_path / "cases")
    rows = [("a/output/x.png", "12"), ("a/source/m.py", "1"), ("a/source/n.py", None), ("b/source/m.py", "1"), ("b/source/__pycache__/m.pyc", "1"), ("b/output/log.md", "exit=0 é")]
    files.write_texts(spark.createDataFrame(rows, "path string, text string"), base)
    for path, at in (("a/output/x.png", 100), ("a/source/m.py", 200), ("b/source/m.py", 100), ("b/source/__pycache__/m.pyc", 900), ("b/output/log.md", 200)):
        os.utime(f"{base}/{path}", (at, at))
    listed = files.listing(spark, base)
    assert "content" not in listed._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert {(r.name, r.length) for r in listed.collect()} == {("x.png", 2), ("m.py", 1), ("log.md", 9)}  # neither empty nor hidden
    own = files.F.split(files.below(files.F.col("path"), base), "/")
    got = vf.fresh(listed.withColumns({"case_id": own[0], "kind": own[1]}), ["case_id"]).select("case_id", "passed").collect()
    assert sorted(map(tuple, got)) == [("a", False), ("b", True)]
    assert [r.text for r in files.texts(spark, base, "log.md").collect()] == ["exit=0 é"]
    assert files.listing(spark, base, "*.csv").count() == 0


def test_checked_write(spark, tmp_path):
    """One job writes and checks; a table with null or repeated keys or too few rows leaves nothing behind."""
    good = spark.range(100).selectExpr("id AS a", "id % 7 AS b")
    spark.sparkContext.setJobGroup("checked", "")
    assert validate.write_checked(good, str(tmp_path / "t"), ["a"], 100).count() == 100
    written = [j for j in spark.sparkContext.statusTracker().getJobIdsForGroup("checked")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["t"] and len(written) <= 4  # stages of the adaptive plan and the count
    nulls = spark.createDataFrame([(1, 2), (None, 2), (None, 3)], "a long, b long")
    for bad, keys, least in ((good, ["b"], 0), (nulls, ["a"], 0), (good, ["a"], 101), (good.limit(0), ["a"], 1)):
        with pytest.raises(ValueError, match="not written"):
            validate.write_checked(bad, str(tmp_path / "u"), keys, least)
    with pytest.raises(ValueError, match="already"):
        validate.write_checked(good, str(tmp_path / "t"), ["a"])
    with pytest.raises(ValueError, match="lacks"):
        validate.write_checked(good, str(tmp_path / "u"), ["zz"])
    assert sorted(f.name for f in tmp_path.iterdir()) == ["t"]
    assert validate.write_checked(good.limit(0), str(tmp_path / "u"), ["a"]).columns == ["a", "b"]


def _by_hand(raw: bytes, declared):
    own = raw.split(b"\f")
    own = own[:-1] if not own[-1].strip() else own
    own = own if declared is None else (own + [b""] * declared)[:declared]
    return [p.decode("utf-8", "replace") for p in own]


@pytest.mark.parametrize("per_task", [1, 2, 100])
def test_paged_files(spark, tmp_path, monkeypatch, per_task):
    """Pages by hand: blank, trailing, padded and cut ones, bytes that aren't UTF-8, pages longer than a block, ranges of any size."""
    texts = {
        "empty.txt": b"", "blank.txt": b" \n\t", "one.txt": b"a", "trail.txt": b"a\fb\f", "spaces.txt": b"a\f\f \n", "bad.txt": b"\xff\xc3\fz", "marks.txt": b"\f" * 7,
        "sub/long.txt": b"x" * (2 * paged.BLOCK + 5) + b"\f" + "\u00e9".encode() * paged.BLOCK + b"\fend", "sub/many.txt": b"\f".join(b"%d" % i for i in range(50)), "_hidden.txt": b"h",
    }
    base = tmp_path / "texts"
    (base / "sub").mkdir(parents=True)
    for name, raw in texts.items():
        (base / name).write_bytes(raw)
    counts = {"empty.txt": 2, "trail.txt": 1, "bad.txt": 3, "sub/many.txt": 60, "blank.txt": None, "absent.txt": 4, "marks.txt": 0}
    spark.createDataFrame(list(counts.items()), "file string, pages int").write.parquet(str(tmp_path / "counts"))
    want = {(f, i): t for f, raw in texts.items() if f != "_hidden.txt" for i, t in enumerate(_by_hand(raw, counts.get(f)), 1)}
    df = paged.pages(spark, str(base), str(tmp_path / "counts"), pages_per_task=per_task)
    rows = df.collect()
    assert len(rows) == len(want) and {(r.file, r.page): r.page_text for r in rows} == want
    for where, keep in {
        "page BETWEEN 2 AND 3": lambda f, p: 2 <= p <= 3, "page > 48": lambda f, p: p > 48, "page < 1": lambda f, p: False, "page = 2 AND file = 'trail.txt'": lambda f, p: False,
        "file IN ('sub/many.txt', 'one.txt') AND page < 4": lambda f, p: p < 4 and f in ("sub/many.txt", "one.txt"), "page <> 1 AND length(page_text) < 3": lambda f, p: p != 1 and len(want[f, p]) < 3,
    }.items():
        assert {(r.file, r.page) for r in df.where(where).collect()} == {k for k in want if keep(*k)}, where


def test_paged_filters_plan_less(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringContains

    (tmp_path / "a.txt").write_bytes(b"\f".join([b"x"] * 10))
    (tmp_path / "b.txt").write_bytes(b"y")
    reader = paged.PagedReader({"path": str(tmp_path), "pagesPerTask": "4"})
    left = StringContains(("page_text",), "x")
    assert list(reader.pushFilters([EqualTo(("file",), "a.txt"), GreaterThan(("page",), 3), LessThanOrEqual(("page",), 6), left])) == [left]
    assert [t.ranges for t in reader.partitions()] == [[paged.PageRange("a.txt", 4, 6, False)]]


def test_paged_files_of_no_folder_content(spark, tmp_path):
    assert paged.pages(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError):
        paged.PagedReader({"path": str(tmp_path), "mark": "--"})


@pytest.mark.parametrize("seed", [0, 1])
def test_appended_events(spark, tmp_path, seed):
    """Any split into batches, repeats and late events included, folds to the states of the whole."""
    rng = np.random.default_rng(seed)
    events = [(None if i % 17 == 0 else int(rng.integers(4)), int(rng.integers(3)), ["running", "done", "failed", None][rng.integers(4)], int(rng.integers(30)), i) for i in range(120)]
    schema = "case_id long, stage long, status string, ts long, event_id long"
    batches = [[events[i] for i in rng.permutation(120)[: rng.integers(1, 90)]] for _ in range(2)] + [events]
    source, target = str(tmp_path / "log"), str(tmp_path / "states")
    read = 0
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = state.fold_appended(stream, target)
        read += sum(p.numInputRows for p in query.recentProgress)
    assert read == sum(map(len, batches))  # nothing is read again
    whole = state.fold(spark.createDataFrame(events, schema))
    assert sorted(map(str, state.folded(spark, target).collect())) == sorted(map(str, whole.collect()))


REVIEWS = {
    1: '{"verdict": "pass", "findings": [1, 2]}', 2: 'a\n```json\n{"x": 1}\n```\n```json\n{"findings": null, "verdict": null}\n```', 3: 'said\n {"findings": [1], "verdict": "v"} then {"x": 2}', 4: None, 5: "",
    6: "| id | n |\n|---|:-:|\n| CDX-S-1 | x |\n| x | CDX-S-2 |\n|\n| CDX-S-3\n| CDX-S-4 |", 7: "|a|\n|-|\n|CDX-C-1|\n|---|\n|CDX-C-2|\r\n\nverdict: Revise now", 8: "| CDX-S-1 | a |\n| b |", 9: '{"findings": [1',
}


def test_reviews(spark):
    """JSON first, whichever block holds the findings; else rows of tables whose first cell is an id, until a line that is no row."""
    got = gates.review_findings(spark.createDataFrame(list(REVIEWS.items()), "case_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {1: (2, "pass"), 2: (0, None), 3: (1, "v"), 4: (0, None), 5: (0, None), 6: (1, None), 7: (2, "Revise"), 8: (0, None), 9: (0, None)}


def test_audit_responses(spark):
    text = "| what | id | Severity (of it) | 处置(x) | 处置 |\n|-|-|-|-|-|\n| CDX-C-1 | CDX-S-1 | major | no | yes |\n| z | CDX-S-2 |\n| z | CDX-S-3 | a | b | c | more |\n"
    got = gates.audit_responses(spark.createDataFrame([(1, text), (2, None)], "case_id long, text string"), "S").collect()
    assert sorted(map(tuple, got)) == [(1, "CDX-S-2", "", "", ""), (1, "CDX-S-3", "a", "", "c")]


def test_yields(spark):
    """Yields of prices that are sums over the flows, the ends of the search, and what has no yield; no bond is searched in a lambda of its own."""
    price = lambda c, y, r: sum((100 * c / 2 + 100 * (k == 2 * y)) / (1 + r / 2) ** k for k in range(1, round(2 * y) + 1))
    known = [(c, y, r) for c in (0.0, 0.05, 0.3) for y in (0.5, 10.0, 100.0) for r in (-0.5, -1e-9, 0.0, 1e-9, 0.04, 2.0)]
    rows = [(price(*k), *k) for k in known] + [(1e300, 0.05, 5.0, -0.9), (0.0, 0.05, 5.0, 10.0)]
    rows += [(None, 0.05, 5.0, None), (float("nan"), 0.05, 5.0, None), (100.0, None, 5.0, None), (100.0, 0.05, 0.0, None), (100.0, 0.05, None, None)]
    df = spark.createDataFrame(rows, "price double, c double, y double, want double").coalesce(1)
    found = df.select("want", fi.yield_to_maturity(F.col("price"), F.lit(100.0), F.col("c"), F.col("y")).alias("got"))
    got = found.collect()
    assert [r.got is None for r in got] == [r.want is None for r in got]
    assert [r.got for r in got if r.want is not None] == pytest.approx([r.want for r in got if r.want is not None], abs=1e-8)
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()


def held_by_loop(events, price, tradable, s):
    """Dates of one path and group by a plain loop over stocks: {date: (trades, holdings, equity)}."""
    cash, shares, last, out = s.initial_capital, {}, {}, {}
    first, until = min(events), max(events)
    for d in sorted({d for d, _ in price} | set(events)):
        if not first <= d <= until:
            continue
        now = {c: p for (e, c), p in price.items() if e == d and p is not None}
        trades, held = {}, {}
        last |= {c: now[c] for c in shares if c in now}
        if d in events:
            targets = set(events[d])
            worth = cash + sum(n * last[c] for c, n in shares.items())
            goal = {c: worth / len(targets) / now[c] if c in targets and c in now else 0.0 for c in targets | set(shares)}
            free = {c for c in goal if c in now and tradable.get((d, c))}
            for c in sorted(goal):
                if (more := goal[c] - shares.get(c, 0.0)) < -s.share_epsilon:
                    trades[c] = ("sell", "filled" if c in free else "blocked", more if c in free else 0.0)
                    if c in free:
                        cash -= more * now[c] * (1 - s.sell_fee)
                        shares[c] += more
            shares = {c: n for c, n in shares.items() if n > s.share_epsilon}
            wish = {c: g - shares.get(c, 0.0) for c, g in goal.items() if g - shares.get(c, 0.0) > s.share_epsilon}
            need = sum(w * now[c] for c, w in wish.items() if c in free)
            part = min(1.0, cash / need) if need > 0 else 0.0
            for c, w in wish.items():
                trades[c] = ("buy", "blocked" if c not in free else "filled" if part >= 1 - 1e-12 else "partial", w * part if c in free else 0.0)
                if c in free:
                    shares[c], last[c] = shares.get(c, 0.0) + w * part, now[c]
            cash -= need * part
            last |= {c: now[c] for c in shares if c in now}
            worth = cash + sum(n * last[c] for c, n in shares.items())
            held = {c: n * last[c] / worth for c, n in shares.items()}
        out[d] = (trades, held, cash + sum(n * last[c] for c, n in shares.items()))
    return out


@pytest.mark.parametrize("code", ["long", "string"])
def test_simulation_equals_loop(spark, code):
    """Long codes beyond 2^53, stocks and dates without rows, prices that come and go, groups that begin and end apart."""
    rng = np.random.default_rng(11)
    name = (lambda i: 2**60 + i) if code == "long" else (lambda i: f"s{i}")
    codes, days = [name(i) for i in range(40)], [day(i) for i in range(30)]
    rows = [(c, d, None if rng.random() < 0.05 else float(np.exp(rng.normal(0, 0.2)) * 9), None if rng.random() < 0.05 else bool(rng.random() > 0.2)) for d in days if d != days[9] for c in codes[:36] if rng.random() > 0.1]
    dates = {1: days[0:25:3], 2: days[3:28:3]}
    events = {(m, g): {d: [c for c in codes if rng.random() < 0.3] if d != ds[-1] else [] for d in ds} for m in ("m", "n") for g, ds in dates.items()}
    plan = spark.createDataFrame([(m, 0, g, d, t) for (m, g), own in events.items() for d, t in own.items()], f"model string, path int, `group` int, execution_date date, targets array<{code}>")
    market = spark.createDataFrame(rows, f"stock_code {code}, date date, price double, tradable boolean")
    s = validate.PortfolioSettings(sell_fee=0.002)
    got = portfolio.simulate(plan, portfolio.prepare_market(market), s).collect()
    price, tradable = {(d, c): p for c, d, p, _ in rows}, {(d, c): t for c, d, _, t in rows}
    for (m, g), own in events.items():
        want, mine = held_by_loop(own, price, tradable, s), [r for r in got if (r.model, r.group) == (m, g)]
        assert {r.date: r.equity for r in mine if r.record == "nav"} == pytest.approx({d: x[2] for d, x in want.items()})
        assert {(r.date, r.stock_code): (r.side, r.status) for r in mine if r.record == "trade"} == {(d, c): t[:2] for d, x in want.items() for c, t in x[0].items()}
        assert {(r.date, r.stock_code): r.executed for r in mine if r.record == "trade"} == pytest.approx({(d, c): t[2] for d, x in want.items() for c, t in x[0].items()})
        assert {(r.date, r.stock_code): r.weight for r in mine if r.record == "holding" and r.status is None} == pytest.approx({(d, c): w for d, x in want.items() for c, w in x[1].items()})
    with pytest.raises(Exception, match="repeats a stock"):
        portfolio.simulate(plan, portfolio.prepare_market(market.unionByName(market)), s).collect()


def test_simulation_streams():
    """The records of a date leave before the next date but one is read."""
    schema = pa.schema([("model", pa.string()), ("path", pa.int64()), ("date", pa.date32()), ("group", pa.int32()), ("until", pa.date32()), ("stock_code", pa.list_(pa.int64())), ("price", pa.list_(pa.float64())), ("tradable", pa.list_(pa.bool_()))])
    rows = [("m", 0, None, 1, day(9), None, None, None), ("m", 0, day(0), None, None, [1, 2], [5.0, 4.0], [True, True]), ("m", 0, day(0), 1, None, [1, 2], None, None)]
    rows += [("m", 0, day(i), None, None, [1, 2], [5.0 + i, 4.0], [True, None]) for i in range(1, 10)]
    read = []

    def batches():
        for row in rows:
            read.append(row)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)

    ahead = [(b.column("date")[0].as_py(), len(read)) for b in portfolio.simulated(batches(), validate.PortfolioSettings(), ("nav",))]
    assert [d for d, _ in ahead] == [day(i) for i in range(10)] and all(n <= 3 + i + 1 for i, (_, n) in enumerate(ahead))


def test_simulation_makes_only_the_records_asked_for(spark):
    plan = spark.createDataFrame([("m", 0, 1, day(0), [1, 2]), ("m", 0, 1, day(2), [])], "model string, path int, `group` int, execution_date date, targets array<long>")
    market = spark.createDataFrame([(c, day(i), 5.0 + i * c, True) for c in (1, 2) for i in range(3)], "stock_code long, date date, price double, tradable boolean")
    whole = portfolio.simulate(plan, market, validate.PortfolioSettings())
    for kind, n in {"trade": 4, "holding": 4, "nav": 3}.items():
        got = portfolio.simulate(plan, market, validate.PortfolioSettings(), [kind])
        assert got.count() == n and sorted(map(str, got.collect())) == sorted(map(str, whole.where(F.col("record") == kind).collect()))


def test_returns_read_the_values_once(spark):
    rows = [("m", 0, 1, day(0), 0.10, 0.12), ("m", 0, 3, day(0), 0.02, 0.03), ("m", 0, 2, day(0), 9.0, 9.0), ("m", 0, 1, day(1), 0.05, 0.05), ("m", 0, 3, day(2), 0.01, 0.01), ("m", 1, 3, day(0), 0.01, 0.01)]
    nav = spark.createDataFrame(rows, "model string, path long, `group` int, date date, daily_return double, gross_return double").mapInArrow(lambda batches: batches, "model string, path long, `group` int, date date, daily_return double, gross_return double")
    got = portfolio.portfolio_returns(nav, 3)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {(r.path, r.portfolio, r.date): (r.daily_return, r.nav) for r in got.collect()}
    assert set(found) == {(0, "top_long", day(0)), (0, "top_long", day(1)), (0, "top_bottom", day(0))}
    assert found[0, "top_long", day(1)] == pytest.approx((0.05, 1.1 * 1.05)) and found[0, "top_bottom", day(0)] == pytest.approx((0.12 - 0.03 - 0.02 - 0.01, 1.06))


def test_trades_leave_in_small_batches():
    """A date's trades go back in batches of bounded size, blocked ones and cash among them in order of the stocks."""
    n = 25_000
    events = [{"model": "m", "path": 0, "date": None, "group": 1, "until": day(0)}, {"model": "m", "path": 0, "date": day(0), "stock_code": list(range(n)), "price": [5.0] * n, "tradable": [i % 10 > 0 for i in range(n)]}, {"model": "m", "path": 0, "date": day(0), "group": 1, "stock_code": list(range(n))}]
    schema = pa.schema([("model", pa.string()), ("path", pa.int64()), ("date", pa.date32()), ("group", pa.int32()), ("until", pa.date32()), ("stock_code", pa.list_(pa.int64())), ("price", pa.list_(pa.float64())), ("tradable", pa.list_(pa.bool_()))])
    out = list(portfolio.simulated(iter([pa.RecordBatch.from_pylist(events, schema=schema)]), validate.PortfolioSettings(initial_capital=1.0 * n), ("trade",)))
    assert [b.num_rows for b in out] == [10_000, 10_000, 5_000]
    whole = pa.Table.from_batches(out).to_pandas()
    assert list(whole.stock_code) == list(range(n)) and list(whole.status) == ["blocked" if i % 10 == 0 else "filled" for i in range(n)]
    assert whole.executed.sum() == pytest.approx(0.9 * n / 5) and whole.cash.min() == pytest.approx(0.1 * n) and whole.cash.isna().sum() == n / 10
