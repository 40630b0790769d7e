"""Every query against its SQL; the plans of the main ones; the package without its llm folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from quillon.queries import catalogue

from .conftest import ROOT, SF, same_rows

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, SF), duck.execute(SQL[name]).df())


WITHOUT_SQL = {"window_tensor", "mean_variance", "risk_parity", "risk_budget", "hrp", "herc", "min_variance", "nco", "olmar", "simulate_paths", "trades", "holdings", "top_bottom_returns", "model_predict", "model_training", "gradient_importance"}


def test_all_others_have_sql():
    assert set(catalogue.queries()) - set(SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", ["mean_variance", "risk_parity", "risk_budget", "hrp", "herc", "min_variance", "nco"])
def test_weights(spark, name):
    """Weights of every year are finite, of nonnegative sign and sum to one."""
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert len(got) and (got.weight > -1e-6).all() and got.groupby("year").weight.sum().sub(1).abs().max() < 1e-4


def test_windows_by_brute_force(spark):
    """The tensors of a code are its consecutive rows, read from the panel with pandas."""
    from quillon.sources import synthetic as syn

    got = catalogue.queries()["window_tensor"](spark, SF).toPandas()
    panel = syn.panel(spark, SF).toPandas().sort_values(["stock_code", "date"])
    assert len(got)
    for row in got.itertuples():
        own = panel[(panel.stock_code == row.stock_code) & (panel.date <= row.date)].tail(6)
        assert [tuple(x) for x in row.window] == list(zip(own.factor, own.fwd))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["rank_ic", "quantile_backtest", "interval_anti_st", "universe_all_dates", "forward_labels", "tolerance_recalc", "path_schedule", "rank_ic_paths", "fit_preprocessor"])
def test_plans_have_no_loops(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pushdown(spark):
    plan = catalogue.queries()["pushdown_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_orderdate" in plan and "o_totalprice" not in plan


def test_library_stands_without_llm(tmp_path):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'rank_ic' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    for path in (ROOT / "quillon").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quillon.llm" not in path.read_text() and "from .llm" not in path.read_text() and "..llm" not in path.read_text()


def test_bond_yield_covers_every_part(spark):
    found = catalogue.queries()["bond_yield"](spark, SF).toPandas()
    assert len(found) == spark.read.parquet(f"{SF}/part.parquet").count() and (found.given - found.found).abs().max() < 2e-6


@pytest.mark.parametrize("keys", [[998, 999], [7, 999, 1000, 5999, None], [2**31 - 1], [12, 2**31 + 5, 10**15]])
def test_next_case_id_of_long_keys(spark, duck, tmp_path, keys):
    """Keys of more than three digits are whole in their ids, and numbers aren't bound to 32 bits."""
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    want = duck.execute(SQL["next_case_id"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")).df()
    same_rows(catalogue.queries()["next_case_id"](spark, str(tmp_path)), want)
