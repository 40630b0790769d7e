"""Multi-path tradable portfolios: schedules, simulation of each path and group, and their metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import wealth
from ..functions.statistics import average_rank, clean, safe_corr
from . import cross_section as xs
from .validate import PortfolioSettings


def prepare_market(df: DataFrame) -> DataFrame:
    """stock_code, date, price (null unless positive), tradable (flag and price)."""
    price = F.when(clean(F.col("price")) > 0, F.col("price").cast("double"))
    return df.select("stock_code", "date", price.alias("price"), (F.coalesce("tradable", F.lit(False)) & price.isNotNull()).alias("tradable"))


def model_days(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """model, date, trade_index, pos: the market dates of each model's range, numbered from 0; by indexes, so the join is an equality."""
    cal = calendar.select("date", "trade_index")
    span = rows.groupBy("model").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    span = span.join(cal.select(F.col("date").alias("lo"), F.col("trade_index").alias("_from")), "lo").join(cal.select(F.col("date").alias("hi"), F.col("trade_index").alias("_to")), "hi")
    days = span.select("model", "_from", F.explode(F.sequence("_from", "_to")).alias("trade_index"))
    return days.join(cal, "trade_index").select("model", "date", "trade_index", (F.col("trade_index") - F.col("_from")).alias("pos"))


def schedule(groups: DataFrame, calendar: DataFrame, settings: PortfolioSettings) -> DataFrame:
    """model, path, group, signal_date, execution_date, kind, targets: what each path is to hold, and when.

    Signals are taken at every interval-th market date of the model's range, from the path's offset. Leading
    events without targets go; a last one sells all, exit_offset dates after the last signal.
    """
    cal = calendar.select("date", "trade_index")
    days = model_days(groups, calendar)
    days = days.select("model", F.col("date").alias("signal_date"), "trade_index", (F.col("pos") % settings.interval).alias("path")).where(F.col("path").isin(list(settings.path_offsets)))
    execute = cal.select((F.col("trade_index") - settings.entry_offset).alias("trade_index"), F.col("date").alias("execution_date"))
    days = days.join((execute), "trade_index")
    numbers = groups.select("model", "group").distinct()
    slots = days.join(numbers, "model")
    chosen = groups.groupBy("model", "group", F.col("date").alias("signal_date")).agg(F.sort_array(F.collect_list("stock_code")).alias("targets"))
    events = slots.join(chosen, ["model", "group", "signal_date"], "left").withColumn("targets", F.coalesce("targets", F.array().cast(dict(chosen.dtypes)["targets"])))
    own = Window.partitionBy("model", "path", "group")
    first = F.min(F.when(F.size("targets") > 0, F.col("execution_date"))).over(own)
    events = events.withColumn("_first", first).where("execution_date >= _first").drop("_first")
    last = events.groupBy("model", "path", "group").agg(F.max("signal_date").alias("signal_date"), F.max("trade_index").alias("trade_index"), F.first("targets").alias("targets"))
    leave = cal.select((F.col("trade_index") - settings.exit_offset).alias("trade_index"), F.col("date").alias("execution_date"))
    final = last.join((leave), "trade_index").withColumn("targets", F.slice("targets", F.lit(1), F.lit(0)))
    cols = ["model", "path", "group", "signal_date", "execution_date"]
    return events.select(*cols, F.lit("rebalance").alias("kind"), "targets").unionByName(final.select(*cols, F.lit("final_exit").alias("kind"), "targets"))


#: What a simulation records, and the columns of its records besides their keys; a column that doesn't apply is null.
KINDS = ("trade", "holding", "nav")
TEXTS = ["status", "side"]
NUMBERS = ["requested", "executed", "price", "fee", "cash", "equity", "daily_return", "gross_return", "nav", "weight"]


class Day:
    """Prices and tradability of a market date by stock; a stock that is absent has no price and can't trade."""

    def __init__(self, date, names: np.ndarray, price: np.ndarray, tradable: np.ndarray):
        self.date, self.index = date, pd.Index(names)
        if not self.index.is_unique:
            raise ValueError(f"the market repeats a stock on {date}")
        price = np.append(np.where(np.isfinite(price), price, np.nan), np.nan)  # the last place is that of absent stocks
        self.price, self.free = price, np.append(tradable, False) & ~np.isnan(price)

    def of(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.index.get_indexer(names)
        return self.price[at], self.free[at]


class Book:
    """What one path and group holds: stocks in ascending order with shares and last known prices, and cash.

    An event moves the shares towards equal amounts: what is too much goes at once, what is wanted is bought in
    proportion to the cash there is. A stock that can't trade keeps its shares. Between events the shares stand still.
    """

    def __init__(self, settings: PortfolioSettings):
        self.settings, self.names, self.shares, self.marks = settings, None, np.zeros(0), np.zeros(0)
        self.cash = self.before = settings.initial_capital

    def after(self, day: Day, targets: np.ndarray | None) -> Iterator[tuple[str, np.ndarray | None, dict]]:
        """kind, stocks (None: one record without) and columns of the date's records; targets: distinct, None without an event."""
        fee = 0.0
        if targets is None:
            price, _ = day.of(self.names)
            self.marks = np.where(np.isnan(price), self.marks, price)
        else:
            fee = yield from self._rebalanced(day, targets)
        equity = self.cash + self.shares @ self.marks
        if not np.isfinite(equity) or equity <= 0:
            raise ValueError(f"equity {equity} on {day.date}")
        if targets is not None:
            yield "holding", self.names, {"executed": self.shares, "price": self.marks, "weight": self.shares * self.marks / equity}
            yield "holding", None, {"status": "cash", "cash": self.cash, "weight": self.cash / equity}
        ret = equity / self.before - 1
        yield "nav", None, {"cash": self.cash, "equity": equity, "fee": fee, "daily_return": ret, "gross_return": ret + fee / self.before, "nav": equity / self.settings.initial_capital}
        self.before = equity

    def _rebalanced(self, day: Day, targets: np.ndarray) -> Iterator[tuple[str, np.ndarray, dict]]:
        """Records of the trades; returns the fee."""
        s, held = self.settings, targets[:0] if self.names is None else self.names
        names = np.union1d(held, targets) if len(held) else np.unique(targets)
        shares, marks, at = np.zeros(len(names)), np.zeros(len(names)), np.searchsorted(names, held)
        shares[at], marks[at] = self.shares, self.marks
        price, free = day.of(names)
        marks = np.where(np.isnan(price), marks, price)
        goal, chosen = np.zeros(len(names)), np.searchsorted(names, targets)
        if len(targets):
            cost = price[chosen]
            goal[chosen] = np.divide((self.cash + shares @ marks) / len(targets), cost, out=np.zeros(len(targets)), where=cost > 0)
        wish, paying = goal - shares, np.nan_to_num(price)
        less, more = wish < -s.share_epsilon, wish > s.share_epsilon
        sold = np.where(less & free, np.maximum(wish, -shares), 0.0)
        paid = -sold * paying
        fee = paid * s.sell_fee
        yield "trade", names[less], {"side": "sell", **_at(less, free, "filled", requested=wish, executed=sold, price=price, fee=fee, cash=self.cash + np.cumsum(paid - fee))}
        cash, shares = self.cash + (paid - fee).sum(), shares + sold
        shares[shares <= s.share_epsilon] = 0.0
        cost = np.where(more & free, wish * paying, 0.0)
        part = min(1.0, cash / cost.sum()) if cost.sum() > 0 else 0.0
        bought = np.where(more & free, wish * part, 0.0)
        yield "trade", names[more], {"side": "buy", **_at(more, free, "filled" if part >= 1 - 1e-12 else "partial", requested=wish, executed=bought, price=price, fee=np.zeros(len(names)), cash=cash - np.cumsum(cost * part))}
        shares = shares + np.where(bought > s.share_epsilon, bought, 0.0)
        own = shares > 0
        self.names, self.shares, self.marks, self.cash = names[own], shares[own], marks[own], cash - (cost * part).sum()
        return fee.sum()


def _at(rows: np.ndarray, free: np.ndarray, done: str, **columns: np.ndarray) -> dict:
    """The columns at these rows; blocked ones show what was asked for, and no price, fee or cash."""
    shown = {k: v if k in ("requested", "executed") else np.where(free, v, np.nan) for k, v in columns.items()}
    return {"status": np.where(free, done, "blocked").astype(object)[rows]} | {k: v[rows] for k, v in shown.items()}


def _walked(days: Iterable[tuple[Day, dict]], until: dict, settings: PortfolioSettings) -> Iterator[tuple]:
    """group, date and record of every group of a path, from its first event to `until`, a date at a time; days: ascending, with the targets of each group that has an event."""
    books: dict = {}
    for day, due in days:
        for group in sorted({*books, *due}):
            book = books.setdefault(group, Book(settings))
            for record in book.after(day, due.get(group)):
                yield group, day.date, *record
            if day.date >= until[group]:
                del books[group]


def simulate_events(events: pd.DataFrame, market: pd.DataFrame, settings: PortfolioSettings) -> list[dict]:
    """Trades, holdings and daily values of one path and group, from tables in memory."""
    due = {d: np.unique(np.array(list(t), object)) for d, t in zip(events["execution_date"], events["targets"])}
    span = dict(list(market[market["date"].between(min(due), max(due))].groupby("date")))
    rows = lambda d: span.get(d, market.iloc[:0])
    days = ((Day(d, rows(d)["stock_code"].to_numpy(object), rows(d)["price"].to_numpy(float), rows(d)["tradable"].eq(True).to_numpy()), {0: due[d]} if d in due else {}) for d in sorted({*span, *due}))
    out: list[dict] = []
    for _, date, kind, names, columns in _walked(days, {0: max(due)}, settings):
        spread = {k: v if isinstance(v, np.ndarray) else [v] * (1 if names is None else len(names)) for k, v in columns.items()}
        out += [{"date": date, "record": kind, "stock_code": s} | {k: v[i] for k, v in spread.items()} for i, s in enumerate([None] if names is None else names)]
    return out


#: Rows of a batch that goes back to Spark, at most; blocks that a date's stocks are dealt to.
BATCH = 10_000
BLOCKS = 32


def _days(rows: Iterable[tuple]) -> Iterator[tuple[Day, dict]]:
    """Dates with their events from rows (date, group, stocks, prices, tradable): blocks of the market have no group, events no prices."""
    for date, own in groupby(rows, itemgetter(0)):
        blocks, due, none = [], {}, None
        for _, group, names, price, tradable in own:
            names = names.values.to_numpy(zero_copy_only=False)
            if group is None:
                blocks.append((names, price.values.to_numpy(zero_copy_only=False).astype(float), tradable.values.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)))
            else:
                due[group], none = np.unique(names), names[:0]
        yield Day(date, *(map(np.concatenate, zip(*blocks)) if blocks else (none, np.zeros(0), np.zeros(0, bool)))), due


def simulated(batches: Iterator[pa.RecordBatch], settings: PortfolioSettings, kinds: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Records of the paths whose rows come sorted by model, path, date (null: a group's last date) and group; they leave with the date that makes them."""
    codes: list[pa.DataType] = []

    def read():
        for batch in batches:
            codes[:] = [batch.schema.field("stock_code").type.value_type]
            keys = [batch.column(c).to_pylist() for c in ("model", "path", "date", "group", "until")]
            lists = [batch.column(c) for c in ("stock_code", "price", "tradable")]
            yield from ((*k, *(x[i] for x in lists)) for i, k in enumerate(zip(*keys)))

    def made(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
        one = lambda v, kind: pa.nulls(n, kind) if v is None else pa.array(v, kind, from_pandas=True) if isinstance(v, np.ndarray) else pa.repeat(pa.scalar(v, kind), n)
        return pa.RecordBatch.from_arrays([one(columns.get(f.name), f.type) for f in schema], schema=schema)

    for (model, path), rows in groupby(read(), itemgetter(0, 1)):
        schema = pa.schema([("model", pa.string()), ("path", pa.int64()), ("group", pa.int32()), ("date", pa.date32()), ("record", pa.string()), ("stock_code", codes[0]), *((c, pa.string()) for c in TEXTS), *((c, pa.float64()) for c in NUMBERS)])
        until, first = {}, None
        for row in rows:
            if row[2] is not None:
                first = row
                break
            until[row[3]] = row[4]
        if first is None:
            continue
        days = _days((r[2], r[3], *r[5:]) for r in chain([first], rows))
        for group, date, kind, names, columns in _walked(days, until, settings):
            if kind in kinds:
                n = 1 if names is None else len(names)
                whole = made(schema, n, {"model": model, "path": path, "group": group, "date": date, "record": kind, "stock_code": names, **columns})
                yield from (whole.slice(i, BATCH) for i in range(0, n, BATCH))


def simulate(events: DataFrame, market: DataFrame, settings: PortfolioSettings, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Trades, holdings and daily values (record, of these kinds) of all paths: a task for each (model, path), whose groups share one reading of the market.

    Only cash joins the stocks of a group, but by every event, so a path is gone through in order. The market comes date by
    date, in blocks, and the records of a date leave before the next is read: a task holds what its groups own and one date.
    """
    keys = ["model", "path", "group"]
    code = dict(market.dtypes)["stock_code"]
    events = events.select(F.col("model").cast("string").alias("model"), F.col("path").cast("long").alias("path"), F.col("group").cast("int").alias("group"), F.col("execution_date").alias("date"), F.array_compact("targets").cast(f"array<{code}>").alias("stock_code"))
    rows = F.collect_list(F.struct("stock_code", F.col("price").cast("double").alias("price"), "tradable"))
    blocks = market.where("stock_code IS NOT NULL AND date IS NOT NULL").groupBy("date", F.pmod(F.xxhash64("stock_code"), F.lit(BLOCKS)).alias("_block")).agg(rows.alias("_rows"))
    blocks = blocks.select("date", *[F.col(f"_rows.{c}").alias(c) for c in ("stock_code", "price", "tradable")])
    spans = events.groupBy("model", "path").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    ends = events.groupBy(*keys).agg(F.max("date").alias("until"))
    stream = spans.join(blocks, "date").unionByName(events, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    stream = stream.select("model", "path", "date", "group", "until", "stock_code", "price", "tradable").repartition("model", "path").sortWithinPartitions("model", "path", "date", "group")
    kept = tuple(kinds)
    schema = f"model string, path long, `group` int, date date, record string, stock_code {code}, {', '.join(f'{c} string' for c in TEXTS)}, {', '.join(f'{c} double' for c in NUMBERS)}"
    return stream.mapInArrow(lambda batches: simulated(batches, settings, kept), schema)


def portfolio_returns(nav: DataFrame, n_groups: int) -> DataFrame:
    """model, path, portfolio (top_long, top_bottom), date, daily_return, nav; both legs pay their fees. nav is read once."""
    leg = lambda g: F.max(F.when(F.col("group") == g, F.struct(F.col("daily_return").alias("ret"), (F.col("gross_return") - F.col("daily_return")).alias("fee"))))
    both = nav.where(F.col("group").isin(1, n_groups)).groupBy("model", "path", "date").agg(leg(1).alias("top"), leg(n_groups).alias("low"))
    spread = F.expr("(top.ret + top.fee) - (low.ret + low.fee) - top.fee - low.fee")
    row = lambda name, there, ret: F.when(there, F.struct(F.lit(name).alias("portfolio"), ret.alias("daily_return")))
    top, low = F.col("top").isNotNull(), F.col("low").isNotNull()
    rows = F.array_compact(F.array(row("top_long", top, F.col("top.ret")), row("top_bottom", top & low, spread)))
    return wealth(both.select("model", "path", "date", F.inline(rows)).select("model", "path", "date", "portfolio", "daily_return"), "daily_return", ["model", "path", "portfolio"])


def path_metrics(returns: DataFrame, periods: int = 252, ret: str = "daily_return", keys: tuple[str, ...] = ("model", "path", "portfolio")) -> DataFrame:
    """Metrics of each path for the whole time and for each calendar year; wealth starts anew with each period."""
    from ..functions.metrics import performance_summary

    rows = returns.select(*keys, "date", ret, F.explode(F.array(F.lit("all"), F.year("date").cast("string"))).alias("period"))
    return performance_summary(rows, [*keys, "period"], ret, periods=periods)


def metrics_over_paths(metrics: DataFrame, keys: tuple[str, ...] = ("model", "portfolio", "period")) -> DataFrame:
    names = ["annual_return", "annual_volatility", "sharpe", "max_drawdown", "win_rate"]
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names], F.count_distinct("path").alias("paths"))


def daily_path_aggregate(nav: DataFrame, keys: tuple[str, ...] = ("model", "group")) -> DataFrame:
    """Mean wealth over the paths of each date; returns come from that mean."""
    mean = nav.groupBy(*keys, "date").agg(F.avg("nav").alias("nav"), F.count(F.lit(1)).alias("paths"))
    own = Window.partitionBy(*keys).orderBy("date")
    return mean.withColumn("daily_return", F.col("nav") / F.coalesce(F.lag("nav").over(own), F.lit(1.0)) - 1)


def monotonicity(df: DataFrame, value: str = "annual_return", by: str = "model", group: str = "group") -> DataFrame:
    """Rank correlation of group number and return (and its negative), share of neighbours in order, top less bottom."""
    own = Window.partitionBy(by).orderBy(group)
    rows = df.withColumn("_rank", average_rank(F.col(value), [by])).withColumn("_next", F.lead(value).over(own))
    return rows.groupBy(by).agg(
        safe_corr(F.col(group).cast("double"), F.col("_rank"), 2).alias("spearman"),
        (-safe_corr(F.col(group).cast("double"), F.col("_rank"), 2)).alias("monotonicity"),
        F.avg(F.when(F.col("_next").isNotNull(), (F.col(value) >= F.col("_next")).cast("double"))).alias("ordered_share"),
        (F.min_by(value, group) - F.max_by(value, group)).alias("top_bottom"),
    )


def rank_ic_paths(diagnostics: DataFrame, calendar: DataFrame, interval: int) -> DataFrame:
    """model, path, ic_mean, n_dates: rank ICs by position of the date in the model's part of the calendar, modulo interval."""
    days = model_days(diagnostics, calendar).withColumn("path", F.col("pos") % interval)
    rows = diagnostics.join(days.select("model", "date", "path"), ["model", "date"])
    return rows.groupBy("model", "path").agg(F.avg("ic").alias("ic_mean"), F.count(F.lit(1)).alias("n_dates"))


def rank_ic_over_paths(paths: DataFrame, interval: int) -> DataFrame:
    """Mean of the path means; missing if any path is."""
    mean = F.when((F.count("ic_mean") == F.count(F.lit(1))) & (F.count(F.lit(1)) == interval), F.avg("ic_mean"))
    return paths.groupBy("model").agg(mean.alias("ic_mean"), F.stddev_samp("ic_mean").alias("ic_std"), F.median("ic_mean").alias("ic_median"), F.avg((F.col("ic_mean") > 0).cast("double")).alias("positive_rate"), F.count(F.lit(1)).alias("paths"))


def diagnostics(df: DataFrame) -> DataFrame:
    """model, date, ic and candidate, valid and missing label counts with rates."""
    ic = xs.ic_series(df, "prediction", "label", ["model", "date"]).drop("n")
    valid = clean(F.col("label")).isNotNull().cast("long")
    counts = df.groupBy("model", "date").agg(F.count(F.lit(1)).alias("candidates"), F.sum(valid).alias("valid"))
    return counts.join(ic, ["model", "date"], "left").withColumn("missing", F.col("candidates") - F.col("valid")).withColumn("valid_rate", F.col("valid") / F.col("candidates"))


def label_coverage(diagnosed: DataFrame) -> DataFrame:
    out = diagnosed.groupBy("model").agg(F.sum("candidates").alias("candidates"), F.sum("valid").alias("valid"), F.sum("missing").alias("missing"))
    if out.where("candidates <> valid + missing").take(1):
        raise ValueError("label counts don't add up")
    return out


def run_backtest(predictions: DataFrame, market: DataFrame, calendar: DataFrame, settings: PortfolioSettings) -> dict[str, DataFrame]:
    """All tables of a multi-path backtest, lazily."""
    settings.validate()
    groups = xs.descending_groups(predictions, settings.n_groups)
    events = schedule(groups, calendar, settings)
    trades, holdings, nav = (simulate(events, prepare_market(market), settings, [kind]) for kind in KINDS)
    returns = portfolio_returns(nav, settings.n_groups)
    by_path = path_metrics(returns, settings.periods_per_year)
    by_group = path_metrics(nav.select("model", "path", F.col("group").alias("portfolio"), "date", "daily_return"), settings.periods_per_year)
    diagnosed = diagnostics(predictions)
    paths = rank_ic_paths(diagnosed, calendar, settings.interval)
    group_metrics = by_group.where("period = 'all'").groupBy("model", F.col("portfolio").alias("group")).agg(F.avg("annual_return").alias("annual_return"))
    return {
        "groups": groups, "events": events, "trades": trades, "holdings": holdings, "nav": nav,
        "returns": returns, "path_metrics": by_path, "metrics": metrics_over_paths(by_path), "group_metrics": by_group, "daily": daily_path_aggregate(nav),
        "monotonicity": monotonicity(group_metrics), "diagnostics": diagnosed, "rank_ic_paths": paths, "rank_ic": rank_ic_over_paths(paths, settings.interval), "label_coverage": label_coverage(diagnosed),
        "model_correlation": xs.model_pairs(predictions), "model_correlation_daily": xs.model_pairs(predictions, by_date=True),
    }
