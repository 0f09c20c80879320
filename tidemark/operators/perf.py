"""Returns, equity curves, trades, positions and their metrics.

Series are long tables: (strategy_id, t, ret) or (strategy_id, t, equity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def S():
    return Window.partitionBy("strategy_id").orderBy("t")


def RUN():
    return S().rowsBetween(Window.unboundedPreceding, 0)

#: Bars a year by timeframe, for markets that never close (365 days) and for stocks (252 days of 390 minutes).
BARS_A_YEAR_CRYPTO = {
    "1m": 365 * 24 * 60, "5m": 365 * 24 * 12, "15m": 365 * 24 * 4, "30m": 365 * 24 * 2, "1h": 365 * 24, "2h": 365 * 12,
    "4h": 365 * 6, "6h": 365 * 4, "8h": 365 * 3, "12h": 365 * 2, "1d": 365, "1w": 52,
}
BARS_A_YEAR_STOCK = {"1m": 252 * 390, "5m": 252 * 78, "15m": 252 * 26, "30m": 252 * 13, "1h": 252 * 7, "4h": 252 * 2, "1d": 252, "1w": 52}
#: Bars a year of a timeframe that the tables lack.
BARS_A_YEAR = 365 * 24
#: Half spreads by symbol and impacts by timeframe, in percent, and what holds for others; crypto, then stocks.
SPREAD_CRYPTO = {"BTCUSDT": 0.005, "ETHUSDT": 0.007, "SOLUSDT": 0.010, "BNBUSDT": 0.010, "AVAXUSDT": 0.015, "LINKUSDT": 0.015}
IMPACT_CRYPTO = {"1m": 0.020, "5m": 0.015, "15m": 0.010, "30m": 0.008, "1h": 0.005, "2h": 0.004, "4h": 0.003, "1d": 0.002}
USUAL_CRYPTO = (0.010, 0.005)
SPREAD_STOCK = {
    "SPY": 0.003, "QQQ": 0.003, "IWM": 0.005, "XLK": 0.005, "XLF": 0.005, "XLE": 0.008, "GLD": 0.005, "TLT": 0.005,
    "AAPL": 0.003, "MSFT": 0.003, "NVDA": 0.005, "TSLA": 0.008, "AMZN": 0.005,
}
IMPACT_STOCK = {"1m": 0.010, "5m": 0.008, "15m": 0.005, "30m": 0.004, "1h": 0.003, "4h": 0.002, "1d": 0.001}
USUAL_STOCK = (0.005, 0.003)


def lookup(table: dict[str, float], key: Column, usual: float) -> Column:
    """The table's value of ``key``; ``usual`` where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])[key], F.lit(float(usual)))


def simple_returns(curves: DataFrame) -> DataFrame:
    """Returns of an equity curve; the first is 0 and counts."""
    return curves.withColumn("ret", F.coalesce(F.col("equity") / F.lag("equity").over(S()) - 1, F.lit(0.0)))


def drawdowns(curves: DataFrame) -> DataFrame:
    peak = F.max("equity").over(RUN())
    return curves.withColumn("dd", (peak - F.col("equity")) / peak)


def perf_metrics(curves: DataFrame, bars_a_year: float, *keys: str) -> DataFrame:
    """Profit, return, Sharpe, Sortino (null with fewer than two losses), drawdown, Calmar, to 4 places.

    A ratio is 0 where its divisor is, and Sharpe and Sortino for a single bar.
    """
    rows = drawdowns(simple_returns(curves))
    root = F.sqrt(F.lit(float(bars_a_year)))
    out = rows.groupBy("strategy_id", *keys).agg(F.min_by("equity", "t").alias("e0"), F.max_by("equity", "t").alias("e1"), F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("d"), F.max("dd").alias("dd"))
    total = (F.col("e1") / F.col("e0") - 1) * 100
    cols = {"net_profit": F.col("e1") - F.col("e0"), "return_pct": total, "sharpe": F.coalesce(F.try_divide("m", "s") * root, F.lit(0.0)), "sortino": F.when((F.col("n") < 2) | (F.col("d") == 0), 0.0).otherwise(F.col("m") / F.col("d") * root), "max_dd_pct": F.col("dd") * 100, "calmar": F.coalesce(F.try_divide(total, F.col("dd") * 100), F.lit(0.0))}
    return out.select("strategy_id", *keys, *[F.round(c, 4).alias(n) for n, c in cols.items()])


def compound(returns: DataFrame, capital: float) -> DataFrame:
    """Equity from returns above -1: capital times e to the running sum of log growth."""
    return returns.withColumn("equity", capital * F.exp(F.sum(F.log1p("ret")).over(RUN())))


def annualisation(timeframe: Column, stock: Column) -> Column:
    """Root of the bars a year of a timeframe; that of hours for one that isn't known."""
    return F.sqrt(F.when(stock, lookup(BARS_A_YEAR_STOCK, timeframe, BARS_A_YEAR)).otherwise(lookup(BARS_A_YEAR_CRYPTO, timeframe, BARS_A_YEAR)))


def signal_episodes(bars: DataFrame) -> DataFrame:
    """Runs in position, entered the bar after the signal: bars, prices, gross profit of one unit."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumns({"on": F.coalesce(F.lag("signal").over(w), F.lit(False)), "n": F.row_number().over(w)})
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("symbol", "on").orderBy("ts")))
    out = rows.where("on").groupBy("symbol", "island").agg(F.min("n").alias("entry_bar"), F.max("n").alias("exit_bar"), F.min_by("open", "ts").alias("entry_price"), F.max_by("close", "ts").alias("exit_price"))
    return out.drop("island").withColumn("pnl", F.col("exit_price") - F.col("entry_price"))


def episode_bars(bars: DataFrame) -> DataFrame:
    """Bars of episodes with their episode's number (first bar's place)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumns({"on": F.coalesce(F.lag("signal").over(w), F.lit(False)), "n": F.row_number().over(w)})
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("symbol", "on").orderBy("ts")))
    return rows.where("on").withColumn("episode", F.min("n").over(Window.partitionBy("symbol", "island"))).drop("on", "island")


def stop_levels(rows: DataFrame, pct: float, mult: float) -> DataFrame:
    """Ratcheted fixed, ATR and Chandelier stops of long episodes and the first bar that breaches each; needs atr."""
    e = Window.partitionBy("symbol", "episode").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"fixed": F.max(F.col("high") - F.col("close") * pct / 100).over(e), "atr_stop": F.max(F.col("close") - mult * F.col("atr")).over(e), "chandelier": F.max("high").over(e) - mult * F.col("atr")})
    first = [F.min(F.when(F.col("low") <= F.col(c), F.col("n"))).alias(f"{c}_breach") for c in ("fixed", "atr_stop", "chandelier")]
    return rows.groupBy("symbol", "episode").agg(F.max("fixed").alias("fixed_stop"), *first)


def trade_metrics(trades: DataFrame, *keys: str) -> DataFrame:
    """Win rate, profit factor (999.99 without losses), mean, longest losing run, count; net of commission."""
    net = F.col("pnl") - F.col("commission")
    rows = trades.withColumn("net", net).withColumn("lost", net < 0)
    w = Window.partitionBy(*keys).orderBy("entry_bar")
    rows = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "lost").orderBy("entry_bar")))
    runs = rows.where("lost").groupBy(*keys, "island").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.max("c").alias("max_losses"))
    win, loss = F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0.0)), F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0.0))
    out = rows.groupBy(*keys).agg(F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.when(loss > 0, win / loss).when(win > 0, 999.99).otherwise(0.0).alias("profit_factor"), F.avg("net").alias("mean_trade"), F.count("*").alias("n_trades"))
    return out.join(runs, list(keys), "left").withColumn("max_losses", F.coalesce("max_losses", F.lit(0)))


def position_size(trades: DataFrame, equity: Column, risk_pct: float, stop: Column, atr: Column, win: Column, payoff: Column, price: Column, most_risk_pct: float = 5.0, atr_multiple: float = 2.0, kelly_share: float = 0.5, least: float = 0.0, most: float = float("inf"), leverage: float = 1.0) -> DataFrame:
    """Units by fixed fraction of equity, by ATR and by a share of Kelly.

    The risk is ``most_risk_pct`` of equity at most; sizes are cut to ``most`` and to the leverage, and are
    0 below ``least``, without a stop (fixed), a range (ATR) or an edge (Kelly). Kelly risks its share up to the stop, or the price without one.
    """
    far = F.nullif(F.abs(price - stop), F.lit(0.0))
    share = F.least(F.lit(risk_pct), F.lit(most_risk_pct)) / 100

    def clamp(x: Column) -> Column:
        cut = F.least(x, F.lit(most), equity * leverage / price)
        return F.when((x > 0) & ~F.isnan(x) & (cut >= least), cut).otherwise(0.0)

    edge = F.when((payoff > 0) & (win > 0) & (win < 1), win - (1 - win) / payoff)
    kelly = F.least(edge * kelly_share, F.lit(most_risk_pct / 100))
    sizes = {"fixed": F.try_divide(equity * share, far), "by_atr": F.when(atr > 0, equity * share / (atr * atr_multiple)), "kelly": F.when(edge > 0, equity * kelly / F.coalesce(far, price))}
    return trades.withColumns({c: clamp(x) for c, x in sizes.items()})


def optimal_f(trades: DataFrame, *keys: str) -> DataFrame:
    """The fraction of 0.01 to 1.00 with the largest product of holding-period returns, winners adding to wealth."""
    worst = trades.groupBy(*keys).agg(F.min("pnl").alias("worst__")).where("worst__ < 0")
    grid = trades.sparkSession.range(1, 101).select((F.col("id") / 100).alias("f"))
    rows = trades.join(worst, list(keys)).crossJoin(F.broadcast(grid))  # 100 rows
    hpr = 1 + F.col("f") * F.col("pnl") / -F.col("worst__")
    twr = rows.groupBy(*keys, "f").agg(F.sum(F.when(hpr > 0, F.ln(hpr)).otherwise(-1e9)).alias("log_twr"))
    return twr.groupBy(*keys).agg(F.max_by("f", F.struct("log_twr", "f")).alias("f"), F.max("log_twr").alias("log_twr"))


def slippage(rows: DataFrame, symbol: str = "symbol", timeframe: str = "timeframe") -> DataFrame:
    """``slippage_pct``: half spread of the symbol plus impact of the timeframe; symbols in USDT or USD are crypto, others stocks."""
    s, t = F.col(symbol), F.col(timeframe)
    crypto = lookup(SPREAD_CRYPTO, s, USUAL_CRYPTO[0]) + lookup(IMPACT_CRYPTO, t, USUAL_CRYPTO[1])
    stock = lookup(SPREAD_STOCK, s, USUAL_STOCK[0]) + lookup(IMPACT_STOCK, t, USUAL_STOCK[1])
    return rows.withColumn("slippage_pct", F.round(F.when(s.endswith("USDT") | s.endswith("USD"), crypto).otherwise(stock), 4))


def slippage_stress(trades: DataFrame, *keys: str) -> DataFrame:
    """Sharpe a trade before and after costs, decay in percent, survival; needs slippage_pct."""
    cost = (F.col("entry_price") + F.col("exit_price")) * F.col("slippage_pct") / 100
    rows = trades.withColumn("net", F.col("pnl") - cost)
    out = rows.groupBy(*keys).agg(F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")).alias("before"), F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("after"))
    return out.withColumns({"decay_pct": F.try_divide(F.col("before") - F.col("after"), F.abs("before")) * 100, "survived": F.col("after") > 0})


def crisis_replay(rows: DataFrame) -> DataFrame:
    """Per (strategy_id, name): drawdown, least equity, return, bars from the trough to the old peak (null if never)."""
    w = Window.partitionBy("strategy_id", "name").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"peak": F.max("equity").over(run), "n": F.row_number().over(w)}).withColumn("dd", 1 - F.col("equity") / F.col("peak"))
    whole = Window.partitionBy("strategy_id", "name")
    rows = rows.withColumn("worst", F.max(F.struct("dd", -F.col("n"), "n", "peak")).over(whole))
    out = rows.groupBy("strategy_id", "name").agg(F.max("dd").alias("max_dd"), F.min("equity").alias("min_equity"), (F.max_by("equity", "t") / F.min_by("equity", "t") - 1).alias("ret"), F.min(F.when((F.col("n") > F.col("worst.n")) & (F.col("equity") >= F.col("worst.peak")), F.col("n") - F.col("worst.n"))).alias("recovery"))
    return out


def drawdown_gate(curves: DataFrame, most_dd_pct: float = 20.0, kill_dd_pct: float = 25.0, most_heat_pct: float = 10.0, most_gross: float = 2.0) -> DataFrame:
    """Whether a new risk is approved at each bar, and if not, by which limit: killed, drawdown, heat or gross.

    ``killed`` stays from the first drawdown of ``kill_dd_pct`` on. Heat is open plus proposed risk in percent
    of equity, gross open plus proposed notional by equity; columns open_risk, proposed_risk, gross and
    proposed_notional count as 0 where absent.
    """
    rows = drawdowns(curves)
    amount = lambda c: F.col(c) if c in curves.columns else F.lit(0.0)
    heat = (amount("open_risk") + amount("proposed_risk")) / F.col("equity") * 100
    gross = amount("gross") + amount("proposed_notional") / F.col("equity")
    rows = rows.withColumns({"killed": F.max(F.col("dd") * 100 >= kill_dd_pct).over(RUN()), "heat_pct": F.when(F.col("equity") > 0, heat), "new_gross": F.when(F.col("equity") > 0, gross)})
    why = F.when(F.col("killed"), "killed").when(F.col("dd") * 100 >= most_dd_pct, "drawdown").when(F.col("heat_pct") > most_heat_pct, "heat").when((amount("proposed_notional") > 0) & (F.col("new_gross") > most_gross), "gross").otherwise("approved")
    return rows.withColumn("reason", why).withColumn("approved", F.col("reason") == "approved")


# --- positions


def positions_consolidated(positions: DataFrame) -> DataFrame:
    """Net, gross, long and short quantity of each symbol and the strategies behind it."""
    q = F.col("quantity")
    return positions.groupBy("symbol").agg(F.sum(q).alias("net"), F.sum(F.abs(q)).alias("gross"), F.sum(F.when(q > 0, q).otherwise(0.0)).alias("long"), F.sum(F.when(q < 0, -q).otherwise(0.0)).alias("short"), F.array_join(F.array_sort(F.collect_set("strategy_id")), ",").alias("strategies"))


def mark_to_market(positions: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """Latest price on open positions: unrealised profit and equity of each strategy."""
    last = prices.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
    rows = positions.join(last, "symbol").withColumn("u", F.col("quantity") * (F.col("price") - F.col("entry_price")))
    return rows.groupBy("strategy_id").agg(F.sum("u").alias("unrealised"), (cash + F.sum("u")).alias("equity"))


def exposure(positions: DataFrame, *keys: str) -> DataFrame:
    """Open risk (2 % of notional without a stop), gross and net exposure, positions."""
    notional = F.col("quantity") * F.col("price")
    risk = F.coalesce(F.abs(F.col("quantity") * (F.col("price") - F.col("stop"))), F.abs(notional) * 0.02)
    return positions.groupBy(*keys).agg(F.sum(risk).alias("open_risk"), F.sum(F.abs(notional)).alias("gross"), F.sum(notional).alias("net"), F.count("*").alias("n_positions"))
