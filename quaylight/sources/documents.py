"""Backtest and live-session result documents: their schema and JSON source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import columns

PARAMETERS = "strategy_name string, capital bigint, data_type string, schema string, start bigint, end bigint, tickers strings"
STATIC_STATS = (
    "total_trades int, total_winning_trades int, total_losing_trades int, avg_profit bigint, avg_profit_percent bigint, avg_gain bigint,"
    " avg_gain_percent bigint, avg_loss bigint, avg_loss_percent bigint, profitability_ratio bigint, profit_factor bigint,"
    " profit_and_loss_ratio bigint, total_fees bigint, net_profit bigint, beginning_equity bigint, ending_equity bigint, total_return bigint,"
    " annualized_return bigint, daily_standard_deviation_percentage bigint, annual_standard_deviation_percentage bigint,"
    " max_drawdown_percentage_period bigint, max_drawdown_percentage_daily bigint, sharpe_ratio bigint, sortino_ratio bigint"
)
SERIES = "timestamp bigint, equity_value bigint, percent_drawdown bigint, cumulative_return bigint, period_return bigint"
TRADES = "trade_id int, signal_id int, timestamp bigint, ticker string, quantity bigint, avg_price bigint, trade_value bigint, trade_cost bigint, action string, fees bigint"
INSTRUCTION = "ticker string, order_type string, action string, signal_id int, weight bigint, quantity int, limit_price string, aux_price string"
_ACCOUNT = ["buying_power", "excess_liquidity", "full_available_funds", "full_init_margin_req", "full_maint_margin_req", "futures_pnl", "net_liquidation", "total_cash_balance", "unrealized_pnl"]
ACCOUNT = "currency string, " + ", ".join(f"{when}_timestamp bigint, " + ", ".join(f"{when}_{a} bigint" for a in _ACCOUNT) for when in ("start", "end"))


_SIGNAL = columns("timestamp bigint, trade_instructions instructions", instructions=T.ArrayType(columns(INSTRUCTION)))
_BODY = {"trades": T.ArrayType(columns(TRADES)), "signals": T.ArrayType(_SIGNAL)}
_META = columns("backtest_id int, backtest_name string, parameters parameters, static_stats stats", parameters=columns(PARAMETERS), stats=columns(STATIC_STATS))
BACKTEST = columns(
    "metadata meta, period_timeseries_stats series, daily_timeseries_stats series, trades trades, signals signals", meta=_META, series=T.ArrayType(columns(SERIES)), **_BODY
)
LIVE = columns("parameters parameters, account account, trades trades, signals signals", parameters=columns(PARAMETERS), account=columns(ACCOUNT), **_BODY)


def read_documents(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """JSON documents: one a file or a list of them, or with ``lines`` one a line, so that Spark can split large files.
    Fields that the schema does not name are not kept."""
    return spark.read.schema(BACKTEST if kind == "backtest" else LIVE).json(path, multiLine=not lines)
