"""Every query by name, with the SQL that must give the same rows where SQL can say it.

``spec`` lists the result columns and their rounding once for both sides; ``{cols}`` in the SQL
stands for it.
"""

import uuid

from pyspark.sql import functions as F

from barwise import constants as K
from barwise import schemas
from barwise.functions.expr import half_up, pick
from barwise.operators import (
    cleanse, correlation, features, layers, market, measures, portfolio, publish, quality, report, risk, scenario, signals,
)
from barwise.plans import oracle as O
from barwise.plans.frames import PROXY, Frames
from barwise.sources import derived, files
from barwise.streaming.incremental import load_new_bars

BUILDERS, SQL = {}, {}


def q(name, spec=None, sql=None, extra=None):
    def register(build):
        def run(spark, sf_dir):
            df = build(Frames(spark, sf_dir))
            return pick(df, spec) if spec else df

        run.__name__ = name
        BUILDERS[name] = run
        if sql:
            text = sql.replace("{cols}", O.select_list(spec)) if spec else sql
            SQL[name] = O.compose(text, extra)
        return build

    return register


BAR = "ticker, date, open, high, low, close, volume, sector"
FUND = ("ticker, sector, market_cap_category, exchange, country, beta:6, pe_ratio:6, pb_ratio:6, "
        "dividend_yield:6, roe:6, debt_to_equity:6")


# ---- sources and sinks -----------------------------------------------------------------------

@q("scan_bars", BAR, "SELECT {cols} FROM bars")
def _(t):
    return files.conform(t.bars, schemas.BARS)


def _folder(t, name):
    return f"{files.shared_folder(t.spark)}/{name}"


@q("scan_csv", BAR, "SELECT {cols} FROM bars")
def _(t):
    path = files.write_csv(t.bars, _folder(t, "csv"))
    return files.read_csv(t.spark, path, schemas.BARS)


@q("scan_partitioned", "ticker, date, close, volume, sector",
   "SELECT {cols} FROM bars WHERE sector IN ('ASIA', 'EUROPE')")
def _(t):
    path = files.write_parquet(t.bars, _folder(t, "bars"), ["sector"])
    return files.read_parquet(t.spark, path).filter(F.col("sector").isin("ASIA", "EUROPE"))


@q("write_read_bars", BAR, "SELECT {cols} FROM bars")
def _(t):
    path = files.write_parquet(t.bars, _folder(t, "bars"), ["sector"], files_per_partition=4)
    return files.read_parquet(t.spark, path, schemas.BARS)


@q("export_csv_roundtrip", "ticker, date, daily_return:4, sma_20:4, rsi_14:4, volume", """
SELECT ticker, date, ROUND(daily_return, 4) AS daily_return, ROUND(sma, 4) AS sma_20,
  ROUND(100 - 100 / (1 + gain / (loss + 1e-8)), 4) AS rsi_14, volume
FROM (SELECT *, """ + O.full("avg(close)", "close", 20) + """ AS sma,
  """ + O.full("avg(greatest(daily_return, 0.0))", "daily_return", 14) + """ AS gain,
  """ + O.full("avg(-least(daily_return, 0.0))", "daily_return", 14) + """ AS loss FROM ret) f""")
def _(t):
    df = layers.export_features(t.series)
    path = files.write_csv(df, _folder(t, "export"))
    return files.read_csv(t.spark, path, df.schema)


@q("fact_year_quarter", "ticker, date, close, market_scenario, signal_score:1, year, quarter",
   "SELECT {cols} FROM gold WHERE year = 1998 AND quarter = 2")
def _(t):
    path = files.write_parquet(t.layers["gold"], _folder(t, "fact"), ["year", "quarter"])
    return files.read_parquet(t.spark, path).filter("year = 1998 AND quarter = 2")


@q("wide_to_long", "ticker, date, open, high, low, close, volume:0", f"""
SELECT ticker, date, open, high, low, close, CAST(volume AS DOUBLE) AS volume
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY {O.BAR_ORDER}) AS n FROM raw_bars) r
WHERE n = 1 AND close IS NOT NULL""")
def _(t):
    # The vendor's wide layout of one download: every field of every ticker in a date's row.
    return cleanse.wide_to_long(cleanse.wide_bars(cleanse.dedup_bars(t.raw_bars)))


@q("scan_fundamentals", FUND, "SELECT {cols} FROM fund")
def _(t):
    path = files.write_parquet(t.fundamentals, _folder(t, "fundamentals"))
    return files.read_parquet(t.spark, path, schemas.FUNDAMENTALS)


UNIVERSE = "ticker, name, sector, sub_industry, weight_pct:6, beta:6, market_cap_cat"


@q("scan_universe", UNIVERSE, "SELECT {cols} FROM univ")
def _(t):
    path = files.write_csv(t.universe, _folder(t, "universe"))
    return files.read_csv(t.spark, path, schemas.UNIVERSE)


@q("stream_bars", BAR, "SELECT {cols} FROM bars")
def _(t):
    """Bars that arrive as files in two lots by date, the second with some dates of the first, loaded by the file stream."""
    source, target, state = (_folder(t, n) for n in ("arriving", "loaded", "state"))
    day = F.col("date")
    for lot in (t.bars.filter(day < "1996-01-01"), t.bars.filter(day >= "1995-12-01")):
        lot.write.mode("append").parquet(source)
        loaded = load_new_bars(t.spark, source, target, state)
    return loaded


@q("universe_filter", "ticker, name, sector, sub_industry, weight_pct:6, beta:6, market_cap_cat",
   "SELECT {cols} FROM univ WHERE sector IN ('ASIA', 'EUROPE', 'AFRICA')")
def _(t):
    return cleanse.universe_filter(t.raw_universe, ["ASIA", "EUROPE", "AFRICA"])


@q("universe_sector_summary", "sector, n_stocks, total_weight:6", """
SELECT sector, count(ticker) AS n_stocks, ROUND(sum(weight_pct), 6) AS total_weight FROM listing GROUP BY sector""")
def _(t):
    return cleanse.universe_sector_summary(t.raw_universe)


@q("list_sectors", None, "SELECT DISTINCT sector FROM fund")
def _(t):
    return market.list_sectors(t.fundamentals)


# ---- cleansing -------------------------------------------------------------------------------

def _history_sql(tol, before):
    keep = f"close IS NOT NULL AND {O.SANE.format(tol=tol)} AND date BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'"
    source = "good" if before else "SELECT * FROM one WHERE n = 1"
    count = f"(SELECT ticker FROM ({'SELECT * FROM good' if before else source}) c GROUP BY ticker HAVING count(*) >= 400)"
    return f"""WITH good AS (SELECT * FROM raw_bars WHERE {keep}),
one AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY {O.BAR_ORDER}) AS n FROM good)
SELECT {O.select_list(BAR)} FROM one WHERE n = 1 AND ticker IN {count}"""


def _nested(sql):
    """Compose a statement that already starts with WITH."""
    head = O.compose(sql)
    at = head.index("\nWITH ")
    return head[:at] + "," + head[at + 5:]


@q("cleanse_bars", BAR)
def _(t):
    return cleanse.cleanse_bars(t.raw_bars, 400, start="1995-06-01", end="2001-06-30")


SQL["cleanse_bars"] = _nested(_history_sql("1.0", True))


@q("cleanse_bars_tolerant", BAR)
def _(t):
    return cleanse.cleanse_bars(
        t.raw_bars, 400, low_tolerance=0.001, count_repeats=False,
        start="1995-06-01", end="2001-06-30",
    )


SQL["cleanse_bars_tolerant"] = _nested(_history_sql("0.999", False))


@q("min_history", BAR, """
SELECT {cols} FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 540)""")
def _(t):
    return cleanse.min_history(t.bars, 540)


@q("dedup_bars", BAR, f"""
SELECT {{cols}} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY {O.BAR_ORDER}) AS n
  FROM raw_bars) d WHERE n = 1""")
def _(t):
    return cleanse.dedup_bars(t.raw_bars)


@q("conform_bars", BAR, "SELECT {cols} FROM typed_bars")
def _(t):
    return cleanse.conform_bars(t.text_bars)


@q("bronze_bars", BAR + ", _source", f"SELECT {O.select_list(BAR)}, 'vendor' AS _source FROM bronze")
def _(t):
    return t.layers["bronze"]


def _fund_sql(pe):
    return f"""SELECT {O.select_list(FUND)} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY beta) AS n
  FROM (SELECT * EXCLUDE (pe_ratio, dividend_yield), CASE WHEN {pe} THEN NULL ELSE pe_ratio END AS pe_ratio,
    CASE WHEN dividend_yield < 0 THEN 0.0 ELSE dividend_yield END AS dividend_yield FROM raw_fund) f) d
WHERE n = 1"""


@q("cleanse_fundamentals", FUND, _fund_sql("pe_ratio > 200"))
def _(t):
    return cleanse.cleanse_fundamentals(t.raw_fundamentals)


@q("cleanse_fundamentals_nb", FUND, _fund_sql("pe_ratio > 200 OR pe_ratio < 0"))
def _(t):
    return cleanse.cleanse_fundamentals(t.raw_fundamentals, drop_negative_pe=True)


@q("enrich_fundamentals", "ticker, date, close, sector, beta:6, pe_ratio:6, dividend_yield:6, exchange", """
SELECT {cols} FROM (SELECT b.ticker, b.date, b.close, coalesce(f.sector, b.sector) AS sector, f.beta,
  f.pe_ratio, f.dividend_yield, f.exchange
  FROM bars b LEFT JOIN clean_fund f ON b.ticker = f.ticker) e""")
def _(t):
    return cleanse.enrich(t.bars, t.clean_fundamentals)


@q("missing_fundamentals", None, """
SELECT DISTINCT ticker FROM bars WHERE ticker NOT IN (SELECT ticker FROM raw_fund)""")
def _(t):
    return cleanse.missing_fundamentals(t.bars, t.raw_fundamentals)


@q("ingest_quality_report",
   "bar_rows, bar_tickers, fundamental_tickers, null_close_pct:6, tickers_missing_fundamentals, min_date, max_date", """
SELECT count(*) AS bar_rows, count(DISTINCT ticker) AS bar_tickers,
  (SELECT count(DISTINCT ticker) FROM raw_fund) AS fundamental_tickers,
  ROUND(count(*) FILTER (close IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_close_pct,
  (SELECT count(DISTINCT ticker) FROM raw_bars WHERE ticker NOT IN (SELECT ticker FROM raw_fund))
    AS tickers_missing_fundamentals,
  min(date) AS min_date, max(date) AS max_date FROM raw_bars""")
def _(t):
    return cleanse.ingest_report(t.raw_bars, t.raw_fundamentals, max_null_share=0.05)


@q("incremental_load", BAR, f"""
SELECT {{cols}} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY {O.BAR_ORDER}) AS n
  FROM (SELECT * FROM raw_bars WHERE sector <> 'ASIA'
    UNION ALL SELECT * FROM bars WHERE ticker NOT IN (SELECT ticker FROM raw_bars WHERE sector <> 'ASIA')) u) d
WHERE n = 1""")
def _(t):
    return cleanse.incremental_load(t.raw_bars.filter("sector <> 'ASIA'"), t.bars)


# ---- features --------------------------------------------------------------------------------

@q("returns", "ticker, date, close, prev_close, daily_return:6, log_return:6", "SELECT {cols} FROM ret")
def _(t):
    return t.returns


@q("moving_averages", "ticker, date, sma_20:2, sma_50:2, sma_200:2, ema_12:2, ema_26:2, macd:2",
   "SELECT {cols} FROM feat")
def _(t):
    return features.with_moving_averages(t.series)


@q("moving_averages_full", "ticker, date, sma_20:2, sma_50:2, sma_200:2",
   "SELECT ticker, date, " + ", ".join(
       f"ROUND({O.full('avg(close)', 'close', n)}, 2) AS sma_{n}" for n in (20, 50, 200)) + " FROM bars")
def _(t):
    return features.with_moving_averages(t.series, full=True)


@q("ema_exact", "ticker, date, ema_12:2, ema_26:2, macd:2, macd_signal:2", "SELECT {cols} FROM ema", extra={
    "numbered": "SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars",
    "ema": """
SELECT ticker, date, n, close AS ema_12, close AS ema_26, CAST(0 AS DOUBLE) AS macd, CAST(0 AS DOUBLE) AS macd_signal
FROM numbered WHERE n = 1
UNION ALL SELECT r.ticker, b.date, b.n, e.a, e.b, e.a - e.b, r.macd_signal * 8.0 / 10 + (e.a - e.b) * 2.0 / 10
FROM ema r JOIN numbered b ON r.ticker = b.ticker AND b.n = r.n + 1,
LATERAL (SELECT r.ema_12 * 11.0 / 13 + b.close * 2.0 / 13 AS a, r.ema_26 * 25.0 / 27 + b.close * 2.0 / 27 AS b) e"""})
def _(t):
    return features.ema_exact(t.series)


@q("bollinger", "ticker, date, bb_mid:2, bb_std:2, bb_upper:2, bb_lower:2, bb_position:4", "SELECT {cols} FROM feat")
def _(t):
    return features.with_bollinger(t.series)


@q("rsi", "ticker, date, rsi_14:4", "SELECT {cols} FROM feat")
def _(t):
    return features.with_rsi(t.series)


@q("momentum", "ticker, date, roc_20:6, roc_60:6, roc_252:6, momentum_zscore:4", "SELECT {cols} FROM feat")
def _(t):
    return features.with_momentum(t.series)


@q("volatility", "ticker, date, vol_20d:6, vol_60d:6", "SELECT {cols} FROM feat")
def _(t):
    return features.with_volatility(t.series)


@q("atr", "ticker, date, true_range, atr_14:2", "SELECT {cols} FROM feat")
def _(t):
    return features.with_atr(t.series)


@q("volume_features", "ticker, date, avg_vol_20d:4, volume_ratio:6, obv",
   "SELECT ticker, date, ROUND(avg_vol_20d, 4) AS avg_vol_20d, ROUND(volume_ratio, 6) AS volume_ratio, "
   "CAST(obv AS BIGINT) AS obv FROM feat")
def _(t):
    return features.with_volume_features(t.series)


@q("cumulative", "ticker, date, cum_return:6, cum_max_return:6, drawdown:6", "SELECT {cols} FROM feat")
def _(t):
    return features.with_cumulative(t.series)


@q("drawdown_mult", "ticker, date, growth:4, drawdown:6", f"""
SELECT {{cols}} FROM (SELECT ticker, date, growth,
  (growth - max(growth) OVER {O.RUN}) / max(growth) OVER {O.RUN} AS drawdown
  FROM (SELECT ticker, date, product(1 + daily_return) OVER {O.RUN} AS growth FROM ret) g) d""")
def _(t):
    return features.with_growth_drawdown(t.series)


@q("rolling_beta", "ticker, date, rolling_beta_252:4", f"""
SELECT ticker, date, ROUND(covar_pop(daily_return, m) OVER {O.rows(252)}
  / (var_pop(m) OVER {O.rows(252)} + 1e-8), 4) AS rolling_beta_252
FROM (SELECT r.ticker, r.date, r.daily_return, p.daily_return AS m
  FROM ret r LEFT JOIN (SELECT * FROM ret WHERE ticker = '{PROXY}') p ON r.date = p.date) j""")
def _(t):
    return features.with_rolling_beta(t.series, PROXY, proxy_bars=t.proxy_bars)


@q("rolling_beta_sample", "ticker, date, rolling_beta:4", f"""
SELECT ticker, date, ROUND(CASE WHEN count(daily_return * m) OVER {O.rows(252)} = 252 THEN
  covar_samp(daily_return, m) OVER {O.rows(252)} / NULLIF(var_samp(m) OVER {O.rows(252)}, 0) END, 4) AS rolling_beta
FROM (SELECT r.ticker, r.date, r.daily_return, mkt.mkt_return AS m FROM ret r LEFT JOIN mkt ON r.date = mkt.date) j""")
def _(t):
    return features.with_rolling_beta_sample(t.returns, t.market_returns)


def _full_stat(expr, n):
    return O.full(expr, "daily_return", n)


@q("rolling_sharpe", "ticker, date, rolling_sharpe:6", f"""
SELECT ticker, date, ROUND(({_full_stat("avg(daily_return)", 252)} * 252 - 0.05)
  / NULLIF({_full_stat("stddev_samp(daily_return)", 252)} * {O.ANN}, 0), 6) AS rolling_sharpe FROM ret""")
def _(t):
    return features.with_rolling_sharpe(t.returns)


@q("rolling_var", "ticker, date, rolling_var:6", f"""
SELECT ticker, date, ROUND({_full_stat("avg(daily_return)", 60)}
  - 1.6449 * {_full_stat("stddev_samp(daily_return)", 60)}, 6) AS rolling_var FROM ret""")
def _(t):
    return features.with_rolling_var(t.returns)


FEATURES = ("ticker, date, open, high, low, close, volume, sector, daily_return:6, log_return:6, "
            "sma_20:2, sma_50:2, sma_200:2, ema_12:2, ema_26:2, macd:2, bb_mid:2, bb_upper:2, bb_lower:2, "
            "bb_position:4, rsi_14:4, roc_20:6, roc_60:6, roc_252:6, momentum_zscore:4, vol_20d:6, "
            "vol_60d:6, true_range, atr_14:2, avg_vol_20d:4, volume_ratio:6, cum_return:6, "
            "cum_max_return:6, drawdown:6")


@q("feature_set", FEATURES + ", rolling_beta_252:4", f"""
SELECT {O.select_list(FEATURES)}, ROUND(b, 4) AS rolling_beta_252
FROM (SELECT feat.*, covar_pop(daily_return, m) OVER {O.rows(252)} / (var_pop(m) OVER {O.rows(252)} + 1e-8) AS b
  FROM feat LEFT JOIN (SELECT date AS d, daily_return AS m FROM ret WHERE ticker = '{PROXY}') p
  ON feat.date = p.d) f""")
def _(t):
    return features.feature_set(t.series, proxy=PROXY, proxy_bars=t.proxy_bars)


@q("feature_table_nb", "ticker, date, close, daily_return:6, sma_20:2, sma_200:2, bb_position:4, rsi_14:4, "
   "roc_252:6, momentum_zscore:4, vol_20d:6, atr_14:2, cum_return:6, drawdown:6, sector, beta:6, pe_ratio:6, roe:6",
   "SELECT {cols} FROM eq_feat")
def _(t):
    return t.equity_features


@q("signal_labels", "ticker, date, sma_50:2, sma_200:2, rsi_14:4, ma_signal, rsi_signal", "SELECT {cols} FROM eq_feat")
def _(t):
    return t.equity_features


@q("rolling_risk_metrics", "ticker, date, daily_return:6, vol_20d:6, vol_60d:6, rsi_14:4, roc_20:6, "
   "momentum_zscore:4, sma_50:2, sma_200:2, ma_signal, rsi_signal",
   "SELECT {cols} FROM eq_feat WHERE date >= (SELECT max(date) - 252 FROM eq_feat)")
def _(t):
    return market.since(t.equity_features, 252)


@q("silver_cleanse", "ticker, date, open, high, low, close, volume, daily_return:6, log_return:6, is_outlier",
   "SELECT {cols} FROM silver")
def _(t):
    return t.layers["silver"]


@q("silver_features", "ticker, date, close, sma_20:2, sma_50:2, sma_200:2, rsi_14:2, vol_20d:6, vol_60d:6, "
   "roc_20:6, roc_252:6, bb_upper:2, bb_lower:2, bb_pct:4, drawdown:6", "SELECT {cols} FROM silver_feat")
def _(t):
    return t.layers["features"]


@q("export_features", "ticker, date, close, daily_return:4, sma_20:4, sma_50:4, sma_200:4, rsi_14:4, vol_20d:4, drawdown_pct:4",
   f"""SELECT {{cols}} FROM (SELECT ticker, date, ROUND(CAST(CAST(close AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS close, ROUND(daily_return, 4) AS daily_return,
  ROUND(sma_20, 4) AS sma_20, ROUND(sma_50, 4) AS sma_50, ROUND(sma_200, 4) AS sma_200,
  ROUND(100 - 100 / (1 + gain / (loss + 1e-8)), 4) AS rsi_14, ROUND(vol_20d, 4) AS vol_20d,
  ROUND((growth - max(growth) OVER {O.RUN}) / max(growth) OVER {O.RUN} * 100, 4) AS drawdown_pct
  FROM (SELECT *, {", ".join(O.full("avg(close)", "close", n) + f" AS sma_{n}" for n in (20, 50, 200))},
    {O.full("avg(greatest(daily_return, 0.0))", "daily_return", 14)} AS gain,
    {O.full("avg(-least(daily_return, 0.0))", "daily_return", 14)} AS loss,
    {O.full("stddev_samp(daily_return)", "daily_return", 20)} * {O.ANN} AS vol_20d,
    product(1 + daily_return) OVER {O.RUN} AS growth FROM ret) f) e""")
def _(t):
    return layers.export_features(t.series)


@q("export_fundamentals", "ticker, sector, beta:6, pe_ratio:6, dividend_yield:6, roe:6, debt_to_equity:6",
   "SELECT {cols} FROM fund")
def _(t):
    return layers.export_fundamentals(t.fundamentals)


# ---- sector, ranking, breadth ----------------------------------------------------------------

@q("sector_performance", None, f"""
SELECT f.sector, count(DISTINCT r.ticker) AS n_equities,
  ROUND(avg(daily_return) * 252, 4) AS annualised_avg_return,
  ROUND(stddev_samp(daily_return) * {O.ANN}, 4) AS annualised_volatility,
  ROUND((avg(daily_return) * 252 - 0.05) / NULLIF(stddev_samp(daily_return) * {O.ANN}, 0), 4) AS sharpe_ratio,
  ROUND(avg(beta), 3) AS avg_beta, ROUND(avg(pe_ratio), 2) AS avg_pe,
  ROUND(count(*) FILTER (daily_return > 0) / CAST(count(daily_return) AS DOUBLE), 4) AS win_rate
FROM ret r JOIN clean_fund f ON r.ticker = f.ticker
WHERE date >= (SELECT d - 252 FROM last_day) GROUP BY f.sector""")
def _(t):
    return market.sector_performance(t.returns, t.clean_fundamentals)


@q("sector_performance_features", None, "SELECT * FROM sector_perf")
def _(t):
    return market.sector_performance_features(t.equity_features)


@q("sector_summary_1y", None, f"""
SELECT sector, count(DISTINCT ticker) AS n_equities, ROUND(avg(daily_return) * 252, 4) AS avg_return_1y,
  ROUND(stddev_samp(daily_return) * {O.ANN}, 4) AS volatility,
  ROUND(count(*) FILTER (daily_return > 0) / CAST(count(*) AS DOUBLE), 4) AS win_rate,
  ROUND((avg(daily_return) * 252 - 0.05) / NULLIF(stddev_samp(daily_return) * {O.ANN}, 0), 4) AS sharpe
FROM ret WHERE date >= (SELECT d - INTERVAL 12 MONTH FROM last_day) GROUP BY sector""")
def _(t):
    return market.sector_summary_1y(t.returns)


@q("top_performers", "ticker, sector, market_cap_category, exchange, latest_close, return_1y:4, beta:6, pe_ratio:6, dividend_yield:6", """
SELECT p.ticker, f.sector, market_cap_category, exchange, latest_close,
  ROUND((latest_close - close_1y) / NULLIF(close_1y, 0), 4) AS return_1y, ROUND(beta, 6) AS beta,
  ROUND(pe_ratio, 6) AS pe_ratio, ROUND(dividend_yield, 6) AS dividend_yield
FROM (SELECT ticker, arg_max(close, date) AS latest_close,
    arg_min(close, date) FILTER (date >= (SELECT d - 252 FROM last_day)) AS close_1y
  FROM bars GROUP BY ticker) p JOIN clean_fund f ON p.ticker = f.ticker
WHERE close_1y IS NOT NULL ORDER BY return_1y DESC NULLS LAST, p.ticker LIMIT 50""")
def _(t):
    return market.top_performers(t.bars, t.clean_fundamentals)


@q("equity_rankings", None, "SELECT * FROM ranks")
def _(t):
    return t.rankings


@q("top_bottom", None, """
(SELECT *, 'top' AS side FROM ranks ORDER BY return_1y DESC, ticker LIMIT 20)
UNION ALL (SELECT *, 'bottom' AS side FROM ranks ORDER BY return_1y, ticker LIMIT 20)""")
def _(t):
    return market.top_bottom(t.rankings)


SCREEN = ("ticker, sector, market_cap_category, exchange, country, beta:6, pe_ratio:6, close, "
          "return_1d:6, return_1y:6, vol_20d:6, rsi_14:4, momentum_zscore:4, total")


@q("screener", SCREEN, """
SELECT {cols} FROM (SELECT *, count(*) OVER () AS total FROM snapshot
  WHERE sector IN ('ASIA', 'EUROPE', 'AMERICA') AND exchange IN ('NYSE', 'NASDAQ')
    AND beta >= 0.6 AND beta <= 1.7 AND pe_ratio >= 5 AND pe_ratio <= 190 AND return_1y >= -0.9) s
ORDER BY return_1y DESC NULLS LAST, ticker LIMIT 20 OFFSET 5""")
def _(t):
    return market.screener(
        market.equity_snapshot(t.features, t.clean_fundamentals),
        sectors=["ASIA", "EUROPE", "AMERICA"], exchanges=["NYSE", "NASDAQ"], min_beta=0.6, max_beta=1.7,
        min_pe=5, max_pe=190, min_return=-0.9, limit=20, offset=5,
    )


@q("equity_history", "ticker, date, bar_no, close, log_return:6", """
SELECT {cols} FROM (SELECT ticker, date, close, log_return,
  CAST(row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS INTEGER) AS bar_no FROM ret) h
WHERE bar_no <= 252""")
def _(t):
    return market.equity_history(t.returns)


@q("equity_detail", None, """
SELECT f.ticker, f.sector, h.n_bars, h.history FROM clean_fund f JOIN (
  SELECT ticker, count(*) AS n_bars, string_agg(strftime(date, '%Y-%m-%d') || ' ' || printf('%.2f', ROUND(CAST(CAST(close AS VARCHAR) AS DECIMAL(38, 18)), 2)::DOUBLE) || ' '
    || coalesce(printf('%.6f', ROUND(CAST(CAST(log_return AS VARCHAR) AS DECIMAL(38, 18)), 6)::DOUBLE), '-'), ';' ORDER BY date) AS history
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM ret) x WHERE n <= 252 GROUP BY ticker) h
ON f.ticker = h.ticker""")
def _(t):
    """The nested history is compared as text."""
    bar = lambda h: F.concat_ws(" ", h["date"].cast("string"), F.format_string("%.2f", h["close"]),
                                F.when(h["return"].isNull(), "-").otherwise(F.format_string("%.6f", h["return"])))
    return market.equity_detail(t.returns, t.clean_fundamentals).select(
        "ticker", "sector", F.size("history").cast("long").alias("n_bars"), F.array_join(F.transform("history", bar), ";").alias("history"))


@q("volatility_regime", "date, cross_sectional_vol:6, rolling_20d_vol:6, vol_regime", """
SELECT {cols} FROM (SELECT *, avg(cross_sectional_vol) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling_20d_vol,
  CASE WHEN cross_sectional_vol > 0.35 THEN 'High Volatility' WHEN cross_sectional_vol >= 0.20 THEN 'Normal'
    ELSE 'Low Volatility' END AS vol_regime
  FROM (SELECT date, stddev_samp(daily_return) * sqrt(252.0) AS cross_sectional_vol FROM ret
    WHERE daily_return IS NOT NULL GROUP BY date) d) r""")
def _(t):
    return market.volatility_regime(t.returns)


@q("volatility_regime_nb", "date, cross_sectional_vol:4, rolling_20d_vol:8, vol_regime", """
SELECT {cols} FROM (SELECT *, avg(cross_sectional_vol) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling_20d_vol,
  CASE WHEN cross_sectional_vol > 0.35 THEN 'High Volatility' WHEN cross_sectional_vol > 0.20 THEN 'Normal'
    ELSE 'Low Volatility' END AS vol_regime
  FROM (SELECT date, ROUND(stddev_samp(daily_return) * sqrt(252.0), 4) AS cross_sectional_vol FROM ret_only
    GROUP BY date) d) r""")
def _(t):
    return market.volatility_regime(t.returns, inclusive=False, digits=4)


BREADTH_SQL = """
SELECT date, count(DISTINCT ticker) AS total_tickers, count(*) FILTER (close > sma_50) AS above_sma50,
  count(*) FILTER (close > sma_200) AS above_sma200, count(*) FILTER (rsi_14 > 70) AS overbought,
  count(*) FILTER (rsi_14 < 30) AS oversold,
  ROUND(count(*) FILTER (close > sma_50) / CAST(count(DISTINCT ticker) AS DOUBLE), 4) AS breadth_pct
FROM eq_feat WHERE date >= (SELECT max(date) - 252 FROM eq_feat) AND sma_50 IS NOT NULL GROUP BY date"""


@q("market_breadth", None, BREADTH_SQL)
def _(t):
    return market.market_breadth(t.equity_features)


@q("breadth_latest", None, BREADTH_SQL + " ORDER BY date DESC LIMIT 20")
def _(t):
    return market.latest_rows(market.market_breadth(t.equity_features), 20)


@q("correlation_pairs", "ticker_a, ticker_b, n_common, correlation:4", """
SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, count(*) AS n_common,
  ROUND(corr(a.daily_return, b.daily_return), 4) AS correlation
FROM recent a JOIN recent b ON a.date = b.date AND a.ticker < b.ticker
GROUP BY a.ticker, b.ticker HAVING count(*) >= 5""",
   extra={"recent": "SELECT * FROM ret_only WHERE date >= (SELECT max(date) - 252 FROM ret)"})
def _(t):
    # The given bars are sparse: a pair shares some ten of the look-back's days, so fewer are asked for than by default.
    recent = files.stored(market.since(t.returns, 252).select("ticker", "date", "daily_return"))
    return correlation.pairwise_correlation(recent, min_common=5)


@q("sector_correlation", "sector_a, sector_b, n_common, correlation:6", """
SELECT a.sector AS sector_a, b.sector AS sector_b, count(*) AS n_common, ROUND(corr(a.r, b.r), 6) AS correlation
FROM sector_days a JOIN sector_days b ON a.date = b.date AND a.sector < b.sector GROUP BY a.sector, b.sector HAVING count(*) >= 2""",
   extra={"sector_days": "SELECT sector, date, avg(daily_return) AS r FROM ret_only GROUP BY sector, date"})
def _(t):
    return correlation.sector_correlation(t.returns)


@q("sharpe_contribution", None, """
SELECT s.sector, n_equities, ann_avg_return, ann_volatility, sharpe_ratio, ROUND(w, 4) AS portfolio_weight,
  ROUND(sharpe_ratio * w, 4) AS sharpe_contribution
FROM sector_perf s JOIN (SELECT sector, count(DISTINCT ticker) / CAST(sum(count(DISTINCT ticker)) OVER () AS DOUBLE) AS w
  FROM capture GROUP BY sector) c ON s.sector = c.sector""")
def _(t):
    return market.sharpe_contribution(
        market.sector_performance_features(t.equity_features),
        scenario.capture_ratios(t.latest_betas, epsilon=1e-6, round_ratio=True),
    )


@q("portfolio_attribution", None, f"""
SELECT sector, count(*) AS n_stocks, {O.tie("avg(w)", 6)} AS avg_weight, {O.tie("sum(w)", 4)} AS total_weight,
  {O.tie("sum(return_1y * w)", 4)} AS return_contribution, {O.tie("avg(return_1y)", 4)} AS avg_sector_return,
  {O.tie("avg(vol_20d)", 4)} AS avg_vol, {O.tie("avg(beta)", 3)} AS avg_beta
FROM (SELECT *, CAST(1.0 AS DOUBLE) / count(*) OVER () AS w FROM ranks) r GROUP BY sector""")
def _(t):
    return market.portfolio_attribution(t.rankings)


@q("portfolio_return_eq", None, f"""
SELECT ROUND(sum(return_1y) / count(*), 3) AS eq_weight_portfolio_return FROM ranks""")
def _(t):
    return market.portfolio_return_eq(t.rankings, digits=3)


@q("weekly_close", "ticker, week, close", """
SELECT ticker, week, arg_max(close, date) AS close
FROM (SELECT *, CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week FROM bars) b GROUP BY ticker, week""")
def _(t):
    return market.weekly_close(t.bars)


@q("weekly_sector_return", "sector, week, avg_return:6", """
SELECT sector, week, ROUND(avg(daily_return), 6) AS avg_return
FROM (SELECT *, CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week FROM ret) b GROUP BY sector, week""")
def _(t):
    return market.weekly_sector_return(t.returns)


WEEK = "CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE)"


@q("weekly_close_arrays", None, f"""
SELECT ticker, string_agg(strftime(week, '%Y-%m-%d'), ',' ORDER BY week) AS weeks, string_agg(printf('%.4f', ROUND(CAST(CAST(close AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE), ',' ORDER BY week) AS closes
FROM (SELECT ticker, week, arg_max(close, date) AS close FROM (SELECT *, {WEEK} AS week FROM bars) b GROUP BY ticker, week) w GROUP BY ticker""")
def _(t):
    return _joined(market.weekly_close_arrays(t.bars), "ticker", "closes", "%.4f")


@q("weekly_sector_arrays", None, f"""
SELECT sector, string_agg(strftime(week, '%Y-%m-%d'), ',' ORDER BY week) AS weeks,
  string_agg(coalesce(printf('%.4f', ROUND(avg_return, 4)), '-'), ',' ORDER BY week) AS returns
FROM (SELECT sector, week, avg(daily_return) AS avg_return FROM (SELECT *, {WEEK} AS week FROM ret) b GROUP BY sector, week) w GROUP BY sector""")
def _(t):
    return _joined(market.weekly_sector_arrays(t.returns), "sector", "returns", "%.4f")


def _joined(df, key, values, pattern):
    """Parallel lists as text."""
    show = lambda v: F.when(v.isNull(), "-").otherwise(F.format_string(pattern, half_up(v, 4)))
    return df.select(key, F.array_join(F.transform("weeks", lambda w: w.cast("string")), ",").alias("weeks"),
                     F.array_join(F.transform(values, show), ",").alias(values))


@q("returns_pivot", None, "SELECT date, ticker, ROUND(daily_return, 6) AS daily_return FROM ret_only")
def _(t):
    """Dates by every ticker; told row by row."""
    long = cleanse.returns_wide(t.returns).select("date", F.explode("returns").alias("ticker", "daily_return"))
    return long.select("date", "ticker", half_up("daily_return", 6).alias("daily_return"))


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


@q("monthly_heatmap", "sector, " + ", ".join(f"{m}:4" for m in MONTHS), "SELECT sector, " + ", ".join(
    f"ROUND(avg(r) FILTER (m = {i + 1}), 4) AS {m}" for i, m in enumerate(MONTHS)) + """
FROM (SELECT ticker, sector, month(date) AS m, product(1 + daily_return) - 1 AS r FROM ret_only
  GROUP BY ticker, sector, year(date), month(date)) x GROUP BY sector""")
def _(t):
    return market.monthly_heatmap(t.returns)


@q("market_index", "date, n_tickers, index_return:6, cum_log_return:6, drawdown:6", """
SELECT {cols} FROM (SELECT *, exp(cum_log_return - max(cum_log_return) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS drawdown
  FROM (SELECT *, sum(ln(1 + index_return)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_log_return
    FROM (SELECT date, count(*) AS n_tickers, avg(daily_return) AS index_return FROM ret_only GROUP BY date) d) c) x""")
def _(t):
    return market.market_index(t.returns)


@q("beta_histogram", "bin, bin_start:6, n", """
SELECT CAST(b AS BIGINT) AS bin, ROUND(0.5 + (b - 1) * 0.125, 6) AS bin_start, count(*) AS n
FROM (SELECT CASE WHEN beta < 0.5 THEN 0 WHEN beta >= 1.5 THEN 9 ELSE floor((beta - 0.5) / 0.125) + 1 END AS b FROM fund) f
GROUP BY b""")
def _(t):
    return market.histogram(t.fundamentals, "beta", 0.5, 1.5, 8)


@q("return_histogram", "bin, bin_start:6, n", """
SELECT CAST(b AS BIGINT) AS bin, ROUND(-1.0 + (b - 1) * 0.125, 6) AS bin_start, count(*) AS n
FROM (SELECT CASE WHEN daily_return < -1 THEN 0 WHEN daily_return >= 1 THEN 17
  ELSE floor((daily_return + 1) / 0.125) + 1 END AS b FROM ret_only) f GROUP BY b""")
def _(t):
    return market.histogram(t.returns, "daily_return", -1.0, 1.0, 16)


@q("date_dimension", None, """
SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(month(date) AS INTEGER) AS month_num, strftime(date, '%b') AS month_name,
  CAST(weekofyear(date) AS INTEGER) AS week, strftime(date, '%a') AS day_of_week,
  CAST(1 AS INTEGER) AS is_trading_day
FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY)) AS DATE) AS date) s
WHERE isodow(date) <= 5""")
def _(t):
    return market.calendar(t.bars)


@q("trading_days_ago", None, """
SELECT min(date) AS date FROM (SELECT date FROM (
  SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY)) AS DATE) AS date) s
  WHERE isodow(date) <= 5 ORDER BY date DESC LIMIT 252) x""")
def _(t):
    return market.trading_days_ago(market.calendar(t.bars), 252)


# ---- risk and portfolios ---------------------------------------------------------------------

def _weights(t):
    """A portfolio over the whole universe by listed weight, and a ticker that nobody knows."""
    ghost = t.spark.createDataFrame([("GHOST", 0.4)], "ticker string, weight double")
    return t.universe.select("ticker", F.col("weight_pct").alias("weight")).unionByName(ghost)


@q("risk_metrics", None, O.risk_sql("(SELECT ticker, date, daily_return AS r FROM ret)", "ticker"))
def _(t):
    return risk.risk_metrics(t.returns)


# A shared calendar for portfolios: each ticker's daily returns compounded by month, twelve of which make a year. The SQL
# is written from the definition: known weights scaled to 1, dates without a gap, weighted sum, then the metrics.
PORTFOLIO_MONTHS = {
    "monthly": """SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, product(1 + daily_return) - 1 AS r
FROM ret_only GROUP BY ticker, date_trunc('month', date)""",
    "stake": """SELECT ticker, weight_pct / sum(weight_pct) OVER () AS weight
FROM univ WHERE ticker IN (SELECT DISTINCT ticker FROM ret_only)""",
    "held": """SELECT 'portfolio' AS portfolio, date, sum(weight * r) AS r
FROM monthly JOIN stake USING (ticker) GROUP BY date HAVING count(*) = (SELECT count(*) FROM stake)""",
    "port": O.risk_sql("held", "portfolio", 12),
    "mkt": "SELECT date, avg(r) AS mkt_return FROM monthly GROUP BY date",
}
# Two tickers that share trading days, by their daily returns; the third does not exist.
PAIR = {"S00001": 3.0, "S00002": 1.0, "GHOST": 2.0}
PORTFOLIO_DAYS = {
    "stake": "SELECT * FROM (VALUES ('S00001', 0.75::DOUBLE), ('S00002', 0.25::DOUBLE)) AS w(ticker, weight)",
    "held": """SELECT 'portfolio' AS portfolio, date, sum(weight * daily_return) AS r
FROM ret_only JOIN stake USING (ticker) GROUP BY date HAVING count(*) = 2""",
    "port": O.risk_sql("held", "portfolio"),
    "mkt": "SELECT date, avg(daily_return) AS mkt_return FROM ret_only GROUP BY date",
}


def _told(c):
    """Compounded figures span many powers of ten: below a million six decimals are compared, above it nine digits. A missing
    one stays null, where ``format_string`` would spell it."""
    return F.when(F.abs(c) < 1e6, F.format_string("%.6f", c)).when(F.col(c).isNotNull(), F.format_string("%.8e", c)).alias(c)


def _told_sql(c):
    return f"CASE WHEN abs({c}) < 1e6 THEN printf('%.6f', {c} + 0.0) ELSE printf('%.8e', {c}) END AS {c}"


def _digits(df, names):
    return df.select("portfolio", *[_told(c) for c in names],
                     F.format_string("%.4f", F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, w: a + w * w)).alias("concentration"),
                     F.size("weights").alias("n_held"))


def _digits_sql(names):
    return "portfolio, " + ", ".join(_told_sql(c) for c in names) + (
        ", (SELECT printf('%.4f', sum(weight * weight)) FROM stake) AS concentration"
        ", (SELECT CAST(count(*) AS INTEGER) FROM stake) AS n_held")


def _against_sql(periods):
    """Beta and what follows from it on the dates that the benchmark has."""
    return f"""
SELECT {_digits_sql([*portfolio.LONG_RUN, *portfolio.AGAINST])} FROM (SELECT port.*, ROUND(b, 4) AS beta,
  ROUND(ann - (0.05 + b * (bm - 0.05)), 4) AS alpha, ROUND((ann - 0.05) / NULLIF(b, 0), 4) AS treynor_ratio,
  ROUND(CASE WHEN te > 0 THEN (ann - bm) / te END, 4) AS information_ratio
FROM port CROSS JOIN (SELECT covar_samp(r, mkt_return) / var_samp(mkt_return) AS b, avg(mkt_return) * {periods} AS bm,
    stddev_samp(r - mkt_return) * sqrt({periods}.0) AS te FROM held JOIN mkt ON held.date = mkt.date) x
CROSS JOIN (SELECT pow(product(1 + r), 1 / greatest(count(*) / {periods}.0, 1.0)) - 1 AS ann FROM held) y) z"""


@q("portfolio_metrics", None, f"SELECT {_digits_sql(portfolio.LONG_RUN)} FROM port", PORTFOLIO_MONTHS)
def _(t):
    return _digits(portfolio.metrics(t.monthly_returns, _weights(t), periods=12), portfolio.LONG_RUN)


@q("portfolio_vs_benchmark", None, _against_sql(12), PORTFOLIO_MONTHS)
def _(t):
    benchmark = features.market_returns(t.monthly_returns)
    found = portfolio.metrics(t.monthly_returns, _weights(t), benchmark=benchmark, periods=12)
    return _digits(found, [*portfolio.LONG_RUN, *portfolio.AGAINST])


@q("portfolio_daily", None, _against_sql(252), PORTFOLIO_DAYS)
def _(t):
    """A holding that shares trading days, on these days alone."""
    weights = t.spark.createDataFrame(list(PAIR.items()), "ticker string, weight double")
    found = portfolio.metrics(t.stored_returns, weights, benchmark=features.market_returns(t.stored_returns.filter("daily_return IS NOT NULL")))
    return _digits(found, [*portfolio.LONG_RUN, *portfolio.AGAINST])


BUNDLE = portfolio.LONG_RUN + "win_rate best_day worst_day skewness kurtosis".split()


@q("portfolio_risk_bundle", None, "SELECT b.ticker, " + ", ".join(_told_sql(c) for c in BUNDLE) + """,
  ROUND(coalesce(weight, 1.0), 6) AS weight
FROM (SELECT * FROM one_by_one UNION ALL SELECT * FROM port) b LEFT JOIN stake ON b.ticker = stake.ticker""", {
    **PORTFOLIO_MONTHS,
    "one_by_one": O.risk_sql("(SELECT ticker, date, daily_return AS r FROM ret_only WHERE ticker IN (SELECT ticker FROM stake))", "ticker"),
    "port": O.risk_sql("(SELECT 'PORTFOLIO' AS ticker, date, r FROM held)", "ticker", 12)})
def _(t):
    path = portfolio.series(portfolio.holding(t.monthly_returns, _weights(t)))
    found = portfolio.bundle(t.stored_returns, _weights(t), path, path_periods=12)
    return found.select("ticker", *[_told(c) for c in BUNDLE], half_up("weight", 6).alias("weight"))


@q("sector_var", "sector, var_90:6, var_95:6, var_99:6, cvar_90:6", """
SELECT r.sector, ROUND(any_value(v90), 6) AS var_90, ROUND(any_value(v95), 6) AS var_95, ROUND(any_value(v99), 6) AS var_99,
  ROUND(avg(daily_return) FILTER (daily_return <= v90), 6) AS cvar_90
FROM ret_only r JOIN (SELECT sector, quantile_cont(daily_return, 0.10) AS v90, quantile_cont(daily_return, 0.05) AS v95,
  quantile_cont(daily_return, 0.01) AS v99 FROM ret_only GROUP BY sector) v ON r.sector = v.sector GROUP BY r.sector""")
def _(t):
    return risk.tail_risk(t.returns, ["sector"], levels=(0.90, 0.95, 0.99))


# ---- scenarios and regimes -------------------------------------------------------------------

@q("scenario_returns_long", None, """
SELECT ticker, sector, scenario_name, mkt_return_shock, vol_multiplier,
  ROUND(CAST(CAST(0.05 + b * (mkt_return_shock - 0.05) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS ticker_return,
  ROUND(b, 3) AS beta
FROM (SELECT ticker, sector, coalesce(NULLIF(beta, 0), 1.0) AS b FROM univ) f CROSS JOIN scen""")
def _(t):
    return scenario.scenario_returns(t.universe)


CAPTURE = ("ticker, sector, beta:6, return_bull:4, return_base:4, return_bear:4, upside_capture:4, "
           "downside_capture:4, capture_ratio:4")


@q("scenario_capture_nb", CAPTURE, "SELECT {cols} FROM capture")
def _(t):
    return scenario.capture_ratios(t.latest_betas, epsilon=1e-6, round_ratio=True)


@q("capture_ratios", CAPTURE, """
SELECT {cols} FROM (SELECT *, upside_capture / NULLIF(abs(downside_capture), 0) AS capture_ratio FROM (
  SELECT ticker, sector, beta, ROUND(CAST(CAST(0.05 + beta * (CAST(0.25 AS DOUBLE) - 0.05) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS return_bull,
    ROUND(CAST(CAST(0.05 + beta * (CAST(0.08 AS DOUBLE) - 0.05) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS return_base,
    ROUND(CAST(CAST(0.05 + beta * (CAST(-0.30 AS DOUBLE) - 0.05) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS return_bear,
    ROUND((0.05 + beta * (CAST(0.25 AS DOUBLE) - 0.05)) / 0.25, 4) AS upside_capture,
    ROUND((0.05 + beta * (CAST(-0.30 AS DOUBLE) - 0.05)) / -0.30, 4) AS downside_capture
  FROM fund WHERE beta IS NOT NULL) c) d""")
def _(t):
    return scenario.capture_ratios(t.fundamentals)


@q("sector_scenario_avg", None, f"""
SELECT sector, count(DISTINCT ticker) AS n_equities, ROUND(avg(return_bull), 3) AS avg_bull_return,
  ROUND(avg(return_base), 3) AS avg_base_return, ROUND(avg(return_bear), 3) AS avg_bear_return,
  ROUND(avg(capture_ratio), 3) AS avg_capture_ratio, {O.tie("avg(beta)", 3)} AS avg_beta
FROM capture GROUP BY sector""")
def _(t):
    return scenario.sector_scenario_averages(
        scenario.capture_ratios(t.latest_betas, epsilon=1e-6, round_ratio=True), digits=3
    )


# The test tables carry region names; each listed region and industry number stands for a sector.
SECTOR_NAMES = [*K.SECTOR_SENSITIVITY, "Other"]
# Fixed values of the published tables, spelled out on this side too.
SECTOR_LIST = """['Technology', 'Financials', 'Healthcare', 'Consumer Discretionary', 'Consumer Staples', 'Energy',
  'Industrials', 'Utilities', 'Materials', 'Real Estate', 'Communication Services', 'Other']"""
SECTOR_MULTIPLIERS = """SELECT sector, scenario, CAST(multiplier AS DOUBLE) AS multiplier FROM (VALUES
  ('Technology', 1.30, 1.00, 1.40), ('Financials', 1.15, 1.00, 1.20), ('Healthcare', 0.85, 0.90, 0.70),
  ('Consumer Discretionary', 1.20, 1.00, 1.30), ('Consumer Staples', 0.60, 0.80, 0.45), ('Energy', 1.25, 0.95, 1.10),
  ('Industrials', 1.10, 1.00, 1.05), ('Utilities', 0.40, 0.70, 0.35), ('Materials', 1.10, 0.95, 1.00),
  ('Real Estate', 0.90, 0.85, 1.15), ('Communication Services', 1.05, 0.95, 1.10)) AS t(sector, bull, base, bear)
  UNPIVOT (multiplier FOR scenario IN (bull, base, bear))"""
REGIME_MULTIPLIERS = """SELECT sector, regime, CAST(multiplier AS DOUBLE) AS multiplier FROM (VALUES
  ('Technology', 1.40, 1.30, 1.30, 1.10, 1.00), ('Financials', 1.20, 1.10, 1.15, 1.20, 1.00),
  ('Healthcare', 0.70, 0.80, 0.85, 0.90, 0.90), ('Consumer Discretionary', 1.30, 1.20, 1.20, 1.15, 1.00),
  ('Communication Services', 1.10, 1.05, 1.05, 1.00, 0.95), ('Industrials', 1.05, 1.00, 1.10, 1.15, 1.00),
  ('Consumer Staples', 0.45, 0.55, 0.60, 0.70, 0.80), ('Energy', 1.10, 1.15, 1.25, 1.10, 0.95),
  ('Real Estate', 1.15, 1.00, 0.90, 1.05, 0.85), ('Materials', 1.00, 1.05, 1.10, 1.10, 0.95),
  ('Utilities', 0.35, 0.40, 0.40, 0.55, 0.70)) AS t(sector, bear, volatile, bull, recovery, normal)
  UNPIVOT (multiplier FOR regime IN (bear, volatile, bull, recovery, normal))"""


def _sector_rows(t):
    """The sectors present among suppliers, named by nation number over the sector list."""
    names = F.array(*[F.lit(s) for s in SECTOR_NAMES])
    key = F.col("s_nationkey") % len(SECTOR_NAMES) + 1
    return derived.read(t.spark, t.sf_dir, "supplier").select(
        F.element_at(names, key).alias("sector")
    ).distinct()


@q("sector_scenario_returns", "sector, scenario, multiplier:4, sector_return:4", """
SELECT s.sector, k.scenario, ROUND(coalesce(m.multiplier, 1.0), 4) AS multiplier,
  ROUND(k.shock * coalesce(m.multiplier, 1.0), 4) AS sector_return
FROM present s CROSS JOIN shocks k LEFT JOIN mults m ON m.sector = s.sector AND m.scenario = k.scenario""", {
    "present": f"SELECT DISTINCT list_extract({SECTOR_LIST}, CAST(s_nationkey % 12 + 1 AS INTEGER)) AS sector FROM supplier",
    "shocks": """SELECT scenario, CAST(shock AS DOUBLE) AS shock FROM (VALUES ('bull', 0.25), ('base', 0.08), ('bear', -0.30),
  ('stagflation', -0.15), ('rate_shock', -0.10)) AS t(scenario, shock)""",
    "mults": SECTOR_MULTIPLIERS})
def _(t):
    rows = None
    for key in [s[0] for s in K.SCENARIOS[:5]]:
        part = scenario.sector_scenario_returns(_sector_rows(t), key)
        rows = part if rows is None else rows.unionByName(part)
    return rows


@q("sector_regime_returns", "sector, market_scenario, n:0, multiplier:4, sector_return:4", """
SELECT g.sector, g.market_scenario, CAST(g.n AS DOUBLE) AS n, ROUND(coalesce(m.multiplier, 1.0), 4) AS multiplier,
  ROUND(k.shock * coalesce(m.multiplier, 1.0), 4) AS sector_return
FROM (SELECT p.sector, market_scenario, count(*) AS n FROM gold
  JOIN (SELECT s_suppkey, list_extract(""" + SECTOR_LIST + """,
    CAST(s_nationkey % 12 + 1 AS INTEGER)) AS sector FROM supplier) p
  ON gold.ticker = printf('S%05d', s_suppkey) GROUP BY p.sector, market_scenario) g
JOIN shocks k ON k.regime = lower(g.market_scenario)
LEFT JOIN mults m ON m.sector = g.sector AND m.regime = lower(g.market_scenario)""", {
    "shocks": """SELECT regime, CAST(shock AS DOUBLE) AS shock FROM (VALUES ('bear', -0.30), ('volatile', -0.05), ('bull', 0.25),
  ('recovery', 0.12), ('normal', 0.08)) AS t(regime, shock)""",
    "mults": REGIME_MULTIPLIERS})
def _(t):
    names = F.array(*[F.lit(s) for s in SECTOR_NAMES])
    industry = derived.read(t.spark, t.sf_dir, "supplier").select(
        derived.ticker_of("s_suppkey").alias("ticker"),
        F.element_at(names, F.col("s_nationkey") % len(SECTOR_NAMES) + 1).alias("sector"),
    )
    rows = (
        t.layers["gold"].select("ticker", "market_scenario").join(industry, "ticker")
        .groupBy("sector", "market_scenario").agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    return scenario.sector_regime_returns(rows)


@q("market_scenario", "ticker, date, market_scenario", "SELECT {cols} FROM gold")
def _(t):
    return scenario.with_market_scenario(t.layers["features"])


@q("regime_rules", "ticker, date, spx_drawdown_pct:6, momentum_20d:6, realized_vol_20d:6, vix_level:6, regime", """
SELECT {cols} FROM (SELECT *, CASE
    WHEN spx_drawdown_pct <= -0.20 AND vix_level >= 30 AND momentum_20d <= -0.05 THEN 'Bear'
    WHEN vix_level >= 25 AND spx_drawdown_pct >= -0.20 AND realized_vol_20d >= 0.22 THEN 'Volatile'
    WHEN spx_drawdown_pct >= -0.05 AND vix_level <= 18 AND momentum_20d >= 0.03 THEN 'Bull'
    WHEN spx_drawdown_pct >= -0.20 AND momentum_20d >= 0.01 AND vix_level <= 28 THEN 'Recovery'
    ELSE 'Normal' END AS regime
  FROM (SELECT ticker, date, drawdown AS spx_drawdown_pct, roc_20 AS momentum_20d, vol_20d AS realized_vol_20d,
    rsi_14 * 0.6 AS vix_level FROM feat) m) r""")
def _(t):
    rows = t.features.select(
        "ticker", "date", F.col("drawdown").alias("spx_drawdown_pct"), F.col("roc_20").alias("momentum_20d"),
        F.col("vol_20d").alias("realized_vol_20d"), (F.col("rsi_14") * 0.6).alias("vix_level"),
    )
    # The rules are a file beside the data.
    path = _folder(t, "rules")
    scenario.rule_table(t.spark).coalesce(1).write.option("header", True).csv(path)
    return scenario.classify_regimes(rows, t.spark.read.option("header", True).schema(scenario.RULE).csv(path))


@q("idiosyncratic_volatility", "ticker, scenario_name, idio_vol:6", f"""
SELECT ticker, scenario_name, ROUND(v * vol_multiplier, 6) AS idio_vol
FROM (SELECT ticker, stddev_samp(daily_return) * {O.ANN} AS v FROM ret GROUP BY ticker HAVING count(daily_return) > 1) s CROSS JOIN scen""")
def _(t):
    return scenario.idiosyncratic_volatility(t.returns)


# ---- signals, gold, audit --------------------------------------------------------------------

SIGNALS_SQL = """
SELECT ticker, sector, latest_close, return_1y, vol_20d, rsi_14, beta, pe_ratio,
  ROUND(CAST(0.4 AS DOUBLE) * CASE WHEN return_1y > 0.30 THEN 5 WHEN return_1y > 0.15 THEN 4 WHEN return_1y > 0 THEN 3
      WHEN return_1y > -0.15 THEN 2 ELSE 1 END
    + CAST(0.2 AS DOUBLE) * CASE WHEN rsi_14 < 30 THEN 5 WHEN rsi_14 < 45 THEN 4 WHEN rsi_14 < 55 THEN 3 WHEN rsi_14 < 70 THEN 2 ELSE 1 END
    + CAST(0.2 AS DOUBLE) * CASE WHEN vol_20d < 0.2 THEN 5 WHEN vol_20d < 0.3 THEN 4 WHEN vol_20d < 0.4 THEN 3 WHEN vol_20d < 0.5 THEN 2 ELSE 1 END
    + CAST(0.2 AS DOUBLE) * CASE WHEN pe_ratio < 10 THEN 5 WHEN pe_ratio < 18 THEN 4 WHEN pe_ratio < 25 THEN 3 WHEN pe_ratio < 40 THEN 2 ELSE 1 END,
  2) AS composite_score,
  CASE WHEN return_1y > 0.2 AND rsi_14 < 65 AND vol_20d < 0.4 THEN 'Strong Buy' WHEN return_1y > 0.05 AND rsi_14 < 70 THEN 'Buy'
    WHEN return_1y > -0.05 THEN 'Hold' WHEN return_1y > -0.2 THEN 'Sell' ELSE 'Strong Sell' END AS signal
FROM ranks"""


@q("investment_signals", None, SIGNALS_SQL)
def _(t):
    return signals.investment_signals(t.rankings)


@q("signal_mix", None, "SELECT signal, count(*) AS n FROM (" + SIGNALS_SQL + ") s GROUP BY signal")
def _(t):
    return signals.signal_mix(signals.investment_signals(t.rankings))


@q("signal_score", "ticker, date, signal_score:1", "SELECT {cols} FROM gold")
def _(t):
    return signals.with_signal_score(t.layers["features"])


@q("gold_fact", "ticker, date, close, daily_return:6, rsi_14:2, vol_20d:6, drawdown:6, market_scenario, signal_score:1, year, quarter",
   "SELECT {cols} FROM gold")
def _(t):
    return t.layers["gold"]


SECTOR_AGG_SQL = f"""
SELECT sector, market_scenario, count(DISTINCT ticker) AS n_equities, ROUND(avg(daily_return) * 252, 4) AS avg_return_ann,
  ROUND(stddev_samp(daily_return) * {O.ANN}, 4) AS volatility_ann,
  ROUND(count(*) FILTER (daily_return > 0) / CAST(count(*) AS DOUBLE), 4) AS win_rate, ROUND(avg(rsi_14), 4) AS avg_rsi,
  ROUND(avg(vol_20d), 4) AS avg_vol_20d,
  ROUND((avg(daily_return) * 252 - 0.05) / CASE WHEN stddev_samp(daily_return) = 0 THEN 1e-8 ELSE stddev_samp(daily_return) * {O.ANN} END, 4) AS sharpe
FROM gold WHERE daily_return IS NOT NULL GROUP BY sector, market_scenario"""


@q("sector_scenario_agg", None, SECTOR_AGG_SQL)
def _(t):
    return t.layers["sector_agg"]


DQ_AS_OF = "2002-01-01 00:00:00"


def _dq(t, layer="bronze"):
    return quality.quality_checks(
        t.dealt(t.raw_bars), layer, quality.QualityConfig(min_rows=100, strict=False), as_of=DQ_AS_OF
    )


DQ_SQL = {
    "dq_rows": f"""SELECT count(*) AS n, count(*) FILTER (close IS NULL) / CAST(count(*) AS DOUBLE) AS null_close,
  count(*) FILTER (close < 0.01 OR close > 1e6) AS r_close, count(*) FILTER (open < 0.01 OR open > 1e6) AS r_open,
  count(*) FILTER (high < 0.01 OR high > 1e6) AS r_high, count(*) FILTER (low < 0.01 OR low > 1e6) AS r_low,
  count(*) FILTER (high < low OR coalesce(close > high * 1.001, false) OR coalesce(close < low * 0.999, false)
    OR open > high * 1.001 OR open < low * 0.999) AS bad,
  epoch(TIMESTAMP '{DQ_AS_OF}' - CAST(max(date) AS TIMESTAMP)) / 3600.0 AS hours FROM raw_bars""",
    "dq_moves": f"""SELECT count(*) FILTER (abs(m) > 0.5) AS extreme FROM (
  SELECT (close - lag(close) OVER (PARTITION BY ticker ORDER BY date, close NULLS FIRST)) /
    lag(close) OVER (PARTITION BY ticker ORDER BY date, close NULLS FIRST) AS m FROM raw_bars) x""",
    "dq_keys": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT ticker, date FROM raw_bars) k) AS dup FROM raw_bars",
    "dq": """
SELECT 'row_count' AS check_name, CASE WHEN n < 100 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(n AS DOUBLE) AS metric,
  CAST(100 AS DOUBLE) AS threshold, CAST(CASE WHEN n < 100 THEN n ELSE 0 END AS BIGINT) AS affected_rows FROM dq_rows
UNION ALL SELECT 'required_columns', 'PASS', NULL, NULL, 0
UNION ALL SELECT 'null_rates', CASE WHEN null_close > 0.01 THEN 'FAIL' ELSE 'PASS' END, null_close, 0.01, 0 FROM dq_rows
UNION ALL SELECT 'numeric_ranges', CASE WHEN r_close + r_open + r_high + r_low > 0 THEN 'FAIL' ELSE 'PASS' END, NULL, NULL, 0 FROM dq_rows
UNION ALL SELECT 'ohlc_consistency', CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END, bad, NULL, bad FROM dq_rows
UNION ALL SELECT 'freshness', CASE WHEN hours > 48 THEN 'WARN' ELSE 'PASS' END, ROUND(hours, 1), 48, 0 FROM dq_rows
UNION ALL SELECT 'price_moves', CASE WHEN extreme / CAST(n AS DOUBLE) > 0.001 THEN 'WARN' ELSE 'PASS' END,
  extreme / CAST(n AS DOUBLE), 0.5, extreme FROM dq_moves, dq_rows
UNION ALL SELECT 'duplicates', CASE WHEN dup > 0 THEN 'FAIL' ELSE 'PASS' END, dup, NULL, dup FROM dq_keys""",
}


@q("dq_report", "layer, check_name, status, metric:6, threshold:6, affected_rows", """
SELECT 'bronze' AS layer, check_name, status, ROUND(metric, 6) AS metric, ROUND(threshold, 6) AS threshold, affected_rows FROM dq""", DQ_SQL)
def _(t):
    return _dq(t)


@q("dq_score", "layer, passed, warned, failed, overall_score:2", """
SELECT 'bronze' AS layer, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warned,
  count(*) FILTER (status = 'FAIL') AS failed,
  ROUND(greatest(CAST(0 AS DOUBLE), 100.0 - 10.0 * count(*) FILTER (status = 'FAIL') - 3.0 * count(*) FILTER (status = 'WARN')), 2) AS overall_score
FROM dq""", DQ_SQL)
def _(t):
    return quality.quality_score(_dq(t))


@q("dq_report_json", None, """
SELECT 'bronze' AS layer, count(*) AS n_checks, string_agg(check_name || ':' || status || ':' || affected_rows, ',' ORDER BY check_name) AS checks,
  greatest(CAST(0 AS DOUBLE), 100.0 - 10.0 * count(*) FILTER (status = 'FAIL') - 3.0 * count(*) FILTER (status = 'WARN')) AS overall_score
FROM dq""", DQ_SQL)
def _(t):
    """The report written as JSON and read back."""
    path = files.write_json(quality.report_json(_dq(t)), _folder(t, "dq"))
    kind = "checks array<struct<check_name: string, status: string, affected_rows: bigint>>, overall_score double"
    read = t.spark.read.schema("layer string, report string").json(path).withColumn("r", F.from_json("report", kind))
    checks = F.sort_array(F.transform("r.checks", lambda c: F.concat_ws(":", c["check_name"], c["status"], c["affected_rows"].cast("string"))))
    return read.select("layer", F.size("r.checks").cast("long").alias("n_checks"), F.array_join(checks, ",").alias("checks"), F.col("r.overall_score").alias("overall_score"))


def _score_sql(table, columns, ranged, prices, moves):
    """The score of one layer from its own checks: minus 10 per failure, 3 per warning."""
    nulls = " OR ".join(f"count(*) - count({c}) > 0.01 * count(*)" for c in columns)
    limits = {"close": "close < 0.01 OR close > 1e6", "open": "open < 0.01 OR open > 1e6", "high": "high < 0.01 OR high > 1e6",
              "low": "low < 0.01 OR low > 1e6", "volume": "volume < 0 OR volume > 1e12"}
    outside = " OR ".join(f"count(*) FILTER ({limits[c]}) > 0" for c in ranged)
    bad = """count(*) FILTER (coalesce(high < low, false) OR coalesce(close > high * 1.001, false) OR coalesce(close < low * 0.999, false)
      OR coalesce(open > high * 1.001, false) OR coalesce(open < low * 0.999, false)) > 0""" if prices else "false"
    return f"""(SELECT 100.0 - 10 * (CAST(count(*) < 100 AS INTEGER) + CAST({nulls} AS INTEGER) + CAST({outside} AS INTEGER) + CAST({bad} AS INTEGER)
      + CAST(count(*) > count(DISTINCT (ticker, date)) AS INTEGER))
      - 3 * (CAST(epoch(TIMESTAMP '{DQ_AS_OF}' - CAST(max(date) AS TIMESTAMP)) / 3600.0 > 48 AS INTEGER)
      + CAST(count(*) FILTER (abs(move) > 0.5) > 0.001 * count(*) AS INTEGER)) FROM (SELECT *, {moves} AS move FROM {table}) t)"""


_BARS = ["open", "high", "low", "close", "volume"]


@q("layer_audit", "step, layer, records_in, records_out, quality_score:2", "SELECT {cols} FROM (" + f"""
SELECT * FROM audit UNION ALL SELECT 0, 'total', CAST(sum(records_in) AS BIGINT), CAST(sum(records_out) AS BIGINT), avg(quality_score) FROM audit) x""", {
    "scored": "SELECT " + _score_sql("bronze", [*_BARS, "ticker", "date", "sector"], _BARS, True,
                                     f"(close - lag(close) OVER {O.W}) / NULLIF(lag(close) OVER {O.W}, 0)") + " AS b, "
              + _score_sql("silver", [*_BARS, "ticker", "date", "sector", "daily_return", "log_return", "is_outlier"], _BARS, True, "daily_return") + " AS s, "
              + _score_sql("(SELECT ticker, date, close, daily_return FROM gold WHERE close IS NOT NULL AND daily_return IS NOT NULL)",
                           ["ticker", "date", "close", "daily_return"], ["close"], False, "daily_return") + " AS g",
    "audit": """
SELECT 1 AS step, 'bronze' AS layer, (SELECT count(*) FROM typed_bars) AS records_in, (SELECT count(*) FROM bronze) AS records_out, CAST(b AS DOUBLE) AS quality_score FROM scored
UNION ALL SELECT 2, 'silver', (SELECT count(*) FROM bronze), (SELECT count(*) FROM silver), s FROM scored
UNION ALL SELECT 3, 'features', (SELECT count(*) FROM silver), (SELECT count(*) FROM silver), 100
UNION ALL SELECT 4, 'gold', (SELECT count(*) FROM silver), (SELECT count(*) FROM silver), g FROM scored"""})
def _(t):
    """A lenient run over faulty bars: every layer is computed once, as it is written, and scored."""
    return _gated(t, t.text_bars, strict=False).audit()


def _gated(t, text, strict):
    config = quality.QualityConfig(min_rows=100, strict=strict)
    return publish.Run(t.spark, files.shared_folder(t.spark), config, DQ_AS_OF, t.tasks).go(text, publish.bar_steps())


@q("gated_gold", "ticker, date, close, market_scenario, signal_score:1, year, quarter", "SELECT {cols} FROM gold")
def _(t):
    return _gated(t, t.text_bars, strict=False).layer("gold")


@q("gated_sector_agg", None, SECTOR_AGG_SQL, {"bronze": "SELECT ticker, date, open, high, low, close, volume, sector FROM bars"})
def _(t):
    """A strict run over bars without planted faults, through every gate."""
    text = t.bars.select(*[F.col(c).cast("string").alias(c) for c in t.bars.columns])
    return _gated(t, text, strict=True).layer("sector_agg")


@q("sql_over_views", "sector, n_days, avg_return:6, worst:6", """
SELECT sector, count(DISTINCT date) AS n_days, avg(daily_return) AS avg_return, min(daily_return) AS worst FROM ret_only GROUP BY sector""".replace(
    "SELECT sector, count", "SELECT {cols} FROM (SELECT sector, count", 1) + ") v")
def _(t):
    """SQL text over registered views, as a notebook would write it."""
    name = f"daily_returns_{uuid.uuid4().hex}"
    files.register_views(**{name: t.returns})
    return t.spark.sql(f"""
        SELECT sector, count(DISTINCT date) AS n_days, avg(daily_return) AS avg_return, min(daily_return) AS worst
        FROM {name} WHERE daily_return IS NOT NULL GROUP BY sector""")


@q("sql_jobs_shared_view", "job, name, value:4", f"""
SELECT job, name, ROUND(value, 4) AS value FROM (
  SELECT 'sector_performance' AS job, f.sector AS name, avg(daily_return) * 252 AS value FROM ret_only r JOIN clean_fund f ON r.ticker = f.ticker
    WHERE date >= (SELECT max(date) - 252 FROM ret) GROUP BY f.sector
  UNION ALL SELECT 'top_performers', ticker, ret_1y FROM (SELECT *, row_number() OVER (ORDER BY ret_1y DESC, ticker) AS k FROM (
    SELECT ticker, arg_max(close, date) / arg_min(close, date) - 1 AS ret_1y FROM ret WHERE date >= (SELECT max(date) - 252 FROM ret) GROUP BY ticker) y) z WHERE k <= 50
  UNION ALL SELECT 'volatility_regime', strftime(date, '%Y-%m-%d'), stddev_samp(daily_return) * {O.ANN} FROM ret_only GROUP BY date) j""")
def _(t):
    """The three SQL jobs of one run over one cached view; each is materialised before the cache goes."""
    with files.shared_views(returns=t.returns.select("ticker", "date", "close", "daily_return"), fundamentals=t.clean_fundamentals) as v:
        jobs = {
            "sector_performance": f"""SELECT f.sector AS name, avg(daily_return) * 252 AS value FROM {v['returns']} r JOIN {v['fundamentals']} f USING (ticker)
                WHERE date >= (SELECT date_sub(max(date), 252) FROM {v['returns']}) GROUP BY f.sector""",
            "top_performers": f"""SELECT ticker AS name, max_by(close, date) / min_by(close, date) - 1 AS value FROM {v['returns']}
                WHERE date >= (SELECT date_sub(max(date), 252) FROM {v['returns']}) GROUP BY ticker ORDER BY value DESC, name LIMIT 50""",
            "volatility_regime": f"SELECT date_format(date, 'yyyy-MM-dd') AS name, stddev_samp(daily_return) * sqrt(252) AS value FROM {v['returns']} WHERE daily_return IS NOT NULL GROUP BY date",
        }
        done = [files.stored(t.spark.sql(text).select(F.lit(job).alias("job"), "name", "value")) for job, text in jobs.items()]
    return done[0].unionByName(done[1]).unionByName(done[2])


@q("bucketed_momentum", "ticker, date, sma_20:6, daily_return:6", f"""
SELECT ticker, date, ROUND(avg(close) OVER {O.rows(20)}, 6) AS sma_20, ROUND(daily_return, 6) AS daily_return FROM ret""")
def _(t):
    """Windows by ticker over a table that is stored by ticker: no shuffle."""
    name = f"bars_{uuid.uuid4().hex}"
    stored = files.write_bucketed(t.bars, name, buckets=16, path=_folder(t, "bucketed"))
    return features.with_moving_averages(features.with_returns(stored))


@q("fact_quarter_rerun", "ticker, date, close, year, quarter", """
SELECT ticker, date, CASE WHEN year = 1998 AND quarter = 2 THEN close * 2 ELSE close END AS close, year, quarter
FROM (SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter FROM bars) b""")
def _(t):
    """One quarter computed again replaces its partition alone."""
    rows = t.bars.select("ticker", "date", "close", F.year("date").alias("year"), F.quarter("date").alias("quarter"))
    path = files.write_parquet(rows, _folder(t, "fact"), ["year", "quarter"])
    again = rows.filter("year = 1998 AND quarter = 2").withColumn("close", F.col("close") * 2)
    return t.spark.read.schema(rows.schema).parquet(files.replace_partitions(again, path, ["year", "quarter"]))


@q("export_dimensions", "kind, name, shock:4, multiplier:4, n_days", """
SELECT 'scenario' AS kind, scenario_name AS name, ROUND(mkt_return_shock, 4) AS shock, ROUND(vol_multiplier, 4) AS multiplier, NULL::BIGINT AS n_days FROM scen
UNION ALL SELECT 'date', 'weekdays', NULL, NULL, (SELECT count(*) FROM (
  SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY)) AS DATE) AS date) s WHERE isodow(date) <= 5)""")
def _(t):
    """The scenario and date dimensions written as one small file each and read back."""
    scenarios = scenario.with_scenarios(t.spark.range(1)).select("scenario_name", "mkt_return_shock", "vol_multiplier")
    kept = files.read_parquet(t.spark, files.write_small(scenarios, _folder(t, "dim_scenario")))
    days = files.write_small(market.calendar(t.bars), _folder(t, "dim_date"))
    counted = files.read_parquet(t.spark, days).agg(F.count(F.lit(1)).alias("n_days"))
    none = F.lit(None).cast("double")
    return kept.select(
        F.lit("scenario").alias("kind"), F.col("scenario_name").alias("name"), F.col("mkt_return_shock").alias("shock"),
        F.col("vol_multiplier").alias("multiplier"), F.lit(None).cast("long").alias("n_days"),
    ).unionByName(counted.select(F.lit("date").alias("kind"), F.lit("weekdays").alias("name"), none.alias("shock"), none.alias("multiplier"), "n_days"))


@q("export_signals", None, SIGNALS_SQL)
def _(t):
    """Signals written as CSV and read back."""
    df = signals.investment_signals(t.rankings)
    return files.read_csv(t.spark, files.write_csv(df, _folder(t, "signals")), df.schema)


# ---- business measures -----------------------------------------------------------------------

@q("m_core", "sector, daily_return:6, latest_close, latest_close_literal, return_1d:6, return_5d:6, return_5d_literal:6", """
SELECT sector, ROUND(avg(daily_return), 6) AS daily_return, any_value(last_close) AS latest_close,
  max(close) AS latest_close_literal,
  ROUND((avg(close) FILTER (date = d1) - avg(close) FILTER (date = d2)) / NULLIF(avg(close) FILTER (date = d2), 0), 6) AS return_1d,
  ROUND((any_value(last_close) - any_value(week_first)) / NULLIF(any_value(week_first), 0), 6) AS return_5d,
  ROUND((max(close) - min(close) FILTER (date >= d1 - 7)) / NULLIF(min(close) FILTER (date >= d1 - 7), 0), 6) AS return_5d_literal
FROM (SELECT *, first_value(close) OVER (PARTITION BY sector ORDER BY date DESC, ticker DESC) AS last_close,
    first_value(close) OVER (PARTITION BY sector ORDER BY date < d1 - 7, date, ticker) AS week_first_raw,
    CASE WHEN max(date) OVER (PARTITION BY sector) >= d1 - 7 THEN
      first_value(close) OVER (PARTITION BY sector ORDER BY date < d1 - 7, date, ticker) END AS week_first
  FROM ret CROSS JOIN (SELECT max(date) AS d1, max(date) FILTER (date < (SELECT d FROM last_day)) AS d2 FROM bars) e) x
GROUP BY sector""")
def _(t):
    return measures.core(t.returns)


HORIZON = ("return_1m:6, return_3m:6, return_6m:6, return_1y:6, return_3y_ann:6, return_5y_ann:6, "
           "return_10y_ann:6, return_20y_ann:6")


@q("m_horizon", "sector, " + HORIZON, "SELECT {cols} FROM (" + O.horizon_sql(["sector"]) + ") h")
def _(t):
    return measures.horizon(t.bars)


@q("m_horizon_asof", "ticker, " + HORIZON, "SELECT {cols} FROM (" + O.asof_sql() + ") h")
def _(t):
    return measures.horizon_asof(t.bars)


@q("m_risk", "sector, annualised_return:4, annualised_volatility:4, sharpe_ratio:4, sortino_ratio:4, var_95:6, var_99:6, "
   "cvar_95:6, max_drawdown:4, win_rate:6, average_beta:6, calmar_ratio:4", f"""
SELECT {{cols}} FROM (SELECT g.sector, a AS annualised_return, s.dev * {O.ANN} AS annualised_volatility,
  (a - 0.05) / (s.dev * {O.ANN}) AS sharpe_ratio, (a - 0.05) / (s.down * {O.ANN}) AS sortino_ratio,
  v95 AS var_95, v99 AS var_99, (SELECT avg(daily_return) FROM ret_only WHERE daily_return <= v95) AS cvar_95,
  mdd AS max_drawdown, wins AS win_rate, b AS average_beta, a / abs(mdd) AS calmar_ratio
FROM (SELECT sector, avg(daily_return) * 252 AS a FROM ret GROUP BY sector) g
LEFT JOIN (SELECT sector, avg(beta) AS b FROM clean_fund GROUP BY sector) f ON g.sector = f.sector
CROSS JOIN (SELECT stddev_pop(daily_return) AS dev, stddev_pop(daily_return) FILTER (daily_return < 0) AS down,
  quantile_cont(daily_return, 0.05) AS v95, quantile_cont(daily_return, 0.01) AS v99,
  count(*) FILTER (daily_return > 0) / CAST(count(*) FILTER (daily_return <> 0) AS DOUBLE) AS wins FROM ret_only) s
CROSS JOIN (SELECT min(c) - max(c) AS mdd FROM (SELECT sum(x) OVER (ORDER BY date) AS c
  FROM (SELECT date, sum(ln(1 + daily_return)) AS x FROM ret GROUP BY date) d) e) m) z""")
def _(t):
    return measures.risk(t.stored_returns, t.clean_fundamentals)


@q("m_breadth", "market_breadth:6, n_advancing, n_declining, new_52w_highs", """
SELECT ROUND(CAST(sum(up) AS DOUBLE) / NULLIF(sum(up) + sum(down), 0), 6) AS market_breadth,
  CAST(sum(up) AS BIGINT) AS n_advancing, CAST(sum(down) AS BIGINT) AS n_declining,
  count(*) FILTER (today >= coalesce(high52, 0)) AS new_52w_highs
FROM (SELECT ticker, count(*) FILTER (date = d AND daily_return > 0) AS up, count(*) FILTER (date = d AND daily_return < 0) AS down,
    max(close) FILTER (date = d) AS today, max(high) FILTER (date >= d - 365 AND date < d) AS high52
  FROM ret CROSS JOIN last_day GROUP BY ticker) p""")
def _(t):
    return measures.breadth(t.returns)


@q("m_scenario", "scenario_name, scenario_return:5, scenario_vol:4, scenario_sharpe:5, scenario_var_95:4, scenario_max_drawdown:4", f"""
SELECT {{cols}} FROM (SELECT scenario_name, r AS scenario_return, v AS scenario_vol, (r - 0.05) / v AS scenario_sharpe,
  mean - 1.6449 * dev * vol_multiplier AS scenario_var_95, -2 * v AS scenario_max_drawdown
FROM (SELECT *, 0.05 + b * (mkt_return_shock - 0.05) AS r, dev * {O.ANN} * vol_multiplier AS v FROM scen
  CROSS JOIN (SELECT avg(beta) AS b FROM clean_fund) f
  CROSS JOIN (SELECT stddev_pop(daily_return) AS dev, avg(daily_return) AS mean FROM ret) s) x) y""")
def _(t):
    return measures.scenario(t.returns, t.clean_fundamentals)


@q("m_sector", "sector, sector_return_1y:6, sector_weight:6, sector_sharpe:6, sector_sharpe_contribution:6", f"""
SELECT {{cols}} FROM (SELECT r.sector, x AS sector_return_1y, w AS sector_weight, (x - 0.05) / v AS sector_sharpe,
  (x - 0.05) / v * w / 100 AS sector_sharpe_contribution
FROM (SELECT sector, avg(return_1y) AS x FROM (""" + O.horizon_sql(["sector", "ticker"]) + f""") h GROUP BY sector) r
LEFT JOIN (SELECT sector, sum(weight_pct) AS w FROM univ GROUP BY sector) u ON r.sector = u.sector
CROSS JOIN (SELECT stddev_pop(daily_return) * {O.ANN} AS v FROM ret) s) z""")
def _(t):
    return measures.sector(t.returns, t.universe)


@q("m_volume", "sector, total_volume, avg_daily_volume:4, volume_ratio_20d:6", """
SELECT sector, CAST(sum(v) AS BIGINT) AS total_volume, ROUND(avg(v), 4) AS avg_daily_volume,
  ROUND(sum(v) FILTER (date = d) / any_value(base), 6) AS volume_ratio_20d
FROM (SELECT sector, date, sum(volume) AS v FROM bars GROUP BY sector, date) s CROSS JOIN last_day
CROSS JOIN (SELECT avg(volume) AS base FROM (SELECT volume, rank() OVER (ORDER BY date DESC) AS k FROM bars
  WHERE date < (SELECT d FROM last_day)) t WHERE k <= 20) b GROUP BY sector""")
def _(t):
    return measures.volume(t.bars)


@q("m_rolling", "ticker, date, rolling_252d_sharpe:6, rolling_60d_vol:6", f"""
SELECT ticker, date, ROUND((avg(daily_return) OVER y * 252 - 0.05) / NULLIF(stddev_pop(daily_return) OVER y * {O.ANN}, 0), 6) AS rolling_252d_sharpe,
  ROUND(stddev_pop(daily_return) OVER qt * {O.ANN}, 6) AS rolling_60d_vol
FROM ret WINDOW y AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW),
  qt AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW)""")
def _(t):
    return measures.rolling(t.returns)


@q("m_signal", "ticker, return_1y:6, rsi_14:4, signal_label, volatility_regime", f"""
SELECT ticker, ROUND(return_1y, 6) AS return_1y, ROUND(rsi_14, 4) AS rsi_14,
  CASE WHEN return_1y > 0.2 AND rsi_14 < 65 THEN 'Strong Buy' WHEN return_1y > 0.05 AND rsi_14 < 70 THEN 'Buy'
    WHEN return_1y > -0.05 THEN 'Hold' WHEN return_1y > -0.2 THEN 'Sell' ELSE 'Strong Sell' END AS signal_label,
  CASE WHEN vol > 0.35 THEN 'High Volatility' WHEN vol > 0.2 THEN 'Normal' ELSE 'Low Volatility' END AS volatility_regime
FROM (SELECT h.ticker, h.return_1y, 100 - 100 / (1 + up / (down + 0.000001)) AS rsi_14,
    (SELECT stddev_pop(daily_return) * {O.ANN} FROM ret) AS vol
  FROM (""" + O.horizon_sql(["ticker"]) + """) h JOIN (SELECT ticker,
    coalesce(avg(daily_return) FILTER (daily_return > 0), 0) AS up, abs(coalesce(avg(daily_return) FILTER (daily_return < 0), 0)) AS down
    FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS e FROM ret) r WHERE date >= e - 21 GROUP BY ticker) s
  ON h.ticker = s.ticker) z""")
def _(t):
    return measures.signal(t.returns)


@q("sector_rotation", "sector, return_1m:6, return_3m:6, return_1y:6, quadrant, momentum_rank", """
SELECT sector, ROUND(m1, 6) AS return_1m, ROUND(m3, 6) AS return_3m, ROUND(y1, 6) AS return_1y,
  CASE WHEN m3 >= 0 AND m1 >= 0 THEN 'Leading' WHEN m3 >= 0 THEN 'Weakening' WHEN m1 < 0 THEN 'Lagging' ELSE 'Improving' END AS quadrant,
  CAST(rank() OVER (ORDER BY y1 DESC NULLS LAST) AS INTEGER) AS momentum_rank
FROM (SELECT sector, avg(return_1m) AS m1, avg(return_3m) AS m3, avg(return_1y) AS y1 FROM (""" + O.asof_sql() + """) a GROUP BY sector) s""")
def _(t):
    return measures.sector_rotation(t.bars)


# ---- summaries -------------------------------------------------------------------------------

def _kpis(t):
    """Headline figures in one row, each a scalar over the stored feature table."""
    stored = t.report_features
    last = market.latest_rows(market.market_breadth(stored), 1)
    regime = market.latest_rows(market.volatility_regime(stored), 1)
    return market.equity_rankings(stored).agg(
        F.count("ticker").alias("total_equities"),
        half_up(F.avg("return_1y"), 3).alias("market_avg_return_1y"),
        half_up(F.avg("vol_20d"), 3).alias("market_avg_vol"),
        F.max(t.bars.agg(F.max("date")).scalar()).alias("as_of_date"),
    ).withColumns({
        "market_breadth_pct": last.select("breadth_pct").scalar(),
        "vol_regime": regime.select("vol_regime").scalar(),
        "var_95": half_up(risk.selection_tail_risk(stored)["var_95"], 6),
    })


# The mean of figures rounded to four digits often lies on a tie of the fourth: three are shown.
KPI_SQL = """
SELECT (SELECT d FROM last_day) AS as_of_date, count(*) AS total_equities, ROUND(avg(return_1y), 3) AS market_avg_return_1y,
  ROUND(avg(vol_20d), 3) AS market_avg_vol,
  (SELECT arg_max(breadth_pct, date) FROM (""" + BREADTH_SQL + """) b) AS market_breadth_pct,
  (SELECT CASE WHEN v > 0.35 THEN 'High Volatility' WHEN v >= 0.2 THEN 'Normal' ELSE 'Low Volatility' END
    FROM (SELECT date, stddev_samp(daily_return) * sqrt(252.0) AS v FROM ret_only GROUP BY date ORDER BY date DESC LIMIT 1) x) AS vol_regime,
  ROUND((SELECT quantile_cont(daily_return, 0.05) FROM ret_only), 6) AS var_95
FROM ranks"""


@q("report_kpis", "as_of_date, total_equities, market_avg_return_1y, market_avg_vol, market_breadth_pct, vol_regime, var_95", KPI_SQL)
def _(t):
    return _kpis(t)


@q("market_summary", None, f"""
SELECT *, (SELECT string_agg(sector || '=' || n_equities || '=' || printf('%.3f', avg_beta), ',' ORDER BY sector) FROM summary_sectors) AS sectors,
  (SELECT string_agg(ticker, ',' ORDER BY return_1y DESC, ticker) FROM (SELECT * FROM ranks ORDER BY return_1y DESC, ticker LIMIT 5) a) AS top_performers,
  (SELECT string_agg(ticker, ',' ORDER BY return_1y, ticker) FROM (SELECT * FROM ranks ORDER BY return_1y, ticker LIMIT 5) b) AS bottom_performers
FROM ({KPI_SQL}) k""", {"summary_sectors": """
SELECT f.sector, count(DISTINCT r.ticker) AS n_equities, ROUND(avg(beta), 3) AS avg_beta
FROM ret r JOIN clean_fund f ON r.ticker = f.ticker WHERE date >= (SELECT d - 252 FROM last_day) GROUP BY f.sector"""})
def _(t):
    """One row: headline figures, and as text the sector rows and both ends of the ranking (of fixed or sector-count length)."""
    sectors = market.sector_performance(t.returns, t.clean_fundamentals)
    ends = market.top_bottom(market.equity_rankings(t.report_features), 5)

    def told(df, text, *order):
        rows = df.select(F.struct(*order, text.alias("text")).alias("r"))
        return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["text"]), ",")).scalar()

    r = F.col("return_1y")
    return _kpis(t).withColumns({
        "sectors": told(sectors, F.concat_ws("=", "sector", "n_equities", F.format_string("%.3f", "avg_beta")), F.col("sector")),
        "top_performers": told(ends.filter("side = 'top'"), F.col("ticker"), (-r).alias("o"), F.col("ticker").alias("k")),
        "bottom_performers": told(ends.filter("side = 'bottom'"), F.col("ticker"), r.alias("o"), F.col("ticker").alias("k")),
    }).select("as_of_date", "total_equities", "market_avg_return_1y", "market_avg_vol", "market_breadth_pct", "vol_regime", "var_95",
              "sectors", "top_performers", "bottom_performers")


_CELLS = "section, name, metric, ROUND(value, 5) AS value"


def _cells_sql(section, name, metrics, source):
    return f"SELECT '{section}' AS section, name, metric, value FROM (SELECT {name} AS name, {', '.join(f'CAST({m} AS DOUBLE) AS {m.split()[-1]}' for m in metrics)} FROM ({source}) s) u UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(m.split()[-1] for m in metrics)}))"


REPORT_ENDS = "SELECT *, row_number() OVER (ORDER BY return_1y {order}, ticker) AS position FROM ranks QUALIFY position <= 10"
REPORT_SQL = f"SELECT {_CELLS} FROM (" + " UNION ALL ".join([
    _cells_sql("kpi", "'market'", ["total_equities", "avg_return_1y", "avg_vol"],
               "SELECT count(*) AS total_equities, ROUND(avg(return_1y), 3) AS avg_return_1y, ROUND(avg(vol_20d), 3) AS avg_vol FROM ranks"),
    _cells_sql("sector", "sector", ["n_equities", "avg_return", "volatility", "sharpe", "avg_beta"], f"""
SELECT coalesce(sector, 'all') AS sector, count(DISTINCT ticker) AS n_equities, ROUND(avg(daily_return) * 252, 4) AS avg_return,
  ROUND(stddev_samp(daily_return) * {O.ANN}, 4) AS volatility,
  ROUND((avg(daily_return) * 252 - 0.05) / NULLIF(stddev_samp(daily_return) * {O.ANN}, 0), 4) AS sharpe, ROUND(avg(beta), 3) AS avg_beta
FROM eq_feat WHERE date >= (SELECT max(date) - 252 FROM eq_feat) GROUP BY GROUPING SETS ((sector), ())"""),
    _cells_sql("top", "ticker", ["position", "return_1y", "vol_20d", "beta", "pe_ratio"], REPORT_ENDS.format(order="DESC")),
    _cells_sql("bottom", "ticker", ["position", "return_1y", "vol_20d", "beta", "pe_ratio"], REPORT_ENDS.format(order="ASC")),
    _cells_sql("scenario", "scenario_name", ["scenario_return", "scenario_vol", "scenario_sharpe", "scenario_var_95", "scenario_max_drawdown"], f"""
SELECT scenario_name, r AS scenario_return, v AS scenario_vol, (r - 0.05) / v AS scenario_sharpe,
  mean - 1.6449 * dev * vol_multiplier AS scenario_var_95, -2 * v AS scenario_max_drawdown
FROM (SELECT *, 0.05 + b * (mkt_return_shock - 0.05) AS r, dev * {O.ANN} * vol_multiplier AS v FROM scen
  CROSS JOIN (SELECT avg(beta) AS b FROM clean_fund) f
  CROSS JOIN (SELECT stddev_pop(daily_return) AS dev, avg(daily_return) AS mean FROM eq_feat) e) x"""),
    _cells_sql("risk", "p", report.RISK, "SELECT * FROM market_risk"),
]) + ") t"


@q("report_bundle", "section, name, metric, value:5", REPORT_SQL, {
    "market_risk": O.risk_sql("(SELECT 'market' AS p, date, avg(daily_return) AS r FROM eq_feat GROUP BY date)", "p")})
def _(t):
    """All tables of the report from one stored feature table."""
    return report.bundle(t.report_features, measures.scenario(t.report_features, t.clean_fundamentals))
