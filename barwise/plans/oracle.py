"""Shared SQL for checking the queries: named common table expressions and a composer."""

import re

ANN = "sqrt(252.0)"


def select_list(spec):
    """Projection text of a ``pick`` spec."""
    out = []
    for item in spec.replace("\n", " ").split(","):
        name, _, digits = item.strip().partition(":")
        out.append(f"ROUND(CAST({name} AS DOUBLE), {digits}) AS {name}" if digits else name)
    return ", ".join(out)


def tie(x, digits):
    """Decimal rounding of a figure that often lies on a tie, such as the mean of rounded figures: of the number as it
    prints, where ROUND of a double would scale in binary first."""
    return f"ROUND(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits})::DOUBLE"


def rows(n):
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RUN = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
W = "(PARTITION BY ticker ORDER BY date)"


def feature_sql(source):
    """Partial-frame features over a return table."""
    lag = lambda n: f"lag(close, {n}) OVER {W}"
    step1 = f"""SELECT ticker, date, open, high, low, close, volume, sector, daily_return, log_return,
      lag(close) OVER {W} AS prev_close,
      {", ".join(f"(close - {lag(n)}) / NULLIF({lag(n)}, 0) AS roc_{n}" for n in (20, 60, 252))}
      FROM {source}"""
    gain = f"avg(CASE WHEN daily_return > 0 THEN daily_return ELSE 0.0 END) OVER {rows(14)}"
    loss = f"avg(CASE WHEN daily_return < 0 THEN -daily_return ELSE 0.0 END) OVER {rows(14)}"
    mid, dev = f"avg(close) OVER {rows(20)}", f"stddev_samp(close) OVER {rows(20)}"
    step2 = f"""SELECT *,
      {", ".join(f"avg(close) OVER {rows(n)} AS sma_{n}" for n in (20, 50, 200))},
      avg(close) OVER {rows(12)} AS ema_12, avg(close) OVER {rows(26)} AS ema_26,
      {mid} AS bb_mid, {dev} AS bb_std,
      100 - 100 / (1 + {gain} / ({loss} + 1e-8)) AS rsi_14,
      avg(roc_252) OVER {rows(252)} AS roc_mean, stddev_samp(roc_252) OVER {rows(252)} AS roc_dev,
      stddev_samp(log_return) OVER {rows(20)} * {ANN} AS vol_20d,
      stddev_samp(log_return) OVER {rows(60)} * {ANN} AS vol_60d,
      greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS true_range,
      avg(volume) OVER {rows(20)} AS avg_vol_20d,
      sum(CASE WHEN daily_return >= 0 THEN volume ELSE -volume END) OVER {RUN} AS obv,
      sum(log_return) OVER {RUN} AS cum_return
      FROM ({step1})"""
    return f"""SELECT *, ema_12 - ema_26 AS macd, bb_mid + 2 * bb_std AS bb_upper,
      bb_mid - 2 * bb_std AS bb_lower,
      (close - (bb_mid - 2 * bb_std)) / (4 * bb_std + 1e-8) AS bb_position,
      (roc_252 - roc_mean) / (roc_dev + 1e-8) AS momentum_zscore,
      avg(true_range) OVER {rows(14)} AS atr_14,
      volume / (avg_vol_20d + 1) AS volume_ratio,
      max(cum_return) OVER {RUN} AS cum_max_return,
      cum_return - max(cum_return) OVER {RUN} AS drawdown
      FROM ({step2})"""


SANE = "high >= low AND close >= low * {tol} AND close <= high * 1.001"
BAR_ORDER = "open NULLS FIRST, high NULLS FIRST, low NULLS FIRST, close NULLS FIRST, volume NULLS FIRST"


def full(expr, values, n):
    return f"CASE WHEN count({values}) OVER {rows(n)} = {n} THEN {expr} OVER {rows(n)} END"


CTES = {
    "bars": """
SELECT ticker, date, max(CASE WHEN first_no = 1 THEN price END) AS open, max(price) AS high,
  min(price) AS low, max(CASE WHEN last_no = 1 THEN price END) AS close,
  CAST(sum(l_quantity) AS BIGINT) AS volume, max(r_name) AS sector
FROM (
  SELECT printf('S%05d', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity, r_name,
    l_extendedprice / l_quantity AS price,
    row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS first_no,
    row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
      ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC,
               l_quantity DESC) AS last_no
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) priced
GROUP BY ticker, date""",
    "keyed_bars": "SELECT *, CAST(substr(ticker, 2) AS BIGINT) * 31 + (date - DATE '1995-01-01') AS k FROM bars",
    "raw_bars": """
SELECT ticker, date, open, CASE WHEN k % 83 = 0 THEN low ELSE high END AS high,
  CASE WHEN k % 83 = 0 THEN high + 1 ELSE low END AS low,
  CASE WHEN k % 89 <> 0 THEN close END AS close, volume, sector
FROM (SELECT * FROM keyed_bars UNION ALL SELECT * FROM keyed_bars WHERE k % 97 = 0) twice""",
    "typed_bars": """
SELECT ticker, date, CASE WHEN day(date) <> 13 THEN open END AS open, high, low, close, volume, sector
FROM raw_bars""",
    "bronze": f"""
SELECT ticker, date, open, high, low, close, volume, sector FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY {BAR_ORDER}) AS n FROM typed_bars) d
WHERE n = 1""",
    "fund": """
SELECT printf('S%05d', s_suppkey) AS ticker, r_name AS sector,
  CASE s_suppkey % 4 WHEN 0 THEN 'Large Cap' WHEN 1 THEN 'Mid Cap' WHEN 2 THEN 'Small Cap'
    ELSE 'Micro Cap' END AS market_cap_category,
  CASE s_suppkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' ELSE 'LSE' END AS exchange,
  n_name AS country, CAST(0.5 + (s_suppkey % 100) / 80.0 AS DOUBLE) AS beta,
  CAST(s_suppkey * 7 % 230 AS DOUBLE) AS pe_ratio,
  CAST(0.5 + (s_suppkey % 11) / 2.0 AS DOUBLE) AS pb_ratio,
  CAST((s_suppkey % 9 - 1) / 200.0 AS DOUBLE) AS dividend_yield,
  CAST((s_suppkey % 13 - 2) / 40.0 AS DOUBLE) AS roe,
  CAST((s_suppkey % 17) / 10.0 AS DOUBLE) AS debt_to_equity
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_fund": """
SELECT ticker, sector, market_cap_category, exchange, country, beta + c AS beta,
  CASE WHEN k % 10 = 3 THEN -pe_ratio ELSE pe_ratio END AS pe_ratio,
  pb_ratio, dividend_yield, roe, debt_to_equity
FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS k FROM fund) f
CROSS JOIN (VALUES (0), (1)) AS copies(c)
WHERE k % 19 <> 5 AND (c = 0 OR k % 7 = 0)""",
    "clean_fund": """
SELECT ticker, sector, market_cap_category, exchange, country, beta,
  CASE WHEN pe_ratio > 200 THEN NULL ELSE pe_ratio END AS pe_ratio, pb_ratio,
  CASE WHEN dividend_yield < 0 THEN 0.0 ELSE dividend_yield END AS dividend_yield, roe, debt_to_equity
FROM fund""",
    "listing": """
SELECT printf('S%05d', s_suppkey) || CASE WHEN s_suppkey % 10 = 0 THEN '.B' ELSE '' END AS ticker,
  s_name AS name, r_name AS sector, n_name AS sub_industry,
  CAST((1 + s_suppkey % 7) / 10.0 + c AS DOUBLE) AS weight_pct,
  CASE WHEN s_suppkey % 23 <> 4 THEN CAST(0.5 + (s_suppkey % 100) / 80.0 AS DOUBLE) END AS beta,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Large' ELSE 'Mid' END AS market_cap_cat, c
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
CROSS JOIN (VALUES (0), (1)) AS copies(c) WHERE c = 0 OR s_suppkey % 16 = 1""",
    "univ": """
SELECT replace(ticker, '.', '-') AS ticker, name, sector, sub_industry, weight_pct, beta, market_cap_cat
FROM listing WHERE c = 0""",
    "ret": f"""
SELECT *, (close - prev_close) / NULLIF(prev_close, 0) AS daily_return,
  ln(close / NULLIF(prev_close, 0)) AS log_return
FROM (SELECT *, lag(close) OVER {W} AS prev_close FROM bars) b""",
    "feat": feature_sql("ret"),
    "ret_only": "SELECT * FROM ret WHERE daily_return IS NOT NULL",
    "feat_nb": feature_sql("ret_only"),
    "eq_feat": """
SELECT f.* EXCLUDE (sector), coalesce(d.sector, f.sector) AS sector, d.market_cap_category, d.exchange,
  d.country, d.beta, d.pe_ratio, d.dividend_yield, d.roe,
  CASE WHEN sma_50 > sma_200 THEN 'Golden Cross' ELSE 'Death Cross' END AS ma_signal,
  CASE WHEN rsi_14 > 70 THEN 'Overbought' WHEN rsi_14 < 30 THEN 'Oversold' ELSE 'Neutral' END AS rsi_signal
FROM feat_nb f LEFT JOIN clean_fund d ON f.ticker = d.ticker""",
    "ranks": """
SELECT ticker, sector, market_cap_category, exchange, ROUND(close, 2) AS latest_close,
  ROUND(roc_252, 4) AS return_1y, ROUND(vol_20d, 4) AS vol_20d, ROUND(rsi_14, 1) AS rsi_14,
  ROUND(beta, 3) AS beta, ROUND(pe_ratio, 2) AS pe_ratio, ROUND(dividend_yield, 4) AS div_yield
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM eq_feat) l
WHERE n = 1 AND roc_252 IS NOT NULL""",
    "sector_perf": f"""
SELECT sector, count(DISTINCT ticker) AS n_equities, ROUND(avg(daily_return) * 252, 4) AS ann_avg_return,
  ROUND(stddev_samp(daily_return) * {ANN}, 4) AS ann_volatility,
  ROUND((avg(daily_return) * 252 - 0.05) / NULLIF(stddev_samp(daily_return) * {ANN}, 0), 4) AS sharpe_ratio,
  ROUND(avg(beta), 3) AS avg_beta, ROUND(avg(pe_ratio), 2) AS avg_pe,
  ROUND(count(*) FILTER (daily_return > 0) / CAST(count(daily_return) AS DOUBLE), 4) AS win_rate,
  ROUND(min(drawdown), 4) AS max_drawdown
FROM eq_feat WHERE date >= (SELECT max(date) - 252 FROM eq_feat) GROUP BY sector""",
    "capture": """
SELECT ticker, sector, beta, rb AS return_bull, rm AS return_base, rd AS return_bear,
  ROUND(rb / 0.25, 4) AS upside_capture, ROUND(rd / -0.30, 4) AS downside_capture,
  ROUND(ROUND(rb / 0.25, 4) / (abs(ROUND(rd / -0.30, 4)) + 1e-6), 4) AS capture_ratio
FROM (SELECT ticker, sector, beta, ROUND(CAST(CAST(0.05 + beta * (CAST(0.25 AS DOUBLE) - 0.05) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS rb,
    ROUND(CAST(CAST(0.05 + beta * (CAST(0.08 AS DOUBLE) - 0.05) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS rm,
    ROUND(CAST(CAST(0.05 + beta * (CAST(-0.30 AS DOUBLE) - 0.05) AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS rd
  FROM (SELECT DISTINCT ticker, sector, beta FROM eq_feat WHERE beta IS NOT NULL) b) x""",
    "silver": f"""
SELECT *, coalesce(abs(daily_return) > 0.5, false) AS is_outlier FROM (
  SELECT ticker, date, open, high, low, close, volume, sector,
    (close - lag(close) OVER {W}) / NULLIF(lag(close) OVER {W}, 0) AS daily_return,
    ln(close / NULLIF(lag(close) OVER {W}, 0)) AS log_return,
    count(date) OVER (PARTITION BY ticker) AS n_days
  FROM bronze WHERE {SANE.format(tol="0.999")}) s
WHERE n_days >= 252""",
    "silver_feat": f"""
SELECT *, (growth - max(growth) OVER {RUN}) / max(growth) OVER {RUN} AS drawdown,
  100 - 100 / (1 + gain / (loss + 1e-8)) AS rsi_14,
  mid + 2 * dev AS bb_upper, mid - 2 * dev AS bb_lower,
  (close - (mid - 2 * dev)) / (4 * dev + 1e-8) AS bb_pct
FROM (SELECT *,
    {", ".join(full("avg(close)", "close", n) + f" AS sma_{n}" for n in (20, 50, 200))},
    {full("avg(greatest(move, 0.0))", "move", 14)} AS gain,
    {full("avg(-least(move, 0.0))", "move", 14)} AS loss,
    {full("stddev_samp(r)", "r", 20)} * {ANN} AS vol_20d,
    {full("stddev_samp(r)", "r", 60)} * {ANN} AS vol_60d,
    {full("avg(close)", "close", 20)} AS mid, {full("stddev_samp(close)", "close", 20)} AS dev,
    product(1 + r) OVER {RUN} AS growth
  FROM (SELECT *, close - lag(close) OVER {W} AS move,
      (close - lag(close) OVER {W}) / NULLIF(lag(close) OVER {W}, 0) AS r,
      (close - lag(close, 20) OVER {W}) / NULLIF(lag(close, 20) OVER {W}, 0) AS roc_20,
      (close - lag(close, 252) OVER {W}) / NULLIF(lag(close, 252) OVER {W}, 0) AS roc_252
    FROM silver) m) q""",
    "gold": """
SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
  CASE WHEN roc_20 IS NULL THEN 'Normal'
    WHEN coalesce(drawdown, 0) <= -0.20 AND v >= 0.22 THEN 'Bear'
    WHEN v >= 0.22 THEN 'Volatile'
    WHEN roc_20 >= 0.03 AND coalesce(drawdown, 0) >= -0.05 THEN 'Bull'
    WHEN roc_20 >= 0.01 AND coalesce(drawdown, 0) >= -0.20 THEN 'Recovery'
    ELSE 'Normal' END AS market_scenario,
  ROUND(least(greatest(50.0 + least(25.0, coalesce(roc_252, 0.0) * 100)
    + (50.0 - coalesce(NULLIF(rsi_14, 0.0), 50.0)) * 0.3
    - coalesce(NULLIF(vol_20d, 0.0), 0.2) * 50.0, 0.0), 100.0), 1) AS signal_score
FROM (SELECT *, coalesce(NULLIF(vol_20d, 0.0), 0.15) AS v FROM silver_feat) s""",
    "mkt": "SELECT date, avg(daily_return) AS mkt_return FROM ret GROUP BY date",
    # Fixed values, spelled out here so that a wrong one in the engine shows.
    "scen": """SELECT * FROM (VALUES ('Bull', CAST(0.25 AS DOUBLE), CAST(0.75 AS DOUBLE)), ('Base', 0.08, 1.00),
  ('Bear', -0.30, 1.80), ('Stagflation', -0.15, 1.40), ('Rate Shock', -0.10, 1.30))
  AS t(scenario_name, mkt_return_shock, vol_multiplier)""",
    "last_day": "SELECT max(date) AS d FROM bars",
    "snapshot": """
SELECT f.*, s.close, s.daily_return AS return_1d, s.roc_252 AS return_1y, s.vol_20d, s.rsi_14, s.momentum_zscore
FROM clean_fund f LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM feat) s
ON f.ticker = s.ticker AND s.n = 1""",
}


def horizon_sql(by, table="bars"):
    end = "(SELECT d FROM last_day)"
    spans = {"return_1m": 1, "return_3m": 3, "return_6m": 6, "return_1y": 12, "return_3y_ann": 36,
             "return_5y_ann": 60, "return_10y_ann": 120, "return_20y_ann": 240}
    cells = []
    for name, m in spans.items():
        base = f"avg(close) FILTER (date <= {end} - INTERVAL {m} MONTH)"
        total = f"(avg(close) - {base}) / NULLIF({base}, 0)"
        cells.append(
            f"{total} AS {name}" if m <= 12 else f"pow(1 + {total}, 1.0 / {m // 12}) - 1 AS {name}"
        )
    keys = ", ".join(by)
    return f"SELECT {keys}, {', '.join(cells)} FROM {table} GROUP BY {keys}"


def asof_sql():
    end = "(SELECT d FROM last_day)"
    spans = {"return_1m": 1, "return_3m": 3, "return_6m": 6, "return_1y": 12, "return_3y_ann": 36,
             "return_5y_ann": 60, "return_10y_ann": 120, "return_20y_ann": 240}
    cells = []
    for name, m in spans.items():
        base = f"arg_max(close, date) FILTER (date <= {end} - INTERVAL {m} MONTH)"
        total = f"(arg_max(close, date) - {base}) / NULLIF({base}, 0)"
        cells.append(
            f"{total} AS {name}" if m <= 12 else f"pow(1 + {total}, 1.0 / {m // 12}) - 1 AS {name}"
        )
    return f"SELECT ticker, any_value(sector) AS sector, {', '.join(cells)} FROM bars GROUP BY ticker"


def risk_sql(source, by, periods=252):
    """Fifteen metrics per group over (by, date, r), of which ``periods`` make a year."""
    g, path = f"PARTITION BY {by}", f"PARTITION BY {by} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
SELECT {by}, ROUND(tot, 6) AS total_return, ROUND(ann, 6) AS annualised_return,
  ROUND(vol, 6) AS annualised_volatility,
  ROUND(CASE WHEN vol > 0 THEN (ann - 0.05) / vol ELSE 0.0 END, 4) AS sharpe_ratio,
  ROUND(CASE WHEN down > 0 THEN (ann - 0.05) / down ELSE 0.0 END, 4) AS sortino_ratio,
  ROUND(mdd, 6) AS max_drawdown,
  ROUND(CASE WHEN mdd < 0 THEN ann / abs(mdd) ELSE 0.0 END, 4) AS calmar_ratio,
  ROUND(m - 1.6449 * s, 6) AS var_95, ROUND(coalesce(tail, m - 1.6449 * s), 6) AS cvar_95,
  ROUND(m - 2.3263 * s, 6) AS var_99, ROUND(wins, 4) AS win_rate, ROUND(best, 6) AS best_day,
  ROUND(worst, 6) AS worst_day, ROUND(sk, 4) AS skewness, ROUND(ku, 4) AS kurtosis
FROM (SELECT *, pow(1 + tot, 1 / greatest(n / {periods}.0, 1.0)) - 1 AS ann, s * sqrt({periods}.0) AS vol,
    CASE WHEN n_down > 1 THEN s_down * sqrt({periods}.0) ELSE s * sqrt({periods}.0) END AS down
  FROM (SELECT {by}, count(r) AS n, product(1 + r) - 1 AS tot, avg(r) AS m, stddev_samp(r) AS s,
      stddev_samp(r) FILTER (r < 0) AS s_down, count(r) FILTER (r < 0) AS n_down,
      min((cum - peak) / peak) AS mdd, avg(r) FILTER (r <= gm - 1.6449 * gs) AS tail,
      count(r) FILTER (r > 0) / CAST(count(r) AS DOUBLE) AS wins, max(r) AS best, min(r) AS worst,
      skewness(r) AS sk, kurtosis(r) AS ku
    FROM (SELECT *, max(cum) OVER ({path}) AS peak FROM (
      SELECT {by}, date, r, avg(r) OVER ({g}) AS gm, stddev_samp(r) OVER ({g}) AS gs,
        product(1 + r) OVER ({path}) AS cum FROM {source} WHERE r IS NOT NULL) c) p
    GROUP BY {by} HAVING count(r) >= 2) a) z"""


def compose(sql, extra=None):
    """Prefix a statement with the table expressions it needs, in dependency order."""
    known = {**CTES, **(extra or {})}
    order = []

    def need(text, above=()):
        for name in known:
            if name not in above and name not in order and re.search(rf"\b{name}\b", text):
                need(known[name], (*above, name))
                order.append(name)

    need(sql)
    if not order:
        return sql
    recursive = "RECURSIVE " if any("UNION ALL SELECT r." in known[n] for n in order) else ""
    body = ",\n".join(f"{n} AS ({known[n].strip()})" for n in order)
    return f"WITH {recursive}{body}\n{sql.strip()}"
