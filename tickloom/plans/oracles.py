"""For each query that SQL can express, the same result in ANSI-style SQL."""

from __future__ import annotations

from tickloom.operators.dashboard import LOOKBACK_DAYS
from tickloom.schemas import FEATURE_COLUMNS

AS_OF = "DATE '2001-11-01'"
CUT, OVERLAP = "DATE '1999-01-01'", "DATE '1998-01-01'"
LOADED_AT = "TIMESTAMP '2024-01-01 00:00:00'"

# Common table expressions, each with the names of those it reads.
_PARTS: dict[str, tuple[str, str]] = {
    "stocks": ("", """
        SELECT CAST(dense_rank() OVER (ORDER BY symbol) AS INTEGER) AS stock_id, symbol,
               symbol AS company_name
        FROM (SELECT DISTINCT p_brand AS symbol FROM part)"""),
    "trades": ("", """
        SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
               l_extendedprice / NULLIF(l_quantity, 0) AS price, l_quantity AS quantity,
               ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)
                   AS trade_order
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "symbol_bars": ("trades", """
        SELECT symbol, trade_date, arg_min(price, trade_order) AS open, max(price) AS high,
               min(price) AS low, arg_max(price, trade_order) AS close,
               CAST(sum(quantity) AS BIGINT) AS volume
        FROM trades GROUP BY symbol, trade_date"""),
    "bars": ("symbol_bars stocks", """
        SELECT stock_id, trade_date, open, high, low, close, volume
        FROM symbol_bars JOIN stocks USING (symbol)"""),
    "prices": ("bars", """
        SELECT stock_id, trade_date, open AS open_price, high AS high_price, low AS low_price,
               close AS close_price, volume FROM bars"""),
    "all_features": ("bars", """
        SELECT *, close / NULLIF(lag(close) OVER w, 0) - 1 AS daily_return,
               close - open AS price_difference, (high - low) / NULLIF(open, 0) AS volatility,
               avg(close) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7,
               avg(close) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ma_30,
               volume * (close - open) / NULLIF(open, 0) AS capital_flow_indicator,
               count(*) OVER (PARTITION BY stock_id) AS n
        FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)"""),
    "features": ("all_features", f"""
        SELECT stock_id, trade_date, close, {', '.join(FEATURE_COLUMNS)}
        FROM all_features WHERE n >= 2"""),
    "typical": ("bars", """
        SELECT *, (high + low + close) / 3 AS typical_price,
               (high + low + close) / 3 * volume AS raw_money_flow,
               count(*) OVER (PARTITION BY stock_id) AS n FROM bars"""),
    "directed": ("typical", """
        SELECT *, CASE WHEN typical_price > lag(typical_price) OVER w THEN 1
                       WHEN typical_price < lag(typical_price) OVER w THEN -1 ELSE 0 END
                  AS flow_direction
        FROM typical WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)"""),
    "split_flow": ("directed", """
        SELECT *, CASE WHEN flow_direction = 1 THEN raw_money_flow ELSE 0.0 END AS inflow,
               CASE WHEN flow_direction = -1 THEN raw_money_flow ELSE 0.0 END AS outflow
        FROM directed"""),
    "summed_flow": ("split_flow", """
        SELECT *, inflow - outflow AS net_flow,
               sum(inflow) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS inflow_14,
               sum(outflow) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS outflow_14,
               sum(inflow - outflow) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_flow
        FROM split_flow WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)"""),
    "flows": ("summed_flow", """
        SELECT stock_id, trade_date, typical_price, raw_money_flow, flow_direction, inflow,
               outflow, inflow_14, outflow_14, net_flow, cumulative_flow,
               100 - 100 / NULLIF(1 + inflow_14 / NULLIF(outflow_14, 0), 0) AS mfi_14
        FROM summed_flow WHERE n >= 15"""),
    "predictions": ("features", """
        SELECT stock_id, CAST(trade_date + CASE dayofweek(trade_date) WHEN 5 THEN 3 WHEN 6 THEN 2
               ELSE 1 END AS DATE) AS prediction_date,
               CASE model_name WHEN 'linear_regression' THEN close WHEN 'xgboost' THEN ma_7
               ELSE ma_30 END AS predicted_close, model_name,
               CAST(trade_date AS TIMESTAMP) AS created_at
        FROM features, (VALUES ('linear_regression'), ('xgboost'), ('stacking')) v(model_name)"""),
    "anomalies": ("features", """
        SELECT stock_id, trade_date, 0.8::DOUBLE - abs(daily_return) AS anomaly_score,
               0.8::DOUBLE - abs(daily_return) < 0 AS anomaly_flag,
               'isolation_forest' AS model_name, CAST(trade_date AS TIMESTAMP) AS created_at
        FROM features WHERE daily_return IS NOT NULL"""),
    "feed": ("", """
        SELECT event_id AS seq, event_type || '-' || CAST(user_id AS VARCHAR) AS symbol,
               CAST(ts AS DATE) AS date,
               CASE WHEN k < 5 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS open,
               CASE WHEN k = 7 THEN value - 1 ELSE value + 1 END AS high,
               CASE WHEN k = 11 THEN -1.0::DOUBLE ELSE value - 0.5::DOUBLE END AS low,
               CASE WHEN k > 94 THEN NULL ELSE value END AS close,
               CASE WHEN k = 13 THEN 0.0::DOUBLE WHEN k = 17 THEN 2.5::DOUBLE
                    ELSE CAST(k AS DOUBLE) END AS volume
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"""),
    "coerced": ("feed", """
        SELECT seq, symbol, date, TRY_CAST(open AS DOUBLE) AS open, high, low, close,
               CAST(trunc(volume) AS BIGINT) AS volume
        FROM feed"""),
    "clean": ("feed coerced", """
        SELECT seq, symbol, date, open, high, low, close, volume FROM (
            SELECT c.*, row_number() OVER (PARTITION BY c.symbol, c.date ORDER BY c.seq) AS r
            FROM coerced c JOIN feed f ON c.seq = f.seq
            WHERE f.open IS NOT NULL AND f.high IS NOT NULL AND f.low IS NOT NULL
              AND f.close IS NOT NULL AND f.volume IS NOT NULL)
        WHERE r = 1"""),
    "gapped": ("clean", """
        SELECT *, date_diff('day', lag(date) OVER (PARTITION BY symbol ORDER BY date), date)
               AS gap_days FROM clean"""),
    "quality": ("gapped", """
        SELECT symbol, count(*) AS n, CAST(count_if(open IS NULL) AS BIGINT) AS null_open,
               CAST(count_if(high IS NULL) AS BIGINT) AS null_high,
               CAST(count_if(low IS NULL) AS BIGINT) AS null_low,
               CAST(count_if(close IS NULL) AS BIGINT) AS null_close,
               CAST(count_if(volume IS NULL) AS BIGINT) AS null_volume,
               CAST(count_if(volume = 0) AS BIGINT) AS zero_volume,
               CAST(count_if(open <= 0) AS BIGINT) AS non_positive_open,
               CAST(count_if(high <= 0) AS BIGINT) AS non_positive_high,
               CAST(count_if(low <= 0) AS BIGINT) AS non_positive_low,
               CAST(count_if(close <= 0) AS BIGINT) AS non_positive_close,
               CAST(count_if(high < low) AS BIGINT) AS high_below_low,
               CAST(count_if(gap_days > 5) AS BIGINT) AS gaps,
               max(CASE WHEN gap_days > 5 THEN gap_days END) AS max_gap
        FROM gapped GROUP BY symbol"""),
    "issues": ("quality", """
        SELECT symbol, 1 AS place, printf('Null values found: {%s}', concat_ws(', ',
               CASE WHEN null_open > 0 THEN printf('''open'': %d', null_open) END,
               CASE WHEN null_high > 0 THEN printf('''high'': %d', null_high) END,
               CASE WHEN null_low > 0 THEN printf('''low'': %d', null_low) END,
               CASE WHEN null_close > 0 THEN printf('''close'': %d', null_close) END,
               CASE WHEN null_volume > 0 THEN printf('''volume'': %d', null_volume) END)) AS issue
        FROM quality
        WHERE null_open + null_high + null_low + null_close + null_volume > 0
        UNION ALL SELECT symbol, 2, printf('%d rows with zero volume', zero_volume)
        FROM quality WHERE zero_volume > 0
        UNION ALL SELECT symbol, 3, printf('%d rows with non-positive open', non_positive_open)
        FROM quality WHERE non_positive_open > 0
        UNION ALL SELECT symbol, 4, printf('%d rows with non-positive high', non_positive_high)
        FROM quality WHERE non_positive_high > 0
        UNION ALL SELECT symbol, 5, printf('%d rows with non-positive low', non_positive_low)
        FROM quality WHERE non_positive_low > 0
        UNION ALL SELECT symbol, 6, printf('%d rows with non-positive close', non_positive_close)
        FROM quality WHERE non_positive_close > 0
        UNION ALL SELECT symbol, 7, printf('%d rows where high < low', high_below_low)
        FROM quality WHERE high_below_low > 0
        UNION ALL SELECT symbol, 8, printf('%d date gaps > 5 days found (max gap: %.1f days)',
               gaps, CAST(max_gap AS DOUBLE)) FROM quality WHERE gaps > 0"""),
    "report": ("feed quality issues", """
        SELECT s.symbol, q.n IS NOT NULL AND count(i.issue) = 0 AS passed,
               CASE WHEN q.n IS NULL THEN 'DataFrame is empty'
                    ELSE coalesce(string_agg(i.issue, '; ' ORDER BY i.place), '') END AS issues
        FROM (SELECT DISTINCT symbol FROM feed) s LEFT JOIN quality q USING (symbol)
        LEFT JOIN issues i USING (symbol) GROUP BY s.symbol, q.n"""),
    "training": ("features", """
        SELECT * FROM (
            SELECT f.*, close AS close_price,
                   lead(close) OVER (PARTITION BY stock_id ORDER BY trade_date) AS target,
                   count(*) OVER (PARTITION BY stock_id) AS joined_rows FROM features f)
        WHERE joined_rows >= 60 AND target IS NOT NULL AND daily_return IS NOT NULL
          AND price_difference IS NOT NULL AND volatility IS NOT NULL AND ma_7 IS NOT NULL
          AND ma_30 IS NOT NULL AND capital_flow_indicator IS NOT NULL"""),
    "positioned": ("training", """
        SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date) AS position,
               count(*) OVER (PARTITION BY stock_id) AS total FROM training"""),
    "split": ("positioned", """
        SELECT *, position <= floor(total * 0.8::DOUBLE) AS is_train FROM positioned"""),
    "folded": ("split", """
        SELECT s.*, f.fold FROM split s LEFT JOIN (
            SELECT stock_id, trade_date, CAST(ntile(5) OVER (PARTITION BY stock_id
                   ORDER BY trade_date) - 1 AS INTEGER) AS fold
            FROM split WHERE is_train) f USING (stock_id, trade_date)"""),
    "naive_scores": ("split", """
        SELECT stock_id, target, model_name, CASE model_name WHEN 'linear_regression'
               THEN close_price WHEN 'xgboost' THEN ma_7 ELSE ma_30 END AS predicted
        FROM split, (VALUES ('linear_regression'), ('xgboost'), ('stacking')) v(model_name)
        WHERE NOT is_train"""),
    "metrics": ("naive_scores", """
        SELECT stock_id, model_name, count(*) AS "rows",
               sqrt(avg((predicted - target) * (predicted - target))) AS rmse,
               avg(abs(predicted - target)) AS mae,
               CASE WHEN count(*) < 2 THEN NULL
                    WHEN min(target) = max(target) THEN
                        CASE WHEN sum(abs(predicted - target)) = 0 THEN 1.0 ELSE 0.0 END
                    ELSE 1 - sum((predicted - target) * (predicted - target))
                        / (var_pop(target) * count(*)) END AS r2
        FROM naive_scores GROUP BY stock_id, model_name"""),
    "centred": ("split", """
        SELECT stock_id, count(*) OVER s AS n, avg(ma_7) OVER s AS ma, avg(ma_30) OVER s AS mb,
               avg(target) OVER s AS my, ma_7 - avg(ma_7) OVER s AS x,
               ma_30 - avg(ma_30) OVER s AS z, target - avg(target) OVER s AS y
        FROM split WHERE is_train WINDOW s AS (PARTITION BY stock_id)"""),
    "products": ("centred", """
        SELECT stock_id, n, ma, mb, my, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz,
               sum(x * y) AS xy, sum(z * y) AS zy
        FROM centred GROUP BY stock_id, n, ma, mb, my"""),
    "ridges": ("products", """
        SELECT *, (pb * xy - xz * zy) / (pa * pb - xz * xz) AS wa,
               (pa * zy - xz * xy) / (pa * pb - xz * xz) AS wb
        FROM (SELECT *, xx + alpha AS pa, zz + alpha AS pb FROM products,
              (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) v(alpha))"""),
    "left_out": ("centred ridges", """
        SELECT r.stock_id, alpha, sum(pow((y - wa * x - wb * z) / (1 - 1.0 / r.n
               - (pb * x * x - 2 * xz * x * z + pa * z * z) / (pa * pb - xz * xz)), 2)) AS loo
        FROM centred c JOIN ridges r ON c.stock_id = r.stock_id GROUP BY r.stock_id, alpha"""),
    # The best of all cuts at 256-quantiles of two columns, by second-order gain.
    "cut_rows": ("split", """
        SELECT stock_id, trade_date, b, b - target AS g, f, v
        FROM (SELECT *, avg(target) OVER (PARTITION BY stock_id) AS b FROM split WHERE is_train),
             LATERAL (VALUES (0, ma_7), (1, ma_30)) x(f, v)"""),
    "cuts": ("cut_rows", """
        SELECT DISTINCT stock_id, f, vs[CAST(ceil(k / 256.0::DOUBLE * len(vs)) AS BIGINT)] AS cut
        FROM (SELECT stock_id, f, list(v ORDER BY v) AS vs FROM cut_rows GROUP BY stock_id, f),
             range(1, 256) r(k)"""),
    "cut_gains": ("cut_rows cuts", """
        SELECT *, lg * lg / (lh + 1) + rg * rg / (rh + 1) - pow(lg + rg, 2) / (lh + rh + 1) AS gain
        FROM (SELECT c.stock_id, c.f, cut, sum(g) FILTER (v <= cut) AS lg, count(*) FILTER (v <= cut) AS lh,
                     sum(g) FILTER (v > cut) AS rg, count(*) FILTER (v > cut) AS rh
              FROM cuts c JOIN cut_rows r ON c.stock_id = r.stock_id AND c.f = r.f GROUP BY c.stock_id, c.f, cut)
        WHERE lh >= 1 AND rh >= 1
        QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY gain DESC, f, cut) = 1"""),
    "volume_changes": ("features bars", """
        SELECT b.stock_id, b.trade_date, b.close AS close_price, b.volume, f.daily_return,
               f.volatility, count(*) OVER (PARTITION BY b.stock_id) AS joined_rows,
               b.volume / NULLIF(CAST(lag(b.volume) OVER (PARTITION BY b.stock_id
                   ORDER BY b.trade_date) AS DOUBLE), 0) - 1 AS volume_change_pct
        FROM bars b JOIN features f USING (stock_id, trade_date)"""),
    "anomaly_rows": ("volume_changes", """
        SELECT * EXCLUDE (joined_rows) FROM (
            SELECT *, count(*) OVER (PARTITION BY stock_id) AS "rows" FROM volume_changes
            WHERE joined_rows >= 30 AND daily_return IS NOT NULL AND volatility IS NOT NULL
              AND volume_change_pct IS NOT NULL)
        WHERE "rows" >= 30"""),
    "overview": ("prices stocks", """
        SELECT symbol, company_name, close, close - prev_close AS change,
               (close - prev_close) / NULLIF(prev_close, 0) * 100 AS change_pct,
               high, low, volume, trade_date
        FROM (SELECT stock_id, max(close_price) FILTER (r = 1) AS close,
                     max(close_price) FILTER (r = 2) AS prev_close,
                     max(high_price) FILTER (r = 1) AS high,
                     max(low_price) FILTER (r = 1) AS low, max(volume) FILTER (r = 1) AS volume,
                     max(trade_date) FILTER (r = 1) AS trade_date, count(*) AS n
              FROM (SELECT *, row_number() OVER (PARTITION BY stock_id
                           ORDER BY trade_date DESC) AS r FROM prices)
              WHERE r <= 2 GROUP BY stock_id)
        JOIN stocks USING (stock_id) WHERE n = 2"""),
    "event_bars": ("", """
        SELECT event_type AS symbol, CAST(ts AS DATE) AS trade_date,
               arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
               arg_max(value, ROW(ts, event_id)) AS close, count(*) AS volume
        FROM events GROUP BY event_type, CAST(ts AS DATE)"""),
}


#: How many of count(*) distinct values are less than their interpolated 5th percentile.
BELOW_QUANTILE = "CAST(ceil((count(*) - 1) * 0.05::DOUBLE) AS BIGINT)"


def _with(needed: str, body: str) -> str:
    """The statement with the common table expressions it needs, in order of dependence."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _PARTS[name][0].split():
            add(other)
        if name not in order:
            order.append(name)

    for name in needed.split():
        add(name)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{name} AS ({_PARTS[name][1]})" for name in order)
    return f"WITH {parts}\n{body.strip()}"


def _fitted_linear() -> str:
    """Fitted values of least squares on the six features, by making the columns orthogonal one after the other."""
    names = [f"x{i}" for i in range(len(FEATURE_COLUMNS))]
    columns = [*zip(names, FEATURE_COLUMNS), ("y", "target")]
    steps = ["o0 AS (SELECT stock_id, trade_date, target, " + ", ".join(
        f"{c} - avg({c}) OVER (PARTITION BY stock_id) AS {n}" for n, c in columns) + " FROM split WHERE is_train)"]
    for i, name in enumerate(names):
        rest = [*names[i + 1:], "y"]
        steps.append(f"o{i + 1} AS (SELECT stock_id, trade_date, target, " + ", ".join(
            f"{n} - {name} * coalesce(sum({n} * {name}) OVER w / NULLIF(sum({name} * {name}) OVER w, 0), 0) AS {n}"
            for n in rest) + f" FROM o{i} WINDOW w AS (PARTITION BY stock_id))")
    body = f"SELECT stock_id, trade_date, {r('target - y', 4, 'fitted')} FROM o{len(names)}"
    whole = _with("split", "")
    return ",\n".join([whole.rstrip(), *steps]) + "\n" + body


def r(expression: str, places: int = 6, name: str = "") -> str:
    """A rounded column; negative zero becomes zero."""
    scale = f"{10 ** places}::DOUBLE"
    value = f"floor(({expression})::DOUBLE * {scale} + 0.5) / {scale}"
    return f"{value} + 0.0::DOUBLE AS {name or expression.split('.')[-1]}"


def rs(columns: str, places: int = 6) -> str:
    return ", ".join(r(c, places) for c in columns.split())


def half_up(expression: str, places: int = 2) -> str:
    """Rounded half up on the shortest decimal text of the number, as Java formats."""
    return (f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 18)), {places}) "
            f"AS DOUBLE)")


def keep_sign(expression: str) -> str:
    """A negative number that rounds to zero is shown as -0.00."""
    return (f"CASE WHEN {expression} < 0 AND {half_up(expression)} = 0 THEN -0.0::DOUBLE "
            f"ELSE {half_up(expression)} END")


def money(expression: str) -> str:
    return f"printf('$%.2f', {half_up(expression)})"


def signed(expression: str, after: str = "") -> str:
    return f"printf('%+.2f{after}', {keep_sign(expression)})"


def delta(change: str, percent: str) -> str:
    return f"printf('%+.2f (%+.2f%%)', {keep_sign(change)}, {keep_sign(percent)})"


OHLC = "open high low close"
PRICES = "open_price high_price low_price close_price"
FEATURES = " ".join(FEATURE_COLUMNS)
_MFI_SIGNAL = ("CASE WHEN {0} > 80 THEN 'Overbought' WHEN {0} < 20 THEN 'Oversold' "
               "ELSE 'Neutral' END")
_PREDICTION = f"stock_id, prediction_date, {r('predicted_close')}, model_name, created_at"


def _lookbacks() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS lookback, stock_id, {r('first_close')}, {r('latest_close')},
            {r('avg_volume')}, {r('period_high')}, {r('period_low')},
            {r('latest_close - first_close', name='period_change')},
            {r('(latest_close - first_close) / NULLIF(first_close, 0) * 100',
               name='period_change_pct')}
        FROM (SELECT stock_id, arg_min(close_price, trade_date) AS first_close,
                     arg_max(close_price, trade_date) AS latest_close,
                     avg(volume) AS avg_volume, max(high_price) AS period_high,
                     min(low_price) AS period_low
              FROM prices {f'WHERE trade_date >= {AS_OF} - {days}' if days else ''}
              GROUP BY stock_id)"""
        for name, days in LOOKBACK_DAYS.items())


def _ranges() -> str:
    starts = {"1m": "last_date - INTERVAL 1 MONTH", "3m": "last_date - INTERVAL 3 MONTH",
              "6m": "last_date - INTERVAL 6 MONTH", "ytd": "date_trunc('year', last_date)",
              "1y": "last_date - INTERVAL 12 MONTH", "all": "DATE '0001-01-01'"}
    return "\nUNION ALL\n".join(
        f"""SELECT stock_id, count(*) AS "rows", min(trade_date) AS first_date,
                   max(trade_date) AS last_date, '{button}' AS button
            FROM (SELECT *, max(trade_date) OVER (PARTITION BY stock_id) AS last_date FROM prices)
            WHERE trade_date >= {start} GROUP BY stock_id"""
        for button, start in starts.items())


def oracles() -> dict[str, str]:
    flow_rows = "stock_id, trade_date"
    sql = {
        "parse_candles": _with("symbol_bars", f"""
            SELECT symbol, trade_date AS date, {rs(OHLC)}, CAST(volume AS DOUBLE) AS volume
            FROM symbol_bars"""),
        "read_history": _with("symbol_bars", f"""
            SELECT symbol, trade_date AS date, {rs(OHLC)}, volume FROM symbol_bars"""),
        "resolve_sources": _with("symbol_bars", f"""
            SELECT symbol, trade_date, {rs(OHLC)}, volume FROM symbol_bars
            WHERE (symbol < 'Brand#2' AND volume >= 10) OR symbol NOT IN
                (SELECT symbol FROM symbol_bars WHERE symbol < 'Brand#2' AND volume >= 10)"""),
        "parse_quotes": f"""
            SELECT event_type AS symbol, {r('value', name='open')},
                   {r('value + 1', name='high')}, {r('value - 1', name='low')},
                   {r('value', name='close')}, {r('value', name='previous_close')},
                   CAST(NULL AS BIGINT) AS volume, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp
            FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
            WHERE k >= 5 AND k <> 7 AND value <> 0""",
        "latest_bar": _with("prices", f"""
            SELECT stock_id, trade_date, {rs(PRICES)}, volume
            FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) r
                  FROM prices WHERE trade_date BETWEEN {AS_OF} - 3 AND {AS_OF}) WHERE r = 1"""),
        "scan_stocks": _with("stocks", "SELECT * FROM stocks ORDER BY symbol"),
        "load_prices": _with("prices", f"""
            SELECT stock_id, trade_date, {rs(PRICES)}, volume FROM prices
            WHERE trade_date >= {AS_OF} - 365"""),
        "load_features": _with("features", f"SELECT stock_id, trade_date, {rs(FEATURES)} FROM features"),
        "load_predictions": _with("predictions", f"SELECT {_PREDICTION} FROM predictions"),
        "load_anomalies": _with("anomalies", f"""
            SELECT stock_id, trade_date, {r('anomaly_score')}, anomaly_flag, model_name, created_at
            FROM anomalies"""),
        "price_series": _with("bars", f"SELECT stock_id, trade_date, {rs(OHLC)}, volume FROM bars"),
        "backfill_window": _with("prices", f"""
            SELECT stock_id, trade_date, {rs(PRICES)}, volume FROM prices
            WHERE trade_date BETWEEN {AS_OF} - 365 AND {AS_OF}"""),
        "universe": _with("symbol_bars", f"""
            SELECT symbol, trade_date, {rs(OHLC)}, volume, symbol || ' Inc.' AS company_name
            FROM symbol_bars WHERE symbol >= 'Brand#2'"""),
        "ensure_stocks": _with("stocks", """
            SELECT stock_id, symbol, company_name FROM stocks WHERE symbol < 'Brand#2'
            UNION ALL
            SELECT CAST((SELECT count(*) FROM stocks WHERE symbol < 'Brand#2')
                        + row_number() OVER (ORDER BY symbol) AS INTEGER),
                   symbol, symbol || ' Inc.' FROM stocks WHERE symbol >= 'Brand#2'"""),
        "assert_unique_key": _with("trades", """
            SELECT symbol, trade_date, count(*) AS copies FROM trades
            GROUP BY symbol, trade_date HAVING count(*) > 1"""),
        "upsert_prices": _with("prices", f"""
            SELECT stock_id, trade_date, {rs('open_price high_price low_price')},
                   {r(f'''CASE WHEN trade_date >= {OVERLAP} AND high_price > 3000
                          THEN close_price * 2 ELSE close_price END''', name='close_price')},
                   CASE WHEN trade_date >= {OVERLAP} AND high_price > 3000 AND volume <= 20
                        THEN 0 ELSE volume END AS volume, {LOADED_AT} AS created_at
            FROM prices"""),
        "upsert_features": _with("features", f"""
            SELECT stock_id, trade_date, {rs('daily_return price_difference')},
                   {r(f'''CASE WHEN trade_date < {OVERLAP} THEN volatility
                          WHEN volatility <> 0 THEN volatility + 1 END''', name='volatility')},
                   {rs('ma_7 ma_30 capital_flow_indicator')}, {LOADED_AT} AS created_at
            FROM features"""),
        "append_predictions": _with("predictions", f"""
            SELECT stock_id, model_name, 2 * count(*) AS "rows",
                   {r('2 * sum(predicted_close)', 2, 'total')}
            FROM predictions GROUP BY stock_id, model_name"""),
        "append_anomalies": _with("anomalies", f"""
            SELECT stock_id, trade_date, {r('anomaly_score')}, anomaly_flag, model_name,
                   {LOADED_AT} AS created_at FROM anomalies"""),
        "drop_null_ohlcv": _with("feed", f"""
            SELECT seq, symbol, CAST(date AS VARCHAR) AS date,
                   {r('TRY_CAST(open AS DOUBLE)', name='open')}, {rs('high low close volume')}
            FROM feed WHERE close IS NOT NULL"""),
        "dedup_dates": _with("feed", f"""
            SELECT seq, symbol, CAST(date AS VARCHAR) AS date,
                   {r('TRY_CAST(open AS DOUBLE)', name='open')}, {rs('high low close volume')}
            FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq) AS r
                  FROM feed) WHERE r = 1"""),
        "coerce_types": _with("coerced", f"SELECT seq, symbol, date, {rs(OHLC)}, volume FROM coerced"),
        "clean_stock_data": _with("clean", f"SELECT seq, symbol, date, {rs(OHLC)}, volume FROM clean"),
        "cleaning_report": _with("feed clean", """
            SELECT f.symbol, initial_rows, coalesce(kept, 0) AS kept_rows,
                   initial_rows - coalesce(kept, 0) AS dropped_rows
            FROM (SELECT symbol, count(*) AS initial_rows FROM feed GROUP BY symbol) f
            LEFT JOIN (SELECT symbol, count(*) AS kept FROM clean GROUP BY symbol) c
            USING (symbol)"""),
        "dq_nulls": _with("quality", """
            SELECT symbol, null_open, null_high, null_low, null_close, null_volume FROM quality"""),
        "dq_zero_volume": _with("quality", "SELECT symbol, zero_volume FROM quality"),
        "dq_nonpositive": _with("quality", """
            SELECT symbol, non_positive_open, non_positive_high, non_positive_low,
                   non_positive_close FROM quality"""),
        "dq_high_low": _with("quality", "SELECT symbol, high_below_low FROM quality"),
        "dq_gaps": _with("quality", "SELECT symbol, gaps, CAST(max_gap AS INTEGER) AS max_gap FROM quality"),
        "validate_quality": _with("report", "SELECT symbol, passed, issues FROM report"),
        "dq_gate": _with("clean report", f"""
            SELECT seq, symbol, date, {rs(OHLC)}, volume, 'warn' AS policy FROM clean
            UNION ALL
            SELECT seq, symbol, date, {rs(OHLC)}, volume, 'drop_symbol' FROM clean
            WHERE symbol IN (SELECT symbol FROM report WHERE passed)"""),
        "load_casts": _with("clean", f"""
            SELECT seq, symbol, date, {rs(OHLC)}, coalesce(volume, 0) AS volume FROM clean"""),
        "join_training": _with("features", f"""
            SELECT stock_id, trade_date, {r('close', name='close_price')}, {rs(FEATURES)}
            FROM features"""),
        "join_anomaly_input": _with("volume_changes", f"""
            SELECT stock_id, trade_date, {r('close_price')}, volume,
                   {rs('daily_return volatility')} FROM volume_changes"""),
        "join_pred_actual": _with("predictions prices", f"""
            SELECT p.stock_id, prediction_date, {r('predicted_close')}, model_name, created_at,
                   {r('close_price')}
            FROM predictions p LEFT JOIN prices r
            ON p.stock_id = r.stock_id AND prediction_date = trade_date"""),
        "join_anomaly_price": _with("anomalies prices", f"""
            SELECT a.stock_id, a.trade_date, {r('anomaly_score')}, anomaly_flag, model_name,
                   created_at, {r('close_price')}
            FROM anomalies a LEFT JOIN prices p USING (stock_id, trade_date)
            WHERE anomaly_flag"""),
        "semi_features": _with("features", f"""
            SELECT stock_id, trade_date, {rs(FEATURES)} FROM features
            WHERE trade_date >= {AS_OF} - 180"""),
        "lookup_symbol": _with("prices stocks", """
            SELECT p.stock_id, trade_date, s.symbol,
                   coalesce(s.symbol, 'stock_' || CAST(p.stock_id AS VARCHAR)) AS symbol_or_id
            FROM prices p LEFT JOIN (SELECT * FROM stocks WHERE symbol < 'Brand#2') s
            USING (stock_id)"""),
        "stocks_x_prices": _with("prices stocks", f"""
            SELECT stock_id, trade_date, {rs(PRICES)}, volume, symbol, company_name
            FROM prices JOIN stocks USING (stock_id)"""),
        "symbol_maps": _with("stocks", """
            SELECT 'symbol_by_id' AS map_name, CAST(stock_id AS VARCHAR) AS key, symbol AS value
            FROM stocks
            UNION ALL SELECT 'name_by_symbol', symbol, company_name FROM stocks"""),
        "compute_features": _with("features", f"SELECT stock_id, trade_date, {rs(FEATURES)} FROM features"),
        "compute_features_for_stock": _with("features", f"""
            SELECT stock_id, trade_date, {rs(FEATURES)} FROM features WHERE stock_id = 7"""),
        "refreshed_features": _with("features", f"""
            SELECT stock_id, trade_date, {rs(FEATURES)} FROM features WHERE trade_date >= {CUT}"""),
        "typical_price": _with("flows", f"SELECT {flow_rows}, {r('typical_price')} FROM flows"),
        "raw_money_flow": _with("flows", f"SELECT {flow_rows}, {r('raw_money_flow', 2)} FROM flows"),
        "flow_direction": _with("flows", f"SELECT {flow_rows}, flow_direction FROM flows"),
        "inflow_outflow": _with("flows", f"SELECT {flow_rows}, {rs('inflow outflow', 2)} FROM flows"),
        "rolling_flow_14": _with("flows", f"SELECT {flow_rows}, {rs('inflow_14 outflow_14', 2)} FROM flows"),
        "mfi_14": _with("flows", f"SELECT {flow_rows}, {r('mfi_14')} FROM flows"),
        "net_flow": _with("flows", f"SELECT {flow_rows}, {r('net_flow', 2)} FROM flows"),
        "cumulative_flow": _with("flows", f"SELECT {flow_rows}, {r('cumulative_flow', 2)} FROM flows"),
        "compute_capital_flow": _with("flows", f"""
            SELECT {flow_rows}, {rs('typical_price mfi_14')}, flow_direction,
                   {rs('raw_money_flow inflow outflow net_flow', 2)}, {r('cumulative_flow', 2)}
            FROM flows"""),
        "market_overview": _with("overview", f"""
            SELECT symbol, company_name, {rs('close change change_pct high low')}, volume,
                   trade_date FROM overview"""),
        "kpi_cards": _with("overview", f"""
            SELECT symbol, {money('close')} AS value, {delta('change', 'change_pct')} AS delta
            FROM overview"""),
        "heatmap_series": _with("overview", f"""
            SELECT symbol, {r('change_pct')}, {signed('change_pct', '%%')} AS label
            FROM overview"""),
        "volume_comparison": _with("overview", """
            SELECT symbol, volume, format('{:,}', volume) AS label FROM overview"""),
        "summary_table": _with("overview", f"""
            SELECT symbol, company_name, {money('close')} AS close, {money('high')} AS high,
                   {money('low')} AS low, {signed('change')} AS change,
                   {signed('change_pct', '%%')} AS change_pct, format('{{:,}}', volume) AS volume,
                   strftime(trade_date, '%Y-%m-%d') AS trade_date FROM overview"""),
        "period_kpis": _with("prices", _lookbacks()),
        "candle_colors": _with("prices", """
            SELECT stock_id, trade_date, CASE WHEN close_price >= open_price THEN 'up'
                   ELSE 'down' END AS color FROM prices"""),
        "indicator_colors": _with("features", """
            SELECT stock_id, trade_date,
                   CASE WHEN daily_return >= 0 THEN 'up' ELSE 'down' END AS return_color,
                   CASE WHEN coalesce(capital_flow_indicator, 0) >= 0 THEN 'up' ELSE 'down' END
                   AS flow_color FROM features"""),
        "candles_with_ma": _with("prices features", f"""
            SELECT stock_id, trade_date, {rs(PRICES)}, volume,
                   CASE WHEN close_price >= open_price THEN 'up' ELSE 'down' END AS color,
                   {rs('ma_7 ma_30')}
            FROM prices LEFT JOIN features USING (stock_id, trade_date)
            WHERE trade_date >= {AS_OF} - 180"""),
        "distinct_models": _with("predictions", """
            SELECT model_name, max(prediction_date) AS latest_prediction
            FROM predictions GROUP BY model_name"""),
        "latest_prediction": _with("predictions", f"""
            SELECT {_PREDICTION}, CASE model_name WHEN 'linear_regression'
                   THEN 'Linear Regression' WHEN 'xgboost' THEN 'Xgboost' ELSE 'Stacking' END
                   AS model_title
            FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, model_name ORDER BY
                  prediction_date DESC, created_at DESC, predicted_close DESC) AS r
                  FROM predictions) WHERE r = 1"""),
        "prediction_accuracy": _with("predictions prices", f"""
            SELECT p.stock_id, model_name,
                   {r('avg(abs(predicted_close - close_price))', name='mae')},
                   {r('avg(abs(predicted_close - close_price) / NULLIF(close_price, 0) * 100)',
                      name='avg_error_pct')}, count(*) AS predictions
            FROM predictions p JOIN prices r
            ON p.stock_id = r.stock_id AND prediction_date = trade_date
            GROUP BY p.stock_id, model_name"""),
        "prediction_history": _with("predictions", f"""
            SELECT stock_id, strftime(prediction_date, '%Y-%m-%d') AS prediction_date,
                   {money('predicted_close')} AS predicted_close, model_name, created_at
            FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, model_name ORDER BY
                  prediction_date DESC, created_at DESC, predicted_close DESC) AS r
                  FROM predictions) WHERE r <= 50"""),
        "alert_summary": _with("anomalies stocks", f"""
            SELECT stock_id, count(*) AS anomaly_count, {r('avg(anomaly_score)', name='avg_score')},
                   max(trade_date) AS latest_date, symbol
            FROM anomalies LEFT JOIN stocks USING (stock_id) WHERE anomaly_flag
            GROUP BY stock_id, symbol"""),
        "recent_anomalies": _with("anomalies", f"""
            SELECT stock_id, strftime(trade_date, '%Y-%m-%d') AS trade_date,
                   printf('%.4f', {half_up('anomaly_score', 4)}) AS anomaly_score, model_name
            FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) r
                  FROM anomalies WHERE anomaly_flag) WHERE r <= 20"""),
        "score_timeline": _with("anomalies", f"""
            SELECT stock_id, trade_date, {r('anomaly_score')}, 0.0::DOUBLE AS boundary,
                   anomaly_score < 0 AS below_boundary FROM anomalies"""),
        "flow_kpis": _with("flows", f"""
            SELECT stock_id, {r('sum(inflow)', 2, 'total_inflow')},
                   {r('sum(outflow)', 2, 'total_outflow')},
                   {r('sum(inflow) - sum(outflow)', 2, 'net_total')},
                   {r('coalesce(max(mfi_14) FILTER (last), 50)', 6, 'mfi_latest')}
            FROM (SELECT *, trade_date = max(trade_date) OVER (PARTITION BY stock_id) AS last
                  FROM flows) GROUP BY stock_id"""),
        "mfi_signal": _with("flows", f"""
            SELECT {flow_rows}, {_MFI_SIGNAL.format('coalesce(mfi_14, 50)')} AS signal
            FROM flows"""),
        "net_flow_sign": _with("flows", f"""
            SELECT {flow_rows}, CASE WHEN net_flow > 0 THEN 'Positive' ELSE 'Negative' END AS sign
            FROM flows"""),
        "range_slice": _with("prices", _ranges()),
        "flow_series": _with("flows", f"""
            SELECT {flow_rows}, {r('net_flow', 2)}, {r('cumulative_flow', 2)},
                   CASE WHEN last_value(cumulative_flow) OVER (PARTITION BY stock_id
                        ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING
                        AND UNBOUNDED FOLLOWING) >= 0 THEN 'up' ELSE 'down' END AS trend
            FROM flows"""),
        "union_predictions": _with("predictions", f"SELECT {_PREDICTION} FROM predictions"),
        "next_business_day": _with("trades", """
            SELECT trade_date, count(*) AS trades, CAST(trade_date + CASE dayofweek(trade_date)
                   WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS next_day
            FROM trades GROUP BY trade_date"""),
        "round2": _with("flows", f"""
            SELECT {flow_rows}, CAST(round(CAST(mfi_14 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS mfi
            FROM flows"""),
        "fmt_money": _with("prices", f"""
            SELECT stock_id, trade_date, {money('close_price')} AS close,
                   format('${{:,.0f}}', {half_up('close_price * volume', 0)}) AS turnover
            FROM prices"""),
        "fmt_signed": _with("features", f"""
            SELECT stock_id, trade_date, {signed('price_difference')} AS change,
                   {signed('daily_return * 100', '%%')} AS percent,
                   {delta('price_difference', 'daily_return * 100')} AS delta
            FROM features"""),
        "fmt_count": _with("prices", """
            SELECT stock_id, trade_date, format('{:,}', volume * 1000) AS volume FROM prices"""),
        "fmt_date": _with("prices", """
            SELECT stock_id, trade_date, strftime(trade_date, '%Y-%m-%d') AS day FROM prices"""),
        "title_model": _with("predictions", """
            SELECT model_name, count(*) AS "rows", CASE model_name WHEN 'linear_regression'
                   THEN 'Linear Regression' WHEN 'xgboost' THEN 'Xgboost' ELSE 'Stacking' END
                   AS title FROM predictions GROUP BY model_name"""),
        "stock_label": _with("stocks", """
            SELECT stock_id, symbol, company_name, symbol || ' — ' || company_name AS label,
                   split_part(symbol || ' — ' || company_name, ' — ', 1) AS label_symbol
            FROM stocks"""),
        "fmt_score": _with("features", f"""
            SELECT stock_id, trade_date,
                   {', '.join(f"printf('%.{n}f', {half_up('volatility', n)}) AS score_{n}"
                              for n in (1, 3, 4))}
            FROM features"""),
        "issue_text": _with("issues", """
            SELECT issue, count(*) AS symbols FROM issues GROUP BY issue"""),
        "epoch_to_date": """
            SELECT event_id, CAST(ts AS DATE) AS day,
                   CAST(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS BIGINT) AS day_seconds
            FROM events""",
        "math_scalars": _with("bars", f"""
            SELECT stock_id, trade_date, {r('sqrt(close)', name='root')},
                   {r('abs(close - open)', name='move')},
                   {r('greatest(open, close)', name='upper')},
                   {r('least(open, close)', name='lower')},
                   {r('(close - open) / NULLIF(high - low, 0)', name='share')} FROM bars"""),
        "training_frame": _with("training", f"""
            SELECT stock_id, trade_date, {rs('close_price ' + FEATURES + ' target')}
            FROM training"""),
        "chrono_split": _with("folded", """
            SELECT stock_id, trade_date, position, total, is_train, fold FROM folded"""),
        "train_linear_averages": _with("products", f"""
            SELECT stock_id, {rs('w_ma_7 w_ma_30')},
                   {r('my - w_ma_7 * ma - w_ma_30 * mb', name='intercept')}
            FROM (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS w_ma_7,
                         (xx * zy - xz * xy) / (xx * zz - xz * xz) AS w_ma_30 FROM products)"""),
        "train_linear_fitted": _fitted_linear(),
        "train_boosted_round": _with("cut_gains", f"""
            SELECT stock_id, trade_date, {r('b - 0.3 * CASE WHEN gain > 1e-6 THEN'
                ' CASE WHEN v <= cut THEN lg / (lh + 1) ELSE rg / (rh + 1) END'
                ' ELSE (lg + rg) / (lh + rh + 1) END', name='predicted')}
            FROM cut_rows JOIN cut_gains USING (stock_id, f)"""),
        "model_store": _with("split", """
            SELECT stock_id, count(*) AS "rows", 0.0::DOUBLE AS max_difference,
                   CASE WHEN stock_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS version,
                   CASE WHEN stock_id % 2 = 0 THEN DATE '2024-01-08' ELSE DATE '2024-01-01' END AS trained_on
            FROM split GROUP BY stock_id"""),
        "train_stacking_ridge": _with("ridges left_out", f"""
            SELECT r.stock_id, r.alpha, {r('wa', name='w_ma_7')}, {r('wb', name='w_ma_30')},
                   {r('my - wa * ma - wb * mb', name='intercept')}
            FROM ridges r JOIN (SELECT *, row_number() OVER (PARTITION BY stock_id
                                ORDER BY loo, alpha) AS place FROM left_out) l
            ON r.stock_id = l.stock_id AND r.alpha = l.alpha WHERE place = 1"""),
        "evaluate": _with("metrics", f"""
            SELECT stock_id, model_name, "rows", {rs('rmse mae r2')} FROM metrics"""),
        "train_report": _with("features split", """
            SELECT j.stock_id, model_name,
                   CASE WHEN model_name <> 'random_forest' AND n >= 60 THEN 'trained'
                        ELSE 'skipped' END AS status,
                   CASE WHEN model_name = 'random_forest' THEN 'Unknown model type: random_forest'
                        WHEN n < 60 THEN printf('Insufficient data: %d rows (need ≥60)', n) END
                   AS reason,
                   CASE WHEN model_name <> 'random_forest' AND n >= 60
                        THEN coalesce(train_size, 0) END AS train_size,
                   CASE WHEN model_name <> 'random_forest' AND n >= 60
                        THEN coalesce(test_size, 0) END AS test_size
            FROM (SELECT stock_id, count(*) AS n FROM features GROUP BY stock_id) j
            LEFT JOIN (SELECT stock_id, CAST(count_if(is_train) AS BIGINT) AS train_size,
                              CAST(count_if(NOT is_train) AS BIGINT) AS test_size FROM split GROUP BY stock_id) s
            USING (stock_id),
            (VALUES ('linear_regression'), ('xgboost'), ('stacking'), ('random_forest'))
                v(model_name)"""),
        "compare_models": _with("metrics stocks", f"""
            SELECT symbol,
                   {r("max(r2) FILTER (model_name = 'linear_regression')",
                      name='r2_linear_regression')},
                   {r("max(r2) FILTER (model_name = 'xgboost')", name='r2_xgboost')},
                   {r("max(r2) FILTER (model_name = 'stacking')", name='r2_stacking')},
                   max(model_name) FILTER (place = 1) AS best_model
            FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY r2 DESC NULLS LAST,
                         CASE model_name WHEN 'linear_regression' THEN 1 WHEN 'xgboost' THEN 2
                         ELSE 3 END) AS place FROM metrics)
            JOIN stocks USING (stock_id) GROUP BY symbol"""),
        "latest_features": _with("features", f"""
            SELECT stock_id, trade_date, {rs(FEATURES)}
            FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) r
                  FROM features) WHERE r <= 8"""),
        "predict_next_close": _with("features", """
            SELECT stock_id, CAST(trade_date + CASE dayofweek(trade_date) WHEN 5 THEN 3
                   WHEN 6 THEN 2 ELSE 1 END AS DATE) AS prediction_date,
                   round(stock_id + 10 * daily_return + 0.1::DOUBLE * price_difference
                         + 5 * volatility + 0.5::DOUBLE * ma_7 + 0.4::DOUBLE * ma_30
                         + 0.001::DOUBLE * capital_flow_indicator, 2) AS predicted_close,
                   'linear_regression' AS model_name
            FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) r
                  FROM features)
            WHERE r <= 8 AND daily_return IS NOT NULL AND volatility IS NOT NULL
              AND capital_flow_indicator IS NOT NULL"""),
        # As many scores lie below their 5th percentile as there are places before it.
        "detect_anomalies": _with("anomaly_rows", f"""
            SELECT stock_id, count(*) AS "rows", {BELOW_QUANTILE} AS anomalies FROM anomaly_rows GROUP BY stock_id"""),
        "job_daily": _with("features anomaly_rows", f"""
            SELECT stock_id, predictions, models, first_day, last_day, scored, anomalies
            FROM (SELECT stock_id, 3 * count(*) AS predictions, 3 AS models, min(day) AS first_day,
                         max(day) AS last_day
                  FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) AS r,
                               CAST(trade_date + CASE dayofweek(trade_date) WHEN 5 THEN 3
                                    WHEN 6 THEN 2 ELSE 1 END AS DATE) AS day FROM features)
                  WHERE r <= 8 AND daily_return IS NOT NULL AND volatility IS NOT NULL
                    AND capital_flow_indicator IS NOT NULL GROUP BY stock_id)
            FULL JOIN (SELECT stock_id, count(*) AS scored, {BELOW_QUANTILE} AS anomalies
                       FROM anomaly_rows GROUP BY stock_id) USING (stock_id)"""),
        "volume_change_pct": _with("volume_changes", f"""
            SELECT stock_id, trade_date, {r('volume_change_pct')} FROM volume_changes"""),
        "anomaly_frame": _with("anomaly_rows", f"""
            SELECT stock_id, trade_date, {r('close_price')}, volume,
                   {rs('daily_return volatility volume_change_pct')}, "rows" FROM anomaly_rows"""),
        "anomaly_flags": _with("anomaly_rows", f"""
            SELECT stock_id, trade_date, {r('raw - offset_', name='anomaly_score')},
                   raw - offset_ < 0 AS anomaly_flag, 'isolation_forest' AS model_name
            FROM (SELECT stock_id, trade_date, -abs(daily_return) - volatility AS raw
                  FROM anomaly_rows)
            JOIN (SELECT stock_id, quantile_cont(-abs(daily_return) - volatility, 0.05) AS offset_
                  FROM anomaly_rows GROUP BY stock_id) USING (stock_id)"""),
        "job_backfill": _with("features", f"""
            SELECT stock_id, trade_date, {rs(FEATURES)}, {LOADED_AT} AS created_at
            FROM features"""),
        "failing_deliveries": _with("symbol_bars", """
            , b AS (SELECT *, right(symbol, 1) = '2' AS cut, right(symbol, 1) = '3' AS none,
                         substr(symbol, -2, 1) >= '1' AS two FROM symbol_bars),
            s AS (SELECT symbol, any_value(cut) AS cut,
                         any_value(cut) AND any_value(two) AND count_if(volume % 10 = 0) > 0 AS short,
                         count(DISTINCT year(trade_date)) + 1 AS payloads,
                         CASE WHEN any_value(cut) OR any_value(none) THEN CASE WHEN any_value(cut)
                              AND any_value(two) AND count_if(volume % 10 = 0) > 0 THEN 'archive'
                              ELSE 'history' END ELSE 'candles' END AS source
                  FROM b GROUP BY symbol)
            SELECT source, 'used' AS fate, count(*) AS "rows", count(DISTINCT symbol) AS symbols,
                   CAST(sum(volume) AS BIGINT) AS volume FROM b JOIN s USING (symbol) GROUP BY source
            UNION ALL SELECT 'absent', 'missing path', 1, 0, NULL
            UNION ALL SELECT 'candles', 'broken payload', CAST(sum(payloads) AS BIGINT), count(*), NULL FROM s WHERE cut
            UNION ALL SELECT 'history', CASE WHEN volume % 10 = 0 THEN 'broken line' ELSE 'delivery failed' END,
                   count(*), count(DISTINCT symbol), NULL
            FROM b JOIN s USING (symbol) WHERE short GROUP BY volume % 10 = 0"""),
        "stream_bars": _with("event_bars", f"""
            SELECT symbol, trade_date, {rs(OHLC)}, volume FROM event_bars"""),
        "stream_upsert": _with("event_bars", f"""
            SELECT symbol, trade_date, {rs(FEATURES)} FROM (
                SELECT symbol, trade_date, count(*) OVER (PARTITION BY symbol) AS n,
                       close / NULLIF(lag(close) OVER w, 0) - 1 AS daily_return,
                       close - open AS price_difference,
                       (high - low) / NULLIF(open, 0) AS volatility,
                       avg(close) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7,
                       avg(close) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ma_30,
                       volume * (close - open) / NULLIF(open, 0) AS capital_flow_indicator
                FROM event_bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
            WHERE n >= 2"""),
    }
    for name in FEATURE_COLUMNS:
        sql[name] = _with("features", f"SELECT stock_id, trade_date, {r(name)} FROM features")
    return {name: statement.strip() for name, statement in sql.items()}
