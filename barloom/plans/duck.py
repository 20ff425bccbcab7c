"""SQL side of the registered plans: fixture definitions and small text macros for window expressions."""

from __future__ import annotations

WEEKDAY = "(CASE isodow({d}) WHEN 6 THEN {d} + 2 WHEN 7 THEN {d} + 1 ELSE {d} END)"
SHIP = WEEKDAY.format(d="CAST(l_shipdate AS DATE)")

OHLCV = """SELECT symbol, date, arg_min(price, (l_orderkey, l_linenumber, price)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (l_orderkey, l_linenumber, price)) AS close, sum(qty) AS volume FROM {src} GROUP BY symbol, date"""

CTES = {
    "trades": f"SELECT p_brand AS symbol, {SHIP} AS date, l_extendedprice / l_quantity AS price, l_quantity AS qty, "
    "l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey",
    "bars": OHLCV.format(src="trades"),
    "trades_wide": f"SELECT 'S' || l_suppkey AS symbol, {SHIP} AS date, l_extendedprice / l_quantity AS price, l_quantity AS qty, "
    "l_orderkey, l_linenumber FROM lineitem",
    "bars_wide": OHLCV.format(src="trades_wide"),
    "rets": "SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM bars",
    "market": "SELECT date, avg(ret) AS mkt FROM rets GROUP BY date",
    "profile": "SELECT 'S' || s_suppkey AS symbol, r_name AS sector, n_name AS industry, s_acctbal AS mcap FROM supplier "
    "JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    "macro": f"SELECT {SHIP} AS date, 10 + 200 * avg(l_discount) AS vix, 12 + 200 * avg(l_tax) AS vix3m, 100 * avg(l_tax) AS ust10y, "
    "60 * avg(l_discount) AS ust2y, avg(l_quantity) AS dollar, avg(l_extendedprice) / 1000 AS tlt, "
    "avg(l_extendedprice * (1 - l_discount)) / 1000 AS hyg FROM lineitem GROUP BY 1",
    "macro_series": "SELECT *, 'MACRO' AS symbol FROM macro",
    "urgent": "SELECT p_brand AS symbol, CAST(o_orderdate AS DATE) AS event_date, count(*) AS n_events FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
    "JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2",
    "tape0": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM rets",
    "tape": "SELECT symbol, date, rn, (rn - 1) // 60 AS fold_id, 0.6::DOUBLE * sin(volume * 0.37::DOUBLE + rn) AS score, 0.5::DOUBLE + 0.49::DOUBLE * sin(volume * 0.37::DOUBLE + rn) AS p, abs(cos(volume)) AS conf, "
    "0.01::DOUBLE + 0.01::DOUBLE * abs(cos(rn)) AS sigma, least(0.05::DOUBLE, greatest(-0.05::DOUBLE, nxt / 20)) AS y_true, (nxt > 0)::INT AS y, CASE WHEN rn % 2 = 0 THEN 5 ELSE 21 END AS horizon, "
    "'m' || (rn % 3) AS model, volume FROM tape0 WHERE nxt IS NOT NULL",
    "qtape": "SELECT *, " + ", ".join(f"0.02::DOUBLE * score + sigma * {v}::DOUBLE AS {k}" for k, v in
    {"q05": -1.645, "q10": -1.2816, "q25": -0.6745, "q50": 0.0, "q75": 0.6745, "q90": 1.2816, "q95": 1.645}.items()) + " FROM tape",
    "chain": """SELECT * EXCLUDE (n, d, x), floor((1037 * n + 200 * d) * 1048576 / (10000 * n)::DOUBLE) / 1048576 AS iv, floor(x * 1048576 / n::DOUBLE) / 1048576 AS bid, floor((101 * x + 100 * n + d) * 1048576 / (100 * n)::DOUBLE) / 1048576 AS ask FROM (
  SELECT symbol, quote_date, expiry, strike, type, sum(l_quantity) AS volume, sum(3 * l_quantity + l_linenumber) AS oi, count(*) AS n, sum(round(100 * l_discount)::BIGINT)::BIGINT AS d, sum(round(100 * l_tax)::BIGINT)::BIGINT AS x, 950 + 10.0::DOUBLE * month(quote_date) AS spot, date_diff('day', quote_date, expiry) / 365.0::DOUBLE AS tte FROM (
  SELECT *, quote_date + 30 * (1 + p_size % 4)::INT AS expiry, floor((p_retailprice - 900) * 3 / 10) * 10 + 850.0 AS strike, CASE WHEN l_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS type FROM (
  SELECT p_brand AS symbol, p_size, p_retailprice, l.*, date_trunc('month', CAST(l_shipdate AS DATE))::DATE AS quote_date FROM lineitem l JOIN part ON p_partkey = l_partkey)) GROUP BY 1, 2, 3, 4, 5)""",
    "insider": """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS filing_date, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'G' END AS code, l_quantity AS shares, l_extendedprice AS value,
  l_orderkey AS name, l_linenumber AS ln FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "minute_bars": "SELECT user_id AS symbol, date_trunc('minute', ts) AS minute, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume, count(*) AS n FROM events GROUP BY 1, 2",
    "fund0": """SELECT p_brand AS symbol, date_trunc('quarter', CAST(l_shipdate AS DATE))::DATE AS period, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * l_tax) AS tax, sum(l_extendedprice * 0.6::DOUBLE) AS cogs,
  sum(l_quantity * 100) AS inventory, sum(l_extendedprice * l_discount) AS receivables, sum(p_retailprice) AS cash, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
    "fundamentals": """SELECT *, revenue - cogs AS gross_profit, revenue * 0.95::DOUBLE - cogs AS ebit, revenue - cogs - tax AS net_income, revenue * 1.2::DOUBLE AS total_assets, revenue * 0.5::DOUBLE + receivables AS total_debt,
  revenue * 0.7::DOUBLE - receivables AS equity, cash + receivables + inventory AS current_assets, cogs * 0.2::DOUBLE AS current_liabilities, revenue * 0.02::DOUBLE AS interest, cogs * 0.1::DOUBLE AS payables,
  revenue * 0.9::DOUBLE - cogs AS operating_cf, receivables * 0.5::DOUBLE AS capex, n * 1000.0::DOUBLE AS shares, tax * 0.3::DOUBLE AS dividends_paid, tax * 0.2::DOUBLE AS buybacks, revenue * 0.05::DOUBLE + tax AS rnd, cogs * 0.15::DOUBLE AS opex,
  CAST(period + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS known_at FROM fund0""",
}


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"fixture {name} defined twice")
    CTES[name] = sql


# ---- window macros: they return SQL text -------------------------------------------------------------------------
PART, ORDER = "symbol", "date"


def over(n=None, shift=0, part=PART, order=ORDER) -> str:
    start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1 + shift} PRECEDING"
    end = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
    by = f"PARTITION BY {part} " if part else ""
    return f"({by}ORDER BY {order} ROWS BETWEEN {start} AND {end})"


def agg(fn: str, x: str, n=None, mp=None, shift=0, extra="", **kw) -> str:
    mp = (1 if n is None else n) if mp is None else mp
    w = over(n, shift, **kw)
    return f"(CASE WHEN count({x}) OVER {w} >= {mp} THEN {fn}({x}{extra}) OVER {w} END)"


def mean(x, n=None, mp=None, shift=0, **kw):
    return agg("avg", x, n, mp, shift, **kw)


def rsum(x, n=None, mp=None, shift=0, **kw):
    return agg("sum", x, n, mp, shift, **kw)


def std(x, n=None, mp=None, shift=0, **kw):
    return agg("stddev_samp", x, n, mp, shift, **kw)


def std0(x, n=None, mp=None, shift=0, **kw):
    return agg("stddev_pop", x, n, mp, shift, **kw)


def rmin(x, n=None, mp=None, shift=0, **kw):
    return agg("min", x, n, mp, shift, **kw)


def rmax(x, n=None, mp=None, shift=0, **kw):
    return agg("max", x, n, mp, shift, **kw)


def quant(x, p, n=None, mp=None, shift=0, **kw):
    return agg("quantile_cont", x, n, mp, shift, extra=f", {p}", **kw)


def prod(x, n=None, mp=None, shift=0, **kw):
    return agg("product", x, n, mp, shift, **kw)


def lag(x, k=1, part=PART, order=ORDER):
    return f"(lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order}))"


def lead(x, k=1, part=PART, order=ORDER):
    return f"(lead({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order}))"


def pct(x, k=1, **kw):
    return f"({x} / nullif({lag(x, k, **kw)}, 0) - 1)"


def logret(x, k=1, **kw):
    return f"(CASE WHEN {x} / nullif({lag(x, k, **kw)}, 0) > 0 THEN ln({x} / {lag(x, k, **kw)}) END)"


def div(a, b):
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def z(x, n=None, mp=None, shift=0, ddof=1, eps="1e-12", **kw):
    s = (std if ddof else std0)(x, n, mp, shift, **kw)
    return f"(CASE WHEN {s} > {eps} THEN ({x} - {mean(x, n, mp, shift, **kw)}) / {s} END)"


def clip(x, lo, hi):
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x})) END)"


def both(x, y):
    ok = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    return f"(CASE WHEN {ok} THEN {x} END)", f"(CASE WHEN {ok} THEN {y} END)"


def corr(x, y, n, mp=None, shift=0, **kw):
    a, b = both(x, y)
    mp, w = n if mp is None else mp, over(n, shift, **kw)
    sa, sb = f"stddev_samp({a}) OVER {w}", f"stddev_samp({b}) OVER {w}"
    return f"(CASE WHEN count({a}) OVER {w} >= {mp} AND {sa} > 1e-12 AND {sb} > 1e-12 THEN covar_samp({a}, {b}) OVER {w} / ({sa} * {sb}) END)"


def beta(y, x, n, mp=None, shift=0, **kw):
    b, a = both(y, x)
    mp, w = n if mp is None else mp, over(n, shift, **kw)
    v = f"var_samp({a}) OVER {w}"
    return f"(CASE WHEN count({a}) OVER {w} >= {mp} AND {v} > 1e-18 THEN covar_samp({b}, {a}) OVER {w} / {v} END)"


def cov(y, x, n, mp=None, shift=0, **kw):
    b, a = both(y, x)
    mp, w = n if mp is None else mp, over(n, shift, **kw)
    return f"(CASE WHEN count({a}) OVER {w} >= {mp} THEN covar_samp({b}, {a}) OVER {w} END)"


def skew(x, n, mp=None, shift=0, **kw):
    mp, w = n if mp is None else mp, over(n, shift, **kw)
    return f"(CASE WHEN count({x}) OVER {w} >= {max(mp, 3)} AND stddev_pop({x}) OVER {w} > 1e-12 THEN skewness({x}) OVER {w} END)"


def kurt(x, n, mp=None, shift=0, **kw):
    mp, w = n if mp is None else mp, over(n, shift, **kw)
    return f"(CASE WHEN count({x}) OVER {w} >= {max(mp, 4)} AND stddev_pop({x}) OVER {w} > 1e-12 THEN kurtosis({x}) OVER {w} END)"


def slope(y, rn, n, mp=None, **kw):
    mp, w = n if mp is None else mp, over(n, 0, **kw)
    return f"(CASE WHEN count({y}) OVER {w} >= {mp} THEN regr_slope({y}, {rn}) OVER {w} END)"


def ffill(x, limit=None, part=PART, order=ORDER):
    start = "UNBOUNDED PRECEDING" if limit is None else f"{limit} PRECEDING"
    return f"(last_value({x} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {start} AND CURRENT ROW))"


def bfill(x, part=PART, order=ORDER):
    return f"(first_value({x} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def pct_rank(x, n, mp=None, ties="average", **kw):
    mp, w = n if mp is None else mp, over(n, 0, **kw)
    lst = f"list({x}) FILTER (WHERE ({x}) IS NOT NULL) OVER {w}"
    lt, le = f"len(list_filter({lst}, lambda e__: e__ < {x}))", f"len(list_filter({lst}, lambda e__: e__ <= {x}))"
    rank = le if ties == "max" else f"({lt} + {le} + 1) / 2.0" if ties == "average" else f"({lt} + 1)"
    return f"(CASE WHEN ({x}) IS NOT NULL AND count({x}) OVER {w} >= {mp} THEN {rank} / len({lst})::DOUBLE END)"


def ewm(x, alpha, i, part=PART, order=ORDER):
    """adjust=False recurrence in closed form over a NULL-free series; `i` is the zero-based row number column."""
    q = f"{1 - alpha!r}::DOUBLE"
    return (
        f"(pow({q}, {i}) * sum({x} * (CASE WHEN {i} = 0 THEN 1.0::DOUBLE ELSE {alpha!r}::DOUBLE END) * pow({q}, -{i})) "
        f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    )


def ewm_adj(x, alpha, i, part=PART, order=ORDER):
    q = f"{1 - alpha!r}::DOUBLE"
    w = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(sum({x} * pow({q}, -{i})) {w} / sum(pow({q}, -{i})) {w})"


def select(exprs: dict[str, str], src: str, keys="symbol, date") -> str:
    return f"SELECT {keys}, " + ", ".join(f"{v} AS {k}" for k, v in exprs.items()) + f" FROM {src}"


def flag(cond):
    return f"(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def nz(x, d=0):
    return f"coalesce({x}, {d})"
