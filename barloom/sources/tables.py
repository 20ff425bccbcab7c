"""Logical input tables (bars, events, fundamentals, chains, tapes ...) derived from the driver's star schema.

Raw rows are always reduced to (symbol, date) or (symbol, minute) grain by a partial-aggregating groupBy before any
window sees them. That bounds every window partition by the calendar, whatever share of the raw rows one symbol holds.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio


def roll_to_weekday(d: Column) -> Column:
    """Saturday and Sunday move to the following Monday."""
    wd = F.weekday(d)
    return F.date_add(d, F.when(wd == 5, 2).when(wd == 6, 1).otherwise(0))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    # ---- price bars -------------------------------------------------------------------------------------------
    def trades(self) -> DataFrame:
        """One row per trade: brand symbol, supplier, session date, price, quantity."""
        li = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"
        )
        part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        return li.join(part, "l_partkey").select(
            "symbol",
            roll_to_weekday(F.col("l_shipdate").cast("date")).alias("date"),
            ratio("l_extendedprice", "l_quantity").alias("price"),
            F.col("l_quantity").alias("qty"),
            "l_orderkey",
            "l_linenumber",
        )

    @staticmethod
    def _ohlcv(trades: DataFrame) -> DataFrame:
        at = F.struct("l_orderkey", "l_linenumber", "price")  # order lines repeat, so the price settles ties
        return trades.groupBy("symbol", "date").agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
        )

    def by_symbol(self, df: DataFrame, *keys: str) -> DataFrame:
        """The one exchange all per-symbol windows of a plan share; a fixed count keeps heavy windows parallel."""
        n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 3 * self.spark.sparkContext.defaultParallelism)
        return df.repartition(n, *(keys or ("symbol",)))

    def bars(self) -> DataFrame:
        """Daily OHLCV per brand: a dense panel of a few symbols."""
        return self.by_symbol(self._ohlcv(self.trades()))

    def bars_wide(self) -> DataFrame:
        """Daily OHLCV per supplier: a wide cross-section whose symbol count grows with the data."""
        li = self.raw("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
            roll_to_weekday(F.col("l_shipdate").cast("date")).alias("date"),
            ratio("l_extendedprice", "l_quantity").alias("price"),
            F.col("l_quantity").alias("qty"),
            "l_orderkey",
            "l_linenumber",
        )
        return self.by_symbol(self._ohlcv(li))

    def sessions(self) -> DataFrame:
        """The dates that bars of either kind can have, without making bars (one row per session, bounded by the calendar)."""
        return self.raw("lineitem").select(roll_to_weekday(F.col("l_shipdate").cast("date")).alias("date")).distinct()

    def rets(self) -> DataFrame:
        """Brand bars with the close-to-close return."""
        w = Window.partitionBy("symbol").orderBy("date")
        return self.bars().withColumn("ret", ratio("close", F.lag("close").over(w)) - 1)

    def market(self) -> DataFrame:
        """Equal-weight mean return per date over the brands (the benchmark series)."""
        return self.rets().groupBy("date").agg(F.avg("ret").alias("mkt"))

    def profile(self) -> DataFrame:
        """Symbol -> sector (region), industry (nation), market-cap proxy, for supplier symbols."""
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return (
            s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 nations and 5 regions at every scale
            .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("industry"),
                F.col("s_acctbal").alias("mcap"),
            )
        )

    def macro(self) -> DataFrame:
        """Date-level macro proxies (one row per session, bounded by the calendar)."""
        li = self.raw("lineitem").select(roll_to_weekday(F.col("l_shipdate").cast("date")).alias("date"), "l_discount", "l_tax", "l_quantity", "l_extendedprice")
        return li.groupBy("date").agg(
            (10 + 200 * F.avg("l_discount")).alias("vix"),
            (12 + 200 * F.avg("l_tax")).alias("vix3m"),
            (100 * F.avg("l_tax")).alias("ust10y"),
            (60 * F.avg("l_discount")).alias("ust2y"),
            F.avg("l_quantity").alias("dollar"),
            (F.avg("l_extendedprice") / 1000).alias("tlt"),
            (F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("hyg"),
        )

    def macro_series(self) -> DataFrame:
        """The macro proxies as a single 'MACRO' symbol, so that series windows have a partition key."""
        return self.macro().withColumn("symbol", F.lit("MACRO"))

    def urgent(self) -> DataFrame:
        """Dated events per brand: lines of urgent orders."""
        o = self.raw("orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", F.col("o_orderdate").cast("date").alias("event_date"))
        li = self.raw("lineitem").select("l_orderkey", "l_partkey")
        part = self.raw("part").select("p_partkey", F.col("p_brand").alias("symbol"))
        return (
            o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("symbol", "event_date")
            .agg(F.count("*").alias("n_events"))
        )

    def tape(self) -> DataFrame:
        """Prediction tape per brand: deterministic scores and probabilities next to the next day's clipped return."""
        r = Window.partitionBy("symbol").orderBy("date")
        d = self.rets().withColumns({"rn": F.row_number().over(r), "nxt": F.lead("ret").over(r)})
        a = F.col("volume") * 0.37 + F.col("rn")
        y = F.least(F.lit(0.05), F.greatest(F.lit(-0.05), F.col("nxt") / 20))
        return d.where(F.col("nxt").isNotNull()).select(
            "symbol", "date", "rn", F.floor((F.col("rn") - 1) / 60).cast("int").alias("fold_id"),
            (0.6 * F.sin(a)).alias("score"), (0.5 + 0.49 * F.sin(a)).alias("p"), F.abs(F.cos("volume")).alias("conf"), (0.01 + 0.01 * F.abs(F.cos("rn"))).alias("sigma"),
            y.alias("y_true"), (F.col("nxt") > 0).cast("int").alias("y"), F.when(F.col("rn") % 2 == 0, 5).otherwise(21).alias("horizon"),
            F.concat(F.lit("m"), (F.col("rn") % 3).cast("string")).alias("model"), F.col("volume"),
        )

    def quantile_tape(self) -> DataFrame:
        """Tape with quantile forecasts around a small centre."""
        t = self.tape()
        c, s = 0.02 * F.col("score"), F.col("sigma")
        # fixed values: standard normal quantiles at the forecast levels
        z = {"q05": -1.645, "q10": -1.2816, "q25": -0.6745, "q50": 0.0, "q75": 0.6745, "q90": 1.2816, "q95": 1.645}
        return t.withColumns({k: c + s * v for k, v in z.items()})

    def chain(self) -> DataFrame:
        """Option-chain stand-in per brand and month: one row per (expiry, strike, type), pre-aggregated from lines."""
        li = self.raw("lineitem").select("l_partkey", "l_quantity", "l_discount", "l_tax", "l_linenumber", F.col("l_shipdate").cast("date").alias("d"))
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"), "p_retailprice", "p_size")
        j = li.join(p, "l_partkey").withColumn("quote_date", F.trunc("d", "month"))
        j = j.withColumns(
            {
                "expiry": F.date_add("quote_date", (30 * (1 + F.col("p_size") % 4)).cast("int")),
                "strike": F.floor((F.col("p_retailprice") - 900) * 3 / 10) * 10 + 850.0,
                "type": F.when(F.col("l_partkey") % 2 == 0, "call").otherwise("put"),
            }
        )
        g = j.groupBy("symbol", "quote_date", "expiry", "strike", "type").agg(
            F.sum("l_quantity").alias("volume"), F.sum(3 * F.col("l_quantity") + F.col("l_linenumber")).alias("oi"), F.count("*").alias("n"),
            F.sum(F.round(100 * F.col("l_discount")).cast("long")).alias("d"), F.sum(F.round(100 * F.col("l_tax")).cast("long")).alias("x"),
        )
        # whole percents summed exactly, and quotes on a binary grid: their sums are exact in any order
        grid = lambda a, b: F.floor(a * 1048576 / b) / 1048576.0
        n, d, x = F.col("n"), F.col("d"), F.col("x")
        g = g.withColumns({"iv": grid(1037 * n + 200 * d, 10000 * n), "bid": grid(x, n), "ask": grid(101 * x + 100 * n + d, 100 * n)}).drop("n", "d", "x")
        return g.withColumns({"spot": 950 + 10.0 * F.month("quote_date"), "tte": F.datediff("expiry", "quote_date") / 365.0})

    def insider(self) -> DataFrame:
        """Insider-trade stand-in: filing date, code, shares, value, name and title per trade."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", F.col("l_shipdate").cast("date").alias("filing_date"))
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        return li.join(p, "l_partkey").select(
            "symbol", "filing_date", F.when(F.col("l_returnflag") == "A", " Purchase").when(F.col("l_returnflag") == "R", "s").otherwise("P - Plan").alias("code"),
            F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("value"), F.col("l_orderkey").cast("string").alias("name"),
            F.element_at(F.array(*[F.lit(x) for x in ("Chief Executive Officer", "Vice President", "President and CEO", "CEO", "Chief Financial Officer", "10% Owner", "Treasurer")]), F.col("l_linenumber").cast("int")).alias("title"),
        )

    def minute_bars(self) -> DataFrame:
        """Event values per user and minute: open/high/low/close/volume, pre-aggregated from events with map-side combine."""
        e = self.raw("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
        at = F.struct("ts", "event_id")
        return e.groupBy(F.col("user_id").alias("symbol"), F.date_trunc("minute", "ts").alias("minute")).agg(
            F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("n")
        )

    def fundamentals(self) -> DataFrame:
        """Quarterly statement stand-in per brand, known 45 days after quarter end."""
        li = self.raw("lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("period"))
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"), "p_retailprice")
        x = F.col("l_extendedprice")
        g = li.join(p, "l_partkey").groupBy("symbol", "period").agg(
            F.sum(x * (1 - F.col("l_discount"))).alias("revenue"), F.sum(x * F.col("l_tax")).alias("tax"), F.sum(x * 0.6).alias("cogs"), F.sum(F.col("l_quantity") * 100).alias("inventory"),
            F.sum(x * F.col("l_discount")).alias("receivables"), F.sum("p_retailprice").alias("cash"), F.count("*").alias("n"),
        )
        return g.select(
            "*", (F.col("revenue") - F.col("cogs")).alias("gross_profit"), (F.col("revenue") * 0.95 - F.col("cogs")).alias("ebit"), (F.col("revenue") - F.col("cogs") - F.col("tax")).alias("net_income"),
            (F.col("revenue") * 1.2).alias("total_assets"), (F.col("revenue") * 0.5 + F.col("receivables")).alias("total_debt"), (F.col("revenue") * 0.7 - F.col("receivables")).alias("equity"),
            (F.col("cash") + F.col("receivables") + F.col("inventory")).alias("current_assets"), (F.col("cogs") * 0.2).alias("current_liabilities"), (F.col("revenue") * 0.02).alias("interest"),
            (F.col("cogs") * 0.1).alias("payables"), (F.col("revenue") * 0.9 - F.col("cogs")).alias("operating_cf"), (F.col("receivables") * 0.5).alias("capex"), (F.col("n") * 1000.0).alias("shares"),
            (F.col("tax") * 0.3).alias("dividends_paid"), (F.col("tax") * 0.2).alias("buybacks"), (F.col("revenue") * 0.05 + F.col("tax")).alias("rnd"), (F.col("cogs") * 0.15).alias("opex"),
            F.date_add(F.add_months("period", 3), 44).alias("known_at"),
        )
