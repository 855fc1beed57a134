"""Bars, fundamentals and universe derived from the order tables."""

from pyspark.sql import functions as F

from barwise.functions.windows import n_tasks

LINES_PER_TASK = 250_000


def in_day():
    """The order of line items as one number. Line numbers below 65,536 and order keys below 2^47 fit into a long, and the two
    are the table's key."""
    return F.shiftleft("l_orderkey", 16).bitwiseOR(F.col("l_linenumber").cast("long"))


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def n_lines(spark, sf_dir):
    """The number of line items, from the files' footers: at least that of the bars."""
    return read(spark, sf_dir, "lineitem").count()


def ticker_of(key):
    return F.format_string("S%05d", F.col(key))


def with_places(df, spark, sf_dir):
    """Attach nation and region names by ``s_nationkey``. No join hints: Spark broadcasts by size,
    and joining the small tables one by one keeps its size estimates tight."""
    return (
        df.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def suppliers(spark, sf_dir):
    return with_places(read(spark, sf_dir, "supplier"), spark, sf_dir)


def bars(spark, sf_dir, tickers=None):
    """Daily bars, one per supplier and ship date; with ``tickers`` of these alone, filtered by key in the scan.

    Line items are aggregated before the dimension join. They are dealt by (supplier, day), so a supplier with a third of
    all line items costs no more than the others, to a number of tasks that follows their number: a line is rarely one of
    several of its day, and combining them in the tasks of the scan would hold a whole file split in memory. All buffers are
    numbers, so the aggregation hashes and never sorts.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = read(spark, sf_dir, "lineitem")
    if tickers is not None:
        lines = lines.filter(F.col("l_suppkey").isin([int(t[1:]) for t in tickers]))
    lines = lines.select("l_suppkey", F.to_date("l_shipdate").alias("date"), price.alias("price"), in_day().alias("in_day"), "l_quantity")
    if tickers is None:
        lines = lines.repartition(n_tasks(spark, n_lines(spark, sf_dir), LINES_PER_TASK), "l_suppkey", "date")
    daily = (
        lines
        .groupBy("l_suppkey", "date")
        .agg(
            F.min_by("price", "in_day").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "in_day").alias("close"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
    )
    owner = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = with_places(
        daily.join(owner, F.col("l_suppkey") == F.col("s_suppkey")), spark, sf_dir
    )
    return placed.select(
        ticker_of("l_suppkey").alias("ticker"),
        "date", "open", "high", "low", "close", "volume", F.col("r_name").alias("sector"),
    )


def raw_bars(spark, sf_dir):
    """Bars with faults injected by key arithmetic: repeats, null closes, swapped high and low."""
    df = bars(spark, sf_dir).withColumn(
        "k",
        F.substring("ticker", 2, 10).cast("long") * 31
        + F.datediff("date", F.lit("1995-01-01").cast("date")),
    )
    swapped = F.col("k") % 83 == 0
    df = df.withColumns(
        {
            "high": F.when(swapped, F.col("low")).otherwise(F.col("high")),
            "low": F.when(swapped, F.col("high") + 1).otherwise(F.col("low")),
            "close": F.when(F.col("k") % 89 != 0, F.col("close")),
        }
    )
    copies = F.when(F.col("k") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy", F.explode(copies)).drop("k", "copy")


def text_bars(spark, sf_dir):
    """Bars as loosely typed text, as a vendor file would hold them, some fields unreadable."""
    df = raw_bars(spark, sf_dir)
    bad = F.dayofmonth("date") == 13
    return df.select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("ticker"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[
            F.when(bad & F.lit(c == "open"), F.lit("n/a"))
            .otherwise(F.col(c).cast("string"))
            .alias(c)
            for c in ("open", "high", "low", "close", "volume")
        ],
        "sector",
    )


def fundamentals(spark, sf_dir):
    k = F.col("s_suppkey")

    def choice(modulus, *labels):
        out = F.lit(labels[-1])
        for i in reversed(range(len(labels) - 1)):
            out = F.when(k % modulus == i, labels[i]).otherwise(out)
        return out

    return suppliers(spark, sf_dir).select(
        ticker_of("s_suppkey").alias("ticker"),
        F.col("r_name").alias("sector"),
        choice(4, "Large Cap", "Mid Cap", "Small Cap", "Micro Cap").alias("market_cap_category"),
        choice(3, "NYSE", "NASDAQ", "LSE").alias("exchange"),
        F.col("n_name").alias("country"),
        (0.5 + (k % 100) / 80.0).cast("double").alias("beta"),
        (k * 7 % 230).cast("double").alias("pe_ratio"),
        (0.5 + (k % 11) / 2.0).cast("double").alias("pb_ratio"),
        ((k % 9 - 1) / 200.0).cast("double").alias("dividend_yield"),
        ((k % 13 - 2) / 40.0).cast("double").alias("roe"),
        ((k % 17) / 10.0).cast("double").alias("debt_to_equity"),
    )


def raw_fundamentals(spark, sf_dir):
    """Fundamentals with repeated tickers, some negative ratios and some tickers missing."""
    k = F.substring("ticker", 2, 10).cast("long")
    df = fundamentals(spark, sf_dir).withColumn("k", k).filter("k % 19 <> 5")
    df = df.withColumn(
        "pe_ratio", F.when(F.col("k") % 10 == 3, -F.col("pe_ratio")).otherwise(F.col("pe_ratio"))
    )
    copies = F.when(F.col("k") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        df.withColumn("copy", F.explode(copies))
        .withColumn("beta", F.col("beta") + F.col("copy"))
        .drop("k", "copy")
    )


def universe(spark, sf_dir):
    """Listing of symbols: some carry a share class after a dot, betas come as text, some repeat."""
    k = F.col("s_suppkey")
    copies = F.when(k % 16 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        suppliers(spark, sf_dir)
        .withColumn("copy", F.explode(copies))
        .select(
            F.concat(ticker_of("s_suppkey"), F.when(k % 10 == 0, ".B").otherwise("")).alias("ticker"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("sub_industry"),
            ((1 + k % 7) / 10.0 + F.col("copy")).cast("double").alias("weight_pct"),
            F.when(k % 23 == 4, "unknown")
            .otherwise((0.5 + (k % 100) / 80.0).cast("double").cast("string"))
            .alias("beta"),
            F.when(k % 4 == 0, "Large").otherwise("Mid").alias("market_cap_cat"),
        )
    )
