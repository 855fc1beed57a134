"""The frames queries start from, each a lazy plan over the given tables."""

from functools import cached_property

from pyspark.sql import functions as F

from barwise.functions.windows import n_tasks
from barwise.operators import cleanse, features, layers, market, portfolio, report
from barwise.sources import derived, files

PROXY = "S00000"


class Frames:
    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def bars(self):
        return derived.bars(self.spark, self.sf_dir)

    @cached_property
    def tasks(self):
        """How many tasks rows of bars are dealt to."""
        return n_tasks(self.spark, derived.n_lines(self.spark, self.sf_dir))

    def dealt(self, bars):
        """Dealt by ticker, for whatever looks along a ticker's days: one exchange, of a size that a task always holds."""
        return bars.repartition(self.tasks, "ticker")

    @cached_property
    def series(self):
        return self.dealt(self.bars)

    @cached_property
    def proxy_bars(self):
        return derived.bars(self.spark, self.sf_dir, [PROXY])

    @cached_property
    def raw_bars(self):
        return derived.raw_bars(self.spark, self.sf_dir)

    @cached_property
    def text_bars(self):
        return derived.text_bars(self.spark, self.sf_dir)

    @cached_property
    def fundamentals(self):
        return derived.fundamentals(self.spark, self.sf_dir)

    @cached_property
    def raw_fundamentals(self):
        return derived.raw_fundamentals(self.spark, self.sf_dir)

    @cached_property
    def clean_fundamentals(self):
        return cleanse.cleanse_fundamentals(self.fundamentals)

    @cached_property
    def raw_universe(self):
        return derived.universe(self.spark, self.sf_dir)

    @cached_property
    def universe(self):
        return cleanse.normalise_universe(self.raw_universe)

    @cached_property
    def returns(self):
        return features.with_returns(self.series)

    @cached_property
    def stored_returns(self):
        """Returns for queries that read them several times, computed and stored once."""
        return files.stored(self.returns.select("ticker", "date", "sector", "close", "daily_return"))

    @cached_property
    def features(self):
        return features.feature_set(self.series)

    @cached_property
    def equity_features(self):
        """Features over bars with a return, enriched and labelled."""
        wanted = ["sector", "market_cap_category", "exchange", "country", "beta", "pe_ratio",
                  "dividend_yield", "roe"]
        rows = features.feature_set(self.series, drop_first=True)
        return features.with_labels(cleanse.enrich(rows, self.clean_fundamentals, wanted))

    @cached_property
    def rankings(self):
        """Over the last row of each ticker, stored: ranking sorts, and its readers count and sum, without computing again."""
        last = market.latest_per_ticker(self.equity_features, [*market.RANKED, "date"])
        return market.equity_rankings(files.stored(last))

    @cached_property
    def report_features(self):
        """The feature columns that reports read, computed and stored once."""
        return files.stored(self.equity_features.select(*report.FEATURES))

    @cached_property
    def layers(self):
        return layers.medallion(self.text_bars, tasks=self.tasks)

    @cached_property
    def market_returns(self):
        return features.market_returns(self.returns)

    @cached_property
    def monthly_returns(self):
        """Each ticker's compounded return by month: a calendar that all tickers share, unlike their sparse trading days. A
        row per ticker and month, stored, as a portfolio reads it several times."""
        return files.stored(portfolio.compound(self.returns, "month"))

    @cached_property
    def latest_betas(self):
        return market.latest_per_ticker(
            self.equity_features.filter("beta is not null"), ["sector", "beta", "date"]
        ).drop("date")

