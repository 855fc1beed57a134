"""Gated layers: write, audit, publish.

A layer is computed once, while it is written to a folder of its own. Its row-level checks and its row count are observed
during that write; duplicates and price moves are then counted over two or three columns of the written files. If a strict
check fails the run stops: the layer is not published, and no later layer is computed. A published layer is a line in the
run's manifest (a Parquet folder, one small file a layer), which is also the audit of the run. Readers take a layer's
files from there, so files of a stopped or repeated run are never seen.

Rows are moved and stored once. With ``tasks``, rows are dealt by ticker before the first layer and every layer is stored in
buckets by ticker, so no later layer or check shuffles rows. A layer without checks to which the next only adds columns
shares that one's files.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from barwise.operators import cleanse, layers
from barwise.operators.quality import QualityConfig, QualityError, keyed_checks, quality_score, row_checks, row_measures
from barwise.sources import files

MANIFEST = "step int, layer string, path string, records_in long, records_out long, quality_score double"
#: A layer without checks of its own.
UNCHECKED = 100.0


@dataclass
class Step:
    """A layer: how it follows from the one before, its partition columns, and what is checked of it (None: nothing;
    otherwise the columns, of which rows must have all known if ``known_only``). ``keyed``: what is done to the rows before they
    are dealt by ticker. ``with_next``: the next step keeps the rows and only adds columns; both share its files."""

    name: str
    build: object
    partition_by: tuple = ()
    checked: tuple | None = None
    known_only: bool = False
    keyed: object = None
    with_next: bool = False


def bar_steps(min_days=252):
    """Bronze, silver, features, gold and the sector aggregate over loosely typed bars."""
    bars = ("ticker", "date", "open", "high", "low", "close", "volume", "sector")
    return [
        Step("bronze", layers.bronze_rows, ("sector",), bars, keyed=cleanse.conform_bars),
        Step("silver", lambda b: layers.silver(b, min_days), (), (*bars, "daily_return", "log_return", "is_outlier")),
        Step("features", layers.silver_features, with_next=True),
        Step("gold", layers.gold_fact, ("year", "quarter"), ("ticker", "date", "close", "daily_return"), known_only=True),
        Step("sector_agg", layers.sector_scenario_agg),
    ]


class Run:
    """One run over ``folder``. ``config``: limits of the checks; ``as_of`` replaces the clock of the freshness check. With
    ``tasks`` rows are dealt by ticker to so many; for rows that do not repeat without bound."""

    def __init__(self, spark, folder, config=None, as_of=None, tasks=None):
        self.spark, self.folder, self.as_of, self.tasks = spark, folder, as_of, tasks
        self.config = config or QualityConfig()
        self.manifest = f"{folder}/manifest"
        self.published = {}

    def land(self, raw, name="raw"):
        """The incoming rows as files; their number is that of the files' footers."""
        raw.write.option("compression", files.DENSE).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(raw.schema).parquet(f"{self.folder}/{name}")

    def publish(self, steps, before, records_in):
        """Write the last of ``steps``, whose files hold the others' columns too, audit it, and publish it or raise. Gives (the
        layer as read from its files, its row count)."""
        *shared, step = steps
        df = before if steps[0].keyed is None else steps[0].keyed(before)
        if self.tasks is not None and "ticker" in df.columns:
            df = df.repartition(self.tasks, "ticker")  # an exchange only where the files are not in these buckets
        columns = {}
        for s in steps:
            df = s.build(df)
            columns[s.name] = df.columns
        path = f"{self.folder}/{step.name}"
        where, measures = None, {}
        if step.checked is not None:
            if step.known_only:
                where = F.lit(True)
                for c in step.checked:
                    where &= F.col(c).isNotNull()
            measures = row_measures(step.checked, self.config, where=where)
        seen = Observation()
        observe = (seen, {"rows_out": F.count(F.lit(1)), **measures})
        if self.tasks is not None and "ticker" in df.columns:
            table = f"layer_{step.name}_{uuid.uuid4().hex}"
            written = files.write_bucketed(
                df, table, buckets=self.tasks, path=path, partition_by=step.partition_by, observe=observe, compression=files.DENSE
            ).select(*df.columns)
        else:
            files.write_parquet(df, path, step.partition_by, observe=observe, compression=files.DENSE)
            written = self.spark.read.schema(df.schema).parquet(path)
        values = dict(seen.get)
        rows_out = values.pop("rows_out")
        for s in shared:
            self._publish(s.name, path, records_in, rows_out, UNCHECKED, written.select(*columns[s.name]))
            records_in = rows_out
        score = UNCHECKED
        if step.checked is not None:
            report = self._audit(step, values, written, where)
            failed = sorted(r["check_name"] for r in report.collect() if r["status"] == "FAIL")  # eight checks
            if self.config.strict and failed:
                raise QualityError(f"{step.name}: {len(failed)} check(s) failed: {', '.join(failed)}")
            score = float(quality_score(report).first()["overall_score"])
        self._publish(step.name, path, records_in, rows_out, score, written)
        return written, rows_out

    def _publish(self, name, path, records_in, rows_out, score, written):
        line = (len(self.published) + 1, name, path, records_in, rows_out, score)
        self.spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").parquet(self.manifest)
        self.published[name] = written

    def _audit(self, step, values, written, where):
        """The report as a table of plain values: reading it again runs no check again."""
        kinds = ", ".join(f"{k} {'date' if k == 'max_date' else 'long'}" for k in values)
        base = self.spark.createDataFrame([tuple(values.values())], kinds)
        rows = row_checks(base, step.checked, self.config, self.as_of)
        wanted = [c for c in ("ticker", "date", "daily_return" if "daily_return" in step.checked else "close") if c in step.checked]
        keyed = (written if where is None else written.filter(where)).select(*wanted)
        if {"ticker", "date"} <= set(wanted):
            rows = rows.unionByName(keyed_checks(keyed, self.config))
        report = rows.select(F.lit(step.name).alias("layer"), "*")
        return self.spark.createDataFrame(report.collect(), report.schema)

    def go(self, raw, steps):
        """All layers in order over the landed rows; stops at the first that fails."""
        now = self.land(raw)
        n = now.count()
        together = []
        for step in steps:
            together.append(step)
            if not step.with_next:
                now, n = self.publish(together, now, n)
                together = []
        return self

    def layer(self, name) -> DataFrame:
        """A published layer, by the manifest."""
        return self.published[name]

    def audit(self, unaudited=("sector_agg",)):
        """Rows in and out and the score of each published layer, with a total line."""
        lines = self.spark.read.schema(MANIFEST).parquet(self.manifest).filter(~F.col("layer").isin(*unaudited)).drop("path")
        total = lines.agg(
            F.lit(0).alias("step"), F.lit("total").alias("layer"), F.sum("records_in").alias("records_in"),
            F.sum("records_out").alias("records_out"), F.avg("quality_score").alias("quality_score"),
        )
        return lines.unionByName(total)
