"""Registered queries over the supplied tables, with their SQL twins.

Stages that several queries share are built once per session and folder, as a
research run would: features are written as a bucketed table, the days' statistics
beside it, smaller ones persisted.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import sizing
from panelwright.operators import (allocation, audit, ensemble, falsify, features as ft, folds, forests,
                                   integrity, ledger, panel as pn, scoring, signals as sg)
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams
from panelwright.plans import oracle as o, refits, report, research
from panelwright.sources import bars as bs, snapshots as sn, universe as un

P = JobParams()
#: Folds, steps and thresholds are the defaults; trees are fewer and smaller, for a pass over the rows costs its overhead on small tables.
MODEL = P.with_(rf_trees=30, rf_depth=5, rf_leaf=20, gb_rounds=6, gb_depth=3, gb_rate=0.1, gb_leaf=20)
WALK = MODEL.with_(rf_trees=10)
#: Permutation rounds of the checks.
SEEDS = [falsify.BASE_SEED + k for k in range(3)]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Stage:
    """Shared, persisted intermediate tables of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        sizing.small_methods(spark)
        sizing.join_where_dealt(spark)
        self._bars: dict[str, DataFrame] = {}

    def bars(self, key: str = "supplier") -> DataFrame:
        if key not in self._bars:
            self._bars[key] = bs.bars(self.spark, self.sf_dir, key).persist()
        return self._bars[key]

    @cached_property
    def span(self) -> int:
        """Measured once on the source dates; every panel date lies inside it."""
        return sizing.calendar_span(
            bs.table(self.spark, self.sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")))

    @cached_property
    def features(self) -> DataFrame:
        return sizing.stored(ft.features(self.bars(), P), "ticker", "date", in_place=True)

    @cached_property
    def panel(self) -> DataFrame:
        return pn.build_panel(self.features)

    @cached_property
    def z(self) -> DataFrame:
        """The normalised panel, read from the stored features and the stored statistics of a row a day."""
        stats = sizing.cut(pn.cross_section_stats(self.panel, "date", FEATURES))
        return pn.normalise(self.panel, "date", span=self.span, stats=stats)

    @cached_property
    def positions(self) -> DataFrame:
        return folds.date_positions(self.panel).persist()

    @cached_property
    def roles(self) -> DataFrame:
        return folds.day_roles(self.positions, P).persist()

    def rule_rows(self, z: DataFrame) -> DataFrame:
        """Validation rows with rule-based stand-ins for the two learners."""
        val = sizing.attach_by_day(z, self.roles.where("role = 'val'").select("date", "fold"), "date", self.span, P.broadcast_days)
        c = F.col
        votes = F.array(*[0.02 * c(v) for v in ("ret_5d", "ret_10d", "ret_21d", "ret_42d", "ret_63d")])
        return val.select(
            F.lit(1).alias("model"), "date", "ticker", "fold",
            (0.02 * c("mom_3_1") + 0.01 * c("ret_21d")).alias("rf"),
            (0.02 * c("mom_3_1") + 0.01 * c("zscore_21")).alias("gb"),
            ensemble.vote_std(votes).alias("tree_std"), "y")

    @cached_property
    def rule_oof(self) -> DataFrame:
        return self.rule_rows(self.z).persist()

    @cached_property
    def refit_r2(self) -> DataFrame:
        """kind, oof_r2 of the stack refitted on true labels, on permuted ones (a row a seed) and on lagged features.

        All refits are models of one fit: a group each in the same two aggregates.
        """
        kinds = ["real", *("permuted" for _ in SEEDS), "lagged"]
        # A row's predictions are the same under all labels; the fits read nothing but them and the label.
        drawn = falsify.permutations(self.panel, SEEDS)
        labels = F.array("y", *(f"y{k}" for k in range(len(SEEDS))))
        here = self.rule_oof.select("date", "ticker", "rf", "gb", "y").join(drawn, ["date", "ticker"]).select(
            F.posexplode(labels).alias("model", "y"), "rf", "gb")
        there = self.rule_rows(self.lagged).select(F.lit(len(kinds) - 1).alias("model"), "y", "rf", "gb")
        stacks = here.unionByName(there).persist()
        fitted = ensemble.calibration(ensemble.stacked(stacks, ensemble.fit_ridge(stacks)))
        names = F.array(*(F.lit(kind) for kind in kinds))
        found = sizing.cut(fitted.select(F.element_at(names, F.col("model") + 1).alias("kind"), "oof_r2"))
        stacks.unpersist()
        return found

    @cached_property
    def ridge(self) -> DataFrame:
        return ensemble.fit_ridge(self.rule_oof).persist()

    @cached_property
    def stacked(self) -> DataFrame:
        return ensemble.stacked(ensemble.complete_oof(self.rule_oof), self.ridge).persist()

    @cached_property
    def calibration(self) -> DataFrame:
        return ensemble.calibration(self.stacked).persist()

    @cached_property
    def lookahead(self) -> DataFrame:
        changed = integrity.perturbed_bars(self.bars(), integrity.cut_days(self.bars()))
        other = sizing.stored(ft.features(changed, P), "ticker", "date", in_place=True)
        return sizing.cut(integrity.lookahead_changes(self.bars(), P, base=self.features, other=other))

    @cached_property
    def lagged(self) -> DataFrame:
        """The panel of features lagged by a row, normalised; both of its readings take the stored one."""
        shifted = ft.lag_features(self.features, 1, P).select("ticker", "date", *FEATURES, "y", "label_end")
        rows = pn.build_panel(sizing.stored(shifted, "ticker", "date", in_place=True))
        return pn.normalise(rows, "date", span=self.span, stats=sizing.cut(pn.cross_section_stats(rows, "date", FEATURES)))

    @cached_property
    def fold_summary(self) -> DataFrame:
        return folds.fold_summary(self.panel, self.roles, P).persist()

    @cached_property
    def as_ofs(self) -> list:
        """Last bar day of every calendar year: a handful of dates."""
        rows = self.bars().groupBy(F.year("date").alias("yr")).agg(F.max("date").alias("d")).collect()
        return sorted(r["d"] for r in rows)

    @cached_property
    def latest(self) -> DataFrame:
        return scoring.latest_rows_at(self.features, self.as_ofs, P).persist()

    @cached_property
    def latest_z(self) -> DataFrame:
        return scoring.normalised_latest(self.latest, len(self.as_ofs))

    @cached_property
    def rule_predictions(self) -> DataFrame:
        c = F.col
        votes = F.array(*[0.06 + 0.03 * c(v) for v in ("ret_5d", "ret_10d", "ret_21d", "ret_42d", "ret_63d")])
        scored = self.latest_z.select(
            F.lit(1).alias("model"), "as_of", "ticker", (0.06 + 0.03 * c("mom_3_1")).alias("rf"),
            (0.06 + 0.03 * c("ret_21d")).alias("gb"), votes.alias("votes"))
        scored = scored.withColumn("pred", 0.5 * c("rf") + 0.5 * c("gb")).withColumn(
            "confidence", ensemble.agreement(c("rf"), c("gb")))
        sigma = self.spark.range(1).select(F.lit(1).alias("model"), F.lit(0.04).alias("residual_std"))
        return scoring.predictions(scored, sigma, P).drop("model")

    @cached_property
    def info(self) -> DataFrame:
        return bs.instruments(self.spark, self.sf_dir, "supplier", self.bars())

    @cached_property
    def signals(self) -> DataFrame:
        return sg.signals(self.rule_predictions, self.latest, self.info, P).persist()

    @cached_property
    def problems(self) -> DataFrame:
        cands = sg.candidates(self.signals, P.min_expected_return, P)
        return allocation.problems(allocation.trailing_returns(cands, self.bars(), P))

    @cached_property
    def covariance(self) -> DataFrame:
        return allocation.covariance(self.problems).persist()

    @cached_property
    def weights(self) -> DataFrame:
        return allocation.optimise(self.covariance, P).persist()

    # ------------------------------------------------------------ models
    @cached_property
    def model_z(self) -> DataFrame:
        return self.z.select("date", "ticker", "y", *FEATURES)

    @cached_property
    def model_rows(self) -> DataFrame:
        return research.matrix(self.model_z)

    @cached_property
    def model_base(self) -> forests.Ensembles:
        """Both learners over the whole panel, for queries that read no fold."""
        return research.whole(self.model_rows, MODEL)

    @cached_property
    def model_folds(self) -> tuple:
        """Out-of-fold rows, ridge, calibration and fold summary, for queries that read no fit of the whole panel."""
        return research.out_of_fold(self.model_z, MODEL, data=self.model_rows)

    @cached_property
    def model(self) -> research.StackedModel:
        oof, ridge, calibration, summary = self.model_folds
        return research.StackedModel(self.model_base, ridge, calibration, oof, summary, 1)

    @cached_property
    def refits(self) -> tuple[refits.Refits, list]:
        return refits.falsification(self.model_z, self.lagged.select("date", "ticker", "y", *FEATURES), SEEDS, MODEL)

    @cached_property
    def falsification(self) -> DataFrame:
        found, kinds = self.refits
        return refits.named(found.calibration, kinds).persist()

    @cached_property
    def walk(self) -> tuple[DataFrame, DataFrame]:
        """Schedule of refitted models over the common dates of the regions, and the calibration of every retrain."""
        daily = self.bars("region")
        feats = sizing.cut(ft.features(daily, P))
        info = bs.instruments(self.spark, self.sf_dir, "region", daily)
        schedule, fitted = refits.walk_forward(feats, daily, info, self.rebalances, WALK, self.span)
        return sizing.cut(schedule), fitted

    @cached_property
    def walk_ledger(self) -> DataFrame:
        """The refitted models' schedule beside equal weight and the index, on the same dates."""
        schedule = self.walk[0].unionByName(self.schedule.where("strategy <> 'strategy'"))
        return ledger.roll_forward(self.ledger_closes, schedule, self.each_rebalance, self.strategies).persist()

    # ------------------------------------------------------------ ledger
    @cached_property
    def calendar(self) -> DataFrame:
        return ledger.common_calendar(self.bars("region")).persist()

    @cached_property
    def rebalances(self) -> DataFrame:
        return ledger.rebalance_dates(self.calendar, P).persist()

    @cached_property
    def index_series(self) -> DataFrame:
        return ledger.align_series(self.bars("index"), self.calendar)

    @cached_property
    def schedule(self) -> DataFrame:
        """Top two by 63-row return, equal weight, and the index, at every rebalance."""
        from pyspark.sql import Window
        close = F.col("close").cast("double")
        per = Window.partitionBy("ticker").orderBy("date")
        mom = self.bars("region").select(
            "ticker", "date", (F.try_divide(close, F.lag(close, 63).over(per)) - 1).alias("r"))
        order = Window.partitionBy("k").orderBy(F.col("r").desc_nulls_last(), "ticker")
        top = self.rebalances.join(mom, "date").withColumn("rn", F.row_number().over(order)).where("rn <= 2")
        n, k = self.bars("region").select("ticker").distinct().count(), self.rebalances.count()
        return (top.select(F.lit("strategy").alias("strategy"), "k", "ticker", F.lit(0.5).alias("weight"))
                .unionByName(ledger.equal_weight(k, self.bars("region"), n))
                .unionByName(ledger.single_holding(self.rebalances, "INDEX", "index")))

    @cached_property
    def strategies(self) -> DataFrame:
        return self.spark.createDataFrame(
            [("strategy", 1.0 - P.cash_reserve, P.cost_rate, P.initial_capital),
             ("equal_weight", 1.0, P.cost_rate, P.initial_capital),
             ("index", 1.0, P.cost_rate, P.initial_capital)],
            "strategy string, invest_fraction double, cost_rate double, capital double")

    @cached_property
    def ledger_closes(self) -> DataFrame:
        return self.bars("region").select("date", "ticker", F.col("close").cast("double").alias("close")) \
            .unionByName(self.index_series.select("date", F.lit("INDEX").alias("ticker"), "close"))

    @cached_property
    def each_rebalance(self) -> DataFrame:
        return self.strategies.select("strategy").crossJoin(self.rebalances)

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger.roll_forward(self.ledger_closes, self.schedule, self.each_rebalance, self.strategies).persist()

    @cached_property
    def window_status(self) -> DataFrame:
        return ledger.window_status(self.calendar, P).persist()

    @cached_property
    def performance(self) -> DataFrame:
        return ledger.performance(self.ledger, P, policies=self.strategies, status=self.window_status).persist()


_STAGES: dict[tuple[str, str], Stage] = {}


def stage(spark: SparkSession, sf_dir: str) -> Stage:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGES:
        _STAGES[key] = Stage(spark, sf_dir)
    return _STAGES[key]


def forget(spark: SparkSession) -> None:
    """Drop all shared stages and their cached data."""
    spark.catalog.clearCache()
    _STAGES.clear()


def query(name: str, parts: list[str] | None = None, final: str | None = None):
    def wrap(fn: Callable[[Stage], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(stage(spark, sf_dir))
        if final is not None:
            ORACLES[name] = o.sql(parts or [], final) if parts else final
        return fn
    return wrap


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double, named."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits).alias(name or c)


def rs(cols: list[str], digits: int = 6) -> list[Column]:
    return [r(c, digits) for c in cols]


def sr(cols: list[str], digits: int = 6) -> str:
    """The same rounding in SQL."""
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols)


# Columns whose size needs fewer decimals to be comparable.
COARSE = {"obv_trend": 2}


def feature_round(cols: list[str], digits: int = 6) -> list[Column]:
    return [r(c, COARSE.get(c, digits)) for c in cols]


def feature_sql(cols: list[str], digits: int = 6) -> str:
    return ", ".join(sr([c], COARSE.get(c, digits)) for c in cols)


OHLC = ["open", "high", "low", "close"]
SUP = o.bars("supplier")
F_ROWS = SUP + o.feature_rows()
FEATS = F_ROWS + o.features()
PANEL = FEATS + o.panel()
Z = PANEL + o.normalised()
FOLDS = PANEL + o.positions() + o.folds()
OOF = Z + o.positions() + o.folds() + o.rule_oof()
STACK = OOF + o.ridge()
LATEST = FEATS + o.as_ofs() + o.latest()
SIGNALS = LATEST + o.rule_predictions() + o.signals()
COV = SIGNALS + o.returns() + o.covariance()
ALLOC = COV + o.allocation()
LEDGER = o.bars("region") + o.calendar() + o.rebalances() + o.aligned_index() + o.schedules() + o.ledger()
PERF = LEDGER + o.metrics()


# ------------------------------------------------------------------ sources
def _bar_query(key: str) -> None:
    @query(f"bars_{key}", o.bars(key), f"SELECT ticker, date, {sr(OHLC, 4)}, volume FROM bars")
    def _(s: Stage) -> DataFrame:
        return s.bars(key).select("ticker", "date", *rs(OHLC, 4), "volume")


for _key in ("supplier", "nation", "region", "brand", "index"):
    _bar_query(_key)


def _raw(s: Stage) -> DataFrame:
    """Brand bars with some bad rows: every 97th day has no positive close, every 89th no volume."""
    day = F.unix_date("date")
    return s.bars("brand").select(
        "ticker", "date", "open", "high", "low",
        F.when(F.pmod(day, F.lit(97)) == 0, F.lit(0.0)).otherwise(F.col("close")).cast("double").alias("close"),
        F.when(F.pmod(day, F.lit(89)) != 0, F.col("volume")).alias("volume"))


RAW = o.bars("brand") + ["""raw AS MATERIALIZED (SELECT ticker, date, open, high, low,
    CASE WHEN (date - DATE '1970-01-01') % 97 = 0 THEN 0 ELSE CAST(close AS DOUBLE) END AS close,
    CASE WHEN (date - DATE '1970-01-01') % 89 <> 0 THEN volume END AS volume FROM bars)"""]
LONG = P.with_(min_bars=1500)


@query("landing_normalise", RAW, f"""SELECT ticker, date, {sr(OHLC, 4)}, volume FROM
    (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM raw WHERE close > 0 AND volume IS NOT NULL) WHERE n >= 1500""")
def _(s: Stage) -> DataFrame:
    return sn.normalise_prices(_raw(s), LONG).select("ticker", "date", *rs(OHLC, 4), "volume")


BRAND_LIST = """listed AS (SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS ord, p_brand AS ticker
    FROM (SELECT DISTINCT p_brand FROM part UNION ALL SELECT 'Brand#missing'))"""


def _brands(s: Stage) -> DataFrame:
    from pyspark.sql import Window
    names = bs.table(s.spark, s.sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct() \
        .unionByName(s.spark.range(1).select(F.lit("Brand#missing").alias("ticker")))
    return names.select((F.row_number().over(Window.orderBy("ticker")) - 1).alias("ord"), "ticker")


@query("landing_rejected", RAW + [BRAND_LIST], """SELECT ticker, reason, n_good FROM (SELECT l.ticker, coalesce(n_good, 0) AS n_good,
    CASE WHEN n_raw IS NULL THEN 'missing' WHEN n_good = 0 THEN 'no valid rows' WHEN n_good < 1500 THEN 'short history' END AS reason
    FROM listed l LEFT JOIN (SELECT ticker, count(*) AS n_raw, count(*) FILTER (close > 0 AND volume IS NOT NULL) AS n_good
    FROM raw GROUP BY ticker) c USING (ticker)) WHERE reason IS NOT NULL""")
def _(s: Stage) -> DataFrame:
    return sn.rejected(_brands(s), _raw(s), LONG)


@query("snapshot_roundtrip", o.bars("region"), f"""SELECT ticker, date, {sr(OHLC, 4)}, volume FROM bars""")
def _(s: Stage) -> DataFrame:
    import datetime as dt
    root = sizing.shared_path(s.spark, "snapshots")
    today, before = dt.date(2024, 1, 2), dt.date(2024, 1, 1)
    sn.write_snapshot(s.bars("nation"), root, "prices", before)
    sn.write_snapshot(s.bars("region"), root, "prices", today)
    return sn.scan_snapshot(s.spark, root, "prices", today).select("ticker", "date", *rs(OHLC, 4), "volume")


def _written_files(s: Stage) -> str:
    """Region bars as parquet files, and one file that is none."""
    root = sizing.shared_path(s.spark, "landing")
    s.bars("region").select(*[f.name for f in bs.BAR_SCHEMA]).repartition(5, "ticker").write.parquet(root)
    path = s.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/part-broken.parquet")
    out = path.getFileSystem(s.spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(b"cut off while it was written"))
    out.close()
    return root


@query("landing_broken_file", o.bars("region"), f"SELECT ticker, date, {sr(OHLC, 4)}, volume FROM bars")
def _(s: Stage) -> DataFrame:
    """All rows of the readable files, though one file is broken."""
    return sn.scan_files(s.spark, _written_files(s))[0].select("ticker", "date", *rs(OHLC, 4), "volume")


@query("landing_broken_list", o.bars("region"), "SELECT 'part-broken.parquet' AS file, count(*) > 0 AS others_landed FROM bars")
def _(s: Stage) -> DataFrame:
    rows, lost = sn.scan_files(s.spark, _written_files(s))
    landed = rows.agg((F.count("*") > 0).alias("others_landed"))
    return lost.select(F.element_at(F.split("path", "/"), -1).alias("file")).crossJoin(landed)


def _mixed_files(s: Stage) -> str:
    """Region bars as CSV files with three headers, one of which lacks the volume."""
    root, kept = sizing.shared_path(s.spark, "mixed"), s.bars("region")
    first = kept.where("ticker LIKE 'A%'").select(
        F.col("ticker").alias("Ticker"), F.col("date").alias("Date"), *[F.col(c).alias(c.title()) for c in sn.REQUIRED])
    second = kept.where("ticker LIKE 'E%'").select(
        *[F.col(c).alias(c.upper()) for c in reversed(sn.REQUIRED)], F.lit("x").alias("Note"), F.col("date").alias("DATE"), F.col("ticker").alias(" Ticker"))
    third = kept.where("ticker LIKE 'M%'").select("ticker", "date", *sn.REQUIRED[:4])
    for name, df in (("a", first), ("b", second), ("c", third)):
        df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{root}/{name}")
    return root


@query("landing_mixed_headers", o.bars("region"), f"SELECT ticker, date, {sr(OHLC, 3)}, volume FROM bars WHERE ticker[1] IN ('A', 'E')")
def _(s: Stage) -> DataFrame:
    return sn.scan_mixed(s.spark, _mixed_files(s))[0].select("ticker", "date", *rs(OHLC, 3), "volume")


@query("landing_mixed_rejected", o.bars("region"), "SELECT 'missing: volume' AS reason, count(DISTINCT ticker) > 0 AS some FROM bars WHERE ticker[1] = 'M'")
def _(s: Stage) -> DataFrame:
    return sn.scan_mixed(s.spark, _mixed_files(s))[1].groupBy("reason").agg((F.count("*") > 0).alias("some"))


ZONES = ["UTC", "Asia/Tokyo", "America/New_York", "Australia/Sydney", "America/Los_Angeles", "Europe/Berlin", "Asia/Kolkata"]
#: Of each line, an instant at some hour of its shipping day in UTC, and the zone of its source.
HOUR = "(l_orderkey * 7 + l_linenumber * 5) % 24"


@query("landing_wall_clock", None, f"""SELECT l_orderkey, l_linenumber, CAST(timezone({ZONES!r}[CAST(l_linenumber % 7 AS INTEGER) + 1],
    timezone('UTC', date_trunc('day', l_shipdate) + to_hours(CAST({HOUR} AS INTEGER)))) AS DATE) AS day FROM lineitem""")
def _(s: Stage) -> DataFrame:
    """Instants as days on their own source's wall clock, whatever the session's zone."""
    lines = bs.table(s.spark, s.sf_dir, "lineitem")
    shipped = F.unix_date(F.to_date(F.col("l_shipdate").cast("timestamp_ntz"))).cast("long") * 86400
    instant = F.timestamp_seconds(shipped + F.expr(HOUR) * 3600)
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("l_linenumber") % 7).cast("int"))
    return lines.select("l_orderkey", "l_linenumber", sn.wall_clock_date(instant, zone).alias("day"))


@query("snapshot_info", SUP + [o.INFO], "SELECT ticker, sector, round(market_cap, 2) AS market_cap FROM info JOIN (SELECT DISTINCT ticker FROM bars) USING (ticker)")
def _(s: Stage) -> DataFrame:
    """Instrument rows written for two dates and read for one."""
    import datetime as dt
    root = sizing.shared_path(s.spark, "snapshots")
    own = s.info.withColumn("short_name", F.col("ticker"))
    sn.write_snapshot(own.withColumn("sector", F.lit("stale")), root, "info", dt.date(2024, 1, 1))
    sn.write_snapshot(own, root, "info", dt.date(2024, 1, 2))
    return sn.scan_snapshot(s.spark, root, "info", dt.date(2024, 1, 2)).select("ticker", "sector", r("market_cap", 2))


@query("snapshot_universe", None, "SELECT CAST(n_nationkey AS INTEGER) AS ord, n_name AS ticker, 'stored' AS source FROM nation UNION ALL SELECT CAST(r_regionkey AS INTEGER), r_name, 'fallback' FROM region")
def _(s: Stage) -> DataFrame:
    """The list of a date that was stored, and the fallback for one that wasn't."""
    import datetime as dt
    root = sizing.shared_path(s.spark, "snapshots")
    listed = bs.table(s.spark, s.sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("ticker"))
    spare = bs.table(s.spark, s.sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("ticker"))
    sn.write_snapshot(listed, root, "universe", dt.date(2024, 1, 2))

    def of(day: dt.date) -> DataFrame:
        return un.with_fallback(sn.scan_snapshot(s.spark, root, "universe", day), spare)

    return of(dt.date(2024, 1, 2)).withColumn("source", F.lit("stored")).unionByName(of(dt.date(2024, 1, 3)).withColumn("source", F.lit("fallback")))


#: Account balances as a careless source would write them.
SAID = ["{v}", " {v} ", "{v} USD", "inf", "-Infinity", "NaN", "", "1e400", None]


@query("universe_numbers", None, """SELECT s_suppkey, round(CASE WHEN s_suppkey % 9 IN (0, 1) THEN s_acctbal ELSE 0 END, 4) AS number FROM supplier""")
def _(s: Stage) -> DataFrame:
    v = F.col("s_acctbal").cast("string")
    told = F.array(*[F.lit(None).cast("string") if t is None else F.concat(F.lit(t.split("{v}")[0]), v, F.lit(t.split("{v}")[1])) if "{v}" in t else F.lit(t)
                     for t in SAID])
    return bs.table(s.spark, s.sf_dir, "supplier").select(
        "s_suppkey", r(un.as_number(F.get(told, (F.col("s_suppkey") % 9).cast("int"))), 4, "number"))


@query("snapshot_split", o.bars("nation"), """SELECT n_name AS ticker, n_name IN (SELECT ticker FROM bars) AS cached FROM nation""")
def _(s: Stage) -> DataFrame:
    listed = bs.table(s.spark, s.sf_dir, "nation").select(F.col("n_name").alias("ticker"))
    have, todo = sn.split_cached(listed, s.bars("nation"))
    return have.withColumn("cached", F.lit(True)).unionByName(todo.withColumn("cached", F.lit(False)))


@query("universe_symbols", None, """SELECT CAST(p_partkey AS INTEGER) AS ord, upper(trim(replace(replace(p_name, ' ', '.'), '.', '-'))) AS ticker
    FROM part WHERE length(trim(p_name)) > 0""")
def _(s: Stage) -> DataFrame:
    raw = bs.table(s.spark, s.sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("ord"), un.symbol(F.translate("p_name", " ", ".")).alias("ticker"))
    return un.custom_symbols(raw)


@query("universe_cap", None, """SELECT * FROM (SELECT CAST(p_partkey AS INTEGER) AS ord, p_name AS ticker FROM part) ORDER BY ord LIMIT 150""")
def _(s: Stage) -> DataFrame:
    listed = bs.table(s.spark, s.sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("ord"), F.col("p_name").alias("ticker"))
    return un.capped(listed, P)


SCREEN_PARAMS = P.with_(min_market_cap=3000.0, min_avg_volume=25.5, min_price=90.0, max_price=115.0)
SCREEN = SUP + [o.INFO, """screen AS MATERIALIZED (SELECT ticker, sector, market_cap, average_volume, last_close,
    CASE WHEN market_cap > 0 AND market_cap < 3000 THEN 'low_cap' WHEN average_volume > 0 AND average_volume < 25.5 THEN 'low_vol'
    WHEN last_close < 90 OR last_close > 115 THEN 'price' END AS reason FROM
    (SELECT ticker, CASE WHEN right(ticker, 1) = '5' THEN 'Unknown' ELSE sector END AS sector,
      CASE WHEN right(ticker, 1) = '7' THEN 0 ELSE market_cap END AS market_cap,
      average_volume, last_close FROM (SELECT ticker, avg(volume) AS average_volume, CAST(arg_max(close, date) AS DOUBLE) AS last_close
    FROM bars GROUP BY ticker) LEFT JOIN info USING (ticker)))"""]


def _screen(s: Stage) -> DataFrame:
    info = s.info.select("ticker", F.when(F.col("ticker").endswith("5"), "").otherwise(F.col("sector")).alias("sector"),
                         F.when(F.col("ticker").endswith("7"), F.lit(0.0)).otherwise(F.col("market_cap")).alias("market_cap"),
                         "average_volume")
    return un.screened(s.bars(), info, SCREEN_PARAMS)


@query("universe_screen", SCREEN, f"SELECT ticker, sector, reason, {sr(['market_cap'], 2)}, {sr(['average_volume', 'last_close'], 4)} FROM screen")
def _(s: Stage) -> DataFrame:
    return _screen(s).select("ticker", "sector", "reason", r("market_cap", 2), *rs(["average_volume", "last_close"], 4))


@query("universe_accepted", SCREEN, "SELECT ticker, sector FROM screen WHERE reason IS NULL")
def _(s: Stage) -> DataFrame:
    return un.accepted(_screen(s)).select("ticker", "sector")


@query("universe_skip_counts", SCREEN, "SELECT reason, count(*) AS n FROM screen WHERE reason IS NOT NULL GROUP BY reason")
def _(s: Stage) -> DataFrame:
    return un.skip_counts(_screen(s))


# ----------------------------------------------------------------- features
GROUPS = {
    "trend": ["price_sma_10", "price_sma_21", "price_sma_50", "price_sma_100", "price_sma_200", "golden_cross_dist"],
    "ema": ["price_ema_10", "price_ema_21", "price_ema_50", "price_ema_100", "price_ema_200", "macd_hist", "macd_hist_norm"],
    "momentum": ["ret_5d", "ret_10d", "ret_21d", "ret_42d", "ret_63d", "ret_126d", "ret_252d", "mom_12_1", "mom_6_1", "mom_3_1"],
    "volatility": ["vol_10d", "vol_21d", "vol_63d", "vol_ratio", "parkinson_vol_21"],
    "rsi": ["rsi_7", "rsi_14", "rsi_21"],
    "bands": ["bb_position", "bb_width", "zscore_21", "zscore_50"],
    "volume": ["rel_vol_5", "rel_vol_21", "obv_trend"],
    "levels": ["dist_52w_high", "dist_52w_low", "breakout_20d"],
    "moments": ["skew_21", "kurt_21", "mean_rev_5", "mean_rev_21"],
}


def _feature_query(group: str, cols: list[str]) -> None:
    parts = SUP + o.feature_rows(ema=group == "ema")

    @query(f"features_{group}", parts, f"SELECT ticker, date, {feature_sql(cols)} FROM f")
    def _(s: Stage) -> DataFrame:
        return ft.indicator_rows(s.bars(), P).select("ticker", "date", *feature_round(cols))


for _group, _cols in GROUPS.items():
    _feature_query(_group, _cols)


@query("features_complete", FEATS, f"SELECT ticker, date, bar_no, row_no, n_rows, {feature_sql(FEATURES, 4)} FROM feats")
def _(s: Stage) -> DataFrame:
    return s.features.select("ticker", "date", "bar_no", "row_no", "n_rows", *feature_round(FEATURES, 4))


@query("features_lagged", FEATS + o.lagged(1), f"SELECT ticker, date, row_no, {feature_sql(FEATURES, 4)} FROM lagged")
def _(s: Stage) -> DataFrame:
    return ft.lag_features(s.features, 1, P).select("ticker", "date", "row_no", *feature_round(FEATURES, 4))


# ------------------------------------------------------------ panel, folds
@query("labels_forward", SUP, f"""SELECT * FROM (SELECT ticker, date,
    round(lead(CAST(close AS DOUBLE), 21) OVER w / CAST(close AS DOUBLE) - 1, 6) AS y, lead(date, 21) OVER w AS label_end
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE y IS NOT NULL""")
def _(s: Stage) -> DataFrame:
    return pn.labels(s.bars(), P).select("ticker", "date", r("y"), "label_end")


@query("panel_cutoff", FEATS + o.panel(where="label_end < DATE '2000-06-30'"),
       f"SELECT date, ticker, round(y, 6) AS y, label_end, {sr(['ret_21d', 'vol_21d'])} FROM panel")
def _(s: Stage) -> DataFrame:
    import datetime as dt
    return pn.build_panel(s.features, dt.date(2000, 6, 30)).select(
        "date", "ticker", r("y"), "label_end", *rs(["ret_21d", "vol_21d"]))


@query("panel_foreign_labels", FEATS + ["""lab AS (SELECT * FROM (SELECT ticker, date,
    lead(CAST(close AS DOUBLE), 5) OVER w / CAST(close AS DOUBLE) - 1 AS y, lead(date, 5) OVER w AS label_end
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE y IS NOT NULL)"""],
    "SELECT f.date, f.ticker, round(lab.y, 6) AS y, lab.label_end FROM feats f JOIN lab USING (ticker, date)")
def _(s: Stage) -> DataFrame:
    return pn.build_panel(s.features, label_table=pn.labels(s.bars(), P.with_(horizon=5))).select(
        "date", "ticker", r("y"), "label_end")


@query("panel_zscore", Z, f"SELECT date, ticker, {sr(FEATURES, 4)} FROM z")
def _(s: Stage) -> DataFrame:
    return s.z.select("date", "ticker", *rs(FEATURES, 4))


@query("panel_profile", PANEL, f"""SELECT count(*) AS n_rows, {len(FEATURES)} AS n_features, count(DISTINCT date) AS n_dates,
    count(DISTINCT ticker) AS n_tickers, round(avg(y), 6) AS y_mean, round(stddev_samp(y), 6) AS y_std FROM panel""")
def _(s: Stage) -> DataFrame:
    return pn.panel_profile(s.panel).select("n_rows", "n_features", "n_dates", "n_tickers", r("y_mean"), r("y_std"))


@query("panel_gate", PANEL, "SELECT count(*) >= 200 AS enough FROM panel")
def _(s: Stage) -> DataFrame:
    return s.panel.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") >= P.min_panel_rows).alias("enough"))


@query("fold_positions", FOLDS, "SELECT date, pos, n_dates FROM pos")
def _(s: Stage) -> DataFrame:
    return s.positions


@query("fold_bounds", FOLDS, "SELECT fold, train_stop, val_start, val_stop FROM folds")
def _(s: Stage) -> DataFrame:
    return folds.fold_bounds(s.positions, P)


@query("fold_assignment", FOLDS, "SELECT panel.date, ticker, pos, fold, role FROM panel JOIN roles ON roles.date = panel.date")
def _(s: Stage) -> DataFrame:
    return folds.assign(s.panel.select("date", "ticker"), s.roles).select("date", "ticker", "pos", "fold", "role")


FOLD_SUMMARY = """SELECT fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'val') AS val_rows,
    max(panel.date) FILTER (role = 'train') AS train_max_date, min(panel.date) FILTER (role = 'val') AS val_min_date,
    max(panel.date) FILTER (role = 'val') AS val_max_date,
    min(pos) FILTER (role = 'val') - max(pos) FILTER (role = 'train') AS gap_trading_days, 21 AS embargo,
    max(pos) FILTER (role = 'train') + 21 < min(pos) FILTER (role = 'val') AS ordering_ok
    FROM panel JOIN roles ON roles.date = panel.date GROUP BY fold"""


@query("fold_summary", FOLDS, FOLD_SUMMARY)
def _(s: Stage) -> DataFrame:
    return s.fold_summary


# ----------------------------------------------------------------- stacking
@query("ridge_fit", STACK, f"SELECT model, n, alpha, {sr(['loo_error', 'w_rf', 'w_gb', 'intercept'])} FROM ridge")
def _(s: Stage) -> DataFrame:
    return s.ridge.select("model", "n", "alpha", *rs(["loo_error", "w_rf", "w_gb", "intercept"]))


@query("oof_stacked", STACK, f"SELECT date, ticker, fold, {sr(['rf', 'gb', 'tree_std', 'y', 'pred', 'confidence'])} FROM stk")
def _(s: Stage) -> DataFrame:
    return s.stacked.select("date", "ticker", "fold", *rs(["rf", "gb", "tree_std", "y", "pred", "confidence"]))


@query("calibration", STACK, f"""SELECT model, n_oof, {sr(['oof_r2', 'residual_std', 'residual_mae'])},
    CASE WHEN oof_r2 > 0.05 THEN 'suspicious' WHEN oof_r2 < -0.05 THEN 'powerless' ELSE 'plausible' END AS r2_flag FROM cal""")
def _(s: Stage) -> DataFrame:
    return s.calibration.select(
        "model", "n_oof", *rs(["oof_r2", "residual_std", "residual_mae"]), "r2_flag")


# ------------------------------------------------------- scoring, portfolio
@query("latest_rows", LATEST, f"SELECT as_of, ticker, date, row_no, {sr(['ret_21d', 'vol_21d', 'mom_12_1'])} FROM latest")
def _(s: Stage) -> DataFrame:
    return s.latest.select("as_of", "ticker", "date", "row_no", *rs(["ret_21d", "vol_21d", "mom_12_1"]))


@query("latest_single", FEATS, f"""SELECT ticker, date, {sr(['ret_21d', 'vol_21d'])} FROM (SELECT *,
    row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM feats WHERE date <= DATE '2001-06-30') WHERE rn = 1""")
def _(s: Stage) -> DataFrame:
    import datetime as dt
    return scoring.latest_rows(s.features, dt.date(2001, 6, 30)).select("ticker", "date", *rs(["ret_21d", "vol_21d"]))


@query("latest_zscore", LATEST, f"SELECT as_of, ticker, {sr(FEATURES, 4)} FROM latest_z")
def _(s: Stage) -> DataFrame:
    return s.latest_z.select("as_of", "ticker", *rs(FEATURES, 4))


PRED_COLS = ["expected_return", "ci_low", "ci_high", "confidence", "tree_std", "calibrated_std", "rf_pred", "gb_pred"]


@query("predictions", SIGNALS, f"SELECT as_of, ticker, {sr(PRED_COLS)} FROM preds")
def _(s: Stage) -> DataFrame:
    return s.rule_predictions.select("as_of", "ticker", *rs(PRED_COLS))


@query("prediction_summary", SIGNALS, """SELECT as_of, count(*) AS n, round(min(expected_return), 6) AS min_return,
    round(max(expected_return), 6) AS max_return, round(avg(expected_return), 6) AS mean_return FROM preds GROUP BY as_of""")
def _(s: Stage) -> DataFrame:
    return scoring.prediction_summary(s.rule_predictions).select(
        "as_of", "n", *rs(["min_return", "max_return", "mean_return"]))


SIGNAL_COLS = ["expected_return", "ci_low", "confidence", "conf_adj_return", "vol_21d", "sharpe_est", "momentum_quality", "composite"]


@query("signals_ranked", SIGNALS, f"SELECT as_of, rank, ticker, conviction, sector, {sr(SIGNAL_COLS)} FROM ranked")
def _(s: Stage) -> DataFrame:
    return sg.ranked(s.signals).select("as_of", "rank", "ticker", "conviction", "sector", *rs(SIGNAL_COLS))


@query("candidates", SIGNALS, f"SELECT as_of, pick, ticker, conviction, {sr(['expected_return', 'composite'])} FROM cand")
def _(s: Stage) -> DataFrame:
    return sg.candidates(s.signals, P.min_expected_return, P).select(
        "as_of", "pick", "ticker", "conviction", *rs(["expected_return", "composite"]))


@query("aligned_returns", COV, "SELECT as_of, ticker, n, round(ret, 8) AS ret FROM rets0 JOIN dims USING (as_of) WHERE n <= m")
def _(s: Stage) -> DataFrame:
    rows = s.problems.select("as_of", F.explode(F.arrays_zip("c", "r")).alias("z"))
    flat = rows.select("as_of", F.col("z.c.ticker").alias("ticker"), F.posexplode("z.r").alias("i", "ret"))
    return flat.select("as_of", "ticker", (F.col("i") + 1).alias("n"), r("ret", 8))


@query("shrinkage", COV, "SELECT as_of, m, p, round(mu, 10) AS mu, round(shrink, 6) AS shrink FROM shr")
def _(s: Stage) -> DataFrame:
    return s.covariance.select("as_of", "m", F.size("c").alias("p"), r("mu", 10), r("shrink"))


@query("covariance", COV, "SELECT as_of, ti AS ticker_i, tj AS ticker_j, round(cov, 10) AS cov FROM cov")
def _(s: Stage) -> DataFrame:
    return allocation.covariance_rows(s.covariance).select("as_of", "ticker_i", "ticker_j", r("cov", 10))


SHORT = P.with_(trading_days=24)
SHORT_COV = SIGNALS + [sql.replace("n <= 252", "n <= 24") for sql in o.returns()] + o.covariance()


@query("covariance_short", SHORT_COV, "SELECT as_of, m, ti AS ticker_i, tj AS ticker_j, m < p + 5 AS diagonal, round(cov, 10) AS cov FROM cov JOIN (SELECT as_of, m, p FROM shr) USING (as_of)")
def _(s: Stage) -> DataFrame:
    """With 24 returns each, days of 20 candidates or more have a diagonal covariance, the others a shrunk one."""
    cands = sg.candidates(s.signals, P.min_expected_return, P)
    made = allocation.covariance(allocation.problems(allocation.trailing_returns(cands, s.bars(), SHORT))).persist()
    size = made.select("as_of", "m", (F.col("m") < F.size("c") + allocation.SPARE_ROWS).alias("diagonal"))
    return allocation.covariance_rows(made).join(size, "as_of").select("as_of", "m", "ticker_i", "ticker_j", "diagonal", r("cov", 10))


@query("cap_feasibility", ALLOC, "SELECT as_of, feasible FROM feas")
def _(s: Stage) -> DataFrame:
    return s.weights.select("as_of", "feasible").distinct()


@query("allocation", ALLOC, "SELECT as_of, ticker, rule, feasible, round(weight, 6) AS weight, round(sharpe, 6) AS sharpe FROM alloc")
def _(s: Stage) -> DataFrame:
    return s.weights.select("as_of", "ticker", "rule", "feasible", r("weight"), r("sharpe"))


@query("portfolio_metrics", ALLOC, """SELECT as_of, round(r, 6) AS expected_return, round(v, 6) AS expected_volatility,
    round((r - 0.045) / greatest(v, 0.01), 6) AS sharpe_ratio, n AS num_positions, round(w, 6) AS max_position FROM
    (SELECT as_of, sum(weight * expected_return) AS r, sqrt(sum(weight * weight * volatility * volatility)) AS v, count(*) AS n,
     max(weight) AS w FROM alloc WHERE weight > 0.01 GROUP BY as_of)""")
def _(s: Stage) -> DataFrame:
    return allocation.portfolio_metrics(s.weights, P).select(
        "as_of", *rs(["expected_return", "expected_volatility", "sharpe_ratio"]), "num_positions", r("max_position"))


@query("sector_weights", ALLOC, "SELECT as_of, sector, round(sum(weight), 6) AS weight FROM alloc WHERE weight > 0.01 GROUP BY 1, 2")
def _(s: Stage) -> DataFrame:
    return allocation.sector_weights(s.weights).select("as_of", "sector", r("weight"))


POS_COLS = ["expected_return", "ci_low", "ci_high", "confidence"]


@query("positions", ALLOC, f"""SELECT as_of, ticker, round(weight, 6) AS weight, {', '.join(f'round(s.{c}, 6) AS {c}' for c in POS_COLS)},
    s.conviction, s.sector FROM (SELECT as_of, ticker, weight FROM alloc WHERE weight > 0.01) JOIN sig s USING (as_of, ticker)""")
def _(s: Stage) -> DataFrame:
    return allocation.positions(s.weights, s.signals).select(
        "as_of", "ticker", r("weight"), *rs(POS_COLS), "conviction", "sector")


# ------------------------------------------------------------------- ledger
@query("common_calendar", LEDGER, "SELECT date, pos FROM cal0")
def _(s: Stage) -> DataFrame:
    return s.calendar


@query("index_alignment", LEDGER, "SELECT date, round(close, 4) AS close FROM aligned")
def _(s: Stage) -> DataFrame:
    return s.index_series.select("date", r("close", 4))


@query("rebalance_dates", LEDGER, "SELECT k, date, end_date FROM reb")
def _(s: Stage) -> DataFrame:
    return s.rebalances


@query("schedule_table", LEDGER, "SELECT strategy, k, ticker, round(CAST(weight AS DOUBLE), 6) AS weight FROM sched")
def _(s: Stage) -> DataFrame:
    return s.schedule.select("strategy", "k", "ticker", r("weight"))


@query("ledger", LEDGER, """SELECT strategy, k, date, round(value, 2) AS value, round(cost, 2) AS cost, round(turnover, 8) AS turnover,
    n_positions, n_trades FROM book""")
def _(s: Stage) -> DataFrame:
    return s.ledger.select("strategy", "k", "date", r("value", 2), r("cost", 2), r("turnover", 8), "n_positions", "n_trades")


@query("period_returns", PERF, "SELECT strategy, date, round(ret, 6) AS period_return FROM path WHERE ret IS NOT NULL")
def _(s: Stage) -> DataFrame:
    return ledger.period_returns(s.ledger).where("period_return IS NOT NULL").select("strategy", "date", r("period_return"))


PERF_COLS = ["total_return", "cagr", "volatility", "sharpe_ratio", "max_drawdown", "years", "turnover_annualized", "active_cagr"]


@query("performance", PERF, f"""SELECT strategy, n_periods, num_trades, {sr(PERF_COLS)}, {sr(['final_value', 'total_costs'], 2)} FROM perf""")
def _(s: Stage) -> DataFrame:
    return s.performance.select("strategy", "n_periods", "num_trades", *rs(PERF_COLS), *rs(["final_value", "total_costs"], 2))


@query("rebalance_costs", LEDGER, """SELECT k AS id, round(sum(abs(goal - dollars)), 4) AS traded, round(sum(abs(goal - dollars)) * 0.001, 4) AS cost,
    round(sum(goal), 4) AS invested FROM (SELECT *, weight * 0.95 * (1000000 - 0.001 * sum(abs(weight * 0.95 * 1000000 - dollars)) OVER (PARTITION BY k)) AS goal FROM
    (SELECT k, ticker, sum(dollars) AS dollars, sum(weight) AS weight FROM (SELECT k, ticker, CAST(0 AS DOUBLE) AS dollars, weight FROM sched WHERE strategy = 'strategy'
    UNION ALL SELECT k, ticker, weight * 1000000, 0 FROM sched WHERE strategy = 'equal_weight') GROUP BY 1, 2)) GROUP BY k""")
def _(s: Stage) -> DataFrame:
    target = s.schedule.where("strategy = 'strategy'").select(F.col("k").alias("id"), "ticker", "weight")
    current = s.schedule.where("strategy = 'equal_weight'").select(
        F.col("k").alias("id"), "ticker", (F.col("weight") * P.initial_capital).alias("dollars"))
    terms = s.rebalances.select(F.col("k").alias("id"), F.lit(P.initial_capital).alias("value"),
                                F.lit(1.0 - P.cash_reserve).alias("invest_fraction"), F.lit(P.cost_rate).alias("cost_rate"))
    return ledger.rebalance_costs(current, target, terms).select("id", *rs(["traded", "cost", "invested"], 4))


# ------------------------------------------------------------ falsification
@query("permuted_labels", PANEL + ["""ra AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY
    md5(ticker || '-' || CAST(date AS VARCHAR) || '-1000a'), ticker) AS rn FROM panel)""",
    """rb AS (SELECT date, y, row_number() OVER (PARTITION BY date ORDER BY
    md5(ticker || '-' || CAST(date AS VARCHAR) || '-1000b'), ticker) AS rn FROM panel)"""],
    "SELECT date, ticker, round(y, 6) AS y FROM ra JOIN rb USING (date, rn)")
def _(s: Stage) -> DataFrame:
    return falsify.permute_labels(s.panel, falsify.BASE_SEED).select("date", "ticker", r("y"))


# ---------------------------------------------------------------- integrity
PERTURBED = SUP + ["""cut AS MATERIALIZED (SELECT ticker, date AS cut FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i,
    count(*) OVER (PARTITION BY ticker) AS n FROM bars) WHERE n >= 400 AND i = CAST(floor(n * 0.7) AS BIGINT))""",
    """days AS (SELECT b.*, cut, (date - DATE '1970-01-01') + 17 AS d FROM bars b JOIN cut USING (ticker))""",
    f"""pbars AS MATERIALIZED (SELECT ticker, date, {', '.join(f"CAST(CASE WHEN date > cut THEN CAST({c} AS FLOAT) * CAST(0.5 + ((d * 7919) % 1101) / 1000.0 AS FLOAT) ELSE {c} END AS FLOAT) AS {c}" for c in OHLC)},
    CASE WHEN date > cut THEN 1000 + (d * 104729) % 8999000 ELSE volume END AS volume FROM days)"""]
LOOK = PERTURBED + o.feature_rows("bars", "f1") + o.features("f1", "fa") + o.feature_rows("pbars", "f2") + o.features("f2", "fb")


def _gap() -> str:
    return "greatest(" + ", ".join(f"abs(CAST(fa.{f} AS DOUBLE) - CAST(fb.{f} AS DOUBLE))" for f in FEATURES) + ")"


@query("perturbed_bars", PERTURBED, f"SELECT ticker, date, {sr(OHLC, 3)}, volume FROM pbars")
def _(s: Stage) -> DataFrame:
    return integrity.perturbed_bars(s.bars(), integrity.cut_days(s.bars())).select(
        "ticker", "date", *rs(OHLC, 3), "volume")


CHANGES = f"""SELECT ticker, cut, count(*) FILTER (early) AS rows_compared,
    count(*) FILTER (early AND gap IS NULL) AS unmatched, coalesce(max(gap) FILTER (early), 0) AS max_before,
    coalesce(max(gap) FILTER (NOT early) > 0, FALSE) AS changed_after FROM
    (SELECT ticker, date, cut, date <= cut AS early, gap FROM cut LEFT JOIN (SELECT ticker, date, CASE WHEN fa.ticker IS NOT NULL AND fb.ticker IS NOT NULL
     THEN {_gap()} END AS gap FROM fa FULL OUTER JOIN fb USING (ticker, date)) USING (ticker)) GROUP BY ticker, cut"""


@query("lookahead_changes", LOOK, CHANGES)
def _(s: Stage) -> DataFrame:
    return s.lookahead


def _static(s: Stage) -> DataFrame:
    """Features with one planted per-ticker constant."""
    return s.features.withColumn("planted", F.length("ticker").cast("float"))


@query("static_columns", FEATS, "SELECT DISTINCT ticker, 'planted' AS feature FROM feats")
def _(s: Stage) -> DataFrame:
    return integrity.static_columns(_static(s), FEATURES + ["planted"])


CHECK = ["name", "passed", "measure", "detail", "gating", "status"]


def _spreads(source: str, extra: str = "") -> str:
    """SQL for (ticker, feature, spread) of every feature, and of the planted one."""
    cols = FEATURES + (["planted"] if extra else [])
    ranges = ", ".join(f"CASE WHEN count({c}) > 1 THEN CAST(max({c}) AS DOUBLE) - min({c}) END AS {c}" for c in cols)
    return f"""(SELECT ticker, feature, spread FROM (SELECT ticker, {ranges} FROM (SELECT *{extra} FROM {source}) GROUP BY ticker)
        UNPIVOT (spread FOR feature IN ({', '.join(cols)})))"""


PLANTED = ", CAST(length(ticker) AS FLOAT) AS planted"
STATUS = "CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status"


def _fingerprints(name: str, extra: str) -> str:
    return f"""SELECT '{name}' AS name, n = 0 AS passed, n || ' static columns over ' || tickers || ' tickers' AS measure,
        'static columns: ' || CASE WHEN n = 0 THEN 'none' ELSE names END AS detail, FALSE AS gating, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM
        (SELECT count(DISTINCT feature) AS n, string_agg(DISTINCT feature, ', ' ORDER BY feature) AS names FROM {_spreads('feats', extra)} WHERE spread = 0),
        (SELECT count(DISTINCT ticker) AS tickers FROM feats)"""


@query("check_fingerprints_clean", FEATS, _fingerprints("No ticker fingerprints", ""))
def _(s: Stage) -> DataFrame:
    return integrity.no_fingerprints(s.features).select(*CHECK)


@query("check_fingerprints", FEATS, _fingerprints("No ticker fingerprints", PLANTED))
def _(s: Stage) -> DataFrame:
    return integrity.no_fingerprints(_static(s), FEATURES + ["planted"]).select(*CHECK)


FOLD_CHECK = f"""SELECT *, {STATUS} FROM (SELECT 'Temporal folds with embargo' AS name, bool_and(ordering_ok) AS passed,
    'min gap ' || min(gap_trading_days) || ' against embargo 21 over ' || count(*) || ' folds' AS measure,
    CASE WHEN bool_and(ordering_ok) THEN 'every fold keeps the embargo' ELSE 'a fold breaks the embargo' END AS detail, FALSE AS gating FROM fs)"""


@query("check_folds", FOLDS + [f"fs AS ({FOLD_SUMMARY})"], FOLD_CHECK)
def _(s: Stage) -> DataFrame:
    return integrity.cv_ordering(s.fold_summary, P).select(*CHECK)


@query("check_folds_broken", FOLDS + [f"""fs AS (SELECT * REPLACE (CASE WHEN fold = 0 THEN 5 ELSE gap_trading_days END AS gap_trading_days,
    CASE WHEN fold = 0 THEN 5 > 21 ELSE ordering_ok END AS ordering_ok) FROM ({FOLD_SUMMARY}))"""], FOLD_CHECK)
def _(s: Stage) -> DataFrame:
    """The first fold's gap is cut to five days: the check has to fail."""
    first = F.col("fold") == 0
    spoilt = s.fold_summary.withColumns({"gap_trading_days": F.when(first, 5).otherwise(F.col("gap_trading_days")),
                                         "ordering_ok": F.when(first, F.lit(5) > P.embargo).otherwise(F.col("ordering_ok"))})
    return integrity.cv_ordering(spoilt, P).select(*CHECK)


def _costs(bps: float) -> str:
    return f"""SELECT *, {STATUS} FROM (SELECT 'Costs applied' AS name, {bps} >= {integrity.MIN_COST_BPS} AND (own > 0 OR ew > 0) AS passed,
        printf('{bps:.0f} bps per side, strategy %.0f at turnover %.0f %%/yr, equal weight %.0f', own, turn * 100, ew) AS measure,
        printf('paid: strategy %.0f, equal weight %.0f', own, ew) AS detail, FALSE AS gating FROM (SELECT coalesce(max(total_costs) FILTER (strategy = 'strategy'), 0) AS own,
        coalesce(max(total_costs) FILTER (strategy = 'equal_weight'), 0) AS ew, coalesce(max(turnover_annualized) FILTER (strategy = 'strategy'), 0) AS turn FROM perf))"""


@query("check_costs", PERF, _costs(10.0))
def _(s: Stage) -> DataFrame:
    return integrity.costs_active(s.performance, P).select(*CHECK)


@query("check_costs_low", PERF, _costs(5.0))
def _(s: Stage) -> DataFrame:
    """Half the least rate: the check has to fail."""
    return integrity.costs_active(s.performance, P.with_(cost_bps=5.0)).select(*CHECK)


def _benchmarks(source: str) -> str:
    return f"""SELECT *, {STATUS} FROM (SELECT 'Benchmarks on identical dates' AS name, coalesce(bool_or(strategy = 'equal_weight'), FALSE) AS passed,
        'present: ' || coalesce(string_agg(strategy, ', ' ORDER BY strategy) FILTER (strategy <> 'strategy'), 'none') AS measure,
        CASE WHEN bool_or(strategy = 'index') THEN 'index available' ELSE 'index unavailable' END AS detail, FALSE AS gating FROM {source})"""


@query("check_benchmarks", PERF, _benchmarks("perf"))
def _(s: Stage) -> DataFrame:
    return integrity.benchmarks_present(s.performance).select(*CHECK)


@query("check_benchmarks_missing", PERF, _benchmarks("(SELECT * FROM perf WHERE strategy <> 'equal_weight')"))
def _(s: Stage) -> DataFrame:
    """Without equal weight the check has to fail."""
    return integrity.benchmarks_present(s.performance.where("strategy <> 'equal_weight'")).select(*CHECK)


@query("check_survivorship", FEATS, """SELECT 'Survivors in the universe' AS name, TRUE AS passed, count(*) FILTER (e - last <= 31) || ' of ' || count(*) || ' tickers have rows in the last 31 days' AS measure,
    'tickers that ended earlier: ' || count(*) FILTER (e - last > 31) AS detail, FALSE AS gating, 'PASS' AS status FROM
    (SELECT ticker, max(date) AS last FROM feats GROUP BY ticker), (SELECT max(date) AS e FROM feats)""")
def _(s: Stage) -> DataFrame:
    return integrity.survivorship(s.features).select(*CHECK)


REFITS = OOF + o.refits(SEEDS)
GATE = REFITS + [f"""gate AS (SELECT *, coalesce(top < {integrity.PERMUTATION_TOLERANCE}, FALSE) AS ok, lagged - real <= {integrity.LAG_TOLERANCE} AS lag_ok FROM
    (SELECT max(oof_r2) FILTER (kind = 'permuted') AS top, avg(oof_r2) FILTER (kind = 'permuted') AS mean, count(*) FILTER (kind = 'permuted') AS n,
     max(oof_r2) FILTER (kind = 'real') AS real, max(oof_r2) FILTER (kind = 'lagged') AS lagged FROM r2))"""]
GATE_ROW = """SELECT 'Falsification gate: permuted labels' AS name, ok AS passed, printf('permuted R2 max %.4f mean %.4f real %.4f', top, mean, real) AS measure,
    'permutation rounds: ' || n AS detail, TRUE AS gating, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM gate"""


#: Beside the ledger's tables, which have bars of other keys.
GATED = PERF + [re.sub(r"\b(bars|bars_ticks)\b", r"gate_\1", sql) for sql in GATE]


@query("refit_r2", REFITS, "SELECT kind, round(oof_r2, 6) AS oof_r2 FROM r2")
def _(s: Stage) -> DataFrame:
    return s.refit_r2.select("kind", r("oof_r2"))


@query("check_permutation_gate", GATE, GATE_ROW)
def _(s: Stage) -> DataFrame:
    return integrity.permutation_gate(s.refit_r2).select(*CHECK)


@query("check_permutation_gate_leak", REFITS + ["""oof_leak AS MATERIALIZED (SELECT * REPLACE (rf + y AS rf) FROM oof_p0)"""] + o.ridge("_leak") + [
    GATE[-1].replace("FROM r2))", "FROM (SELECT kind, oof_r2 FROM r2 WHERE kind = 'real' UNION ALL SELECT 'permuted', oof_r2 FROM cal_leak)))")], GATE_ROW)
def _(s: Stage) -> DataFrame:
    """A learner that sees the labels it is scored on: the gate has to fail."""
    permuted = falsify.with_labels(s.rule_oof, falsify.permute_labels(s.panel, SEEDS[0]))
    leak = permuted.withColumn("rf", F.col("rf") + F.col("y")).persist()
    fitted = ensemble.calibration(ensemble.stacked(leak, ensemble.fit_ridge(leak)))
    rows = s.refit_r2.where("kind = 'real'").unionByName(fitted.select(F.lit("permuted").alias("kind"), "oof_r2"))
    return integrity.permutation_gate(rows).select(*CHECK)


@query("check_feature_lag", GATE, """SELECT 'Feature-lag test' AS name, lag_ok AS passed, printf('lagged - real %.4f', lagged - real) AS measure,
    printf('real %.4f, lagged %.4f', real, lagged) AS detail, FALSE AS gating, CASE WHEN lag_ok THEN 'PASS' ELSE 'FAIL' END AS status FROM gate""")
def _(s: Stage) -> DataFrame:
    return integrity.feature_lag(s.refit_r2).select(*CHECK)


def _checks(s: Stage, with_rounds: bool) -> DataFrame:
    return integrity.report(
        s.spark, changes=s.lookahead, feats=s.features,
        summary=s.fold_summary, perf=s.performance,
        r2=s.refit_r2 if with_rounds else None, run_lag=with_rounds, params=P)


def _beside_perf(sql: str) -> str:
    """Tables over the suppliers' bars, beside those of the ledger, which have bars of other keys."""
    return re.sub(r"\b(bars|bars_ticks)\b", r"gate_\1", sql)


LOOKED = [_beside_perf(sql) for sql in LOOK[len(SUP):]] + [f"chg AS MATERIALIZED ({_beside_perf(CHANGES)})"]


def _passed(refits: bool) -> list[str]:
    """chk(name, passed, gating): all checks, from the tables."""
    rows = ["SELECT 'look' AS name, count(*) > 0 AND sum(unmatched) + count(*) FILTER (rows_compared = 0) = 0 AND max(max_before) = 0 AS passed, FALSE AS gating FROM chg",
            f"SELECT 'prints', count(*) = 0, FALSE FROM {_spreads('feats')} WHERE spread = 0",
            "SELECT 'folds', bool_and(ordering_ok), FALSE FROM fs",
            "SELECT 'costs', max(total_costs) FILTER (strategy IN ('strategy', 'equal_weight')) > 0, FALSE FROM perf",
            "SELECT 'benchmarks', bool_or(strategy = 'equal_weight'), FALSE FROM perf",
            "SELECT 'survivors', TRUE, FALSE"]
    rows += ["SELECT 'gate', ok, TRUE FROM gate", "SELECT 'lag', lag_ok, FALSE FROM gate"] if refits else ["SELECT 'gate', FALSE, TRUE"]
    return LOOKED + [f"fs AS ({FOLD_SUMMARY})", f"chk AS MATERIALIZED ({' UNION ALL '.join(rows)})",
                     """roll AS MATERIALIZED (SELECT count(*) AS n_checks, count(*) FILTER (passed) AS n_passed, count(*) FILTER (gating) AS n_gating,
                     bool_and(passed) FILTER (gating) AS gate_ok, CASE WHEN bool_and(passed) FILTER (gating) THEN 'PASSED' ELSE 'FAILED' END AS gate_state FROM chk)"""]


ROLLED = GATED + _passed(True)
NOT_RUN = GATED + _passed(False)


@query("integrity_rollup", ROLLED, "SELECT * FROM roll")
def _(s: Stage) -> DataFrame:
    return integrity.gate(_checks(s, True))


@query("integrity_gate_not_run", NOT_RUN, "SELECT * FROM roll")
def _(s: Stage) -> DataFrame:
    return integrity.gate(_checks(s, False))


# ------------------------------------------------------------------- audit
TIERED = STACK + [f"tiers AS MATERIALIZED (SELECT stk.*, {o.tier('pred', 'pred - 1.28 * residual_std', 'confidence', 'tree_std')} AS tier FROM stk, cal)"]
AUDIT = TIERED + ["""aud AS MATERIALIZED (SELECT tier, list_position(['HIGH', 'MEDIUM', 'LOW', 'SPECULATIVE', 'AVOID'], tier) AS tier_order, count(*) AS n,
    avg(pred) AS mean_pred, avg(y) AS mean_realized, median(y) AS median_realized, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0 END) AS hit_rate FROM tiers GROUP BY tier)"""]


def _tiers(s: Stage) -> DataFrame:
    sigma = s.calibration.select("model", "residual_std")
    return audit.tiered(s.stacked.join(F.broadcast(sigma), "model"), P)


@query("tier_rows", TIERED, "SELECT date, ticker, tier FROM tiers")
def _(s: Stage) -> DataFrame:
    return _tiers(s).select("date", "ticker", "tier")


@query("tier_table", AUDIT, f"SELECT tier, tier_order, n, {sr(['mean_pred', 'mean_realized', 'median_realized', 'hit_rate'])} FROM aud")
def _(s: Stage) -> DataFrame:
    return audit.tier_table(_tiers(s)).select(
        "tier", "tier_order", "n", *rs(["mean_pred", "mean_realized", "median_realized", "hit_rate"]))


@query("tier_verdict", AUDIT, """SELECT count(*) AS n_tiers, count(*) >= 2 AND bool_and(coalesce(prev >= mean_realized, TRUE)) AS monotonic FROM
    (SELECT *, lag(mean_realized) OVER (ORDER BY tier_order) AS prev FROM aud WHERE tier IN ('HIGH', 'MEDIUM', 'LOW'))""")
def _(s: Stage) -> DataFrame:
    return audit.verdict(audit.tier_table(_tiers(s))).select("n_tiers", "monotonic")


# ------------------------------------------------------------ report tables
@query("report_signal_scan", SIGNALS, """SELECT as_of, rank, ticker, conviction, sector, round(expected_return, 6) AS expected_return FROM
    (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY rank) AS n FROM ranked WHERE rank <= 16 OR conviction <> 'AVOID') WHERE n <= 30""")
def _(s: Stage) -> DataFrame:
    return report.signal_scan(sg.ranked(s.signals)).select(
        "as_of", "rank", "ticker", "conviction", "sector", r("expected_return"))


@query("report_uncertainty", SIGNALS, """SELECT as_of, rank, ticker, conviction, round(abs(rf_pred - gb_pred), 6) AS spread,
    round(tree_std, 6) AS tree_std FROM ranked WHERE rank <= 10""")
def _(s: Stage) -> DataFrame:
    return report.uncertainty(sg.ranked(s.signals)).select("as_of", "rank", "ticker", "conviction", *rs(["spread", "tree_std"]))


@query("report_comparison", PERF + [f"long AS (SELECT strategy, metric, value FROM (SELECT strategy, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in report.METRICS)} FROM perf) UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(report.METRICS)})))"],
       """SELECT metric, round(max(value) FILTER (strategy = 'strategy'), 4) AS strategy, round(max(value) FILTER (strategy = 'equal_weight'), 4) AS equal_weight,
       round(max(value) FILTER (strategy = 'index'), 4) AS "index" FROM long GROUP BY metric""")
def _(s: Stage) -> DataFrame:
    return report.comparison(s.performance, ["strategy", "equal_weight", "index"]).select(
        "metric", *rs(["strategy", "equal_weight", "index"], 4))


@query("report_withheld", PERF, """SELECT CAST(NULL AS VARCHAR) AS strategy, CAST(NULL AS DOUBLE) AS cagr, 'falsification gate did not pass' AS reason
    FROM perf WHERE strategy = 'strategy'""")
def _(s: Stage) -> DataFrame:
    return report.withheld(s.performance, integrity.gate(integrity.permutation_gate(
        s.spark.createDataFrame([], "kind string, oof_r2 double"))))


@query("report_shown", GATED, """SELECT strategy, round(cagr, 6) AS cagr, CAST(NULL AS VARCHAR) AS reason FROM perf, gate WHERE ok
    UNION ALL SELECT NULL, NULL, 'falsification gate did not pass' FROM gate WHERE NOT ok""")
def _(s: Stage) -> DataFrame:
    return report.withheld(s.performance, integrity.gate(integrity.permutation_gate(s.refit_r2))).select(
        "strategy", r("cagr"), "reason")


BENCH_COLS = ["cagr", "total_return", "sharpe_ratio", "max_drawdown", "active_cagr"]


@query("benchmark_summary", PERF, f"SELECT strategy, {sr(BENCH_COLS)}, CAST(NULL AS VARCHAR) AS error FROM perf WHERE strategy <> 'strategy'")
def _(s: Stage) -> DataFrame:
    return report.benchmark_summary(s.performance).select("strategy", *rs(BENCH_COLS), "error")


# ------------------------------------------------------------ fitted models
#: Rows that any fit over these folds predicts: the keys and labels of the validation rows.
VALIDATION = FOLDS + ["val AS MATERIALIZED (SELECT panel.date, ticker, fold, round(y, 6) AS y FROM panel JOIN roles ON roles.date = panel.date WHERE role = 'val')"]


def _sound(rf: str = "rf", gb: str = "gb", std: str = "tree_std") -> Column:
    """Predictions are there, and lie within the range of any 21-day return of these prices."""
    return (F.col(rf).isNotNull() & F.col(gb).isNotNull() & (F.abs(F.col(rf)) < 1) & (F.abs(F.col(gb)) < 1) & (F.col(std) >= 0))


@query("model_oof", VALIDATION, "SELECT date, ticker, fold, y, TRUE AS sound FROM val")
def _(s: Stage) -> DataFrame:
    return s.model_folds[0].select("date", "ticker", "fold", r("y"), _sound().alias("sound"))


@query("model_stack", VALIDATION, "SELECT count(*) AS n, count(*) AS n_oof, TRUE AS same_ridge, TRUE AS same_fit FROM val")
def _(s: Stage) -> DataFrame:
    """The ridge and its R2 beside the normal equations and residuals, summed up anew from the stored out-of-fold rows."""
    oof, ridge_, calibration, _ = s.model_folds
    fitted = ridge_.join(calibration, "model").withColumnRenamed("n", "n_ridge")
    rows = oof.crossJoin(F.broadcast(ridge_.select("w_rf", "w_gb", "intercept", "alpha")))
    e = F.col("y") - F.col("intercept") - F.col("w_rf") * F.col("rf") - F.col("w_gb") * F.col("gb")
    sums = rows.agg(F.count("*").alias("n"), F.covar_pop(e, "rf").alias("c_rf"), F.covar_pop(e, "gb").alias("c_gb"), F.avg(e).alias("bias"),
                    F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"))
    both = fitted.crossJoin(sums)
    # Penalised least squares: n cov(residual, x) = alpha w, and a free intercept leaves no bias.
    ridge = ((F.abs(F.col("n") * F.col("c_rf") - F.col("alpha") * F.col("w_rf")) < 1e-6)
             & (F.abs(F.col("n") * F.col("c_gb") - F.col("alpha") * F.col("w_gb")) < 1e-6) & (F.abs("bias") < 1e-9))
    same = F.abs(1 - F.col("sse") / F.col("sst") - F.col("oof_r2")) < 1e-9
    return both.select(F.col("n_ridge").alias("n"), "n_oof", ridge.alias("same_ridge"), (same & (F.col("n") == F.col("n_oof"))).alias("same_fit"))


@query("model_votes", LATEST, "SELECT as_of, ticker, 30 AS n_votes, TRUE AS mean_is_rf FROM latest_z")
def _(s: Stage) -> DataFrame:
    """The forest's prediction is the mean of its trees' votes."""
    voted = research.votes(s.model_base, s.latest_z)
    mean = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v) / F.size("votes")
    return voted.select("as_of", "ticker", F.size("votes").alias("n_votes"), (F.abs(mean - F.col("rf")) < 1e-9).alias("mean_is_rf"))


@query("model_predictions", LATEST, "SELECT as_of, ticker, TRUE AS brackets, TRUE AS bounded FROM latest_z")
def _(s: Stage) -> DataFrame:
    er, low, high = (F.col(c) for c in ("expected_return", "ci_low", "ci_high"))
    half = MODEL.interval_z * F.col("calibrated_std")
    wide = (low <= er - half + 1e-12) & (high >= er + half - 1e-12)
    return s.model.score(s.latest_z, MODEL).select(
        "as_of", "ticker", wide.alias("brackets"), (er.between(-0.5, 1.0) & F.col("confidence").between(0, 1) & (F.col("tree_std") >= 0)).alias("bounded"))


@query("model_signals_nested", LATEST + [o.INFO], """SELECT as_of, ticker, sector, TRUE AS same FROM latest JOIN info USING (ticker) WHERE row_no >= 50""")
def _(s: Stage) -> DataFrame:
    """Nested signals hold what the flat ones hold."""
    flat = sg.signals(s.model.score(s.latest_z, MODEL), s.latest, s.info, P)
    nested = sg.nested(flat).select("as_of", "ticker", "factors")
    both = nested.join(flat.drop("factors"), ["as_of", "ticker"])
    same = ((F.col("factors.scores.composite") == F.col("composite")) & (F.col("factors.volatility") == F.col("volatility"))
            & (F.col("factors.rf_pred") == F.col("rf_pred")) & (F.col("factors.sector") == F.col("sector")))
    return both.select("as_of", "ticker", "sector", same.alias("same"))


@query("model_importances", None, f"SELECT unnest({FEATURES!r}) AS feature, TRUE AS sums_to_one, TRUE AS in_range")
def _(s: Stage) -> DataFrame:
    from pyspark.sql import Window
    return ensemble.named_importances(forests.importances(s.model_base, 0)).select(
        "feature", (F.abs(F.sum("importance").over(Window.partitionBy()) - 1) < 1e-6).alias("sums_to_one"),
        F.col("importance").between(0, 1).alias("in_range"))


@query("model_top_importances", None, f"SELECT {report.IMPORTANCE_ROWS} AS n, TRUE AS are_the_largest")
def _(s: Stage) -> DataFrame:
    whole = ensemble.named_importances(forests.importances(s.model_base, 0))
    top = report.top_importances(whole)
    rest = whole.join(top.select("feature"), "feature", "left_anti").agg(F.max("importance").alias("next"))
    return top.agg(F.count("*").alias("n"), F.min("importance").alias("last")).crossJoin(rest).select(
        F.col("n").cast("int").alias("n"), (F.col("last") >= F.col("next")).alias("are_the_largest"))


@query("model_tier_table", VALIDATION, "SELECT count(*) AS n, TRUE AS tiers_known FROM val")
def _(s: Stage) -> DataFrame:
    oof, _, calibration, _ = s.model_folds
    rows = oof.join(F.broadcast(calibration.select("model", "residual_std")), "model")
    table = audit.tier_table(audit.tiered(rows, P))
    return table.agg(F.sum("n").alias("n"), F.bool_and(F.col("tier").isin(*sg.TIERS) & F.col("hit_rate").between(0, 1)).alias("tiers_known"))


#: Of the refits, all but the lagged one have the panel's validation rows.
@query("model_falsification", VALIDATION, f"""SELECT kind, seed, n_oof, TRUE AS has_r2 FROM (SELECT count(*) AS n_oof FROM val),
    (SELECT 'real' AS kind, CAST(NULL AS INTEGER) AS seed UNION ALL SELECT 'permuted', unnest({SEEDS}))""")
def _(s: Stage) -> DataFrame:
    return s.falsification.where("kind <> 'lagged'").select("kind", "seed", "n_oof", (F.col("oof_r2") < 1).alias("has_r2"))


LAG_PANEL = FEATS + o.lagged(1) + o.panel(src="lagged") + o.positions() + o.folds()


@query("model_falsification_lagged", LAG_PANEL, """SELECT count(*) AS n_oof, TRUE AS has_r2 FROM panel JOIN roles ON roles.date = panel.date WHERE role = 'val'""")
def _(s: Stage) -> DataFrame:
    return s.falsification.where("kind = 'lagged'").select("n_oof", (F.col("oof_r2") < 1).alias("has_r2"))


@query("model_permuted_oof", VALIDATION, f"""SELECT seed, date, count(*) AS n, CAST(sum(CAST(round(y * 1e6) AS BIGINT)) AS BIGINT) AS sum_y FROM (SELECT date, y FROM val), (SELECT unnest({SEEDS}) AS seed) GROUP BY ALL""")
def _(s: Stage) -> DataFrame:
    """Every permutation keeps each day's labels: their number and sum over the validation rows that the refits scored."""
    found, kinds = s.refits
    rows = refits.named(found.oof, kinds).where("kind = 'permuted'")
    return rows.groupBy("seed", "date").agg(F.count("*").alias("n"), F.sum(F.round(F.col("y") * 1e6).cast("bigint")).alias("sum_y"))


@query("model_integrity_report", VALIDATION, """SELECT unnest(['No look-ahead', 'No ticker fingerprints', 'Temporal folds with embargo', 'Costs applied',
    'Benchmarks on identical dates', 'Falsification gate: permuted labels', 'Feature-lag test', 'Survivors in the universe']) AS name,
    unnest([FALSE, FALSE, FALSE, FALSE, FALSE, TRUE, FALSE, FALSE]) AS gating, TRUE AS told FROM (SELECT count(*) FROM val)""")
def _(s: Stage) -> DataFrame:
    """The checks over stage tables that were written once; R2 comes from refits of both learners."""
    checks = integrity.report(
        s.spark, changes=sizing.cut(s.lookahead), feats=s.features, summary=sizing.cut(s.fold_summary),
        perf=sizing.cut(s.performance), r2=sizing.cut(s.falsification), params=P)
    told = F.col("passed").isNotNull() & (F.length("measure") > 0) & (F.length("detail") > 0)
    return checks.select("name", "gating", told.alias("told"))


@query("model_walk_forward", LEDGER, """SELECT model, cutoff, TRUE AS fitted FROM (SELECT CAST(k / 3 AS INTEGER) AS model, date AS cutoff FROM reb WHERE k % 3 = 0)""")
def _(s: Stage) -> DataFrame:
    """A retrain every 63 days, each with a calibration of its own."""
    return s.walk[1].select("model", "cutoff", ((F.col("n_oof") >= WALK.min_oof_rows) & (F.col("residual_std") > 0) & (F.col("oof_r2") < 1)).alias("fitted"))


@query("model_schedule", LEDGER, "SELECT k, TRUE AS fits FROM reb")
def _(s: Stage) -> DataFrame:
    """Weights of every rebalance: none, or in all not more than one, each within (0, 1], of tickers that exist."""
    tickers = s.bars("region").select("ticker").distinct()
    known = s.walk[0].join(F.broadcast(tickers.withColumn("known", F.lit(True))), "ticker", "left")
    total = known.groupBy("k").agg(F.sum("weight").alias("w"), F.min("weight").alias("low"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))
    fits = F.col("w").isNull() | ((F.col("w") <= 1 + 1e-9) & (F.col("low") > 0) & F.col("known"))
    return s.rebalances.join(total, "k", "left").select("k", fits.alias("fits"))


@query("model_ledger", LEDGER, """SELECT strategy, k, date, TRUE AS pays, CASE WHEN strategy <> 'strategy' THEN round(value, 2) END AS value FROM book""")
def _(s: Stage) -> DataFrame:
    """The models' schedule through the ledger, on the benchmarks' dates: costs are the rate times what was traded."""
    book = s.walk_ledger
    # Of large amounts doubles hold no cents, and a strategy that has lost all has a value of nothing.
    pays = F.when(F.col("is_end"), F.col("cost") == 0).otherwise(
        F.abs(F.col("cost") - (F.col("value") + F.col("cost")) * F.col("turnover") * P.cost_rate) <= F.greatest(F.lit(1e-6), 1e-12 * F.col("cost")))
    return book.select("strategy", "k", "date", (pays & (F.col("value") >= 0)).alias("pays"),
                       F.when(F.col("strategy") != "strategy", F.round("value", 2)).alias("value"))


@query("model_performance", PERF, """SELECT strategy, n_periods, round(years, 6) AS years, CASE WHEN strategy <> 'strategy' THEN round(cagr, 6) END AS cagr, TRUE AS active FROM perf""")
def _(s: Stage) -> DataFrame:
    perf = ledger.performance(s.walk_ledger, P, policies=s.strategies, status=s.window_status)
    own = perf.agg(F.max(F.when(F.col("strategy") == "strategy", F.col("cagr"))).alias("own"))
    active = F.when(F.col("strategy") == "strategy", F.col("active_cagr").isNull()).otherwise(
        F.abs(F.col("own") - F.col("cagr") - F.col("active_cagr")) < 1e-9)
    return perf.crossJoin(F.broadcast(own)).select("strategy", "n_periods", r("years"), F.when(F.col("strategy") != "strategy", F.round("cagr", 6)).alias("cagr"),
                                                   active.alias("active"))


RECORD = ROLLED + TIERED[-1:] + AUDIT[-1:] + ["""verd AS (SELECT count(*) >= 2 AND bool_and(coalesce(prev >= mean_realized, TRUE)) AS monotonic FROM
    (SELECT *, lag(mean_realized) OVER (ORDER BY tier_order) AS prev FROM aud WHERE tier IN ('HIGH', 'MEDIUM', 'LOW')))"""]


def _record(s: Stage, perf: DataFrame) -> DataFrame:
    checks = sizing.cut(_checks(s, True))
    table = sizing.cut(audit.tier_table(_tiers(s)))
    return report.run_record(
        P, generated=F.lit("2024-01-02T00:00:00"), universe=s.bars().select("ticker").distinct(), checks=checks, gate_row=integrity.gate(checks),
        perf=perf, book=s.ledger, r2=s.calibration, tiers=table, verdict=audit.verdict(table))


def _written(s: Stage, record: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The record and the universe as they're read back from where they were written."""
    path = report.write_record(record, s.bars().select("ticker"), sizing.shared_path(s.spark, "records"), "2024-01-02")
    return report.read_record(s.spark, path, record.schema)


@query("run_record", RECORD, """SELECT (SELECT count(DISTINCT ticker) FROM gate_bars) AS universe_size, gate_ok, n_checks AS checks, n_passed AS passed,
    (SELECT min(date) FROM reb) AS first_day, (SELECT max(end_date) FROM reb) AS last_day, (SELECT count(*) FROM reb) AS num_rebalances,
    round(perf.cagr, 6) AS cagr, round(perf.final_value, 2) AS final_value, round(perf.total_costs, 2) AS total_costs, perf.num_trades,
    (SELECT string_agg(strategy, ',' ORDER BY strategy) FROM perf WHERE strategy <> 'strategy') AS benchmarks,
    (SELECT round(oof_r2, 6) FROM cal) AS oof_r2, monotonic, (SELECT count(*) FROM aud) AS tiers, CAST(NULL AS VARCHAR) AS error
    FROM perf, roll, verd WHERE strategy = 'strategy'""")
def _(s: Stage) -> DataFrame:
    """The record of the run, written as JSON and read back."""
    found, _ = _written(s, _record(s, s.performance))
    back = F.col("backtest")
    return found.select(
        "universe_size", F.col("falsification_gate_passed").alias("gate_ok"), F.size("integrity").cast("long").alias("checks"),
        F.size(F.filter("integrity", lambda c: c["passed"])).cast("long").alias("passed"), back["window"][0].alias("first_day"),
        back["window"][1].alias("last_day"), back["num_rebalances"].alias("num_rebalances"), r(back["strategy"]["cagr"], 6, "cagr"),
        r(back["strategy"]["final_value"], 2, "final_value"), r(back["strategy"]["total_costs"], 2, "total_costs"),
        back["strategy"]["num_trades"].alias("num_trades"), F.array_join(F.transform(back["benchmarks"], lambda b: b["name"]), ",").alias("benchmarks"),
        r(back["oof_r2"], 6, "oof_r2"), F.col("conviction_audit.monotonic").alias("monotonic"),
        F.size("conviction_audit.table").cast("long").alias("tiers"), back["error"].alias("error"))


@query("run_record_universe", SUP, "SELECT DISTINCT ticker FROM bars")
def _(s: Stage) -> DataFrame:
    record = s.spark.range(1).select(F.lit("none").alias("error"))
    return _written(s, record)[1]


@query("run_record_failed", SUP, f"""SELECT count(DISTINCT ticker) AS universe_size, '{ledger.FEW_DAYS}' AS error, TRUE AS nothing_else FROM bars""")
def _(s: Stage) -> DataFrame:
    """A window that couldn't be run leaves its error, and no figures."""
    status = ledger.window_status(s.calendar.where("pos < 60"), P)
    failed = ledger.performance(s.ledger, P, policies=s.strategies, status=status)
    none = s.spark.createDataFrame([], "kind string, oof_r2 double")
    checks = integrity.permutation_gate(none).withColumn("ord", F.lit(0))
    tiers = s.spark.createDataFrame([], "tier string, tier_order int, n long, mean_pred double, mean_realized double, median_realized double, hit_rate double")
    record = report.run_record(P, generated=F.lit("2024-01-02T00:00:00"), universe=s.bars().select("ticker").distinct(), checks=checks,
                               gate_row=integrity.gate(checks), perf=failed, book=s.ledger, r2=s.calibration, tiers=tiers, verdict=audit.verdict(tiers))
    found, _ = _written(s, record)
    back = F.col("backtest")
    return found.select("universe_size", back["error"].alias("error"),
                        (back["strategy"].isNull() & back["window"].isNull() & back["oof_r2"].isNull() & F.col("conviction_audit").isNull()).alias("nothing_else"))


# ------------------------------------------------------------ windows that can't be run
@query("window_status", o.bars("region") + o.calendar() + [re.sub(r"\b(bars|bars_ticks|cal0)\b", r"n_\1", sql) for sql in o.bars("nation") + o.calendar()], f"""
    SELECT name, days, rebalances, CASE WHEN days = 0 THEN '{ledger.NO_DAYS}' WHEN days < 100 THEN '{ledger.FEW_DAYS}' WHEN rebalances < 2 THEN '{ledger.NO_PERIODS}' END AS error FROM
    (SELECT name, days, CASE WHEN days = 0 THEN 0 ELSE (SELECT count(*) FROM range(least(504, days // 2), days - 1, every)) END AS rebalances FROM
     (SELECT 'whole' AS name, count(*) AS days, 21 AS every FROM cal0 UNION ALL SELECT 'short', count(*), 21 FROM cal0 WHERE pos < 60
      UNION ALL SELECT 'no days', count(*), 21 FROM n_cal0 WHERE date < DATE '1900-01-01'
      UNION ALL SELECT 'one period', count(*), 252 FROM cal0 WHERE pos < 120 UNION ALL SELECT 'clipped', count(*), 21 FROM cal0 WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'))""")
def _(s: Stage) -> DataFrame:
    """Whole, short, empty, single-period and clipped calendars, each with the reason why it can't be run, if any."""
    import datetime as dt
    clipped = ledger.common_calendar(s.bars("region"), dt.date(1995, 1, 1), dt.date(1996, 12, 31))
    cases = {"whole": (s.calendar, P), "short": (s.calendar.where("pos < 60"), P),
             "no days": (ledger.common_calendar(s.bars("nation"), end=dt.date(1899, 12, 31)), P),
             "one period": (s.calendar.where("pos < 120"), P.with_(rebalance_every=252)), "clipped": (clipped, P)}
    out = None
    for name, (calendar, params) in cases.items():
        row = ledger.window_status(calendar, params).select(F.lit(name).alias("name"), "days", "rebalances", "error")
        out = row if out is None else out.unionByName(row)
    return out


@query("performance_not_run", None, f"""SELECT unnest(['strategy', 'equal_weight', 'index']) AS strategy, CAST(NULL AS DOUBLE) AS cagr, '{ledger.FEW_DAYS}' AS error FROM (SELECT count(*) FROM lineitem)""")
def _(s: Stage) -> DataFrame:
    status = ledger.window_status(s.calendar.where("pos < 60"), P)
    return ledger.performance(s.ledger, P, policies=s.strategies, status=status).select("strategy", "cagr", "error")


@query("benchmarks_not_run", None, f"""SELECT unnest(['equal_weight', 'index']) AS strategy, '{ledger.FEW_DAYS}' AS error FROM (SELECT count(*) FROM lineitem)""")
def _(s: Stage) -> DataFrame:
    status = ledger.window_status(s.calendar.where("pos < 60"), P)
    return report.benchmark_summary(ledger.performance(s.ledger, P, policies=s.strategies, status=status)).select("strategy", "error")
