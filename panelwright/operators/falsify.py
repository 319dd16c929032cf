"""Label permutation and feature lag: adversarial versions of the panel."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import ranks
from panelwright.operators.features import lag_features  # noqa: F401  (part of this surface)

BASE_SEED = 1000
#: Rows of a date that one task numbers, about, where dates are split; and rows of the largest date up to which none is.
PREFIX_ROWS, WHOLE_ROWS = 50_000, 300_000


def _largest_date(panel: DataFrame) -> int:
    return panel.groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def prefix_digits(panel: DataFrame) -> int:
    """Hex digits of the hash prefixes that split the largest date into parts of PREFIX_ROWS rows; only dates are read."""
    return _digits(_largest_date(panel))


def _digits(most: int) -> int:
    digits = 0
    while most > PREFIX_ROWS * 16 ** digits:
        digits += 1
    return digits


def permutations(panel: DataFrame, seeds: list[int], whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """date, ticker and, for each seed, the permuted label (y0, y1, ...), as permute_labels deals them.

    Rows are dealt by date once for all seeds, and a date's two orders of each seed are taken in a task. Where the
    largest date has more than `whole_rows` rows, dates are split by hash prefixes, each seed by itself.
    """
    rows, most = panel.select("date", "ticker", "y"), _largest_date(panel)
    names = [f"y{k}" for k in range(len(seeds))]
    if most > whole_rows:
        out = None
        for name, seed in zip(names, seeds):
            one = permute_labels(rows, seed, _digits(most)).withColumnRenamed("y", name)
            out = one if out is None else out.join(one, ["date", "ticker"])
        return out
    keys = [(f"_{tag}{k}", F.unhex(F.md5(F.concat_ws("-", "ticker", F.col("date").cast("string"), F.lit(f"{seed}{tag}")))))
            for k, seed in enumerate(seeds) for tag in "ab"]

    def deal(day: pa.Table) -> pa.Table:
        given = {"date": day.column("date"), "ticker": day.column("ticker")}
        for k, name in enumerate(names):
            seats, drawn = (pc.sort_indices(day, sort_keys=[(f"_{tag}{k}", "ascending"), ("ticker", "ascending")]) for tag in "ab")
            # The n-th seat is given the n-th label drawn.
            given[name] = day.column("y").take(drawn).take(pc.sort_indices(seats))
        return pa.table(given)

    # Hashes are taken where a date's rows are, so they aren't moved.
    dealt = rows.repartition("date").withColumns(dict(keys))
    return dealt.groupBy("date").applyInArrow(deal, ", ".join([f"date {rows.schema['date'].dataType.simpleString()}", "ticker string", *(f"{n} double" for n in names)]))


def permute_labels(panel: DataFrame, seed: int = 0, digits: int | None = None) -> DataFrame:
    """Shuffle ``y`` among the tickers of each date.

    Two independent hash orders of the same rows are paired up by row number.
    Deterministic in (ticker, date, seed); a ticker may draw its own label.
    Hash prefixes of ``digits`` split a date over many tasks, whatever its size; the result doesn't depend on them. Unless
    they're given, dates are only split where the largest one is measured to need it.
    """
    if digits is None:
        return permutations(panel, [seed]).withColumnRenamed("y0", "y")

    def ordered(tag: str) -> DataFrame:
        key = F.md5(F.concat_ws("-", F.col("ticker"), F.col("date").cast("string"),
                                F.lit(f"{seed}{tag}")))
        keyed = panel.select("date", "ticker", "y", key.alias("k"))
        return ranks.numbered(keyed, ["date"], ranks.hash_bucket(F.col("k"), digits),
                              [F.col("k"), F.col("ticker")], "rn").drop("k")

    seats = ordered("a").select("date", "rn", "ticker")
    drawn = ordered("b").select("date", "rn", "y")
    return seats.join(drawn, ["date", "rn"]).select("date", "ticker", "y")


def with_labels(panel: DataFrame, permuted: DataFrame) -> DataFrame:
    return panel.drop("y").join(permuted, ["date", "ticker"])
