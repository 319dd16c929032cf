"""Independent SQL for the registered queries, built from shared WITH parts.

The SQL follows the definitions directly (plain frames, recursive means,
row-by-row ledger); it shares no formula tricks with the Spark plans.
"""

from __future__ import annotations

import re

from panelwright.operators.features import FEATURES
from panelwright.params import JobParams

P = JobParams()
TIE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"

KEYS = {
    "index": ("'INDEX'", "lineitem"),
    "supplier": ("'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0')", "lineitem"),
    "brand": ("p_brand", "lineitem JOIN part ON p_partkey = l_partkey"),
    "nation": ("n_name", "lineitem JOIN supplier ON s_suppkey = l_suppkey "
                         "JOIN nation ON n_nationkey = s_nationkey"),
    "region": ("r_name", "lineitem JOIN supplier ON s_suppkey = l_suppkey "
                         "JOIN nation ON n_nationkey = s_nationkey "
                         "JOIN region ON r_regionkey = n_regionkey"),
}


def bars(key: str, name: str = "bars") -> list[str]:
    expr, src = KEYS[key]
    order = f"PARTITION BY {expr} ORDER BY l_shipdate, {TIE} ROWS UNBOUNDED PRECEDING"
    return [
        f"""{name}_ticks AS (SELECT {expr} AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS q,
          row_number() OVER (PARTITION BY {expr} ORDER BY l_shipdate, {TIE}) AS rn,
          CAST(round(100 * exp(0.15 * CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5)
               OVER ({order}) AS DOUBLE) / 100), 4) AS FLOAT) AS tick FROM {src})""",
        f"""{name} AS MATERIALIZED (SELECT ticker, date, arg_min(tick, rn) AS open, max(tick) AS high,
          min(tick) AS low, arg_max(tick, rn) AS close, CAST(sum(q) AS BIGINT) AS volume
          FROM {name}_ticks GROUP BY ticker, date)"""]


def _roll(agg: str, x: str, n: int, prior: bool = False) -> str:
    frame = f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING" if prior else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    over = f"OVER (PARTITION BY ticker ORDER BY date {frame})"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY ticker ORDER BY date)"


def feature_rows(src: str = "bars", out: str = "f", horizon: int = P.horizon, ema: bool = True) -> list[str]:
    """All indicator columns on every row of tickers with at least 252 bars."""
    spans = [9, 10, 12, 21, 26, 50, 100, 200]
    step = {n: f"(e.e{n} + {2.0 / (n + 1)!r} * (g.c - e.e{n}))" for n in spans}
    parts = [
        f"""{out}_g AS MATERIALIZED (SELECT * FROM (SELECT ticker, date, CAST(close AS DOUBLE) AS c, CAST(high AS DOUBLE) AS h,
          CAST(low AS DOUBLE) AS l, CAST(volume AS DOUBLE) AS v,
          row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i,
          count(*) OVER (PARTITION BY ticker) AS n_bars FROM {src}) WHERE n_bars >= 252)""",
        f"""{out}_r AS (SELECT *, c / {_lag('c', 1)} - 1 AS ret, c - {_lag('c', 1)} AS move, ln(h / l) AS hl,
          lead(c, {horizon}) OVER (PARTITION BY ticker ORDER BY date) / c - 1 AS y,
          lead(date, {horizon}) OVER (PARTITION BY ticker ORDER BY date) AS label_end FROM {out}_g)""",
        f"""{out}_s AS (SELECT *, sum(CASE WHEN ret > 0 THEN v WHEN ret < 0 THEN -v ELSE 0 END)
          OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv,
          CASE WHEN move IS NULL THEN NULL ELSE greatest(move, 0) END AS gain,
          CASE WHEN move IS NULL THEN NULL ELSE greatest(-move, 0) END AS loss FROM {out}_r)"""]
    if ema:
        parts.append(
            f"""{out}_e AS (SELECT ticker, i, {', '.join(f'c AS e{n}' for n in spans)}, CAST(0 AS DOUBLE) AS sg
              FROM {out}_g WHERE i = 0 UNION ALL SELECT g.ticker, g.i, {', '.join(step[n] for n in spans)},
              e.sg + 0.2 * (({step[12]} - {step[26]}) - e.sg)
              FROM {out}_e e JOIN {out}_g g ON g.ticker = e.ticker AND g.i = e.i + 1)""")
        joined = f"{out}_s JOIN {out}_e USING (ticker, i)"
    else:
        joined = f"(SELECT *, {', '.join(f'CAST(NULL AS DOUBLE) AS e{n}' for n in spans)}, CAST(NULL AS DOUBLE) AS sg FROM {out}_s)"
    c: dict[str, str] = {}
    for n in (10, 21, 50, 100, 200):
        c[f"price_sma_{n}"] = f"c / ({_roll('avg', 'c', n)})"
        c[f"price_ema_{n}"] = f"c / e{n}"
    for n in (5, 10, 21, 42, 63, 126, 252):
        c[f"ret_{n}d"] = f"c / {_lag('c', n)} - 1"
    for name, n in (("mom_12_1", 252), ("mom_6_1", 126), ("mom_3_1", 63)):
        c[name] = f"{_lag('c', 21)} / {_lag('c', 21 + n)} - 1"
    for n in (10, 21, 63):
        c[f"vol_{n}d"] = f"({_roll('stddev_samp', 'ret', n)}) * sqrt(252)"
    c["vol_ratio"] = f"({c['vol_21d']}) / (({c['vol_63d']}) + 1e-8)"
    c["parkinson_vol_21"] = f"({_roll('avg', 'hl', 21)}) * sqrt(252 / (4 * ln(2)))"
    for n in (7, 14, 21):
        c[f"rsi_{n}"] = f"100 - 100 / (1 + ({_roll('avg', 'gain', n)}) / (({_roll('avg', 'loss', n)}) + 1e-8))"
    c["macd_hist"] = "(e12 - e26) - sg"
    c["macd_hist_norm"] = "((e12 - e26) - sg) / (c + 1e-8)"
    m20, s20 = _roll("avg", "c", 20), _roll("stddev_samp", "c", 20)
    c["bb_position"] = f"(c - (({m20}) - 2 * ({s20}))) / (4 * ({s20}) + 1e-8)"
    c["bb_width"] = f"4 * ({s20}) / (({m20}) + 1e-8)"
    for n in (5, 21):
        c[f"rel_vol_{n}"] = f"v / (({_roll('avg', 'v', n, True)}) + 1)"
    c["obv_trend"] = f"obv / (({_roll('avg', 'obv', 21, True)}) + 1e-8)"
    c["dist_52w_high"] = f"c / ({_roll('max', 'c', 252, True)}) - 1"
    c["dist_52w_low"] = f"c / ({_roll('min', 'c', 252, True)}) - 1"
    c["breakout_20d"] = f"CASE WHEN c > ({_roll('max', 'h', 20, True)}) THEN 1.0 ELSE 0.0 END"
    c["golden_cross_dist"] = f"({_roll('avg', 'c', 50)}) / (({_roll('avg', 'c', 200)}) + 1e-8) - 1"
    c["skew_21"] = _roll("skewness", "ret", 21)
    c["kurt_21"] = _roll("kurtosis", "ret", 21)
    for n in (21, 50):
        c[f"zscore_{n}"] = f"(c - ({_roll('avg', 'c', n)})) / (({_roll('stddev_samp', 'c', n)}) + 1e-8)"
    for n in (5, 21):
        c[f"mean_rev_{n}"] = f"-({_roll('sum', 'ret', n)})"
    cols = ", ".join(f"CAST({c[f]} AS DOUBLE) AS {f}" for f in FEATURES)
    parts.append(f"{out} AS MATERIALIZED (SELECT ticker, date, i AS bar_no, n_bars, c, {cols}, y, label_end FROM {joined})")
    return parts


ALL_THERE = " AND ".join(f"{f} IS NOT NULL AND isfinite({f})" for f in FEATURES)


def features(src: str = "f", out: str = "feats") -> list[str]:
    """Complete rows stored as FLOAT, tickers with more than 100 of them."""
    cols = ", ".join(f"CAST({f} AS FLOAT) AS {f}" for f in FEATURES)
    return [f"""{out} AS MATERIALIZED (SELECT * FROM (SELECT ticker, date, bar_no, {cols}, y, label_end,
        row_number() OVER (PARTITION BY ticker ORDER BY date) AS row_no,
        count(*) OVER (PARTITION BY ticker) AS n_rows FROM {src} WHERE {ALL_THERE}) WHERE n_rows > 100)"""]


def lagged(k: int, src: str = "feats", out: str = "lagged") -> list[str]:
    cols = ", ".join(f"{_lag(f, k)} AS {f}" for f in FEATURES)
    return [f"""{out} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS row_no,
        count(*) OVER (PARTITION BY ticker) AS n_rows FROM (SELECT ticker, date, {cols}, y, label_end FROM {src})
        WHERE {FEATURES[0]} IS NOT NULL) WHERE n_rows > 100)"""]


def panel(src: str = "feats", out: str = "panel", where: str = "TRUE") -> list[str]:
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    return [f"""{out} AS MATERIALIZED (SELECT date, ticker, {cols}, y, label_end FROM {src}
        WHERE y IS NOT NULL AND label_end IS NOT NULL AND {where})"""]


def _z(f: str, by: str) -> str:
    sd = f"stddev_samp({f}) OVER (PARTITION BY {by})"
    return f"({f} - avg({f}) OVER (PARTITION BY {by})) / CASE WHEN {sd} > 0 THEN {sd} ELSE 1 END AS {f}"


def normalised(src: str = "panel", out: str = "z", by: str = "date", extra: str = "date, ticker, y, label_end") -> list[str]:
    return [f"{out} AS MATERIALIZED (SELECT {extra}, {', '.join(_z(f, by) for f in FEATURES)} FROM {src})"]


def positions(src: str = "panel") -> list[str]:
    return [f"""pos AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos,
        count(*) OVER () AS n_dates FROM (SELECT DISTINCT date FROM {src}))"""]


def folds(n_folds: int = P.n_folds, embargo: int = P.embargo) -> list[str]:
    return [f"""cuts AS (SELECT i, CAST(floor(i * (n / {n_folds + 1.0})) AS INTEGER) AS val_start,
          CASE WHEN i = {n_folds} THEN n ELSE CAST(floor((i + 1) * (n / {n_folds + 1.0})) AS INTEGER) END AS val_stop
          FROM (SELECT max(n_dates) AS n FROM pos), range(1, {n_folds + 1}) t(i))""",
            f"""folds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i) - 1 AS fold, val_start - {embargo} AS train_stop,
          val_start, val_stop FROM cuts WHERE val_start - {embargo} >= 1 AND val_stop > val_start)""",
            """roles AS MATERIALIZED (SELECT pos.date, pos.pos, fold, CASE WHEN pos.pos < train_stop THEN 'train' ELSE 'val' END AS role
          FROM pos JOIN folds ON pos.pos < train_stop OR (pos.pos >= val_start AND pos.pos < val_stop))"""]


# ------------------------------------------------- rule-based predictions
def rule_oof(src: str = "z", out: str = "oof") -> list[str]:
    """Validation rows of the folds with rule-based stand-ins for both learners."""
    votes = ["ret_5d", "ret_10d", "ret_21d", "ret_42d", "ret_63d"]
    return [f"""{out} AS MATERIALIZED (SELECT 1 AS model, z.date, z.ticker, roles.fold, 0.02 * mom_3_1 + 0.01 * ret_21d AS rf,
        0.02 * mom_3_1 + 0.01 * zscore_21 AS gb, y, {', '.join(f'0.02 * {v} AS v{i}' for i, v in enumerate(votes))}
        FROM {src} z JOIN roles ON roles.date = z.date AND roles.role = 'val')"""]


def ridge(tag: str = "") -> list[str]:
    """The stack fitted on oof; with a tag, on the table of that name, its tables likewise named."""
    return [re.sub(r"\b(oof|mom|fit|loo|ridge|stk|cal)\b", rf"\1{tag}", sql) for sql in [
        """mom AS (SELECT count(*) AS n, avg(rf) AS mr, avg(gb) AS mg, avg(y) AS my, var_pop(rf) * count(*) AS srr,
          var_pop(gb) * count(*) AS sgg, covar_pop(rf, gb) * count(*) AS srg, covar_pop(rf, y) * count(*) AS sry,
          covar_pop(gb, y) * count(*) AS sgy FROM oof)""",
        """fit AS (SELECT *, (b * sry - srg * sgy) / det AS wr, (a * sgy - srg * sry) / det AS wg FROM
          (SELECT *, a * b - srg * srg AS det FROM (SELECT mom.*, alpha, srr + alpha AS a, sgg + alpha AS b
           FROM mom, (VALUES (CAST(0.1 AS DOUBLE)), (1), (10), (100)) t(alpha))))""",
        """loo AS (SELECT alpha, avg(pow((y - my - (rf - mr) * wr - (gb - mg) * wg) / (1 - (1.0 / n
          + (b * pow(rf - mr, 2) - 2 * srg * (rf - mr) * (gb - mg) + a * pow(gb - mg, 2)) / det)), 2)) AS loo_error
          FROM oof, fit GROUP BY alpha)""",
        """ridge AS MATERIALIZED (SELECT 1 AS model, n, alpha, loo_error, wr AS w_rf, wg AS w_gb,
          my - wr * mr - wg * mg AS intercept FROM fit JOIN loo USING (alpha) ORDER BY loo_error, alpha LIMIT 1)""",
        """stk AS MATERIALIZED (SELECT oof.*, intercept + w_rf * rf + w_gb * gb AS pred,
          1 / (1 + 5 * abs(rf - gb)) AS confidence,
          list_aggregate([v0, v1, v2, v3, v4], 'stddev_pop') AS tree_std FROM oof, ridge)""",
        """cal AS MATERIALIZED (SELECT 1 AS model, count(*) AS n_oof, 1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(*)) AS oof_r2,
          stddev_pop(y - pred) AS residual_std, avg(abs(y - pred)) AS residual_mae FROM stk)"""]]


def permuted(seed: int, out: str, src: str = "panel") -> list[str]:
    """Labels dealt anew among the tickers of each date."""
    order = "md5(ticker || '-' || CAST(date AS VARCHAR) || '-{}'), ticker"
    rows = "(SELECT date, {}, row_number() OVER (PARTITION BY date ORDER BY {}) AS rn FROM {})"
    return [f"""{out} AS MATERIALIZED (SELECT date, ticker, y FROM {rows.format('ticker', order.format(f'{seed}a'), src)} a
        JOIN {rows.format('y', order.format(f'{seed}b'), src)} b USING (date, rn))"""]


def refits(seeds: list[int]) -> list[str]:
    """r2(kind, oof_r2): the stack refitted on true labels, on permuted ones, and on features of the day before."""
    out, kinds = ridge(), ["SELECT 'real' AS kind, oof_r2 FROM cal"]
    for k, seed in enumerate(seeds):
        out += permuted(seed, f"perm{k}")
        out += [f"oof_p{k} AS MATERIALIZED (SELECT oof.* REPLACE (p.y AS y) FROM oof JOIN perm{k} p USING (date, ticker))"]
        out += ridge(f"_p{k}")
        kinds.append(f"SELECT 'permuted', oof_r2 FROM cal_p{k}")
    out += lagged(1) + panel("lagged", "lpanel") + normalised("lpanel", "lz") + rule_oof("lz", "oof_lag") + ridge("_lag")
    kinds.append("SELECT 'lagged', oof_r2 FROM cal_lag")
    return [*out, f"r2 AS MATERIALIZED ({' UNION ALL '.join(kinds)})"]


def tier(er: str, low: str, conf: str, std: str) -> str:
    return (f"CASE WHEN {er} <= 0 THEN 'AVOID' WHEN {low} > 0 AND {conf} > 0.6 AND {std} < 0.08 THEN 'HIGH' "
            f"WHEN {low} > -0.05 AND {conf} > 0.45 THEN 'MEDIUM' WHEN {conf} > 0.3 THEN 'LOW' ELSE 'SPECULATIVE' END")


def as_ofs() -> list[str]:
    """Last bar day of every calendar year."""
    return ["asofs AS MATERIALIZED (SELECT max(date) AS as_of FROM bars GROUP BY year(date))"]


def latest() -> list[str]:
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    return [f"""latest AS MATERIALIZED (SELECT * EXCLUDE rn FROM (SELECT as_of, ticker, date, row_no, {cols},
        row_number() OVER (PARTITION BY as_of, ticker ORDER BY date DESC) AS rn
        FROM feats JOIN asofs ON feats.date <= asofs.as_of) WHERE rn = 1 AND row_no > 100)""",
            f"""latest_z AS MATERIALIZED (SELECT as_of, ticker, date, row_no,
        {', '.join(_z(f, 'as_of') for f in FEATURES)} FROM latest)"""]


def rule_predictions() -> list[str]:
    votes = ["ret_5d", "ret_10d", "ret_21d", "ret_42d", "ret_63d"]
    return [f"""votes AS MATERIALIZED (SELECT 1 AS model, as_of, ticker, 0.06 + 0.03 * mom_3_1 AS rf, 0.06 + 0.03 * ret_21d AS gb,
          [{', '.join(f'0.06 + 0.03 * {v}' for v in votes)}] AS vs FROM latest_z)""",
            """preds AS MATERIALIZED (SELECT as_of, ticker, er AS expected_return,
          least(list_aggregate(vs, 'quantile_cont', 0.1), er - 1.28 * 0.04) AS ci_low,
          greatest(list_aggregate(vs, 'quantile_cont', 0.9), er + 1.28 * 0.04) AS ci_high,
          1 / (1 + 5 * abs(rf - gb)) AS confidence, list_aggregate(vs, 'stddev_pop') AS tree_std,
          CAST(0.04 AS DOUBLE) AS calibrated_std, rf AS rf_pred, gb AS gb_pred
          FROM (SELECT *, greatest(-0.5, least(1.0, 0.5 * rf + 0.5 * gb)) AS er FROM votes))"""]


INFO = """info AS MATERIALIZED (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS ticker, r_name AS sector,
    round(s_acctbal, 2) AS market_cap FROM supplier JOIN nation ON n_nationkey = s_nationkey
    JOIN region ON r_regionkey = n_regionkey)"""


def signals() -> list[str]:
    return [INFO, f"""sig AS MATERIALIZED (SELECT *, 0.45 * conf_adj_return + 0.35 * sharpe_est / 3 + 0.2 * momentum_quality AS composite
        FROM (SELECT p.*, l.vol_21d AS volatility, i.sector, i.market_cap,
          {tier('expected_return', 'ci_low', 'confidence', 'tree_std')} AS conviction,
          expected_return * confidence AS conf_adj_return, greatest(l.vol_21d, 0.01) AS vol_21d,
          (expected_return - 0.045) / greatest(l.vol_21d, 0.01) AS sharpe_est,
          (l.mom_12_1 + l.mom_6_1 + l.mom_3_1) / 3 AS momentum_quality
          FROM preds p JOIN latest l USING (as_of, ticker) JOIN info i USING (ticker) WHERE l.row_no >= 50))""",
            """ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, ticker) AS rank FROM sig)""",
            """cand AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, ticker) AS pick
          FROM sig WHERE expected_return >= 0.05 AND confidence >= 0.4 AND conviction IN ('HIGH', 'MEDIUM', 'LOW'))
          WHERE pick <= 40)"""]


def returns() -> list[str]:
    return [
        f"daily AS MATERIALIZED (SELECT ticker, date, CAST(close AS DOUBLE) / {_lag('CAST(close AS DOUBLE)', 1)} - 1 AS ret FROM bars)",
        """rets0 AS MATERIALIZED (SELECT * FROM (SELECT c.as_of, c.ticker, d.ret,
          row_number() OVER (PARTITION BY c.as_of, c.ticker ORDER BY d.date DESC) AS n
          FROM cand c JOIN daily d ON d.ticker = c.ticker AND d.date <= c.as_of AND d.ret IS NOT NULL) WHERE n <= 252)""",
        """dims AS MATERIALIZED (SELECT as_of, min(k) AS m, count(*) AS p FROM
          (SELECT as_of, ticker, count(*) AS k FROM rets0 GROUP BY 1, 2) GROUP BY 1)""",
        """rets AS MATERIALIZED (SELECT as_of, ticker, n, ret - avg(ret) OVER (PARTITION BY as_of, ticker) AS x, m, p
          FROM rets0 JOIN dims USING (as_of) WHERE n <= m)"""]


def covariance() -> list[str]:
    return [
        """s AS MATERIALIZED (SELECT a.as_of, a.ticker AS ti, b.ticker AS tj, sum(a.x * b.x) / max(a.m) AS s
          FROM rets a JOIN rets b ON a.as_of = b.as_of AND a.n = b.n GROUP BY 1, 2, 3)""",
        """fourth AS (SELECT as_of, sum(q * q) AS f4 FROM (SELECT as_of, n, sum(x * x) AS q FROM rets GROUP BY 1, 2) GROUP BY 1)""",
        """shr AS MATERIALIZED (SELECT as_of, m, p, mu, CASE WHEN m < p + 5 THEN NULL WHEN least(beta, delta) = 0 THEN 0
          WHEN delta = 0 THEN 0 ELSE least(beta, delta) / delta END AS shrink FROM
          (SELECT as_of, m, p, mu, sq - p * mu * mu AS delta, (f4 / m - sq) / m AS beta FROM
           (SELECT as_of, sum(CASE WHEN ti = tj THEN s END) / count(DISTINCT ti) AS mu, sum(s * s) AS sq FROM s GROUP BY 1)
           JOIN fourth USING (as_of) JOIN dims USING (as_of)))""",
        """cov AS MATERIALIZED (SELECT as_of, ti, tj, CASE WHEN shrink IS NULL THEN CASE WHEN ti = tj THEN s ELSE 0 END
          ELSE (1 - shrink) * s + CASE WHEN ti = tj THEN shrink * mu ELSE 0 END END AS cov
          FROM s JOIN shr USING (as_of))"""]


def allocation() -> list[str]:
    return [
        """feas AS (SELECT as_of, sum(least(0.3, 0.1 * k)) >= 1 - 1e-12 AND max(m) >= 20 AS feasible FROM
          (SELECT as_of, sector, count(*) AS k FROM cand GROUP BY 1, 2) JOIN dims USING (as_of) GROUP BY 1)""",
        """capw AS (SELECT as_of, ticker, sector, r.rule, 0 AS it,
            pow(expected_return, r.g) / pow(greatest(volatility, 0.01), r.d) AS w
          FROM cand JOIN feas USING (as_of), (SELECT CAST(i AS INTEGER) AS rule, i // 3 AS g, i % 3 AS d FROM range(9) t(i)) r WHERE feasible
          UNION ALL SELECT as_of, ticker, sector, rule, it + 1,
            v * least(1.0, 0.3 / sum(v) OVER (PARTITION BY as_of, rule, sector)) FROM
            (SELECT as_of, ticker, sector, rule, it, least(w / sum(w) OVER (PARTITION BY as_of, rule), 0.1) AS v
             FROM capw WHERE it < 30))""",
        """wts AS MATERIALIZED (SELECT as_of, ticker, rule, TRUE AS feasible, w / sum(w) OVER (PARTITION BY as_of, rule) AS w
          FROM capw WHERE it = 30
          UNION ALL SELECT as_of, ticker, 0, FALSE, 1.0 / count(*) OVER (PARTITION BY as_of) FROM cand JOIN feas USING (as_of) WHERE NOT feasible)""",
        """shp AS (SELECT as_of, rule, (r - 0.045) / sqrt(greatest(v, 1e-10)) AS sharpe FROM
          (SELECT as_of, rule, sum(w * expected_return) AS r FROM wts JOIN cand USING (as_of, ticker) GROUP BY 1, 2)
          JOIN (SELECT a.as_of, a.rule, sum(a.w * b.w * cov * 252) AS v FROM wts a JOIN wts b ON a.as_of = b.as_of AND a.rule = b.rule
            JOIN cov ON cov.as_of = a.as_of AND cov.ti = a.ticker AND cov.tj = b.ticker GROUP BY 1, 2) USING (as_of, rule))""",
        """best AS (SELECT as_of, rule, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY as_of
          ORDER BY round(sharpe, 12) DESC, rule) AS rn FROM shp) WHERE rn = 1)""",
        """alloc AS MATERIALIZED (SELECT as_of, ticker, k / sum(k) OVER (PARTITION BY as_of) AS weight, expected_return, volatility,
          sector, rule, sharpe, feasible FROM (SELECT as_of, ticker, CASE WHEN w < 0.02 THEN 0 ELSE w END AS k, rule, sharpe, feasible
          FROM wts JOIN best USING (as_of, rule)) JOIN (SELECT as_of, ticker, expected_return, volatility, sector FROM cand) USING (as_of, ticker))"""]


# ----------------------------------------------------------------- ledger
def calendar() -> list[str]:
    return ["""cal0 AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM
        (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)))"""]


def rebalances(every: int = P.rebalance_every) -> list[str]:
    return [f"""reb AS MATERIALIZED (SELECT CAST((pos - s) // {every} AS INTEGER) AS k, date, e AS end_date FROM cal0,
        (SELECT least(504, count(*) // 2) AS s, max(date) AS e FROM cal0)
        WHERE pos >= s AND (pos - s) % {every} = 0 AND date < e)"""]


def aligned_index() -> list[str]:
    return bars("index", "ix") + [
        """aligned AS MATERIALIZED (SELECT cal0.date, CAST(ix.close AS DOUBLE) AS close
           FROM cal0 ASOF LEFT JOIN ix ON ix.date <= cal0.date)"""]


def schedules() -> list[str]:
    return [
        f"""m63 AS (SELECT ticker, date, CAST(close AS DOUBLE) / {_lag('CAST(close AS DOUBLE)', 63)} - 1 AS r FROM bars)""",
        """sched AS MATERIALIZED (SELECT 'strategy' AS strategy, k, ticker, CAST(0.5 AS DOUBLE) AS weight FROM
          (SELECT k, ticker, row_number() OVER (PARTITION BY k ORDER BY r DESC NULLS LAST, ticker) AS rn
           FROM reb JOIN m63 USING (date)) WHERE rn <= 2
          UNION ALL SELECT 'equal_weight', k, ticker, 1.0 / (SELECT count(DISTINCT ticker) FROM bars)
            FROM reb, (SELECT DISTINCT ticker FROM bars)
          UNION ALL SELECT 'index', k, 'INDEX', 1.0 FROM reb)"""]


def ledger() -> list[str]:
    return [
        """closes AS MATERIALIZED (SELECT date, ticker, CAST(close AS DOUBLE) AS close FROM bars
          UNION ALL SELECT date, 'INDEX', close FROM aligned)""",
        """steps AS MATERIALIZED (SELECT k, date, FALSE AS is_end FROM reb UNION ALL
          SELECT max(k) + 1, max(end_date), TRUE FROM reb)""",
        """grid AS MATERIALIZED (SELECT st.strategy, st.f, t.ticker, s.k, s.date, s.is_end, c.close AS p, coalesce(w.weight, 0) AS w
          FROM (VALUES ('strategy', CAST(0.95 AS DOUBLE)), ('equal_weight', 1), ('index', 1)) st(strategy, f),
            (SELECT DISTINCT ticker FROM closes) t, steps s
          JOIN closes c ON c.date = s.date AND c.ticker = t.ticker
          LEFT JOIN sched w ON w.strategy = st.strategy AND w.k = s.k AND w.ticker = t.ticker)""",
        """led AS (SELECT strategy, ticker, -1 AS k, CAST(0 AS DOUBLE) AS shares, CAST(1000000 AS DOUBLE) AS cash,
            CAST(NULL AS DATE) AS date, FALSE AS is_end, CAST(0 AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS cost,
            CAST(0 AS DOUBLE) AS turnover, CAST(0 AS BIGINT) AS n_positions, CAST(0 AS BIGINT) AS n_trades
          FROM (SELECT DISTINCT strategy, ticker FROM grid)
          UNION ALL SELECT strategy, ticker, k, tgt / p, greatest(0, v - c - sum(tgt) OVER s), date, is_end, v - CASE WHEN is_end THEN 0 ELSE c END,
            CASE WHEN is_end THEN 0 ELSE c END, tr / v, sum(CASE WHEN tgt > 0 THEN 1 ELSE 0 END) OVER s,
            sum(CASE WHEN abs(tgt - cur) > 1 THEN 1 ELSE 0 END) OVER s FROM
          (SELECT *, sum(abs(tgt - cur)) OVER s AS tr, sum(abs(tgt - cur)) OVER s * 0.001 AS c FROM
           (SELECT *, w * f * (v - 0.001 * sum(abs(w * f * v - cur)) OVER s) AS tgt FROM
            (SELECT g.*, l.shares * g.p AS cur, l.cash + sum(l.shares * g.p) OVER (PARTITION BY g.strategy) AS v
             FROM led l JOIN grid g ON g.strategy = l.strategy AND g.ticker = l.ticker AND g.k = l.k + 1) WINDOW s AS (PARTITION BY strategy))
           WINDOW s AS (PARTITION BY strategy)) WINDOW s AS (PARTITION BY strategy))""",
        """book AS MATERIALIZED (SELECT DISTINCT strategy, k, date, is_end, round(value, 2) AS value0, value, cost,
          CASE WHEN is_end THEN NULL ELSE turnover END AS turnover, CASE WHEN is_end THEN NULL ELSE n_positions END AS n_positions,
          CASE WHEN is_end THEN NULL ELSE n_trades END AS n_trades FROM led WHERE k >= 0 AND ticker = (SELECT min(ticker) FROM closes))"""]


def metrics() -> list[str]:
    return [
        """path AS (SELECT *, value / lag(value) OVER (PARTITION BY strategy ORDER BY date) - 1 AS ret,
          value / max(value) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM book)""",
        """perf0 AS (SELECT strategy, arg_max(value, date) AS final_value, arg_max(value, date) / arg_min(value, date) AS g,
          greatest(0.1, (max(date) - min(date)) / 365.25) AS years, coalesce(stddev_samp(ret), 0) * sqrt(12) AS volatility,
          count(ret) AS n_periods, min(dd) AS max_drawdown, avg(turnover) * 12 AS turnover_annualized, sum(cost) AS total_costs,
          CAST(sum(n_trades) AS BIGINT) AS num_trades FROM path GROUP BY strategy)""",
        """perf1 AS (SELECT *, g - 1 AS total_return, pow(g, 1 / years) - 1 AS cagr FROM perf0)""",
        """perf AS MATERIALIZED (SELECT *, (cagr - 0.045) / greatest(volatility, 1e-4) AS sharpe_ratio,
          CASE WHEN strategy <> 'strategy' THEN (SELECT cagr FROM perf1 WHERE strategy = 'strategy') - cagr END AS active_cagr FROM perf1)"""]


def sql(parts: list[str], final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final
