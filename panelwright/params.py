"""Job parameters: one frozen record handed to every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class JobParams:
    # Defaults that results must agree with.
    min_expected_return: float = 0.05
    backtest_min_return: float = 0.03
    confidence_threshold: float = 0.40

    min_market_cap: float = 2_000_000_000
    min_avg_volume: float = 500_000
    min_price: float = 5.0
    max_price: float = 10_000.0
    max_universe_size: int = 150

    max_position_size: float = 0.10
    max_sector_exposure: float = 0.30
    max_positions: int = 20
    risk_free_rate: float = 0.045
    min_weight_threshold: float = 0.02
    cash_reserve: float = 0.05

    horizon: int = 21
    first_rebalance: int = 504
    rebalance_every: int = 21
    retrain_every: int = 63
    cost_bps: float = 10.0
    trading_days: int = 252
    initial_capital: float = 1_000_000.0

    n_folds: int = 5
    rf_trees: int = 300
    rf_depth: int = 8
    rf_leaf: int = 50
    gb_rounds: int = 200
    gb_depth: int = 4
    gb_rate: float = 0.03
    gb_leaf: int = 50
    gb_subsample: float = 0.75
    seed: int = 42
    interval_pct: tuple[float, float] = (10.0, 90.0)
    interval_z: float = 1.28

    min_bars: int = 100
    min_feature_bars: int = 252
    min_feature_rows: int = 100
    min_signal_rows: int = 50
    min_panel_rows: int = 200
    min_oof_rows: int = 100

    # Physical knob, no effect on results: a table keyed by day is broadcast
    # only when the calendar span it covers is known to be at most this long.
    broadcast_days: int = 40_000

    def __post_init__(self) -> None:
        if self.n_folds < 1:
            raise ValueError("n_folds must be >= 1")

    @property
    def embargo(self) -> int:
        return self.horizon

    @property
    def cost_rate(self) -> float:
        return self.cost_bps / 10_000.0

    @property
    def periods_per_year(self) -> float:
        return self.trading_days / self.rebalance_every

    @property
    def retrain_stride(self) -> int:
        return max(1, self.retrain_every // self.rebalance_every)

    @property
    def max_candidates(self) -> int:
        return 2 * self.max_positions

    def with_(self, **changes) -> "JobParams":
        return replace(self, **changes)
