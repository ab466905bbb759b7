"""Parameters of the feature pipeline. Times are microseconds; the defaults suit a 500 ms grid."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    depth: int = 10
    rolling: int = 1500  # trades, tick directions, and the divisor of spread volatility
    zscore: int = 30000
    snapshot_us: int = 500_000
    sample_us: int = 50_000
    ring: int = 1800  # samples of mid and spread
    return_lag: int = 20  # the value lies one row further back, as a row is compared before it is stored
    ofi_decay: float = 0.5
    ofi_alpha: float = 0.2
    min_volume: float = 1e-6
    stress_levels: int = 5
    stress_size: float = 5.0
    stress_decay: float = 10.0
    stress_alpha: float = 0.1
    tick: float = 0.01


#: For the sparse event table of the tests: six hours, one hour, and short windows.
SPARSE = Params(rolling=200, zscore=40, snapshot_us=21_600_000_000, sample_us=3_600_000_000, ring=100, return_lag=5)

# The columns of the stored tables, in their order.
FEATURES = [
    "midprice", "log_spread", "log_return", "ewm_volatility", "realized_variance", "directional_volatility", "spread_volatility", "ofi",
    "signed_volume_pressure", "order_arrival_rate", "depth_imbalance", "market_depth", "lob_slope", "price_gap", "tick_direction_entropy",
    "reversal_rate", "aggressor_bias", "shannon_entropy", "liquidity_stress",
]
# The columns that regime models do without, and so those that they take.
DROPPED = [
    "timestamp_ns", "instrument", "aggressor_bias", "signed_volume_pressure", "midprice", "market_depth", "price_gap", "order_arrival_rate",
    "reversal_rate", "log_spread", "log_return", "depth_imbalance", "lob_slope", "spread_volatility", "ofi", "liquidity_stress",
]
MODEL = [f for f in FEATURES if f not in DROPPED]
