"""Parameters of a study as a frozen record; everything that depends on the scale of the data is one of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    base: int = 15  # minutes of a base bar
    signal: int = 60  # minutes of a signal bar
    point: float = 0.01  # price of one point of spread
    rate: float = 0.000016  # commission for each side, as a share of the price
    atr_period: int = 14
    day_atr: int = 7  # days of the daily range's average
    hist_days: int = 5  # days of same-slot history
    hist_min_days: int = 3
    resume_bars: int = 5  # consecutive bars of usual spread that reopen a day
    resume_factor: float = 1.5
    deadline: int = 990  # minute of the day by which it reopens anyway
    ref_from: int = 600  # minutes of the previous day whose median spread is usual
    flat: int = 1290  # minute of the day by which every position is closed
    session_end: int = 480
    gap_report: int = 1  # missing bars that are listed, and that quarantine a day
    gap_quarantine: int = 12
    horizons: tuple[int, ...] = (60, 120, 240)
    lags: tuple[int, ...] = (15, 60, 120, 240)  # minutes of the moves among the features
    range_span: int = 180  # minutes of the last bars' range, and of their volume
    volume_span: int = 60
    vol_rows: int = 10  # base bars of realised volatility
    overlap_rows: int = 6  # signal bars of the overlap
    stops: tuple[float, ...] = (1.0, 2.0)
    targets: tuple[float, ...] = (1.0, 2.0)
    # level events: minutes of signal bars, bands and stops in average true ranges, targets in what the stop risks
    level_bars: tuple[int, ...] = (60, 120)
    bands: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0)
    level_stops: tuple[float, ...] = (0.5, 1.0, 2.0)  # besides the structural stop
    level_targets: tuple[int, ...] = (1, 2, 3)
    level_window: int = 12  # signal bars within which a retest or a failure must come
    rearm: float = 0.5  # a level is free again after a close so many ranges off it
    last_entry: int = 1260  # minute of the day
    struct_floor: float = 0.1  # the least structural stop
    hours: tuple[int, ...] = (480, 600, 780, 990, 1080)  # edges of the day's parts
    reps: int = 200  # bootstrap resamples, and permutations
    alpha: float = 0.05
    seed: int = 7
    train_days: int = 15
    test_days: int = 3
    embargo: int = 1
    m1_bins: int = 5  # bins of a feature alone, and of each of a pair
    m2_bins: int = 3
    m2_min_rows: int = 30
    m2_min_days: int = 5
    m3_depth: int = 3
    min_leaf: int = 40
    fit_reps: int = 100  # resamples that activate a cell
    null_runs: int = 2  # runs with permuted training targets

    def fingerprint(self) -> str:
        """The first 16 digits of the SHA-256 of the sorted record."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


#: For bars of a few minutes made from hourly or sparser ticks, such as the driver's tables.
DEFAULT = Params()
#: For bars of one minute.
MINUTE = Params(
    base=1, signal=5, day_atr=14, hist_days=20, hist_min_days=10, gap_report=5, gap_quarantine=30, horizons=(30, 60, 120), lags=(5, 15, 60, 240), range_span=55, volume_span=10, vol_rows=30, overlap_rows=12,
    stops=(0.5, 1.0, 1.5, 2.0), targets=(1.0, 1.5, 2.0, 3.0), level_bars=(5, 15), m1_bins=10, m2_bins=5, m2_min_rows=200, m2_min_days=50, min_leaf=500, reps=10_000, fit_reps=1000, null_runs=200,
)
