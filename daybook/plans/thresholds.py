"""Alert bands. A band list is ascending in badness and the last band reached wins.

Fixed values: they decide RED/AMBER, so they are stated as plain numbers.
``lower_is_worse`` bands fire strictly below their bound; the others at or above it.
"""

from __future__ import annotations

from dataclasses import dataclass

RED, AMBER, GREEN, IDLE = "RED", "AMBER", "GREEN", "IDLE"
CRITICAL, HIGH, MEDIUM, LOW = "CRITICAL", "HIGH", "MEDIUM", "LOW"


@dataclass(frozen=True)
class Threshold:
    bands: tuple[tuple[float, str, str], ...]
    lower_is_worse: bool = False


def two_step(amber: float, red: float, critical: float | None = None) -> Threshold:
    bands = [(amber, AMBER, MEDIUM), (red, RED, HIGH)]
    if critical is not None:
        bands.append((critical, RED, CRITICAL))
    return Threshold(tuple(bands))


def amber_only(at: float) -> Threshold:
    return Threshold(((at, AMBER, MEDIUM),))


def falling(amber: float, red: float) -> Threshold:
    return Threshold(((amber, AMBER, MEDIUM), (red, RED, HIGH)), lower_is_worse=True)


NO_BANDS = Threshold(())

# Named thresholds.
NAMED: dict[str, Threshold] = {
    "DECLINE_STREAK": two_step(2, 3),
    "LATEST_MOM_DECLINE": two_step(0.05, 0.10),
    "MOMENTUM_3M_DECLINE": two_step(0.05, 0.10),
    "PEAK_GAP": two_step(0.20, 0.40, 0.60),
    "SHARE_LOSS_PP": two_step(0.05, 0.10),
    "NEGATIVE_SLOPE": two_step(0.005, 0.01),
    "COMPANY_DECLINE": two_step(0.05, 0.10, 0.20),
    "DECLINING_SHARE_OF_ENTITIES": two_step(0.50, 0.75),
    "VOLATILITY_CV": two_step(0.15, 0.30),
    "PEAK_TROUGH_RATIO": two_step(2.0, 3.0),
    "HHI": two_step(1.95, 3.25, 10.4),
    "HHI_MEMBER_MAX": two_step(1.95, 2.6),
    "HHI_PORTFOLIO_AVERAGE": Threshold(((1.56, AMBER, LOW), (1.95, RED, HIGH))),
    "HHI_SPREAD": amber_only(0.65),
    "HHI_ABOVE_MODERATE": amber_only(0.5),
    "HHI_ABOVE_AVERAGE": amber_only(2 / 3),
    "HHI_MAX_MIN_RATIO": Threshold(((1.5, AMBER, LOW), (2.0, RED, HIGH))),
    "HHI_HEALTH_SHORTFALL": two_step(40, 50),
    "HHI_EXCESS_TOTAL": amber_only(1.3),
    "TOP2_DEPENDENCY": two_step(0.70, 0.80),
    "TOP3_CONCENTRATION": two_step(0.40, 0.55),
    "TOP1_CONCENTRATION": two_step(0.15, 0.25),
    "TOP5_CONCENTRATION": two_step(0.60, 0.75),
    "SINGLE_ENTITY_DEPENDENCY": two_step(0.60, 0.75),
    "EQUAL_SHARE_DEVIATION": two_step(0.30, 0.50),
    "HEAD_TO_HEAD_GAP": two_step(0.30, 0.60),
    "AVERAGE_RANK_WEAK": two_step(3.5, 5),
    "MONTH_RANK_WEAK": two_step(7, 10),
    "RANK_LEADER_UBIQUITY": two_step(0.75, 0.9),
    "LATEST_PERIOD_RANK_SHARE": two_step(0.69, 0.85),
    "RANK_VOLATILITY_SHARE": two_step(0.31, 0.385),
    "RANK_DRIFT_SHARE": two_step(0.154, 0.31),
    "BOTTOM_RANK_UBIQUITY": two_step(2, 3),
    "WEAKEST_RANK_SHARE": two_step(0.83, 0.95),
    "MATERIAL_NEGATIVE_CONTRIBUTOR": two_step(0.15, 0.30),
    "MOVEMENT_CONCENTRATION": two_step(0.30, 0.50),
    "TOP2_NEGATIVE_SHARE": Threshold(((0.70, AMBER, HIGH),)),
    "CHANGE_DISPERSION": amber_only(2),
    "CHANGE_DISTRIBUTION_SPREAD": amber_only(1.5),
    "NET_REVENUE_DECLINE": Threshold(((0.0000001, RED, HIGH), (0.10, RED, CRITICAL))),
    "LATEST_MONTH_FELL": amber_only(0.01),
    "DECLINE_RUNWAY_SHORTFALL": two_step(0.01, 6),
    "ENTITY_DECLINE_SHARE": two_step(0.07, 0.15),
    "RECOVERABLE_SHARE": two_step(0.10, 0.20),
    "OFFSET_DEFICIT": two_step(0.25, 0.50),
    "COVERAGE_GAP": two_step(0.40, 0.60),
}


def resolve(threshold: str | Threshold) -> Threshold:
    return NAMED[threshold] if isinstance(threshold, str) else threshold
