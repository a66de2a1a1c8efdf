"""Business parameters, with their standard values as defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Country, merchant category codes and thresholds.
COUNTRY = 616
HUB_MCCS = (5811, 5812, 5813, 5814)
MODEL_MCCS = (5812, 5814)
GROCERY_MCCS = (5411,)
LODGING_MCCS = (7011, 7012)
LEISURE_MCCS = (5813, 7832, 7922, 7941, 7991, 7996)
PLACE_TYPES = {5812: "restaurant", 5814: "fast food"}
HUB_MIN_NAMES = 60
ACTIVE_MIN_CARDS = 5
MIN_SHOPS_PER_MCC = 10
MIN_FULL_YEAR = 5
MIN_SHOPS_PER_CELL = 5
FOLDS = 5
TRAIN_SHARE = 0.7
CATCHMENT_KM = 5.0

Window = tuple[int, int]


@dataclass(frozen=True)
class Params:
    """Month windows (inclusive YYYYMM pairs) and thresholds of one run."""

    train_year: Window = (202501, 202512)
    target_year: Window = (202507, 202606)
    half_first: Window = (202507, 202512)
    half_second: Window = (202601, 202606)
    trend_before: Window = (202501, 202506)
    trend_after: Window = (202601, 202606)
    card_window: Window = (202501, 202606)
    hub_min_names: int = HUB_MIN_NAMES
    min_cards: int = ACTIVE_MIN_CARDS
    min_shops_per_mcc: int = MIN_SHOPS_PER_MCC
    min_registrations: int = 5
    min_full_year: int = MIN_FULL_YEAR
    min_shops_per_cell: int = MIN_SHOPS_PER_CELL
    catchment_km: float = CATCHMENT_KM


def months_in(window: Window) -> int:
    """Number of calendar months an inclusive YYYYMM window covers."""
    lo, hi = window
    return (hi // 100 - lo // 100) * 12 + hi % 100 - lo % 100 + 1
