"""Gates before an alert. The first gate that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_reason(gates: list[tuple[str, Column]], passed: str = "pass") -> Column:
    """Name of the first condition that holds; a null condition doesn't (gates fail open)."""
    out = F
    for name, bad in gates:
        out = out.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(passed))


def below_floors(profit: Column, roi: Column, volume: Column, least: tuple[int, float, int] = (10_000, 5.0, 1)) -> list[tuple[str, Column]]:
    return [("profit_floor", profit < least[0]), ("roi_floor", roi < least[1]), ("volume_floor", F.coalesce(volume, F.lit(0)) < least[2])]


def estimated_floors(confirmed: Column, estimated: Column, confirmed_roi: Column, estimated_roi: Column, profit: int = 10_000, roi: float = 5.0) -> Column:
    """Confirmed profit meets the floors, or an estimate meets twice the profit and one and a half times the ROI."""
    return F.when(confirmed > 0, (confirmed >= profit) & (confirmed_roi >= roi)).otherwise((estimated >= 2 * profit) & (estimated_roi >= 1.5 * roi))


def prefilter_price(tentative: Column, last_price: Column, least: int = 10_000, upside: float = 0.20) -> Column:
    """True where even with the upside the profit stays below the floor; open when no price is known."""
    return F.coalesce((tentative + F.floor(last_price.cast("double") * F.lit(upside)).cast("bigint")) < least, F.lit(False))


def prefilter_volume(row_found: Column, volume: Column, least: int = 1) -> Column:
    """True for known products below the least volume, an unknown volume counting as none; open for unknown products."""
    return F.coalesce(row_found, F.lit(False)) & (F.coalesce(volume, F.lit(0)) < least)


def spread_anomaly(max_sell: Column, min_cost: Column, times: float = 2.0) -> Column:
    return F.coalesce((min_cost > 0) & (max_sell.cast("double") > min_cost.cast("double") * times), F.lit(False))


def gap_screen(price: Column, market: Column, least: int = -20_000) -> Column:
    return F.coalesce(price - market > least, F.lit(False))


def conjunction(conditions: list[Column | None]) -> Column:
    """All conditions that are given; true when none is."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def sent_status(status: Column, sentinel: int = 599) -> Column:
    """Really sent: any status but the sentinel, null included."""
    return ~status.eqNullSafe(F.lit(sentinel))


def purpose_in(purpose: Column, names: list[str]) -> Column:
    """The purpose itself or one of its sub-purposes ('name:...')."""
    out = F.lit(False)
    for n in names:
        out = out | (purpose == n) | purpose.startswith(f"{n}:")
    return F.coalesce(out, F.lit(False))


#: States of an item that is announced but not sold yet.
LAUNCH = ("COMING SOON", "UPCOMING", "LAUNCH", "PREORDER")


def buyable(item: Column) -> Column:
    """Items (JSON) on sale: no launch state, and not marked as not buyable."""
    state = F.upper(F.coalesce(F.get_json_object(item, "$.status"), F.lit("")))
    return ~state.isin(*LAUNCH) & (F.coalesce(F.get_json_object(item, "$.buyable"), F.lit("true")) != "false")
