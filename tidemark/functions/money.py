"""Fees, profit and numbers in texts. Money is BIGINT; halves round to even."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: At least this price means that no price is known.
SENTINEL = 8_000_000


@dataclass(frozen=True)
class Fees:
    base: int = 2500
    rate: float = 0.06
    vat: float = 0.1
    inspection: int = 2500
    market_shipping: int = 0
    seller_shipping: int = 3000


FEES = Fees()


def sell_fee(price: Column, f: Fees = FEES) -> Column:
    raw = (F.lit(float(f.base)) + price.cast("double") * F.lit(f.rate)) * F.lit(1 + f.vat)
    return F.bround(raw, 0).cast("bigint")


def total_fees(price: Column, f: Fees = FEES) -> Column:
    return sell_fee(price, f) + F.lit(f.inspection + f.market_shipping + f.seller_shipping)


def net_profit(price: Column, cost: Column, f: Fees = FEES) -> Column:
    return price - cost - total_fees(price, f)


def roi(profit: Column, cost: Column) -> Column:
    """Percent with one decimal; 0 where there is no cost."""
    return F.when(cost > 0, F.bround(profit.cast("double") / cost.cast("double") * F.lit(100.0), 1)).otherwise(F.lit(0.0))


def signal(profit: Column, volume: Column, strong: int = 30_000, buy: int = 15_000, watch: int = 5_000, volumes: tuple[int, int, int] = (1, 1, 1)) -> Column:
    """strong_buy, buy, watch or none; each level wants its volume (null counts as none)."""
    v = F.coalesce(volume, F.lit(0))
    return (
        F.when((profit >= strong) & (v >= volumes[0]), "strong_buy").when((profit >= buy) & (v >= volumes[1]), "buy")
        .when((profit >= watch) & (v >= volumes[2]), "watch").otherwise("none")
    )


def profit_signal(profit: Column, strong: int = 30_000, buy: int = 15_000, watch: int = 5_000) -> Column:
    """The level by profit alone, for monitors that know no volume."""
    return F.when(profit >= strong, "strong_buy").when(profit >= buy, "buy").when(profit >= watch, "watch").otherwise("none")


def discount_rate(sale: Column, original: Column) -> Column:
    return F.when((original > sale) & (sale > 0), F.bround(F.lit(1.0) - sale.cast("double") / original.cast("double"), 3)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole, 0 where whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.bround(part.cast("double") * F.lit(100.0) / whole.cast("double"), places))


def digits(c: Column) -> Column:
    """A positive number from the digits of a text; null else."""
    n = F.regexp_replace(c.cast("string"), "[^0-9]", "").try_cast("bigint")
    return F.when(n > 0, n)


def price_or_zero(c: Column) -> Column:
    """'12,300원' to 12300; null and text without digits to 0."""
    return F.coalesce(F.regexp_extract(F.replace(c, F.lit(",")), "([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def real_price(c: Column) -> Column:
    """Null for prices of 0 or less and for sentinels."""
    return F.when((c > 0) & (c < SENTINEL), c)


def price_insane(sell: Column, cost: Column, multiplier: float = 5.0) -> Column:
    return F.coalesce((cost > 0) & (sell.cast("double") > cost.cast("double") * F.lit(multiplier)), F.lit(False))


def liquidity(sales: Column, asks: Column) -> Column:
    """r / (r + 1) for r sales an ask; 0 without sales, 1 without asks."""
    r = sales.cast("double") / asks.cast("double")
    return F.when(sales <= 0, 0.0).when(asks <= 0, 1.0).otherwise(r / (r + 1.0))


def state_hash(*cols: Column) -> Column:
    """Changes when a value changes, null values included."""
    names = [f"c{i}" for i in range(len(cols))]
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for c, n in zip(cols, names)]), {"ignoreNullFields": "false"}), 256)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
