"""One conservative label per message, or null (W1-W6), as one CASE over the hit mask.

The matched set is a 13-bit integer, so "exactly these two labels" is an integer comparison
and the whole decision stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions.normalize import strip
from threadweave.functions.patterns import SCREEN, STRONG_SCREENED, found, hit_mask, strong_hits, with_screen
from threadweave.operators.common import bind

_BIT = {name: 1 << i for i, name in enumerate(FV.TAXONOMY)}


def _bits(*names: str) -> int:
    return sum(_BIT[n] for n in names)


def _one_of(a: Column, b: Column, label_a: str, label_b: str) -> Column:
    """label_a when only a holds, label_b when only b holds, else null."""
    return F.when(a & ~b, label_a).when(b & ~a, label_b)


def _cue(lowered: Column, pattern: str) -> Column:
    return found(lowered, pattern, ignore_case=False)


def battery_or_charging(lowered: Column) -> Column:
    """W2."""
    return _one_of(
        _cue(lowered, FV.DRAIN_CUE), _cue(lowered, FV.CHARGE_CUE), "battery_drain", "charging_issue"
    )


def payment_or_subscription(lowered: Column) -> Column:
    """W3."""
    return _one_of(
        _cue(lowered, FV.PAYMENT_CUE), _cue(lowered, FV.SUBSCRIPTION_CUE),
        "payment_or_refund", "subscription_management",
    )


def update_or_app(lowered: Column) -> Column:
    """W4."""
    return F.when(_cue(lowered, FV.MANY_BROKEN_CUE), "software_update_issue").when(
        _cue(lowered, FV.NAMED_APP_CUE), "app_issue"
    )


def update_or_hardware(lowered: Column) -> Column:
    """W5."""
    return F.when(_cue(lowered, FV.PHYSICAL_CUE), "hardware_issue").when(
        _cue(lowered, FV.UPDATE_CUE), "software_update_issue"
    )


def label_from_mask(mask: Column, power: Column, money: Column, app: Column, physical: Column) -> Column:
    """W1 over the matched set and the four resolver outcomes (labels or null)."""
    both_power = _bits("battery_drain", "charging_issue")
    conflict_power = mask.bitwiseAND(F.lit(both_power)) == both_power
    winner_bit = F.when(power == "battery_drain", _BIT["battery_drain"]).otherwise(_BIT["charging_issue"])
    # Battery against charging is settled first; the loser leaves the set.
    settled = F.when(
        conflict_power, mask.bitwiseAND(F.lit(~both_power)).bitwiseOR(winner_bit)
    ).otherwise(mask)
    # A how-to question yields to whatever else was found.
    without_howto = settled.bitwiseAND(F.lit(~_BIT["howto_or_feature"]))

    label = F.when(mask == 0, F.lit(None).cast("string"))
    label = label.when(conflict_power & power.isNull(), F.lit(None).cast("string"))
    for matched in (settled, without_howto):
        single = F.get(F.array(*[F.lit(n) for n in FV.TAXONOMY]), F.bit_count(matched - 1))
        label = label.when(F.bit_count(matched) == 1, single)
        label = label.when(matched == _bits("payment_or_refund", "subscription_management"), money)
        label = label.when(matched == _bits("app_issue", "software_update_issue"), app)
        label = label.when(matched == _bits("hardware_issue", "software_update_issue"), physical)
        for a, b, winner in FV.TWO_LABEL_WINNERS:
            label = label.when(matched == _bits(a, b), F.lit(winner or None).cast("string"))
    # Three or more labels: a power symptom still beats the update it is blamed on.
    update = without_howto.bitwiseAND(F.lit(_BIT["software_update_issue"])) != 0
    for symptom in ("battery_drain", "charging_issue"):
        label = label.when(update & (without_howto.bitwiseAND(F.lit(_BIT[symptom])) != 0), symptom)
    return label


def with_weak_intent(
    df: DataFrame, text: str = "customer_text", label: str = "weak_intent", mask: str | None = None
) -> DataFrame:
    """W1. Add the label; ``mask`` keeps the hit mask under that name."""
    kept = mask or "_hits"
    trimmed = bind(df, _trimmed=strip(F.coalesce(F.col(text), F.lit(""))))
    screened = with_screen(trimmed, "_trimmed", STRONG_SCREENED)
    hit = bind(screened, **{kept: hit_mask(strong_hits("_trimmed", STRONG_SCREENED))}).drop(SCREEN)
    lowered = F.lower(F.col("_trimmed"))
    out = bind(
        hit,
        **{
            label: label_from_mask(
                F.col(kept), battery_or_charging(lowered), payment_or_subscription(lowered),
                update_or_app(lowered), update_or_hardware(lowered),
            )
        },
    )
    return out.drop("_trimmed") if mask else out.drop("_trimmed", kept)
