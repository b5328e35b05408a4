"""Scalar expressions: ratios, fits, buckets, folding of text, stable assignment."""

from __future__ import annotations

import functools
import math
import unicodedata
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders of the feature tables.
UNKNOWN, UNSPECIFIED, NOT_APPLICABLE, MISSING = "__UNKNOWN__", "__UNSPECIFIED__", "__NOT_APPLICABLE__", "<missing>"


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null for a null or zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def parse_number(x: Column) -> Column:
    """A double from text; null if it does not parse."""
    return F.trim(x).try_cast("double")


def parse_flag(x: Column) -> Column:
    """Boolean from true/1/yes and false/0/no in any case; null for the rest."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the band (-inf, e1], (e1, e2], ..., (en, inf); null for null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, label in zip(edges, labels):
        out = out.when(x <= e, label)
    return out.otherwise(labels[-1])


@functools.cache
def _accented() -> tuple[str, str]:
    """Lower-case characters of the basic plane that decompose to one character and marks, and that character, by the Unicode tables of this Python."""
    pairs = []
    for c in (chr(k) for k in range(0xC0, 0x10000) if not 0xD800 <= k < 0xE000):
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c and c.lower() == c:
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_text(x: Column) -> Column:
    """Lower case without accents: what decomposes to a letter and marks becomes the letter, marks of their own go. Null stays null."""
    return F.regexp_replace(F.translate(F.lower(x), *_accented()), r"\p{Mn}+", "")


def mentions(x: Column, phrases: list[str]) -> Column:
    """Whether folded text holds any of the phrases; the text is folded once for all of them."""
    folded = fold_text(x)
    return F.coalesce(functools.reduce(lambda a, b: a | b, [F.contains(folded, F.lit(p)) for p in phrases], F.lit(False)), F.lit(False))


def json_list(x: Column) -> Column:
    """Distinct sorted strings of a JSON list; empty where it does not parse."""
    return F.array_sort(F.array_distinct(F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))))


def comma_count(x: Column) -> Column:
    """Items of a list by commas: 0 for blank text."""
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", 0).otherwise(F.regexp_count(x, F.lit(",")) + 1)


def interaction(*columns: str, by: str = " x ") -> Column:
    """Values joined to one key; nulls read nan."""
    return F.concat_ws(by, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def completeness(required: list[tuple[Column, Column]]) -> Column:
    """Share of values present among those that apply: pairs of (applies, value)."""
    have = sum((F.when(a, v.isNotNull().cast("int")).otherwise(0) for a, v in required), F.lit(0))
    need = sum((F.when(a, 1).otherwise(0) for a, _ in required), F.lit(0))
    return F.try_divide(have.cast("double"), need)


def mean_present(*columns: Column) -> Column:
    """Mean of the values that are not null; null if there is none."""
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.try_divide(total, sum((c.isNotNull().cast("int") for c in columns), F.lit(0)))


def weighted_present(pairs: list[tuple[float, Column]]) -> Column:
    """Weighted mean over the values that are not null, weights renormalised."""
    total = sum((F.coalesce(c * w, F.lit(0.0)) for w, c in pairs), F.lit(0.0))
    return F.try_divide(total, sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in pairs), F.lit(0.0)))


def geometric_mean(*columns: Column) -> Column:
    """Geometric mean of positive values; 0 if one is 0, null if one is null."""
    product = F.lit(1.0)
    for c in columns:
        product = product * c
    return F.when(product > 0, F.exp(F.log(product) / len(columns))).otherwise(product)


def ratio_fit(a: Column, b: Column) -> Column:
    """exp(-|ln(a / b)|): 1 for equal, 0.5 for a factor of two; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.exp(-F.abs(F.log(a.cast("double") / b))))


def gap_fit(value: Column, wanted: Column) -> Column:
    """max(0, 1 - |value - wanted| / wanted)."""
    return F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(value - wanted), wanted))


def budget_fit(price: Column, lo: Column, hi: Column) -> Column:
    """1 inside [lo, hi], hi/price above, price/lo below; null for an unknown price or no bounds."""
    return F.when(price.isNull() | (lo.isNull() & hi.isNull()), F.lit(None).cast("double")).when(price > hi, hi / price).when(price < lo, price / lo).otherwise(1.0)


def budget_state(applies: Column, lo: Column, hi: Column) -> Column:
    """NOT_APPLICABLE, OBSERVED (both bounds), PARTIAL (one) or UNKNOWN."""
    return F.when(~F.coalesce(applies, F.lit(False)), "NOT_APPLICABLE").when(lo.isNotNull() & hi.isNotNull(), "OBSERVED").when(lo.isNotNull() | hi.isNotNull(), "PARTIAL").otherwise("UNKNOWN")


def within_interval(x: Column, lo: Column, hi: Column) -> Column:
    """Whether lo <= x <= hi; null if anything is unknown."""
    return F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), x.between(lo, hi))


def interval_distance(x: Column, lo: Column, hi: Column) -> Column:
    """Distance of x from [lo, hi], in units of the interval's middle; 0 inside."""
    return F.try_divide(F.greatest(lo - x, F.lit(0.0)) + F.greatest(x - hi, F.lit(0.0)), F.abs(lo + hi) / 2)


def mode_compatible(wanted: Column, offered: Column) -> Column:
    """Equal modes, or either side takes both."""
    return (wanted == "both") | (offered == "both") | (wanted == offered)


def saturation(n: Column, scale: float = 3.0) -> Column:
    return 1 - F.exp(-n / scale)


def logistic(intercept: float, terms: list[tuple[float, Column, float, float, float]]) -> Column:
    """A frozen logistic model: terms of (coefficient, value, mean, spread, fill)."""
    z = F.lit(intercept)
    for coefficient, value, mean, spread, fill in terms:
        z = z + coefficient * (F.coalesce(value.cast("double"), F.lit(fill)) - mean) / spread
    return 1 / (1 + F.exp(-z))


def unit_hash(salt: str, entity: Column) -> Column:
    """A number in [0, 1) from the first 8 bytes of SHA-256(salt|entity)."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), entity.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / float(2**64)


def sticky_arm(salt: str, entity: Column, share: float = 0.5) -> Column:
    """treatment or control, the same at every call."""
    return F.when(unit_hash(salt, entity) < share, "treatment").otherwise("control")


def scrambled(entity: Column, a: int, c: int, m: int) -> Column:
    """Order of a linear congruential step: (id * a + c) mod m, free of overflow for ids below 2^31."""
    return F.pmod(F.pmod(entity.cast("decimal(20,0)"), F.lit(m).cast("decimal(20,0)")) * F.lit(a).cast("decimal(10,0)") + F.lit(c).cast("decimal(20,0)"), F.lit(m).cast("decimal(20,0)")).cast("long")


def sample_size(base: float, lift: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Entities per arm to detect a relative lift of a rate, by the normal approximation."""
    other = base * (1 + lift)
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return math.ceil(z * z * (base * (1 - base) + other * (1 - other)) / (base - other) ** 2)
