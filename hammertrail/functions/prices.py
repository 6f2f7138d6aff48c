"""Price rules, margins, levels and presentation of amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# A starting price of exactly 100 is a placeholder once a bid or sale of 500,
# or a valuation of 1000, is known.
PLACEHOLDER, BID_FLOOR, VALUATION_FLOOR = 100, 500, 1000
# Repair floors: sibling price, same-row valuation, same-row bid.
SIBLING_FLOOR, REPAIR_VALUATION_FLOOR, REPAIR_BID_FLOOR = 500, 1000, 1000
# Not-drivable wording: strict for listing pages (case matters), loose for
# panels, comparable for the sold sample.
NOT_DRIVABLE = {
    # A word ends at ASCII letters, digits and the underscore only, on every Java version: "accidente" must not go on,
    # while "accidenté" counts only where such a character follows.
    "strict": (
        r"v[ée]hicule\s+non\s*roulant(?![A-Za-z0-9_])|v[ée]hicule\s+hors\s+d['’]\s*usage(?![A-Za-z0-9_])"
        r"|v[ée]hicule\s+[eé]pave(?![A-Za-z0-9_])|v[ée]hicule\s+accident(?:é(?=[A-Za-z0-9_])|e(?![A-Za-z0-9_]))"
        r"|(?:^|\s)NON\s+ROULANT(?![A-Za-z0-9_])"
        r"|mention\s+[eé]pave(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])statut\s*:\s*[eé]pave(?![A-Za-z0-9_])"
    ),
    "loose": r"(?i)non\s*roulant",
    "comparable": r"(?iu)non\s*roulant|hors\s*d['’]usage|[eé]pave|accident[eé]",
}
# Each strict wording holds one of these, which are found faster.
STRICT_WORDS = ["roulant", "ROULANT", "usage", "pave", "accident"]
PRESALE = ["available", "auction_live"]
TERMINAL = ["sold", "unsold"]
# Similarity levels.
EXACT_FROM, SAME_MODEL_FROM, SIMILAR_FROM = 90, 60, 40
STATUS_LABELS = {
    "auction_live": "Enchere en cours",
    "sold": "Vendu",
    "unsold": "Invendu",
    "removed": "Retire",
    "available": "Disponible",
}
STATUS_TONES = {"sold": "green", "unsold": "red", "removed": "red", "auction_live": "amber"}
DASH = "—"
# ----------------------------------------------------------------------------


def known(col: Column) -> Column:
    """0 and NULL both count as "no value"."""
    return F.nullif(col, F.lit(0).cast("bigint"))


def at_least(col: Column, floor: int) -> Column:
    return F.coalesce(col, F.lit(0)) >= floor


def disproves_placeholder(live: Column, sold: Column, market: Column, new: Column) -> Column:
    """Evidence that a lot is worth far more than the placeholder."""
    return (
        at_least(live, BID_FLOOR)
        | at_least(sold, BID_FLOOR)
        | at_least(market, VALUATION_FLOOR)
        | at_least(new, VALUATION_FLOOR)
    )


def is_placeholder(price: Column, live: Column, sold: Column, market: Column, new: Column) -> Column:
    return price.eqNullSafe(F.lit(PLACEHOLDER)) & disproves_placeholder(live, sold, market, new)


def scrub_price(price: Column, live: Column, sold: Column, market: Column, new: Column) -> Column:
    return F.when(~is_placeholder(price, live, sold, market, new), price)


def not_drivable(mode: str, *cols: Column) -> Column:
    hit = F.lit(False)
    for col in cols:
        text = F.coalesce(col, F.lit(""))
        found = text.rlike(NOT_DRIVABLE[mode])
        if mode == "strict":
            worded = F.lit(False)
            for word in STRICT_WORDS:
                worded = worded | F.contains(text, F.lit(word))
            found = worded & found
        hit = hit | found
    return hit


def is_presale(status: Column) -> Column:
    return status.isin(PRESALE)


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL)


def half_up(col: Column) -> Column:
    """Round with halves toward plus infinity."""
    return F.floor(col + F.lit(0.5)).cast("bigint")


def margin(sold: Column, base: Column) -> Column:
    return F.when(known(base).isNotNull(), sold - base)


def margin_pct(sold: Column, base: Column) -> Column:
    """Whole percent, halves away from zero."""
    return F.round((sold - base) * F.lit(100.0) / known(base)).cast("bigint")


def number_delta(before: Column, after: Column) -> Column:
    """after - before with NULL read as 0; NULL when both are NULL or equal."""
    changed = ~before.eqNullSafe(after)
    return F.when(changed, F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0)))


def direction(delta: Column) -> Column:
    return F.when(delta > 0, F.lit("up")).when(delta < 0, F.lit("down")).otherwise(F.lit("neutral"))


def power_gate(a: Column, b: Column) -> Column:
    """True when the power gap rules out similarity; asymmetric in ``a``."""
    allowed = F.greatest(F.lit(25), half_up(a * F.lit(0.2)))
    gap = F.abs(a - b) > allowed
    return F.coalesce(F.when((a != 0) & (b != 0), gap), F.lit(False))


def match_level(score: Column) -> Column:
    return (
        F.when(score >= EXACT_FROM, F.lit("exact"))
        .when(score >= SAME_MODEL_FROM, F.lit("same_model"))
        .when(score >= SIMILAR_FROM, F.lit("similar"))
    )


def score_tone(score: Column, good: int = 80, warn: int = 65) -> Column:
    return (
        F.when(score >= good, F.lit("good")).when(score >= warn, F.lit("warn")).otherwise(F.lit("bad"))
    )


def km_per_year(km: Column, year: Column, as_of: Column) -> Column:
    """Kilometres per started year of age; unknown year gives NULL."""
    return km / F.greatest(F.lit(1), F.year(as_of) - known(year) + 1)


def _lookup(col: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), default)


def status_label(col: Column) -> Column:
    return _lookup(col, STATUS_LABELS, F.coalesce(F.nullif(col, F.lit("")), F.lit("Inconnu")))


def status_tone(col: Column) -> Column:
    return _lookup(col, STATUS_TONES, F.lit("blue"))


def grouped(col: Column) -> Column:
    """Whole number with narrow no-break spaces between thousands."""
    return F.translate(F.format_number(col, 0), ",", "\u202f")


def fmt_money(col: Column) -> Column:
    return F.coalesce(F.concat(grouped(col), F.lit(" €")), F.lit(DASH))


def fmt_km(col: Column) -> Column:
    return F.coalesce(F.concat(grouped(col), F.lit(" km")), F.lit(DASH))


def fmt_date(col: Column) -> Column:
    """ISO to dd/MM/yyyy; other text unchanged; NULL gives ''."""
    iso = r"^(\d{4})-(\d{2})-(\d{2}).*$"
    shown = F.when(col.rlike(iso), F.regexp_replace(col, iso, "$3/$2/$1")).otherwise(col)
    return F.coalesce(shown, F.lit(""))


def truncate(col: Column, width: int = 60) -> Column:
    text = F.trim(F.coalesce(col, F.lit("")))
    cut = F.concat(F.substring(text, 1, width - 1), F.lit("…"))
    return F.when(F.length(text) <= width, text).otherwise(cut)


def signed(delta: Column, unit: str = "") -> Column:
    sign = F.when(delta > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, grouped(delta), F.lit(unit))


def change_reason(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """Readable list of what changed in price, status, city and sale date."""

    def part(field: str, word: str, shown) -> Column:
        text = F.concat(F.lit(word + " "), shown(old[field]), F.lit(" → "), shown(new[field]))
        return F.when(~new[field].eqNullSafe(old[field]), text)

    def asked(col: Column) -> Column:
        return F.coalesce(F.nullif(col, F.lit("")), F.lit("?"))

    text = F.concat_ws(
        " · ",
        part("starting_price", "Prix", fmt_money),
        part("status", "Statut", lambda c: F.coalesce(c, F.lit(""))),
        part("city", "Ville", asked),
        part("sale_date", "Date", asked),
    )
    return F.when(text == "", F.lit("Modifié")).otherwise(text)


def countdown(sale_date: Column, sale_time: Column, as_of: Column) -> Column:
    """HH:MM:SS left until the sale (10:00 unless a HH:MM time is known)."""
    clock = F.when(sale_time.rlike(r"^\d{1,2}:\d{2}"), F.substring(sale_time, 1, 5)).otherwise(
        F.lit("10:00")
    )
    target = F.try_to_timestamp(F.concat(sale_date, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm"))
    left = F.timestamp_diff("SECOND", as_of, target)
    hours = F.floor(left / 3600).cast("bigint").cast("string")
    shown = F.concat_ws(
        ":",
        F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours),
        F.lpad(F.floor((left % 3600) / 60).cast("string"), 2, "0"),
        F.lpad((left % 60).cast("string"), 2, "0"),
    )
    return F.when(left > 0, shown)
