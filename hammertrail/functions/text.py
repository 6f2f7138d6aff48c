"""Text expressions: folding, tokens, titles, numbers and dates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Brands written as two words.
TWO_WORD_BRANDS = ["MV AGUSTA", "LAND ROVER", "ALFA ROMEO", "ASTON MARTIN", "CAN-AM"]
# Gearbox word that may stand between the power and the trim level.
GEARBOX_PREFIX = (
    r"(?i)^(?:S\s*tronic|DSG|EDC|EAT|BVA|BVM|CVT|tiptronic|automatique|manuelle"
    r"|DCT|PowerShift|tronic)\s*\d*\s+"
)
# Letters of a brand word.
BRAND_WORD = "^[A-ZÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ0-9-]+$"
# Colour words that may end a title.
COLOUR_SUFFIX = (
    r"(?iu)\s+(Noir|Blanc|Bleu|Rouge|Gris|Vert|Jaune|Orange|Marron|Beige|Argent|Bronze"
    r"|Bordeaux|Violet)[\wéèêëàâäôöùûüïîç\s]*$"
)
# Cities looked for when a page names no sale place.
KNOWN_CITIES = [
    "Bordeaux", "Lyon", "Paris", "Marseille", "Lille", "Rennes", "Strasbourg",
    "Toulouse", "Nantes", "Rouen", "Montpellier", "Grenoble", "Caen",
]
# Days before and after the scrape in which a sale date is plausible.
PAST_DAYS, FUTURE_DAYS = 14, 120
# ----------------------------------------------------------------------------


def _accent_map() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus marks."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(p for p in parts if not 0x0300 <= ord(p) <= 0x036F)
        if len(parts) > 1 and len(base) == 1:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_map()


#: Characters beyond the two cases of a letter that Java takes for it where case is ignored.
_FOLDED = {"i": "İı", "s": "ſ", "k": "\u212a"}


def any_case(pattern: str) -> str:
    """``pattern`` under ``(?iu)``, with each letter as the class of its cases, which Java searches several times as fast.

    ``pattern`` holds no range of letters.
    """
    out, held = [], False
    for at, char in enumerate(pattern):
        if char in "[]" and pattern[at - 1:at] != "\\":
            held = char == "["
        elif char.isalpha() and pattern[at - 1:at] != "\\":
            cases = char.lower() + char.upper() + _FOLDED.get(char.lower(), "")
            char = cases if held else f"[{cases}]"
        out.append(char)
    return "".join(out)


def blank_to_null(col: Column) -> Column:
    """'' and NULL both mean "unknown" for identifiers and dates."""
    return F.nullif(col, F.lit(""))


def strip_accents(col: Column) -> Column:
    # A text of as many bytes as characters has no accents.
    stripped = F.regexp_replace(F.translate(col, ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(stripped)


def normalize_key(col: Column) -> Column:
    """Accent-free lower-case key in which other characters become one space."""
    text = F.lower(strip_accents(F.coalesce(col, F.lit(""))))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def fold(col: Column) -> Column:
    """Search form: accent-free, lower-case, trimmed."""
    return F.trim(F.lower(strip_accents(F.coalesce(col, F.lit("")))))


def tokens(col: Column) -> Column:
    """Distinct tokens of the normalised key."""
    return F.array_distinct(F.array_remove(F.split(normalize_key(col), " "), ""))


def overlap(a_tokens: Column, b_tokens: Column) -> Column:
    """Shared tokens over the size of the larger set; an empty set gives 0."""
    larger = F.greatest(F.size(a_tokens), F.size(b_tokens))
    smaller = F.least(F.size(a_tokens), F.size(b_tokens))
    shared = F.size(F.array_intersect(a_tokens, b_tokens))
    return F.when(smaller > 0, shared / larger).otherwise(F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    return overlap(tokens(a), tokens(b))


def ci_equal(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def ci_contains(a: Column, b: Column) -> Column:
    """Either text holds the other; '' is held by every text."""
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def first_word(col: Column) -> Column:
    return F.upper(F.get(F.split(col, r"\s+"), F.lit(0)))


def trim_level(version: Column) -> Column:
    """Trim name that follows "<n> ch [gearbox]" in a version text, else ''."""
    tail = F.trim(F.regexp_extract(F.coalesce(version, F.lit("")), r"(?i)\bch\s+(.+)$", 1))
    return F.trim(F.regexp_replace(tail, GEARBOX_PREFIX, ""))


def brand_of(title: Column) -> Column:
    """Two-word brand, else the first upper-case word, else the first word."""
    words = F.split(title, r"\s+")
    upper_words = F.filter(
        words, lambda w: (w == F.upper(w)) & (F.length(w) > 1) & w.rlike(BRAND_WORD)
    )
    known = [F.when(F.startswith(F.upper(title), F.lit(b)), F.lit(b)) for b in TWO_WORD_BRANDS]
    return F.coalesce(*known, F.get(upper_words, F.lit(0)), F.get(words, F.lit(0)))


def model_of(version: Column) -> Column:
    return F.concat_ws(" ", F.slice(F.split(version, r"\s+"), 1, 2))


def first_int(col: Column, pattern: str) -> Column:
    """First capture of ``pattern`` as an integer, NULL without a match.

    A failed try_cast raises inside; NULL instead of '' spares that.
    """
    return blank_to_null(F.regexp_extract(F.coalesce(col, F.lit("")), pattern, 1)).try_cast("bigint")


def parse_year(col: Column) -> Column:
    return F.coalesce(first_int(col, r"(\d{4})"), F.lit(0))


def without_spaces(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\s\u00a0\u202f]", "")


def parse_km(col: Column) -> Column:
    return F.coalesce(first_int(without_spaces(col), r"(\d+)"), F.lit(0))


def parse_price(col: Column, pattern: str = r"(\d+)") -> Column:
    return first_int(without_spaces(col), pattern)


def parse_date(col: Column) -> Column:
    """dd/MM/yy(yy) to ISO; any other shape is kept as it is."""

    def iso(col: Column, parts: Column) -> Column:
        year = F.get(parts, F.lit(2))
        year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        day = F.concat_ws("-", year, F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
        return F.when(F.size(parts) == 3, day).otherwise(col)

    # The arrays of one keep the text and its parts from being worked out for every use.
    split = F.transform(F.array(col), lambda x: F.struct(x.alias("text"), F.split(x, "/").alias("parts")))
    return F.get(F.transform(split, lambda s: iso(s["text"], s["parts"])), F.lit(0))


def plausible_date(text: Column, as_of: Column) -> Column:
    """First dd/MM/yyyy in the text that lies near ``as_of``; NULL without one."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d{2}/\d{2}/\d{2,4})"), 1), parse_date
    )
    days = F.transform(found, lambda iso: F.struct(iso.alias("iso"), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).alias("day")))

    def near(x: Column) -> Column:
        return (x["day"] >= as_of - F.expr(f"interval {PAST_DAYS} days")) & (
            x["day"] <= as_of + F.expr(f"interval {FUTURE_DAYS} days")
        )

    return F.get(F.filter(days, near), F.lit(0))["iso"]


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def order_date(sale_date: Column, ts: Column) -> Column:
    return F.coalesce(blank_to_null(sale_date), utc_day(ts))


def json_strings(col: Column) -> Column:
    """JSON array text as array<string>; malformed or missing gives []."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def dedup_items(items: Column) -> Column:
    """Ordered, case-insensitive de-duplication of a short string array."""
    lowered = F.transform(items, F.lower)
    return F.filter(
        items, lambda x, i: F.array_position(lowered, F.lower(x)) == (i + 1).cast("bigint")
    )
