"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Path of a listing's detail page.
DETAIL_PATH = "/vehicule/([a-f0-9]+)/"
# Paths and markers of list pages.
LIST_PATH = "(?i)/(vehicule|enchere|selection)/(liste|resultats)"
LIST_MARKERS = ["/rechercher/", "/recherche/", "?vente=", "?recherche="]
# ----------------------------------------------------------------------------


def normalize_url(col: Column) -> Column:
    """host + path + query without scheme, www., fragment or trailing slash."""
    raw = F.trim(F.coalesce(col, F.lit("")))
    host = F.regexp_replace(
        F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)),
        r"^www\.", "",
    )
    path = F.regexp_replace(
        F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", ""
    )
    query = F.regexp_extract(raw, r"^[^?#]*(\?[^#]+)", 1)
    bare = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.lower(raw), "^https?://", ""), r"^www\.", ""),
        "/+$", "",
    )
    return F.when(host != "", F.concat(host, path, query)).otherwise(bare)


def hash_from_url(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, DETAIL_PATH, 1), F.lit(""))


def page_url(col: Column, page: Column | int) -> Column:
    """Set the ``page`` parameter; page 1 and below drop it."""
    number = page if isinstance(page, Column) else F.lit(page)
    dropped = F.regexp_replace(
        F.regexp_replace(col, r"([?&])page=[^&#]*(&|(?=#)|$)", "$1"), r"[?&](?=#|$)", ""
    )
    glue = F.when(F.contains(dropped, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    base = F.regexp_extract(dropped, "^([^#]*)", 1)
    fragment = F.regexp_extract(dropped, "(#.*)$", 1)
    numbered = F.concat(base, glue, F.lit("page="), number.cast("string"), fragment)
    return F.when(number <= 1, dropped).otherwise(numbered)


def page_type(url: Column, host: str | None = None) -> Column:
    """detail, list or unknown from the address alone.

    ``host`` (a regular expression) restricts detail pages to one site.
    """
    detail = f"^https://(?:www\\.)?{host or '[^/]+'}{DETAIL_PATH}"
    listed = url.rlike(LIST_PATH)
    for marker in LIST_MARKERS:
        listed = listed | F.contains(url, F.lit(marker))
    return (
        F.when(url.rlike(detail), F.lit("detail"))
        .when(listed, F.lit("list"))
        .otherwise(F.lit("unknown"))
    )
