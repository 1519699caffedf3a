"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import _col, none_if_no_match


def url_token_extract(c: Column | str, pattern: str = fixed.VIEW_IN_URL) -> Column:
    return none_if_no_match(_col(c), pattern)


def url_int_token(c: Column | str, pattern: str = fixed.SHOT_IN_URL, default: int = fixed.MISSING_SHOT) -> Column:
    """Number inside a URL as an integer (so 10 sorts after 9), ``default`` where there is none."""
    return F.coalesce(F.regexp_extract(_col(c), pattern, 1).try_cast("int"), F.lit(default))


def authority(c: Column | str) -> Column:
    """Lower-cased host part, with port and user info; '' where the text has none."""
    return F.lower(F.regexp_extract(_col(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def host_matches(c: Column | str, domain: str) -> Column:
    host = authority(c)
    return (host == domain) | host.endswith("." + domain)


def url_without_query(c: Column | str) -> Column:
    return F.substring_index(_col(c), "?", 1)


def derived_cache_url(base: str, record: Column | str, url: Column | str, size: str = "x") -> Column:
    """Address of a cached copy; its last segment is the md5 of the original address."""
    return F.concat(
        F.lit(f"{base}/image/cache/{size}/occurrence/"), _col(record).cast("string"), F.lit("/media/"), F.md5(_col(url))
    )


def variant_urls(c: Column | str, pattern: str = fixed.SIZE_SUFFIX, sizes: list[str] | None = None) -> Column:
    """Ordered array of size variants; an address of another shape stands for itself."""
    c = _col(c)
    stem = F.regexp_replace(c, pattern, "")
    variants = F.array(*[F.concat(stem, F.lit(f"_{s}.jpg")) for s in (sizes or fixed.SIZES)])
    return F.when(c.rlike(pattern), variants).otherwise(F.array(c))
