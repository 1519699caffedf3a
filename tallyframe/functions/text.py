"""Column functions on text. Every function takes and returns columns and stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def none_if_no_match(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, null where there is none (``regexp_extract`` gives '')."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def strip_suffix_code(c: Column | str, pattern: str = fixed.SUFFIX_CODE) -> Column:
    """Item code without its per-view suffix."""
    return F.regexp_replace(strip(c), f"(?i){pattern}", "")


def safe_file_token(c: Column | str) -> Column:
    """Characters outside ``[A-Za-z0-9_-]`` become ``_``; runs collapse."""
    return F.regexp_replace(F.regexp_replace(_col(c), "[^A-Za-z0-9_-]", "_"), "_+", "_")


def path_template(root: str, group: Column | str, token: Column | str, view: Column | str, ext: str = ".jpg") -> Column:
    return F.concat(F.lit(root + "/"), _col(group), F.lit("/"), safe_file_token(token), F.lit("_"), _col(view), F.lit(ext))


def title_parse(c: Column | str) -> Column:
    """Struct (code, view, shot) of a free-text title; null where no code is found."""
    raw = F.lower(F.regexp_replace(_col(c), r"^File:", ""))
    title = F.regexp_replace(raw, r"\.jpe?g$", "")
    code_pattern, view_pattern = f"(?Ui){fixed.TITLE_CODE}", f"(?U){fixed.TITLE_VIEW}"
    words = F.create_map(*[F.lit(x) for pair in fixed.VIEW_LETTER.items() for x in pair])
    view = none_if_no_match(title, view_pattern, 1)
    shot = F.coalesce(F.regexp_extract(title, view_pattern, 2).try_cast("int"), F.lit(1))
    return F.when(
        title.rlike(code_pattern),
        F.struct(
            F.regexp_extract(title, code_pattern, 1).alias("code"),
            F.when(view.isNotNull(), words[view]).alias("view"),
            F.when(view.isNotNull(), shot).otherwise(F.lit(1)).alias("shot"),
        ),
    )


def year_range_parse(c: Column | str) -> Column:
    """Struct (start, end): ``YYYY-YYYY``, else a single year twice, else nulls."""
    c = _col(c)
    pair = c.rlike(fixed.YEAR_RANGE)
    single = none_if_no_match(c, fixed.YEAR_SINGLE)
    return F.struct(
        F.when(pair, F.regexp_extract(c, fixed.YEAR_RANGE, 1)).otherwise(single).try_cast("int").alias("start"),
        F.when(pair, F.regexp_extract(c, fixed.YEAR_RANGE, 2)).otherwise(single).try_cast("int").alias("end"),
    )


def year_prefix(c: Column | str) -> Column:
    """First four characters as a number; null where they are none."""
    return F.substring(_col(c).cast("string"), 1, 4).try_cast("int")


def decade(year: Column | str) -> Column:
    return (F.floor(_col(year) / 10) * 10).cast("int")


def normalise_label(c: Column | str) -> Column:
    return F.lower(strip(F.coalesce(_col(c), F.lit(""))))


def list_successor(c: Column | str, marker: str, sep: str = ";") -> Column:
    """Element after ``marker`` in a separated list, '' if the marker is absent or last."""
    parts = F.split(_col(c), f"\\Q{sep}\\E")
    at = F.array_position(parts, marker)
    return F.when(at > 0, F.coalesce(F.try_element_at(parts, (at + 1).cast("int")), F.lit(""))).otherwise(F.lit(""))


def blank_to_null(c: Column | str, numeric: bool = False) -> Column:
    c = _col(c)
    if numeric:
        return F.when(~F.isnan(c), c)
    return F.when(F.length(strip(c)) > 0, c)


def prompt_template(template: str, c: Column | str, slot: str = "{x}") -> Column:
    return F.replace(F.lit(template), F.lit(slot), _col(c))


def strip_leading_term(c: Column | str, term: Column | str) -> Column:
    """Drop a leading word held in another column, with the white space after it."""
    c, term = _col(c), _col(term)
    rest = F.substring(c, F.length(term) + 1, F.length(c))
    return F.when(c.startswith(term) & rest.rlike(r"(?U)^\s"), F.regexp_replace(rest, r"(?U)^\s+", "")).otherwise(c)


def marker_screen(c: Column | str, markers: list[str] | None = None, head: int | None = None) -> Column:
    """True if any marker occurs; with ``head``, only in so many bytes (the tail of a cut character is ignored)."""
    page = F.encode(_col(c), "UTF-8")
    page = (page if head is None else F.substring(page, 1, head)).cast("binary")
    hit = F.lit(False)
    for m in markers or fixed.CHALLENGE_MARKERS:
        hit = hit | page.contains(F.lit(m.encode()))
    return hit


def flag_list(flags: dict[str, Column], sep: str = ";") -> Column:
    """Names of the true conditions in the order given, joined; '' if there are none."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for name, cond in flags.items()])


def add_flag(flags: Column | str, name: str, cond: Column, sep: str = ";") -> Column:
    """Append one more flag to an already joined list."""
    base = F.when(F.length(_col(flags)) > 0, _col(flags))
    return F.concat_ws(sep, base, F.when(cond, F.lit(name)))


def source_class(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """Ordered rules: the first true condition names the class."""
    out = None
    for cond, name in rules:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(otherwise))
