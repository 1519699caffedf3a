"""Statistics of whole texts as Spark column expressions (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"  # all but the symbols that the contract counts
#: A 3-word window's hash fills the high bits and its position the low 30, so that one sort of plain longs brings
#: equal windows together. Neighbours with equal high bits are candidates; their words are then compared in full.
LOW = 30


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of ``text`` (null: empty).

    Also leaves ``_t`` (the text) and ``_w`` (its words) for further expressions; drop them before a shuffle.
    ``n_lines`` counts the lines with a word. Everything is computed in one pass, row by row, with arrays that
    are linear in the text; windows are sorted within a text, never across texts.
    """
    d = docs.select(*keep, text_or_empty().alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", SPLIT), "")).withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_k", F.expr(
        f"CASE WHEN n_words < 3 THEN array() ELSE sort_array(transform(sequence(0, cast(n_words AS int) - 3),"
        f" i -> shiftleft(shiftright(xxhash64(_w[i], _w[i + 1], _w[i + 2]), {LOW}), {LOW}) + i)) END"))
    d = d.withColumn("_c", F.expr(
        f"transform(filter(_k, (x, i) -> shiftright(x, {LOW}) <=> shiftright(get(_k, i - 1), {LOW})"
        f" OR shiftright(x, {LOW}) <=> shiftright(get(_k, i + 1), {LOW})), x -> cast(x & {(1 << LOW) - 1} AS int))"))
    d = d.withColumn("_g", F.expr("sort_array(transform(_c, p -> struct(concat(_w[p], ' ', _w[p + 1], ' ', _w[p + 2]) AS g, p AS p)))"))
    d = d.withColumn("_p", F.expr("transform(filter(_g, (x, i) -> x.g <=> get(_g, i - 1).g OR x.g <=> get(_g, i + 1).g), x -> x.p)"))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines)
    return d.select(
        *keep, "_t", "_w", "n_words",
        F.length(F.regexp_replace("_t", SPLIT, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(p, p + 1, p + 2))))).cast("long").alias("n_repeat_words"))


RATIOS = ["symbol_share", "dup_line_share", "repeat_share", "mean_word", "upper_share", "shout_share", "bar_share",
          "digit_share", "distinct_share", "mean_line", "log_words"]


def ratios(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The base counts and size-free ratios, all double and never null (0 for a text without words)."""
    d = base_counts(docs, keep).withColumn("_r", F.regexp_replace("_t", r"[\p{Ll}\s.,;]+", ""))  # short: what follows counts in it
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    count = lambda kinds: F.length(F.regexp_replace("_r", f"[^{kinds}]+", ""))
    out = {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
        "upper_share": count(r"\p{Lu}") / chars,
        "shout_share": count("!?") / chars,
        "bar_share": count(r"|_~=+\\/") / chars,
        "digit_share": count("0-9") / chars,
        "distinct_share": F.size(F.array_distinct("_w")) / words,
        "mean_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "log_words": F.log1p(F.col("n_words")),
    }
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return d.select(*keep, *counts, *[c.cast("double").alias(n) for n, c in out.items()])
