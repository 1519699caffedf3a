"""Group-by reports. Counts and sums combine before the shuffle; exact medians use
``exact_quantiles``; no list of rows is ever collected per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..core.scale import exact_quantiles, group_medians_wide, join_small
from ..functions.values import fixed_text, recode


def facet_counts(df: DataFrame, key: str, names: DataFrame | None = None, n: str = "n") -> DataFrame:
    """Rows per key, with names looked up from a table that shares the key column."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n))
    return out.join(names, key, "left") if names is not None else out


def at_least(counts: DataFrame, n: str, thresholds: list[int]) -> DataFrame:
    """How many keys have at least each threshold."""
    return counts.agg(*[F.count_if(F.col(n) >= k).alias(f"ge_{k}") for k in thresholds])


def recode_counts(df: DataFrame, column: str, mapping: dict[str, str], id_col: str) -> DataFrame:
    """Rows and distinct ids changed by each entry of a rename."""
    hit = df.filter(F.col(column).isin(list(mapping)))
    return hit.groupBy(F.col(column).alias("original")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(id_col).alias("n_keys")
    ).withColumn("recoded", recode("original", mapping))


def joined_set(c: str, sep: str = ";") -> Column:
    """Sorted, joined set of a bounded text column."""
    return F.array_join(F.sort_array(F.collect_set(c)), sep)


def group_profile(df: DataFrame, group: str, name: str, named: Column, place: str, coord: str, measure: str, year: str) -> DataFrame:
    """Per class: rows, distinct named values, unnamed rows, places, coverage, range and median of a
    measure, and year range. Extremes and median are rounded half to even."""
    base = df.filter(F.col(group).isNotNull())
    out = base.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.when(named, F.col(name))).alias("n_named"),
        F.count_if(F.col(name).isNull()).alias("n_unnamed"),
        F.countDistinct(place).alias("n_places"),
        joined_set(place).alias("places"),
        F.count(coord).alias("n_with_coords"),
        F.bround(F.min(measure), 0).cast("long").alias("measure_min"),
        F.bround(F.max(measure), 0).cast("long").alias("measure_max"),
        F.min(year).cast("long").alias("year_min"),
        F.max(year).cast("long").alias("year_max"),
        F.count_if(F.col(year).isNull()).alias("n_without_year"),
    )
    med = group_medians_wide(base, [group], [measure], "")
    med = med.select(group, F.bround(F.col(measure), 0).cast("long").alias("measure_median"))
    return out.join(med, group, "left")


def top_values(df: DataFrame, group: str, value: str, n: int, alias: str, sep: str = ";") -> DataFrame:
    """Per group its n most frequent values as ``value count`` text, ties by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy(F.desc("_n"), value)
    top = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    entry = F.struct("_r", F.concat_ws(" ", F.col(value), F.col("_n").cast("string")).alias("t"))
    parts = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"])  # at most n entries
    return top.groupBy(group).agg(F.array_join(parts, sep).alias(alias))


def place_profile(df: DataFrame, place: str, cls: str, name: str, named: Column, top: int = 5) -> DataFrame:
    """Per place (null shown as ``(none)``): rows, classes, named values and the top classes."""
    base = df.withColumn(place, F.coalesce(F.col(place), F.lit("(none)")))
    out = base.groupBy(place).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(cls).alias("n_classes"),
        F.countDistinct(F.when(named, F.col(name))).alias("n_named"))
    return out.join(top_values(base, place, cls, top, "top_classes"), place, "left")


def locality_top(df: DataFrame, locality: str, cls: str, place: str, measures: list[str], n: int = 100) -> DataFrame:
    """The n largest localities: rows, classes, places and exact medians of the measures.

    Medians are computed for the chosen localities only.
    """
    base = df.filter(F.col(locality).isNotNull())
    counts = base.groupBy(locality).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(cls).alias("n_classes"), joined_set(place).alias("places"))
    top = counts.orderBy(F.desc("n_rows"), F.desc("n_classes"), locality).limit(n)
    rows = join_small(base, top.select(locality), [locality], "left_semi")
    return top.join(group_medians_wide(rows, [locality], measures), locality, "left")


def coverage_gaps(df: DataFrame, cls: str, place: str, year: str, coord: str) -> DataFrame:
    """Sections of one long table: rows and classes per place, rows per decade, classes found in at
    most one place, classes with rows lacking coordinates."""
    def section(name: str, frame: DataFrame, key: str, value: str) -> DataFrame:
        return frame.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).alias("n"))

    placed = df.filter(F.col(place).isNotNull()).groupBy(place).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(cls).alias("k"))
    decades = df.filter(F.col(year).isNotNull()).groupBy((F.floor(F.col(year) / 10) * 10).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    classes = df.filter(F.col(cls).isNotNull()).groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(place).alias("places"), F.count(coord).alias("with_coords"))
    missing = classes.withColumn("lacking", F.col("n") - F.col("with_coords")).filter("lacking > 0")
    return reduce(DataFrame.unionByName, [
        section("rows_per_place", placed, place, "n"), section("classes_per_place", placed, place, "k"),
        section("rows_per_decade", decades, "d", "n"), section("single_place_classes", classes.filter("places <= 1"), cls, "n"),
        section("without_coords", missing, cls, "lacking")])


def merged_keys_audit(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names that gather more than one source key, with the keys (a bounded set per name)."""
    return (df.filter(F.col(name).isNotNull()).select(name, key).distinct().groupBy(name)
            .agg(F.count(key).alias("n_keys"), F.array_join(F.sort_array(F.collect_list(key)), ";").alias("keys"))
            .filter("n_keys > 1"))


def counts_of_counts(df: DataFrame, record: str) -> DataFrame:
    """How many records have 1, 2, 3 ... items."""
    per = df.groupBy(record).agg(F.count(F.lit(1)).alias("n_items"))
    return per.groupBy("n_items").agg(F.count(F.lit(1)).alias("n_records"))


def count_summary(df: DataFrame, record: str) -> DataFrame:
    """Records, mean and largest number of items per record."""
    hist = counts_of_counts(df, record)
    return hist.agg(
        F.sum("n_records").alias("n_records"),
        (F.sum(F.col("n_items") * F.col("n_records")) / F.sum("n_records")).alias("mean_items"), F.max("n_items").alias("max_items"))


def nested_counts(df: DataFrame, filters: dict[str, Column], guard: int | None = None) -> DataFrame:
    """Rows under successively narrower filters in one pass, and whether the volume guard holds."""
    cols, so_far = [], F.lit(True)
    for name, cond in filters.items():
        so_far = so_far & F.coalesce(cond, F.lit(False))
        cols.append(F.count_if(so_far).alias(name))
    out = df.agg(F.count(F.lit(1)).alias("all_rows"), *cols)
    return out if guard is None else out.withColumn("within_guard", F.col(list(filters)[-1]) <= guard)


def non_null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(f"share_{c}") for c in columns])


def flag_counts(df: DataFrame, flags: str, known: list[str], sep: str = ";") -> DataFrame:
    """Rows per flag of a known list, zero included: one conditional count per flag, no explode."""
    padded = F.concat(F.lit(sep), F.col(flags), F.lit(sep))
    one = df.agg(*[F.count_if(padded.contains(sep + f + sep)).alias(f) for f in known])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in known])))


def candidate_rollup(df: DataFrame, key: str, kind: str, kinds: list[str], accepted: Column, size: str, grown: str, total: str) -> DataFrame:
    """Per item from its candidates: accepted regions and size per kind, rejected size, growth, removed share."""
    a = F.coalesce(accepted, F.lit(False))
    base = df.withColumn("_a", a)
    cols = []
    for k in kinds:
        hit = (F.col(kind) == k) & F.col("_a")
        cols += [F.count_if(hit).alias(f"{k}_regions"), F.coalesce(F.sum(F.when(hit, F.col(size))), F.lit(0.0)).alias(f"{k}_size")]
    out = base.groupBy(key).agg(
        *cols, F.coalesce(F.sum(F.when(~F.col("_a"), F.col(size))), F.lit(0.0)).alias("rejected_size"),
        F.coalesce(F.sum(F.when(F.col("_a"), F.col(grown))), F.lit(0.0)).alias("grown_size"),
        F.coalesce(F.sum(F.when(F.col("_a"), F.col(size))), F.lit(0.0)).alias("_removed"), F.max(total).alias("_total"))
    return out.withColumn("removed_share", F.try_divide(F.col("_removed"), F.col("_total"))).drop("_removed", "_total")


def value_distribution(df: DataFrame, column: str, blank: str = "?", null: str = "(none)", top: int | None = None) -> DataFrame:
    """Counts per value with '' and null shown by name; the ``top`` largest if asked for."""
    shown = F.when(F.col(column).isNull(), null).when(F.col(column) == "", blank).otherwise(F.col(column))
    out = df.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def set_coverage(df: DataFrame, key: str, value: str, first: str, second: str) -> DataFrame:
    """Keys that have ``first``, only ``second``, or neither (two booleans per key, no sets)."""
    per = df.groupBy(key).agg(F.bool_or(F.col(value) == first).alias("a"), F.bool_or(F.col(value) == second).alias("b"))
    label = F.when(F.col("a"), f"has {first}").when(F.col("b"), f"{second} only").otherwise("neither")
    return per.groupBy(label.alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


def category_drop_table(df: DataFrame, cls: str, value: Column, kept: list[str]) -> DataFrame:
    """Class x category (kept, dropped by value, value missing) in long form with the class total."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    category = (F.when(v == "", "dropped: null").when(v.isin(kept), f"kept ({'/'.join(kept)})")
                .otherwise(F.concat(F.lit("dropped: "), v)))
    counts = df.filter(F.col(cls).isNotNull()).groupBy(cls, category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(cls)))  # a window over counts


def split_pivot(df: DataFrame, cls: str, split: str, splits: list[str]) -> DataFrame:
    """Class x split counts, absent cells 0, with the total."""
    out = df.groupBy(cls).agg(*[F.count_if(F.col(split) == s).alias(s) for s in splits])
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(s) for s in splits]))


def crosstab_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    """Two-way counts in long form: cell, row total, column total and the rank of the column."""
    cells = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(row).agg(F.sum("n").alias("row_total"))
    cols = cells.groupBy(col).agg(F.sum("n").alias("col_total"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("col_total"), col))  # one row per level
    return cells.join(rows, row).join(cols.withColumn("col_rank", rank), col)


def crosstab_rowpct(df: DataFrame, row: str, col: str) -> DataFrame:
    c = crosstab_counts(df, row, col)
    return c.select(row, col, F.col("row_total").alias("n"), F.bround(F.col("n") * 100.0 / F.col("row_total"), 1).alias("pct"))


def dominant_value(df: DataFrame, cls: str, value: str, share: float = fixed.DOMINANT_SHARE) -> DataFrame:
    """Classes whose most frequent value reaches ``share`` of their rows (percentages with one decimal)."""
    pct = crosstab_rowpct(df, cls, value)
    w = Window.partitionBy(cls).orderBy(F.desc("pct"), value)
    top = pct.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return top.filter(F.col("pct") >= share * 100).select(cls, "n", F.col(value).alias("top_value"), F.col("pct").alias("top_share_pct"))


def flag_fraction(df: DataFrame, cls: str, flag: Column, levels: dict[str, Column]) -> DataFrame:
    """Rows, flagged rows and share per class, with counts per level."""
    out = df.filter(F.col(cls).isNotNull()).groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flag"), *[F.count_if(c).alias(k) for k, c in levels.items()])
    return out.withColumn("flag_frac", F.bround(F.col("n_flag") / F.col("n"), 3))


def group_medians(df: DataFrame, cls: str, measures: list[str], places: int = 4) -> DataFrame:
    n = df.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    med = group_medians_wide(df, [cls], measures)
    return n.join(med, cls, "left").select(cls, "n", *[F.bround(f"{m}_median", places).alias(f"{m}_median") for m in measures])


def funnel(df: DataFrame, stages: dict[str, Column], record: str, item: str) -> DataFrame:
    """Rows, records and ids left after each stage, with the share of the first stage.

    Stages are nested, so a row is described by the number of stages it passes, and a record or item by the largest
    number of its rows: one grouped pass each, whose partial maxima combine before the shuffle.
    """
    passed, so_far = F.lit(0), F.lit(True)
    for cond in stages.values():
        so_far = so_far & F.coalesce(cond, F.lit(False))
        passed = passed + so_far.cast("int")
    base = df.select(record, item, passed.alias("_passed"))

    def reached(kind: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy("_passed").agg(F.count(F.lit(1)).alias("_n")).withColumn("_kind", F.lit(kind))

    furthest = {kind: base.filter(F.col(c).isNotNull()).groupBy(c).agg(F.max("_passed").alias("_passed")) for kind, c in (("record", record), ("item", item))}
    counts = reached("row", base).unionByName(reached("record", furthest["record"])).unionByName(reached("item", furthest["item"]))
    left = lambda kind, i: F.coalesce(F.sum(F.when((F.col("_kind") == kind) & (F.col("_passed") > i), F.col("_n"))), F.lit(0))
    lines = F.array(*[F.struct(
        F.lit(i).alias("step"), F.lit(name).alias("stage"), left("row", i).alias("n_rows"), left("record", i).alias("n_records"), left("item", i).alias("n_items"))
        for i, name in enumerate(stages)])
    first = F.coalesce(F.sum(F.when((F.col("_kind") == "row") & (F.col("_passed") > 0), F.col("_n"))), F.lit(0)).alias("_first")
    out = counts.agg(lines.alias("_lines"), first).select("_first", F.inline("_lines"))
    return out.select("step", "stage", "n_rows", "n_records", "n_items", F.try_divide(F.col("n_rows").cast("double"), F.col("_first").cast("double")).alias("share"))


def dropped_classes(df: DataFrame, cls: str, kept: Column, item: str, target: int) -> DataFrame:
    """Classes below the target with what was obtained."""
    got = df.filter(F.col(cls).isNotNull()).groupBy(cls).agg(
        F.countDistinct(F.when(kept, F.col(item))).alias("obtained"), F.countDistinct(item).alias("targeted"))
    return got.filter(F.col("obtained") < target)


def failure_rates(df: DataFrame, by: Column, failed: Column, only_failed: bool = False) -> DataFrame:
    out = df.groupBy(by.alias("key")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(failed).alias("n_failed"))
    out = out.withColumn("rate", F.col("n_failed") / F.col("n_rows"))
    return out.filter("n_failed > 0") if only_failed else out


def kept_reliability(scores: DataFrame, n: str = "n_test", f1: str = "f1") -> DataFrame:
    """Reliability label per class: enough tests and a high enough score, else the reason."""
    # two decimals can only tie at eighths, which are shown rounded up
    eighth = F.col(f1) * 8 == F.floor(F.col(f1) * 8)
    shown = fixed_text(F.when(eighth, F.round(f1, 2)).otherwise(F.col(f1)), 2)
    label = (F.when(F.col(n) < fixed.RELIABLE_MIN_TESTS, F.format_string("low (%d tests)", F.col(n)))
             .when(F.col(f1) < fixed.RELIABLE_MIN_F1, F.concat(F.lit("low (F1 "), shown, F.lit(")"))).otherwise("high"))
    return scores.withColumn("reliability", label).withColumn("is_low", F.col("reliability") != "high")


def error_pairs(df: DataFrame, true: str, pred: str, top: int) -> DataFrame:
    wrong = df.filter(F.col(true) != F.col(pred))
    return wrong.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), true, pred).limit(top)


def errors_to(df: DataFrame, true: str, pred: str, n: int = 3) -> DataFrame:
    """Per class its most frequent wrong predictions as text."""
    return top_values(df.filter(F.col(true) != F.col(pred)), true, pred, n, "errors_to", "; ")


def quantile_profile(df: DataFrame, group: str, value: str, probs: list[float], below: list[float]) -> DataFrame:
    """Listed quantiles per group (long form), with mean, extremes and counts under thresholds."""
    q = exact_quantiles(df, [group], [value], probs).select(group, "prob", "value")
    s = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        *[F.count_if(F.col(value) < b).alias(f"below_{str(b).replace('.', '_')}") for b in below])
    return q.join(s, group)
