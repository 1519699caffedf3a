"""Bands, interval estimates, association measures and their nulls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.scale import exact_quantiles, join_small
from ..core.session import materialise


def quantile_bands(df: DataFrame, value: str, bands: int = 4, label: str = "band") -> DataFrame:
    """Add a labelled band by interpolated quantile edges, right-closed, lowest value included.

    Labels read ``B1 900-925`` with edges rounded half to even. The edges are one row.
    """
    probs = [i / bands for i in range(bands + 1)]
    q = exact_quantiles(df, [], [value], probs)
    edges = q.agg(F.transform(F.sort_array(F.collect_list(F.struct("prob", "value"))), lambda s: s["value"]).alias("_e"))
    out = df.withColumn("_e", edges.scalar())
    v, e = F.col(value), F.col("_e")
    name = None
    for i in range(bands):
        text = F.concat(F.lit(f"B{i + 1} "), F.bround(e[i], 0).cast("long").cast("string"), F.lit("-"),
                        F.bround(e[i + 1], 0).cast("long").cast("string"))
        name = F.when(v <= e[i + 1], text) if name is None else name.when(v <= e[i + 1], text)
    return out.withColumn(label, name).drop("_e")


def fixed_bands(value: Column | str, edges: list[float]) -> Column:
    """Left-closed bands ``[lo, hi)`` by fixed edges; null outside."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.when(v < edges[0], F.lit(None))
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(v < hi, F.lit(f"[{lo}, {hi})"))
    return out


def three_way_band(value: Column | str, lo: float, hi: float, names: tuple[str, str, str]) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v < lo, names[0]).when(v < hi, names[1]).otherwise(names[2])


def wilson_interval(k: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson bounds of a share; null for no trials."""
    k, n = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (k, n))
    n = F.when(n > 0, n)
    p, z2 = k / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half


def condition_accuracy(df: DataFrame, groups: dict[str, Column], ok: Column) -> DataFrame:
    """n, correct, rate and Wilson bounds of overlapping named row groups.

    Every row names the groups it belongs to; the counts combine before the shuffle. A group
    without rows is listed with n = 0.
    """
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()]))
    hit = df.select(F.explode(names).alias("group"), ok.cast("long").alias("_ok"))
    counts = hit.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("correct"))
    listed = df.sparkSession.createDataFrame([(g,) for g in groups], "group string")
    counts = F.broadcast(listed).join(counts, "group", "left").na.fill(0, ["n", "correct"])
    lo, hi = wilson_interval("correct", "n")
    return counts.select("group", "n", "correct", F.try_divide(F.col("correct").cast("double"), F.col("n").cast("double")).alias("rate"), lo.alias("ci_low"), hi.alias("ci_high"))


def _melt(df: DataFrame, columns: list[str], cls: str, kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.filter(F.col(cls).isNotNull()).select(F.col(cls).alias("cls"), F.explode(pairs).alias("p")).select("cls", "p.variable", "p.value")


def cramers_table(df: DataFrame, columns: list[str], cls: str) -> DataFrame:
    """Raw and bias-corrected association of each categorical column with the class.

    One pass counts (variable, level, class) cells for all columns; chi square is a sum over the
    observed cells, since n * (sum n_ij^2 / (r_i c_j) - 1) needs no empty ones.
    """
    cells = _melt(df, columns, cls, "string").filter("value is not null").groupBy("variable", "value", "cls").agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("variable", "value").agg(F.sum("o").alias("ri"))
    cols = cells.groupBy("variable", "cls").agg(F.sum("o").alias("cj"))
    s = cells.join(rows, ["variable", "value"]).join(cols, ["variable", "cls"]).groupBy("variable").agg(
        F.sum("o").cast("double").alias("n"), F.sum(F.col("o") / F.col("ri") * F.col("o") / F.col("cj")).alias("q"),
        F.countDistinct("value").alias("r"), F.countDistinct("cls").alias("k"))
    association = F.greatest(F.col("q") - 1, F.lit(0.0))
    free = [F.col(levels).cast("double") - 1 for levels in ("r", "k")]  # degrees of freedom of the two sides
    # Bergsma (2013): independent columns have an association of free_1 * free_2 / (n - 1) on average, and each side
    # loses the share free / (n - 1) of its degrees of freedom
    share = [F.try_divide(f, F.col("n") - 1) for f in free]
    excess = F.greatest(F.lit(0.0), association - free[0] * share[1])
    left = F.least(*[f * (1 - lost) for f, lost in zip(free, share)])
    return s.select(
        "variable", F.col("n").cast("long").alias("n"), F.col("r").alias("levels"),
        F.sqrt(association / F.greatest(F.lit(1.0), F.least(*free))).alias("raw_value"),
        F.sqrt(excess / F.greatest(F.lit(1e-12), left)).alias("value"))


def eta_table(df: DataFrame, columns: list[str], cls: str) -> DataFrame:
    """Between / total sum of squares of each numeric column, with the F statistic.

    Group counts, means and variances in one grouped pass over all columns; the sums of squares
    come from those group rows.
    """
    long = _melt(df, columns, cls, "double").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    g = long.groupBy("variable", "cls").agg(
        F.count(F.lit(1)).alias("n_g"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    grand = g.groupBy("variable").agg((F.sum(F.col("n_g") * F.col("m")) / F.sum("n_g")).alias("mm"))
    s = g.join(grand, "variable").groupBy("variable").agg(
        F.sum("n_g").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n_g") * (F.col("m") - F.col("mm")) * (F.col("m") - F.col("mm"))).alias("ssb"),
        F.sum(F.col("n_g") * F.col("v")).alias("ssw"))
    total = F.col("ssb") + F.col("ssw")
    f = F.try_divide(F.col("ssb") / (F.col("groups") - 1), F.col("ssw") / (F.col("n") - F.col("groups")))
    return s.select("variable", "n", "groups", F.when(total > 0, F.col("ssb") / total).alias("value"), f.alias("f_stat"), "ssb", "ssw")


def _beta_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) of an F distribution: regularised incomplete beta by its continued fraction."""
    from math import exp, lgamma, log

    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    if x <= 0:
        return 1.0 if flip else 0.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    total = 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / (c if abs(c) > tiny else tiny)
        total *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    value = front * (total - 1)
    return 1 - value if flip else value


def with_f_pvalue(eta: DataFrame) -> DataFrame:
    """Add ``anova_p``: one tail probability per variable, from the aggregated F statistic."""
    @F.pandas_udf("double")
    def tail(f: pd.Series, groups: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.nan if pd.isna(x) else _beta_tail(x, g - 1, m - g) for x, g, m in zip(f, groups, n)])

    return eta.withColumn("anova_p", tail("f_stat", "groups", "n"))


def association_scan(df: DataFrame, categorical: list[str], numeric: list[str], cls: str) -> DataFrame:
    """All variables against the class on one scale (V, or the root of eta squared), best first."""
    c = cramers_table(df, categorical, cls).select(
        "variable", F.lit("categorical").alias("type"), "n", "value", "raw_value", F.col("levels"))
    e = eta_table(df, numeric, cls).select(
        "variable", F.lit("numeric").alias("type"), "n", "value", F.lit(None).cast("double").alias("raw_value"), F.lit(None).cast("long").alias("levels"))
    both = c.unionByName(e)
    effect = F.when(F.col("type") == "numeric", F.sqrt("value")).otherwise(F.col("value"))
    return both.withColumn("effect", effect).orderBy(F.desc("effect"), "variable")


def _end_zones(bounds: list[int], sigmas: float) -> np.ndarray:
    """Edges of the hash intervals that should hold the ends of all classes but the last: segment 2 i + 1 of the result is zone i."""
    n, zones = (bounds[-1] if bounds else 0), []
    for b in bounds[:-1]:
        wide = sigmas * (b * (1 - b / n)) ** 0.5
        lo, hi = (min(2**64 - 1, max(0, int(x / n * 2**64))) for x in (b - wide, b + wide))
        if zones and lo <= zones[-1][1]:
            zones[-1][1] = hi
        else:
            zones.append([lo, hi])
    return np.array([x for z in zones for x in z], dtype=np.uint64)


def _shuffled_segments(base: DataFrame, replicates: int, seed: int, edges: np.ndarray, rows_of: np.ndarray) -> DataFrame:
    """Counts and sums of the rows' hashes per replicate and segment (``h`` null), and single rows where ``rows_of[replicate, segment]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, segments = ["replicate", "segment", "n", "s", "h"], len(edges) + 1
        count, total = np.zeros((replicates + 1, segments), np.int64), np.zeros((replicates + 1, segments))
        for batch in batches:
            tails = [t.encode() for t in batch.column("_t").to_pylist()]
            v = batch.column("_v").to_numpy(zero_copy_only=False)
            out = []
            for rep in range(1, replicates + 1):
                head = f"{seed}|{rep}".encode()
                raw = np.frombuffer(b"".join([md5(head + t).digest() for t in tails]), dtype="S16")
                segment = np.searchsorted(edges, raw.view(">u8")[::2].astype(np.uint64), side="right")
                count[rep] += np.bincount(segment, minlength=segments)
                total[rep] += np.bincount(segment, v, minlength=segments)
                at = np.flatnonzero(rows_of[rep][segment])
                out.append((np.full(len(at), rep, np.int32), segment[at].astype(np.int32), v[at], raw[at].view(np.uint8)))
            if out and sum(len(o[0]) for o in out):
                rep, segment, s, raw = (np.concatenate(c) for c in zip(*out))
                h = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rep), [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(segment), pa.array(np.ones(len(rep), np.int64)), pa.array(s), h], names=names)
        rep, segment = np.nonzero(count)
        columns = [pa.array(rep.astype(np.int32)), pa.array(segment.astype(np.int32)), pa.array(count[rep, segment]), pa.array(total[rep, segment])]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rep), pa.binary())], names=names)

    return materialise(base.select("_t", "_v").mapInArrow(run, "replicate int, segment int, n long, s double, h binary"))


def permuted_eta(df: DataFrame, value: str, cls: str, id_col: str, replicates: int, seed: int, sigmas: float = 5.0) -> DataFrame:
    """eta squared of ``value`` under ``replicates`` label shuffles: (replicate, statistic).

    A shuffle is a hash order of the rows: the first n_1 rows get class 1, the next n_2 class 2 and so on. Hashes are even, so the
    place where a class ends is known within ``sigmas`` deviations; a task adds up the rows between these zones, and only the rows
    inside (some root of all rows) are ranked. Ends that lie elsewhere, as with repeated ids, are found by another pass over their segments.
    """
    kept = df.filter(F.col(cls).isNotNull() & F.col(value).isNotNull())
    text = F.coalesce(F.concat(F.lit("|"), F.col(id_col).cast("string")), F.lit(""))
    base = kept.select(text.alias("_t"), F.col(cls).alias("_c"), F.col(value).cast("double").alias("_v"))
    base = materialise(base.repartition(df.sparkSession.sparkContext.defaultParallelism))  # few rows become many: all tasks take part
    mean, total = base.agg(F.avg("_v"), F.var_pop("_v") * F.count(F.lit(1))).first()
    upto = Window.partitionBy(F.lit(1)).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)  # one row per class
    bounds = base.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).select(F.sum("_n").over(upto).alias("_to")).agg(F.sort_array(F.collect_list("_to")))
    edges = _end_zones(bounds.first()[0], sigmas)
    zones = np.zeros((replicates + 1, len(edges) + 1), bool)
    zones[:, 1::2] = True
    base = base.withColumn("_v", F.col("_v") - F.lit(mean))
    found = _shuffled_segments(base, replicates, seed, edges, zones)
    before = Window.partitionBy("replicate").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    pieces = found.filter("h is null").groupBy("replicate", "segment").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_bounds", bounds.scalar())
    at = lambda rank: F.size(F.filter("_bounds", lambda b: b < rank))  # noqa: E731 - the class that holds a rank
    pieces = materialise(pieces.select("replicate", "segment", "_n", "_s", "_before", at(F.col("_before") + 1).alias("_k"), at(F.col("_before") + F.col("_n")).alias("_last")))
    cut = pieces.filter("_k <> _last").select("replicate", "segment", "_before")
    rows = found.filter("h is not null")
    missed = cut.filter("segment % 2 = 0").select("replicate", "segment").collect()  # an end outside its zone
    if missed:
        again = np.zeros_like(zones)
        again[[r["replicate"] for r in missed], [r["segment"] for r in missed]] = True
        rows = rows.unionByName(_shuffled_segments(base, replicates, seed, edges, again).filter("h is not null"))
    order = Window.partitionBy("replicate", "segment").orderBy("h", "s")
    cut = join_small(rows, cut, ["replicate", "segment"]).withColumn("_rank", F.col("_before") + F.row_number().over(order)).withColumn("_bounds", bounds.scalar())
    ends = cut.select("replicate", at(F.col("_rank")).alias("_k"), F.col("n").alias("_n"), F.col("s").alias("_s"))
    cells = pieces.filter("_k = _last").select("replicate", "_k", "_n", "_s").unionByName(ends).groupBy("replicate", "_k").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    return cells.groupBy("replicate").agg((F.sum(F.col("_s") * F.col("_s") / F.col("_n")) / F.lit(total)).alias("statistic"))


def permuted_cramers(df: DataFrame, column: str, cls: str, replicates: int, seed: int) -> DataFrame:
    """Bias-corrected V under label shuffles, drawn from the margins: (replicate, statistic).

    A shuffle of labels changes nothing but the table of counts, whose law given its margins is
    multivariate hypergeometric. So the tables are drawn directly, in tasks, from the two margins:
    the cost does not depend on the number of rows.
    """
    base = df.filter(F.col(cls).isNotNull() & F.col(column).isNotNull())
    r = base.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list("n")).alias("rows"))
    c = base.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list("n")).alias("cols"))
    margins = r.withColumn("cols", c.scalar())
    jobs = margins.select("rows", "cols", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).repartition(
        min(replicates, 64), "replicate")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rows, cols, rep in zip(pdf["rows"], pdf["cols"], pdf["replicate"]):
                rng = np.random.default_rng([seed, int(rep)])
                rows, left = np.asarray(rows, dtype=np.int64), np.asarray(cols, dtype=np.int64).copy()
                n, q = float(rows.sum()), 0.0
                weights = 1.0 / left
                for size in rows:
                    line = rng.multivariate_hypergeometric(left, size, method="marginals")
                    left -= line
                    q += float((line.astype(float) ** 2 * weights).sum()) / size
                k, m = float(len(rows)), float(len(cols))
                phi = max(0.0, max(q - 1, 0.0) - (k - 1) * (m - 1) / (n - 1))
                shrunk = min(k - (k - 1) ** 2 / (n - 1), m - (m - 1) ** 2 / (n - 1))
                out.append((int(rep), float(np.sqrt(phi / max(1e-12, shrunk - 1)))))
            yield pd.DataFrame(out, columns=["replicate", "statistic"])

    return jobs.mapInPandas(draw, "replicate int, statistic double")


def permutation_summary(null: DataFrame, observed: DataFrame) -> DataFrame:
    """Null mean, 99th percentile and p = (1 + #{null >= observed}) / (N + 1). ``observed`` is one
    row with ``value``; ``null`` has one row per replicate."""
    both = null.withColumn("value", observed.select("value").scalar())
    return both.agg(
        F.max("value").alias("value"), F.avg("statistic").alias("null_mean"), F.percentile("statistic", 0.99).alias("null_p99"),
        ((1 + F.count_if(F.col("statistic") >= F.col("value"))) / (F.count(F.lit(1)) + 1)).alias("perm_p"),
        F.count(F.lit(1)).alias("replicates"))


def bootstrap_ci(df: DataFrame, true: str, pred: str, replicates: int, seed: int, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Percentile intervals of accuracy and macro-F1, per combination of ``by``.

    Resampling n rows with replacement and counting (true, predicted) cells is a multinomial draw
    of the cells, so replicates are drawn from the cell counts: the cost does not grow with the
    rows. Classes absent from a replicate are left out of its macro-F1.
    """
    by = by or []
    cells = df.groupBy(*by, F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    table = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "p", "n"))).alias("cells"))  # at most K * K entries
    chunk = 50
    jobs = table.select(*by, "cells", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // chunk))).alias("part")).repartition(64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, job in pdf.iterrows():
                entries = job["cells"]
                labels = sorted({e["t"] for e in entries} | {e["p"] for e in entries})
                place = {v: i for i, v in enumerate(labels)}
                ti, pi = np.array([place[e["t"]] for e in entries]), np.array([place[e["p"]] for e in entries])
                counts = np.array([e["n"] for e in entries], dtype=float)
                total, size = int(counts.sum()), min(chunk, replicates - job["part"] * chunk)
                rng = np.random.default_rng([seed, int(job["part"])])
                draws = rng.multinomial(total, counts / total, size=size).astype(float)
                hit = draws * (ti == pi)
                onto = lambda idx, x: x @ np.eye(len(labels))[idx]
                support = onto(ti, draws) + onto(pi, draws)
                with np.errstate(invalid="ignore", divide="ignore"):
                    f1 = np.nanmean(np.where(support > 0, 2 * onto(ti, hit) / support, np.nan), axis=1)
                out = pd.DataFrame({"accuracy": hit.sum(axis=1) / total, "macro_f1": f1})
                for c in by:
                    out[c] = job[c]
                yield out[[*by, "accuracy", "macro_f1"]]

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "accuracy double, macro_f1 double"])
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    point = jobs.mapInPandas(draw, schema)
    return point.groupBy(*by).agg(
        F.percentile("accuracy", lo).alias("accuracy_lo"), F.percentile("accuracy", hi).alias("accuracy_hi"),
        F.percentile("macro_f1", lo).alias("macro_f1_lo"), F.percentile("macro_f1", hi).alias("macro_f1_hi"))


def chance_levels(df: DataFrame, cls: str) -> DataFrame:
    """Majority guess (accuracy, macro-F1) and guessing by class shares (accuracy, macro-F1)."""
    c = df.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    s = c.agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    p = F.col("top") / F.col("n")
    return s.select(p.alias("majority_accuracy"), (2 * p / (1 + p) / F.col("k")).alias("majority_macro_f1"),
                    (F.col("sq") / F.col("n") / F.col("n")).alias("random_accuracy"), (1 / F.col("k")).alias("random_macro_f1"))


def simulated_chance(df: DataFrame, cls: str, replicates: int, seed: int) -> DataFrame:
    """Mean and 99th percentile of accuracy and macro-F1 when labels are guessed by class shares.

    Given the class counts the guesses of a class are one multinomial draw, so a replicate costs
    K draws whatever the number of rows.
    """
    counts = df.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list("n")).alias("n"))
    jobs = counts.select("n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).repartition(min(replicates, 64), "replicate")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, rep in zip(pdf["n"], pdf["replicate"]):
                n = np.asarray(n, dtype=np.int64)
                rng = np.random.default_rng([seed, int(rep)])
                table = rng.multinomial(n, n / n.sum())
                hit = np.diag(table).astype(float)
                out.append((hit.sum() / n.sum(), float((2 * hit / (n + table.sum(axis=0))).mean())))
            yield pd.DataFrame(out, columns=["accuracy", "macro_f1"])

    sims = jobs.mapInPandas(draw, "accuracy double, macro_f1 double")
    return sims.agg(*[f for m in ("accuracy", "macro_f1") for f in (
        F.avg(m).alias(f"sim_{m}_mean"), F.percentile(m, 0.99).alias(f"sim_{m}_p99"))])


def bbox_extent(df: DataFrame, group: list[str], lat: str, lon: str, pad: float) -> DataFrame:
    """Extremes of the coordinates widened on every side by a share of their range."""
    def side(c: str) -> list[Column]:
        lo, hi = F.min(c), F.max(c)
        return [(lo - pad * (hi - lo)).alias(f"{c}_min"), (hi + pad * (hi - lo)).alias(f"{c}_max")]

    return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*group).agg(*side(lat), *side(lon))


def set_overlap(a: DataFrame, b: DataFrame, key: str, cell: str, frame_size: Column | None = None) -> DataFrame:
    """Per key: size in each run, intersection over union (1 if both are empty), changed share, identical.

    Cells of both runs are tagged, stacked and grouped, which combines before the shuffle. A key
    with null cells only stands for an empty set.
    """
    tagged = a.select(key, cell, F.lit(1).alias("_s")).unionByName(b.select(key, cell, F.lit(2).alias("_s")))
    per = tagged.groupBy(key, cell).agg(F.max(F.when(F.col("_s") == 1, 1)).alias("_a"), F.max(F.when(F.col("_s") == 2, 1)).alias("_b"))
    real = F.col(cell).isNotNull()
    sums = per.groupBy(key).agg(
        F.count_if(real & F.col("_a").isNotNull()).alias("size_1"), F.count_if(real & F.col("_b").isNotNull()).alias("size_2"),
        F.count_if(real & F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_i"), F.count_if(real).alias("_u"))
    differs = F.col("_u") - F.col("_i")
    iou = F.when(F.col("_u") == 0, F.lit(1.0)).otherwise(F.col("_i") / F.col("_u"))
    share = differs / (frame_size if frame_size is not None else F.greatest(F.col("_u"), F.lit(1)))
    return sums.select(key, "size_1", "size_2", iou.alias("iou"), share.alias("changed_share"), (differs == 0).alias("identical"))
