"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Each stratum has one sequence of nested rule sets (a cutoff for each statistic), from lenient to strict. A quarter of the
good labelled rows and all bad ones decide the sequence: each statistic's cutoffs are reduced to the concave hull of
(good lost, bad caught), and the steps of all hulls are merged, most bad per good row first. The other good rows are
the holdout. A rule set passes if an exact binomial test on it shows that all its rules together reject at most a
share ``risk`` of the stratum's good documents; the first failure ends the sequence (fixed-sequence testing, so the
steps need no correction), and the level is divided by the number of strata that can pass at all (Bonferroni). With
confidence ``1 - error`` every stratum then loses at most ``risk`` of its good documents. Among the rule sets that
passed, the one that rejects the most bad beyond good rows is used. At 5 % and 5 % a stratum alone needs 59 good
rows in the holdout (79 labelled), one of four strata 86 (115 labelled).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .text_stats import ratios

#: Statistics that speak against a text when large, and the most lenient and strictest cutoff tried.
LADDERS: dict[str, tuple[float, float]] = {
    "symbol_share": (1.0, 0.01), "dup_line_share": (0.95, 0.05), "repeat_share": (0.95, 0.05), "mean_word": (40.0, 4.0),
    "upper_share": (1.0, 0.02), "shout_share": (1.0, 0.005), "bar_share": (1.0, 0.005), "digit_share": (1.0, 0.02)}
STEPS = 48


def ladder(name: str) -> list[float]:
    """Cutoffs from lenient to strict, evenly spaced in the logarithm."""
    first, last = LADDERS[name]
    return [first * (last / first) ** (i / (STEPS - 1)) for i in range(STEPS)]


def steps_passed(name: str) -> Column:
    """How many cutoffs of the ladder the statistic exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, ladder(name))), lambda cut: F.col(name) > cut))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p): the regularised incomplete beta function, by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, p)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / c or tiny
        value *= c * d
        if abs(1.0 - c * d) < 1e-13:
            break
    return front * (value - 1.0)


def sequence(counts: dict[str, dict[int, tuple[int, int]]]) -> list[tuple[str, int]]:
    """The steps (statistic, index of its cutoff) from rule set to rule set.

    ``counts`` holds (good, bad) rows by statistic and number of cutoffs exceeded. A statistic's steps keep their order,
    so the rule sets are nested; cutoffs that catch no more bad rows than a more lenient one are left out.
    """
    hulls = {}
    for stat, steps in counts.items():
        points = [(0, 0, -1)]
        for i in range(STEPS):  # the strictest cutoffs are exceeded first
            over = [v for s, v in steps.items() if s >= STEPS - i]
            point = (sum(g for g, _ in over), sum(b for _, b in over), i)
            if point[1] == points[-1][1]:
                continue
            while len(points) > 1 and (point[1] - points[-1][1]) * (points[-1][0] - points[-2][0]) >= (points[-1][1] - points[-2][1]) * (point[0] - points[-1][0]):
                points.pop()
            points.append(point)
        gains = [((b - b0) / (g - g0 + 1), i) for (g0, b0, _), (g, b, i) in zip(points, points[1:])]
        if gains:
            hulls[stat] = gains
    out, at = [], dict.fromkeys(hulls, 0)
    while at:
        stat = max(at, key=lambda s: (hulls[s][at[s]][0], s))
        out.append((stat, hulls[stat][at[stat]][1]))
        at[stat] += 1
        if at[stat] == len(hulls[stat]):
            del at[stat]
    return out


def levels(steps: list[tuple[str, int]]) -> dict[str, list[int]]:
    """By statistic and number of cutoffs exceeded: the first rule set that rejects, ``len(steps)`` if none does."""
    out = {s: [len(steps)] * (STEPS + 1) for s in LADDERS}
    for level in reversed(range(len(steps))):
        stat, i = steps[level]
        for exceeded in range(STEPS - i, STEPS + 1):
            out[stat][exceeded] = level
    return out


def strata_tested(sizes: dict[str, int], risk: float, error: float) -> list[str]:
    """The strata whose holdout is large enough for a test at the level that is left to each of them."""
    ordered = sorted(sizes, key=lambda s: (-sizes[s], s))
    for m in range(len(ordered), 0, -1):
        if (1.0 - risk) ** sizes[ordered[m - 1]] <= error / m:
            return ordered[:m]
    return []


def chosen(steps: list[tuple[str, int]], reached: dict[int, tuple[int, int]], n: int, risk: float, level: float) -> dict[str, float]:
    """Cutoff by statistic of the best rule set that passes; ``reached``: (holdout good, bad) rows by first rejecting rule set."""
    best, last, lost, caught = 0, -1, 0, 0
    for i in range(len(steps)):
        good, bad = reached.get(i, (0, 0))
        lost, caught = lost + good, caught + bad
        if binomial_tail(lost, n, risk) > level:
            break
        if caught - lost > best:
            best, last = caught - lost, i
    return {stat: ladder(stat)[i] for stat, i in steps[:last + 1]}


def cutoffs(known: DataFrame, risk: float, error: float) -> dict[tuple[str, str], float]:
    """Cutoff by (stratum, statistic) from labelled rows: ``_s, _good, _tune`` and the cutoffs exceeded by each statistic.

    What reaches the driver are counts: strata with enough rows x statistics x steps.
    """
    sizes = known.filter("_good and not _tune").groupBy("_s").agg(F.count(F.lit(1)).alias("n"))
    least = math.ceil(math.log(error) / math.log1p(-risk))  # no stratum passes with fewer
    sizes = {r._s: r.n for r in sizes.filter(F.col("n") >= least).collect()}
    tested = strata_tested(sizes, risk, error)
    if not tested:
        return {}
    known = known.filter(F.col("_s").isin(tested))
    long = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("step")) for s in LADDERS]))
    per = known.filter("_tune or not _good").select("_s", "_good", long.alias("r")).groupBy("_s", "r.stat", "r.step")
    counts: dict[str, dict] = {s: {} for s in tested}
    for r in per.agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")).collect():
        counts[r._s].setdefault(r.stat, {})[r.step] = (r.good, r.bad)
    steps = {s: sequence(dict(sorted(counts[s].items()))) for s in tested}
    first = None  # the first rule set of its stratum that rejects a row
    for s in tested:
        table = levels(steps[s])
        level = F.least(*[F.array(*map(F.lit, table[stat]))[F.col(stat)] for stat in LADDERS])
        first = F.when(F.col("_s") == s, level) if first is None else first.when(F.col("_s") == s, level)
    found: dict[str, dict] = {s: {} for s in tested}
    rows = known.filter("not (_good and _tune)").groupBy("_s", first.alias("level"))
    for r in rows.agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")).collect():
        found[r._s][r.level] = (r.good, r.bad)
    return {(s, stat): cut for s in tested for stat, cut in chosen(steps[s], found[s], sizes[s], risk, error / len(tested)).items()}


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", label: str = "quality", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The base counts, ``base_failed`` and ``kept`` of every row of ``docs``.

    A null stratum is a stratum of its own. Strata with too few labelled good rows for any guarantee have no
    cutoffs, and their rows are kept unless the base rules fail. Null texts have no words and fail the base
    rules. Rows without an id are judged but not learned from; several labels of one id are averaged.
    """
    stats = materialise(ratios(docs.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit(""))), ["doc_id", "_s"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).alias("_good"))
    tune = F.pmod(F.crc32(F.concat(F.lit("tune "), F.col("doc_id").cast("string"))), F.lit(4)) == 0
    known = stats.filter(~failed).join(marks, "doc_id").select("_s", "_good", tune.alias("_tune"), *[steps_passed(s).alias(s) for s in LADDERS])
    found = cutoffs(materialise(known), risk, error)
    bad: Column = F.lit(False)
    for s in sorted({k[0] for k in found}):
        over = F.lit(False)
        for (at, stat), cut in found.items():
            if at == s:
                over = over | (F.col(stat) > F.lit(cut))
        bad = bad | ((F.col("_s") == s) & over)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~bad).alias("kept"))
