"""Joins. The physical strategy is left to the planner, which knows the sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.scale import group_rank
from ..functions.text import title_parse
from .windows import latest_per_key


def enrich_left(df: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    return df.join(other.select(*on, *columns), on, "left")


def enrich_inner(df: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    return df.join(other.select(*on, *columns), on)


def one_to_one_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that break a one-to-one join, with their counts on both sides."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    counts = a.join(b, key, "full_outer").na.fill(0, ["n_left", "n_right"])
    problem = (F.when(F.col("n_left") > 1, "duplicate left").when(F.col("n_right") > 1, "duplicate right")
               .when(F.col("n_right") == 0, "missing right").when(F.col("n_left") == 0, "missing left"))
    return counts.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join after asserting that ``key`` is unique on both sides."""
    bad = one_to_one_violations(left, right, key).filter(F.col("problem").startswith("duplicate")).limit(1).count()
    if bad:
        raise ValueError(f"{key} is not unique on both sides")
    return left.join(right, key, how)


def align_by_key(left: DataFrame, right: DataFrame, key: str, left_pos: str, right_pos: str) -> DataFrame:
    """Key join in place of a positional one, with a flag where the recorded positions differ."""
    return left.join(right, key).withColumn("in_step", F.col(left_pos).eqNullSafe(F.col(right_pos)))


def keep_present(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def keep_pending(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def class_parent_lookup(df: DataFrame, key: str, first: DataFrame, second: DataFrame, parent: str) -> DataFrame:
    """Parent of each class from two tables; an entry of the second one wins."""
    a = first.select(key, F.col(parent).alias("_p1"))
    b = second.select(key, F.col(parent).alias("_p2"))
    return df.join(a, key, "left").join(b, key, "left").withColumn(parent, F.coalesce("_p2", "_p1")).drop("_p1", "_p2")


def parsed_titles(df: DataFrame, title: str) -> DataFrame:
    """Code, view and shot of every title that carries a code."""
    return df.withColumn("_t", title_parse(title)).filter("_t is not null").select(*df.columns, "_t.code", "_t.view", "_t.shot")


def candidates(items: DataFrame, titles: DataFrame, code: str, view: str) -> DataFrame:
    """All same-view candidates of each item with their rank: lowest shot first, then title.

    ``titles`` has ``code, view, shot, title``. Ranks come from one range partitioning, so a code
    with very many titles spans many tasks.
    """
    left = items.withColumn("_code", F.lower(F.col(code))).withColumn("_view", F.col(view))
    right = titles.select(F.col("code").alias("_code"), F.col("view").alias("_view"), "shot", "title")
    ranked = group_rank(right, ["_code", "_view"], ["shot", "title"])
    return left.join(ranked, ["_code", "_view"]).drop("_code", "_view")


def best_candidate(items: DataFrame, titles: DataFrame, code: str, view: str) -> DataFrame:
    """First candidate and number of candidates per item; items without one are left out.

    Titles are reduced to one row per (code, view) by a partial aggregation before the join.
    """
    best = titles.groupBy(F.col("code").alias("_code"), F.col("view").alias("_view")).agg(
        F.min(F.struct("shot", "title")).alias("_b"), F.count(F.lit(1)).alias("n_candidates"))
    left = items.withColumn("_code", F.lower(F.col(code))).withColumn("_view", F.col(view))
    return left.join(best, ["_code", "_view"]).select(*items.columns, "_b.shot", "_b.title", "n_candidates")


def first_confirmed_candidate(evidence: DataFrame, key: list[str], rank: str, confidence: str, payload: list[str],
                              unconfirmed: str = "unconfirmed") -> DataFrame:
    """Per key the lowest rank that is confirmed, else the evidence of the lowest rank."""
    order = F.struct((F.col(confidence) == unconfirmed).alias("open"), F.col(rank).alias("rank"), *[F.col(c) for c in payload])
    best = evidence.groupBy(*key).agg(
        F.min(F.struct(order.alias("o"), F.col(confidence).alias("confidence"))).alias("_b"),
        F.count(F.lit(1)).alias("n_candidates"))
    return best.select(*key, F.col("_b.o.rank").alias("candidate_rank"), F.col("_b.confidence").alias("match_confidence"),
                       *[F.col(f"_b.o.{c}").alias(c) for c in payload], "n_candidates")


def paired_outcomes(df: DataFrame, key: list[str], scheme: str, schemes: list[str], value: Column, base: str) -> DataFrame:
    """One column per scheme and the difference of each scheme from ``base``."""
    wide = df.groupBy(*key).pivot(scheme, schemes).agg(value)
    return wide.select(*key, *schemes, *[(F.col(base) - F.col(s)).alias(f"drop_{s}") for s in schemes if s != base])


def upsert(old: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows replace old ones with the same key; new keys are added. Full outer join on the key."""
    values = [c for c in old.columns if c not in key]
    a = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(True).alias("_in_old"))
    b = fresh.select(*key, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_in_new"))
    state = F.when(F.col("_in_new") & F.col("_in_old"), "replaced").when(F.col("_in_new"), "added").otherwise("kept")
    return a.join(b, key, "full_outer").select(
        *key, *[F.when(F.col("_in_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in values],
        state.alias("state"))


def keep_outcome_if_same(previous: DataFrame, current: DataFrame, key: str, url: str, columns: list[str], default: dict) -> DataFrame:
    """Earlier outcome columns survive only if the address is unchanged, else the default is written."""
    p = previous.select(key, F.col(url).alias("_u"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.coalesce(F.col("_u") == F.col(url), F.lit(False))
    return current.join(p, key, "left").select(
        *current.columns, *[F.when(same, F.col(f"_{c}")).otherwise(F.lit(default[c])).alias(c) for c in columns])


def source_resolve(items: DataFrame, log: DataFrame, ok: DataFrame, log_order: list[str], cached: str, default: str) -> DataFrame:
    """Source of each item: '' if absent, else the latest log entry, else ``cached`` where the
    success table has the same address, else ``default``."""
    latest = latest_per_key(log, ["path"], log_order, ["source"]).select("path", F.col("source").alias("_logged"))
    good = ok.select("path", "url").distinct().withColumn("_ok", F.lit(True))
    out = items.join(latest, "path", "left").join(good, ["path", "url"], "left")
    source = (F.when(~F.col("present"), "").when(F.col("_logged").isNotNull(), F.col("_logged"))
              .when(F.col("_ok"), cached).otherwise(default))
    return out.withColumn("source", source).drop("_logged", "_ok")
