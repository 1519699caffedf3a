"""The score fixture: the first ten dimensions of each vector are the logits of classes 0-9 and
``label`` is the truth, so that metrics can be checked without a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 10


def logits(t) -> DataFrame:
    """vec_id, truth, scores: array of (label, score)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.get("embedding", F.lit(k)).cast("double").alias("score")) for k in range(K)])
    return t.embeddings.select("vec_id", F.col("label").alias("truth"), pairs.alias("scores"))


def scored(t) -> DataFrame:
    """vec_id, truth, pred: class with the largest logit, ties to the lower class."""
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["label"]).alias("neg"))))
    return logits(t).select("vec_id", "truth", (-best["neg"]).alias("pred"))


FIXTURE = """
g as (select vec_id, label as truth, unnest(range(0, 10)) as k, unnest(embedding[1:10])::double as z from embeddings),
o as (select *, row_number() over (partition by vec_id order by z desc, k) as r from g),
s as (select vec_id, truth, cast(k as integer) as pred from o where r = 1)"""
