"""Vectors: norms, exact nearest neighbours, centroids, fingerprints.

Vectors are ``array<float|double>`` columns keyed by an id of any type. Python steps are the matrix products of
``cosine_topk`` and ``score_against`` and the segment means of ``fingerprint`` (Arrow batches to numpy).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from .. import fixed
from ..core.scale import exact_quantiles, join_small, range_rank
from ..core.session import materialise
from .models import side_by_side

BROADCAST_BYTES = 32 << 20  # query or class matrices up to this size travel to the tasks as they are
SCORE_BLOCK = 2_048  # rows and classes of a block of scores: 32 MiB
SCORE_CELLS = 1 << 21  # of one product of queries with corpus rows
PACKED_ROWS = 4_096  # corpus rows that travel as one value
FIRST_COLUMNS = 2_048  # of a product that give the first bound of a query
GROUP = 64  # columns of a product that are looked at through their largest value
PAIRS_AT_ONCE = 1 << 16  # whose exact similarity is computed together
SIMILARITY_PLACES = 12  # equal vectors tie exactly whatever their place in a block


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(df: DataFrame, vec: str) -> DataFrame:
    """Unit vectors. Null, zero and non-finite vectors get no row; nothing is filled in."""
    n = norm(vec)
    ok = n.isNotNull() & (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return df.withColumn("_n", n).filter(ok).withColumn(vec, F.transform(vec, lambda x: F.try_divide(x.cast("double"), F.col("_n")))).drop("_n")


def norm_check(df: DataFrame, vec: str, tolerance: float = 1e-4) -> DataFrame:
    n = df.select(norm(vec).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(F.abs(F.col("n") - 1) <= tolerance, F.lit(False))).alias("n_off"),
                 F.min("n").alias("min_norm"), F.max("n").alias("max_norm"))


def paired(a: DataFrame, b: DataFrame, key: str, vec: str) -> DataFrame:
    """Both versions of each id with their cosine."""
    both = a.select(key, F.col(vec).alias("_a")).join(b.select(key, F.col(vec).alias("_b")), key)
    return both.withColumn("cosine", F.try_divide(dot("_a", "_b"), norm("_a") * norm("_b")))


def paired_cosine(a: DataFrame, b: DataFrame, key: str, vec: str, worst: int = 5) -> DataFrame:
    """Median, minimum, first percentile and the worst ids of the cosine of two versions: (what, id, value)."""
    pairs = paired(a, b, key, vec).select(key, "cosine")
    q = exact_quantiles(pairs, [], ["cosine"], [0.0, 0.01, 0.5])
    what = F.when(F.col("prob") == 0.0, "min").when(F.col("prob") == 0.01, "p1").otherwise("median")
    low = pairs.orderBy("cosine", key).limit(worst)
    return q.select(what.alias("what"), F.lit(None).cast(a.schema[key].dataType).alias("id"), "value").unionByName(
        low.select(F.lit("worst").alias("what"), F.col(key).alias("id"), F.col("cosine").alias("value")))


def signal_distance(a: DataFrame, b: DataFrame, key: str, vec: str, peak: float = 255.0) -> DataFrame:
    """Peak signal-to-noise ratio (dB, +inf for equal vectors) and mean squared error per id."""
    both = a.select(key, F.col(vec).alias("_a")).join(b.select(key, F.col(vec).alias("_b")), key)
    gaps = F.zip_with("_a", "_b", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    mse = F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), F.size("_a"))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / F.col("mse")))
    return both.withColumn("mse", mse).select(key, "mse", psnr.alias("psnr_db"))


def evidence_tier(psnr: Column | str, distance: Column | str, exact: Column, aspect_gap: Column | None = None) -> Column:
    """exact / visual_match / unconfirmed from signal distance, fingerprint distance and shape."""
    psnr, distance = (F.col(c) if isinstance(c, str) else c for c in (psnr, distance))
    ok = (psnr >= fixed.SIGNAL_MIN_DB) & (distance <= fixed.FINGERPRINT_MAX)
    tier = F.when(exact, "exact")
    if aspect_gap is not None:
        tier = tier.when(aspect_gap > fixed.ASPECT_TOLERANCE, "unconfirmed")
    return tier.when(ok, "visual_match").otherwise("unconfirmed")


# ---------------------------------------------------------------- exact nearest neighbours
def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, np.nan)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _list_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column without nulls as a matrix; an element that is null becomes NaN."""
    if not len(column):
        return np.zeros((0, 0))
    size = pc.list_value_length(column)
    if pc.min(size) != pc.max(size):
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size[0].as_py())


def _ids(column: pd.Series) -> np.ndarray:
    """Ids as they are: numbers as numbers, anything else as objects that can be put in order."""
    return column.to_numpy() if column.dtype.kind in "iuf" else column.to_numpy(dtype=object)


class _Nearest:
    """The k best corpus rows of some queries so far.

    A block of products in single precision only says which pairs cannot be among the k best, within its error bound; pairs that
    can are computed in double precision. Where copies or large coordinates leave too many, the block is done in double precision.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int, metric: str):
        self.k, self.metric = k, metric
        self.ids, self.m = self._usable(ids, m)
        self.square = np.einsum("ij,ij->i", self.m, self.m).max(initial=0.0)
        self.sims, self.found = np.full((len(self.ids), k), -np.inf), np.zeros((len(self.ids), k), np.int64)
        self.order = np.argsort(self.ids, kind="stable")
        self.lifted: dict = {}

    def _usable(self, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a similarity to others; unit vectors for the cosine."""
        with np.errstate(invalid="ignore"):
            m = _unit(m) if self.metric == "cosine" else m
        ok = np.isfinite(m).all(axis=1) & (m.shape[1] > 0)
        return ids[ok], m[ok]

    def _lift(self, m: np.ndarray, corpus: bool) -> np.ndarray:
        """Rows whose products are the cosine, or the negative squared distance."""
        if self.metric == "cosine":
            return m
        sq, one = np.einsum("ij,ij->i", m, m)[:, None], np.ones((len(m), 1))
        return np.hstack([m, sq, one]) if corpus else np.hstack([2 * m, -one, -sq])

    def _candidates(self, a: int, b: int, c: np.ndarray, width: int, scale: float, kind: type, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.lifted:
            self.lifted[kind] = self._lift(self.m, False).astype(kind)
        s = self.lifted[kind][a:b] @ c.T
        s[own] = -np.inf
        s[:, width:] = -np.inf
        error, digit = (c.shape[1] + 16) * float(np.finfo(kind).eps) * 4 * scale, 10.0**-SIMILARITY_PLACES
        low = self.sims[a:b, -1]
        low = low - digit if self.metric == "cosine" else -((digit - low) ** 2)
        if np.isinf(low).any() and s.shape[1] > self.k:
            first = s[:, :max(FIRST_COLUMNS, self.k + 1)]
            low = np.maximum(low, np.partition(first, -self.k, axis=1)[:, -self.k].astype(np.float64) - error - digit * max(1.0, scale))
        limit = (low - error).astype(kind)
        s = s.reshape(b - a, GROUP, -1)
        r, group = np.nonzero(s.max(axis=1) >= limit[:, None])  # most groups hold none
        at, member = np.nonzero(s[r, :, group] >= limit[r, None])
        return r[at], member * s.shape[2] + group[at]

    def _exact(self, r: np.ndarray, col: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for a in range(0, len(r), PAIRS_AT_ONCE):
            x, y = self.m[r[a:a + PAIRS_AT_ONCE]], c[col[a:a + PAIRS_AT_ONCE]]
            gap = x - y
            out[a:a + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", x, y) if self.metric == "cosine" else -np.sqrt(np.einsum("ij,ij->i", gap, gap))
        return np.round(out, SIMILARITY_PLACES)

    def add(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        c_ids, c = self._usable(c_ids, c)
        if not len(c_ids) or not len(self.ids):
            return
        # pairs of a query and itself, in the order of the queries
        from_, to = (np.searchsorted(self.ids, c_ids, side, sorter=self.order) for side in ("left", "right"))
        times = to - from_
        mine = self.order[np.repeat(from_, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        by_query = np.argsort(mine, kind="stable")
        mine, self_col = mine[by_query], np.repeat(np.arange(len(c_ids)), times)[by_query]
        scale = 1.0 if self.metric == "cosine" else float(self.square + np.einsum("ij,ij->i", c, c).max())
        double = self._lift(c, True)
        double = np.vstack([double, np.zeros((-len(c) % GROUP, double.shape[1]))])
        single = double.astype(np.float32) if 1e-30 < scale < 1e30 else None
        step = max(64, SCORE_CELLS // len(c))
        for a in range(0, len(self.ids), step):
            b = min(a + step, len(self.ids))
            lo, hi = np.searchsorted(mine, [a, b])
            own = (mine[lo:hi] - a, self_col[lo:hi])
            r = None
            if single is not None:
                r, col = self._candidates(a, b, single, len(c), scale, np.float32, own)
            if r is None or len(r) > max(4096, (b - a) * len(c) // 16):
                r, col = self._candidates(a, b, double, len(c), scale, np.float64, own)
            r, real = r + a, col < len(c)
            r, col = r[real], col[real]
            other = self.ids[r] != c_ids[col]
            r, col = r[other], col[other]
            s = self._exact(r, col, c)
            good = np.isfinite(s) & (s >= self.sims[r, -1])
            self._merge(r[good], c_ids[col[good]], s[good])

    def _merge(self, r: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Keep the first k per query by (similarity descending, id)."""
        rows = np.unique(r)
        qi, ids, s = np.r_[np.repeat(rows, self.k), r], np.r_[self.found[rows].ravel(), ids], np.r_[self.sims[rows].ravel(), s]
        real = s > -np.inf
        qi, ids, s = qi[real], ids[real], s[real]
        order = np.lexsort((ids, -s, qi))
        qi, ids, s = qi[order], ids[order], s[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = place < self.k
        self.sims[qi[keep], place[keep]], self.found[qi[keep], place[keep]] = s[keep], ids[keep]

    def table(self) -> pa.RecordBatch:
        real = self.sims > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.k)[real.ravel()]), pa.array(self.found[real]), pa.array(self.sims[real])],
                                          names=["query_id", "neighbour_id", "similarity"])


def _packed(rows: DataFrame) -> DataFrame:
    """Ids and vectors of up to ``PACKED_ROWS`` rows as the bytes of two arrays, spread evenly over the tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PACKED_ROWS):
                part = batch.slice(a, PACKED_ROWS)
                ids, m = part.column("id").to_numpy(), _list_matrix(part.column("v"))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([m.tobytes()])], names=["ids", "m"])

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return materialise(rows.repartition(tasks).mapInArrow(pack, "ids binary, m binary"))


def _numbered_ids(q: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries and corpus with ids replaced by their number in the order of the ids, and the numbers' names."""
    names = materialise(range_rank(q.select("id").union(c.select("id")).distinct(), [F.col("id")]).select("id", F.col("rank").alias("_no")))
    number = lambda df: df.join(names, "id").select(F.col("_no").alias("id"), "v")
    return number(q), number(c), names


def cosine_topk(queries: DataFrame, corpus: DataFrame, key: str, vec: str, k: int = 5, metric: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k most similar corpus rows of every query: (query_id, neighbour_id, similarity, rank).

    Exact, for ids of any type that has an order; rows without id or vector are left out, the query itself is excluded and
    ties go to the lower id. The corpus is written once in packed blocks, dealt evenly to the tasks; queries travel to the tasks,
    ``broadcast_bytes`` at a time. A task keeps its k best per query, so no pair of rows is ever shuffled. With more
    queries than travel at once, each round's result is a table, and some rounds run side by side. All pairs are compared, so
    the work grows with queries times corpus; the memory does not. ``metric`` is cosine or euclidean (negative distance).
    """
    own = lambda df: df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("v is not null and id is not null")
    q, c = own(queries), own(corpus)
    kind = lambda df: df.schema["id"].dataType
    kinds, names = (kind(q), kind(c)), None
    if not all(isinstance(t, IntegralType) for t in kinds):
        q, c, names = _numbered_ids(q, c)
    long = lambda df: df.select(F.col("id").cast("long").alias("id"), "v")
    q, c = long(q), _packed(long(c))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    rounds = max(1, -(-size["n"] * size["d"] * 8 // broadcast_bytes))
    if rounds > 1:
        q = materialise(q.withColumn("_turn", F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int")).repartition("_turn"), "_turn")
    spark, w = q.sparkSession, Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")

    def best(turn: int):
        rows = (q.filter(F.col("_turn") == turn).select("id", "v") if rounds > 1 else q).toArrow().combine_chunks()  # about broadcast_bytes
        lists = rows.column("v").combine_chunks()
        shared = spark.sparkContext.broadcast((rows.column("id").to_numpy(), _list_matrix(lists)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = _Nearest(*shared.value, k, metric)
            for batch in batches:
                for ids, m in zip(batch.column("ids"), batch.column("m")):
                    ids = np.frombuffer(ids.as_buffer(), dtype=np.int64)
                    near.add(ids, np.frombuffer(m.as_buffer(), dtype=np.float64).reshape(len(ids), -1))
            yield near.table()

        found = c.mapInArrow(scan, "query_id long, neighbour_id long, similarity double")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), shared

    def written(turn: int) -> DataFrame:
        part, shared = best(turn)
        part = materialise(part)
        shared.destroy()
        return part

    if rounds == 1:
        top = best(0)[0]
    else:
        parts = side_by_side([lambda turn=turn: written(turn) for turn in range(rounds)], 3)
        top = spark.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()])
    if names is not None:
        name = lambda c: names.select(F.col("_no").alias(c), F.col("id").alias(f"_{c}"))
        top = top.join(name("query_id"), "query_id").join(name("neighbour_id"), "neighbour_id")
        top = top.select(F.col("_query_id").alias("query_id"), F.col("_neighbour_id").alias("neighbour_id"), "similarity", "rank")
    return top.select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("neighbour_id").cast(kinds[1]).alias("neighbour_id"), "similarity", "rank")


def similar_cards(top: DataFrame, meta: DataFrame, key: str, columns: list[str], link: str) -> DataFrame:
    """Neighbours with metadata columns and a link built from the id."""
    m = meta.select(F.col(key).alias("neighbour_id"), *columns)
    return top.join(m, "neighbour_id").withColumn("link", F.concat(F.lit(link), F.col("neighbour_id").cast("string")))


def knn_vote(top: DataFrame, labels: DataFrame, key: str, label: str, votes: int = 3) -> DataFrame:
    """Nearest label and majority of the nearest ``votes``; a tie goes to the label met first."""
    named = top.filter(F.col("rank") <= votes).join(labels.select(F.col(key).alias("neighbour_id"), F.col(label).alias("_label")), "neighbour_id")
    per = named.groupBy("query_id", "_label").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first"))
    return per.groupBy("query_id").agg(
        F.min_by("_label", "_first").alias("top1"), F.max_by("_label", F.struct("_n", (-F.col("_first")).alias("f"))).alias("vote"))


def neighbour_composition(top: DataFrame, labels: DataFrame, key: str, label: str, n: int = 3) -> DataFrame:
    """Most frequent labels among the neighbours of each query as ``label count, ...`` text."""
    named = top.join(labels.select(F.col(key).alias("neighbour_id"), F.col(label).alias("_label")), "neighbour_id")
    counts = named.groupBy("query_id", "_label").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct((-F.col("_n")).alias("o"), F.col("_label").alias("l"), F.concat_ws(" ", F.col("_label").cast("string"), F.col("_n").cast("string")).alias("t"))
    lists = counts.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, n).alias("_e"))  # at most k entries
    return lists.select("query_id", F.array_join(F.transform("_e", lambda e: e["t"]), ", ").alias("neighbours"))


# ---------------------------------------------------------------- class vectors
def class_means(df: DataFrame, cls: str, vec: str) -> DataFrame:
    """Mean vector per class as rows (class, dim, mean): combined before the shuffle."""
    dims = df.filter(F.col(cls).isNotNull()).select(cls, F.posexplode(vec).alias("dim", "x"))
    return dims.groupBy(cls, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def class_vectors(df: DataFrame, cls: str, vec: str) -> DataFrame:
    """One mean vector per class; each list has as many entries as there are dimensions."""
    means = class_means(df, cls, vec)
    return means.groupBy(cls).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias(vec))


def score_against(df: DataFrame, vec: str, prototypes: DataFrame, cls: str, normalise: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``scores``: array of (label, score) of every row against one vector per class.

    A class matrix of checked small size travels to the tasks and the rows stay in place. A larger one is cut
    into class blocks: every (row block, class block) pair is one task, and a row's pieces are put together again.
    """
    size = prototypes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vec)), F.lit(0)).alias("d")).first()
    if size["n"] * size["d"] * 8 > broadcast_bytes:
        return _score_blocks(df, vec, prototypes, cls, normalise, max(1, min(SCORE_BLOCK, broadcast_bytes // (size["d"] * 8))))
    rows = prototypes.orderBy(cls).select(cls, F.col(vec).cast("array<double>").alias("v")).toPandas()
    labels, m = rows[cls].tolist(), _matrix(rows["v"])
    m = _unit(m) if normalise else m

    @F.pandas_udf("array<double>")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(_matrix(v) @ m.T))

    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("scores", F.zip_with(names, score(F.col(vec).cast("array<double>")), lambda a, b: F.struct(a.alias("label"), b.alias("score"))))


def _score_blocks(df: DataFrame, vec: str, prototypes: DataFrame, cls: str, normalise: bool, width: int) -> DataFrame:
    """``score_against`` for any number of classes, in blocks of ``width`` classes and some ``SCORE_BLOCK`` rows."""
    classes = materialise(range_rank(prototypes.select(cls, F.col(vec).cast("array<double>").alias("v")), [F.col(cls)]).select(
        F.col(cls).alias("c"), "v", (F.col("rank") - 1).alias("place"), F.floor((F.col("rank") - 1) / width).cast("int").alias("block")))
    blocks = -(-classes.count() // width)
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    pieces = max(1, -(-rows.count() // SCORE_BLOCK))
    left = rows.select("_row", F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64("_row"), F.lit(pieces)).cast("int").alias("piece"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = classes.select("place", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_row": [], "block": [], "s": []})
        m = _matrix(b.sort_values("place")["v"])
        m = _unit(m) if normalise else m
        return pd.DataFrame({"_row": a["_row"], "block": a["block"], "s": list(_matrix(a["v"]) @ m.T)})

    parts = left.groupBy("piece", "block").cogroup(right.groupBy("piece", "block")).applyInPandas(pair, "_row bigint, block int, s array<double>")
    whole = parts.groupBy("_row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "s"))), lambda p: p["s"])).alias("_s"))
    names = classes.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "c"))), lambda p: p["c"]))  # what every row of the result holds
    scored = rows.join(whole, "_row").withColumn("_names", names.scalar())
    return scored.select(*df.columns, F.zip_with("_names", "_s", lambda a, b: F.struct(a.alias("label"), b.alias("score"))).alias("scores"))


def distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def class_centroids(df: DataFrame, cls: str, vec: str) -> DataFrame:
    """Per class: rows, centroid and spread (mean distance of its rows to the centroid)."""
    centroids = class_vectors(df, cls, vec).withColumnRenamed(vec, "centroid")
    rows = join_small(df.filter(F.col(cls).isNotNull()).select(cls, vec), centroids, [cls])
    spread = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.avg(distance(vec, "centroid")).alias("spread"))
    return spread.join(centroids, cls)


def class_median_position(df: DataFrame, cls: str, x: str, y: str) -> DataFrame:
    q = exact_quantiles(df, [cls], [x, y], [0.5])
    return q.groupBy(cls).agg(F.max(F.when(F.col("name") == x, F.col("value"))).alias(f"{x}_median"),
                              F.max(F.when(F.col("name") == y, F.col("value"))).alias(f"{y}_median"))


def pair_separation(centroids: DataFrame, pairs: DataFrame, cls: str) -> DataFrame:
    """overlapping / adjacent / separated for given class pairs (columns ``a`` and ``b``)."""
    side = lambda name: centroids.select(F.col(cls).alias(name), F.col("centroid").alias(f"_c{name}"), F.col("spread").alias(f"spread_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("distance", distance("_ca", "_cb"))
    wide = F.greatest("spread_a", "spread_b")
    verdict = F.when(F.col("distance") < wide, "overlapping").when(F.col("distance") < 2 * wide, "adjacent").otherwise("separated")
    return both.select("a", "b", "distance", "spread_a", "spread_b", verdict.alias("verdict"))


def nearest_other_centroid(centroids: DataFrame, cls: str) -> DataFrame:
    """Closest other class of every class, by the exact block search over centroids."""
    ids = centroids.select(F.col(cls).alias("id"), F.col("centroid").alias("v"))
    top = cosine_topk(ids, ids, "id", "v", k=1, metric="euclidean")
    return top.select(F.col("query_id").alias(cls), F.col("neighbour_id").alias("nearest"), (-F.col("similarity")).alias("distance"))


# ---------------------------------------------------------------- fingerprints
@F.pandas_udf(LongType())
def _fingerprints(vectors: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(vectors), dtype="Int64")
    sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for n in np.unique(sizes[sizes >= 0]):
        if n < 64:
            raise ValueError("a fingerprint needs 64 elements or more")
        at = np.flatnonzero(sizes == n)
        edges = np.arange(65) * n // 64
        means = np.add.reduceat(_matrix(vectors.iloc[at]), edges[:-1], axis=1) / np.diff(edges)
        middle = np.partition(means[:, 1:], 31, axis=1)[:, 31]  # of 63
        bits = (means > middle[:, None]) << np.arange(64, dtype=np.uint64)
        out.iloc[at] = np.bitwise_or.reduce(bits, axis=1).view(np.int64)
    return out


def fingerprint(vec: Column | str) -> Column:
    """64-bit fingerprint: bit i is set where the mean of segment i exceeds the median of segments 2 and up.

    The vector is cut into 64 even segments, so every element takes part; of 64 elements each is a segment.
    Shorter vectors are refused; a null vector has a null fingerprint. One pass in Arrow batches.
    """
    return _fingerprints(vec)


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _agreeing(bits: list[int], blocks: int, limit: int) -> list[int]:
    """Masks (as signed numbers) over bits dealt in turn to blocks: words at most ``limit`` apart agree under one at least."""
    masks = [sum(1 << b for b in bits[i::blocks]) for i in range(blocks)]
    whole = [sum(c) for c in combinations(masks, blocks - limit)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in whole]


def block_count(n: int, limit: int, information: float = 64.0) -> int:
    """Blocks with the least work for two sets of ``n`` fingerprints of so many random bits: keys made, and pairs that meet by chance."""
    def work(blocks: int) -> float:
        ways = comb(blocks, limit)
        return ways * n * (1 + n / 2.0 ** (information * (blocks - limit) / blocks))

    return min(range(limit + 1, min(limit + 7, 64)), key=work)


def _meetings(left: DataFrame, right: DataFrame, limit: int, blocks: int | None = None) -> DataFrame:
    """Pairs ``_f, _g`` of fingerprints that meet under some key (``right`` keeps its other columns); all within ``limit`` bits are among them.

    How often each bit is set says how much it tells apart; the bits are dealt to the blocks from the best one down, so
    bits that all fingerprints share do not fill a block.
    """
    bit = lambda i: F.shiftright("_g", i).bitwiseAND(F.lit(1).cast("bigint"))
    n, *ones = right.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(bit(i)), F.lit(0)) for i in range(64)]).first()
    share = np.clip(np.array(ones) / max(n, 1), 1e-12, 1 - 1e-12)
    told = -(share * np.log2(share) + (1 - share) * np.log2(1 - share))
    blocks = blocks or block_count(max(n, 1), limit, float(told.sum()))
    masks = _agreeing(np.argsort(-told, kind="stable").tolist(), blocks, limit)

    def keyed(df: DataFrame, fp: str) -> DataFrame:
        return df.select("*", F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m).cast("bigint")) for m in masks])).alias("_c", "_k"))

    return keyed(left, "_f").join(keyed(right, "_g"), ["_c", "_k"])


def fingerprint_match(left: DataFrame, right: DataFrame, key: str, fp: str, limit: int = fixed.FINGERPRINT_MAX, blocks: int | None = None) -> DataFrame:
    """Best match of every left row within ``limit`` bits: (key, match, distance).

    Distinct fingerprints are matched, not rows, so copies never form pairs. With 64 bits in
    ``blocks`` blocks (as many as suit the number of fingerprints) at most ``limit`` of them can differ, so the remaining
    ones agree: fingerprints meet under the values of those blocks (pigeonhole), which loses no match. Each comparison is
    reduced to the best one per left fingerprint at once. Ties go to the smaller right key.
    """
    l_fp = materialise(left.select(F.col(fp).alias("_f")).filter("_f is not null").distinct())
    r_fp = materialise(right.filter(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("_g")).agg(F.min(key).alias("_m")))
    near = _meetings(l_fp, r_fp, limit, blocks).withColumn("_d", hamming("_f", "_g")).filter(F.col("_d") <= limit)
    best = near.groupBy("_f").agg(F.min(F.struct(F.col("_d").alias("d"), F.col("_m").alias("m"))).alias("_b"))
    out = left.select(key, F.col(fp).alias("_f")).join(best, "_f")
    return out.select(key, F.col("_b.m").alias("match"), F.col("_b.d").alias("distance"))


# ---------------------------------------------------------------- occlusion
def occlusion_importance(df: DataFrame, key: str, vec: str, weights: list[float], n_masks: int, p_keep: float, seed: int) -> DataFrame:
    """Importance of each feature from random keep-masks: sum(p * m) / sum(m) per (id, feature); null where no mask keeps it.

    ``p`` is the logistic score of the masked row under linear ``weights``. Mask bits come from a
    hash of (seed, mask, feature), the same for every row. Each row is processed where it is, in
    Arrow batches against one mask matrix, so nothing is shuffled and no (row, mask) pair is emitted.
    """
    import hashlib

    d = len(weights)
    bit = lambda m, j: int(hashlib.md5(f"{seed}|{m}|{j}".encode()).hexdigest()[:8], 16) / 2**32 < p_keep
    masks = np.array([[bit(m, j) for j in range(d)] for m in range(n_masks)], dtype=float)
    w = np.asarray(weights, dtype=float)
    cover = masks.sum(axis=0)
    seen = cover > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"])
            if not len(x):
                continue
            p = 1 / (1 + np.exp(-((x[:, :d] * w) @ masks.T)))
            importance = np.full((len(x), d), None, dtype=object)
            importance[:, seen] = (p @ masks)[:, seen] / cover[seen]
            ids = _ids(pdf["id"])
            yield pd.DataFrame({"id": pd.Series(ids, dtype=ids.dtype), "importance": list(importance), "p_mean": p.mean(axis=1), "p_max": p.max(axis=1)})

    rows = df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, importance array<double>, p_mean double, p_max double").withColumnRenamed("id", key)


def occlusion_summary(imp: DataFrame, key: str) -> DataFrame:
    """Baseline, range and largest deviation per id, and the scale shared by all ids."""
    mean = F.aggregate("importance", F.lit(0.0), lambda s, x: s + x) / F.size("importance")
    s = imp.withColumn("baseline", mean)
    s = s.withColumn("dev_max", F.array_max(F.transform("importance", lambda x: F.abs(x - F.col("baseline")))))
    s = s.select(key, "baseline", F.array_min("importance").alias("imp_min"), F.array_max("importance").alias("imp_max"), "dev_max", "p_mean", "p_max")
    return s.withColumn("shared_scale", s.agg(F.max("dev_max")).scalar())
