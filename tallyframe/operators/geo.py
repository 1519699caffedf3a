"""Geography and serving tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..core.scale import exact_quantiles
from ..functions.values import fixed_text
from .windows import hash_first


def mercator_cell(lat: Column | str, lon: Column | str, zoom: int, cell_px: int = fixed.CELL_PX) -> tuple[Column, Column]:
    """Cell of a web-mercator pixel grid (256-pixel tiles) at a zoom."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    size = 256.0 * 2**zoom
    clipped = F.greatest(F.lit(-85.0511287798), F.least(F.lit(85.0511287798), lat))
    s = F.sin(clipped * pi / 180)
    x = (lon / 360 + 0.5) * size
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * pi)) * size
    return F.floor(x / cell_px), F.floor(y / cell_px)


def grid_cluster(df: DataFrame, group: str, lat: str, lon: str, zoom: int, above: int = fixed.CLUSTER_ABOVE) -> DataFrame:
    """Mean position and count per grid cell; groups of up to ``above`` points stay raw (n = 1).

    Both forms come from one pass: a small group keeps its points apart by a row number that is
    only part of the key there.
    """
    pts = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(group, lat, lon)
    sizes = pts.groupBy(group).agg((F.count(F.lit(1)) > above).alias("_many"))
    cx, cy = mercator_cell(lat, lon, zoom)
    rows = pts.join(sizes, group).withColumn("cell_x", cx).withColumn("cell_y", cy)
    raw = rows.filter(~F.col("_many")).select(group, "cell_x", "cell_y", F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.lit(1).cast("long").alias("n"))
    many = rows.filter("_many").groupBy(group, "cell_x", "cell_y").agg(
        F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count(F.lit(1)).alias("n"))
    return many.unionByName(raw)


def class_geo_table(df: DataFrame, cls: str, id_col: str, place: str, lat: str, lon: str, measure: str, year: str,
                    name: str, named: Column, cap: int, seed: int) -> DataFrame:
    """Per class: rows, named and unnamed values, counts per place, measure statistics, years and
    at most ``cap`` sampled points. Places and points are JSON text of bounded size."""
    both = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    base = df.filter(F.col(cls).isNotNull())
    s = base.groupBy(cls).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.when(named, F.col(name))).alias("n_named"),
        F.count_if(F.col(name).isNull()).alias("n_unnamed"), F.min(measure).alias("measure_min"), F.max(measure).alias("measure_max"),
        F.count(measure).alias("measure_n"), F.min(year).alias("year_min"), F.max(year).alias("year_max"),
        F.count_if(both).alias("n_with_coords"), (F.count_if(both) > cap).alias("points_capped"))
    med = exact_quantiles(base, [cls], [measure], [0.5]).select(cls, F.col("value").alias("measure_median"))
    counts = base.filter(F.col(place).isNotNull()).groupBy(cls, place).agg(F.count(F.lit(1)).alias("_n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col(place).alias("k"), F.col("_n").alias("v"))))  # one entry per place
    places = counts.groupBy(cls).agg(F.to_json(F.map_from_entries(F.transform(order, lambda e: F.struct(e["k"], e["v"])))).alias("places"))
    sample = hash_first(base.filter(both), cls, id_col, cap, seed)
    point = F.struct("k", F.array(F.bround(lat, 5), F.bround(lon, 5)).alias("p"))
    points = sample.groupBy(cls).agg(F.to_json(F.transform(F.sort_array(F.collect_list(point)), lambda e: e["p"])).alias("points"))  # cap entries
    return s.join(med, cls, "left").join(places, cls, "left").join(points, cls, "left")


def near_points(df: DataFrame, x: str, y: str, label: str, centres: DataFrame, radius: float) -> DataFrame:
    """Label counts within a radius of named centres (columns ``name, cx, cy``).

    Points and centres meet in square cells of side ``radius`` (a centre covers the nine cells
    around it), an equi-join instead of all pairs.
    """
    pts = df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(label).alias(label),
                    F.floor(F.col(x) / radius).alias("_i"), F.floor(F.col(y) / radius).alias("_j"))
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda a: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    c = centres.select("name", "cx", "cy", around.alias("_o")).select(
        "name", "cx", "cy", (F.floor(F.col("cx") / radius) + F.col("_o.a")).alias("_i"), (F.floor(F.col("cy") / radius) + F.col("_o.b")).alias("_j"))
    near = pts.join(c, ["_i", "_j"]).filter(
        (F.col("_x") - F.col("cx")) * (F.col("_x") - F.col("cx")) + (F.col("_y") - F.col("cy")) * (F.col("_y") - F.col("cy")) <= radius * radius)
    return near.groupBy("name", label).agg(F.count(F.lit(1)).alias("n"))


def class_table(splits: DataFrame, scores: DataFrame, positions: DataFrame, cls: str) -> DataFrame:
    """Per class: train and test counts, F1 and median map position."""
    n = splits.groupBy(cls).agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    return n.join(scores, cls, "left").join(positions, cls, "left").orderBy(cls)


def atlas_table(placed: DataFrame, key: str, columns: list[str], present: DataFrame, params: dict[str, str]) -> DataFrame:
    """Every id with position, labels, availability and the map parameters."""
    have = present.select(key).distinct().withColumn("_here", F.lit(True))
    out = placed.select(key, "x", "y", *columns).join(have, key, "left")
    return out.select(key, "x", "y", *columns, F.coalesce("_here", F.lit(False)).alias("available"),
                      *[F.lit(v).alias(f"param_{k}") for k, v in params.items()])


def evidence_rows(runs: DataFrame, top3: DataFrame, receipts: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """For each run: its first guesses, receipts, numbers and a formatted sentence.

    ``top3``: key, ``top3`` array of (label, score). ``receipts``: key, rank, neighbour, label,
    similarity. ``settings`` is one row. A run whose id has no evidence gives no row.
    """
    entry = F.struct("rank", F.format_string("%s (%s, cosine %s)", F.col("neighbour").cast("string"), F.col("label").cast("string"), fixed_text("similarity", 3)).alias("t"))
    r = receipts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), "; ").alias("receipts"))  # k entries
    guess = F.array_join(F.transform("top3", lambda s: F.format_string("%s %s", s["label"].cast("string"), fixed_text(s["score"], 3))), ", ")
    out = runs.join(top3.select(key, guess.alias("top3")), key).join(r, key)
    names = settings.columns
    out = out.withColumn("_s", settings.select(F.struct(*names)).scalar()).select("*", *[F.col(f"_s.{c}").alias(c) for c in names]).drop("_s")
    text = F.format_string(
        "%s labelled %s; target %s: P = %s over %d masks, baseline %s; first guesses %s; receipts %s",
        F.col(key).cast("string"), F.col("truth").cast("string"), F.col("target").cast("string"), fixed_text("p_full", 3), F.col("n_masks"),
        fixed_text("baseline", 3), F.col("top3"), F.col("receipts"))
    return out.withColumn("sentence", text)


def place_shares(df: DataFrame, cls: str, place: str) -> DataFrame:
    """Rows per class and place with the share of the largest place of the class."""
    counts = df.filter(F.col(place).isNotNull()).groupBy(cls, place).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy(cls)))  # a window over counts
