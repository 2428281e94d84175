"""Connected components of cells over many tiles: a frame is labelled tile by tile, and what touches across borders is joined.

Each task labels one tile; only cells on tiles' edges meet their neighbours in a join; the parts that touch are a small graph, which
is contracted in rounds (every part takes the least label of its neighbours, then its label's label), each cut off by a
checkpoint. A component is named by its first cell in rows, as y * 2^32 + x, so names do not depend on the tiles.

cells: frame, x, y (whole, not negative) and whatever a star is measured by; repeated cells are one. Neighbours are the eight around a cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.operators import registration as R
from nightloom.sources.store import checkpoints

ROW = 1 << 32


def _parts(cells: DataFrame, tile: int) -> DataFrame:
    """frame, x, y, part: components within tiles."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows.x.to_numpy(np.int64), rows.y.to_numpy(np.int64)
        x0, y0 = key[2] * tile, key[1] * tile
        mask = np.zeros((tile, tile), bool)
        mask[y - y0, x - x0] = True
        first = R.label(mask)[y - y0, x - x0] - 1  # the component's first cell in the tile
        return pd.DataFrame({"frame": key[0], "x": x, "y": y, "part": (first // tile + y0) * ROW + first % tile + x0})

    t = cells.select(F.col("frame").cast("long").alias("frame"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    t = t.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    return t.groupBy("frame", "ty", "tx").applyInPandas(run, "frame long, x long, y long, part long")


def contract(edges: DataFrame) -> DataFrame:
    """frame, part, label: the least part that each part of edges (frame, a, b) reaches."""
    both = edges.union(edges.select("frame", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select("frame", F.col("a").alias("part"), F.col("a").alias("label")).distinct()
    while True:
        near = both.join(labels.select("frame", F.col("part").alias("b"), F.col("label").alias("l")), ["frame", "b"]).groupBy("frame", F.col("a").alias("part")).agg(F.min("l").alias("l"))
        new = labels.join(near, ["frame", "part"]).select("frame", "part", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        up = new.select("frame", F.col("part").alias("label"), F.col("label").alias("further"))
        new = new.join(up, ["frame", "label"], "left").select("frame", "part", F.coalesce("further", "label").alias("label"), (F.coalesce("further", "label") != F.col("old")).alias("moved")).checkpoint()
        labels = new.select("frame", "part", "label")
        if not new.where("moved").head(1):
            return labels


def label_cells(cells: DataFrame, tile: int = 256) -> DataFrame:
    """frame, x, y, component of every cell."""
    checkpoints(cells.sparkSession)
    parts = _parts(cells, tile).checkpoint()
    edge = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    rim = parts.where(edge("x") | edge("y"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))]))  # the other four meet from the other side
    away = rim.select("frame", "x", "y", F.col("part").alias("a"), steps.alias("s")).select("frame", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "a")
    edges = away.join(rim.withColumnRenamed("part", "b"), ["frame", "x", "y"]).where("a <> b").select("frame", "a", "b").distinct()
    labels = contract(edges)
    return parts.join(labels, ["frame", "part"], "left").select("frame", "x", "y", F.coalesce("label", "part").alias("component"))


def star_moments(cells: DataFrame, tile: int = 256, least: int = R.LEAST_PIXELS, most: int = R.MOST_PIXELS) -> DataFrame:
    """frame, component, n, flux, x, y, hfr, eccentricity of components with a usable number of cells and light.

    cells: frame, x, y, w: the light of a pixel above its background, of pixels above the threshold."""
    c = cells.select(F.col("frame").cast("long").alias("frame"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "w").join(label_cells(cells, tile), ["frame", "x", "y"])
    key = ["frame", "component"]
    s = c.groupBy(*key).agg(F.count("*").alias("n"), F.sum("w").alias("flux"), F.sum(F.col("x") * F.col("w")).alias("wx"), F.sum(F.col("y") * F.col("w")).alias("wy"))
    s = s.where(F.col("n").between(least, most) & (F.col("flux") > 0)).select(*key, "n", "flux", (F.col("wx") / F.col("flux")).alias("mx"), (F.col("wy") / F.col("flux")).alias("my"))
    d = c.join(s, key).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    m = lambda e: F.sum(F.col("w") * e)
    d = d.groupBy(*key, "n", "flux", "mx", "my").agg(m(F.hypot("dx", "dy")).alias("r"), m(F.col("dx") * F.col("dx")).alias("xx"), m(F.col("dx") * F.col("dy")).alias("xy"), m(F.col("dy") * F.col("dy")).alias("yy"))
    a, b, e = F.greatest(F.lit(0.0), F.col("xx") / F.col("flux")), F.col("xy") / F.col("flux"), F.greatest(F.lit(0.0), F.col("yy") / F.col("flux"))
    root = F.sqrt(F.pow((a - e) / 2, 2) + b * b)
    d = d.withColumns({"major": (a + e) / 2 + root, "minor": F.greatest(F.lit(0.0), (a + e) / 2 - root)})
    return d.select(*key, "n", "flux", F.col("mx").alias("x"), F.col("my").alias("y"), (F.col("r") / F.col("flux")).alias("hfr"), F.when(F.col("major") > 0, F.sqrt(1 - F.col("minor") / F.col("major"))).otherwise(1.0).alias("eccentricity"))
