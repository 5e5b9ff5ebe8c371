"""Embedding near-duplicates by collision-counting projections.

Equal vectors of a label are one class with a weight. A label's classes are split into cells by the signs of random
projections, in several orders with projections of their own: as many signs, and then as many orders, as bring all but
SPLIT_MISS of the pairs at the threshold into one cell at the least cost. Few classes are one cell; of many, each class
meets some hundreds in each order, so the work grows little faster than their number. A cell is sorted by a further
projection and cut into blocks; linked vectors differ by a bounded amount there, so only blocks within that reach meet.

In a pair of blocks each of PROJECTIONS one-dimensional projections is a line: for each query the vectors in the window
around it collide, collisions are counted per pair, and pairs with enough are verified by cosine in double precision.
Window and count follow from the threshold: the projections of a pair at the threshold differ by a normal variable of
known spread, so the binomial count passes MISS short of always. A pair counts in the first order in which it shares a
cell. Links are returned as counts and as stars of each block pair, never as all pairs.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing, nor does one
with a null label; vectors of different lengths do not link; repeated rows count as vectors of their own; a null vec_id
takes part but names no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, comb, erf, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, components, frugal, running_total, stars

THRESHOLD = 0.93
PROJECTIONS = 32
#: The window around a query, in standard deviations of the difference of a pair at the threshold, and the share of such pairs that may be missed.
WINDOW, MISS = 2.0, 1e-7
#: The share of pairs at the threshold that no order may bring together, and the most signs and orders.
SPLIT_MISS, MOST_SIGNS, MOST_ORDERS = 1e-6, 24, 250
#: Costs in compared pairs, as measured: of a row in an order, and of a cell.
ROW_COST, CELL_COST = 300, 40_000
BLOCK = 1024


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    """(dim, PROJECTIONS + 1) normal directions, the same on every machine; the last one, of length 1, sorts the blocks."""
    out = np.random.default_rng(dim).standard_normal((dim, PROJECTIONS + 1))
    out[:, -1] /= np.linalg.norm(out[:, -1])
    return out


@lru_cache(maxsize=4)
def hyperplanes(dim: int, order: int) -> np.ndarray:
    """(dim, MOST_SIGNS) normal directions whose signs split the cells of an order."""
    return np.random.default_rng([dim, order, 1]).standard_normal((dim, MOST_SIGNS))


def splits(n: int, threshold: float) -> tuple[int, int]:
    """(signs, orders) of the least cost for ``n`` classes."""
    best = (n / 2, 0, 1)
    for signs in range(1, MOST_SIGNS + 1):
        together = (1 - acos(threshold) / pi) ** signs
        orders = ceil(log(SPLIT_MISS) / log(1 - together))
        cell = max(n / 2**signs, 1)
        if orders <= MOST_ORDERS:
            best = min(best, (orders * (cell / 2 + CELL_COST / cell + ROW_COST), signs, orders))
    return best[1:]


def least_count(miss: float = MISS) -> int:
    """The most collisions that a pair at the threshold reaches but for ``miss`` of the cases."""
    p, below = erf(WINDOW / sqrt(2)), 0.0
    for k in range(PROJECTIONS + 1):
        below += comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if below > miss:
            return k
    return PROJECTIONS


def spread(threshold: float) -> float:
    """The distance of unit vectors whose cosine is the threshold."""
    return sqrt(2 - 2 * threshold)


def links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (doubles) with a cosine of at least the threshold.

    Places on a line are whole steps of a sixty-fourth of the window, which is widened by a step: a collision on two
    16-bit lines is one subtraction and one comparison, for all pairs of the block at once.
    """
    unit = [x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b)]
    reach = WINDOW * spread(threshold) * (1 + 1e-9)
    # Beyond the ends of 16 bits nothing of a unit vector's projections is found (over 100 standard deviations).
    lines = [np.floor(np.clip(x @ directions(a.shape[1])[:, :-1] * (64 / reach), -16_000, 16_000)).astype(np.int16) for x in unit]
    counts = np.zeros((len(a), len(b)), np.uint8)
    for left, right in zip(lines[0].T, lines[1].T):
        counts += (left[:, None] + np.int16(65) - right).view(np.uint16) <= 130
    u, v = np.nonzero(counts >= least_count())
    cosine = np.einsum("ij,ij->i", a[u], b[v]) / (np.linalg.norm(a[u], axis=1) * np.linalg.norm(b[v], axis=1))
    good = cosine >= threshold
    return u[good], v[good]


def meet(threshold: float):
    """applyInPandas function over one pair of blocks: (cid, n, other), links counted by weight, and star edges."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["_side"] == s] for s in (0, 1)]
        same = not len(sides[1])
        a, b = sides[0], sides[0] if same else sides[1]
        x, y = (np.array(s["embedding"].tolist(), float).reshape(len(s), -1) for s in (a, b))
        u, v = links(x, y, threshold)
        if same:
            u, v = u[u < v], v[u < v]
        order = int(rows["order"].iat[0])
        if order:  # what shares a cell in an earlier order has been found there
            cells = [np.frombuffer(b"".join(s["cells"]), np.int32).reshape(len(s), -1)[:, :order] for s in (a, b)]
            new = ~(cells[0][u] == cells[1][v]).any(axis=1)
            u, v = u[new], v[new]
        ids = [s["cid"].to_numpy()[k] for s, k in ((a, u), (b, v))]
        weights = [s["weight"].to_numpy()[k] for s, k in ((b, v), (a, u))]
        nodes, roots = stars(*ids) if len(u) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        counted = pd.DataFrame({"cid": np.concatenate(ids), "n": np.concatenate(weights)}).groupby("cid", as_index=False)["n"].sum()
        return counted.merge(pd.DataFrame({"cid": nodes, "other": roots}), on="cid", how="left").astype({"cid": "int64", "n": "int64", "other": "int64"})

    return run


def in_orders(classes: DataFrame) -> DataFrame:
    """Each class (label, dim, cid, weight, embedding, signs, orders) once in each order: order, cell, the cells of all orders, and the place on the last line."""
    kind, label = (classes.schema[c].dataType.simpleString() for c in ("embedding", "label"))
    names = ["label", "dim", "order", "cell", "_line", "cid", "weight", "embedding", "cells"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for (dim, signs, orders), rows in whole.groupby(["dim", "signs", "orders"]):
                x = np.array(rows["embedding"].tolist(), float).reshape(len(rows), -1)
                x /= np.linalg.norm(x, axis=1)[:, None]
                powers = 1 << np.arange(signs, dtype=np.int32)
                cells = np.stack([((x @ hyperplanes(int(dim), k)[:, :signs] > 0) @ powers).astype(np.int32) if signs else np.zeros(len(x), np.int32) for k in range(orders)], axis=1)
                rows = rows.assign(_line=x @ directions(int(dim))[:, -1], cells=[c.tobytes() for c in cells])
                for k in range(orders):
                    yield rows.assign(order=k, cell=cells[:, k])[names]

    return classes.mapInPandas(frugal(run), f"label {label}, dim int, order int, cell int, _line double, cid long, weight long, embedding {kind}, cells binary")


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark, "embeddings")
    numbers = F.col("embedding").cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(numbers, lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    name = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>")))
    keyed = vectors.select("vec_id", "label", "embedding", F.when(usable, name).alias("_name"))
    classes = keyed.where("_name IS NOT NULL").groupBy("_name").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))

    # Numbered as they are written, so that numbers stay.
    numbered = scratch.save(classes.withColumns({"dim": F.size("embedding"), "cid": F.monotonically_increasing_id()}), "numbered")
    sizes = numbered.groupBy("label", "dim").agg(F.count("*").alias("n"))

    def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            plans = [splits(n, threshold) for n in rows["n"].tolist()]
            yield rows[["label", "dim"]].assign(signs=[p[0] for p in plans], orders=[p[1] for p in plans])

    label = classes.schema["label"].dataType.simpleString()
    plan = scratch.save(sizes.mapInPandas(planned, f"label {label}, dim int, signs int, orders int"), "plan")
    rows = in_orders(numbered.join(plan, ["label", "dim"])).withColumn("_one", F.lit(1).cast("long"))
    group = ["label", "dim", "order", "cell"]
    placed = scratch.save(running_total(scratch, "sorted", rows, [*map(F.col, group), F.col("_line"), F.col("cid")], "_one").withColumnRenamed("_before", "_at"), "placed")
    starts = placed.groupBy(*group).agg(F.min("_at").alias("_first"))
    placed = scratch.save(placed.join(starts, group).withColumn("block", F.floor((F.col("_at") - F.col("_first")) / BLOCK)), "blocks")
    scratch.drop("sorted", "placed")
    ends = placed.groupBy(*group, "block").agg(F.min("_line").alias("low"), F.max("_line").alias("high"))
    later = ends.select(*group, F.col("block").alias("other"), F.col("low").alias("from"))
    reach = spread(threshold) * (1 + 1e-9)
    pairs = ends.join(later, group).where((F.col("other") >= F.col("block")) & (F.col("from") <= F.col("high") + reach)).select(*group, "block", "other")
    pairs = scratch.save(pairs, "pairs")
    given = [*group, "block", "other", "cid", "weight", "embedding", "cells"]
    left = placed.join(pairs, [*group, "block"]).select(*given, F.lit(0).alias("_side"))
    right = placed.withColumnRenamed("block", "other").join(pairs.where("other > block"), [*group, "other"]).select(*given, F.lit(1).alias("_side"))
    found = left.union(right).groupBy(*group, "block", "other").applyInPandas(meet(threshold), "cid long, n long, other long")
    found = scratch.save(found, "found")
    joined = components(scratch, found.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    named = numbered.join(counts, "cid", "left").join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = scratch.save(named.select("_name", "cid", "weight", "least", "component", F.coalesce("n", F.lit(0)).alias("n")), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    table = scratch.save(named.join(smallest, "component").select("_name", "component_id", (F.col("n") + F.col("weight") - 1).alias("n_links")), "classes")
    out = keyed.select("vec_id", "_name").join(table, "_name", "left")
    component = F.when(F.col("_name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def link_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: links and components of all embeddings."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


LINK_SQL = r"""
WITH RECURSIVE vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*)::BIGINT AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = id LEFT JOIN counts ON a = e.vec_id
"""
