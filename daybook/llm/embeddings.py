"""Near-duplicate vectors by collision counting over sorted projections.

Vectors of a label meet in buckets of random half-spaces, in enough tables that a pair at the threshold shares one with
the recall asked for. In a bucket every vector is projected on many lines; on each line the vectors are sorted and a
window centred on the query is counted as a collision with every vector in it. Pairs with enough collisions, a count
calibrated so that pairs at the threshold reach it, are verified by cosine in double precision.

Equal vectors are one. A pair is counted in the first table that it shares, so links add up over tables without a list
of pairs; for components a bucket gives one edge for each vector. Buckets over ``block`` vectors are split into blocks
that meet two by two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import staged
from daybook.llm.graph import components


def calibrated(m: int, cosine: float, recall: float, width: float = 1.5) -> tuple[float, int]:
    """(half width of a window, collisions asked for): a pair at the threshold has so many of m with the chance ``recall``."""
    p, tail = math.erf(width / math.sqrt(2)), 0.0
    for c in range(m, -1, -1):
        tail += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if tail >= recall:
            return width * math.sqrt(2 - 2 * cosine), c
    return width * math.sqrt(2 - 2 * cosine), 0


def tables_for(largest: int, cosine: float, recall: float, bucket: int = 16) -> tuple[int, int]:
    """(bits of a key, tables): buckets of about ``bucket`` unrelated vectors, enough tables for the recall."""
    bits = min(30, max(1, round(math.log2(max(2, largest / bucket)))))
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def collisions(x: np.ndarray, lines: np.ndarray, half: float) -> np.ndarray:
    """Collisions of each pair of rows of x, over windows centred on each row's projection."""
    count = np.zeros((len(x), len(x)), np.int16)
    for line in (x @ lines).T:
        order = np.argsort(line, kind="stable")
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        low, high = np.searchsorted(line[order], line - half, "left"), np.searchsorted(line[order], line + half, "right")
        count += (rank >= low[:, None]) & (rank < high[:, None])
    return count


def _joined(x: np.ndarray, keys: np.ndarray, table: int, block: np.ndarray, across: bool, lines: np.ndarray, half: float, least: int, cosine: float):
    """Boolean matrix of the verified pairs of one bucket that have no earlier table in common."""
    a, b = np.nonzero(np.triu(collisions(x, lines, half) >= least, 1))
    if across:
        a, b = (v[block[a] != block[b]] for v in (a, b))
    for i in range(table):
        first = keys[a, i] != keys[b, i]
        a, b = a[first], b[first]
    ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
    out = np.zeros((len(x), len(x)), bool)
    out[a[ok], b[ok]] = out[b[ok], a[ok]] = True
    return out


def join(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.998, lines: int = 32, block: int = 512, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Rows of one label (not null) link at a cosine of at least ``cosine``. Vectors that are null, empty, zero, hold null or
    non-finite components, or differ in length from the label's other ones at most link with nothing or their like. Equal
    rows link with each other. A null vec_id is never a component's id unless it is alone. No rows give no rows.
    """
    spark: SparkSession = vectors.sparkSession
    v = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("label").isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = staged(vectors.select("vec_id", "label", v.alias("v"), sound.alias("sound")).select(
        "vec_id", "label", "v", F.size("v").alias("d"), F.when(F.col("sound"), F.xxhash64("label", "v")).alias("cid")), "vectors")
    classes = staged(rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("weight"), F.min(F.struct("label", "d", "v")).alias("one")).select(
        "cid", "weight", F.xxhash64("one.label", "one.d").alias("room"), "one.d", "one.v"), "vector-classes")
    largest = classes.groupBy("room").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables = tables_for(largest, cosine, recall)
    half, least = calibrated(lines, cosine, 1 - (1 - recall) / 2)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys = np.zeros((len(f), tables), np.int32)
            for d in f.d.unique():
                i = np.flatnonzero(f.d.to_numpy() == d)
                planes = np.random.default_rng([seed, int(d), 1]).standard_normal((int(d), tables * bits))
                side = (np.stack(f.v.to_numpy()[i]) @ planes > 0).reshape(len(i), tables, bits)
                keys[i] = side @ (1 << np.arange(bits))
            yield f.assign(keys=list(keys))[["cid", "weight", "room", "d", "v", "keys"]]

    held = staged(classes.mapInPandas(keyed, "cid long, weight long, room long, d int, v array<double>, keys array<int>"), "keyed-vectors")
    spots = held.select("cid", "room", F.posexplode("keys").alias("t", "key"))
    sizes = spots.groupBy("room", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # A bucket of several blocks sends each vector to every pair of blocks with its own.
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = spots.join(sizes, ["room", "t", "key"]).select("cid", "room", "t", "key", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    met = dealt.select("cid", "room", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own").join(held.drop("room"), "cid")
    group = ["room", "t", "key", "i", "j"]

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions: dict[int, np.ndarray] = {}

        def one(g: pd.DataFrame) -> pd.DataFrame | None:
            d = int(g.d.iloc[0])
            if d not in directions:
                directions[d] = np.random.default_rng([seed, d, 2]).standard_normal((d, lines))
            x = np.stack(g.v.to_numpy())
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            near = _joined(x, np.stack(g["keys"].to_numpy()), int(g.t.iloc[0]), g.own.to_numpy(), g.i.iloc[0] != g.j.iloc[0], directions[d], half, least, cosine)
            if not near.any():
                return None
            cid = g.cid.to_numpy()
            root, at = cid.copy(), None
            while at is None or (root != at).any():  # smallest id in reach inside the bucket
                at = root
                root = np.minimum(at, np.where(near, at[None, :], np.iinfo(np.int64).max).min(axis=1))
            some = near.any(axis=1)
            return pd.DataFrame({"cid": cid[some], "root": root[some], "links": (near @ g.weight.to_numpy())[some]})

        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            new = np.flatnonzero((f[group].to_numpy()[1:] != f[group].to_numpy()[:-1]).any(axis=1)) + 1
            cuts = [0, *new.tolist()]
            rest = f.iloc[cuts[-1] :]
            out = [r for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 and (r := one(f.iloc[a:b])) is not None]
            if out:
                yield pd.concat(out)
        if rest is not None and len(rest) > 1 and (r := one(rest)) is not None:
            yield r

    found = staged(met.repartition(*group).sortWithinPartitions(*group).mapInPandas(verified, "cid long, root long, links long"), "vector-links")
    parts = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    judged = classes.select("cid", "weight").join(links, "cid", "left").join(parts, F.col("cid") == F.col("node"), "left").select(
        "cid", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("part"))
    told = rows.select("vec_id", "cid").join(judged, "cid", "left")
    least_id = told.where("part is not null").groupBy("part").agg(F.min("vec_id").alias("component_id"))
    return told.join(least_id, "part", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
