"""Parent chains to their end, by pointer doubling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

c = F.col


def parent_chains(nodes: DataFrame, scope: list[str], separator: str = " > ") -> DataFrame:
    """``scope``, node, name, root, path, depth and is_cyclic of every node, whatever the depth.

    ``nodes`` has the columns of ``scope``, node, parent and name, with one row for each node. A parent that is null, the
    node itself or no node of the scope ends the chain. Each round joins a node's covered stretch with that of the node
    above it, so it doubles, and writes the rows down: the rounds are the logarithm of the depth. An open chain whose next node is
    done ends in that round; a round that closes none leaves only chains that run into a cycle. Those are reported with
    is_cyclic and stand as roots of their own: root and path are their own name, depth 0.
    """
    spark = nodes.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/daybook-chains-{uuid.uuid4().hex}"

    def written(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{base}/{step}")
        return spark.read.schema(df.schema).parquet(f"{base}/{step}")

    known = nodes.select(*scope, c("node").alias("parent"), F.lit(True).alias("is_known"))
    up = F.when(c("is_known") & (c("parent") != c("node")), c("parent"))
    walk = written(nodes.select(*scope, "node", "parent", "name").join(known, [*scope, "parent"], "left").select(
        *scope, "node", "name", up.alias("up"), c("name").alias("root"), c("name").alias("path"), F.lit(0).cast("bigint").alias("depth")), 0)
    before, step = None, 0
    while (left := walk.filter("up IS NOT NULL").count()) not in (0, before):
        before, step = left, step + 1
        above = walk.select(*scope, c("node").alias("up"), c("up").alias("next"), c("root").alias("top"), c("path").alias("over"), c("depth").alias("more"))
        joined = walk.filter("up IS NOT NULL").join(above, [*scope, "up"]).select(
            *scope, "node", "name", c("next").alias("up"), c("top").alias("root"), F.concat("over", F.lit(separator), "path").alias("path"),
            (c("depth") + c("more") + 1).alias("depth"))
        walk = written(walk.filter("up IS NULL").unionByName(joined), step)
    loops = c("up").isNotNull()
    return walk.select(*scope, "node", "name", F.when(loops, c("name")).otherwise(c("root")).alias("root"), F.when(loops, c("name")).otherwise(c("path")).alias("path"),
                       F.when(loops, F.lit(0)).otherwise(c("depth")).cast("bigint").alias("depth"), loops.alias("is_cyclic"))
