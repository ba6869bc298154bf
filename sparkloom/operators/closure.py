"""Everything that can be reached along the edges of a table, by rounds over what the last round found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources import shared

#: Sources that share a row of a round, a bit each.
BITS = 64


def closure(edges: DataFrame, source: str, target: str, starts: DataFrame | None = None) -> DataFrame:
    """source, target, depth: each pair that a path joins, by its fewest edges; from ``starts`` (a column of sources), or from
    all. Semi-naive: a round extends only the pairs that are new, and pairs known already are dropped, so cycles end.

    Rounds are tables in the shared folder (depth + 1 of them). A row of a round is a node with the sources of one block that
    came to it then, as bits, so an edge is walked once a round for up to 64 sources; a step is a join on the node reached, its
    long partitions split by Spark, and an aggregate with what is known. Null ends are no edges, repeated edges are one."""
    spark = edges.sparkSession
    path = shared.new_path(spark, "closure")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    step = kept(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).dropna().distinct(), "edges")
    first = step.select("s") if starts is None else step.select("s").join(starts.select(F.col(starts.columns[0]).alias("s")), "s", "left_semi")
    # ids run on within a task and are far apart between tasks: few tasks, so that blocks are full
    firsts = kept(first.distinct(), "firsts")
    numbered = firsts.coalesce(1 + firsts.count() // 100_000).withColumn("number", F.monotonically_increasing_id())
    sources = kept(numbered.select("s", F.floor(F.col("number") / BITS).alias("block"), F.pmod("number", F.lit(BITS)).cast("int").alias("bit")), "sources")
    mask = F.expr("shiftleft(1L, bit)")
    new = step.join(sources, "s").groupBy("block", "t").agg(F.bit_or(mask).alias("mask"))
    rounds: list[DataFrame] = []
    while True:
        depth = len(rounds) + 1
        rounds.append(kept(new.withColumn("depth", F.lit(depth)), f"round-{depth}"))
        if rounds[-1].isEmpty():
            break
        further = rounds[-1].select("block", F.col("t").alias("s"), "mask").join(step, "s").select("block", "t", "mask", F.lit(0).cast("long").alias("known"))
        for r in rounds:
            further = further.unionByName(r.select("block", "t", F.lit(0).cast("long").alias("mask"), F.col("mask").alias("known")))
        found = further.groupBy("block", "t").agg(F.bit_or("mask").alias("mask"), F.bit_or("known").alias("known"))
        new = found.select("block", "t", F.col("mask").bitwiseAND(F.bitwise_not("known")).alias("mask")).filter("mask <> 0")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    named = sources.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bit", "s"))).alias("names"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1)
    pairs = out.join(named, "block").select("names", "t", "depth", F.explode(bits).alias("bit"))
    return pairs.select(F.col("names")[F.col("bit")].alias(source), F.col("t").alias(target), "depth")
