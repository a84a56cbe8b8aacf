"""Connected components by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions

#: Links that a task handles.
LINKS_EACH = 50_000


def tasks_for(rows: int, most: int) -> int:
    """Tasks for so many links: few links in as many tasks as there are shuffle partitions are files and little else, in every exchange of every round."""
    return max(1, min(most, -(-rows // LINKS_EACH)))


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id in links (a, b), the smallest id that it is linked to, itself included.

    Each round points every id's larger neighbours at its smallest one, then every id's smaller
    neighbours (and itself) likewise, until nothing changes: a logarithmic number of rounds in practice.
    Self links give their id a row; rows with a null end are left out; an empty input gives no rows.
    An id with very many neighbours is aggregated map-side (min) and never collected.
    Each round is checkpointed, so that a lost executor costs one round at most. Links that are stars around the smallest ids
    already, as the operators send them, settle in the first round. Tasks follow the number of links, which no round adds to.
    """
    most = partitions(links.sparkSession)
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    given = checkpoint(ends.distinct())
    tasks = tasks_for(given.count(), most)
    given = given.coalesce(tasks)
    ids = given.select(F.col("u").alias("id")).union(given.select("v")).distinct()
    edges, before = given.where("u <> v"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, tasks = state, tasks_for(state[0], most)
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        edges = checkpoint(small)
    return ids.join(edges.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
