"""ST4 for clients of any size: windows of the rate limiter by links that are composed, not by a fold over a client's
requests.

A window opens with a client's first request, and again with the first one more than `seconds` after it opened. So every
request has one link, to the request that would open the next window if it had opened one; windows open where the chain
of links from the first request leads. Requests fall into buckets of `seconds`: a link ends in the next bucket or at the
head of a later one, and a bucket has one opening at most. Marks double their reach each round, as links are composed
with themselves, so the rounds are the logarithm of the most windows that a client has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.operators.sessions import RATE, RATE_SECONDS
from clausewright.sources.shared import cut


def _links(rows: DataFrame, width: int) -> DataFrame:
    """(client, node, next): node and next are (at, event_id)."""
    node = F.struct("at", "event_id")
    # In a bucket, its requests and the ends of windows that the requests before it would have opened.
    data = rows.select("client", "bucket", "at", F.lit(0).alias("kind"), node.alias("node"))
    ends = rows.select("client", (F.col("bucket") + 1).alias("bucket"), (F.col("at") + width).alias("at"), F.lit(1).alias("kind"), node.alias("node"))
    after = Window.partitionBy("client", "bucket").orderBy("at", "kind", "node").rowsBetween(1, Window.unboundedFollowing)
    found = data.unionByName(ends).withColumn("near", F.min(F.when(F.col("kind") == 0, F.col("node"))).over(after)).filter("kind = 1")
    # One row a bucket: a client has as many as its time has minutes, whatever its requests.
    heads = rows.groupBy("client", "bucket").agg(F.min(node).alias("head"))
    later = Window.partitionBy("client").orderBy("bucket")
    one, two = (F.lead(F.struct("bucket", "head"), k).over(later) for k in (1, 2))
    heads = heads.select("client", (F.col("bucket") + 1).alias("bucket"), F.when(one["bucket"] > F.col("bucket") + 1, one["head"]).otherwise(two["head"]).alias("far"))
    return found.join(heads, ["client", "bucket"]).select("client", "node", F.coalesce("near", "far").alias("next"))


def openings(requests: DataFrame, seconds: float = RATE_SECONDS) -> DataFrame:
    """requests (client, event_id, at in microseconds, bucket) to (client, node) of those that open windows."""
    jumps = cut(_links(requests, int(seconds * 1_000_000)).filter("next IS NOT NULL"))
    marked = cut(requests.groupBy("client").agg(F.min(F.struct("at", "event_id")).alias("node")))
    size = marked.count()
    while True:
        reached = marked.join(jumps, ["client", "node"]).select("client", F.col("next").alias("node"))
        marked = cut(marked.unionByName(reached).distinct())
        before, size = size, marked.count()
        if size == before:
            return marked
        further = jumps.select("client", F.col("node").alias("next"), F.col("next").alias("_then"))
        jumps = cut(jumps.join(further, ["client", "next"]).select("client", "node", F.col("_then").alias("next")))


def rate_windows(requests: DataFrame, client: str = "user_id", most: int = RATE, seconds: float = RATE_SECONDS) -> DataFrame:
    """rate_decisions() by links: requests (client, event_id, ts) with `allowed`. event_id tells requests of a client
    apart. A client with all rows is as many tasks as others: nothing gathers more of it than what falls into one window.
    Null clients are one client."""
    width = int(seconds * 1_000_000)
    named = requests.select(F.col(client).alias("_name"), F.coalesce(F.concat(F.lit("c"), F.col(client).cast("string")), F.lit("")).alias("client"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = named.withColumn("bucket", F.floor(F.col("at") / width).cast("long"))
    starts = openings(rows.drop("_name"), seconds).select("client", F.floor(F.col("node.at") / width).cast("long").alias("bucket"), F.col("node").alias("opens"))
    own, before = starts.withColumnRenamed("opens", "_own"), starts.select("client", (F.col("bucket") + 1).alias("bucket"), F.col("opens").alias("_before"))
    met = rows.join(own, ["client", "bucket"], "left").join(before, ["client", "bucket"], "left")
    opened = F.when(F.col("_own") <= F.struct("at", "event_id"), F.col("_own")).otherwise(F.col("_before"))
    within = Window.partitionBy("client", "_opened").orderBy("at", "event_id")
    return met.withColumn("_opened", opened).withColumn("allowed", F.row_number().over(within) <= most).select(F.col("_name").alias("client"), "event_id", "allowed")
