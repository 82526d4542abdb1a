"""What changed between full snapshots: one window per key over snapshot indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import salted_join

#: Complete snapshots over all roots that are broadcast; more are joined by a salted shuffle.
MAX_BROADCAST = 100_000


def snapshot_changes(listing: DataFrame, headers: DataFrame, compare: tuple[str, ...] = ("file_id", "state")) -> DataFrame:
    """Added, removed and changed paths between consecutive complete snapshots of a root.

    listing: root, snapshot_no, path, delivered_at and the columns to compare. headers:
    root, snapshot_no, complete. Per root, snapshot and path the latest delivery counts
    (equal times: that of the greatest digest of the compared values, so the outcome is fixed). Snapshots whose
    header is missing or not complete are left out; a root's first complete one gives no
    cases; a complete one without rows removes everything. Null equals null in compared
    columns; null root or path rows are left out. Returns root, snapshot_no, path, change.

    Complete snapshots of a root are numbered 1, 2, ... Each key is windowed once by that
    index: lag of the digest shows a change, a gap in the index shows a removal and a
    later addition. One shuffle by key serves deduplication and window alike.
    """
    per_root = Window.partitionBy("root").orderBy("snapshot_no")
    index = (
        headers.where("root IS NOT NULL AND snapshot_no IS NOT NULL")
        .groupBy("root", "snapshot_no")
        .agg(F.max("complete").alias("complete"))
        .where("complete")
        .select("root", "snapshot_no", F.row_number().over(per_root).alias("idx"), F.lead("snapshot_no").over(per_root).alias("next_no"))
    )
    few = index.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    digest = F.xxhash64(*[c for x in compare for c in (F.col(x).isNull(), F.coalesce(F.col(x).cast("string"), F.lit("")))])
    listed = listing.where("path IS NOT NULL").select("root", "snapshot_no", "path", F.struct("delivered_at", digest.alias("digest")).alias("v"))
    if few:
        known = listed.join(F.broadcast(index), ["root", "snapshot_no"])
    else:
        both = F.when(F.col("root").isNotNull() & F.col("snapshot_no").isNotNull(), F.struct("root", "snapshot_no")).alias("of")
        known = salted_join(listed.select("path", "v", both), index.select(both, "idx", "next_no"), "of").select("of.*", "path", "v", "idx", "next_no")
    rows = (
        known.repartition("root", "path")
        .groupBy("root", "path", "idx", "snapshot_no", "next_no")
        .agg(F.max("v").alias("v"))
    )
    per_key = Window.partitionBy("root", "path").orderBy("idx")
    seen = rows.select("root", "path", "idx", "snapshot_no", "next_no", F.col("v.digest").alias("digest"), F.lag("idx").over(per_key).alias("before"), F.lag("v.digest").over(per_key).alias("was"), F.lead("idx").over(per_key).alias("after"))
    follows = F.col("before") == F.col("idx") - 1
    here = F.when((F.col("idx") > 1) & (F.col("before").isNull() | ~follows), "added").when(follows & (F.col("was") != F.col("digest")), "changed")
    gone = F.col("next_no").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("idx") + 1))
    events = F.array(F.struct(F.col("snapshot_no").alias("no"), here.alias("change")), F.struct(F.col("next_no").alias("no"), F.when(gone, "removed").alias("change")))
    return seen.select("root", "path", F.explode(events).alias("e")).where("e.change IS NOT NULL").select("root", F.col("e.no").cast("long").alias("snapshot_no"), "path", F.col("e.change").alias("change"))
