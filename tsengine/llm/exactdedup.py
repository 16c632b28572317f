"""Exact deduplication with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import table

#: Digests held by more than this share of the rows take the broadcast path, so at most
#: 1 / SUPPORT digests (about 100 bytes each) are ever broadcast.
SUPPORT = 0.001


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Which row stays of each group of equal texts.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]. The row with
    the most code points stays, then the smallest doc_id, then the row read first (so of
    repeated rows one stays); a null doc_id comes after all others.

    Misra-Gries counters (`freqItems`) give every digest above `support`; an exact
    aggregate verifies their winners, which are broadcast, so rows of these groups never
    meet in one task. All other digests are shuffled and ranked.

    Null text counts as empty; empty texts form one group; an empty table gives an empty
    result. Columns other than doc_id and text are ignored."""
    if not 1e-5 <= support < 1:
        raise ValueError("support must be at least 1e-5, which bounds the broadcast")
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = table(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256)).alias("digest"),
            F.struct(
                (-F.length(text)).alias("neg_len"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")
            ).alias("rank"),
        ),
        "digests",
    )
    frequent = digests.select(F.hex("digest").alias("d")).freqItems(["d"], support).select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("digest"))
    frequent = table(frequent, "frequent")
    winners = table(
        digests.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("group_size")), "winners"
    )
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(frequent), "digest", "left_anti").withColumns({"best": F.min("rank").over(group), "group_size": F.count(F.lit(1)).over(group)})
    out = [
        F.col("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("group_size"),
        (F.col("rank.row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    return heavy.select(*out).unionAll(rest.select(*out))
