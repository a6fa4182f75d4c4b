"""Sharding: rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one window partition of the slot numbering holds on average.
ROWS_PER_RUN = 20_000


def score(key: Column, shard: int, weight: float) -> Column:
    """The claim of one shard on a key: ``weight / -ln(u)`` with ``u`` in (0, 1) from a hash of both.

    A shard with twice the weight wins twice the keys. ``u`` has 53 bits, and the half added keeps it
    from 0 and 1.
    """
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return F.lit(float(weight)) / -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53)))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose claim on the key is greatest; of equal claims the lowest shard's."""
    claims = [F.struct(score(key, i, w).alias("claim"), F.lit(-i).alias("rank")) for i, w in enumerate(weights)]
    return -(F.greatest(*claims) if len(claims) > 1 else claims[0])["rank"]


def rendezvous_shards(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    added_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Put every row of ``docs`` into a shard that its key and the weights alone decide.

    ``grown_shard`` is the shard with one more shard of ``added_weight``: a row either stays or goes
    to the new shard. ``slot`` numbers the rows of a shard without gaps from 0.

    The slot numbering never brings a shard together: rows are numbered inside runs of about
    ``ROWS_PER_RUN`` rows (shard and a hash of the row), and a run starts where the runs before it
    end, which needs only a table of run sizes. The text itself isn't shuffled.

    A null text counts as no bytes (size 1, crc 0), a null key is a key of its own; repeated rows
    share a shard and get slots of their own; an empty table gives an empty result. Columns of
    ``docs`` other than key and text are ignored.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    # Runs have to be of bounded size at any input size, so their number follows the row count.
    runs = max(1, -(-docs.select(F.lit(1)).count() // (ROWS_PER_RUN * len(weights))))
    named = F.col("doc_id")
    shard = winner(named, weights)
    placed = rows.select("*", shard.cast("int").alias("shard")).select(
        "*",
        F.when(score(named, len(weights), added_weight) > _claim(named, F.col("shard"), weights), F.lit(len(weights)))
        .otherwise(F.col("shard"))
        .cast("int")
        .alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(runs)).cast("int").alias("run"),
    )
    run = Window.partitionBy("shard", "run")
    numbered = placed.withColumn("at", F.row_number().over(run.orderBy("doc_id", "size", "text_crc32")).cast("long") - 1)
    sizes = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    # One row a run, so a shard's sizes are summed in one task even at 10^11 rows (10^6 runs a shard).
    starts = sizes.select(
        F.col("shard").alias("of_shard"),
        F.col("run").alias("of_run"),
        (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("start"),
    )
    return numbered.join(starts, (F.col("shard") == F.col("of_shard")) & (F.col("run") == F.col("of_run"))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard",
    )


def _claim(key: Column, shard: Column, weights: Sequence[float]) -> Column:
    """The claim of the shard in a column."""
    claim = F.lit(None).cast("double")
    for i, w in enumerate(weights):
        claim = F.when(shard == i, score(key, i, w)).otherwise(claim)
    return claim
