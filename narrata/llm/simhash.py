"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints that differ in at most three
bits differ in at most one bit of one segment, so the ball of radius one round a segment, looked up
among the segments of the table, finds all links; complete distances are verified after.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import bounded_broadcast, cut

#: Words of a shingle, bits of a link, and the seed of the shingle hash.
SHINGLE, MOST_BITS, SEED = 3, 3, 42
#: Fingerprints of a segment value from which links go over common midpoints instead of pairs.
CROWD = 256
#: Rows of a table of crowded segments that may be broadcast (16 bytes each).
BROADCAST_ROWS = 200_000
#: Shingles whose bits are counted at a time.
_STEP = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The SimHash of a text, as a signed 64-bit integer; 0 for a text without words or null.

    Words are runs of anything but ASCII white space, with A-Z lowered. A bit is set if it is set in
    over half of the XXH64 values of the three-word shingles, repeats included.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))), len(words) - SHINGLE + 1
    set_in = np.zeros(64, np.int64)
    for begin in range(0, n, _STEP):
        count = min(_STEP, n - begin)
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for _, s in zip(range(count), shingles)), "<u8", count)
        set_in += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    """:func:`fingerprint_of` for a column."""
    return F.pandas_udf(_fingerprints, "long")(text)


def _segment(fp: Column, which: int) -> Column:
    """Segment 0 (high half) or 1 (low half), told apart by a bit above its 32."""
    half = F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return half.bitwiseOR(F.lit(which << 32))


def _cleared(segment: str) -> Column:
    """The segment values that lack one of its bits.

    Of two segments that differ in one bit, one lacks a bit that the other has, so clearing bits alone
    covers the ball of radius one, in half the look-ups.
    """
    return F.expr(f"filter(transform(sequence(0, 31), b -> if((shiftright({segment}, b) & 1L) = 1L, {segment} - shiftleft(1L, b), null)), x -> x is not null)")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints such that linked fingerprints, and only these, are connected.

    ``prints`` has one row a distinct fingerprint, ``fp``. Segment values of up to ``crowd``
    fingerprints give each verified pair. In a larger one pairs would grow with its square: there each
    fingerprint names the points near it, and is linked to one fingerprint next to each point, which
    connects the same fingerprints with a number of rows in proportion to theirs.
    """
    members = prints.select("fp", F.explode(F.array(_segment(F.col("fp"), 0), _segment(F.col("fp"), 1))).alias("segment"))
    asked = members.select("fp", "segment", F.explode(F.concat(F.array("segment"), _cleared("segment"))).alias("bucket"))
    asked = asked.select("bucket", F.col("fp").alias("a"), (F.col("segment") == F.col("bucket")).alias("own"))
    table = members.select(F.col("segment").alias("bucket"), F.col("fp").alias("b"))
    crowded = cut(table.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("bucket"))
    none = crowded.isEmpty()
    if not none:
        known = bounded_broadcast(crowded, BROADCAST_ROWS)
        sparse_asked, sparse_table = asked.join(known, "bucket", "left_anti"), table.join(known, "bucket", "left_anti")
    else:
        sparse_asked, sparse_table = asked, table
    near = _distance(F.col("a"), F.col("b")) <= MOST_BITS
    pairs = sparse_asked.join(sparse_table, "bucket").where(near & (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))).select("a", "b")
    if none:
        return pairs
    return pairs.unionByName(_crowded_links(asked.join(known, "bucket", "left_semi")))


def _crowded_links(asked: DataFrame) -> DataFrame:
    """Links in crowded buckets over midpoints of the other segment.

    Members of a bucket (``own``) may differ in three bits of the other segment: some point is within
    one bit of one and within two of the other. A fingerprint that lacks a bit may differ in two: some
    point is within one bit of both. So whoever names a point is linked to the least member within
    one bit of it; all links are within three bits.
    """
    # The other segment of the fingerprint, as its low 32 bits; the bucket says which one that is.
    rest = F.when(F.shiftright("bucket", 32) == 0, F.col("a").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("a", 32))
    rows = asked.select("bucket", "a", "own", rest.alias("rest"))
    flips1 = "transform(sequence(0, 31), i -> shiftleft(1L, i))"
    flips2 = "flatten(transform(sequence(1, 31), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    flips = F.expr(f"concat(array(0L), {flips1}, if(own, {flips2}, array()))")
    named = rows.select("bucket", "a", "own", "rest", F.explode(flips).alias("flip"))
    named = named.select("bucket", "a", (F.col("own") & (F.bit_count("flip") <= 1)).alias("close"), F.col("rest").bitwiseXOR(F.col("flip")).alias("point"))
    heads = named.where("close").groupBy("bucket", "point").agg(F.min("a").alias("b"))
    return named.join(heads, ["bucket", "point"]).where("a != b").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the undirected edges ``(a, b)``; the root is the least node reachable.

    Alternates large and small stars (Kiveris et al., Connected Components in MapReduce and Beyond,
    2014) till only stars are left. Each round is a pre-aggregated minimum and a join on the node, which
    Spark can split where a node has a great many neighbours; the lineage is cut after each round.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: u, v. Large: each node sends its larger neighbours to its least one. Small: its smaller ones.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # Cut, so that the join deals out both sides anew and Spark can split a node with a great many neighbours.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m")))
        met = both.join(least, both["u"] == least["w"])
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        to_least = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return to_least.unionByName(least.where("w != m").select(F.col("w").alias("u"), F.col("m").alias("v")))

    def settled(e: DataFrame) -> bool:
        # Stars round their least nodes: no u has two edges or is some v. One pre-aggregated pass instead of a round that changes nothing.
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.where("up > 1 or up + down > 1").agg(F.count(F.lit(1))).first()[0] == 0

    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not settled(edges):
        edges = cut(star(star(edges, True), False).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Per document its fingerprint (16 hex digits) and ``component_id``, the least id it is linked to over any path.

    Fingerprints link at MOST_BITS or fewer differing bits. Texts are read and hashed once, where they
    lie; from then on rows are an id and a fingerprint, and links are between distinct fingerprints,
    so copies of a text meet in a pre-aggregated minimum and never in pairs.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows give
    repeated results; a document with a null id gets the least id of its component (null if it has
    none). Extra columns are ignored; an empty table gives an empty result.
    """
    hashed = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")))
    prints = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(prints.select("fp"), crowd))
    label = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = label.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = label.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return hashed.join(named, hashed["fp"] == named["of_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
