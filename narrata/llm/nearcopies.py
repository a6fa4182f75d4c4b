"""SimHash near copies by five words: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Multi-index hashing, as in ``simhash``, with a fingerprint wide enough for that similarity: it is cut
into SEGMENTS, the ball round a segment flips the bits that are least certain in this text (those near
copies differ in), texts that meet in a point of their balls are candidates, and for each candidate
the complete distance and then the exact similarity are verified.

Of two texts of similarity 0.8 a bit differs with a chance of 0.15 and a ball point is shared in one of
24 segments with 0.97; of similarity 0.85 with 0.999 (simulated; the README has recall on given tables).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import bounded_broadcast, column, cut
from narrata.llm.simhash import components

#: Words of a shingle; a link needs LINK[0] / LINK[1] of the united shingles in both texts.
SHINGLE, LINK = 5, (4, 5)
#: Segments of the fingerprint, bits of a segment, and bits of it that the ball flips in all combinations.
#: Segments of b bits suit about 2^b texts: unrelated texts share a point with a chance of 64 * 24 / 2^28.
SEGMENTS, BITS, BALL = 24, 28, 3
#: Differing bits of the whole fingerprint from which a candidate isn't looked at: four deviations beyond the mean at 0.8.
MOST_BITS = 138
#: Texts of a ball point up to which each pair is a candidate at once.
CROWD = 4
#: Shingles of a crowd's base that are told one by one, and steps from a text to the base of its base.
PLACES, JUMPS = 1024, 2
#: Lists that the points of a crowded text are dealt into.
LISTS = 8
#: Rows of hashes and ids, a few dozen bytes each, up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000
#: Shingles whose bits are counted at a time.
_STEP = 1 << 12

_HASHES = -(-SEGMENTS * BITS // 64)
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = (1 << BITS) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles_of(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order.

    Words are those of ``simhash``. A text of fewer words than a shingle is one shingle.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    grams = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n])
    return np.unique(grams)


def segments_of(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint's segments, each a long: its bits, then the places of its BALL least certain bits, five bits each.

    A bit of the fingerprint is set if it is set in over half of the shingles' hashes; it is the less
    certain the nearer to half. None for a text without words.
    """
    if not len(shingles):
        return np.empty(0, np.int64)
    set_in = np.zeros(64 * _HASHES, np.int64)
    for begin in range(0, len(shingles), _STEP):
        hashes = _mixed(shingles[begin : begin + _STEP, None] * _MULTIPLIERS)
        set_in += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    margins = (2 * set_in - len(shingles))[: SEGMENTS * BITS].reshape(SEGMENTS, BITS)
    out = ((margins > 0).astype(np.int64) << np.arange(BITS)).sum(1)
    doubt = np.argpartition(np.abs(margins) * BITS + np.arange(BITS), BALL - 1, axis=1)[:, :BALL]
    return out | (np.sort(doubt, axis=1) << (BITS + 5 * np.arange(BALL))).sum(1)


def _sketches(texts: pd.Series) -> pd.DataFrame:
    found = [shingles_of(t) for t in texts]
    nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
    return pd.DataFrame({"node": nodes, "segments": [segments_of(s) for s in found]})


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles_of(t).view(np.int64) for t in texts], dtype="object")


def _ball(segment: Column, which: Column) -> Column:
    """The points of the ball round a segment, told apart by the segment's number above its bits."""
    points = [segment.bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftleft(which.cast("long"), BITS))]
    for k in range(BALL):
        flip = F.expr(f"shiftleft(1L, cast(shiftright(segment, {BITS + 5 * k}) & 31 as int))")
        points += [p.bitwiseXOR(flip) for p in points]
    return F.array(*points)


def _bits(x: str, y: str) -> Column:
    """In how many bits two complete fingerprints differ."""
    bits = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]).bitwiseAND(F.lit(_MASK))) for i in range(SEGMENTS)]
    return sum(bits[1:], bits[0])


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs (a, b)`` whose complete fingerprints are near enough, with their distance in bits."""
    of_a = nodes.select(F.col("node").alias("a"), F.col("segments").alias("x"))
    of_b = nodes.select(F.col("node").alias("b"), F.col("segments").alias("y"))
    met = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", _bits("x", "y").alias("bits"))
    return met.where(F.col("bits") <= MOST_BITS)


def _similar(both: Column, x: Column, y: Column) -> Column:
    """Whether sets of x and y shingles with ``both`` in common are similar enough, in whole numbers."""
    part, whole = LINK
    return both * (part + whole) >= (x + y) * part


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs (a, b)`` whose sets are similar enough."""
    met = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(_similar(both, F.size("x"), F.size("y"))).select("a", "b")


def _held(shingles: pd.Series, of_base: pd.Series) -> pd.DataFrame:
    """What a text has of its base: bits of the base's first PLACES shingles, the number of the others, and what the text has beyond it."""
    out = []
    for own, base in zip(shingles, of_base):
        has = np.isin(base, own, assume_unique=True)
        bits = np.packbits(np.pad(has[:PLACES], (0, -len(has[:PLACES]) % 64)), bitorder="little").view(np.int64)
        out.append((bits, int(has[PLACES:].sum()), np.setdiff1d(own, base, assume_unique=True)))
    return pd.DataFrame(out, columns=["held", "rest", "beyond"])


def _crowd_facts(many: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, size, base, held, rest, shared, sharable)`` of crowded texts, which bound what any two have in common.

    Texts are written as what they hold of a base and what they have beyond it, so that rows are in
    proportion to what tells the texts of a crowd apart. The base is the least head, then its least
    head and so on, a few steps, so that the texts of a crowd have few bases; which one it is decides
    no result. ``shared``: how many shingles beyond the base any other crowded text has. Two texts of one base have in
    common what both hold of it, and of the others no more than either's ``rest`` and ``shared``; any two no more
    than either's ``sharable``.
    """
    base = cut(many.groupBy("node").agg(F.min("head").alias("base")))
    for _ in range(JUMPS):
        further = base.select(F.col("node").alias("h_node"), F.col("base").alias("h_base"))
        base = cut(base.join(further, F.col("base") == F.col("h_node")).select("node", F.col("h_base").alias("base")))
    # Cut, so that the join deals out both sides anew and Spark can split a base with a great many texts.
    own = cut(base.join(sets, "node"))
    whole = cut(base.select(F.col("base").alias("h_node")).distinct().join(sets.select(F.col("node").alias("h_node"), F.col("shingles").alias("of_base")), "h_node"))
    met = own.join(whole, F.col("base") == F.col("h_node"))
    known = cut(met.select("node", "base", F.size("shingles").alias("size"), F.pandas_udf(_held, "held array<long>, rest int, beyond array<long>")("shingles", "of_base").alias("h")).select("node", "base", "size", "h.*"))
    # A base's own shingles have a holder beside any text that has them beyond another base.
    each = known.select("node", F.explode("beyond").alias("shingle"), F.lit(False).alias("based")).union(whole.select("h_node", F.explode("of_base"), F.lit(True)))
    holders = each.groupBy("shingle").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.max("based").alias("based"))
    alone = holders.where("least = most and not based").groupBy("least").agg(F.count(F.lit(1)).alias("alone"))
    facts = known.join(alone, F.col("node") == F.col("least"), "left").withColumn("shared", (F.size("beyond") - F.coalesce("alone", F.lit(0))).cast("int"))
    return facts.select("node", "size", "base", "held", "rest", "shared", (F.col("size") - F.size("beyond") + F.col("shared")).alias("sharable"))


def _most_common() -> Column:
    """How many shingles a text and the text of the columns ``b_*`` can have in common at most."""
    both = [F.coalesce(F.bit_count(F.get("held", F.lit(i)).bitwiseAND(F.get("b_held", F.lit(i)))), F.lit(0)) for i in range(PLACES // 64)]
    of_base = sum(both[1:], both[0]) + F.least("rest", "b_rest") + F.least("shared", "b_shared")
    return F.when(F.col("base") == F.col("b_base"), of_base).otherwise(F.least("sharable", "b_sharable"))


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with ``root``, the component of the node so far."""
    known = roots.select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
    return rows.join(known, F.col("node") == F.col("r_node"), "left").withColumn("root", F.coalesce("r_root", "node")).drop("r_node", "r_root")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _connected(nodes: DataFrame, texts: DataFrame, crowd: int) -> DataFrame:
    """``(node, root)`` of nodes with a link: the components over all candidates that are similar enough.

    Points that up to ``crowd`` texts share give each pair. In a larger crowd pairs would grow with its
    square: there each text first meets the point's head, the least text of it, of all its heads the
    one that it shares most points with and the least one. Then whatever lies outside a crowd's largest component meets the texts of
    the crowd in other components, so no candidate that could join two components is left out, but for
    those that have too few shingles in common (see :func:`_crowd_facts`), an exact bound.
    """
    members = nodes.select("node", F.posexplode("segments").alias("which", "segment"))
    members = members.select("node", F.explode(_ball(F.col("segment"), F.col("which"))).alias("point"))
    sizes = members.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1").withColumnRenamed("point", "s_point")
    shared = cut(members.join(sizes, F.col("point") == F.col("s_point")).select("node", "point", "n", "head"))
    few, many = shared.where(F.col("n") <= crowd), shared.where(F.col("n") > crowd)
    other = few.select(F.col("node").alias("b"), F.col("point").alias("b_point"))
    pairs = few.join(other, F.col("point") == F.col("b_point")).where("node < b").select(F.col("node").alias("a"), "b").distinct()
    headed = many.where("node != head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"))
    best = headed.groupBy("node").agg(F.min_by("head", F.struct(-F.col("n"), "head")).alias("nearest"), F.min("head").alias("least"))
    best = best.select(F.col("node").alias("a"), F.explode(F.array("nearest", "least")).alias("b"))
    first = cut(_ordered(_near(pairs, nodes).select("a", "b").union(best)))
    # The exact sets of all texts that are compared now or, in crowds, later; each text is read for it once.
    asked = first.select(F.col("a").alias("node")).union(first.select("b")).union(many.select("node")).distinct()
    wanted = cut(asked.join(nodes.select("node", F.col("text_hash").alias("w_hash")), "node"))
    read = texts.join(bounded_broadcast(wanted, BROADCAST_ROWS), F.col("text_hash") == F.col("w_hash")).dropDuplicates(["node"])
    sets = cut(read.select("node", F.pandas_udf(_sets, "array<long>")("text").alias("shingles")))
    links = cut(_verified(first, sets))
    roots = components(links)
    if many.isEmpty():
        return roots
    facts = _labelled(_crowd_facts(many, sets), roots)
    # A text's points go along as a few lists, so that what is known of it is joined to those and not to each point.
    listed = many.groupBy("node", F.pmod("point", F.lit(LISTS)).alias("list")).agg(F.collect_list("point").alias("points"))
    rows = cut(listed.join(bounded_broadcast(cut(facts), BROADCAST_ROWS), "node").select(F.explode("points").alias("point"), *facts.columns))
    of_root = rows.groupBy("point", "root").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    main = of_root.groupBy("point").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots"), F.min("size").alias("least_size"))
    main = main.where("roots > 1").select(F.col("point").alias("m_point"), F.col("m.root").alias("m_root"), "least_size")
    able = _similar(F.col("sharable"), F.col("size"), F.col("least_size"))
    open_rows = cut(rows.join(main, (F.col("point") == F.col("m_point")) & able).withColumn("outside", F.col("root") != F.col("m_root")).drop("m_point", "m_root", "least_size"))
    outside = open_rows.where("outside")
    # Only points that someone outside still asks about go on.
    asked_points = outside.select(F.col("point").alias("a_point")).distinct()
    against = open_rows.join(asked_points, F.col("point") == F.col("a_point"), "left_semi")
    against = against.select(*(F.col(c).alias(f"b_{c}") for c in against.columns))
    # All of it is the join's own condition: pairs that can't be similar, or are compared from the other side, are no rows.
    apart = (F.col("root") != F.col("b_root")) & (~F.col("b_outside") | (F.col("node") < F.col("b_node")))
    likely = _similar(_most_common(), F.col("size"), F.col("b_size"))
    met = outside.join(against, (F.col("point") == F.col("b_point")) & apart & likely)
    later = cut(_verified(_ordered(met.select(F.col("node").alias("a"), F.col("b_node").alias("b"))), sets))
    # The first round's components stand for its links, so that the second starts from stars.
    return roots if later.isEmpty() else components(later.union(roots))


def near_copies_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``docs`` with exactly one row of each component of near copies.

    The row of the least id stays, null ids last; of equal ids the least hash of the text, then of the
    whole row. Rows with a null id and rows that share an id are rows like any other. Null texts and
    texts without words are copies of one another; an empty table gives an empty result.

    Hot groups: texts with the same shingles are one node from the start, and see :func:`_connected`.
    """
    columns = docs.columns
    row = F.xxhash64(*map(column, columns), *(column(c).isNull() for c in columns))
    keyed = docs.withColumns({"_narrata_text": F.xxhash64(text_col), "_narrata_row": row})
    facts = keyed.select(
        F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_narrata_text").alias("text_hash"), F.col("_narrata_row").alias("row")).alias("best"),
        F.pandas_udf(_sketches, "node long, segments array<long>")(F.col(text_col)).alias("s"),
    )
    found = cut(facts.select("best", "s.*"))
    nodes = cut(found.groupBy("node").agg(F.min("best").alias("best"), F.first("segments").alias("segments")).withColumn("text_hash", F.col("best.text_hash")))
    texts = keyed.select(F.col("_narrata_text").alias("text_hash"), F.col(text_col).alias("text"))
    label = _labelled(nodes.select("node", "best"), _connected(nodes, texts, crowd))
    kept = label.groupBy("root").agg(F.min("best").alias("k")).select(F.col("k.id").alias("_narrata_id"), F.col("k.row").alias("_narrata_kept"))
    same = (F.col("_narrata_row") == F.col("_narrata_kept")) & F.col(id_col).eqNullSafe(F.col("_narrata_id"))
    return keyed.join(bounded_broadcast(cut(kept), BROADCAST_ROWS), same, "left_semi").dropDuplicates(["_narrata_row"]).select(*map(column, columns))
