"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of ``SEGMENTS`` segments. If two of them
differ in at most t bits, some segment starts a chain whose first l segments differ
in at most floor(l * t / SEGMENTS) bits together, for every l (the pigeonring
principle). For t = 3 and eight segments the budgets are 0 0 1 1 1 2 2 3: the chain's
first two segments agree, and of the next three at most one differs. That gives the
candidate keys: start, the agreeing segments, and which of the budget-one segments is
left out; 8 x 3 keys of 32 bits each. Pairs that share a key pass the whole chain of
budgets before their link counts; its last step is the full Hamming distance.

Only distinct fingerprints are compared. A link joins representatives; documents of
one fingerprint share its component. Components come from rounds of large-star and
small-star on the links, each cut by a checkpoint.

Defined cases: a null or empty text has no word and fingerprint 0, which links like
any other; rows with a null doc_id belong to a component but never name it, unless no
member has an id (then its id is null); repeated rows share a fingerprint; an empty
table gives an empty result; other columns are ignored by :func:`components` and
carried by :func:`representatives`, which needs them orderable.

Scale: fingerprints are computed once and checkpointed (two longs a row). A hot
fingerprint is one row after pre-aggregation, and its documents meet the result by
:func:`common.attach`. The candidate join runs in the JVM and emits verified links
only; its work grows with the number of *different* fingerprints on one 32-bit key,
and Spark's skew join splits a key that holds many.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import attach, checkpointed, small_batches
from ledgerlens.llm.fingerprints import SHINGLE, fingerprint_udf

MAX_BITS = 3
SEGMENTS = 8
WIDTH = 64 // SEGMENTS


def _budgets(max_bits: int) -> list[int]:
    return [n * max_bits // SEGMENTS for n in range(1, SEGMENTS + 1)]


def _key_masks(max_bits: int) -> list[int]:
    """Bits of a fingerprint, turned so that the chain starts at its top, that make up each kind of key."""
    budgets = _budgets(max_bits)
    zero, one = budgets.count(0), budgets.count(1)
    byte = lambda j: ((1 << WIDTH) - 1) << (64 - WIDTH * (j + 1))
    exact = sum(byte(j) for j in range(zero))
    loose = range(zero, zero + one)
    return [exact + sum(map(byte, held)) for held in combinations(loose, max(one - 1, 0))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _turn(x: Column, bits: Column) -> Column:
    """Rotate to the left; the JVM takes shifts modulo 64."""
    return F.call_function("shiftleft", x, bits).bitwiseOR(F.call_function("shiftrightunsigned", x, 64 - bits))


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct ``fp`` (long) -> links (a, b), a < b, of fingerprints that differ in 1 to ``max_bits`` bits."""
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"max_bits must be 0 to {SEGMENTS - 1}")
    starts = F.array(*[F.lit(i * WIDTH) for i in range(SEGMENTS)])
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(_key_masks(max_bits))])
    turned = fingerprints.select("fp", F.explode(starts).alias("start")).withColumn("ring", _turn(F.col("fp"), F.col("start")))
    keyed = turned.select("fp", "start", "ring", F.explode(kinds).alias("k")).select(
        F.struct("start", "k.kind", F.col("ring").bitwiseAND(F.col("k.mask")).alias("bits")).alias("key"), "fp", "ring")
    keyed = keyed.select("key.start", "key.kind", "key.bits", "fp", "ring")
    left, right = keyed.withColumnsRenamed({"fp": "a", "ring": "ring_a"}), keyed.withColumnsRenamed({"fp": "b", "ring": "ring_b"})
    x = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    chain = F.col("a") < F.col("b")
    for n, budget in enumerate(_budgets(max_bits), 1):
        head = F.lit(_signed(((1 << 64) - 1) ^ ((1 << (64 - WIDTH * n)) - 1)))
        chain = chain & (F.bit_count(x.bitwiseAND(head)) <= budget)
    return left.join(right, ["start", "kind", "bits"]).where(chain).select("a", "b").distinct()


def star_roots(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root) for every node of an edge; root: the least node of its component.

    Large-star points a node's larger neighbours at its least neighbour, small-star the others and
    itself; both keep components whole, and when neither changes an edge every component is a star.
    """
    def both_ways(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")

    def point(near: DataFrame, keep: Column) -> DataFrame:
        least = near.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least")).withColumnRenamed("u", "w")
        return near.join(least, F.col("u") == F.col("w")).where(keep).select(F.col("least").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("least").alias("a"), F.col("w").alias("b"))).where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = checkpointed(edges)
    seen = mark(edges)
    while seen[0]:
        large = point(both_ways(edges), F.col("v") > F.col("u"))
        # after large-star every edge points from a larger node to a smaller one
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        edges = checkpointed(point(down, F.lit(True)))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _named(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """docs -> per row: doc_id, h (hash of the text), fp, best.

    ``best`` is the component's first row, (no id, doc_id, h), or null for a row that is alone.
    """
    marked = checkpointed(small_batches(docs).select("doc_id", F.xxhash64("text").alias("h"), fingerprint_udf(shingle)("text").alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    classes = marked.groupBy("fp").agg(first.alias("best"), F.count(F.lit(1)).alias("n"))
    # one row per fingerprint that has a link: its root
    stars = star_roots(links(classes.select("fp"), max_bits))
    roots = checkpointed(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()))
    joined = classes.join(roots, F.col("fp") == F.col("node"))
    linked = joined.drop("best").join(joined.groupBy("root").agg(F.min("best").alias("best")), "root").select("fp", "best", "n")
    alone = classes.where("n > 1").join(roots, F.col("fp") == F.col("node"), "left_anti").select("fp", "best", "n")
    return attach(marked, checkpointed(linked.unionByName(alone)), "fp", "n")


def components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs(doc_id, text) -> one row per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    own = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best")["doc_id"])
    return _named(docs, shingle, max_bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own.alias("component_id"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component its first row (least doc_id, rows without one last, then the
    least text hash), once, with all columns as they came. Texts cross the network once."""
    def key(h: Column) -> Column:
        # nulls are left out of the JSON, so no id equals a null one
        return F.to_json(F.struct("doc_id", h.alias("h")))

    same = (F.col("doc_id").isNull() == F.col("best")["no_id"]) & F.col("doc_id").eqNullSafe(F.col("best")["doc_id"]) & (F.col("h") == F.col("best")["h"])
    gone = _named(docs, shingle, max_bits).where(F.col("best").isNotNull() & ~same).select(key(F.col("h")).alias("gone")).distinct()
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    left = docs.select(key(F.xxhash64("text")).alias("key"), row.alias("row")).join(gone, F.col("key") == F.col("gone"), "left_anti")
    # rows repeated with one doc_id and text: the least by its other columns stays
    return left.groupBy("key").agg(F.min("row").alias("row")).select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
