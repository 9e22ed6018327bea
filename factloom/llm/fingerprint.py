"""Homomorphic multiset hash of documents.

A paragraph hashes to a wide vector: four lanes of its own SHA-256, 56 bits each, and 64 lanes that each add one bit of the hash of every
shingle of the paragraph, up to three words. A document's fingerprint is the sum of its paragraphs' vectors modulo
powers of two. So the order of paragraphs doesn't matter, a paragraph is inserted or deleted by adding or subtracting its
vector, and equal multisets of paragraphs have equal fingerprints. The bit lanes are random signs: their products
estimate the inner product of two documents' shingle counts, which gives a likeness.

Everything is SQL expressions. A document's shingles are rows only inside the task that holds it: the sums go on in the
same stage, and what leaves it is one vector for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import shuffle_partitions, whole_text

WIDE, PARTS = 2**56, 4  # of the lanes of whole paragraphs
LANES, MODULUS = 64, 2**24  # of the lanes of shingles' bits; the count of shingles has as much room


def paragraph_lanes(text: Column) -> Column:
    """The first PARTS lanes: sums of slices of the SHA-256 of a text's paragraphs modulo WIDE, which don't follow from each other."""
    def add(sums: Column, x: Column) -> Column:
        digest = F.sha2(x, 256)
        return F.array(*(F.pmod(sums[i] + F.conv(F.substring(digest, 14 * i + 1, 14), 16, 10).cast("long"), F.lit(WIDE)) for i in range(PARTS)))

    return F.aggregate(F.split(text, "\n"), F.array(*(F.lit(0).cast("long") for _ in range(PARTS))), add)


def shingles(text: Column, words: int = 3) -> Column:
    """All runs of up to ``words`` words that begin at a word of a paragraph, the last ones shorter; never across paragraphs."""
    def of(line: Column) -> Column:
        parts = F.split(line, " ")
        return F.arrays_zip(*(F.slice(parts, i + 1, F.size(parts)).alias(f"w{i}") for i in range(words)))

    return F.flatten(F.transform(F.split(text, "\n"), of))


def lane_sums(unit: str) -> list[Column]:
    """Two lanes in each long, 32 bits apart, so that 32 sums hold 64 lanes; and the count."""
    spread = (1 << 32) | 1
    return [F.sum(F.shiftrightunsigned(unit, i).bitwiseAND(F.lit(spread))).alias(f"s{i}") for i in range(LANES // 2)] + [F.count(unit).alias("n")]


def lanes() -> Column:
    """The lanes as 64 sums of signs modulo MODULUS, from the columns of lane_sums()."""
    low = [F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(LANES // 2)]
    high = [F.shiftrightunsigned(f"s{i}", 32) for i in range(LANES // 2)]
    return F.array(*(F.pmod(2 * F.coalesce(x, F.lit(0)) - F.col("n"), F.lit(MODULUS)) for x in low + high))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint after inserting (sign 1) or deleting (-1) the paragraphs of ``b``; fingerprints as arrays."""
    def at(x: Column, y: Column, modulus: int) -> Column:
        return F.pmod(x + sign * y, F.lit(modulus))

    wide = F.zip_with(F.slice(a, 1, PARTS), F.slice(b, 1, PARTS), lambda x, y: at(x, y, WIDE))
    return F.concat(wide, F.zip_with(F.slice(a, PARTS + 1, LANES), F.slice(b, PARTS + 1, LANES), lambda x, y: at(x, y, MODULUS)))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the shingle counts of two fingerprints as their lanes estimate it, from 0 to 1; 1 for equal fingerprints."""
    signed = lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("double")
    x, y = (F.transform(F.slice(v, PARTS + 1, LANES), signed) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    near = F.least(F.greatest(F.when(norms > 0, dot(x, y) / norms).otherwise(0.0), F.lit(0.0)), F.lit(1.0))
    return F.when(a == b, 1.0).otherwise(near)


def written(fingerprint: Column) -> Column:
    """A fingerprint as hexadecimal text of a fixed width."""
    wide = F.transform(F.slice(fingerprint, 1, PARTS), lambda x: F.lpad(F.lower(F.hex(x)), 14, "0"))
    return F.array_join(F.concat(wide, F.transform(F.slice(fingerprint, PARTS + 1, LANES), lambda x: F.lpad(F.lower(F.hex(x)), 6, "0"))), "")


def summed(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``print``, the fingerprint of each row's ``text`` as an array; the keys tell rows apart."""
    wide = [f"_p{i}" for i in range(PARTS)]
    rows = texts.select(*keys, "text", paragraph_lanes(F.col("text")).alias("_p")).select(*keys, "text", *(F.get("_p", F.lit(i)).alias(w) for i, w in enumerate(wide)))
    units = rows.select(*keys, *wide, F.explode_outer(shingles(F.col("text"))).alias("_u"))
    hashed = units.select(*keys, *wide, F.xxhash64("_u.w0", "_u.w1", "_u.w2").alias("_h"))
    sums = hashed.groupBy(*keys).agg(*(F.max(w).alias(w) for w in wide), *lane_sums("_h"))  # numbers only: a hash aggregate
    return sums.select(*keys, F.concat(F.array(*wide), lanes()).alias("print"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, print: each row's fingerprint. Null text is empty; repeated rows stay; extra columns are left out."""
    keyed = docs.select("doc_id", whole_text().alias("text"), F.monotonically_increasing_id().alias("_row"))
    return summed(keyed, ["doc_id", "_row"]).drop("_row")


def with_successor(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, next_text and bucket of each row; the order is (doc_id, hash of the text), and the first follows the last.

    Rows are dealt into buckets of about the same number along the order, so that no task holds all of them; the first
    document of a bucket goes to the one before as well (``guest``), and closes it.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    edges = rows.select(F.percentile_approx("doc_id", [i / buckets for i in range(buckets + 1)], 100 * buckets).alias("e")).first().e or []
    cuts = sorted(set(edges[1:-1]))
    groups = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[::groups]
    parts = [cuts[i : i + groups] for i in range(0, len(cuts), groups)]
    if cuts:
        # Two short scans instead of one over all cuts: which stretch of cuts, then which cut of the stretch.
        stretch = F.size(F.filter(F.array(*(F.lit(c) for c in coarse)), lambda c: F.col("doc_id") >= c))
        within = F.get(F.array(*(F.array(*(F.lit(c) for c in p)) for p in parts)), F.col("_s") - 1)
        inside = F.size(F.filter(within, lambda c: F.col("doc_id") >= c))
        bucket = F.when(F.col("_s") == 0, 0).otherwise((F.col("_s") - 1) * groups + inside)
        rows = rows.withColumn("_s", F.coalesce(stretch, F.lit(0))).withColumn("bucket", F.coalesce(bucket, F.lit(0))).drop("_s")
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "_h")).alias("f")).orderBy("bucket").collect()  # a row for each bucket
    before = {}
    for i, r in enumerate(firsts):
        before[(r.f.doc_id, r.f._h)] = firsts[i - 1].bucket
    if not before:
        return rows.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"), "bucket", F.lit(False).alias("guest"), F.lit(0).cast("long").alias("place"))
    spark = docs.sparkSession
    heads = spark.createDataFrame([(k[0], k[1], b) for k, b in before.items()], "doc_id long, _h long, _to int")
    met = rows.join(F.broadcast(heads), [rows["doc_id"].eqNullSafe(heads["doc_id"]), rows["_h"] == heads["_h"]], "left").select(rows["doc_id"], "text", "bucket", rows["_h"], "_to")
    homes = met.select("doc_id", "text", "_h", F.explode(F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("guest")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("guest")))))).alias("home"))
    homes = homes.select("doc_id", "text", "_h", "home.bucket", "home.guest")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "_h")
    return homes.withColumns({"next_text": F.lead("text").over(order), "place": F.row_number().over(order).cast("long")}).drop("_h")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text has its last quarter (rounded down) replaced by as many first characters of the next document, or all
    of them. One document is its own successor. Rows of one id follow each other in the order of their texts' hashes;
    null ids come first; equal rows stay apart.
    """
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    rows = with_successor(docs.select("doc_id", "text"), buckets)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - quarter), F.substring(F.coalesce("next_text", F.lit("")), 1, quarter))
    rows = rows.select("bucket", "place", "guest", "doc_id", "text", F.when(~F.col("guest"), edited).alias("edited"))
    keys = ["bucket", "place", "guest", "doc_id"]
    both = rows.select(*keys, n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.coalesce("edited", F.lit("")).alias("text")))).alias("v"))
    keyed = both.select(*keys, "n_chars", "edited_sha256", "v.which", "v.text")
    prints = summed(keyed, [*keys, "n_chars", "edited_sha256", "which"])
    order = Window.partitionBy("bucket").orderBy("place", "which")
    seen = prints.withColumns({"edited_print": F.lead("print", 1).over(order), "next_print": F.lead("print", 2).over(order)}).where((F.col("which") == 0) & ~F.col("guest"))
    return seen.select("doc_id", "n_chars", "edited_sha256", written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
