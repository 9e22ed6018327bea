"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A string of 100 bytes holds 69 substrings of 32 bytes; the one of least hash is its anchor, and equal strings have equal
anchors. Runs of neighbouring strings of one anchor are stretches of some 35 strings. A stretch whose anchor occurs once, at one place,
holds nothing that repeats, which settles most of the text without sorting it. Of the others, equal stretches are settled
by their first occurrence. What remains - different stretches that share an anchor - is dealt into buckets by anchor; in
each, shards of stretches get their transforms, the transforms are merged by interleave refinement, and the blocks of
rotations that agree on 100 bytes are the strings that repeat. An anchor with very many different stretches is dealt by
the strings themselves, so no bucket grows with it.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bwt import repeated
from factloom.llm.common import discard, materialize, shared_folder, shuffle_partitions, whole_text, written_tables

_NO_ID = -(2**63)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``gram`` (a power of two) bytes."""
    mix = np.random.default_rng(11).integers(1, 2**63, size=256, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    h, width = mix[raw], 1
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * factor + h[width:]
            h ^= h >> np.uint64(29)
            factor = factor * factor | np.uint64(1)
            width *= 2
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _stretches(depth: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document lists of its stretches: anchor, start, number of strings, places of the anchor (2: two or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            raw = np.frombuffer(b"".join(texts), np.uint8)
            if not (sizes >= depth).any():
                continue
            grams, width = gram_hashes(raw, gram), depth - gram + 1
            least = sliding_least(grams, width)
            # Places that are the least of some string around them.
            most = np.concatenate([np.zeros(width - 1, least.dtype), least, np.zeros(width - 1, least.dtype)])
            ends = np.flatnonzero(~sliding_least(~most, width) == grams)
            begin = np.cumsum(sizes) - sizes
            windows = np.maximum(sizes - depth + 1, 0)
            whose = np.repeat(np.arange(len(sizes), dtype=np.int32), windows)
            offset = np.arange(len(whose)) - np.repeat(np.cumsum(windows) - windows, windows)
            value = least[begin[whose] + offset]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (whose[1:] != whose[:-1])
            at = np.flatnonzero(new)
            runs = np.diff(np.append(at, len(value)))
            # How many places in the stretch have the anchor's hash: a second one, and it can repeat within itself.
            first = begin[whose[at]] + offset[at]
            lo, hi = np.searchsorted(ends, first), np.searchsorted(ends, first + runs + width - 1)
            each = np.repeat(np.arange(len(at)), hi - lo)
            place = ends[np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]]
            places = np.bincount(each[grams[place] == value[at][each]], minlength=len(at))
            edges = pa.array(np.searchsorted(whose[at], np.arange(len(sizes) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (value[at].view(np.int64), offset[at].astype(np.int32), runs.astype(np.int32), np.minimum(places, 2).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], names=["doc_id", "anchor", "start", "n", "places"])

    return run


_HELD = pa.schema([("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("places", pa.int32()), ("bytes", pa.binary())])


def _cut(depth: int, most: int = 100_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each stretch with a hash of its bytes; where the task meets these bytes first, with the bytes. Rows come by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for b in batches:
            lists = b.column("parts")
            parts, per_doc = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            anchor, start, n, places = (parts.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            whose = np.repeat(np.arange(len(per_doc)), per_doc)
            by = np.lexsort((start, whose))
            anchor, start, n, places = anchor[by], start[by], n[by], places[by]
            raw = [t.encode() for t in b.column("text").to_pylist()]
            keys, pieces = [], []
            for doc, lo, hi in zip(whose.tolist(), start.tolist(), (start + n + depth - 1).tolist()):
                piece = raw[doc][lo:hi]
                key = hashlib.blake2b(piece, digest_size=16).digest()
                keys.append(key)
                if key in met:
                    pieces.append(None)
                    continue
                if len(met) >= most:
                    met.clear()
                met.add(key)
                pieces.append(piece)
            hashes = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[whose]
            columns = [anchor, hashes[:, 0].copy(), hashes[:, 1].copy(), ids, start, n, places]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _HELD)), pa.array(pieces, pa.binary())], schema=_HELD)

    return run


_DEALT = pa.schema([("bucket", pa.int64()), ("bytes", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64())])


def _deal(depth: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches by their anchor; those of a heavy anchor string by string, by a hash of the string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            best: dict[bytes, tuple[int, int]] = {}
            for heavy, anchor, piece, doc, start in zip(*(b.column(c).to_pylist() for c in ("heavy", "anchor", "bytes", "doc_id", "start"))):
                if not heavy:
                    rows.append((anchor % buckets, piece, doc, start))
                    continue
                for i in range(len(piece) - depth + 1):
                    one = piece[i : i + depth]
                    if one not in best or (doc, start + i) < best[one]:
                        if one in best:
                            rows.append((int.from_bytes(hashlib.blake2b(one, digest_size=7).digest()) % buckets, one, *best[one]))
                        best[one] = (doc, start + i)
                    else:
                        rows.append((int.from_bytes(hashlib.blake2b(one, digest_size=7).digest()) % buckets, one, doc, start + i))
            rows += [(int.from_bytes(hashlib.blake2b(one, digest_size=7).digest()) % buckets, one, *place) for one, place in best.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEALT)], schema=_DEALT)

    return run


_RUNS = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _merge_buckets(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        held: dict[bytes, tuple[int, int]] = {}
        later: list[tuple[int, int, int]] = []

        def found() -> pa.RecordBatch | None:
            runs = later[:]
            if held:
                places = np.array(list(held.values()), np.int64)
                runs += repeated(list(held), places[:, 0], places[:, 1], depth)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*runs)], schema=_RUNS) if runs else None

        for b in batches:
            for key, piece, doc, start in zip(*(b.column(c).to_pylist() for c in ("bucket", "bytes", "doc_id", "start"))):
                if key != bucket:
                    if (out := found()) is not None:
                        yield out
                    bucket, held, later = key, {}, []
                # Of equal stretches the first stays; the others repeat it as a whole.
                place = (doc, start)
                known = held.setdefault(piece, place)
                if known != place:
                    held[piece] = min(known, place)
                    doc, start = max(known, place)
                    later.append((doc, start, start + len(piece)))
        if (out := found()) is not None:
            yield out

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def union_of(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that intervals cover together."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(parts):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _keep(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw = text.encode()
                runs = union_of([(s["lo"], s["hi"]) for s in spans or ()])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                rest = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((doc, len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore") if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEPT)], schema=_KEPT)

    return run


def bucketed(df: DataFrame, key: str, dealt: bool = False) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder in as many buckets of ``key`` as a shuffle has partitions, and the table's name: later
    joins by the key read it in place. ``dealt``: ``df`` is partitioned so. Whoever asks for it drops the table."""
    spark = df.sparkSession
    name = f"factloom_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    with written_tables(spark):  # dealt by the key first, a task writes one file and not one for each bucket
        (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def remove_repeats(docs: DataFrame, depth: int = 100, gram: int = 32, heavy: int = 4000, bucket_bytes: int = 1 << 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining text) of each row of ``docs``.

    ``docs`` has doc_id and text (null: empty); other columns are ignored. Each byte under a string of ``depth`` bytes that
    also starts earlier, in a document of a smaller id or in the same one, is removed; strings don't cross documents. A null
    id counts as the least. Rows of one id count as one document: what they hold at the same place, all of them keep.
    ``kept`` leaves out bytes of characters that were cut.
    """
    spark = docs.sparkSession
    text = whole_text()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("t"))
    texts, name = bucketed(rows, "doc_id")
    copied = _equal_texts(texts, depth)
    parts = _shared_stretches(texts.join(copied, "doc_id", "left_anti"), depth, gram)
    held = materialize(texts.join(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_cut(depth), "anchor long, k1 long, k2 long, doc_id long, start int, n int, places int, bytes binary"))
    discard(parts)
    spans = _equal_stretches(held, depth).unionByName(_merged(held, depth, heavy, bucket_bytes)).unionByName(copied)
    spans = materialize(spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    out = texts.join(spans, "doc_id", "left").mapInArrow(_keep(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    out = out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
    out = materialize(out if with_text else out.drop("kept"), 500)
    spark.sql(f"DROP TABLE {name}")
    return out


def _equal_texts(texts: DataFrame, depth: int) -> DataFrame:
    """doc_id, lo, hi: documents whose whole text an earlier document has; nothing else needs to look at them."""
    first = materialize(texts.groupBy("t").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1"))
    later = texts.select("doc_id", "n_bytes", "t").join(first, "t").where((F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= depth))
    return materialize(later.select("doc_id", F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")).distinct())


def _shared_stretches(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """doc_id, parts: the stretches of each document whose anchor has a second place somewhere."""
    lists = "doc_id long, anchor array<long>, start array<int>, n array<int>, places array<int>"
    listed = materialize(texts.select("doc_id", "text").mapInArrow(_stretches(depth, gram), lists))
    counted = listed.select(F.explode(F.arrays_zip("anchor", "places")).alias("s")).groupBy("s.anchor").agg(F.sum("s.places").alias("places"))
    shared = counted.where("places > 1").select("anchor")
    stretches = listed.select("doc_id", F.explode(F.arrays_zip("anchor", "start", "n", "places")).alias("s")).select("doc_id", "s.*")
    parts = materialize(stretches.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n", "places")).alias("parts")))
    discard(listed)
    return parts


def _equal_stretches(held: DataFrame, depth: int) -> DataFrame:
    """doc_id, lo, hi: stretches whose bytes as a whole occur earlier."""
    same = ["anchor", "k1", "k2"]
    firsts = held.groupBy(*same).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = held.drop("bytes").join(firsts, same).where("doc_id <> first.doc_id OR start <> first.start")
    return later.select("doc_id", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("n") + depth - 1).cast("long").alias("hi"))


def _merged(held: DataFrame, depth: int, heavy: int, bucket_bytes: int) -> DataFrame:
    """doc_id, lo, hi: repeats between different stretches of one anchor, by merged transforms."""
    spark = held.sparkSession
    cut = held.where("bytes IS NOT NULL")
    key = F.struct("k1", "k2")
    tangled = cut.groupBy("anchor").agg(F.count("*").alias("pieces"), F.min(key).alias("a"), F.max(key).alias("z"), F.max("places").alias("places"), F.sum("n").alias("strings"), F.sum(F.length("bytes")).alias("size")).where("a <> z OR places > 1")
    tangled = materialize(tangled.select("anchor", (F.col("pieces") > heavy).alias("heavy"), F.when(F.col("pieces") > heavy, F.col("strings") * depth).otherwise(F.col("size")).alias("size")))
    total = tangled.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    dealt = cut.join(tangled.drop("size"), "anchor").select("heavy", "anchor", "bytes", "doc_id", "start").mapInArrow(_deal(depth, buckets), "bucket long, bytes binary, doc_id long, start long")
    return dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_merge_buckets(depth), "doc_id long, lo long, hi long")
