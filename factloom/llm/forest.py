"""Near-duplicate join on n-gram Jaccard similarity: MinHash banding, then exact verification.

Each text's set of word shingles gets a min-hash signature, cut into one label for each tree. An LSH forest would match
full labels in prefix tries and shorten the prefix; here its final length, at which pairs at the wanted similarity meet in
some tree with the wanted recall, is computed beforehand and just that prefix is hashed. Texts that meet are candidates;
their components are gathered, dealt in bounded blocks, and every pair of texts inside is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize, shuffle_partitions, whole_text
from factloom.llm.graph import components

_MIX = np.uint64(0x9E3779B97F4A7C15)


def prefix_length(similarity: float, recall: float, trees: int, longest: int) -> int:
    """The longest prefix at which a pair at ``similarity`` shares a node of some tree with probability ``recall``; 1 at least."""
    for length in range(longest, 1, -1):
        if 1 - (1 - similarity**length) ** trees >= recall:
            return length
    return 1


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words, which white space parts."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, and how many each has; a shorter text is one run of all its words."""
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    words = words.astype(np.uint64)
    ends = np.cumsum(sizes)
    whose = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(words))  # words from here to the end of the text
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            moved = np.zeros(len(words), np.uint64)
            moved[: len(words) - i] = words[i:]
            there = left > i
            out = np.where(there, (out ^ (moved + np.uint64(i))) * _MIX + (out >> np.uint64(29)), out)
        out ^= out >> np.uint64(32)
    first = np.zeros(len(words), bool)
    first[(ends - sizes)[sizes > 0]] = True
    keep = (left >= width) | (first & (sizes[whose] < width))
    return out[keep], np.bincount(whose[keep], minlength=len(sizes))


def label_hashes(shingles: np.ndarray, counts: np.ndarray, trees: int, length: int, seed: int = 7) -> np.ndarray:
    """For each text with shingles one 64-bit hash of each tree's label prefix."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, size=(trees, length), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]
    out = np.empty((len(starts), trees), np.uint64)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        for t in range(trees):
            label = np.full(len(starts), t + 1, np.uint64)
            for k in range(length):
                h = shingles * factors[t, k]
                h ^= h >> np.uint64(31)
                label = (label ^ np.minimum.reduceat(h, starts)) * _MIX
                label ^= label >> np.uint64(29)
            out[:, t] = label
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _labels(width: int, trees: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shingles, counts = shingle_hashes(*_flat(b.column("words")), width)
            labels = label_hashes(shingles, counts, trees, length).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, trees, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels.ravel()))], names=["doc_id", "t", "n", "labels"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``; sorted sets."""
    sizes = [np.array([len(x) for x in s]) for s in (left, right)]
    values = [np.concatenate(s) for s in (left, right)]
    shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(s)), n) for s, n in zip((left, right), sizes)]
    at = [np.searchsorted(shared, v) for v in values]
    for side in range(2):
        ok = at[side] < len(shared)
        ok[ok] = shared[at[side][ok]] == values[side][ok]
        order = np.argsort(at[side][ok], kind="stable")
        rows[side], at[side] = rows[side][ok][order], at[side][ok][order]
    for begin in range(0, len(shared), columns):
        parts = []
        for side, n in ((0, len(left)), (1, len(right))):
            lo, hi = np.searchsorted(at[side], [begin, begin + columns])
            m = np.zeros((n, min(columns, len(shared) - begin)), np.float32)
            m[rows[side][lo:hi], at[side][lo:hi] - begin] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


@dataclass(frozen=True)
class _Group:
    """Texts that are compared together: a block pair (i, j) of a component (tree -1), or of a node of a tree."""

    of: int
    tree: int
    i: int
    j: int
    whole: bool


def _compared(group: _Group, rows: list[tuple[int, int, int, np.ndarray, np.ndarray]], similarity: float) -> tuple[list[int], list[int], list[int]]:
    """Of one group: the texts' numbers, links (copies counted) and roots. A row: number, block, copies, set, labels.

    In a group of a tree only those pairs count that share no node of an earlier tree, so each counts once.
    """
    rows.sort(key=lambda r: r[0])
    ids, mult = [r[0] for r in rows], np.array([r[2] for r in rows])
    left = [k for k, r in enumerate(rows) if r[1] == group.i]
    right = left if group.i == group.j else [k for k, r in enumerate(rows) if r[1] == group.j]
    links, a, b = np.zeros(len(rows), np.int64), [], []
    if left and right:
        sizes = np.array([len(r[3]) for r in rows], np.float64)
        for begin in range(0, len(left), 512):
            part = left[begin : begin + 512]
            common = _overlaps([rows[k][3] for k in part], [rows[k][3] for k in right]).astype(np.float64)
            close = common >= similarity * (sizes[part][:, None] + sizes[right][None, :] - common) - 1e-9
            close &= common > 0
            for t in range(group.tree):
                close &= np.array([rows[k][4][t] for k in part])[:, None] != np.array([rows[k][4][t] for k in right])[None, :]
            x, y = np.nonzero(close)
            x, y = np.array(part)[x], np.array(right)[y]
            if group.i == group.j:
                x, y = x[x < y], y[x < y]
            np.add.at(links, x, mult[y])
            np.add.at(links, y, mult[x])
            a.append(x)
            b.append(y)
    roots = _roots(len(rows), np.concatenate(a) if a else np.empty(0, int), np.concatenate(b) if b else np.empty(0, int))
    return ids, links.tolist(), [ids[r] for r in roots]


def _verify(width: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by group: one group of a bounded number of texts and words after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def close() -> None:
            if held:
                numbers, links, roots = _compared(group, held, similarity)
                for column, values in zip(out, (numbers, links, roots, [group.whole] * len(numbers))):
                    column.extend(values)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.bool_())], names=["no", "links", "root", "whole"])
            for c in out:
                c.clear()
            return made

        for b in batches:
            shingles, counts = shingle_hashes(*_flat(b.column("words")), width)
            ends = np.cumsum(counts)
            labels, per_text = _flat(b.column("labels"))
            to = np.cumsum(per_text)
            cols = [b.column(c).to_pylist() for c in ("of", "tree", "i", "j", "whole", "no", "block", "mult")]
            for k, (of, tree, i, j, whole, no, block, mult) in enumerate(zip(*cols)):
                if group is None or (of, tree, i, j) != (group.of, group.tree, group.i, group.j):
                    close()
                    group, held = _Group(of, tree, i, j, whole), []
                held.append((no, block, mult, np.unique(shingles[ends[k] - counts[k] : ends[k]]), labels[to[k] - per_text[k] : to[k]].copy()))
            if len(out[0]) > 10_000:
                yield batch()
        close()
        yield batch()

    return run


def _blocks(texts: Column, words: Column, block: int, block_words: int) -> Column:
    return F.greatest(F.ceil(texts / block), F.ceil(words / block_words), F.lit(1)).cast("int")


def _groups(met: DataFrame, members: DataFrame, block: int, block_words: int, most_blocks: int) -> DataFrame:
    """of, tree, blocks, whole, no: in which groups each text is compared.

    A component of up to ``most_blocks`` blocks is one group, dealt in block pairs. A larger one - a chain of texts of which
    most share nothing - is taken apart into the nodes of its trees, so that only texts that meet are compared.
    ``met``: no, tree, node; ``members``: root, no, words.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("texts"), F.sum("words").alias("words"))
    sizes = sizes.select("root", _blocks(F.col("texts"), F.col("words"), block, block_words).alias("blocks"))
    sized = members.join(sizes, "root")
    small = sized.where(F.col("blocks") <= most_blocks).select(F.col("root").alias("of"), F.lit(-1).alias("tree"), "blocks", (F.col("blocks") == 1).alias("whole"), "no")
    large = met.join(sized.where(F.col("blocks") > most_blocks).select("no", "words"), "no")
    nodes = large.groupBy("tree", "node").agg(F.count("*").alias("texts"), F.sum("words").alias("words")).where("texts > 1")
    nodes = nodes.select("tree", "node", _blocks(F.col("texts"), F.col("words"), block, block_words).alias("blocks"))
    return small.unionByName(large.join(nodes, ["tree", "node"]).select(F.col("node").alias("of"), "tree", "blocks", F.lit(False).alias("whole"), "no"))


def text_key(text: Column) -> Column:
    """What tells different texts apart: their SHA-256; null counts as empty."""
    return F.unhex(F.sha2(whole_text(text), 256))


def _joined(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999, trees: int = 24, longest: int = 8, block: int = 512, block_words: int = 400_000, most_blocks: int = 24) -> tuple[DataFrame, DataFrame]:
    """doc_id and t, the text's key, of each row with an id; and t, rep, mult, links, root of each different text."""
    spark = docs.sparkSession
    length = prefix_length(similarity, recall, trees, longest)
    text = whole_text()
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("t"), text.alias("text"))
    labelled = materialize(rows.select("doc_id", "t", word_hashes(F.col("text")).alias("words")).mapInArrow(_labels(width, trees, length), "doc_id long, t binary, n long, labels array<long>"))
    # One row for each different text, with a number of its own: ids can be shared.
    texts = materialize(labelled.groupBy("t").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.any_value("n").alias("n"), F.any_value("labels").alias("labels")).withColumn("no", F.monotonically_increasing_id()))
    met = texts.select("no", F.posexplode("labels").alias("tree", "label")).select("no", "tree", F.xxhash64("tree", "label").alias("node"))
    nodes = met.groupBy("node").agg(F.min("no").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = met.join(nodes, "node").where(F.col("no") != F.col("head")).select(F.col("no").alias("a"), F.col("head").alias("b"))
    roots = components(pairs)
    members = roots.join(texts.select(F.col("no").alias("node"), F.col("n").alias("words")), "node").select("root", F.col("node").alias("no"), "words")
    groups = materialize(_groups(met, members, block, block_words, most_blocks))
    # The words of those texts that are compared, read once for each text: from its row of the least id.
    wanted = texts.select("t", "rep", "no", "mult", "labels").join(roots.select(F.col("node").alias("no")), "no")
    words = rows.withColumnRenamed("doc_id", "rep").join(wanted, ["t", "rep"]).dropDuplicates(["no"]).select("no", "mult", "labels", word_hashes(F.col("text")).alias("words"))
    block_of = F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int")
    dealt = groups.withColumn("block", block_of).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("of", "tree", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "whole", "no", "block")
    dealt = dealt.join(words, "no").repartition(shuffle_partitions(spark), "of", "tree", "i", "j").sortWithinPartitions("of", "tree", "i", "j")
    found = materialize(dealt.mapInArrow(_verify(width, similarity), "no long, links long, root long, whole boolean"))
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    far = components(found.where("NOT whole").select(F.col("no").alias("a"), F.col("root").alias("b")))
    near = found.where("whole").select("no", "root")
    roots = links.join(near.unionByName(far.select(F.col("node").alias("no"), "root")), "no", "left")
    joined = texts.select("t", "no", "rep", "mult").join(roots, "no", "left").withColumn("root", F.coalesce("root", "no"))
    return labelled.select("doc_id", "t"), joined


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id, n_links of each row of ``docs`` (doc_id, text; other columns are ignored).

    A link joins two rows whose sets of ``width``-word shingles (5) have a Jaccard similarity of ``similarity`` (0.8) or more; equal
    texts are always linked. class_id is the least id of the rows joined by links, n_links counts the others that a row is
    linked to, copies included. A text of fewer words is one shingle; null or white text has none, and links to equal texts
    only. Rows without an id are left out; repeated rows count as copies and come out as often as they went in. Different
    texts under one id are rows of their own, each with its class and links. An empty table gives no rows.
    """
    rows, joined = _joined(docs, **settings)
    classes = joined.groupBy("root").agg(F.min("rep").alias("class_id"))
    per_text = joined.join(classes, "root").select("t", "class_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    return rows.join(per_text, "t").select("doc_id", "class_id", "n_links")


def class_heads(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, t: the row of the least id of each class of near_duplicates(), with the key of its text."""
    _, joined = _joined(docs, **settings)
    return joined.groupBy("root").agg(F.min(F.struct("rep", "t")).alias("head")).select(F.col("head.rep").alias("doc_id"), "head.t")
