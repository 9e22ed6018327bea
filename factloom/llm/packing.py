"""Packing documents into fixed windows by non-negative least squares over the histogram of remainders.

Every document is its token ids and an end id. Whole windows are cut from its front; the rest, shorter than a window, is
its remainder. Combinations of up to three remainders that fill a window exactly are enumerated, repeat counts are solved
against the histogram of remainder lengths by non-negative least squares (projected gradient with momentum) and rounded
down. What stays over is cut once, at a multiple of a quarter window: the heads fill windows exactly, and the short tails
are packed greedily, longest first.

The solver sees the histogram alone, of at most one bin per length below the window. Which document takes which place
follows from its rank among the remainders of its length, so no document passes through the driver.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import batched, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize, shuffle_partitions, whole_text

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LENGTHS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest_crcs", pa.list_(pa.int64()))])


def tokenizer_of(path: str) -> tuple:
    """A tokenizer, and which of its ids end a word. Each is loaded once for each process: a Python worker serves many tasks,
    and this function reaches it by value, so what it holds has to lie in a module that stays."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_loaded_by_path", {})
    if path not in held:
        loaded = tokenizers.Tokenizer.from_file(path)
        vocabulary = loaded.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        held[path] = loaded, ends
    return held[path]


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins what white space parts: each distinct word of a batch is encoded once.

    A word is cut before its closing marks if a letter or a digit stands there, since the tokenizer cuts there as well; words
    with the same beginning share its ids. Ids lie in flat arrays, not in objects. Beginnings that are frequent in a batch are kept
    for the next ones, at most ``keep`` of them.
    """

    #: ASCII signs that the tokenizer always parts from what is before them (not the apostrophe of contractions), if that is
    #: a letter or digit that stays one in lower case.
    MARKS = ".,;:!?)]}\"#%&$*@+-=_/\\~^`>([{"
    LAST = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]$"

    def __init__(self, path: str, keep: int = 200_000, often: int = 2):
        self.keep, self.often = keep, often
        self.tokenizer, self.ends = tokenizer_of(path)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, one after the other. Runs of letters are one word each to the tokenizer, and the last id of a word has
        an end mark: many are encoded as one text and told apart by it. If the ends don't add up, each is encoded by itself."""
        sizes, flat = array("q"), array("I")
        for alike, run in groupby(parts, str.isalpha):
            for chunk in batched(run, 2000):
                if alike and len(chunk) > 1:
                    ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0].ids, np.uint32)
                    ends = np.flatnonzero(self.ends[ids])
                    if len(ends) == len(chunk):
                        sizes.frombytes(np.diff(ends, prepend=-1).astype(np.int64).tobytes())
                        flat.frombytes(ids.tobytes())
                        continue
                for code in self.tokenizer.encode_batch_fast(list(chunk), add_special_tokens=False):
                    ids = code.ids
                    sizes.append(len(ids))
                    flat.extend(ids)
        return np.frombuffer(sizes, np.int64), np.frombuffer(flat, np.uint32)

    def _cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
        """Beginnings; which words are cut; their closing marks. ASCII words become lower case, as the tokenizer makes them."""
        plain = pc.invert(pc.match_substring(words, "<|"))  # other words can be special tokens
        low = pc.if_else(pc.and_(plain, pc.string_is_ascii(words)), pc.ascii_lower(words), words)
        stems = pc.ascii_rtrim(low, characters=self.MARKS)
        cut = pc.and_(pc.and_(pc.not_equal(stems, low), pc.match_substring_regex(stems, self.LAST)), plain)
        sizes = pc.utf8_length(stems).filter(cut).to_pylist()
        return pc.if_else(cut, stems, low), np.asarray(cut), [w[n:] for w, n in zip(low.filter(cut).to_pylist(), sizes)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and how many each text has."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        place, known, fresh = self.place, len(self.place), {}
        of = lambda strings: np.fromiter((place[p] if p in place else fresh.setdefault(p, known + len(fresh)) for p in strings), np.int32, len(strings))
        # Two parts for each distinct word: its beginning and its closing marks, or nothing.
        stems, cut, marks = self._cut(coded.dictionary)
        stems = stems.dictionary_encode()
        parts = np.full((len(coded.dictionary), 2), of([""])[0], np.int32)
        parts[:, 0] = of(stems.dictionary.to_pylist())[stems.indices.to_numpy(zero_copy_only=False)]
        parts[cut, 1] = of(marks)
        order = sorted(fresh, key=str.isalpha)
        at = np.empty(len(fresh), np.int32)
        at[np.fromiter((fresh[p] for p in order), np.int64, len(fresh)) - known] = known + np.arange(len(fresh))
        parts = np.concatenate([np.arange(known, dtype=np.int32), at])[parts]
        new_sizes, new_flat = self._encoded(order)
        sizes, flat = np.concatenate([self.sizes, new_sizes]), np.concatenate([self.flat, new_flat])
        starts = np.cumsum(sizes) - sizes
        used = parts[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        counts = sizes[used]
        ends = np.cumsum(counts)
        ids = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[used] - ends + counts, counts)]
        of_text = 2 * np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(of_text)])]
        self._keep(order, np.bincount(used, minlength=len(sizes))[known:], new_sizes, new_flat)
        return ids, np.diff(edges)

    def _keep(self, fresh: list[str], times: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        frequent = times >= self.often
        if len(self.place) + frequent.sum() > self.keep:
            self._forget()
        for p, often in zip(fresh, frequent.tolist()):
            if often:
                self.place[p] = len(self.place)
        self.sizes = np.concatenate([self.sizes, sizes[frequent]])
        self.flat = np.concatenate([self.flat, flat[np.repeat(frequent, sizes)]])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _lengths(path: str, end_id: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each document: its tokens, the checksum of each whole window, and of the remainder, its head and its tail."""
    quarter = window // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(path)
        for batch in batches:
            ids, sizes = encode(batch.column("text"))
            at, n, crcs, rests = 0, [], [], []
            for size in sizes:
                doc = np.append(ids[at : at + size], np.uint32(end_id)).astype("<u4")
                at += size
                full = len(doc) // window * window
                rest = doc[full:]
                cut = len(rest) // quarter * quarter
                n.append(len(doc))
                crcs.append([_crc(doc[i : i + window]) for i in range(0, full, window)])
                rests.append([_crc(rest), _crc(rest[:cut]), _crc(rest[cut:])] if len(rest) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.list_(pa.int64()))], schema=_LENGTHS)

    return run


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window exactly, of lengths that occur: all pairs, and those triples whose
    shortest part is a multiple of a sixteenth of the window or repeats another part."""
    there = histogram > 0
    low = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(low), low, window - low], axis=1)
    a, b = np.meshgrid(np.arange(1, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    pick = (b >= a) & (c >= b) & ((a % max(1, window // 16) == 0) | (a == b) | (b == c))
    rows = np.concatenate([pairs, np.stack([a, b, c], axis=1)[pick]])
    ok = np.ones(len(rows), bool)
    for i in range(3):
        ok &= (rows[:, i] == 0) | there[rows[:, i]]
    return rows[ok]


def solve(histogram: np.ndarray, rows: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A: how often a combination has a length. Accelerated projected
    gradient; lengths are weighted alike."""
    if not len(rows):
        return np.zeros(0)
    bins = len(histogram)
    use = lambda x: sum(np.bincount(rows[:, i], x, bins) for i in range(3))
    goal = histogram.astype(float).copy()
    goal[0] = 0

    def residual(x: np.ndarray) -> np.ndarray:
        r = use(x) - goal
        r[0] = 0
        return r

    probe = np.ones(len(rows))
    for _ in range(20):
        r = use(probe)
        r[0] = 0
        probe = r[rows].sum(axis=1)
        top = np.linalg.norm(probe)
        probe /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - residual(y)[rows].sum(axis=1) / (1.05 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


class Plan:
    """Where the j-th remainder of each length goes; made from the histogram alone."""

    def __init__(self, histogram: np.ndarray, window: int, first: int):
        self.window, self.quarter, self.next = window, window // 4, first
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        taken = np.zeros(window, np.int64)
        whole: dict[int, list[tuple[int, int, int, int]]] = {}
        rows = combinations(left, window)
        repeats = solve(left, rows)
        for i in np.argsort(-repeats, kind="stable"):
            lengths = [int(x) for x in rows[i] if x]
            count = min([int(repeats[i] + 1e-6), *(left[x] // lengths.count(x) for x in lengths)])
            if count <= 0:
                continue
            offset = 0
            for x in lengths:
                whole.setdefault(x, []).append((int(taken[x]), int(count), self.next, offset))
                taken[x] += count
                left[x] -= count
                offset += x
            self.next += int(count)
        # What is left is cut into a head of whole quarters and a tail.
        self.cut_from = taken
        heads, tails = np.zeros(4, np.int64), np.zeros(self.quarter, np.int64)
        self.head_base, self.tail_base = np.zeros(window, np.int64), np.zeros(window, np.int64)
        for x in np.flatnonzero(left):
            q, r = divmod(int(x), self.quarter)
            self.head_base[x], self.tail_base[x] = heads[q], tails[r]
            heads[q] += left[x]
            tails[r] += left[x]
        self.whole = self._table(whole)
        self.heads = self._table(self._greedy(heads, self.quarter))
        self.tails = self._table(self._greedy(tails, 1))

    def _greedy(self, counts: np.ndarray, unit: int) -> dict[int, list[tuple[int, int, int, int]]]:
        """Longest first, the same filling repeated as often as the counts allow; the key is the class."""
        left, taken, out = counts.copy(), np.zeros(len(counts), np.int64), {}
        left[0] = 0
        while left.any():
            room, filling = self.window, {}
            for k in np.flatnonzero(left)[::-1]:
                n = min(room // (int(k) * unit), int(left[k]))
                if n:
                    filling[int(k)] = n
                    room -= n * int(k) * unit
            count = min(int(left[k]) // n for k, n in filling.items())
            offset = 0
            for k, n in filling.items():
                for _ in range(n):
                    out.setdefault(k, []).append((int(taken[k]), count, self.next, offset))
                    taken[k] += count
                    left[k] -= count
                    offset += k * unit
            self.next += count
        return out

    @staticmethod
    def _table(parts: dict[int, list[tuple[int, int, int, int]]]) -> tuple[np.ndarray, ...]:
        """Sorted by (class, first rank): class and first rank as one key, first rank, first sequence, offset."""
        flat = sorted((k, *x) for k, v in parts.items() for x in v)
        cols = np.array(flat, dtype=np.int64).reshape(-1, 5).T
        return (cols[0] << 44) + cols[1], cols[1], cols[3], cols[4]

    @staticmethod
    def find(table: tuple[np.ndarray, ...], cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, first, sequence, offset = table
        i = np.searchsorted(key, (cls.astype(np.int64) << 44) + rank, side="right") - 1
        return sequence[i] + rank - first[i], offset[i]


def _places(plan: Plan) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    window, quarter = plan.window, plan.quarter

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs in batches:
            n, rest, rank = (docs[c].to_numpy() for c in ("n", "rest", "rank"))
            full = n // window
            at = np.repeat(np.arange(len(docs)), full)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
            crcs = np.concatenate(docs["crcs"].to_list() or [[]]).astype(np.int64)
            parts = [(at, nth * window, np.full(len(at), window), crcs, docs["full_base"].to_numpy()[at] + nth, np.zeros(len(at), np.int64))]
            some = rest > 0
            rests = np.zeros((len(docs), 3), np.int64)
            if some.any():
                rests[some] = np.stack(docs["rest_crcs"].to_numpy()[some])
            uncut = some & (rank < plan.cut_from[rest])
            cut = np.flatnonzero(some & ~uncut)
            at = np.flatnonzero(uncut)
            if len(at):
                parts.append((at, full[at] * window, rest[at], rests[at, 0], *Plan.find(plan.whole, rest[at], rank[at])))
            nth = rank - plan.cut_from[rest]
            head, tail = rest // quarter, rest % quarter
            at = cut[head[cut] > 0]
            if len(at):
                parts.append((at, full[at] * window, head[at] * quarter, rests[at, 1], *Plan.find(plan.heads, head[at], plan.head_base[rest[at]] + nth[at])))
            at = cut[tail[cut] > 0]
            if len(at):
                parts.append((at, full[at] * window + head[at] * quarter, tail[at], rests[at, 2], *Plan.find(plan.tails, tail[at], plan.tail_base[rest[at]] + nth[at])))
            at, start, length, crc, sequence, offset = (np.concatenate([p[i] for p in parts]) for i in range(6))
            yield pd.DataFrame({"doc_id": docs["doc_id"].to_numpy()[at], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": n[at], "sequence_id": sequence, "offset": offset})

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all documents in their sequences.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null or empty text is the end id alone. Repeated rows
    are packed each for itself. An empty table gives no pieces. Null ids stay null. A remainder of the histogram is cut
    at most once; texts themselves are never shortened. The tokenizer must keep words that white space parts apart.
    """
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = docs.select("doc_id", whole_text().alias("text"))
    lengths = materialize(texts.mapInArrow(_lengths(tokenizer_path, end_id, window), "doc_id long, n long, crcs array<long>, rest_crcs array<long>"))
    salts = max(16, shuffle_partitions(spark))
    keyed = lengths.select("*", (F.col("n") % window).cast("int").alias("rest"), F.floor(F.col("n") / window).alias("full"), F.pmod(F.xxhash64("doc_id", "rest_crcs"), F.lit(salts)).cast("int").alias("salt"))
    groups = keyed.groupBy("rest", "salt").agg(F.count("*").alias("docs"), F.sum("full").alias("fulls"))
    bins = groups.groupBy("rest").agg(F.sum("docs").alias("docs"), F.sum("fulls").alias("fulls")).orderBy("rest").collect()  # one per length below the window
    histogram = np.zeros(window, np.int64)
    bases, total = {}, 0
    for b in bins:
        histogram[b.rest] = b.docs
        bases[b.rest] = total
        total += b.fulls
    plan = Plan(histogram, window, total)
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("rest", "salt", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("fulls_before"))
    inner = Window.partitionBy("rest", "salt").orderBy("doc_id", F.col("crcs"), F.col("rest_crcs"))
    ranked = (
        keyed.withColumns({"nth": F.row_number().over(inner) - 1, "full_nth": F.coalesce(F.sum("full").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        .join(offsets, ["rest", "salt"])
        .select("doc_id", "n", "rest", "crcs", "rest_crcs", (F.col("nth") + F.col("docs_before")).alias("rank"), (F.col("full_nth") + F.col("fulls_before")).alias("full_in_bin"))
    )
    base_of = np.zeros(window, np.int64)
    for rest, base in bases.items():
        base_of[rest] = base
    place = _places(plan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return place(b.assign(full_base=base_of[b["rest"].to_numpy()] + b["full_in_bin"].to_numpy()) for b in batches)

    return ranked.mapInPandas(run, PIECES)
