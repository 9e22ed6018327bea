"""Burrows-Wheeler transforms of collections of byte strings, and their merge by iterative interleave refinement."""

from __future__ import annotations

import numpy as np


class Shard:
    """Strings end to end, parted by zero bytes, and their transform.

    The transform is of bounded order: ``order`` sorts the places by the ``depth`` bytes (8, 16, 32 ...) that begin there,
    around the end, and the merge goes on from there; ``bwt`` has the ``step`` (2 or 4) bytes before each, as one symbol. What reads across a zero compares in some way that
    doesn't matter: only places that have as many bytes of one string before them as the merge compares count in the end.
    """

    def __init__(self, strings: list[bytes], depth: int = 8, step: int = 2):
        lengths = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths - 1
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        n = len(text)
        around = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
        rank = np.zeros(n, np.uint64)
        for i in range(8):
            rank = (rank << np.uint64(8)) | around[i : i + n]
        k = 8
        while True:
            order = np.argsort(rank, kind="stable")
            if k >= depth:
                break
            ordered = rank[order]
            small = np.empty(n, np.uint64)
            small[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
            rank = (small << np.uint64(32)) | np.roll(small, -(k % n))
            k *= 2
        self.text, self.order = text, order
        symbols = np.zeros(n, np.uint32)
        for i in range(step, 0, -1):
            symbols = (symbols << np.uint32(8)) | np.roll(text, i)
        self.bwt = symbols[order]
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.back = place[(order - step) % n]  # where the order has the rotation that begins ``step`` bytes before


def repeating(texts: list[np.ndarray], depth: int, bits: int = 22) -> list[np.ndarray]:
    """For each byte of the texts, which go around, if the ``depth`` bytes from it can occur twice.

    Three parts of them, first, middle and last, are counted by hashes of ``bits`` bits: that can say too much, never too little.
    """
    mix = np.random.default_rng(17).integers(1, 2**63, size=256, dtype=np.uint64)
    gram = min(32, 1 << (depth.bit_length() - 1))
    slots = []
    with np.errstate(over="ignore"):
        for text in texts:
            around = np.concatenate([text, np.resize(text, gram - 1)])
            h, width, factor = mix[around], 1, np.uint64(0x9E3779B97F4A7C15)
            while width < gram:
                h = h[:-width] * factor + h[width:]
                h ^= h >> np.uint64(29)
                factor = factor * factor | np.uint64(1)
                width *= 2
            slots.append(((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int32))
    seen = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    twice = np.bincount(np.concatenate(slots), minlength=1 << bits)[np.concatenate(slots)] > 1
    parts = [twice[a:b] for a, b in zip(seen, seen[1:])]
    return [p & np.roll(p, -((depth - gram) // 2)) & np.roll(p, gram - depth) for p in parts]


def merge(shards: list[Shard], depth: int, step: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' orders by the first ``depth`` (a multiple of ``step``) bytes, of rotations that share them with others, and
    the number of each one's block. A rotation is named by its place in the shards' orders, one shard after the other.

    The interleave starts as shard after shard, without the rotations that would end at bytes which can't repeat. In each round the transforms, read in the order of the interleave, are
    sorted stably by symbol, and the interleave steps back by it; a symbol being ``step`` bytes, after k rounds it sorts by the
    first k * step. A rotation begins a block where its first symbol, or the block of what follows the symbol, differs from the
    one before: common prefixes come out of the same rounds. A block of one is settled, and so is what precedes it: both
    leave the interleave.
    """
    offsets = np.cumsum([0, *(len(s.bwt) for s in shards)])
    bwt = np.concatenate([s.bwt for s in shards])
    # Any order of the symbols serves: they are numbered, so that most often 16 bits hold them.
    distinct = np.unique(bwt)
    bwt = np.searchsorted(distinct, bwt).astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
    back = np.concatenate([s.back + np.int32(o) for s, o in zip(shards, offsets)])
    can = repeating([s.text for s in shards], depth)
    interleave = np.concatenate([np.flatnonzero(c[(s.order - depth) % len(s.order)]).astype(np.int32) + np.int32(o) for s, c, o in zip(shards, can, offsets)])
    block = np.zeros(len(interleave), np.int32)
    for _ in range(depth // step):
        symbols = bwt[interleave]
        to = np.argsort(symbols.astype(np.uint16), kind="stable")  # by the low 16 bits, in linear time
        if bwt.itemsize > 2:
            to = to[np.argsort((symbols >> np.uint32(16)).astype(np.uint16)[to], kind="stable")]
        interleave = back[interleave[to]]
        first, rest = symbols[to], block[to]
        begins = np.ones(len(to) + 1, bool)
        begins[1:-1] = (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])
        shared = ~(begins[:-1] & begins[1:])
        interleave = interleave[shared]
        block = np.cumsum(begins[:-1][shared], dtype=np.int32)
        if not len(block):
            break
    return interleave, block


def repeated(strings: list[bytes], ids: np.ndarray, at: np.ndarray, depth: int, shard_bytes: int = 1 << 17) -> list[tuple[int, int, int]]:
    """(id, from, to) of runs of bytes under strings of ``depth`` bytes that occur earlier as well, by (id, place).

    ``strings`` are stretches of documents: ``ids`` their documents, ``at`` their first bytes' places.
    """
    shard_bytes = max(shard_bytes, sum(map(len, strings)) // 200)
    parts: list[list[int]] = [[]]
    size = 0
    for i, s in enumerate(strings):
        if size > shard_bytes:
            parts.append([])
            size = 0
        parts[-1].append(i)
        size += len(s)
    step = 2 if depth % 4 else 4
    shards = [Shard([strings[i] for i in p], step=step) for p in parts if p]
    interleave, block = merge(shards, depth, step)
    if not len(block):
        return []
    begin = np.cumsum([0, *(len(s.bwt) for s in shards)])
    whose, offset, full = (np.empty(len(block), t) for t in (np.int64, np.int64, bool))  # of each: its string, the offset, if it fits
    of = np.searchsorted(begin, interleave, side="right") - 1
    for i, (s, p) in enumerate(zip(shards, [p for p in parts if p])):
        mine = of == i
        at_byte = s.order[interleave[mine] - begin[i]]
        local = np.searchsorted(s.starts, at_byte, side="right") - 1
        off = at_byte - s.starts[local]
        whose[mine], offset[mine], full[mine] = np.array(p)[local], off, off + depth <= s.lengths[local]
    # Blocks of two or more full strings; all but the first of each, by document and place, repeat it.
    counts = np.bincount(block[full], minlength=int(block[-1]) + 1)
    some = full & (counts[block] > 1)
    block, whose, offset = block[some], whose[some], offset[some]
    doc, place = ids[whose], at[whose] + offset
    by = np.lexsort((place, doc, block))
    block, doc, place = block[by], doc[by], place[by]
    first = np.ones(len(block), bool)
    first[1:] = block[1:] != block[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(block)), 0))
    later = (doc != doc[head]) | (place != place[head])  # one place can come in two stretches
    doc, place = doc[later], place[later]
    by = np.lexsort((place, doc))
    doc, place = doc[by], place[by]
    if not len(doc):
        return []
    breaks = np.flatnonzero((doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1))
    lo, hi = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(doc) - 1]])
    return list(zip(doc[lo].tolist(), place[lo].tolist(), (place[hi] + depth).tolist()))
