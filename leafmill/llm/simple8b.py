"""Token ids as Simple-8b words: a 4-bit selector and as many ids as fit in the other 60 bits.

A segment is a header, the ids of its documents, their counts of token ids, the place of each
block's first word, and the words. Blocks hold `BLOCK` ids, so that all blocks of a segment are coded
in step, and each can be decoded alone. Selector 15 is an escape: the next word is one raw id of up
to 64 bits.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK = b"LMS8", 1024
HEAD = struct.Struct("<4sIQIIQ")  # magic, documents, ids, ids a block, blocks, words
#: Fixed values of the coding: ids a word and bits an id, for selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE, PAD = 15, 60
_BITS16 = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
_N = np.array([0, *COUNTS, 1], np.int64)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0."""
    if len(ids) and int(ids.max()) < 1 << 16:
        return _BITS16[ids]
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the place of each block's first word and the end."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    table = np.zeros((blocks, BLOCK + PAD), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = ids
    table[:, :BLOCK] = full.reshape(blocks, BLOCK)
    w = np.zeros((blocks, BLOCK + PAD), np.uint8)
    w[:, :BLOCK] = widths(table[:, :BLOCK].ravel()).reshape(blocks, BLOCK)
    # The widest of the next k ids, for each count k of a selector; the largest count that fits wins.
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    widest, have = w.copy(), 1
    for k in range(14, 0, -1):
        count, bits = COUNTS[k - 1], BITS[k - 1]
        while have < count:
            step = min(have, count - have)
            widest[:, : widest.shape[1] - step] = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:])
            have += step
        fits = widest[:, :BLOCK] <= bits
        if not fits.any():
            break
        choice[fits] = k
    steps = _N[choice]
    at, lane, ends = np.zeros(blocks, np.int64), np.arange(blocks), np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    seen = np.zeros((blocks, BLOCK), bool)
    while len(lane):
        seen[lane, at] = True
        at = at + steps[lane, at]
        more = at < ends[lane]
        at, lane = at[more], lane[more]
    block, place = np.nonzero(seen)
    sel = choice[block, place]
    size = np.where(sel == ESCAPE, 2, 1)
    first = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k in np.unique(sel):
        mine = sel == k
        if k == ESCAPE:
            words[first[mine]] = np.uint64(ESCAPE) << np.uint64(60)
            words[first[mine] + 1] = table[block[mine], place[mine]]
            continue
        count, bits = COUNTS[k - 1], BITS[k - 1]
        got = table[block[mine][:, None], place[mine][:, None] + np.arange(count)]
        shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        words[first[mine]] = np.bitwise_or.reduce(got << shift, axis=1) | (np.uint64(k) << np.uint64(60))
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(np.bincount(block, weights=size, minlength=blocks).astype(np.uint32), out=starts[1:])
    return words, starts


def unpack(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ids of a segment, or of some of its blocks (starts: their part of the places)."""
    blocks = len(starts) - 1
    if not n:
        return np.zeros(0, np.uint64)
    words = words[starts[0] : starts[-1]]
    starts = starts.astype(np.int64) - int(starts[0])
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():
        for i in np.flatnonzero(sel == ESCAPE):  # rare; a raw word may look like an escape
            if not raw[i]:
                raw[i + 1] = True
    sel[raw] = 0
    counts = _N[sel]
    block = np.repeat(np.arange(blocks), np.diff(starts))
    total = np.cumsum(counts) - counts
    place = total - total[starts[:-1]][block]
    out = np.zeros((blocks, BLOCK + PAD), np.uint64)
    for k in np.unique(sel[~raw]):
        mine = np.flatnonzero((sel == k) & ~raw)
        if k == ESCAPE:
            out[block[mine], place[mine]] = words[mine + 1]
            continue
        count, bits = COUNTS[k - 1], BITS[k - 1]
        shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        out[block[mine][:, None], place[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shift) & np.uint64((1 << bits) - 1)
    return out[:, :BLOCK].ravel()[:n]


def write_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts = pack(ids.astype(np.uint64))
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), BLOCK, len(starts) - 1, len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, counts and token ids of a segment."""
    magic, n_docs, n, block, blocks, n_words = HEAD.unpack_from(raw)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a segment of this format")
    at, out = HEAD.size, []
    for kind, k in (("<i8", n_docs), ("<u8", n_docs), ("<u4", blocks + 1), ("<u8", n_words)):
        out.append(np.frombuffer(raw, kind, k, at))
        at += out[-1].nbytes
    return out[0], out[1].astype(np.int64), unpack(out[3], out[2], n)
