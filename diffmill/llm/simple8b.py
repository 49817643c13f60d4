"""Simple-8b: a selector of 4 bits says how many ids share the other 60 bits of a word.

The last selector is an escape: the next word is one id as it stands, for ids of more than
60 bits. Every document starts at a new word, and the last word of a document is filled up
with zeros, which its length tells from ids. So a block with the word offset of each
document is decoded as a whole by array operations, or one document of it alone.
"""

import numpy as np

#: Ids in a word and bits of each, by selector.
LAYOUTS = [
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
ESCAPE = len(LAYOUTS)
_COUNTS = np.array([c for c, _ in LAYOUTS] + [1], np.int64)
_GAP = 60


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of the narrowest layout that holds each id; 64 where none does."""
    if len(ids) > 1 << 17 and ids.max() < 1 << 17:  # token ids: by table
        return _widths(np.arange(1 << 17, dtype=np.uint64))[ids]
    width = np.full(len(ids), 64, np.uint8)
    for _, bits in reversed(LAYOUTS):
        width[ids < (1 << bits)] = bits
    width[ids == 0] = 0
    return width


def _choices(width: np.ndarray) -> np.ndarray:
    """Selector of the word that would start at each place, by the widest id in reach."""
    n = len(width) - _GAP
    reach = {1: width}

    def widest(count: int) -> np.ndarray:
        if count not in reach:
            part = 1 << (count.bit_length() - 1)
            part = part // 2 if part == count else part
            left, right = widest(part), widest(count - part)
            size = min(len(left), len(right) - part)
            reach[count] = np.maximum(left[:size], right[part : part + size])
        return reach[count]

    chosen = np.full(n, ESCAPE, np.uint8)
    for selector in range(len(LAYOUTS) - 1, -1, -1):  # a denser one that fits wins
        count, bits = LAYOUTS[selector]
        fits = widest(count)[:n] <= bits
        if not fits.any():
            break
        chosen[fits] = selector
    return chosen


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offset of each document's first word with the end added."""
    ids, lengths = ids.astype(np.uint64), lengths.astype(np.int64)
    # documents apart by a gap of zeros, so that no word reaches into the next document
    starts = np.cumsum(lengths + _GAP) - lengths - _GAP
    spread = np.zeros(int(lengths.sum()) + _GAP * (len(lengths) + 1), np.uint64)
    if len(ids):
        shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        spread[np.arange(len(ids)) + shift] = ids
    chosen = _choices(_widths(spread))
    step = _COUNTS[chosen].astype(np.uint8).tobytes()
    at: list[int] = []
    add = at.append
    sizes = np.zeros(len(lengths), np.int64)
    for k, (i, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        before, end = len(at), i + n
        while i < end:
            add(i)
            i += step[i]
        sizes[k] = len(at) - before
    place = np.array(at, np.int64)
    selector = chosen[place] if len(place) else np.zeros(0, np.uint8)
    words = selector.astype(np.uint64)
    for s in np.unique(selector).tolist():
        rows = np.flatnonzero(selector == s)
        if s < ESCAPE:
            count, bits = LAYOUTS[s]
            first = place[rows]
            for k in range(count):
                words[rows] |= spread[first + k] << np.uint64(4 + k * bits)
    escaped = selector == ESCAPE
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if escaped.any():  # the id follows its escape
        grown = np.cumsum(escaped)
        out = np.zeros(len(words) + int(grown[-1]), np.uint64)
        home = np.arange(len(words)) + grown - escaped
        out[home] = words
        out[home[escaped] + 1] = spread[place[escaped]]
        offsets = offsets + np.concatenate([[0], grown])[offsets]
        words = out
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of all documents of a block, one after another."""
    lengths = lengths.astype(np.int64)
    selector = (words & np.uint64(15)).astype(np.int64)
    plain = np.ones(len(words), bool)
    if (selector == ESCAPE).any():  # words after an escape are ids, whatever they look like
        i = 0
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if plain[i]:
                plain[i + 1] = False
    heads = np.flatnonzero(plain)
    kind = selector[heads]
    counts = _COUNTS[kind]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[begin[rows]] = words[heads[rows] + 1]
            continue
        count, bits = LAYOUTS[s]
        source, target, low = words[heads[rows]], begin[rows], np.uint64((1 << bits) - 1)
        for k in range(count):
            out[target + k] = source >> np.uint64(4 + k * bits) & low
    # what fills up the last word of a document is left out
    head_of = np.searchsorted(heads, offsets)
    ends = np.concatenate([begin, [len(out)]])[head_of]
    start = ends[:-1]
    keep = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    return out[keep]
