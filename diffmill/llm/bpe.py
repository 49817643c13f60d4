"""Byte-level BPE encoding and decoding (operator 1).

A pre-token is merged with a rank queue: one bucket per merge rank holds the positions of
a linked list whose pair has that rank, and a hierarchical bitmap over the ranks finds the
lowest bucket that is not empty by find-first-set. A merge changes at most two pairs;
entries of pairs that are gone stay in their buckets and are skipped when popped. So a
pre-token of n bytes costs O(n) queue steps, however long it is.

Pre-tokens repeat, so each Python worker remembers the ids of those it meets, a fixed
number at most; this changes nothing but time.

Defined results: a null text counts as empty and has no ids; lone invalid bytes do not
occur in a Spark string; ids outside the vocabulary decode to nothing; rows with equal ids
of a document are encoded each on its own; other columns pass through untouched.
"""

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill.llm.batches import list_array, texts

#: White space as the split pattern's own library has it.
SPACE = "\t-\r \x85\xa0  -     　"
_INNER = re.compile(f"[{SPACE}] (?:[{SPACE}]|\\Z)")
def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each byte string of a vocabulary file: base64 and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class BytePairs:
    """Merges of one vocabulary: ``encode`` a pre-token, ``decode`` ids.

    The rank queue lives here and is empty between two calls: ``leaves`` has a bit per
    rank, the summary a bit per leaf that is not zero, ``buckets`` the positions by rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.strings: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for string, rank in ranks.items():
            self.strings[rank] = string
        # leaves about as wide as the summary
        self.shift = max(6, (len(self.strings).bit_length() + 1) // 2)
        self.leaves = [0] * ((len(self.strings) >> self.shift) + 1)
        self.mask = (1 << self.shift) - 1
        self.bits = [1 << i for i in range(max(len(self.leaves), self.mask + 1))]

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        rank_of, leaves, bits = ranks.get, self.leaves, self.bits
        shift, mask = self.shift, self.mask
        summary, buckets = 0, {}
        # the node at a position covers piece[position:after[position]]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        want = [-1] * n  # rank of the pair that starts here, to tell stale entries
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                want[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    summary |= bits[rank >> shift]
                    leaves[rank >> shift] |= bits[rank & mask]
        while summary:
            # find-first-set on both levels
            word = (summary & -summary).bit_length() - 1
            leaf = leaves[word]
            lowest = leaf & -leaf
            leaves[word] = leaf = leaf ^ lowest
            if not leaf:
                summary &= summary - 1
            rank = word << shift | (lowest.bit_length() - 1)
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()  # equal ranks merge from left to right
            for i in positions:
                if want[i] != rank:
                    continue  # the pair is gone
                middle = after[i]
                end = after[i] = after[middle]
                want[middle] = -1
                new = rank_of(piece[i : after[end]]) if end < n else None
                if new is None:
                    want[i] = -1
                else:
                    want[i] = new
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        summary |= bits[new >> shift]
                        leaves[new >> shift] |= bits[new & mask]
                if end < n:
                    before[end] = i
                left = before[i]
                if left >= 0:
                    new = rank_of(piece[left:end])
                    if new is None:
                        want[left] = -1
                    else:
                        want[left] = new
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            summary |= bits[new >> shift]
                            leaves[new >> shift] |= bits[new & mask]
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        strings, n = self.strings, len(self.strings)
        return b"".join([strings[i] if 0 <= i < n else b"" for i in ids])


class TextEncoder:
    """Ids of whole texts. Pre-tokens and the parts between spaces are remembered as the bytes of their ids;
    each memory holds ``kept`` of them at most and begins anew when it is full. A word with one mark behind
    it is two pre-tokens, so the word alone is remembered; parts with a line end hardly come back."""

    def __init__(self, pairs: BytePairs, pattern: str, kept: int):
        import regex

        # the library reads \s as White_Space; say so to be independent of this one
        spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(spelled).findall
        self.pairs, self.kept = pairs, kept
        self.parts: dict[str, bytes] = {}  # by what follows a space
        self.pieces: dict[str, bytes] = {}  # pre-tokens without a space in front
        self.marks = {mark: self.plain(mark) for mark in ".,;:!?"}

    def keep(self, known: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(known) >= self.kept:
            known.clear()
        if len(key) < 64:
            known[key] = ids

    def piece(self, pre_token: str) -> bytes:
        known, key = (self.parts, pre_token[1:]) if pre_token[0] == " " else (self.pieces, pre_token)
        found = known.get(key)
        if found is None:
            found = array("i", self.pairs.encode(pre_token.encode())).tobytes()
            self.keep(known, key, found)
        return found

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def text(self, text: str) -> bytes:
        if _INNER.search(text):
            return self.plain(text)
        # a space outside a longer run of white space always starts a pre-token, so the
        # parts between such spaces are independent and repeat often
        first, *parts = text.split(" ")
        known, marks, out = self.parts, self.marks, [self.plain(first)]
        for part in parts:
            ids = known.get(part)
            if ids is None:
                if part.isalpha():  # a pre-token as it stands
                    ids = self.piece(" " + part)
                elif part[-1:] in marks and part[:-1].isalpha():  # two of them
                    ids = self.piece(" " + part[:-1]) + marks[part[-1]]
                else:
                    ids = self.plain(" " + part)
                    if "\n" not in part:
                        self.keep(known, part, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        coded = [self.text(x) for x in rows]
        return np.frombuffer(b"".join(coded), "i4"), np.array([len(x) // 4 for x in coded], np.int64)


_loaded: dict[tuple, object] = {}


def _once(key: tuple, make):
    """One object per Python worker, whatever number of tasks it runs."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def _pairs(path: str) -> BytePairs:
    return _once(("pairs", path), lambda: BytePairs(read_ranks(path)))


def _encoder(vocabulary: str, pattern: str, kept: int) -> TextEncoder:
    return _once(("encoder", vocabulary, pattern, kept), lambda: TextEncoder(_pairs(vocabulary), pattern, kept))


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of ``values`` that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes of each row from all bytes and the rows' sizes."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


class TokenBytes:
    """Bytes of ids, by array operations."""

    def __init__(self, pairs: BytePairs):
        # the last row stands for ids outside the vocabulary
        strings = [*pairs.strings, b""]
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        last = len(self.sizes) - 1
        rows = np.where((ids >= 0) & (ids < last), ids, last)
        sizes = self.sizes[rows]
        done = np.concatenate([[0], np.cumsum(sizes)])
        return _binary(_gathered(self.data, self.starts[rows], sizes), np.diff(done[np.cumsum(lengths)], prepend=0))


def _token_bytes(vocabulary: str) -> TokenBytes:
    return _once(("bytes", vocabulary), lambda: TokenBytes(_pairs(vocabulary)))


#: Rows that are worked on together.
ROWS = 500


def encode(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", kept: int = 300_000, decoded: str | None = None) -> DataFrame:
    """Adds the token ids of ``text`` as an array of ints.

    ``vocabulary`` is a rank file that every executor has at this path. ``kept`` bounds
    the parts a worker remembers. With ``decoded`` the ids are decoded again, and the bytes
    added under that name.
    """
    plain = docs.drop(ids, *[decoded] if decoded else [])
    schema = T.StructType([*plain.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    if decoded:
        schema = schema.add(decoded, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern, kept)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                flat, lengths = encoder.encode(texts(batch.column("text")))
                columns = [*batch.columns, list_array(flat, lengths, pa.int32())]
                if decoded:
                    columns.append(_token_bytes(vocabulary).decode(flat, lengths))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return plain.mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give empty bytes."""
    plain = coded.drop(decoded)
    schema = T.StructType([*plain.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _token_bytes(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                column = batch.column(ids)
                lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                # the ids of null lists, if there are any, are left out
                flat = pc.fill_null(column.drop_null().flatten(), -1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, strings.decode(flat, lengths)], names=schema.names)

    return plain.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, pattern: str, kept: int = 800_000) -> DataFrame:
    """Round trip of every document: number of ids, digest of the ids, digest of the
    decoded bytes."""
    coded = encode(docs.select("doc_id", "text"), vocabulary, pattern, kept=kept, decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
