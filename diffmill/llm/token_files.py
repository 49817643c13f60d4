"""Token files (operator 10): ids of all documents in ascending order of their ids.

Documents are range-partitioned and sorted by ``doc_id`` (equal ids by a hash of the
text), encoded, and written as Parquet whose rows are blocks: ids packed by Simple-8b, with the word offset of every document. A block closes at
the first document end after ``block_ids`` ids, so a document is never cut, and a block is
bounded by that number plus one document. Blocks carry the number of their partition and
how many ids of it precede them, so any task can read any block.

Defined results: a null text is empty and has only the end id; null document ids come
first; repeated rows are written each; an empty table gives an empty file.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffmill.llm.batches import list_array
from diffmill.llm.simple8b import pack, unpack

BLOCK = (
    "part int, ids_before bigint, doc_ids array<bigint>, lengths array<int>, "
    "offsets array<int>, words binary"
)


#: Letters of ASCII and Latin-1, which stay one code point each when normalized and lower-cased.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"

#: A word of Latin letters, with or without one mark behind it.
_WORD = re.compile(f"[{_LETTERS}]+([.,;:!?]?)").fullmatch

#: A word of Latin letters and the ASCII marks behind it.
_MARKED = rf"^(?P<word>[{_LETTERS}]+)(?P<marks>[!-/:-@\[-`{{-~]*)$"


def _runs(flat: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat``, which have these lengths, in the order of ``index``, and their lengths."""
    starts, n = (np.cumsum(lengths) - lengths)[index], lengths[index]
    ends = np.cumsum(n)
    places = np.repeat(starts - (ends - n), n)
    places += np.arange(len(places))
    return flat[places], n


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The tokenizer drops white space and never joins what it parts, so a text is encoded in
    the parts between its white space. It lower-cases words and parts them from marks behind
    them, so a part of letters and marks is its word in small letters, then its marks. Words,
    marks and other parts repeat: those met are kept, up to a fixed number, after which the
    memory begins anew.
    """

    def __init__(self, path: str, end_id: int, kept: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words in small letters, which need neither normalizer nor pattern
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence(
            [WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.kept, self.known, self.end_id = kept, {}, end_id
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(*vocabulary.values(), end_id) < 1 << 16 else 4
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self._check(path)

    def _check(self, path: str) -> None:
        """Every letter and mark is treated as the class takes for granted."""
        words = [f"{a}{chr(c)}{a}" for a in "aA" for c in range(256) if _WORD(chr(c))]
        marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        whole, parted = " ".join(words + ["a" + m for m in marks]), " ".join(f"a {m}" for m in marks)
        ids = self.plain.encode(" ".join(words).lower(), add_special_tokens=False).ids
        ids += self.tokenizer.encode(parted, add_special_tokens=False).ids
        if self.tokenizer.encode(whole, add_special_tokens=False).ids != ids:
            raise ValueError(f"{path}: a tokenizer that lower-cases words and parts them from marks is needed")

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of small Latin letters: many of them make up one call, and the ids
        that end a word tell them apart."""
        found, width = {}, self.width
        for some in (words[i : i + 20_000] for i in range(0, len(words), 20_000)):
            lines = [" ".join(some[i : i + 500]) for i in range(0, len(some), 500)]
            coded = self.plain.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "u4") for e in coded])
            ends = (np.flatnonzero(self.last[ids]) + 1) * width
            assert len(ends) == len(some)
            flat = self._bytes(ids)
            begin = 0
            for word, end in zip(some, ends.tolist()):
                found[word] = flat[begin:end]
                begin = end
        return found

    def _encoded(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of each key: a word in small letters, or whatever else stands between blanks."""
        found = self._words([k for k in keys if _WORD(k)])
        alone = [k for k in keys if k not in found]
        for some in (alone[i : i + 20_000] for i in range(0, len(alone), 20_000)):
            coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            found.update((key, self._bytes(e.ids)) for key, e in zip(some, coded))
        return found

    def _remembered(self, keys: list[str]) -> list[bytes]:
        """Ids of each key, of which none comes twice."""
        out = list(map(self.known.get, keys))
        new = [k for k, ids in zip(keys, out) if ids is None]
        if len(self.known) + len(new) > self.kept:
            self.known = {k: ids for k, ids in zip(keys, out) if ids is not None}
        found = self._encoded(new)
        self.known.update((k, ids) for k, ids in found.items() if len(k) < 64)  # long ones hardly come back
        return [found[k] if ids is None else ids for k, ids in zip(keys, out)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and how many each has."""
        rows = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        places = rows.flatten().dictionary_encode()
        parts = places.dictionary
        marked = pc.extract_regex(parts, _MARKED)
        words = pc.if_else(marked.is_valid(), pc.utf8_lower(pc.struct_field(marked, "word")), parts)
        marks = pc.fill_null(pc.struct_field(marked, "marks"), "")
        pieces = pa.concat_arrays([words, marks]).dictionary_encode()
        ids = self._remembered(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        # ids of each part, which are its word's and its marks', and of the end as one part more
        flat, n = _runs(
            np.frombuffer(b"".join(ids), f"<u{self.width}"),
            np.fromiter(map(len, ids), np.int64, len(ids)) // self.width,
            pieces.indices.to_numpy().reshape(2, -1).T.ravel(),
        )
        flat, n = np.append(flat, flat.dtype.type(self.end_id)), np.append(n.reshape(-1, 2).sum(1), 1)
        # ids of each text
        ends = np.cumsum(rows.value_lengths().to_numpy())
        flat, n = _runs(flat, n, np.insert(places.indices.to_numpy(), ends, len(parts)))
        closed = np.cumsum(n)[ends + np.arange(len(ends))]
        return flat, np.diff(closed, prepend=0)


_loaded: dict[tuple, WordEncoder] = {}


def _encoder(*key) -> WordEncoder:
    if key not in _loaded:
        _loaded[key] = WordEncoder(*key)
    return _loaded[key]


def _block(part: int, before: int, docs: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    words, offsets = pack(ids, lengths)
    one = np.array([len(lengths)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()),
            pa.array([before], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
            list_array(lengths, one, pa.int32()),
            list_array(offsets, one + 1, pa.int32()),
            pa.array([words.astype("<u8").tobytes()], pa.binary()),
        ],
        names=["part", "ids_before", "doc_ids", "lengths", "offsets", "words"],
    )


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = 1 << 18, kept: int = 800_000
) -> None:
    """Encode ``doc_id, text`` and write the token files to ``path``.

    ``tokenizer`` is a file of the tokenizers library that every executor has at this
    path; ``end_id`` is appended to each document. A ``doc_id`` that is not a number
    has to be given one first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer, end_id, kept), TaskContext.get().partitionId()
        open_rows: list[tuple] = []
        size = before = 0

        def block() -> pa.RecordBatch:
            docs, ids, lengths = zip(*open_rows)
            return _block(part, before, pa.concat_arrays(docs), np.concatenate(ids), np.concatenate(lengths))

        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                docs, (ids, lengths) = batch.column("doc_id"), encoder.encode(batch.column("text"))
                ends = np.cumsum(lengths)
                row = done = 0
                while (last := int(np.searchsorted(ends, done + block_ids - size))) < len(ends):
                    end = int(ends[last])
                    open_rows.append((docs[row : last + 1], ids[done:end], lengths[row : last + 1]))
                    yield block()
                    before, size, open_rows = before + size + end - done, 0, []
                    row, done = last + 1, end
                if row < len(ends):
                    open_rows.append((docs[row:], ids[done:], lengths[row:]))
                    size += len(ids) - done
        if open_rows:
            yield block()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    same = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), same).sortWithinPartitions("doc_id", same)
    ordered.mapInArrow(run, BLOCK).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document of the files; ids as bytes of
    little-endian unsigned 32-bit integers, start as the ids of all documents before it."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    # one row for each written partition
    sizes = blocks.groupBy("part").agg(
        F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("ids")
    )
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, docs, lengths, offsets, words = (c[row].as_py() for c in batch.columns)
                n = np.array(lengths, np.int64)
                ids = unpack(np.frombuffer(words, "<u8"), np.array(offsets, np.int64), n).astype("<u4")
                ends = np.cumsum(n)
                begins = (ends - n).tolist()
                out = [ids[a:b].tobytes() for a, b in zip(begins, ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(docs), pa.int32()),
                        pa.array(docs, pa.int64()),
                        pa.array(ends - n + before, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(out, pa.binary()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    rows = blocks.mapInArrow(run, "part int, doc_id bigint, start bigint, n_tokens bigint, ids binary")
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def checked(documents: DataFrame) -> DataFrame:
    """Digest of what was read back."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
