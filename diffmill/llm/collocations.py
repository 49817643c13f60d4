"""Phrase collocations by Rabin-Karp fingerprints (operator 12).

A text is lower-cased (A to Z), cut into pieces and those into words. Prefix sums of a
polynomial over the bytes give every word's hash by one subtraction, prefix sums over the
word hashes every n-gram's, and language and length are mixed in. Two polynomials make up a
fingerprint of 64 bits and a check of 48, so the shuffle sees numbers alone: fingerprint, check, count,
and a pointer to an occurrence, the bucket of a document that has it.

A phrase is as frequent as its parts at least. Words are counted first, then pairs of
frequent words, then three and four words whose pairs are all frequent. What is frequent reaches the
tasks as a bit field of fixed size; other phrases that share a bit cost time and change
nothing. Fingerprints that meet by chance differ in their checks and are counted apart. Last,
only documents that a pointer names turn frequent phrases into text, and every task compares all
occurrences of a fingerprint and check in a slice with the first of them, word by word: if two
texts differ, which 112 bits make next to impossible, the job ends with an error.

Texts are worked off in slices of about ``SLICE`` bytes, cut where pieces end, so memory is
bounded by a slice and the longest piece.

Defined results: null texts are empty and have no words, null languages are ``und``;
repeated rows count each; an empty table gives no rows; other columns are left out.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffmill.llm.batches import byte_texts
from diffmill.sources.staging import staged

LONGEST = 4
SLICE = 1 << 20
#: Fingerprints that a task gathers before it hands them on.
GATHERED = 1_500_000
#: A bit field of 8 MB; beyond some 10^7 frequent phrases it prunes less and less.
FIELD_BITS = 26
CHECK_BITS, BUCKETS = 48, 1 << 16
UNKNOWN = "und"
_U = np.uint64
#: Bases of the two polynomials.
_BASES = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, ``n`` at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, SLICE + SLICE // 8)
        tables = []
        for step in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, step, _U)
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        _powers[base] = tables[0], tables[1]
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of each span of values, the same wherever the span lies."""
    power, inverse = _power_tables(len(values) + 1, base)
    prefix = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * inverse[starts]


class Words:
    """The words of a slice: bytes of some texts, each with its language's seed. ``mask``
    cuts fingerprints short in tests."""

    def __init__(self, texts: list[bytes], seeds: list[int], mask: int = (1 << 64) - 1):
        self.data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        self.mask = _U(mask)
        kind = _KIND[self.data]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.starts, self.ends = edge[::2], edge[1::2]
        lengths = np.array([len(x) + 1 for x in texts], np.int64)
        first = np.cumsum(lengths) - lengths
        self.text = np.searchsorted(first, self.starts, "right") - 1
        self.first = first
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        with np.errstate(over="ignore"):
            values, size = self.data.astype(_U), (self.ends - self.starts).astype(_U)
            self.hashes = [_mixed(_spans(values, self.starts, self.ends, base) + size) for base in _BASES]
            self.seed = _mixed(np.array(seeds, np.int64).astype(_U))[self.text] if len(texts) else np.zeros(0, _U)

    def places(self, n: int) -> np.ndarray:
        """Where n words lie in one piece."""
        w = len(self.starts)
        if w < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: w - n + 1] == self.piece[n - 1 :])

    def _prints(self, places: np.ndarray, n: int, which: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            own = self.hashes[which]
            poly = own[places] if n == 1 else _spans(own, places, places + n, _BASES[which])
            return _mixed(poly + self.seed[places] * _U(2 * n + 1))

    def fingerprints(self, places: np.ndarray, n: int) -> np.ndarray:
        return self._prints(places, n, 0) & self.mask

    def checks(self, places: np.ndarray, n: int) -> np.ndarray:
        return self._prints(places, n, 1) >> _U(64 - CHECK_BITS)

    def phrase(self, place: int, n: int) -> bytes:
        return b" ".join([self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(place, place + n)])

    def numbered(self) -> np.ndarray | None:
        """A number for each word, equal for equal words only: words of one hash are compared
        byte by byte with the first of them. None if two of them differ."""
        _, first, number = np.unique(self.hashes[0], return_index=True, return_inverse=True)
        first = first[number]
        size = self.ends - self.starts
        if not np.array_equal(size, size[first]):
            return None
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        own, other = self.data[np.repeat(self.starts, size) + step], self.data[np.repeat(self.starts[first], size) + step]
        return number if np.array_equal(own, other) else None


@dataclass
class Frequent:
    """Bit fields of the fingerprints that are frequent, by words and pairs and the rest."""

    fields: list[Broadcast]
    bits: int

    def has(self, level: int, prints: np.ndarray) -> np.ndarray:
        at = prints & _U((1 << self.bits) - 1)
        return (self.fields[level].value[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _candidates(words: Words, frequent: Frequent, levels: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and fingerprints of the phrases that can be frequent, as far as ``levels``
    fields tell, by length. The last length but one level is not tested itself."""
    out, count = {}, len(words.starts)
    ok = {}
    for n in range(1, LONGEST + 1):
        level = min(n, 3) - 1
        if level > levels:
            break
        places = words.places(n)
        if n > 1:
            inner = ok[min(n - 1, 2)]
            fits = np.ones(len(places), bool)
            for j in range(2 if n < 4 else 3):
                fits &= inner[places + j]
            places = places[fits]
        prints = words.fingerprints(places, n)
        if level < levels:
            fits = frequent.has(level, prints)
            places, prints = places[fits], prints[fits]
            ok[n] = np.zeros(count, bool)
            ok[n][places] = True
        out[n] = places, prints
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[int], list[int], list[int]]]:
    """Texts, seeds, rows and offsets of about ``SLICE`` bytes; long texts are cut after a
    separator of pieces."""
    texts, seeds, rows, begins, size = [], [], [], [], 0
    marks = batch.column("seed").to_pylist()
    for row, text in enumerate(byte_texts(batch.column("text"))):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                near = np.frombuffer(text, np.uint8, SLICE, at)
                cut = np.flatnonzero(_KIND[near] == 2)
                if len(cut):
                    end = at + int(cut[-1]) + 1
                else:  # a long piece stays whole
                    far = at + SLICE
                    while far < len(text):
                        cut = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, min(SLICE, len(text) - far), far)] == 2)
                        if len(cut):
                            end = far + int(cut[0]) + 1
                            break
                        far += SLICE
            texts.append(text[at:end])
            seeds.append(marks[row])
            rows.append(row)
            begins.append(at)
            size += end - at
            at = end
            if size >= SLICE:
                yield texts, seeds, rows, begins
                texts, seeds, rows, begins, size = [], [], [], [], 0
    if texts:
        yield texts, seeds, rows, begins


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # fingerprint, check, n, bucket


def _first_of_each(prints: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the phrases, and where in it each one begins."""
    order = np.lexsort((checks, prints))
    prints, checks = prints[order], checks[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
    return order, np.flatnonzero(begins)


def _merged(parts: list[Counts]) -> Counts:
    prints, checks, counts, buckets = (np.concatenate(c) for c in zip(*parts))
    order, first = _first_of_each(prints, checks)
    if not len(first):
        return prints, checks, counts, buckets
    one = order[first]
    return prints[one], checks[one], np.add.reduceat(counts[order], first), np.minimum.reduceat(buckets[order], first)


def _buckets(keys: pa.Array, rows: list[int], words: Words, places: np.ndarray) -> np.ndarray:
    """Bucket of the document that holds each place."""
    return (keys.to_numpy() & (BUCKETS - 1))[np.array(rows)][words.text[places]]


def _counted(rows: DataFrame, frequent: Frequent, levels: int, mask: int) -> DataFrame:
    """``fingerprint, check, n, bucket`` of the phrases of the level after those that are known."""

    def batch_of(found: Counts) -> pa.RecordBatch:
        prints, checks, counts, buckets = found
        return pa.RecordBatch.from_arrays(
            [pa.array(prints.view(np.int64)), pa.array(checks.view(np.int64)), pa.array(counts), pa.array(buckets)],
            names=["fingerprint", "check", "n", "bucket"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for texts, seeds, row, _ in _slices(batch):
                words = Words(texts, seeds, mask)
                for n, (places, prints) in _candidates(words, frequent, levels).items():
                    if min(n, 3) - 1 == levels and len(places):
                        buckets = _buckets(batch.column("key"), row, words, places)
                        parts.append(_merged([(prints, words.checks(places, n), np.ones(len(places), np.int64), buckets)]))
                        size += len(parts[-1][0])
                if size > GATHERED:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
                    if size > GATHERED // 2:
                        yield batch_of(parts.pop())
                        size = 0
        if parts:
            yield batch_of(_merged(parts))

    found = rows.select("key", "seed", "text").mapInArrow(run, "fingerprint bigint, check bigint, n bigint, bucket bigint")
    return found.groupBy("fingerprint", "check").agg(F.sum("n").alias("n"), F.min("bucket").alias("bucket"))


def _owned(prints: np.ndarray, checks: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Hash of a phrase and of a document bucket that is to turn it into text."""
    with np.errstate(over="ignore"):
        return _mixed(prints * _U(3) + _mixed(checks + buckets.astype(_U) * _U(_BASES[1])))


def _field(counts: DataFrame, bits: int, owners: bool = False) -> Broadcast:
    """Bit field of fingerprints, or of their owners: 2^(bits - 6) longs at most."""
    marks = counts.select("fingerprint")
    if owners:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prints, checks, buckets = (c.to_numpy() for c in batch.columns)
                mark = _owned(prints.view(_U), checks.view(_U), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64))], names=["fingerprint"])

        marks = counts.select("fingerprint", "check", "bucket").mapInArrow(run, "fingerprint bigint")
    slot = F.col("fingerprint").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr("shiftleft(1L, cast(fingerprint & 63 AS int))")
    found = marks.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    field = np.zeros(1 << (bits - 6), np.int64)
    field[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return counts.sparkSession.sparkContext.broadcast(field.view(np.uint8))


def _texts(rows: DataFrame, frequent: Frequent, mask: int) -> DataFrame:
    """``fingerprint, check, lang, words, phrase, doc_id, at``: phrases as text, from the documents
    that own them, with the byte of the text where one starts; and, as a phrase of no
    words, the number ``n`` of all words of a language."""
    schema = "fingerprint bigint, check bigint, lang string, words int, phrase string, doc_id string, at bigint, n bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    names = [field.split()[0] for field in schema.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(list(c), kind) for c, kind in zip(zip(*found), kinds)]
        columns[4] = columns[4].view(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            langs, docs = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
            for texts, seeds, row, begins in _slices(batch):
                words = Words(texts, seeds, mask)
                for k, n in enumerate(np.bincount(words.text, minlength=len(texts)).tolist()):
                    total[langs[row[k]]] += n
                number = words.numbered()
                found = []
                for n, (places, prints) in _candidates(words, frequent, 3).items():
                    checks = words.checks(places, n)
                    _verified(words, places, prints, checks, n, number)
                    owner = _owned(prints, checks, _buckets(batch.column("key"), row, words, places))
                    mine = np.flatnonzero(frequent.has(3, owner))
                    # once for each phrase of the slice
                    order, first = _first_of_each(prints[mine], checks[mine])
                    mine = mine[order[first]]
                    for k in mine.tolist():
                        place = int(places[k])
                        text = int(words.text[place])
                        found.append(
                            (int(prints[k].view(np.int64)), int(checks[k]), langs[row[text]], n, words.phrase(place, n),
                             docs[row[text]], int(words.starts[place] - words.first[text]) + begins[text], 0)
                        )
                if found:
                    yield batch_of(found)
        if total:
            yield batch_of([(0, 0, lang, 0, b"", None, None, n) for lang, n in total.items() if n])

    return rows.mapInArrow(run, schema)


def _verified(words: Words, places: np.ndarray, prints: np.ndarray, checks: np.ndarray, n: int, number) -> None:
    """All occurrences of a fingerprint and check have the words of the first one."""
    if len(places) < 2:
        return
    order = np.lexsort((checks, prints))
    own = places[order]
    same = (prints[order][1:] == prints[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    left, right = own[:-1][same], own[1:][same]
    equal = number is not None and all(np.array_equal(number[left + j], number[right + j]) for j in range(n))
    if not equal or not np.array_equal(words.seed[left], words.seed[right]):
        if any(words.phrase(a, n) != words.phrase(b, n) for a, b in zip(left.tolist(), right.tolist())):
            raise ValueError("two phrases have one fingerprint and check")


def phrases(docs: DataFrame, least: int = 30, field_bits: int = FIELD_BITS, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to 4 words that occur ``least`` times or more in a language:
    ``lang, words, phrase, f, doc_id, at``, the last two a pointer to an occurrence; and
    ``lang, n``, the number of words of each language. ``hash_bits`` below 64 serves tests of
    collisions."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    rows = docs.select(
        F.col("doc_id").cast("string"), lang.alias("lang"), F.xxhash64(lang).alias("seed"), F.xxhash64("text", lang).alias("key"), "text"
    )
    mask, fields, counts = (1 << hash_bits) - 1, [], None
    for level in range(3):
        found = _counted(rows, Frequent(list(fields), field_bits), level, mask)
        found = staged(found.filter(F.col("n") >= least), "phrase-counts")
        fields.append(_field(found, field_bits))
        counts = found if counts is None else counts.unionByName(found)
    fields.append(_field(counts, field_bits, owners=True))
    texts = staged(_texts(rows, Frequent(fields, field_bits), mask), "phrase-texts")
    one = texts.filter("words > 0").groupBy("fingerprint", "check").agg(
        F.min("lang").alias("lang"), F.min("words").alias("words"), F.min("phrase").alias("phrase"),
        F.min(F.struct("doc_id", "at")).alias("p"),
    )
    kept = counts.join(one, ["fingerprint", "check"])
    kept = staged(kept.select("lang", "words", "phrase", F.col("n").alias("f"), "p.doc_id", "p.at"), "phrases")
    return kept, texts.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def scored(kept: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of each phrase of two words or more, by its
    worst cut."""
    several = kept.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    split = F.split("phrase", " ")
    cut = several.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "words", "a", "k",
        F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("words")), " ").alias("right"),
    )

    def part(name: str, value: str) -> DataFrame:
        return kept.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))

    both = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # exact: decimals hold what long integers may not
    product = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    score = F.call_function("div", product, (F.col("l") + F.col("r")).cast("decimal(20,0)")).cast("bigint")
    return both.groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    ).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def without_parts(candidates: DataFrame, share: int = 80) -> DataFrame:
    """Candidates that no longer one holds and is nearly as frequent as."""
    split = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(split, i, n), " ")
            ),
        )
    )
    longer = candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("held"))
    held = longer.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = candidates.join(held, ["lang", "phrase"], "left")
    return kept.filter(F.coalesce(100 * F.col("held") < share * F.col("a"), F.lit(True))).drop("held")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, **hashing: int) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    kept, words = phrases(docs, least, **hashing)
    found = without_parts(scored(kept), share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each part first, so that no task ranks a whole language
    part = Window.partitionBy("lang", "part").orderBy(*order)
    best = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(part))
    ranked = best.filter(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    )
    return (
        ranked.filter(F.col("rank") <= top)
        .join(words, "lang")
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
