"""Language identification by language-bitmask n-gram filters (operator 6).

One bit-sliced Bloom filter for all languages: a slot holds a bit for each language, in as many masks as that takes, an
n-gram names three slots, and the bits common to all three are the languages that have
the n-gram. So one lookup answers for every language at once. A text's count for a
language is the number of its n-grams with that bit, corrected for the share that the
filter would answer by chance; the language with the highest corrected share decides.

N-grams are three letters, or two with a word border, in lower case. A language has an
n-gram if it is common enough there, in itself and against the language where it is most
common. The counts for that come from all learning rows; batches count first, Spark sums.
The filter has a fixed size, and what reaches the driver is bounded by it.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if nothing was learned; rows with a null language teach nothing; ties go to the
language first in order; repeated rows count and are judged each.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.batches import texts

UNKNOWN = "und"
HASHES = 3
_BITS = 21  # of a code point

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def gram_keys(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, one text after another, and where each text ends."""
    lowered = [x.lower() for x in rows]
    joined = " " + " ".join(lowered) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letter_table()[codes], codes, 32).astype(np.int64)
    ends = np.cumsum(np.array([len(x) + 1 for x in lowered], np.int64))
    inner = codes[1:-1] != 32
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = ((codes[:-2] << 2 * _BITS) | (codes[1:-1] << _BITS) | codes[2:])[inner]
    # a text's n-grams are those whose middle letter lies in it
    return keys, np.concatenate([[0], np.cumsum(inner)])[ends - 1]


def slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots of each key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    first, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return [((first + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(HASHES)]


#: Languages of a mask; a slot has a mask for every so many.
WIDTH = 64


@dataclass
class Filter:
    """``masks``: for every 64 of ``languages``, a bit for each of them by slot."""

    languages: list[str]
    masks: list[np.ndarray]

    def chance(self) -> np.ndarray:
        """By language, the share of unknown n-grams that the filter would answer for."""
        fill = [((self.masks[k // WIDTH] >> np.uint64(k % WIDTH)) & np.uint64(1)).mean() for k in range(len(self.languages))]
        return np.minimum(np.array(fill) ** HASHES, 0.99)

    def compact(self) -> list[np.ndarray]:
        used = [min(WIDTH, len(self.languages) - WIDTH * k) for k in range(len(self.masks))]
        return [mask.astype(np.min_scalar_type((1 << max(n, 0)) - 1)) for mask, n in zip(self.masks, used)]


def answers(masks: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """The languages that have each key, as masks; a language's bit is set if it is in all slots."""
    out = []
    for mask in masks:
        first, *others = slots(keys, len(mask))
        found = mask[first]
        for at in others:
            found &= mask[at]
        out.append(found)
    return out


def shares(masks: list[np.ndarray], chance: np.ndarray, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams of each text, and by language the corrected share it knows."""
    keys, ends = gram_keys(rows)
    every = answers(masks, keys)
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(rows), len(chance)))
    for k, p in enumerate(chance):
        found = every[k // WIDTH]
        bits = (found >> found.dtype.type(k % WIDTH)) & found.dtype.type(1)
        counts = np.diff(np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])[ends], prepend=0)
        out[:, k] = np.clip((counts - p * sizes) / np.maximum(sizes, 1) / (1 - p), 0, 1)
    return sizes, out


def _counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n``: each batch counts, Spark sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
                    by_lang.setdefault(lang, []).append(text)
                for lang, some in by_lang.items():
                    keys, counts = np.unique(gram_keys(some)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
                        names=["lang", "gram", "n"],
                    )

    found = rows.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, which: Column, size: int = 1 << 20, least: float = 2e-6, against: float = 0.2
) -> Filter:
    """The filter from ``lang`` and ``text`` of the rows where ``which`` holds.

    ``least``: share of a language's n-grams that one must have to be set, so that a
    language sets at most 1 / ``least``; ``against``: the part of its highest share in any
    language. For every 64 languages ``size`` slots reach the driver.
    """
    counts = _counts(docs.filter(which & F.col("lang").isNotNull()).select("lang", "text"))
    counts = counts.persist()
    try:
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        languages = sorted(totals)
        if not languages:
            return Filter([], [])
        # one row per language
        rows = [(lang, k, float(totals[lang])) for k, lang in enumerate(languages)]
        known = F.broadcast(docs.sparkSession.createDataFrame(rows, "lang string, number int, total double"))
        rated = counts.join(known, "lang").select("gram", "number", (F.col("n") / F.col("total")).alias("share"))
        # one row per n-gram, with an entry per language at most
        every = rated.groupBy("gram").agg(F.collect_list(F.struct("number", "share")).alias("found"), F.max("share").alias("top"))
        common = F.filter("found", lambda x: (x["share"] >= least) & (x["share"] >= against * F.col("top")))
        marks = every.select("gram", F.explode(common).alias("x")).select("gram", "x.number")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = np.tile(batch.column("number").to_numpy(), HASHES)
                keys = np.concatenate(slots(batch.column("gram").to_numpy(), size))
                bits = np.uint64(1) << (number % WIDTH).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number // WIDTH, pa.int32()), pa.array(keys), pa.array(bits.view(np.int64))], names=["word", "slot", "mask"]
                )

        set_bits = marks.mapInArrow(spread, "word int, slot bigint, mask bigint").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
        found = set_bits.toArrow()
    finally:
        counts.unpersist()
    word, slot = found.column("word").to_numpy(), found.column("slot").to_numpy()
    mask = found.column("mask").to_numpy().view(np.uint64)
    out = [np.zeros(size, np.uint64) for _ in range(-(-len(languages) // WIDTH))]
    for k in range(len(out)):
        out[k][slot[word == k]] = mask[word == k]
    return Filter(languages, out)


def identify(
    docs: DataFrame, known: Filter, lang: str = "lang_pred", score: str = "score", keep_text: bool = False
) -> DataFrame:
    """``docs`` with the language of each whole text and the share of its n-grams that
    this language has; with or without the text."""
    extra = [c for c in docs.columns if c not in (lang, score) and (keep_text or c != "text")]
    masks = docs.sparkSession.sparkContext.broadcast(known.compact())
    languages, chance = [*known.languages, UNKNOWN], known.chance()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, found = shares(masks.value, chance, texts(batch.column("text")))
                best = np.full(len(sizes), len(chance))
                top = np.zeros(len(sizes))
                if len(chance):
                    best = np.where(sizes > 0, found.argmax(1), len(chance))
                    top = np.where(sizes > 0, found.max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in extra],
                        pa.array([languages[k] for k in best.tolist()], pa.string()),
                        pa.array(top, pa.float64()),
                    ],
                    names=[*extra, lang, score],
                )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    texts_last = [F.col(f"`{c}`") for c in extra if c != "text"]
    return docs.select(*texts_last, "text").mapInArrow(run, f"{kinds}`{lang}` string, `{score}` double")
