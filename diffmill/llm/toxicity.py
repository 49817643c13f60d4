"""Toxicity by class-conditional Kneser-Ney models (operator 4).

Two models of the letters in a word, one of toxic and one of ordinary texts, give each
letter a chance by the letters before it. What a class has seen counts at the longest
context; the rest of the mass goes to shorter contexts by continuation counts that both
classes share, so that expressions which are rare in either class do not decide. A word's
ratio is the sum over its letters. A document is described by the difference of its
length-normalised log-likelihoods and by those of its most toxic words; a logistic
curve turns that into a score.

N-grams are counted in all labelled documents, and Spark forms the ratios from the counts.
Only the curve is fitted on a bounded sample: at most ``per_class`` documents of each class,
those with the lowest hash of their id, under ratios that leave them out. Ratios reach the
workers as sorted 64-bit hashes of the n-grams, 16 bytes each. Words are compared in lower
case by their letters and digits alone, so marks inside a word do not hide it.

Defined results: a null or empty text, or one without letters and digits, gets the score
of a text of no evidence; unlabelled rows and null labels teach nothing; of repeated
labels the highest counts; with no labelled text of one class every score is 0; repeated rows are
scored each; an empty table gives no rows.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.batches import byte_texts
from diffmill.sources.staging import staged

ORDER = 5
START, END = "\x02", "\x03"
FEATURES = ["ratio", "first", "top"]
#: Distinct words that a task gathers before it hands their n-grams on.
WORDS = 30_000


def plain(word: str) -> str:
    """The letters and digits of a word in lower case."""
    low = word.lower()
    if low.isalnum():
        return low
    if low[:-1].isalnum():  # one mark behind it
        return low[:-1]
    return "".join(c for c in low if c.isalnum())


def grams(word: str) -> Iterator[str]:
    """For each letter, and the end, it and the up to four letters before it; a word's
    start counts as a letter."""
    whole = START + word + END
    for i in range(2, len(whole) + 1):
        yield whole[max(0, i - ORDER) : i]


def _discount(counts) -> float:
    of = Counter(min(n, 3) for n in counts)
    return of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5


def log_ratios(toxic: dict[str, int], ordinary: dict[str, int]) -> dict[str, float]:
    """Log of the toxic over the ordinary chance of the last letter of each gram seen in
    either class; and, under a context alone, of any letter not seen after it."""
    # shared continuation counts: in how many ways a gram goes on to the left
    shared: dict[str, int] = Counter()
    level = defaultdict(set)
    for g in toxic.keys() | ordinary.keys():
        level[len(g)].add(g)
    for size in range(ORDER, 1, -1):
        for g in level[size]:
            shared[g[1:]] += 1
            level[size - 1].add(g[1:])

    def contexts(counts: dict[str, int]) -> tuple[Counter, Counter]:
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        return total, kinds

    total, kinds = contexts(shared)
    d = _discount(shared.values())
    chances: dict[str, float] = {}
    alphabet = max(kinds[""], 1)

    def chance(g: str) -> float:
        """Of the last letter of a gram by the shared counts."""
        if g == "":
            return 1 / alphabet
        if g not in chances:
            h, below = g[:-1], chance(g[1:]) if len(g) > 1 else 1 / alphabet
            if total[h]:
                below = (max(shared.get(g, 0) - d, 0) + d * kinds[h] * below) / total[h]
            chances[g] = below
        return chances[g]

    out: dict[str, float] = {}
    sides = [(c, *contexts(c), _discount(c.values())) for c in (toxic, ordinary)]
    for h in sides[0][1].keys() | sides[1][1].keys():
        left = [dk * ks[h] / ts[h] if ts[h] else 1.0 for _, ts, ks, dk in sides]
        out[h + "\x00"] = math.log(left[0] / left[1])
    for g in toxic.keys() | ordinary.keys():
        h, below = g[:-1], chance(g[1:])
        seen = [
            (max(c.get(g, 0) - dk, 0) + dk * ks[h] * below) / ts[h] if ts[h] else below
            for c, ts, ks, dk in sides
        ]
        out[g] = math.log(seen[0] / seen[1])
    return out


def _keys(codes: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams from the code points of each place, 0 before a short one."""
    with np.errstate(over="ignore"):
        x = np.zeros(len(codes[0]), np.uint64)
        for c in codes:
            x = (x ^ c.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _gram_keys(grams: list[str]) -> np.ndarray:
    keys = np.zeros(len(grams), np.uint64)
    for at in range(0, len(grams), 100_000):
        some = grams[at : at + 100_000]
        padded = _codes("".join(g.rjust(ORDER, "\x00") for g in some)).reshape(-1, ORDER)
        keys[at : at + len(some)] = _keys(list(padded.T))
    return keys


@dataclass
class Ratios:
    """Log ratios by the hash of their n-gram, in its order."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, grams: list[str], values: np.ndarray) -> "Ratios":
        return cls.sorted(_gram_keys(grams), values)

    @classmethod
    def sorted(cls, keys: np.ndarray, values: np.ndarray) -> "Ratios":
        order = np.argsort(keys)
        return cls(keys[order], np.asarray(values, float)[order])

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of the keys, 0 if not known, and whether they are."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.values[at], 0.0), known

    def of_words(self, words: list[str]) -> np.ndarray:
        """For each word, of letters and digits, the sum over its n-grams."""
        if not words:
            return np.zeros(0)
        codes = _codes("".join(START + w + END for w in words))
        sizes = np.array([len(w) + 2 for w in words])
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        places = []
        for back in range(ORDER - 1, -1, -1):
            earlier = np.concatenate([np.zeros(back, codes.dtype), codes])[: len(codes)]
            places.append(np.where(place >= back, earlier, 0))
        value, known = self.get(_keys(places))
        alone, _ = self.get(_keys([*places[:-1], np.zeros_like(codes)]))
        value = np.where(place > 0, np.where(known, value, alone), 0.0)
        return np.add.reduceat(value, starts)


@dataclass
class WordScorer:
    """Ratios of words, by table. A batch looks each distinct word up once; ratios that
    were formed are kept, up to a fixed number."""

    ratios: Ratios | dict[str, float]
    kept: int = 250_000

    def __post_init__(self):
        if isinstance(self.ratios, dict):
            self.ratios = Ratios.of(list(self.ratios), np.array(list(self.ratios.values())))
        self.known: dict[str, float] = {}

    def values(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.kept:
            known.clear()
            new = words
        letters = [plain(w) for w in new]
        some = [k for k, x in enumerate(letters) if x]
        found = np.zeros(len(new))
        found[some] = self.ratios.of_words([letters[k] for k in some])
        known.update(zip(new, found.tolist()))
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def ratio(self, word: str) -> float:
        return float(self.values([word])[0])

    def features(self, column: pa.Array) -> np.ndarray:
        """A row for each text: the ratio of all words by its letters, the largest ratio of a word,
        and a third of the three largest that are above 0."""
        texts = pc.fill_null(column, "")
        split = pc.ascii_split_whitespace(texts)
        parts = split.flatten().dictionary_encode()
        words = parts.dictionary.to_pylist()
        place = parts.indices.to_numpy()
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        real = np.array([w != "" for w in words], bool)[place] if len(place) else np.zeros(0, bool)
        value, doc = self.values(words)[place[real]], doc[real]
        out = np.zeros((len(texts), len(FEATURES)))
        counts = np.bincount(doc, minlength=len(texts))
        letters = pc.binary_length(texts).to_numpy() - counts
        out[:, 0] = np.bincount(doc, value, len(texts)) / np.maximum(letters, 1)
        order = np.lexsort((value, doc))
        ranked, ends = value[order], np.cumsum(counts)
        some = np.flatnonzero(counts)
        out[some, 1] = ranked[ends[some] - 1]
        for k in range(1, 4):
            has = np.flatnonzero(counts >= k)
            out[has, 2] += np.maximum(ranked[ends[has] - k], 0) / 3
        return out


@dataclass
class Model:
    """Word ratios and the logistic curve over the features."""

    ratios: Ratios
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    shared: Broadcast | None = None  # the ratios, as workers have them


def _curve(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps."""
    mean, scale = features.mean(0), features.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    x = np.column_stack([np.ones(len(features)), (features - mean) / scale])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.1
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (toxic - p)) - ridge @ w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(Ratios.of([], np.zeros(0)), w, mean, scale)


def _features(rows: DataFrame, ratios, extra: list[str]) -> DataFrame:
    """The features of every text, with the columns ``extra`` beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScorer(ratios.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                table = scorer.features(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in extra], *[pa.array(table[:, k]) for k in range(len(FEATURES))]],
                    names=[*extra, *FEATURES],
                )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in extra)
    schema = kinds + "".join(f", {c} double" for c in FEATURES)
    return rows.select(*[F.col(f"`{c}`") for c in extra], "text").mapInArrow(run, schema)


def _gram_counts(rows: DataFrame) -> DataFrame:
    """``gram``, ``t`` and ``o``, its number in toxic and ordinary texts of labelled rows,
    and ``ct`` and ``co``, those without the rows of ``fits_curve``."""

    def counted(words: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (toxic, curve), found in words.items():
            counts: Counter = Counter()
            for word, n in found.items():
                letters = plain(word.decode("utf-8", "replace"))
                if letters:
                    for g in grams(letters):
                        counts[g] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([toxic] * len(counts), pa.int32()),
                    pa.array([curve] * len(counts), pa.bool_()),
                    pa.array(list(counts.keys()), pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["toxic", "fits_curve", "gram", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            marks = zip(batch.column("toxic").to_pylist(), batch.column("fits_curve").to_pylist())
            for mark, text in zip(marks, byte_texts(batch.column("text"))):
                words[mark].update(text.split())
                if len(words[mark]) > WORDS:
                    yield from counted({mark: words.pop(mark)})
        yield from counted(words)

    schema = "toxic int, fits_curve boolean, gram string, n bigint"
    found = rows.select("toxic", "fits_curve", "text").mapInArrow(run, schema)
    of = lambda which: F.coalesce(F.sum(F.when(F.expr(which), F.col("n"))), F.lit(0))
    return found.groupBy("gram").agg(
        of("toxic = 1").alias("t"),
        of("toxic = 0").alias("o"),
        of("toxic = 1 AND NOT fits_curve").alias("ct"),
        of("toxic = 0 AND NOT fits_curve").alias("co"),
    )


def _discounts(rows: DataFrame, columns: list[str]) -> list[float]:
    sums = [F.sum((F.col(c) == k).cast("bigint")) for c in columns for k in (1, 2)]
    found = [n or 0 for n in rows.agg(*[x.alias(f"n{i}") for i, x in enumerate(sums)]).first()]
    return [a / (a + 2 * b) if a and b else 0.5 for a, b in zip(found[::2], found[1::2])]


def spark_ratios(counts: DataFrame) -> DataFrame:
    """As ``log_ratios``, from ``gram, t, o`` to ``gram, ratio``."""
    context, rest = F.expr("left(gram, length(gram) - 1)"), F.expr("substring(gram, 2)")
    ends = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda i: F.substring("gram", i, F.length("gram")))
    seen = counts.select(F.explode(ends).alias("gram")).distinct()
    shared = staged(seen.groupBy(rest.alias("gram")).agg(F.count("*").alias("n")), "toxic-shared")
    d = _discounts(shared, ["n"])[0]
    totals = shared.groupBy(context.alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rows = shared.withColumn("h", context).join(totals, "h")
    value = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("below")) / F.col("total")
    alphabet = max(shared.filter("length(gram) = 1").count(), 1)
    level = rows.filter("length(gram) = 1").withColumn("below", F.lit(1 / alphabet)).select("gram", value.alias("chance"))
    chances = level = staged(level, "toxic-chances")
    for size in range(2, ORDER):
        below = level.select(F.col("gram").alias("rest"), F.col("chance").alias("below"))
        level = rows.filter(F.length("gram") == size).withColumn("rest", rest).join(below, "rest")
        level = staged(level.select("gram", value.alias("chance")), "toxic-chances")
        chances = chances.unionByName(level)
    dt, do = _discounts(counts, ["t", "o"])
    of_class = counts.groupBy(context.alias("h")).agg(
        F.sum("t").alias("tt"), F.sum("o").alias("to"),
        F.sum(F.expr("int(t > 0)")).alias("kt"), F.sum(F.expr("int(o > 0)")).alias("ko"),
    )

    def left(d: float, kinds: str, total: str) -> Column:
        return F.when(F.col(total) > 0, d * F.col(kinds) / F.col(total)).otherwise(1.0)

    def at(n: str, d: float, kinds: str, total: str) -> Column:
        own = F.when(F.col(total) > 0, F.greatest(F.col(n) - d, F.lit(0.0)) / F.col(total)).otherwise(0.0)
        return own + left(d, kinds, total) * F.col("chance")

    unseen = of_class.select(
        F.concat("h", F.lit("\x00")).alias("gram"), F.log(left(dt, "kt", "tt") / left(do, "ko", "to")).alias("ratio")
    )
    known = counts.withColumn("h", context).withColumn("rest", rest).join(of_class, "h")
    known = known.join(chances.withColumnRenamed("gram", "rest"), "rest")
    return known.select("gram", F.log(at("t", dt, "kt", "tt") / at("o", do, "ko", "to")).alias("ratio")).unionByName(unseen)


def _collected(counts: DataFrame) -> Ratios:
    """The ratios by hashes that tasks form: 16 bytes an n-gram reach the driver, whose
    number saturates, as there are so many ways to write five letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _gram_keys(batch.column("gram").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("ratio")], names=["key", "ratio"])

    found = spark_ratios(counts).mapInArrow(run, "key bigint, ratio double").toArrow()
    return Ratios.sorted(found.column("key").to_numpy().view(np.uint64), found.column("ratio").to_numpy())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 4000) -> Model | None:
    """The model from labelled documents for which ``learn``, a column over ``doc_id``,
    holds. None if a class has no document with a letter or digit."""
    known = labels.filter(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # ids and classes alone; beyond a million of them the planner decides
    known = staged(known, "toxic-labels")
    known = F.broadcast(known) if known.count() < 1_000_000 else known
    present = staged(docs.select("doc_id").join(known, "doc_id").distinct(), "toxic-present")
    sizes = {r["toxic"]: r["count"] for r in present.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit(4))
    # a quarter of each class, but one document at least; an only one is counted as well
    curve = [
        present.filter(F.col("toxic") == k)
        .orderBy(order, "doc_id")
        .limit(min(per_class, max(sizes.get(k, 0) // 4, 1)))
        .select("doc_id", F.lit(sizes.get(k, 0) > 1).alias("fits_curve"))
        for k in (0, 1)
    ]
    # at most 2 * per_class ids are broadcast
    sample = staged(curve[0].unionByName(curve[1]), "toxic-sample")
    rows = docs.select("doc_id", "text").join(known, "doc_id").join(F.broadcast(sample), "doc_id", "left")
    counts = staged(_gram_counts(rows.withColumn("fits_curve", F.coalesce("fits_curve", F.lit(False)))), "toxic-grams")
    kept = counts.filter("ct + co > 0").select("gram", F.col("ct").alias("t"), F.col("co").alias("o"))
    every = counts.select("gram", "t", "o")
    has_both = lambda x: all(x.agg(F.max("t"), F.max("o")).first())
    if not has_both(every):
        return None
    if not has_both(kept):  # only the curve's documents of a class have letters
        kept = every
    broadcast = docs.sparkSession.sparkContext.broadcast
    ids = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").join(known, "doc_id")
    found = _features(ids, broadcast(_collected(kept)), ["doc_id", "toxic"])
    # one text of each id, so that as many rows reach the driver
    found = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(*FEATURES)).alias("x")).select("toxic", "x.*").toArrow()
    toxic = found.column("toxic").to_numpy()
    features = np.column_stack([found.column(c).to_numpy() for c in FEATURES])
    # the sample has as many rows of each class; weigh them as all labels have them
    rate = {k: sizes[k] / max((toxic == k).sum(), 1) for k in (0, 1)}
    weight = np.where(toxic == 1, rate[1], rate[0])
    model = _curve(features, toxic.astype(float), weight / weight.mean())
    model.ratios = _collected(every)
    model.shared = broadcast(model.ratios)
    return model


def score(docs: DataFrame, model: Model | None, score: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the score of each whole text, with or without the text. Columns of
    the names of the features come back as they were."""
    own = [c for c in docs.columns if c != score and (keep_text or c != "text")]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in own], "text")
    extra = [f"_in_{c}" for c in own]
    back = [F.col(f"`_in_{c}`").alias(c) for c in own]
    if model is None:
        return docs.select(*back, F.lit(0.0).alias(score))
    shared = model.shared or docs.sparkSession.sparkContext.broadcast(model.ratios)
    found = _features(docs, shared, extra)
    value = F.lit(float(model.weights[0]))
    for k, c in enumerate(FEATURES):
        value = value + float(model.weights[k + 1]) * (F.col(c) - float(model.mean[k])) / float(model.scale[k])
    return found.select(*back, (1 / (1 + F.exp(-value))).alias(score))
