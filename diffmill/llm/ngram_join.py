"""N-gram Jaccard join (operator 9): size-aware, with light and heavy sets.

A document is the set of its word n-grams (shingles). Two sets of Jaccard similarity at
least t overlap in all but a few elements, so in any fixed order of all elements the first
few of both, their prefixes, share some. Light (small) sets enumerate the pairs of
elements of a prefix one longer, which any partner must share a pair with; heavy (large)
sets are found by the inverted lists of single prefix elements, in which every set that
may be a heavy set's partner stands too. The boundary is the size for which the counted
cost of all subsets and lists is least. The order puts elements that are frequent in a
sample last; it changes the cost, never the result.

Equal sets are one node from the start. Lists of single elements reach two elements
further than the prefix, where partners share three. In a short list every pair counts
what it shares; in a long one, members are first compared with one pivot, the set with
most copies, and joined into components. Only sets in long lists with more than one
component are left. For them the prefixes are formed anew, by how often an
element occurs among themselves, so that what tells them apart comes first; pairs in
different components are found by the shorter prefix of the smaller set and the longer one
of the larger, and only if the places of their common element allow the overlap. So a
group of near copies costs about its size, not its square, and no link between components
is lost.

Every set carries the parities of its elements' counts in 2,048 slots. Where two sets'
parities differ, they differ in an element, so a pair with too many such slots can't link;
this drops nearly all candidates that don't and none that do. The pairs that are left are
verified on the whole sets, read again from the texts of these documents alone.

Shingles are compared by 62 bits of a hash. Defined results: a text without words, null or
empty, has an empty set and links with nothing; with fewer words than the shingle length,
the whole sequence is one shingle; rows of equal ids are one node; rows of a null id link
with nothing; an empty table gives no rows; other columns are left out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.batches import byte_texts, list_array
from diffmill.llm.components import connected
from diffmill.sources.staging import staged

#: One in so many documents is counted to find frequent shingles; so many become last.
SAMPLE, LEAST_COUNT, FREQUENT = 8, 2, 1_000_000
#: Set sizes that may become the boundary of light and heavy.
BOUNDARIES = [0, 8, 9, 14, 19, 29, 39, 59, 79, 119, 159, 239, 319, 479, 639]
#: Lists of at most so many members give all their pairs, which then must share so many.
SHORT, SHARED = 8, 3
#: Counters that order the elements of the sets left after the pivots.
COUNTERS = 1 << 18
#: Up to so many ids (8 MB) are broadcast to find their texts; beyond, texts are joined.
BROADCAST_IDS = 1_000_000

#: Slots of the parities, in 64-bit words of a set.
SLOTS = 2048

_LAST = np.uint64(1 << 62)


class Shingler:
    """Sets of shingles of texts. Word hashes of the first words met are kept."""

    def __init__(self, words: int, kept: int = 150_000):
        self.words, self.kept = words, kept
        self.known: dict[bytes, int] = {}

    def hashed(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(known) < self.kept and len(w) < 64:
                    known[w] = h
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        """Ascending distinct hashes of 62 bits."""
        words = self.hashed(text.lower().split())
        n = min(self.words, len(words))
        if n == 0:
            return words
        with np.errstate(over="ignore"):
            size = len(words) - n + 1
            mixed = np.full(size, n, np.uint64)
            for k in range(n):
                mixed = (mixed ^ words[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed >> np.uint64(2))

    def ordered(self, text: bytes, frequent: np.ndarray) -> np.ndarray:
        """The set in the common order: frequent shingles last, by a bit above the hash."""
        found = self.shingles(text)
        if len(frequent) and len(found):
            at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
            late = frequent[at] == found
            if late.any():
                found = np.concatenate([found[~late], found[late] | _LAST])
        return found


def least_overlap(size, percent: int):
    """The overlap that any partner of a set of this size needs."""
    return (percent * size + 99) // 100


def _signature(found: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(found.tobytes())
    a, b = np.frombuffer(digest, "<i8")
    return int(a), int(b)


def _parities(found: np.ndarray) -> np.ndarray:
    counts = np.bincount((found & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    return np.packbits(counts & 1).view(np.int64)


def _sample_counts(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [shingler.shingles(x) for x in byte_texts(batch.column("text"))]
            if found:
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["key", "n"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(SAMPLE)) == 0)
    counts = some.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """At most ``FREQUENT`` shingles that are most frequent in the sample, ascending."""
    top = _sample_counts(docs, words).orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()
    return np.sort(top.column("key").to_numpy().astype(np.uint64))


def sketches(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``doc_id, n, sig1, sig2, sketch, parity``: size and signature of each set, the
    prefix of its order with ``SHARED`` elements more, and the parities of its slots."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [shingler.ordered(x, shared.value) for x in byte_texts(batch.column("text"))]
                size = np.array([len(x) for x in found], np.int64)
                prefix = size - least_overlap(size, percent) + 1
                reach = np.minimum(size, prefix + SHARED)
                parts = [x[:k] for x, k in zip(found, reach.tolist())]
                signs = np.array([_signature(x) for x in found], np.int64).reshape(-1, 2)
                flat = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
                parity = np.array([_parities(x) for x in found], np.int64).reshape(-1)
                each = np.full(len(found), SLOTS // 64, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(size, pa.int64()),
                        pa.array(signs[:, 0]),
                        pa.array(signs[:, 1]),
                        list_array(flat, reach, pa.int64()),
                        list_array(parity, each, pa.int64()),
                    ],
                    names=["doc_id", "n", "sig1", "sig2", "sketch", "parity"],
                )

    schema = "doc_id bigint, n bigint, sig1 bigint, sig2 bigint, sketch array<bigint>, parity array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def _documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, text`` for the documents of ``ids`` (one row per ``id``), and its other columns."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(wanted, "id")


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with the sets of their texts."""
    shingler = Shingler(words)
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            yield batch, [shingler.shingles(x).astype(np.int64) for x in byte_texts(batch.column("text"))]


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, set`` for the documents of ``ids`` (``id``), written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _sets(batches, words):
            size = np.array([len(x) for x in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), list_array(np.concatenate(found), size, pa.int64())], names=["id", "set"]
            )

    rows = _documents(docs, staged(ids.distinct(), "join-ids"))
    return staged(rows.mapInArrow(run, "id bigint, set array<bigint>"), "join-sets")


def _slot(elements: np.ndarray) -> np.ndarray:
    return (elements & (COUNTERS - 1)).astype(np.int64)


def _rarity(rows: DataFrame, words: int) -> np.ndarray:
    """Counters of the elements of all sets; elements share them, which does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, found in _sets(batches, words):
            total += np.bincount(_slot(np.concatenate(found)), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    counts = rows.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _rare_prefixes(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, group, n, place, key``: the prefix of each set, the rarest elements first."""
    rarity = rows.sparkSession.sparkContext.broadcast(_rarity(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _sets(batches, words):
            size = np.array([len(x) for x in found], np.int64)
            prefix = np.minimum(size, size - least_overlap(size, percent) + 1)
            keys = [x[np.lexsort((x, rarity.value[_slot(x)]))][:p] for x, p in zip(found, prefix.tolist())]
            places = np.concatenate([np.arange(p) for p in prefix.tolist()])
            of_row = [pa.array(np.repeat(x, prefix), pa.int64()) for x in (batch["id"], batch["group"], size)]
            columns = [*of_row, pa.array(places, pa.int64()), pa.array(np.concatenate(keys), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "group", "n", "place", "key"])

    return rows.mapInArrow(run, "id bigint, group bigint, n bigint, place bigint, key bigint")


def _prefix(n: Column, percent: int) -> Column:
    return n - F.floor((percent * n + 99) / 100) + 1


def _boundary(reps: DataFrame, percent: int) -> int:
    """The size up to which enumerating pairs of prefix elements costs less than lists of
    single ones. A place in a list costs one row, and three more if it shares its list,
    for it is then joined, written and grouped; how many do is counted on the lists of
    every 16th element."""
    p = _prefix(F.col("n"), percent)
    lists = (
        reps.select(F.explode(F.slice("sketch", 1, p.cast("int"))).alias("key")).filter("pmod(key, 16) = 0")
        .groupBy("key").count()
    )
    row = lists.agg(
        F.sum("count").alias("all"), F.sum(F.when(F.col("count") > 1, F.col("count"))).alias("shared")
    ).first()
    mean = 1 + 3 * (row["shared"] or 0) / (row["all"] or 1)
    light = p * (p + 1) / 2
    costs = reps.agg(
        *[
            F.sum(F.when(F.col("n") <= b, light).otherwise(0) + F.when(F.col("n") >= least_overlap(b + 1, percent), p * mean).otherwise(0)).alias(str(b))
            for b in BOUNDARIES
        ]
    ).first()
    return min(BOUNDARIES, key=lambda b: (costs[str(b)] or 0, b))


def _postings(reps: DataFrame, percent: int, boundary: int) -> DataFrame:
    """``key, id, n, copies``: the lists a set stands in. Keys of pairs are negative."""
    p = _prefix(F.col("n"), percent).cast("int")
    own = ["id", "n", "copies"]
    longer = F.col("longer")
    pair = lambda a, i: F.transform(
        F.slice(longer, i + 2, F.size(longer)), lambda b: F.xxhash64(a, b).bitwiseOR(F.lit(-(1 << 63)))
    )
    light = (
        reps.filter(F.col("n").between(2, boundary))
        .select(*own, F.slice("sketch", 1, p + 1).alias("longer"))
        .select(*own, F.explode(F.flatten(F.transform("longer", pair))).alias("key"))
    )
    single = reps.filter(F.col("n") >= max(2, least_overlap(boundary + 1, percent))).select(
        *own, F.explode(F.slice("sketch", 1, p + SHARED - 1)).alias("key")
    )
    return light.unionByName(single)


class Join:
    """Links between the representatives of equal sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int):
        self.docs, self.reps, self.words, self.percent = docs, reps, words, percent
        self.links: DataFrame | None = None

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose parities allow the overlap."""
        side = lambda x: self.reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
        rows = pairs.join(side("a"), "a").join(side("b"), "b")
        apart = F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        least = F.aggregate(apart, F.lit(0), lambda total, x: total + x)
        both = F.col("na") + F.col("nb")
        return rows.filter((100 - self.percent) * both >= (100 + self.percent) * least).select("a", "b").distinct()

    def _verified(self, pairs: DataFrame) -> None:
        """Adds the links among the pairs, by the whole sets of those that are possible."""
        pairs = staged(self._possible(pairs), "join-possible")
        sets = full_sets(self.docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), self.words)
        side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
        rows = pairs.join(side("a"), "a").join(side("b"), "b")
        overlap = F.size(F.array_intersect("sa", "sb"))
        similar = 100 * overlap >= self.percent * (F.size("sa") + F.size("sb") - overlap)
        found = staged(rows.filter(similar).select("a", "b").distinct(), "join-links")
        self.links = found if self.links is None else self.links.unionByName(found)

    def _with_pivots(self, lists: DataFrame) -> DataFrame:
        pivots = lists.groupBy("key").agg(F.max(F.struct("copies", (-F.col("id")).alias("minus"), "n")).alias("p"))
        pivots = pivots.select("key", (-F.col("p.minus")).alias("other"), F.col("p.n").alias("other_n"))
        small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
        fits = (F.col("id") != F.col("other")) & (100 * small >= self.percent * large)
        return lists.join(pivots, "key").filter(fits).select(
            F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")
        )

    def _in_short_lists(self, lists: DataFrame) -> DataFrame:
        x, y = lists.alias("x"), lists.alias("y")
        small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        rows = x.join(
            y,
            (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (100 * small >= self.percent * large),
        )
        counted = rows.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
            F.count("*").alias("shared"), F.min("x.key").alias("key"), F.max(large).alias("large")
        )
        # a negative key is a pair of elements of two light sets
        least = F.least(F.lit(SHARED), F.floor((self.percent * F.col("large") + 99) / 100))
        return counted.filter((F.col("key") < 0) | (F.col("shared") >= least)).select("a", "b")

    def run(self, postings: DataFrame) -> DataFrame:
        """``node, component`` of all sets that link with another."""
        # most elements stand alone: only keys and ids are shuffled to find that out
        shared = postings.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
        found = postings.select("key", "id").join(shared, "key")
        lists = staged(found.join(self.reps.select("id", "n", "copies"), "id"), "join-lists")
        short, long = lists.filter(F.col("members") <= SHORT), lists.filter(F.col("members") > SHORT)
        self._verified(self._in_short_lists(short).unionByName(self._with_pivots(long)).distinct())
        groups = staged(connected(self.links), "join-groups")
        left = staged(self._left(long, groups), "join-left")
        if left.isEmpty():
            return groups
        self._verified(staged(self._across(left), "join-across"))
        return connected(self.links)

    def _left(self, lists: DataFrame, groups: DataFrame) -> DataFrame:
        """``id, group`` of the sets in lists with more than one component."""
        rows = lists.select("key", "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
        rows = rows.select("key", "id", F.coalesce("component", "id").alias("group"))
        open_lists = rows.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y")
        return rows.join(open_lists, "key").select("id", "group").distinct()

    def _across(self, left: DataFrame) -> DataFrame:
        """``a, b``: pairs of different components whose first common element lies
        where it allows the overlap. The smaller set stands in the lists with as many
        elements as a partner not below its own size can't all miss."""
        rows = staged(_rare_prefixes(_documents(self.docs, left), self.words, self.percent), "join-rare")
        enough = F.ceil(2 * self.percent * F.col("n") / (100 + self.percent))
        standing = rows.filter(F.col("place") <= F.col("n") - enough).alias("y")
        asking = rows.alias("x")
        common = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
        found = asking.join(
            standing,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.group") != F.col("y.group"))
            & (F.struct("y.n", "y.id") < F.struct("x.n", "x.id"))
            & (100 * common >= self.percent * (F.col("x.n") + F.col("y.n") - common)),
        )
        return found.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct()


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, for shingles of ``words``
    words and links at a Jaccard similarity of ``percent`` / 100 or more.

    ``percent`` is above 50: below, sets that share a single one of two shingles would
    link, which pairs of a prefix's elements can't find; that is an error.
    """
    if not 50 < percent <= 100:
        raise ValueError(f"a similarity of {percent} % is out of range: above 50 and up to 100")
    own = docs.select("doc_id", "text")
    rows = staged(sketches(own, words, percent, frequent_shingles(own, words)), "join-sketches")
    filled = rows.filter("n > 0 AND doc_id IS NOT NULL")
    signature = ["n", "sig1", "sig2"]
    reps = staged(
        filled.groupBy(*signature).agg(
            F.min("doc_id").alias("id"),
            F.count("*").alias("copies"),
            F.min_by("sketch", "doc_id").alias("sketch"),
            F.min_by("parity", "doc_id").alias("parity"),
        ),
        "join-sets",
    )
    join = Join(own, reps.select("id", "n", "copies", "sketch", "parity"), words, percent)
    # an id with several texts holds them together
    same = filled.join(reps.select(*signature, "id"), signature).filter("doc_id <> id")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    join.links = same.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    groups = join.run(_postings(join.reps, percent, _boundary(join.reps, percent)))
    found = reps.select(*signature, "id").join(groups, F.col("id") == F.col("node"), "left")
    found = found.select(*signature, F.coalesce("component", "id").alias("component"))
    # copies are many rows of one signature; the other side has one row for each
    placed = rows.select("doc_id", *signature).join(found, signature, "left")
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
