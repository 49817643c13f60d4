"""Vector codes: product quantisation by member-resident Lloyd rounds (operator 13).

Vectors are scaled to integers and cut into parts. Each part position has a codebook, and
a part is a member of the entry nearest to it. Members live with their owners: blocks of
them are partitioned by (position, entry, salt), and the salt, a hash of the row, splits an
entry that holds a large share of all rows. In a round owners sum their resident members, the
sums of all tasks, a few numbers per entry, make up the next codebook, and members look for
their entry again in place. Only those whose entry changes migrate in the next shuffle; the
union with those that stay keeps the partitioning and shuffles nothing. That is why members are an
RDD: a data frame that is read back no longer knows how it is partitioned. Each round ends
with a reliable checkpoint, so a lost executor costs tasks of one round.

A codebook has ``entries`` times the vector's length numbers, whatever the rows; that is all that
reaches the driver and the workers. A block holds at most the parts of one Arrow batch.

Defined results: rows whose vector is null, or holds null or non-finite components, or one
of 2^20 or more in size (its squares would leave 64 bits), are dropped; vectors of another
length than the one of the smallest id have a null code and error, and add nothing to
codebooks; of rows with equal ids each is coded on its own; null ids come after all others
when codebooks are started; with fewer vectors than entries there are fewer entries; a
length that the parts do not divide gives parts that differ by one; an empty table gives no
rows; other columns are left out.
"""

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.sources.staging import shared_dir, staged

LARGEST = float(1 << 20)
#: Rows that follow each other in the input and get their codes in one task.
TOGETHER = 12
Codebooks = list[np.ndarray]  # by position: entries by components
Owner = tuple[int, int, int]  # position, entry, salt
Block = tuple[np.ndarray, np.ndarray]  # row ids, their parts


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``row_id, vec_id, label, x``: the rows with usable vectors, as integers."""

    def usable(x):
        x = x.cast("double")
        return F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False))

    kept = F.col("embedding").isNotNull() & F.forall("embedding", usable)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("int"))
    return vectors.filter(kept).select(
        F.monotonically_increasing_id().alias("row_id"), "vec_id", "label", whole.alias("x")
    )


def _bounds(length: int, parts: int) -> list[int]:
    return [k * length // parts for k in range(parts + 1)]


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors of the smallest ids; at most ``entries`` rows are read."""
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = rows.orderBy(*by_id).select("x").limit(1).collect()
    if not first:
        return None
    length = len(first[0].x)
    chosen = rows.filter(F.size("x") == length).orderBy(*by_id).select("x").limit(entries).collect()
    start = np.array([r.x for r in chosen], np.int64).reshape(-1, length)
    at = _bounds(length, parts)
    return [start[:, a:b] for a, b in zip(at, at[1:])]


def nearest(part: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row; ties go to the lower entry."""
    entry, distance = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for a in range(0, len(part), 4096):
        d = np.zeros((len(part[a : a + 4096]), len(codebook)), np.int64)
        for c in range(codebook.shape[1]):
            d += (part[a : a + 4096, c].astype(np.int64)[:, None] - codebook[None, :, c]) ** 2
        entry[a : a + 4096] = d.argmin(1)
        distance[a : a + 4096] = d.min(1)
    return entry, distance


def _salt(row_id: np.ndarray, salts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = row_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64) % salts


def _spread(group: int) -> int:
    return (group * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32


def _dealt(position: int, row_id: np.ndarray, entry: np.ndarray, part: np.ndarray, salts: int) -> Iterator[tuple[Owner, Block]]:
    """Blocks of members by owner."""
    owner = entry * salts + _salt(row_id, salts)
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            e, salt = divmod(int(owner[own[0]]), salts)
            yield (position, e, salt), (row_id[own], part[own])


def _first_blocks(rows: DataFrame, books: Codebooks, salts: int) -> RDD:
    """A member for each part of each vector of the codebooks' length."""
    length = sum(b.shape[1] for b in books)
    at = _bounds(length, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(ids), length)
            for k, book in enumerate(books):
                part = np.ascontiguousarray(x[:, at[k] : at[k + 1]])
                blocks = [pickle.dumps(b, 5) for b in _dealt(k, ids, nearest(part, book)[0], part, salts)]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])

    own = rows.filter(F.size("x") == length).select("row_id", "x")
    return own.mapInArrow(run, "block binary").rdd.map(lambda row: pickle.loads(row[0]))


class Members:
    """Members of all entries, partitioned by owner."""

    def __init__(self, blocks: RDD, books: Codebooks, salts: int, partitions: int):
        entries = len(books[0])

        def place(owner: Owner) -> int:
            return (owner[0] * entries + owner[1]) * salts + owner[2]

        self.place, self.salts, self.partitions = place, salts, partitions
        self.blocks = self._kept(blocks.partitionBy(partitions, place))

    @staticmethod
    def _kept(blocks: RDD) -> RDD:
        """With a reliable checkpoint, which the next action writes."""
        blocks.checkpoint()
        return blocks

    def next_codebooks(self, books: Codebooks) -> Codebooks:
        """Each entry as the rounded-down mean of its members; entries without any stay."""

        def sums(blocks: Iterator[tuple[Owner, Block]]) -> Iterator[tuple]:
            found: dict[tuple[int, int], list] = {}
            for (position, entry, _), (ids, part) in blocks:
                total = found.setdefault((position, entry), [0, np.zeros(part.shape[1], np.int64)])
                total[0] += len(ids)
                total[1] += part.sum(0, dtype=np.int64)
            for key, (n, total) in found.items():
                yield key, (n, total.tolist())

        def added(a: tuple, b: tuple) -> tuple:
            return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]

        out = [b.copy() for b in books]
        # positions times entries rows
        for (position, entry), (n, total) in self.blocks.mapPartitions(sums).reduceByKey(added, self.partitions).collect():
            out[position][entry] = [x // n for x in total]
        return out

    def migrate(self, books: Codebooks) -> None:
        """Every member to the entry it is nearest to now; only those of another entry move."""
        salts = self.salts

        def staying(blocks: Iterator[tuple[Owner, Block]]) -> Iterator[tuple[Owner, Block]]:
            for owner, (ids, part) in blocks:
                stays = nearest(part, books[owner[0]])[0] == owner[1]
                if stays.any():
                    yield owner, (ids[stays], part[stays])

        def leaving(blocks: Iterator[tuple[Owner, Block]]) -> Iterator[tuple[Owner, Block]]:
            for owner, (ids, part) in blocks:
                entry = nearest(part, books[owner[0]])[0]
                goes = entry != owner[1]
                if goes.any():
                    yield from _dealt(owner[0], ids[goes], entry[goes], part[goes], salts)

        stay = self.blocks.mapPartitions(staying, preservesPartitioning=True)
        move = self.blocks.mapPartitions(leaving).partitionBy(self.partitions, self.place)
        self.blocks = self._kept(stay.union(move))

    def codes(self, books: Codebooks) -> RDD:
        """``row_id, code, error`` of each vector. Results of rows that follow each other meet
        in one task, which holds a byte per part and a number per row."""
        parts = len(books)

        def found(blocks: Iterator[tuple[Owner, Block]]) -> Iterator[tuple]:
            for (position, _, _), (ids, part) in blocks:
                entry, distance = nearest(part, books[position])
                group = ids >> TOGETHER
                order = np.argsort(group, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                    yield int(group[own[0]]), (position, ids[own], entry[own].astype(np.uint8), distance[own])

        def gathered(rows: Iterator[tuple]) -> Iterator[tuple]:
            size = 1 << TOGETHER
            groups: dict[int, tuple] = {}
            for group, (position, ids, entry, distance) in rows:
                if group not in groups:
                    groups[group] = np.zeros((size, parts), np.uint8), np.zeros(size, np.int64), np.zeros(size, bool)
                codes, errors, seen = groups[group]
                at = ids & (size - 1)
                codes[at, position] = entry
                errors[at] += distance
                seen[at] = True
            for group, (codes, errors, seen) in groups.items():
                for at in np.flatnonzero(seen).tolist():
                    yield group << TOGETHER | at, codes[at].tobytes().hex(), int(errors[at])

        return self.blocks.mapPartitions(found).partitionBy(self.partitions, _spread).mapPartitions(gathered)


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of each usable vector, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    spark = vectors.sparkSession
    rows = staged(integers(vectors), "code-vectors")
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # an entry that owns all parts of its position fills as many tasks as the position's share
    salts = max(4, -(-partitions // parts))
    members = Members(_first_blocks(rows, books, salts), books, salts, partitions)
    for k in range(rounds):
        if k:
            members.migrate(books)
        books = members.next_codebooks(books)
    codes = spark.createDataFrame(members.codes(books), "row_id bigint, code string, error bigint")
    return rows.select("row_id", "vec_id", "label").join(codes, "row_id", "left").drop("row_id"), books


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def digests(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Code and error of each vector, with the errors of its label together."""
    codes, books = compressed(vectors, parts, entries, rounds)
    codes = staged(codes, "vector-codes")
    labels = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error")
    return codes.join(labels, F.expr("label <=> of")).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
