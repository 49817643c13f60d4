"""Embedding near-dedup (operator 2): navigable small-world graphs per shard.

Vectors of a label are dealt to shards of bounded size. Each shard builds a hierarchical
navigable small-world graph, and every vector of the label is searched in every shard of
it. A beam widens for a search while everything in it links; and it widens for all
searches of a task until an audit passes: a part of the searches, chosen by hash, is
compared with all vectors of the shard, and each has to find its own links. If no beam
passes, every search of the task is compared so. Every link is verified by the cosine in
double precision. A search hands on how many it found and one link into each component of the
shard, so no task emits all pairs of a group; components are then joined over all shards.

Equal vectors are one vector with a number of copies. Searches reach a shard in blocks of
bounded size, together with its finished graph.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
vectors with a null label, link with nothing; vectors of different lengths do not link;
repeated rows are vectors of their own; rows of a null id have a null component; an empty
table gives no rows. Equality of vectors is by 128 bits of hashes.
"""

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.llm.components import connected
from diffmill.sources.staging import staged

#: Vectors of a shard, searches of a block, neighbours of a node, first beam.
SHARD, BLOCK, NEIGHBOURS, BEAM = 8192, 8192, 12, 64
#: One search in so many is audited, and no fewer than so many, of which so many have links
#: (or all searches); each has to find so much of what it links with, itself left out.
AUDIT, AUDITED, LINKED, RECALL = 32, 256, 32, 0.99


class Graph:
    """A navigable small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, m: int = NEIGHBOURS, beam: int = BEAM, seed: int = 2):
        self.vectors, self.m = vectors, m
        draws = np.random.default_rng(seed).random(len(vectors))
        self.levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(m)).astype(int), 8).tolist()
        self.links: list[list[list[int]]] = [[[] for _ in range(k + 1)] for k in self.levels]
        self.entry, self.top = (0, self.levels[0]) if len(vectors) else (-1, -1)
        for node in range(1, len(vectors)):
            self._insert(node, beam)

    def _beam(self, q: np.ndarray, starts: list[int], level: int, width: int) -> list[tuple[float, int]]:
        """The best ``width`` found from ``starts``, as similarity and node."""
        vectors, links, seen = self.vectors, self.links, set(starts)
        first = [(float(s), x) for s, x in zip(vectors[starts] @ q, starts)]
        ahead = [(-s, x) for s, x in first]
        heapq.heapify(ahead)
        best = first[:]
        heapq.heapify(best)
        while ahead:
            minus, node = heapq.heappop(ahead)
            if len(best) >= width and -minus < best[0][0]:
                break
            new = [x for x in links[node][level] if x not in seen]
            if not new:
                continue
            seen.update(new)
            least = best[0][0] if len(best) >= width else -2.0
            for s, x in zip((vectors[new] @ q).tolist(), new):
                if s > least or len(best) < width:
                    heapq.heappush(ahead, (-s, x))
                    heapq.heappush(best, (s, x))
                    if len(best) > width:
                        heapq.heappop(best)
                    least = best[0][0]
        return best

    def _spread(self, found: list[tuple[float, int]], count: int) -> list[int]:
        """Neighbours in different directions: one that is nearer to a chosen one than to
        the node is left out while others remain."""
        found = sorted(found, reverse=True)
        ids = [x for _, x in found]
        among = self.vectors[ids] @ self.vectors[ids].T
        chosen: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(chosen) == count:
                break
            if not chosen or among[k, chosen].max() < s:
                chosen.append(k)
        rest = [k for k in range(len(found)) if k not in set(chosen)]
        return [ids[k] for k in (chosen + rest)[:count]]

    def _insert(self, node: int, beam: int) -> None:
        q, level = self.vectors[node], self.levels[node]
        starts = [self.entry]
        for k in range(self.top, level, -1):
            starts = [max(self._beam(q, starts, k, 1))[1]]
        for k in range(min(level, self.top), -1, -1):
            found = self._beam(q, starts, k, beam)
            most = self.m * 2 if k == 0 else self.m
            self.links[node][k] = chosen = self._spread(found, self.m)
            for x in chosen:
                back = self.links[x][k]
                back.append(node)
                if len(back) > most:
                    s = (self.vectors[back] @ self.vectors[x]).tolist()
                    self.links[x][k] = self._spread(list(zip(s, back)), most)
            starts = [x for _, x in found]
        if level > self.top:
            self.entry, self.top = node, level

    def near(self, q: np.ndarray, least: float, width: int) -> list[int]:
        """Nodes of similarity ``least`` or more; the beam widens while all in it are."""
        starts = [self.entry]
        for k in range(self.top, 0, -1):
            starts = [max(self._beam(q, starts, k, 1))[1]]
        while True:
            found = self._beam(q, starts, 0, width)
            if len(found) < width or min(found)[0] < least - 1e-6 or width >= len(self.vectors):
                return [x for s, x in found if s >= least - 1e-6]
            width *= 2


class Shard:
    """A graph, the ids and copies of its vectors, and their components in the shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        self.ids, self.raw, self.copies = ids, vectors, copies
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.graph = Graph(vectors / self.norms[:, None])
        self.group = ids.copy()

    def search(self, vectors: np.ndarray, ids: np.ndarray, least: float) -> list[np.ndarray]:
        """For each vector the places it links with in the shard, itself not excluded."""
        norms = np.sqrt((vectors * vectors).sum(1))
        units = vectors / norms[:, None]
        own = vectors is self.raw  # then search k is for the vector of place k

        def exact(some: np.ndarray) -> list[np.ndarray]:
            near = units[some] @ self.graph.vectors.T >= least - 1e-6
            return [self._linked(vectors[k], norms[k], np.flatnonzero(x), least) for k, x in zip(some.tolist(), near)]

        def linked(k: int) -> np.ndarray:
            near = self.graph.near(units[k], least, width)
            return self._linked(vectors[k], norms[k], np.union1d(near, [k] if own else []), least)

        wanted: dict[int, np.ndarray] = {}
        order, audited = np.argsort(_hashes(ids), kind="stable"), 0
        while audited < len(ids) and (audited < max(AUDITED, len(ids) / AUDIT) or len(wanted) < LINKED):
            some = order[audited : audited + AUDITED]
            wanted |= {k: x for k, x in zip(some.tolist(), exact(some)) if len(x) > own}
            audited += len(some)

        width = BEAM
        while width < 2 * len(self.ids):
            if all(len(linked(k)) - own >= RECALL * (len(x) - own) for k, x in wanted.items()):
                return [linked(k) for k in range(len(ids))]
            width *= 2
        parts = (np.arange(at, min(at + AUDITED, len(ids))) for at in range(0, len(ids), AUDITED))
        return [x for some in parts for x in exact(some)]

    def _linked(self, vector: np.ndarray, norm: float, some: np.ndarray, least: float) -> np.ndarray:
        """Those of the places ``some``, in order, whose cosine in double precision is high
        enough."""
        rows = some.astype(np.int64)
        cosine = (self.raw[rows] @ vector) / (self.norms[rows] * norm)
        return rows[cosine >= least]

    def join_groups(self, found: list[np.ndarray]) -> None:
        parent = list(range(len(self.ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        order = self.ids.tolist()
        for k, places in enumerate(found):
            for x in places.tolist():
                a, b = root(k), root(x)
                if a != b:
                    a, b = (a, b) if order[a] < order[b] else (b, a)
                    parent[b] = a
        self.group = self.ids[[root(k) for k in range(len(parent))]]


def _hashes(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def representatives(embeddings: DataFrame) -> DataFrame:
    """``h1, h2, label, size, id, copies, vector`` of the distinct vectors that may link."""
    vector = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists(vector, lambda x: x != 0)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter(good & finite).select(*_keys(), "label", "vec_id", vector.alias("vector"))
    return rows.groupBy("h1", "h2").agg(
        F.first("label").alias("label"),
        F.first(F.size("vector")).alias("size"),
        F.min("vec_id").alias("id"),
        F.count("*").alias("copies"),
        F.first("vector").alias("vector"),
    )


def _keys() -> list:
    return [
        F.xxhash64("label", "embedding", F.lit(1)).alias("h1"),
        F.xxhash64(F.lit(2), "embedding", "label").alias("h2"),
    ]


def links(embeddings: DataFrame, least: float, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    reps = staged(representatives(embeddings), "vectors")
    parts = ["label", "size"]
    counts = reps.groupBy(*parts).agg(
        F.ceil(F.count("*") / shard).alias("shards"), F.ceil(F.count("*") / block).alias("blocks")
    )
    placed = reps.join(F.broadcast(counts) if counts.count() < 10_000 else counts, parts)
    at = lambda k, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(k)).cast("int")
    placed = staged(placed.withColumn("shard", at("shards", 21)).withColumn("block", at("blocks", 22)), "vectors-placed")
    kind = placed.schema["label"].dataType.simpleString()
    own = f"label {kind}, size int, shard int"

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        one = Shard(ids[order], _matrix(group.column("vector"))[order], group.column("copies").to_numpy()[order])
        found = one.search(one.raw, one.ids, least)
        one.join_groups(found)
        links = [int(one.copies[x].sum()) - int(one.copies[k]) for k, x in enumerate(found)]
        return pa.table(
            {c: group.column(c)[:1] for c in ("label", "size", "shard")}
            | {
                "graph": pa.array([pickle.dumps(one)], pa.binary()),
                "ids": pa.array([one.ids.tolist()], pa.list_(pa.int64())),
                "links": pa.array([links], pa.list_(pa.int64())),
                "groups": pa.array([one.group.tolist()], pa.list_(pa.int64())),
            }
        )

    schema = f"{own}, graph binary, ids array<bigint>, links array<bigint>, groups array<bigint>"
    shards = staged(
        placed.select(*parts, "shard", "id", "copies", "vector")
        .groupBy(*parts, "shard")
        .applyInArrow(build, schema),
        "vector-shards",
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = np.zeros(0, np.int64), []
        if left.num_rows and right.num_rows:
            one = pickle.loads(left.column("graph")[0].as_py())
            ids = right.column("id").to_numpy()
            found = one.search(_matrix(right.column("vector")), ids, least)
        return pa.table(
            {
                "id": pa.array(ids, pa.int64()),
                "links": pa.array([int(one.copies[x].sum()) for x in found], pa.int64()),
                "groups": pa.array([np.unique(one.group[x]).tolist() for x in found], pa.list_(pa.int64())),
            }
        )

    # every vector in every other shard of its label, in blocks; a block meets a shard's
    # graph once
    many = placed.filter("shards > 1")
    asked = many.select(
        *parts, "id", "vector", "block", F.col("shard").alias("home"), F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))).alias("shard")
    ).filter("home <> shard")
    meets = staged(asked.select(*parts, "shard", "block").distinct(), "vector-meets")
    graphs = shards.select(*parts, "shard", "graph").join(meets, [*parts, "shard"])
    key = [*parts, "shard", "block"]
    across = staged(
        graphs.groupBy(*key).cogroup(asked.select(*key, "id", "vector").groupBy(*key)).applyInArrow(
            search, "id bigint, links bigint, groups array<bigint>"
        ),
        "vector-links",
    )
    within = shards.select(F.explode(F.arrays_zip("ids", "links", "groups")).alias("x")).select(
        F.col("x.ids").alias("id"), F.col("x.links").alias("links"), F.col("x.groups").alias("group")
    )
    edges = within.select(F.col("id").alias("a"), F.col("group").alias("b")).unionByName(
        across.select(F.col("id").alias("a"), F.explode("groups").alias("b"))
    )
    components = connected(edges)
    counted = within.select("id", "links").unionByName(across.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))
    known = (
        reps.select("h1", "h2", "id", "copies")
        .join(counted, "id")
        .join(components.withColumnRenamed("node", "id"), "id", "left")
        .select("h1", "h2", (F.col("links") + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    # copies are many rows of one key; the other side has one row for each
    rows = embeddings.select("vec_id", *_keys()).join(known, ["h1", "h2"], "left")
    alone = F.coalesce("component", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        alone.alias("component_id"),
        (F.col("vec_id") == alone).alias("kept"),
    )
