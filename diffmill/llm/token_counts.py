"""Token counts (operator 7): lengths of greedy word-piece segmentations.

Longest match in linear time: a trie of the vocabulary whose nodes have a failure link and
the number of pieces popped on the way. Where a word leaves the trie, the automaton pops
and goes on at the link, so every character is read once, nothing is tried again, and no
piece is built. A word that no segmentation covers counts as one unknown piece.

Words are runs of anything but ASCII white space. Counts of the first words a worker meets
are kept, up to a fixed number.

Defined results: a null or empty text has no words and no pieces; repeated rows are
counted each; other columns are left out.
"""

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from diffmill.llm.batches import byte_texts

#: How sentence pieces mark the start of a word.
START = "▁"


class PieceCounter:
    """The automaton. ``starts`` are pieces that begin a word, ``continuations`` others."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # node 0 begins words, 1 goes on
        final = set()
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                node = root
                for char in piece:
                    following = self.children[node].get(char)
                    if following is None:
                        following = self.children[node][char] = len(self.children)
                        self.children.append({})
                    node = following
                if node > 1:
                    final.add(node)
        n = len(self.children)
        self.link, self.pops = [-1] * n, [0] * n
        waiting = deque([0, 1])
        while waiting:
            parent = waiting.popleft()
            for char, node in self.children[parent].items():
                waiting.append(node)
                if node in final:
                    self.link[node], self.pops[node] = 1, 1
                    continue
                at, popped = self.link[parent], self.pops[parent]
                while at >= 0 and char not in self.children[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.children[at][char], popped

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it can't be covered."""
        children, link, pops = self.children, self.link, self.pops
        node = pieces = 0
        for char in word:
            following = children[node].get(char)
            while following is None:
                pieces += pops[node]
                node = link[node]
                if node < 0:
                    return -1
                following = children[node].get(char)
            node = following
        while node > 1:
            pieces += pops[node]
            node = link[node]
        return pieces if node >= 0 else -1


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentence-piece model that begin words, and those that go on."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    starts = [p[1:] for p in pieces if p[0] == START and len(p) > 1 and START not in p[1:]]
    return starts, [p for p in pieces if START not in p]


_loaded: dict[str, tuple[PieceCounter, dict[bytes, int]]] = {}


def _counter(path: str) -> tuple[PieceCounter, dict[bytes, int]]:
    if path not in _loaded:
        _loaded[path] = PieceCounter(*read_pieces(path)), {}
    return _loaded[path]


def token_counts(docs: DataFrame, model: str, kept: int = 600_000) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every text.

    ``model`` is a sentence-piece file that every executor has at this path. An unknown
    word counts as one token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = _counter(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                rows = [x.split() for x in byte_texts(batch.column("text"))]
                new = {w for row in rows for w in row if w not in known}
                found = {w: counter.count(w.decode()) for w in new}
                if len(known) + len(found) <= kept:
                    known.update(found)
                    sizes = [list(map(known.__getitem__, row)) for row in rows]
                else:
                    sizes = [[known[w] if w in known else found[w] for w in row] for row in rows]
                    for w in list(found)[: kept - len(known)]:
                        if len(w) < 64:
                            known[w] = found[w]
                unknown = [row.count(-1) for row in sizes]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(row) for row in rows], pa.int64()),
                        pa.array([sum(row) + 2 * u for row, u in zip(sizes, unknown)], pa.int64()),
                        pa.array(unknown, pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_tokens", "n_unknown"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
