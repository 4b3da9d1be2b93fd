"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Texts are tokens (runs of letters and digits, lower case). Items and documents meet on shared seeds:
hashes of ``MIN_MATCH`` tokens in a row. For every pair with a seed the longest common run of tokens
that neither side has used yet is marked, again and again, until no run of ``MIN_MATCH`` is left. The
share of the item's tokens under marked runs is its coverage. Order does not matter, so passages
whose sentences were moved around are caught; coverage of ``COVERAGE`` or more is contamination.

The benchmark side is small next to the corpus but not assumed so: it goes to the tasks in blocks of at
most ``BLOCK_CHARS`` characters, each block one pass over the documents, so what is broadcast has a
fixed size and any number of items is exact. A document is read, hashed and tiled in one task as a
stream of batches; nothing is shuffled, so a passage in a third of all documents makes no hot key.

Defined results: null and empty texts share no seed and are clean. An item with fewer than
``MIN_MATCH`` tokens is matched whole. Repeated items are separate items. Repeated documents each
get their rows. Rows are ordered by nothing; no pair is dropped.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Shortest run that counts, in tokens.
MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_CHARS = 4_000_000
#: Multiplier of the rolling hash.
BASE = np.uint64(1_000_003)
FILTER_BITS = 22


def tokens_of(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower()) if text else []


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` ids, equal to the Karp-Rabin hash rolled over them."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    parts = (ids + 1).astype(np.uint64)
    total = parts[:n].copy()
    for k in range(1, length):
        total *= BASE
        total += parts[k : k + n]
    return total


def _slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Block:
    """Items with the index of their seeds: vocabulary, bit filter and postings."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        postings: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens_of(text)], np.int64)
            if not len(ids):
                continue
            length = min(MIN_MATCH, len(ids))
            for at, h in enumerate(rolling(ids, length).tolist()):
                postings.setdefault((length, h), []).append((len(self.items), at))
            self.items.append((item_id, ids))
        self.postings = postings
        self.filters = {}
        for length in {n for n, _ in postings}:
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[_slots(np.array([h for n, h in postings if n == length], np.uint64))] = True
            self.filters[length] = bits

    def seeds(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By item the places (in the document, in the item) where ``length`` tokens agree."""
        found: dict[int, list[tuple[int, int]]] = {}
        known = ids >= 0
        for length, bits in self.filters.items():
            n = len(ids) - length + 1
            if n <= 0:
                continue
            whole = known[:n].copy()
            for k in range(1, length):
                whole &= known[k : k + n]
            places = np.flatnonzero(whole)
            if not len(places):
                continue
            hashes = rolling(ids, length)[places]
            likely = bits[_slots(hashes)]
            for at, h in zip(places[likely].tolist(), hashes[likely].tolist()):
                for item, start in self.postings.get((length, h), ()):
                    other = self.items[item][1]
                    if np.array_equal(ids[at : at + length], other[start : start + length]):
                        found.setdefault(item, []).append((at, start))
        return found


def tile(places: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: non-overlapping (document place, item place, tokens), longest first.

    ``places`` are all pairs where ``length`` tokens agree. Pairs on one diagonal that follow each
    other are one maximal match; a match that a marked tile cuts goes back with what is left of it.
    """
    runs: list[tuple[int, int, int]] = []
    ordered = sorted(places, key=lambda p: (p[0] - p[1], p[0]))
    for at, start in ordered:
        if runs and runs[-1][0] - runs[-1][1] == at - start and runs[-1][0] + runs[-1][2] - length + 1 == at:
            runs[-1] = (runs[-1][0], runs[-1][1], runs[-1][2] + 1)
        else:
            runs.append((at, start, length))
    heap = [(-n, at, start) for at, start, n in runs]
    heapq.heapify(heap)
    used_there: set[int] = set()
    used_here: set[int] = set()
    tiles = []
    while heap:
        n, at, start = heapq.heappop(heap)
        free = [k for k in range(-n) if at + k not in used_there and start + k not in used_here]
        if len(free) == -n:
            tiles.append((at, start, -n))
            used_there.update(range(at, at - n))
            used_here.update(range(start, start - n))
            continue
        piece: list[int] = []
        for k in [*free, None]:
            if piece and k != piece[-1] + 1:
                if len(piece) >= length:
                    heapq.heappush(heap, (-len(piece), at + piece[0], start + piece[0]))
                piece = []
            if k is not None:
                piece.append(k)
    return tiles


def matches(text: str | None, block: Block) -> Iterator[tuple[int, int, int, int]]:
    """Per item with a seed in the text: item_id, tiled tokens, tokens of the item, tiles."""
    words = tokens_of(text)
    ids = np.fromiter(map(block.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    for item, places in block.seeds(ids).items():
        item_id, other = block.items[item]
        tiles = tile(places, min(MIN_MATCH, len(other)))
        yield item_id, sum(n for _, _, n in tiles), len(other), len(tiles)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size; one block is on the driver at a time."""
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if block and chars + len(row.text or "") > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text or "")
    if block:
        yield block


COLUMNS = {
    "doc_id": pa.int64(),
    "item_id": pa.int64(),
    "tiled_tokens": pa.int64(),
    "item_tokens": pa.int64(),
    "tiles": pa.int64(),
    "coverage": pa.float64(),
    "contaminated": pa.bool_(),
}
SCHEMA = "doc_id long, item_id long, tiled_tokens long, item_tokens long, tiles long, coverage double, contaminated boolean"


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The pairs of a document and an item that it covers to ``coverage`` or more."""
    context, result = documents.sparkSession.sparkContext, None
    for items in _blocks(benchmark):
        shared = context.broadcast(items)

        def paired(batches, shared=shared):
            block = Block(shared.value)
            for batch in batches:
                rows = [
                    (doc_id, item, tiled, n, k, tiled / n, True)
                    for doc_id, text in zip(*(c.to_pylist() for c in batch.columns))
                    for item, tiled, n, k in matches(text, block)
                    if tiled >= coverage * n
                ]
                columns = list(zip(*rows)) or [()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, COLUMNS.values())], names=list(COLUMNS)
                )

        found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(paired, SCHEMA)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    return result


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no item to ``coverage`` or more, with the columns they came with."""
    context, result = documents.sparkSession.sparkContext, documents
    text = documents.columns.index("text")
    for items in _blocks(benchmark):
        shared = context.broadcast(items)

        def clean(batches, shared=shared):
            block = Block(shared.value)
            for batch in batches:
                kept = [
                    all(tiled < coverage * n for _, tiled, n, _ in matches(x.as_py(), block))
                    for x in batch.column(text)
                ]
                yield batch.filter(pa.array(kept, pa.bool_()))

        result = result.mapInArrow(clean, documents.schema)
    return result
