"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two documents are linked when theirs differ in ``RADIUS`` bits or fewer.
The bits are dealt into parts. If each part i gets a threshold T_i and the sum of all (T_i + 1) is
``RADIUS + 1``, two fingerprints that differ in ``RADIUS`` bits or fewer differ in at most T_i bits
of some part i. So fingerprints are sent to a bucket for each part, and, where T_i > 0, to the buckets
whose value differs in up to T_i bits; every pair in a bucket is verified on all 64 bits.

Bits that go together are put into one part, since a value of correlated bits tells less. The number of parts
and their thresholds come from dynamic programming over an estimate of rows sent and candidates met,
made from counts of single bits and of pairs of bits over all fingerprints. The plan changes the cost
only; every plan finds every pair.

Copies never meet one by one: only distinct fingerprints go to buckets, and a bucket emits links that
connect what it verified (a spanning forest, fewer links than members), not all its pairs. A
third of all documents with one fingerprint is one row. Components of the links are found in rounds
of grouped minima on tables in the shared folder.

Defined results: a null text or one without words has fingerprint zero and is linked like any other; one
or two words are one shingle. Null ids take part, but never name a component unless all its ids are
null. Repeated rows are in one component. An empty table has no components.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanframe.llm.common import unused, written
from gleanframe.llm.components import components

RADIUS = 3
BITS = 64
SEED = 42
SHINGLE = 3
#: Shingles hashed at once, so that memory does not follow the longest text.
STEP = 1 << 16
MOST_PARTS = 6
#: Cost of a row that is sent to a bucket, as so many verified candidates.
ROW_COST = 12.0


def fingerprint(text: str | None) -> int:
    """SimHash of a text: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), STEP):
        part = zip(starts[at : at + STEP], ends[at : at + STEP])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in part], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def hashed(batches):
        for batch in batches:
            values = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(hashed, "doc_id long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set: 64 x 64 counts over all of them."""

    def counted(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            n, both = n + len(bits), both + (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*both.ravel().tolist(), n], pa.int64())],
            names=["cell", "n"],
        )

    rows = distinct.select("fp").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in rows:
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` parts of even size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    free, result = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        first = max(free, key=lambda b: (correlation[b, sorted(free)].sum(), -b))
        part = [first]
        free.remove(first)
        while len(part) < size:
            best = max(free, key=lambda b: (correlation[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        result.append(sorted(part))
    return result


def differing(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, ... ``most`` of the bits with these shares of ones."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance = chance * (1 - q) + np.concatenate([[0], chance[:-1]]) * q
    return chance


def allocate(n: int, p: np.ndarray, parts: list[list[int]], radius: int = RADIUS) -> tuple[float, list[int]]:
    """Cheapest thresholds by dynamic programming; -1 leaves a part out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        met = np.cumsum(differing(p[part], radius))
        reached: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, radius + 1 - spent):
                rows = sum(math.comb(len(part), k) for k in range(t + 1))
                more = cost + n * rows * ROW_COST + (n * n / 2 * met[t] * (1 + (t > 0)) if t >= 0 else 0)
                if spent + t + 1 not in reached or more < reached[spent + t + 1][0]:
                    reached[spent + t + 1] = (more, [*chosen, t])
        best = reached
    return best[radius + 1]


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Parts of bits with their thresholds, of the cheapest number of parts."""
    p = np.diag(both) / max(n, 1)
    options = []
    for count in range(1, MOST_PARTS + 1):
        parts = correlated_parts(n, both, count)
        cost, thresholds = allocate(n, p, parts, radius)
        options.append((cost, count, [(b, t) for b, t in zip(parts, thresholds) if t >= 0]))
    return min(options)[2]


def bucket_rows(values: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket key and fingerprint of every row that a batch of fingerprints sends."""
    keys, owners = [], []
    for number, (bits, threshold) in enumerate(parts):
        mask = np.uint64(sum(1 << b for b in bits))
        own = values & mask
        for flips in range(threshold + 1):
            for chosen in itertools.combinations(bits, flips):
                key = (own ^ np.uint64(sum(1 << b for b in chosen))) * np.uint64(0x9E3779B97F4A7C15)
                keys.append(key + np.uint64(number))
                owners.append(values)
    return np.concatenate(keys), np.concatenate(owners)


def forest(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all members within ``radius`` of each other, directly or over others."""
    rest, links = members, []
    while len(rest) > 1:
        wave, rest = [rest[0]], rest[1:]
        while wave and len(rest):
            one = wave.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                found = rest[near]
                links += [(int(one), int(x)) for x in found]
                wave += list(found)
                rest = rest[~near]
    return links


def links_of(distinct: DataFrame, parts, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that span all pairs within ``radius``."""

    def sent(batches):
        for batch in batches:
            keys, owners = bucket_rows(batch.column(0).to_numpy().view(np.uint64), parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], names=["key", "fp"]
            )

    def met(batches):
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held_keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
                held = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(held):
                continue
            edges = np.flatnonzero(np.diff(held_keys)) + 1
            # The last bucket may go on in the next batch.
            stop = len(held) if batch is None else (int(edges[-1]) if len(edges) else 0)
            bounds = np.concatenate([[0], edges[edges < stop], [stop]]) if stop else np.array([0])
            links = []
            for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
                links += forest(held[bounds[k] : bounds[k + 1]], radius)
            held_keys, held = held_keys[stop:], held[stop:]
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return (
        distinct.select("fp")
        .mapInArrow(sent, "key long, fp long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(met, "a long, b long")
    )


def labelled(hashed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint of ``hashed (doc_id, fp)``."""
    distinct = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash")
    n, both = bit_counts(distinct)
    parts = plan(n, both, radius)
    roots = components(links_of(distinct, parts, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(rooted.join(named, "root").select("fp", "root", "component_id"), "simhash")


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    hashed = written(fingerprints(documents), "simhash")
    return hashed.join(labelled(hashed, radius), "fp").select(
        "doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of every component, with the columns it came with: the one of the smallest id.

    Of repeated rows of that id one stays, and one of a component without any id.
    """
    winner, turn, fp, root, own = unused(
        documents.columns, "simhash_winner", "simhash_turn", "simhash_fp", "simhash_root", "simhash_of_row"
    )
    hashed = written(fingerprints(documents), "simhash")
    labels = labelled(hashed, radius)
    winners = labels.where("component_id is not null").select(F.col("component_id").alias(winner)).distinct()
    order = F.row_number().over(Window.partitionBy(winner).orderBy(F.xxhash64("text")))
    kept = (
        documents.join(winners, documents["doc_id"] == winners[winner])
        .withColumn(turn, order)
        .where(F.col(turn) == 1)
        .select(*documents.columns)
    )
    if hashed.where("doc_id is null").isEmpty():
        return kept
    nameless = labels.where("component_id is null").select(F.col("fp").alias(fp), F.col("root").alias(root))
    order = F.row_number().over(Window.partitionBy(root).orderBy(F.xxhash64("text")))
    rest = (
        documents.where("doc_id is null")
        .withColumn(own, _fingerprint_column("text"))
        .join(nameless, F.col(own) == F.col(fp))
        .withColumn(turn, order)
        .where(F.col(turn) == 1)
        .select(*documents.columns)
    )
    return kept.unionByName(rest)


def _fingerprint_column(text: str) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))

    return of(F.col(text))
