"""Removal of repeated passages with suffix arrays by the difference-cover algorithm.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document of a smaller id.

Only strings that can repeat are sorted. Every window of ``LENGTH`` bytes has an anchor: the smallest hash of
the ``GRAM``-byte strings in it, which equal windows share. A run of windows with one anchor is a unit. Units meet
by anchor, in buckets. In a large corpus most anchors occur in several documents by chance, so what stands beside
them decides as well: equal windows with the anchor in their left half share the 17 bytes behind it, any others the
18 before it. Units that share neither with another document cannot repeat and end there. Units that are equal as
a whole are settled by the smallest id among them, first among the texts that a task reads together, so a
passage in a third of all documents is one unit. What is left, units that share an anchor and more and differ,
goes to the suffix arrays: tasks that hold all units of an anchor put them into one string, sort its
suffixes (triples of the sample, names, recursion, merge) and compare adjacent ones over ``LENGTH``
bytes. An anchor whose different units have more than ``ANCHOR_BYTES`` bytes (the edge of a passage that very many
documents hold) is spread over tasks window by window instead: equal windows meet in an aggregation that
counts before it shuffles. Where a sample shows an anchor to be of that kind, its units do not meet in one bucket.

Every step ends in a table in the shared folder, so a lost executor costs one step, and shuffle files of
finished steps can go. No document is cut: matches are found on whole texts, read in stretches of bounded
size.

Defined results: a null text has no bytes. A document shorter than ``LENGTH`` loses nothing. A null id
counts as larger than any other, and rows of one id do not remove from each other, so repeated rows all stay
as the first of them. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.llm.common import discard, written
from gleanframe.llm.suffixes import MOST_SYMBOLS, equal_windows

LENGTH = 50
GRAM = 16
#: Windows of a text that are hashed at once, and bytes of several texts.
STRETCH, TOGETHER = 1 << 20, 1 << 17
#: Odd, and 5 modulo 8, so that its powers return to 1 only after 2^62.
BASE = 0x9E3779B97F4A7C15
#: Bytes of the different units of an anchor that one task may hold, and bytes that go into one suffix array
#: unless one anchor needs more: together no more than a suffix array can take.
ANCHOR_BYTES = 800_000
TEXT_BYTES = MOST_SYMBOLS - ANCHOR_BYTES
#: Bits of a place among the texts that are hashed at once, which are less than STRETCH + TOGETHER + LENGTH bytes.
PLACE_BITS = 21
PLACES = np.uint64((1 << PLACE_BITS) - 1)
#: Bytes of text whose units leave a task together, and buckets for each shuffle partition.
FLUSH, BUCKETS = 4_000_000, 4
#: Of so many documents one is looked at to find anchors of many different units: so many there, and a share of the documents.
SAMPLE_EVERY, MANY_UNITS, FREQUENT = 64, 190, 0.005
#: Units whose contents leave a task in one batch, and settled spans.
UNITS_AT_ONCE, SPANS_AT_ONCE = 20_000, 500_000
LAST_ID = (1 << 63) - 1


def gram_hashes(content: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of every ``gram`` bytes in a row; ``gram`` is a power of two."""
    hashes, width = content.astype(np.uint64) + np.uint64(1), 1
    while width < gram:
        hashes = hashes[:-width] * np.uint64(0x9E3779B97F4A7C15) + (hashes[width:] ^ (hashes[width:] >> np.uint64(31)))
        width *= 2
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return hashes ^ (hashes >> np.uint64(29))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    if rest := width - reach:
        values = np.minimum(values[:-rest], values[rest:])
    return values


def _unit_hashes(grams: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes of every unit: the polynomial in ``BASE`` of its gram hashes, from differences of prefix sums."""
    up, down = (np.cumprod(np.full(len(grams) + 1, b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * up[:-1])])
    value = (sums[starts + counts + (length - GRAM)] - sums[starts]) * down[starts]
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return value ^ (value >> np.uint64(29))


def _beside(grams: np.ndarray, near: np.ndarray, far: np.ndarray, there: np.ndarray) -> np.ndarray:
    """16 bits, not 0, of two grams beside an anchor, 0 where no window holds them."""
    near, far = (grams[np.clip(x, 0, len(grams) - 1)] for x in (near, far))
    value = near * np.uint64(BASE) + (far ^ (far >> np.uint64(31)))
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.where(there, (value >> np.uint64(33)) % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint32)


def located_units(contents: list[bytes], length: int = LENGTH):
    """What ``units`` gives, and of every unit whether its anchor occurs in it again, and what stands beside the anchor.

    The texts are looked at as one, without the windows that go over the end of a text. The upper 16 bits of what
    stands beside are for windows with the anchor in their left half, the lower ones for the others.
    """
    whole = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents], np.int64)
    counts = np.maximum(sizes - (length - 1), 0)
    if not counts.any():
        return
    owner = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = np.repeat(np.cumsum(sizes) - sizes, counts) + inside
    grams, more = gram_hashes(whole), length - GRAM
    # The lower bits of a hash give way to its place: of equal ones the first is the smallest, or the last.
    hashes, at = grams & ~PLACES, np.arange(len(grams), dtype=np.uint64)
    low = smallest(hashes | at, more + 1)[places]
    anchors = low >> np.uint64(PLACE_BITS)
    new = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    runs = np.diff(np.concatenate([starts, [len(anchors)]]))
    first = places[starts]
    last = first + runs - 1
    place = (low[starts] & PLACES).astype(np.int64)
    again = (PLACES - (smallest(hashes | (PLACES - at), more + 1)[last] & PLACES)).astype(np.int64) != place
    half = more // 2
    right = _beside(grams, place + min(GRAM, more - half), place + more - half, place - last <= half)
    left = _beside(grams, place - min(GRAM, half + 1), place - half - 1, place - first > half)
    own = _unit_hashes(grams, first, runs, length)
    yield owner[starts], anchors[starts], own, inside[starts], runs, again, (right << np.uint32(16)) | left


def units(contents: list[bytes], length: int = LENGTH):
    """Number of the text, anchor, hash, first window and number of windows of every unit of some texts."""
    for found in located_units(contents, length):
        yield found[:5]


def _stretches(texts, length: int = LENGTH):
    """Texts by number, cut into stretches of ``STRETCH`` windows, in lists of some ``TOGETHER`` bytes, with their starts."""
    held, size = [], 0
    for number, text in texts:
        for at in range(0, max(0, len(text) - length + 1), STRETCH):
            part = text[at : at + STRETCH + length - 1]
            held.append((number, at, part))
            size += len(part)
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _identified(documents: DataFrame) -> DataFrame:
    """``doc, version, content``: a document is its id and, for rows that share it, a hash of the text."""
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.hash("text").alias("version"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("content"),
    )


#: Units in a bucket: anchor, hash, document, version, first window, windows (less than 0 if the anchor occurs again),
#: what is beside the anchor. Spans that are settled: document, version, from, bytes.
UNIT_KINDS = [np.dtype(k) for k in ("u8", "u8", "i8", "i4", "i4", "i4", "u4")]
SPAN_KINDS = [np.dtype(k) for k in ("i8", "i4", "i4", "i4")]


def _packed(columns: list[np.ndarray], buckets: np.ndarray, settled: bool) -> pa.RecordBatch:
    """The rows of every bucket as bytes: the first bytes of all values of a column, the second ones and so on, which compress."""
    order = np.argsort(buckets, kind="stable")
    columns, ranked = [c[order] for c in columns], buckets[order]
    starts = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(ranked)]])
    planes = [plane for c in columns for plane in c.view(np.uint8).reshape(len(c), -1).T.copy()]
    data = [b"".join([p[a:b] for p in planes]) for a, b in zip(starts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(ranked[starts], pa.int32()), pa.array(np.full(len(data), settled)), pa.array(data, pa.binary())],
        names=["bucket", "settled", "data"],
    )


def _unpacked(data: list, kinds: list[np.dtype]) -> list[np.ndarray]:
    edges = np.cumsum([0, *(k.itemsize for k in kinds)])
    planes = np.concatenate([np.frombuffer(held, np.uint8).reshape(edges[-1], -1) for held in data], axis=1)
    return [np.ascontiguousarray(planes[a:b].T).view(k).ravel() for a, b, k in zip(edges, edges[1:], kinds)]


def _by_bucket(batches):
    """``settled`` and the data of every bucket, from rows in order of both."""
    key, held = None, []
    for batch in batches:
        for bucket, settled, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if held and key != (bucket, settled):
                yield key[1], held
                held = []
            key = (bucket, settled)
            held.append(data.as_buffer())
    if held:
        yield key[1], held


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])[: len(keys[0])]
    return starts, np.diff(np.concatenate([starts, [len(keys[0])]]))


def _settled_at_once(columns: list[np.ndarray], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The units without those that equal one of a smaller document among them, and the spans of the latter."""
    own = columns[1]
    order = np.argsort(own)
    starts, sizes = _groups(own[order])
    twice = order[np.repeat(sizes > 1, sizes)]
    anchor, own, doc = (c[twice] for c in columns[:3])
    order = np.lexsort((doc, own, anchor))
    starts, sizes = _groups(anchor[order], own[order])
    rows = twice[order][doc[order] > np.repeat(doc[order][starts], sizes)]
    stay = np.ones(len(columns[0]), bool)
    stay[rows] = False
    doc, version, low, n = (columns[i][rows] for i in (2, 3, 4, 5))
    order = np.lexsort((low, version, doc))
    doc, version, low, high = doc[order], version[order], low[order], (low + np.abs(n) + np.int32(length - 1))[order]
    # Spans of a text that touch are one.
    new = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (low[1:] > high[:-1])
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])[: len(doc)]
    highs = np.maximum.reduceat(high, starts) if len(starts) else high
    return [c[stay] for c in columns], [doc[starts], version[starts], low[starts], highs - low[starts]]


def _among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(values), bool)
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def in_buckets(documents: DataFrame, frequent: np.ndarray, length: int = LENGTH) -> DataFrame:
    """``bucket, settled, data``: all units of all documents, in partitions and order of their buckets.

    Units of one anchor meet, but of a ``frequent`` one only those that are equal.
    """
    buckets = np.uint64(BUCKETS * max(16, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    mixed = np.uint64(0xC2B2AE3D27D4EB4F)

    def dealt(held):
        columns = [np.concatenate(c) for c in zip(*held)]
        columns, spans = _settled_at_once(columns, length)
        key = columns[0] ^ np.where(_among(columns[0], frequent), columns[1], np.uint64(0))
        yield _packed(columns, (((key * mixed) >> np.uint64(32)) % buckets).astype(np.int32), False)
        if len(spans[0]):
            whole = ((spans[0][:1].astype(np.uint64) * mixed) >> np.uint64(32)) % buckets
            yield _packed(spans, np.repeat(whole.astype(np.int32), len(spans[0])), True)

    def cut(batches):
        held, size = [], 0
        for batch in batches:
            docs, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for texts in _stretches((enumerate(c.as_py() for c in batch.column(2))), length):
                numbers, firsts, parts = zip(*texts)
                for owner, anchors, own, inside, runs, again, beside in located_units(parts, length):
                    number = np.array(numbers)[owner]
                    at = (inside + np.array(firsts)[owner]).astype(np.int32)
                    n = np.where(again, -runs, runs).astype(np.int32)
                    held.append((anchors, own, docs[number], versions[number], at, n, beside))
                size += sum(map(len, parts))
                if held and size >= FLUSH:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    rows = _identified(documents).mapInArrow(cut, "bucket int, settled boolean, data binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "settled")


def frequent_anchors(documents: DataFrame) -> np.ndarray:
    """Anchors of so many different units that no task should hold them all, in order.

    They are looked for in a sample. The list only says where units meet; results do not depend on it. A document
    of k units adds at most k to the sum of all counts, so there are at most ``k / FREQUENT`` of them for the mean k.
    """
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_EVERY)) == 0)
    least = max(MANY_UNITS, FREQUENT * sample.count())

    def counted(batches):
        for settled, data in _by_bucket(batches):
            if not settled:
                anchor, own = _unpacked(data, UNIT_KINDS)[:2]
                order = np.lexsort((own, anchor))
                starts, _ = _groups(anchor[order], own[order])
                anchor = anchor[order][starts]
                starts, sizes = _groups(anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[starts][sizes >= least].astype(np.int64))], names=["anchor"])

    found = in_buckets(sample, np.zeros(0, np.uint64)).mapInArrow(counted, "anchor long").collect()
    return np.sort(np.array([r["anchor"] for r in found], np.uint64))


def _can_repeat(columns: list[np.ndarray], apart: np.ndarray) -> np.ndarray:
    """Numbers of the units that share their anchor and what stands beside it with another document, by anchor.

    Where the anchor occurs in a unit again it has no place of its own: then all that share it can. So can units
    that are ``apart`` from others of their anchor.
    """
    anchor, doc, n, beside = (columns[i] for i in (0, 2, 5, 6))
    order = np.argsort(anchor)
    starts, sizes = _groups(anchor[order])
    spread = lambda values: np.repeat(values, sizes)
    shared = spread(np.minimum.reduceat(doc[order], starts) < np.maximum.reduceat(doc[order], starts))
    again = spread(np.logical_or.reduceat(n[order] < 0, starts))
    group = spread(np.arange(len(starts)))
    live = apart[order] | (shared & again)
    rest = np.flatnonzero(shared & ~live)
    for shift in (16, 0):
        side = (beside[order[rest]] >> np.uint32(shift)) & np.uint32(0xFFFF)
        those = rest[side > 0]
        key = (group[those] << 16) | side[side > 0].astype(np.int64)
        turn = np.argsort(key)
        those = those[turn]
        starts, sizes = _groups(key[turn])
        if len(starts):
            docs = doc[order[those]]
            two = np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts)
            live[those] |= np.repeat(two, sizes)
    return order[live]


MET = (
    "doc long, version int, low int, size int, anchor long, unit long, n int, many boolean, "
    "places array<struct<version:int,at:int>>"
)


def met_units(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """What follows from units that meet.

    Without an anchor: spans that are copies of a unit in a smaller document. With one: units that share their anchor with
    other ones, and the places in the smallest document that holds them.
    """
    frequent, most = frequent_anchors(documents), ANCHOR_BYTES
    place = pa.struct([("version", pa.int32()), ("at", pa.int32())])
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(place)]
    names = [c.split()[0] for c in MET.split(", ")]

    def batch_of(rows, **columns):
        arrays = [columns[c] if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(arrays, kinds)], names=names)

    def spans_of(parts):
        doc, version, low, size = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(doc)
        return batch_of(len(doc), doc=doc[order], version=version[order], low=low[order], size=size[order])

    def wanted_of(anchor, unit, doc, version, at, n, starts, sizes, apart):
        """Units, of which one is at ``starts``, if their anchor has others; all are in order, and in their smallest documents."""
        first, several = _groups(anchor[starts])
        own = n[starts].astype(np.int64) + (length - 1)
        bytes_ = np.repeat(np.add.reduceat(own, first), several)
        apart = apart[starts]
        chosen = (np.repeat(several, several) > 1) | apart
        held = np.repeat(chosen, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes[chosen])])
        places = pa.StructArray.from_arrays([pa.array(version[held]), pa.array(at[held])], ["version", "at"])
        one = starts[chosen]
        return batch_of(
            len(one),
            doc=doc[one],
            anchor=anchor[one].view(np.int64),
            unit=unit[one].view(np.int64),
            n=n[one],
            many=((bytes_ > most) | apart)[chosen],
            places=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places),
        )

    def meet(batches):
        spans, size = [], 0
        for settled, data in _by_bucket(batches):
            if settled:
                spans.append(_unpacked(data, SPAN_KINDS))
            else:
                columns = _unpacked(data, UNIT_KINDS)
                apart = _among(columns[0], frequent)
                rows = _can_repeat(columns, apart)
                if not len(rows):
                    continue
                anchor, unit, doc, version, at, n = (c[rows] for c in columns[:6])
                order = np.lexsort((at, version, doc, unit, anchor))
                anchor, unit, doc, version, at, n = (c[order] for c in (anchor, unit, doc, version, at, np.abs(n)))
                starts, sizes = _groups(anchor, unit)
                later = doc > np.repeat(doc[starts], sizes)
                spans.append([c[later] for c in (doc, version, at, n + np.int32(length - 1))])
                sizes = np.add.reduceat(~later, starts, dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                yield wanted_of(*(c[~later] for c in (anchor, unit, doc, version, at, n)), starts, sizes, apart[rows][order][~later])
            size += len(spans[-1][0])
            if size >= SPANS_AT_ONCE:
                yield spans_of(spans)
                spans, size = [], 0
        if spans:
            yield spans_of(spans)

    return written(in_buckets(documents, frequent, length).mapInArrow(meet, MET), "repeats")


def with_content(documents: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """``anchor, unit, doc, many, content`` of the ``wanted`` units, read from their documents."""
    lists = wanted.groupBy("doc", "version").agg(
        F.collect_list(F.struct("anchor", "unit", "many", "at", "n")).alias("units")
    )

    names = ["anchor", "unit", "doc", "many", "content"]

    def read(batches):
        for batch in batches:
            docs, contents, lists = batch.columns
            flat = lists.flatten()
            owners = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            held, data = -1, b""
            for at in range(0, len(flat), UNITS_AT_ONCE):
                found, owner = flat.slice(at, UNITS_AT_ONCE), owners[at : at + UNITS_AT_ONCE]
                low = found.field("at").to_numpy()
                high = low + found.field("n").to_numpy() + (length - 1)
                parts = []
                for number, a, b in zip(owner.tolist(), low.tolist(), high.tolist()):
                    if number != held:
                        held, data = number, contents[number].as_py()
                    parts.append(data[a:b])
                yield pa.RecordBatch.from_arrays(
                    [found.field("anchor"), found.field("unit"), docs.take(pa.array(owner)), found.field("many"), pa.array(parts, pa.binary())],
                    names=names,
                )

    joined = _identified(documents).join(lists, ["doc", "version"]).select("doc", "content", "units")
    return written(
        joined.mapInArrow(read, "anchor long, unit long, doc long, many boolean, content binary"), "repeats"
    )


def covered_windows(contents: list[bytes], docs: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each unit the runs ``(from, to)`` of windows that a unit of a smaller document holds."""
    sizes = np.array([len(c) for c in contents])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    classes = equal_windows(np.frombuffer(b"".join(contents), np.uint8), firsts[owner] + inside, length)
    doc = np.array(docs, np.int64)[owner]
    least = np.full(classes.max() + 1, LAST_ID, np.int64)
    np.minimum.at(least, classes, doc)
    hit = doc > least[classes]
    result: list[list[tuple[int, int]]] = [[] for _ in contents]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    for start, stop in edges.reshape(-1, 2).tolist():
        # A run may go over the end of a unit into the next.
        while start < stop:
            unit = int(owner[start])
            end = min(stop, start + int(counts[unit] - inside[start]))
            result[unit].append((int(inside[start]), int(inside[start]) + end - start))
            start = end
    return result


COVERED = "anchor long, unit long, low int, high int"


def _sorted_together(batches):
    """Suffix arrays over all units of an anchor, a few anchors at a time."""
    names = [c.split()[0] for c in COVERED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush(rows):
        runs = covered_windows([r[3] for r in rows], [r[2] for r in rows])
        found = [(r[0], r[1], a, b) for r, spans in zip(rows, runs) for a, b in spans]
        columns = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= TEXT_BYTES and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _window_by_window(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for anchors with very many units: equal windows meet in an aggregation."""
    places = F.sequence(F.lit(1), F.length("content") - (length - 1))
    windows = rows.select(
        "anchor", "unit", "doc", F.posexplode(F.transform(places, lambda i: F.substring("content", i, length)))
    )
    least = windows.groupBy("col").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    found = (
        windows.join(least.select("col", "least"), "col")
        .where("doc > least")
        .groupBy("anchor", "unit")
        .agg(F.sort_array(F.collect_list("pos")).alias("at"))
    )
    # Windows in a row are one run.
    low = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) < x - 1))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > x + 1))
    runs = found.select("anchor", "unit", low.alias("low"), last.alias("last"))
    return runs.select("anchor", "unit", F.inline(F.arrays_zip("low", "last"))).select(
        "anchor", "unit", "low", (F.col("last") + 1).alias("high")
    )


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, version, spans``: byte spans ``(low, high)`` of every document that loses bytes."""
    met = met_units(documents, length)
    wanted = met.where("anchor is not null").select("anchor", "unit", "doc", "n", "many", "places")
    contents = with_content(documents, wanted.select("*", F.expr("inline(slice(places, 1, 1))")), length)
    covered = written(
        contents.where("not many")
        .select("anchor", "unit", "doc", "content")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "doc", "unit")
        .mapInArrow(_sorted_together, COVERED)
        .unionByName(_window_by_window(contents.where("many"), length)),
        "repeats",
    )
    discard(contents)
    # A copy of a unit in a later document goes as a whole, in the earliest the windows that an earlier one holds.
    span = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    parts = covered.join(wanted.select("anchor", "unit", "doc", "places"), ["anchor", "unit"]).select(
        "doc", "low", "high", F.inline("places")
    )
    found = written(
        met.where("anchor is null")
        .select("doc", "version", span(F.col("low"), F.col("low") + F.col("size")).alias("span"))
        .unionByName(
            parts.select(
                "doc", "version", span(F.col("at") + F.col("low"), F.col("at") + F.col("high") + (length - 1)).alias("span")
            )
        )
        .groupBy("doc", "version")
        .agg(F.collect_list("span").alias("spans")),
        "repeats",
    )
    for done in (met, covered):
        discard(done)
    return found


def _merged(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts in order and without overlap; spans that touch are one."""
    order = np.lexsort((low, owner))
    base = owner[order].astype(np.int64) << 32
    low, high = base + low[order], np.maximum.accumulate(base + high[order])
    first = np.ones(len(low), bool)
    first[1:] = low[1:] > high[:-1]
    # The furthest end until the next span begins.
    last = np.append(first[1:], True)[: len(low)]
    mask = (1 << 32) - 1
    return low[first] >> 32, low[first] & mask, high[last] & mask


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, removed`` (spans of bytes), ``kept`` (the remaining bytes) of every document."""
    spans = repeated_spans(documents, length)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.hash("text").alias("version"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("content"),
    ).join(spans, ["doc", "version"], "left")

    def cut(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            contents, found = batch.column(1), batch.column(2)
            sizes = pc.binary_length(contents).to_numpy()
            flat = found.flatten()
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(found.value_lengths(), 0).to_numpy())
            owner, low, high = _merged(owner, flat.field("low").to_numpy(), flat.field("high").to_numpy())
            high = np.minimum(high, sizes[owner])
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            kept, lows, highs = [], low.tolist(), high.tolist()
            for content, a, b in zip(contents, ends.tolist(), ends[1:].tolist()):
                data = content.as_py()
                if a < b:
                    data = b"".join(data[x:y] for x, y in zip([0, *highs[a:b]], [*lows[a:b], len(data)]))
                kept.append(data)
            pairs = pa.StructArray.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["low", "high"])
            removed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), removed, pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return rows.select("doc_id", "content", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, removed array<struct<low:int,high:int>>, kept binary"
    )


def report(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    lost: Column = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return without_repeats(documents, length).select(
        "doc_id",
        "n_bytes",
        lost.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
