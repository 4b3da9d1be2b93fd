"""Best-fit packing of documents into sequences by the sum of squares.

Every document becomes token ids and an end id; only one longer than a sequence is cut, into full pieces
and a last, shorter one. A full piece is a sequence by itself. The others are packed shard by shard, longest
first: of the open sequences that fit, a piece goes where the sum over all residual gaps of
(open sequences with that gap)^2 becomes smallest, and ties go to the smallest gap left. A new sequence is
opened only where none fits. So the open sequences keep many different gaps, one of which
fits what comes, and the short pieces at the end fill them.

A shard is a bounded number of pieces dealt out evenly, whatever ids, sources or lengths repeat, so that one
document in a third of all rows makes no shard larger; a shard wastes about one sequence. A task holds
counts per gap and the numbers of its open sequences, no texts. The encoded pieces are written to the shared
folder first: a lost executor repeats single shards over the same rows.

Defined results: a null or empty text is its end id alone. Rows of one id are packed each by itself; a null id
stays null. An empty table gives no rows. Only ``doc_id`` and ``text`` are read; other columns do
not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from gleanframe.llm import word_ids
from gleanframe.llm.common import written

LENGTH = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Pieces of a shard, about.
SHARD = 50_000

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Texts to packed ids, for tokenizers that drop white space: word by word equals the whole text."""

    def __init__(self, tokenizer: str, end_id: int):
        model = word_ids.load(tokenizer)
        self.kind = word_ids.kind_of(model, end_id)
        self.words = word_ids.WordIds(model, self.kind, fold=True)
        self.end = self.words.pack([end_id])

    def encode(self, text: str | None) -> np.ndarray:
        words = (text or "").replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)) + self.end, self.kind)


def encode_pieces(
    documents: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece, written to the shared folder; ``ids`` are packed little-endian 32-bit ids."""
    columns = PIECES + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = [c.split()[0] for c in columns.split(", ")]

    def pieces(batches):
        encoder = word_ids.of_process(f"packing {tokenizer} {end_id}", lambda: Encoder(tokenizer, end_id))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in word_ids.chunks(batch, 1):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.encode(text).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), length)):
                        data = ids[start : start + length].tobytes()
                        rows.append((row, doc_id, piece, start, len(data) // 4, zlib.crc32(data), data))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(texts.mapInArrow(pieces, columns), "packing-pieces")


class Gaps:
    """Open sequences of a shard by their residual gap."""

    def __init__(self, length: int):
        self.length, self.open, self.numbers, self.used = length, np.zeros(length + 1, np.int64), {}, 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for a piece of ``size`` tokens, fewer than a sequence holds."""
        left = self.open[: self.length - size + 1]
        fits = self.open[size:]
        # Moving one sequence from gap g to g - size changes the sum by 2 * (left - fits) + 2; a full one is no longer open.
        change = 2 * (left - fits) + 2
        change[0] = 1 - 2 * fits[0]
        change[fits == 0] = np.iinfo(np.int64).max
        gap = int(change.argmin())
        if fits[gap]:
            number = self.numbers[gap + size].pop()
            self.open[gap + size] -= 1
        else:
            gap, number = self.length - size, self.used
            self.used += 1
        if gap:
            self.open[gap] += 1
            self.numbers.setdefault(gap, []).append(number)
        return number, self.length - size - gap


def pack(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every ``length`` is at most that of a sequence.

    ``pieces`` is a written table, so that a repeated task sees the same rows in the same shard.
    """
    full = F.col("length") == length
    rest = pieces.where(~full)
    shards = max(1, -(-rest.count() // shard))
    fields = rest.schema.names
    at = fields.index("length")

    def placed(batches):
        gaps, base = Gaps(length), TaskContext.get().partitionId() << 33
        for batch in batches:
            found = [gaps.place(n) for n in batch.column(at).to_pylist()]
            numbers, offsets = (np.array(x, np.int64) for x in zip(*found)) if found else ([], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(2 * (base + np.asarray(numbers, np.int64))), pa.array(offsets, pa.int64())],
                names=[*fields, "sequence_id", "offset"],
            )

    schema = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = rest.repartition(shards).sortWithinPartitions(F.desc("length"), "row")
    alone = pieces.where(full).select("*", (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.mapInArrow(placed, schema).unionByName(alone)


def pack_documents(documents: DataFrame, length: int = LENGTH, with_ids: bool = False, **options) -> DataFrame:
    """The pieces of all documents with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(encode_pieces(documents, length=length, with_ids=with_ids, **options), length).drop("row")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` and its ``pieces`` (doc_id, piece, offset, length) in order.

    ``placed`` was made with ids. A group is one sequence, so it is bounded by the length of one.
    """
    piece = F.struct("offset", "length", "doc_id", "piece", "ids")
    parts = F.array_sort(F.collect_list(piece))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("pieces"),
    )
