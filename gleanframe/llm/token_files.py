"""Token ids in Arrow files of fixed-size-list batches.

The documents are range-partitioned by id, and each partition becomes one shard: an Arrow file (IPC
with a footer) whose rows are sequences of ``length`` token ids with a mask of equal shape, ``BATCH``
sequences in every record batch but the last. So sequence k is row ``k % BATCH`` of batch ``k // BATCH``,
found without a scan, and its ids are a slice of the mapped file without a copy. Documents follow each
other without padding, each closed by the end id; only the last sequence of a shard is padded, and the
mask says where. Ids are 16 bits wide if the vocabulary allows, else 32. Beside each shard lies an
Arrow file with ``doc_id, start, n_tokens`` of its documents.

Tasks write under names that no other attempt uses, and Spark commits the manifest: a file counts only if
the manifest names it, so lost executors and repeated attempts leave no wrong shard. A shard is written
as a stream; memory holds one batch of documents and one of sequences. The tokenizer file is
read by every task from its own installation of the tokenizers' files.

Byte-level BPE never joins across a blank or line end between two words, so a text is encoded word by word,
and words seen before come from a table of bounded size. Texts where that does not hold (runs of
white space, other white space, special tokens) are encoded whole.

Defined results: a null or empty text is its end id alone. Null ids come first. Rows of one id keep
together, ordered by a hash of their text. An empty table writes no shard and reads as an empty one.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gleanframe.llm import word_ids
from gleanframe.llm.common import new_folder, written

LENGTH = 2048
BATCH = 64
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, file string, docs_file string, length int, n_docs long, n_tokens long"


def store(uri: str):
    """File system and path of a folder or file."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(uri)


class Encoder:
    """Texts to little-endian ids, equal to encoding each text whole."""

    def __init__(self, tokenizer: str, end_id: int, limit: int = word_ids.WORDS):
        self.model = word_ids.load(tokenizer)
        self.kind = word_ids.kind_of(self.model, end_id)
        specials = sorted(t.content for t in self.model.get_added_tokens_decoder().values())
        self.unsafe = ("  ", "\n\n", " \n", "\n ", *specials)
        self.other_space = re.compile(r"[^\S \n]")
        #: Words at the start of a line, and words after a blank, which is part of them.
        self.firsts = word_ids.WordIds(self.model, self.kind, limit=limit)
        self.others = word_ids.WordIds(self.model, self.kind, before=" ", limit=limit)
        self.end = self.firsts.pack([end_id])
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return self.firsts.pack(self.model.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bool:
        """Whether all white space is one blank or line end between two words."""
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in self.unsafe):
            return False
        return self.other_space.search(text) is None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text with the end id."""
        first, other, result = self.firsts.__getitem__, self.others.__getitem__, []
        for text in texts:
            if not text:
                result.append(self.end)
            elif self._plain(text):
                lines = []
                for line in text.split("\n"):
                    start, *words = line.split(" ")
                    lines.append(first(start) + b"".join(map(other, words)))
                result.append(self.line_end.join(lines) + self.end)
            else:
                result.append(self._whole(text) + self.end)
        return result


def _list_type(kind: pa.DataType, length: int) -> pa.DataType:
    return pa.list_(pa.field("item", kind, nullable=False), length)


def write_tokens(
    documents: DataFrame, folder: str, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """Write ``documents`` to ``folder``; the manifest has one row for each shard, in id order."""

    def shard(batches):
        encoder = word_ids.of_process(f"token files {tokenizer} {end_id}", lambda: Encoder(tokenizer, end_id))
        writer, index, sink = None, None, []
        number = TaskContext.get().partitionId()
        name = f"{folder}/tokens-{number:06d}-{uuid.uuid4().hex[:12]}"
        size = encoder.kind.itemsize
        kind = pa.uint32() if size == 4 else pa.uint16()
        schema = pa.schema([("ids", _list_type(kind, length)), ("mask", _list_type(pa.bool_(), length))])
        waiting, held, n_docs, n_tokens = [], 0, 0, 0

        def put(flat: np.ndarray, real: int) -> None:
            mask = np.arange(len(flat)) < real
            writer.write_batch(
                pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeListArray.from_arrays(pa.array(flat), type=schema.field("ids").type),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask), type=schema.field("mask").type),
                    ],
                    schema=schema,
                )
            )

        def flush(last: bool) -> None:
            """Write the full batches that wait; at the end all, with padding."""
            nonlocal waiting, held
            flat = np.frombuffer(b"".join(waiting), encoder.kind)
            step = BATCH * length
            full = len(flat) // step * step
            for at in range(0, full, step):
                put(flat[at : at + step], step)
            rest = flat[full:]
            if last and len(rest):
                put(np.pad(rest, (0, -len(rest) % length)), len(rest))
                rest = rest[:0]
            waiting, held = [rest.tobytes()], len(rest)

        for batch in batches:
            for part in word_ids.chunks(batch, 1):
                if writer is None:
                    files, path = store(name)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = [files.open_output_stream(path + x) for x in (".arrow", ".docs.arrow")]
                    writer, index = pa.ipc.new_file(sink[0], schema), pa.ipc.new_file(sink[1], INDEX)
                encoded = encoder.encode(part.column(1).to_pylist())
                counts = np.array([len(e) // size for e in encoded], np.int64)
                starts = n_tokens + np.concatenate([[0], np.cumsum(counts)[:-1]])
                index.write_batch(
                    pa.RecordBatch.from_arrays([part.column(0), pa.array(starts), pa.array(counts)], schema=INDEX)
                )
                waiting += encoded
                n_docs, n_tokens, held = n_docs + len(counts), n_tokens + int(counts.sum()), held + int(counts.sum())
                if held >= BATCH * length:
                    flush(False)
        if writer is not None:
            flush(True)
            for closing in (writer, index, *sink):
                closing.close()
            row = [number, f"{name}.arrow", f"{name}.docs.arrow", length, n_docs, n_tokens]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")]
            )

    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .select("doc_id", "text")
    )
    return written(ordered.mapInArrow(shard, MANIFEST), "token-manifest")


class Shard:
    """One shard, mapped: documents and sequences by their place."""

    def __init__(self, file: str, docs_file: str, length: int):
        self.length = length
        self.tokens, self.docs = (self._open(x) for x in (file, docs_file))

    @staticmethod
    def _open(uri: str):
        files, path = store(uri)
        if isinstance(files, pa.fs.LocalFileSystem):
            return pa.ipc.open_file(pa.memory_map(path))
        return pa.ipc.open_file(files.open_input_file(path))

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence k."""
        batch, row = self.tokens.get_batch(k // BATCH), k % BATCH
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        part = slice(row * self.length, (row + 1) * self.length)
        return ids[part], mask[part]

    def runs(self, start: int, n: int):
        """The ids from ``start`` on, in pieces that are views of the file."""
        step = BATCH * self.length
        while n:
            at = start % step
            ids = self.tokens.get_batch(start // step).column(0).flatten().to_numpy(zero_copy_only=True)
            piece = ids[at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)

    def real_tokens(self) -> int:
        """Tokens that are no padding, by the mask."""
        return sum(self.tokens.get_batch(b).column(1).flatten().true_count for b in range(self.tokens.num_record_batches))


def read_index(manifest: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32, shard``, read back from the files.

    ``start`` counts over all shards. The offsets of the shards come from a running sum over the manifest,
    one row for each shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    out = pa.schema([*INDEX, ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"], row["docs_file"], row["length"])
                if shard.real_tokens() != row["n_tokens"]:
                    raise ValueError(f"{row['file']}: the mask does not agree with the manifest")
                for b in range(shard.docs.num_record_batches):
                    docs = shard.docs.get_batch(b)
                    sums = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                        crc = 0
                        for ids in shard.runs(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = docs.column(1).to_numpy() + row["base"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            docs.column(0),
                            pa.array(starts, pa.int64()),
                            docs.column(2),
                            pa.array(sums, pa.int64()),
                            pa.array([row["shard"]] * len(sums), pa.int32()),
                        ],
                        schema=out,
                    )

    shards = max(1, manifest.count())
    return placed.repartition(shards, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
    )


def encode_and_read(documents: DataFrame, **options) -> DataFrame:
    """Write the documents below the shared folder and read the files back."""
    return read_index(write_tokens(documents, new_folder(documents.sparkSession, "tokens"), **options))
