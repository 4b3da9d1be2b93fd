import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanframe.llm import token_files

PIECES = [" ", "  ", "\n", "\t", "a", "é", "ö's", "don't", "123", "!", "?", ".", "\r\n", "日本", "😀", "<|endoftext|>", "'ll", "_", "x\x85y", " "]


@pytest.fixture(scope="module")
def plain():
    model = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def test_pieces_encode_like_whole_texts(plain):
    rng, encoder = random.Random(1), token_files.Encoder(token_files.TOKENIZER, token_files.END_ID)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(3_000)] + [None, ""]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, encoder.kind).tolist() == plain(text), text


def rows_of(prose):
    rows = [(i * 3, prose(i, 5 + 40 * (i % 4))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "word " * 9_000), (9, rows[3][1]), (None, "no id"), (503, "<|endoftext|> # !")]
    random.Random(2).shuffle(rows)
    return rows


def check(frame, rows, plain):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in frame.collect())
    assert [x[1] for x in got] == [None] + sorted(i for i, _ in rows if i is not None)
    place = 0
    for start, _, n, _ in got:
        assert start == place
        place += n
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((x[1] or -1, x[2], x[3]) for x in got) == sorted(
        (i or -1, len(plain(t)), crc(plain(t))) for i, t in rows
    )


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_files_hold_every_document_in_order(spark, documents, prose, plain, partitions):
    rows = rows_of(prose)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(token_files.encode_and_read(documents(rows).repartition(3), length=64), rows, plain)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_random_access_without_a_copy(documents, prose, plain, tmp_path):
    rows = [(i, prose(i, 200)) for i in range(30)]
    manifest = token_files.write_tokens(documents(rows).coalesce(1), f"file://{tmp_path}/tokens", length=16).orderBy("shard").collect()
    flat = [t for _, text in rows for t in plain(text)]
    for row in manifest:
        shard = token_files.Shard(row.file, row.docs_file, row.length)
        part, flat = flat[: row.n_tokens], flat[row.n_tokens :]
        for k in range(-(-row.n_tokens // 16)):
            ids, mask = shard.sequence(k)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            want = part[16 * k : 16 * k + 16]
            assert ids[: len(want)].tolist() == want and mask.tolist() == [j < len(want) for j in range(16)]
        assert shard.real_tokens() == row.n_tokens
    assert not flat


def test_empty_table(documents):
    assert token_files.encode_and_read(documents([])).count() == 0


@pytest.mark.parametrize("limit", [3, 40, 300])
def test_full_tables_turn_over_without_loss(prose, plain, limit):
    encoder = token_files.Encoder(token_files.TOKENIZER, token_files.END_ID, limit)
    for batch in range(30):
        texts = [prose(batch * 10 + i, 80).replace(" a", ", ") + "." for i in range(5)] + ["de la, été. le Über!", prose(3, 50)]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, encoder.kind).tolist() == plain(text)
        for table in (encoder.firsts, encoder.others):
            assert len(table) <= limit and len(table.older) <= limit
