import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanframe.llm import packing

PIECES = [" ", "  ", "\n", "\t", "a", "É", "ö's", "don't", "123", "!", "?", ".", "\r\n", "日本", "😀", "<|endoftext|>", "'ll", "_", "x\x85y", "ΑΣ", "İ", "µ", "ª", "é"]


@pytest.fixture(scope="module")
def plain():
    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_words_encode_like_whole_texts(plain):
    rng, encoder = random.Random(1), packing.Encoder(packing.TOKENIZER, packing.END_ID)
    for text in ["".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(3_000)] + [None, ""]:
        assert encoder.encode(text).tolist() == plain(text), text


def rows_of(prose):
    rows = [(i * 3, prose(i, 5 + 40 * (i % 4))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 900), (9, rows[3][1]), (None, "no id"), (503, "<|endoftext|> # !")]
    return rows + [(700, "same text")] * 60


@pytest.mark.parametrize("shard", [37, 50_000])
def test_every_piece_has_its_place(documents, prose, plain, shard):
    rows, length = rows_of(prose), 256
    pieces = packing.encode_pieces(documents(rows).repartition(3), length=length)
    got = packing.pack(pieces, length, shard).collect()
    want = []
    for doc_id, text in rows:
        ids = plain(text)
        for piece, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            want.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    order = lambda xs: sorted(xs, key=lambda x: tuple(-1 if v is None else v for v in x))
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == order(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    best_fit = []
    for size in sorted((w[3] for w in want), reverse=True):
        fits = [k for k, level in enumerate(best_fit) if level + size <= length]
        if fits:
            best_fit[max(fits, key=best_fit.__getitem__)] += size
        else:
            best_fit.append(size)
    assert len(sequences) <= len(best_fit) + -(-len(want) // shard)


def test_a_place_is_chosen_by_the_sum_of_squares():
    rng, length = random.Random(4), 40
    gaps, bins = packing.Gaps(length), {}

    def cost(levels):
        counts = defaultdict(int)
        for level in levels:
            counts[length - level] += level < length
        return sum(n * n for n in counts.values())

    for size in sorted((rng.randint(1, length - 1) for _ in range(400)), reverse=True):
        fits = [k for k, level in bins.items() if level + size <= length]
        number, offset = gaps.place(size)
        if fits:
            costs = {k: cost([v + size * (j == k) for j, v in bins.items()]) for k in fits}
            assert costs[number] == min(costs.values())
        else:
            assert number not in bins
        assert offset == bins.get(number, 0)
        bins[number] = offset + size


def test_sequences_hold_the_documents(documents, prose, plain):
    rows = rows_of(prose)[:40] + [(502, "word " * 900), (503, None)]
    placed = packing.pack_documents(documents(rows), length=128, with_ids=True)
    found = {}
    for r in packing.sequences(placed).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) <= 128
        for p in r.pieces:
            found[p.doc_id, p.piece] = ids[p.offset : p.offset + p.length]
    for doc_id, text in rows:
        whole = [t for k in sorted(k for k in found if k[0] == doc_id) for t in found[k]]
        assert whole == plain(text)


def test_empty_table(documents):
    assert packing.pack_documents(documents([])).count() == 0
