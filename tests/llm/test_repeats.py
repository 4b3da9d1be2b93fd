import hashlib
import random

import numpy as np

from gleanframe.llm import repeats
from gleanframe.llm.suffixes import equal_windows, suffix_array


def brute(rows, length=50):
    """By the definition, byte by byte."""
    result = []
    key = lambda i: 1 << 63 if i is None else i
    texts = [(key(i), (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            least[w] = min(least.get(w, 1 << 64), i)
    for i, b in texts:
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if least[b[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        result.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


def checked(documents, rows):
    got = repeats.report(documents(rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(rows))), key=key)
    assert sorted(map(tuple, got), key=key) == want


def test_suffix_array_equals_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(600):
        s = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(1, 50))]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_equal_windows_have_one_class():
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab") for _ in range(400))
    starts = np.array(sorted(rng.sample(range(390), 200)))
    classes = equal_windows(np.frombuffer(text, np.uint8), starts, 10)
    pairs = {(c, text[s : s + 10]) for c, s in zip(classes.tolist(), starts.tolist())}
    assert len(pairs) == len({c for c, _ in pairs}) == len({w for _, w in pairs})


def test_repeats_equal_the_definition(documents, prose):
    shared = [prose(s, 20) for s in range(50, 56)]
    rng, rows = random.Random(8), []
    for i in range(40):
        parts = [prose(i, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(shared)
            cut = rng.randint(0, len(text))
            parts += [text[cut:], text, prose(900 + rng.randint(0, 9), rng.randint(1, 9))]
        rng.shuffle(parts)
        rows.append((rng.randint(0, 500), "".join(parts)))
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(1000, rows[0][1]), (1001, rows[1][1]), (1002, rows[1][1])]
    checked(documents, rows)


def test_odd_rows(documents, prose):
    base = prose(1, 30)
    rows = [
        (1, None), (2, ""), (3, "short"), (4, base[:49]), (5, base[:50]), (6, base), (6, base), (7, "é" * 200), (8, "é" * 60),
        (9, "a" * 3_000), (10, "a" * 70), (None, base), (None, base), (12, "b" + base[5:80] + "c" + base[3:60]),
    ]
    checked(documents, rows)
    assert repeats.report(documents([])).count() == 0


def test_long_texts_and_common_passages(documents, prose, monkeypatch):
    """Texts over several stretches, anchors with many different units, small suffix arrays."""
    monkeypatch.setattr(repeats, "STRETCH", 300)
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", 400)
    monkeypatch.setattr(repeats, "TEXT_BYTES", 500)
    monkeypatch.setattr(repeats, "UNITS_AT_ONCE", 7)
    common = prose(77, 12)
    rows = [(i, prose(i, 5) + common + prose(200 + i, 7) + common[:60]) for i in range(30)]
    rows.append((50, prose(3, 400) + common + prose(3, 400)))
    checked(documents, rows)


def test_units_of_texts_together_are_those_of_each():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"abc", k=rng.randrange(400))) for _ in range(60)] + [b"", b"a" * 49, b"a" * 50]

    def units(group):
        return [
            (int(owner), int(anchor), int(own), int(at), int(n))
            for found in repeats.units(group)
            for owner, anchor, own, at, n in zip(*found)
        ]

    together = units(texts)
    alone = [(i, *u[1:]) for i, text in enumerate(texts) for u in units([text])]
    assert together == alone
    contents = {texts[i][at : at + n + repeats.LENGTH - 1]: own for i, _, own, at, n in together}
    assert len(set(contents.values())) == len(contents)
    assert all(contents[texts[i][at : at + n + repeats.LENGTH - 1]] == own for i, _, own, at, n in together)


def test_suffixes_are_sorted_whatever_their_symbols():
    rng = random.Random(6)
    for size in (*range(12), 200, 1000):
        for symbols in (2, 5, 90_000):
            text = [rng.randrange(1, symbols) for _ in range(size)]
            got = suffix_array(np.array(text, np.int64)).tolist()
            assert got == sorted(range(size), key=lambda i: text[i:])


def test_units_that_share_an_anchor_by_chance_are_not_sorted(documents, prose, monkeypatch):
    """Documents of one vocabulary share most anchors in a large corpus; a common string that short is no repeat."""
    sorted_ = []

    def watched(documents, wanted, length, read=repeats.with_content):
        sorted_.extend(r["doc"] for r in wanted.collect())
        return read(documents, wanted, length)

    monkeypatch.setattr(repeats, "with_content", watched)
    common = [prose(s, 9)[:26] for s in range(20, 30)]
    rows = [(i, "".join(prose(100 * i + k, 9) + c for k, c in enumerate(common))) for i in range(30)]
    assert all(len(c) == 26 for c in common)
    checked(documents, rows)
    assert not sorted_
    rows += [(40, prose(1, 3) + prose(100, 9) + prose(2, 3)), (41, prose(3, 3) + prose(101, 9)[-50:] + prose(4, 3))]
    checked(documents, rows)
    assert sorted_ and set(sorted_) <= {1, 40, 41}


def test_units_of_frequent_anchors(documents, prose, monkeypatch):
    """Anchors that the sample finds are spread over tasks, whatever else holds them; results stay."""
    monkeypatch.setattr(repeats, "SAMPLE_EVERY", 1)
    monkeypatch.setattr(repeats, "MANY_UNITS", 3)
    common = prose(77, 30)
    rows = [(i % 25, prose(i, 5) + common + prose(200 + i, 7) + common[:90]) for i in range(30)]
    rows += [(60, common), (61, common), (62, "a" * 500), (63, "b" + "a" * 300), (64, "ab" * 90), (65, "c" + "ab" * 70 + "a" * 60)]
    assert len(repeats.frequent_anchors(documents(rows)))
    checked(documents, rows)


def test_random_texts_of_few_letters(documents):
    """Anchors that occur again inside a unit, and matches of all lengths around ``LENGTH``."""
    rng = random.Random(12)
    pool = ["".join(rng.choices("ab", k=rng.choice([5, 20, 49, 50, 51, 67, 100]))) * rng.choice([1, 1, 4]) for _ in range(25)]
    rows = [(rng.randrange(60), "".join(rng.choice(pool) + rng.choice("xyz") * rng.randrange(20) for _ in range(rng.randrange(12)))) for _ in range(90)]
    checked(documents, rows)
