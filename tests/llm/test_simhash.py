import random
import re

import numpy as np
import xxhash

from gleanframe.llm import simhash
from gleanframe.llm.components import components


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    """Smallest member reachable over pairs within ``radius``."""
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint_equals_its_definition(prose, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 50)
    for text in (None, "", " \n", "A", "a B", "É ü ß", "a b c", "a b c a b c d", prose(1, 400), "x " * 500, "a\x1cb \x85 c d"):
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def near(rng, base, flips):
    return base ^ sum(1 << b for b in rng.sample(range(64), flips))


def test_links_span_all_pairs(spark):
    rng = random.Random(9)
    values = {0, 1, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        values |= {near(rng, base, rng.randint(0, 6)) for _ in range(15)}
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    n, both = simhash.bit_counts(frame)
    assert n == len(values)
    bits = np.array([[v >> b & 1 for b in range(64)] for v in values])
    assert (both == bits.T @ bits).all()
    for parts in (simhash.plan(n, both), [(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(64)), 3)]):
        assert sum(t + 1 for _, t in parts) == 4
        links = simhash.links_of(frame, parts).collect()
        mask = (1 << 64) - 1
        assert all((r.a & mask ^ r.b & mask).bit_count() <= 3 for r in links)
        label = {v: v for v in values}
        for _ in values:
            for r in links:
                low = min(label[r.a & mask], label[r.b & mask])
                label[r.a & mask] = label[r.b & mask] = low
        assert label == brute_components(values)


def test_plan_weighs_rows_against_candidates():
    few, many = (simhash.plan(n, np.full((64, 64), n // 4) + np.diag([n // 4] * 64)) for n in (1_000, 10**10))
    assert max(len(b) for b, _ in few) <= max(len(b) for b, _ in many)
    for parts in (few, many):
        assert sum(t + 1 for _, t in parts) == 4


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 201)]
    random.Random(1).shuffle(links)
    frame = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in links], "a long, b long")
    roots = {r.node: r.root for r in components(frame).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert roots == want
    assert components(frame.limit(0)).count() == 0


def test_near_duplicates(documents, prose):
    base = prose(1, 400)
    rows = [(5, base), (3, base + " tail"), (9, prose(2, 300)), (7, None), (2, ""), (8, " "), (9, prose(2, 300)), (None, base), (11, "a b")]
    docs = documents(rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    values = {simhash.fingerprint(t) for _, t in rows}
    label = brute_components(values)
    for r in got:
        assert r.fingerprint in {f"{v:016x}" for v in values}
        mates = [i for i, t in rows if i is not None and label[simhash.fingerprint(t)] == label[int(r.fingerprint, 16)]]
        assert r.component_id == min(mates)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})
    assert {r.turn for r in kept.collect()} == {"own turn"}


def test_rows_without_ids_and_empty_tables(documents, prose):
    docs = documents([(None, prose(1, 90)), (None, prose(1, 90)), (None, prose(2, 90)), (4, prose(3, 90))])
    assert sorted(r.text for r in simhash.keep_one(docs).collect()) == sorted(prose(s, 90) for s in (1, 2, 3))
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {None, 4}
    assert simhash.near_duplicates(documents([])).count() == 0 and simhash.keep_one(documents([])).count() == 0
