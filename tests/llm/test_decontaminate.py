import random

from gleanframe.llm import decontaminate


def brute_tiles(a, b, length):
    """Greedy string tiling by its definition: mark the longest common run, again and again."""
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < length:
            return total
        k, i, j = best[0], -best[1], -best[2]
        for x in range(k):
            used_a[i + x] = used_b[j + x] = True
        total += k


def test_tiling_equals_its_definition():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.choice("abcdefg") for _ in range(rng.randint(1, 25))]
        text = [rng.choice("abcdefg") for _ in range(rng.randint(0, 40))]
        cut = rng.randint(0, len(item))
        text[rng.randint(0, len(text)) : 0] = item[cut:] + ["x"] * rng.randint(0, 2) + item[:cut]
        block = decontaminate.Block([(7, " ".join(item))])
        found = list(decontaminate.matches(" ".join(text), block))
        want = brute_tiles(text, item, min(decontaminate.MIN_MATCH, len(item)))
        assert (found[0][1] if found else 0) == want, (item, text)


def test_whole_reordered_and_partial_passages(spark, documents, prose):
    item = " ".join(prose(1, 40).split())
    words = item.split()
    noise = [prose(s, 60) for s in range(10, 16)]
    rows = [
        (1, f"{noise[0]} {item} {noise[1]}"),
        (2, f"{noise[2]} {' '.join(words[20:])} {noise[3]} {' '.join(words[:20])}"),
        (3, f"{noise[4]} {' '.join(words[:20])}"),
        (4, noise[5]),
        (5, None),
        (6, ""),
        (7, item.upper().replace(" ", ", ")),
        (None, item),
        (1, f"{noise[0]} {item} {noise[1]}"),
    ]
    docs = documents(rows)
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "two words"), (10, item)], "item_id long, text string")
    pairs = decontaminate.contaminated_pairs(docs, items).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.tiles) for r in pairs)
    assert {x[1] for x in found if not x[0]} == {1, 2, 7} and len(found) == 2 * 5
    assert {x[3] for x in found if x[1] == 2} == {2}
    kept = decontaminate.keep_uncontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_blocks_of_items_change_nothing(spark, documents, prose, monkeypatch):
    items = [(i, prose(i, 30)) for i in range(6)]
    docs = documents([(i, prose(100 + i, 50) + " " + items[i % 6][1]) for i in range(12)])
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated_pairs(docs, table).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert len(list(decontaminate._blocks(table))) > 2
    assert sorted(map(tuple, decontaminate.contaminated_pairs(docs, table).collect())) == whole and len(whole) == 12
    assert decontaminate.keep_uncontaminated(docs, table).count() == 0


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b c d e f")])
    assert decontaminate.contaminated_pairs(docs, none).count() == 0
    assert decontaminate.keep_uncontaminated(docs, none).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated_pairs(documents([]), some).count() == 0
