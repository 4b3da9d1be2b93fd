import random
import zlib

from gleanframe.llm import toxicity


def corpus(documents, spark, stems=("vorgo", "plimb"), n=400):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "en", "ist"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_learned_terms_find_held_out_rows(documents, spark):
    docs, labels, truth = corpus(documents, spark)
    model = toxicity.learn(docs, labels)
    assert {"vorgo", "plimb"} <= set(model.terms)
    rows = toxicity.score(docs.select("doc_id", "text", toxicity.held_out(docs.doc_id).alias("h")), model).collect()
    for r in rows:
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    right = [r.predicted == truth[r.doc_id] for r in rows if r.h]
    assert sum(right) >= 0.95 * len(right)


def test_held_out_labels_are_not_read(documents, spark):
    docs, labels, _ = corpus(documents, spark)
    turned = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where(toxicity.held_out(labels.doc_id))
    mixed = labels.where(~toxicity.held_out(labels.doc_id)).unionByName(turned)
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, mixed)


def test_disguises_exceptions_and_length():
    table, tree = toxicity.folding_table(), toxicity.automaton(toxicity.SEED_TERMS)
    count = lambda text: sum(toxicity.hits(toxicity.fold(text, table), tree).values())
    for text in ("IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "id\u200biot", "(idiot)", "idiots!", "an idi\u00adot."):
        assert count(text) == 1, text
    assert count("a trash can") == 0 and count("trash") == 1 and count("trash can and trash") == 1
    assert count(None) == 0 and count("") == 0 and count("patio video") == 0
    one = toxicity.hits(toxicity.fold("idiot", table), tree)
    assert toxicity.SEED_MODEL.score(one, 5) > toxicity.SEED_MODEL.score(one, 50_000) > 0.3


def test_odd_rows(documents, spark):
    docs = documents([(1, None), (2, ""), (None, "such an idiot"), (4, "fine text"), (4, "fine text")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    for labels in (none, odd):
        assert toxicity.learn(docs, labels) == toxicity.SEED_MODEL
    scored = toxicity.score(docs, toxicity.SEED_MODEL)
    assert [r.predicted for r in scored.orderBy("doc_id").collect()] == [1, 0, 0, 0, 0]
    clean = toxicity.keep_clean(docs, toxicity.SEED_MODEL)
    assert clean.columns == docs.columns and clean.count() == 4
    assert toxicity.score(documents([]), toxicity.SEED_MODEL).count() == 0
    assert toxicity.learn(documents([]), none) == toxicity.SEED_MODEL


def naive_hits(folded, terms, exceptions):
    found = {}
    for at, c in enumerate(folded):
        here = [t for t in terms if folded.startswith(f" {t}", at)] if c == " " else []
        if here and not any(folded.startswith(f" {e}", at) for e in exceptions):
            longest = max(here, key=len)
            found[longest] = found.get(longest, 0) + 1
    return found


def test_the_automaton_finds_what_a_plain_search_finds():
    rng, table = random.Random(8), toxicity.folding_table()
    terms, exceptions = ["ab", "abc", "b", "ca t", "aa", "aab"], ["ab ba", "b c", "aabb"]
    tree = toxicity.automaton(terms, exceptions)
    for _ in range(3_000):
        text = "".join(rng.choice("aabbc  t4@​.В") for _ in range(rng.randint(0, 30)))
        folded = toxicity.fold(text, table)
        got = {terms[t]: n for t, n in toxicity.hits(folded, tree).items()}
        assert got == naive_hits(folded, terms, exceptions), text
