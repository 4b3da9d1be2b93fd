import re
from collections import Counter

from gleanframe.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)
    }
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_equal_a_plain_count(documents, prose):
    texts = [
        None, "", "   \n\t ", "one", "one two", "a b c", "a b c a b c", "x x x x x", "é ü\u00a0ß a\x85b",
        "same line\nsame line\n\nsame line", "## **bold** <b>", prose(1, 300), prose(2, 40) + "\n" + prose(2, 40),
        "\n".join(["again and again and"] * 50), "word " * 30_000,
    ]
    frame = quality.judge(documents(list(enumerate(texts))))
    for row in frame.collect():
        m = row.metrics
        got = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
        assert got == brute(texts[row.doc_id]), texts[row.doc_id]
        assert row.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert row.size == "own size"


def test_verdict_names_the_rules(documents, prose):
    good = " ".join(f"{w} the {v}" for w, v in zip(prose(3, 60).split(), prose(4, 60).split()))
    noisy = good.replace(" the", " the$$$ ###")
    rows = {r.doc_id: r for r in quality.judge(documents([(1, good), (2, noisy), (3, None), (2, noisy)])).collect()}
    assert rows[1].kept and rows[1].failed == []
    assert not rows[2].kept and "symbols" in rows[2].failed
    assert rows[3].base_failed and not rows[3].kept
    assert quality.judge(documents([])).count() == 0


def test_one_projection_without_shuffle_or_python(documents):
    plan = quality.judge(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan
