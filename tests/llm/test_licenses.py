import random
from collections import Counter

from gleanframe.llm import licenses


def found(frame, **options):
    return sorted((r.doc_id or 0, r.first_line, r.last_line, r.license) for r in licenses.scan(frame, **options).collect())


def test_lines_wrapped_texts_and_changed_words(documents, prose):
    mit = licenses.TEMPLATES[2][1]
    words = mit.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = [
        (1, f"{prose(1, 30)}\nReleased under the MIT License.\n{prose(2, 30)}"),
        (2, "LICENSED under the Apache License, version 1.1!"),
        (3, f"{prose(3, 22)}\n{wrapped}\n{prose(4, 22)}"),
        (4, mit.replace("any person", "every person")),
        (5, prose(5, 200)),
        (6, None), (7, ""), (8, "license"), (9, "the of and to any"),
        (10, "\n\nAll rights reserved.\n\n"), (10, "\n\nAll rights reserved.\n\n"),
        (None, "All rights reserved."),
        (12, "All rights reserved.\n" * 300),
    ]
    got = found(documents(rows))
    assert got[:2] == [(0, 0, 0, "All rights reserved"), (1, 3, 3, "MIT")]
    assert (2, 0, 0, "Apache") in got and (4, 0, 0, "MIT") in got
    assert [x for x in got if x[0] == 3] == [(3, 2, 2 + -(-len(words) // 9) - 1, "MIT")]
    assert [x for x in got if x[0] == 10] == [(10, 0, 0, "All rights reserved")] * 2
    assert len([x for x in got if x[0] == 12 and x[1] == x[2]]) == 300
    assert not {5, 6, 7, 8, 9} & {x[0] for x in got}
    assert found(documents([])) == []


def test_scores_equal_a_plain_comparison(documents):
    import re

    templates = (("A", "one two three four five"), ("A", "one two three four"), ("B", "six seven"))
    texts = ["one two three four five", "one two three four five six", "one two three", "six seven", "two one three four five", "six seven eight"]

    def grams(text):
        words = re.findall(r"\w+", text)
        return set(zip(words, words[1:]))

    want = set()
    for i, text in enumerate(texts):
        for name in "AB":
            best = max(2 * len(grams(text) & grams(t)) / (len(grams(text)) + len(grams(t))) for n, t in templates if n == name)
            if best >= 0.6:
                want.add((i, name, round(best, 9)))
    rows = licenses.scan(documents(list(enumerate(texts))), templates, least=0.6).collect()
    assert {(r.doc_id, r.license, round(r.dice, 9)) for r in rows} == want


def test_notices_among_other_words_and_beside_each_other(documents, prose):
    def wrapped(text):
        words = text.split()
        return "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))

    texts = {name: text for name, text in licenses.TEMPLATES if len(text) > 150}
    isc, gpl = wrapped(texts["ISC"]), wrapped(texts["GPL"])
    rows = [
        (1, "We describe a small parser for logs and how to build it. Released under the MIT License."),
        (2, f"This tool reads maps of old towns. {texts['Apache']}. It was written over one long winter."),
        (3, f"{isc}\n{gpl}"),
        (4, f"{prose(1, 40)} {texts['BSD']} {prose(2, 40)}".replace("\n", " ")),
        (5, f"{prose(3, 40)} all rights were reserved, and a license was given to any person"),
        (6, "Released under the\nMIT License by the people of the town, who hope that it is of use to others"),
    ]
    got = found(documents(rows))
    assert {(1, 0, 0, "MIT"), (2, 0, 0, "Apache"), (4, 0, 0, "BSD"), (6, 0, 1, "MIT")} <= set(got)
    last = len(isc.split("\n")) - 1
    assert [x for x in got if x[0] == 3] == [(3, 0, last, "ISC"), (3, last + 1, last + len(gpl.split("\n")), "GPL")]
    assert len(got) == 6


def test_windows_of_texts_that_repeat_themselves(documents):
    got = licenses.windows(documents([(1, "licensed under the mit " * 20_000), (2, "x " + "all rights reserved " * 20_000)]))
    assert got.where("doc_id = 2").count() == 20_000
    assert got.where("doc_id = 1").count() == 0


def test_a_license_before_one_unknown_word_many_times(documents):
    assert found(documents([(1, "Released under the MIT License" + " qwerty" * 8)])) == [(1, 0, 0, "MIT")]


def test_the_scan_runs_no_python_in_tasks(documents):
    for frame in (licenses.scan(documents([(1, "x")])), licenses.windows(documents([(1, "x")]))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("Python", "Pandas", "Arrow") if x in plan]


def plain_windows(text, templates, least):
    """The windows of a text, by their definition: ``first_line, last_line, license, dice``."""
    lines = [line.split() for line in text.split("\n") if line.split()]
    words, line_of = [w for x in lines for w in x], [i for i, x in enumerate(lines) for _ in x]
    pairs = lambda x: list(zip(x, x[1:]))
    grams, known = pairs(words), {w for _, t in templates for w in t.split()}
    share, found = least / (2 - least), []
    ok = [len(x) > 1 and sum(w in known for w in x) >= share * (len(x) - 1) - 1e-9 for x in lines]
    runs = [(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if all(ok[a : b + 1])]
    runs = [(a, b) for a, b in runs if a == b or not (a and ok[a - 1] or b + 1 < len(lines) and ok[b + 1])]
    for name in {n for n, _ in templates}:
        same, windows, taken = [set(pairs(t.split())) for n, t in templates if n == name], [], set()
        for a, b in runs:
            own = set(pairs([w for x in lines[a : b + 1] for w in x]))
            if any(2 * len(own & t) / (len(own) + len(t)) >= least for t in same):
                taken |= {i for i, line in enumerate(line_of) if a <= line <= b}
        for wanted in same:
            spots = [i for i, g in enumerate(grams) if g in wanted]
            for first in spots:
                scores = []
                for last in (i for i in spots if i >= first and grams[first] not in grams[first + 1 : i + 1]):
                    own = set(grams[first : last + 1])
                    shared, new = len(own & wanted), grams[last] not in grams[first:last]
                    dice = 2 * shared / (len(own) + len(wanted))
                    if new and dice >= least and shared >= least * len(wanted) - 1e-9:
                        scores.append((dice, last, shared))
                if scores:
                    dice, last, shared = max(scores)
                    windows.append((-shared, -dice, first, spots[0], len(windows), last))
        for _, dice, first, _, _, last in sorted(windows):
            own = set(range(first, last + 2))
            if not own & taken:
                taken |= own
                found.append((line_of[first], line_of[last + 1], name, -dice))
    return found


def test_windows_equal_a_plain_search(documents):
    templates = (("A", "a b c d e"), ("A", "a b c d"), ("A", "c d e f g a b"), ("B", "f g"), ("B", "g a f g"), ("C", "x"))
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgx\n") for _ in range(rng.randrange(60)))) for i in range(400)]
    for least in (0.6, 0.8):
        want = Counter((i, *x) for i, text in rows for x in plain_windows(text, templates, least))
        got = Counter(map(tuple, licenses.windows(documents(rows), templates, least).collect()))
        assert got == want and len(want) > 100
