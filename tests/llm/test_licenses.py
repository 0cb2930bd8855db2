import random
import re

import pytest

from ledgerlens.llm import licenses

OWN = licenses.scanner(tuple(licenses.TEMPLATES))


@pytest.mark.parametrize("name, key, text", licenses.TEMPLATES)
def test_every_template_finds_itself(name, key, text):
    rng = random.Random(len(text))
    prose = " ".join("".join(rng.choices("aeinorst", k=rng.randrange(2, 9))) for _ in range(400))
    for around in (text, f"{prose}.\n{text}", f"{text}\n{prose}", f"{prose}. {text} {prose.capitalize()}", text.upper()):
        found = licenses.scan_text(around, OWN)
        assert [f[2] for f in found] == [name], (around, found)
        assert found[0][4] <= licenses.DIFFERENT * len(licenses.wording(text)) and found[0][5] == 0


def test_small_wording_differences():
    found = licenses.scan_text("This book is licensed under the GNU General Public License, version 3.", OWN)
    assert [(f[2], f[4], f[5]) for f in found] == [("GPL-3.0", 1, 1)]
    assert not licenses.scan_text("You need a license to drive, and the apache helicopter needs version 2.0 of it.", OWN)
    assert not licenses.scan_text("The licensed driver took all the rights he could get.", OWN)


def test_versions_are_told_apart():
    for name, text in (("GPL-2.0", "version 2."), ("GPL-3.0", "version 3.")):
        assert [f[2] for f in licenses.scan_text("This work is licensed under the GNU General Public License, " + text, OWN)] == [name]


def words_of(text):
    return re.findall(r"[^\W_]+(?:\.\d+)*", text.lower())


def shared(a, b):
    """Words of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def brute(text):
    """Notices by every stretch of words of the text and every template, without blocks, gates or compression: the one that differs least first, then all that do not overlap it."""
    words, fits = words_of(text), []
    for n, (name, key, t) in enumerate(licenses.TEMPLATES):
        w = words_of(t)
        for a in range(len(words)):
            if words[a] not in w:
                continue
            for b in range(a + 1, min(len(words), a + int(1.2 * len(w))) + 1):
                part = words[a:b]
                if words[b - 1] in w and set(key.split()) <= set(part):
                    differs = len(w) + len(part) - 2 * shared(w, part)
                    if differs <= int(0.2 * len(w)):
                        fits.append((differs / len(w), -len(w), n, a, b, name))
    out = []
    for *_, a, b, name in sorted(fits):
        if all(b <= p or a >= q for p, q, _ in out):
            out.append((a, b, name))
    return [name for _, _, name in sorted(out)]


def test_query_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        prose = [" ".join("".join(rng.choices("aeinorst", k=5)) for _ in range(12)) + "." for _ in range(rng.randrange(2, 12))]
        if k % 2:
            words = rng.choice(licenses.TEMPLATES)[2].split(" ")
            if k % 4 == 1 and len(words) > 8:
                words[rng.randrange(len(words))] = "other"
            prose.insert(rng.randrange(len(prose)), "\n" + " ".join(words) + "\n")
        rows.append((k, " ".join(prose), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (None, "All rights reserved.", "x"), (502, "All rights reserved.", "x"), (502, "All rights reserved.", "x"), (503, "word " * 100_000 + "\nReleased under the MIT License.", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.license) for r in licenses.licence_blocks(frame).collect())
    want = sorted((-1 if i is None else i, name) for i, t, _ in rows for name in brute((t or "").replace("word ", "")))
    assert got == want and len(got) > 40
    assert licenses.licence_blocks(frame.limit(0)).collect() == []


SHORT = [t for t in licenses.TEMPLATES if len(licenses.wording(t[2])) < 16 and "SPDX" not in t[2]]


@pytest.mark.parametrize("between", ["\n", " ", "\nSome other words. "])
def test_neighbouring_notices_are_all_found(between):
    rng = random.Random(len(between))
    for _ in range(25):
        chosen = rng.sample(SHORT, rng.randrange(2, 5))
        text = "Some words before.\n" + between.join(t for _, _, t in chosen) + "\nAnd some after."
        found = licenses.scan_text(text, OWN)
        assert [f[2] for f in found] == [name for name, _, _ in chosen] == brute(text), text
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        assert all(licenses.wording(t) == licenses.wording(text[f[0] : f[1]]) for f, (_, _, t) in zip(found, chosen))


def test_edited_copies_of_one_notice():
    one, two = (t for name, _, t in licenses.TEMPLATES if name == "GPL-3.0" and "SPDX" not in t)
    found = licenses.scan_text(f"{two.replace('redistribute', 'share')}\n{two.replace('published', 'printed')}\n{one}\nAll rights reserved.", OWN)
    assert [f[2] for f in found] == ["GPL-3.0", "GPL-3.0", "GPL-3.0", "all-rights-reserved"]


@pytest.mark.parametrize(
    "text, names",
    [
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3. Licensed under CC BY 4.0.", ["GPL-3.0", "CC-BY-4.0"]),
        ("MIT License.\nAll rights reserved.", ["all-rights-reserved"]),
        ("Released under the MIT License\nAll rights reserved", ["MIT", "all-rights-reserved"]),
        ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", ["GPL-3.0"]),
        ("# SPDX-License-Identifier: CC-BY-SA-4.0", ["CC-BY-SA-4.0"]),
        ("er kam mit dem Bus und mit der Bahn, all das mit Recht", []),
    ],
)
def test_notices_without_hint_words_around(text, names):
    assert [f[2] for f in licenses.scan_text(text, OWN)] == names == brute(text)


def test_long_runs_of_notices_and_texts_without_sentences():
    rng = random.Random(9)
    words = " ".join("".join(rng.choices("aeinorst", k=4)) for _ in range(20_000))
    assert [f[2] for f in licenses.scan_text(f"{words} released under the mit license {words}", OWN)] == ["MIT"]
    chosen = [rng.choice(SHORT) for _ in range(400)]
    found = licenses.scan_text("\n".join(t for _, _, t in chosen), OWN)
    assert [f[2] for f in found] == [name for name, _, _ in chosen]


def test_alignment_equals_every_stretch():
    rng = random.Random(10)
    for _ in range(300):
        template = rng.choices("abcde", k=rng.randrange(1, 7))
        block = rng.choices("abcdef", k=rng.randrange(0, 12))
        costs = [len(template) + b - a - 2 * shared(template, block[a:b]) for a in range(len(block)) for b in range(a + 1, len(block) + 1)]
        got = licenses.alignment(template, block)
        least = min(costs, default=99)
        assert (got is None and least > len(template)) or got[0] + got[1] == min(least, len(template) + 99)


ALL = (*licenses.TEMPLATES, *licenses.SHORT_FORMS)


def test_the_ranking_decides(monkeypatch):
    """A long notice with a few other words is that notice; without compression it is the short one that it holds word for word."""
    long = next(t for name, _, t in licenses.TEMPLATES if name == "Apache-2.0" and len(t) > 150)
    text = "Some words.\n" + long.replace("use this file", "touch this file").replace("obtain a copy", "get a copy") + "\nOther words."
    found = licenses.scan_text(text, OWN)
    assert [(f[2], f[4], f[5]) for f in found] == [("Apache-2.0", 2, 2)]
    monkeypatch.setattr(licenses.Scanner, "saved", lambda self, block, numbers: [0] * len(numbers))
    plain = licenses.scan_text(text, licenses.Scanner(ALL))
    assert plain[0][2:3] + plain[0][4:] == ("Apache-2.0", 0, 0)


def test_few_templates_are_compared_word_by_word(monkeypatch):
    calls = []
    plain = licenses.alignment
    monkeypatch.setattr(licenses, "alignment", lambda *a, **b: calls.append(a) or plain(*a, **b))
    texts = [t for _, _, t in ALL]
    own = licenses.Scanner(ALL)
    assert all(licenses.scan_text(t, own) for t in texts)
    ranked = len(calls)
    calls.clear()
    monkeypatch.setattr(licenses.Scanner, "saved", lambda self, block, numbers: [0] * len(numbers))
    own = licenses.Scanner(ALL)
    assert all(licenses.scan_text(t, own) for t in texts) and ranked < len(calls)


@pytest.mark.parametrize("text, name", [("Apache License 2.0", "Apache-2.0"), ("License: MIT", "MIT"), ("Released under MIT.", "MIT"), ("GNU GPL v3", "GPL-3.0"), ("BSD 2-Clause License", "BSD-2-Clause"), ("ISC License", "ISC"), ("Licensed under the GPLv2+", "GPL-2.0"), ("SPDX-License-Identifier: ISC", "ISC")])
def test_short_forms(text, name):
    assert [f[2] for f in licenses.scan_text(f"Words before it.\n{text}\nand after.", licenses.scanner(ALL))] == [name]


def test_all_forms_find_themselves():
    own = licenses.scanner(ALL)
    for name, _, text in ALL:
        assert [f[2] for f in licenses.scan_text(f"Some words before.\n{text}\nAnd some after.", own)] == [name], text
