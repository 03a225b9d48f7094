import random

import numpy as np
import pytest

from treeframe.llm import langid
from treeframe.llm import license_scan as ls

from .conftest import sentence


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    labels = [("en", "fr", "de")[i % 3] for i in range(600)]
    return langid.fit([sentence(rng, rng.randrange(5, 90), x) for x in labels], labels)


def test_held_out(model):
    rng = random.Random(77)
    labels = [("en", "fr", "de")[i % 3] for i in range(300)]
    texts = [sentence(rng, rng.randrange(5, 90), x) for x in labels]
    best, sure, accepted = model.predict(*langid._packed(texts))
    right = np.array([model.languages[b] == y for b, y in zip(best, labels)])
    assert right.mean() > 0.97 and accepted.mean() > 0.99
    # of what it is sure of it is right about as often as it says
    assert abs(sure[right | ~right].mean() - right.mean()) < 0.15
    noise = langid.garbled([t * 3 for t in texts], np.random.default_rng(8))
    assert model.predict(*langid._packed(noise))[2].mean() < 0.1


def test_a_language_left_out():
    """Each language in turn isn't among the labels: most long texts in it are rejected, and hardly any others."""
    names = ("en", "fr", "de")
    for out in names:
        rng = random.Random(5)
        labels = [x for x in names if x != out] * 300
        m = langid.fit([sentence(rng, rng.randrange(20, 90), x) for x in labels], labels)
        ours = [sentence(rng, 60, x) for x in labels[:300]]
        others = [sentence(rng, 60, out) for _ in range(200)]
        assert m.predict(*langid._packed(ours))[2].mean() > 0.98
        assert m.predict(*langid._packed(others))[2].mean() < 0.5, out


def test_whole_texts_and_batches(model):
    """A prediction doesn't depend on the other texts of a batch, and uses all of a text."""
    rng = random.Random(4)
    texts = [sentence(rng, 30, "de"), "", "!!!", sentence(rng, 4, "en") + " " + sentence(rng, 4000, "fr"), "x"]
    together = model.predict(*langid._packed(texts))
    for i, t in enumerate(texts):
        alone = model.predict(*langid._packed([t]))
        assert alone[0][0] == together[0][i] and np.isclose(alone[1][0], together[1][i])
    assert [model.languages[b] if b >= 0 else None for b in together[0]][:4] == ["de", None, None, "fr"]
    assert together[2].tolist() == [True, False, False, True, True]


def test_features_by_hand():
    data, offsets = langid._packed(["Ab", "", "..", "a  b"])
    flat, first = langid.features(data, offsets)
    assert np.diff(first).tolist() == [2, 0, 0, 3 + 1]
    assert flat[0] == flat[first[3]]


def test_frames(docs, empty, clashing, corpus):
    got = {repr((r.doc_id, r.language is None)): r for r in langid.identify(docs).collect()}
    assert len(langid.identify(docs).collect()) == len(corpus)
    assert not any(r.accepted for r in got.values() if r.language is None)
    kept = langid.accepted(docs).collect()
    assert {r.doc_id for r in kept} >= set(range(72)) and not any(r.text in (None, "") for r in kept)
    assert langid.identify(empty).count() == 0 and langid.accepted(empty).count() == 0
    assert langid.accepted(clashing).columns == clashing.columns
    assert langid.identify(docs.where("lang IS NULL")).where("accepted").count() == 0
    texts, labels = langid.labelled_sample(docs, "lang", 20)
    assert len(texts) == len(labels) <= 20


def test_every_label_is_in_the_sample(spark):
    """A label of 3 in 5000 rows, and a text with 2000 copies."""
    rows = [(f"text {i}", "en" if i % 3 else "de") for i in range(3000)] + [("copied", "en")] * 2000 + [(f"rare {i}", "fr") for i in range(3)]
    texts, labels = langid.labelled_sample(spark.createDataFrame(rows, "text string, lang string").repartition(5), "lang", 100)
    assert len(texts) == len(set(texts)) == 100
    assert labels.count("fr") == 3 and abs(labels.count("en") - labels.count("de")) <= 1


@pytest.mark.parametrize("values", [[], [1], [3, 1, 2, 5, 4], [5, 4, 3], [1, 2, 3], [2, 9, 1, 10, 3, 4, 5]])
def test_longest_ascending(values):
    got = [values[i] for i in ls.ascending(values)]
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert got == sorted(set(got)) and len(got) == max(best, default=0)


def test_align():
    a, b = "x the quick brown fox y jumps over".split(), "the quick red fox jumps over".split()
    assert [a[i] for i, _ in ls.align(a, b)] == "the quick fox jumps over".split()
    assert ls.align([], b) == [] and ls.align(a, a) == [(i, i) for i in range(len(a))]
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = ls.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def _cases():
    rng = random.Random(6)
    plain = sentence(rng, 300)
    mit = ls.TEMPLATES["mit"]
    words = mit.split()
    for i in range(0, len(words), 12):
        words[i] = "changed"
    return {
        1: f"{plain} Released under the MIT License. {plain}",
        2: f"{plain}\n{mit}\n{plain}",
        3: f"{plain} {' '.join(words)}",
        4: plain,
        5: "Licensed under CC BY-NC 4.0. " * 3,
        6: f"LICENSED under the apache license, version 2.0 {plain} All rights reserved.",
        7: "license under the " * 50,
        8: None,
        9: "",
        10: ls.TEMPLATES["apache-2.0"],
        11: " ".join(mit.split()[: len(mit.split()) // 2]),
    }


def test_license_scan(spark):
    cases = _cases()
    df = spark.createDataFrame([(k, v, "x") for k, v in cases.items()], "doc_id long, text string, license string")
    got = {}
    for r in ls.license_scan(df).collect():
        got.setdefault(r.doc_id, []).append(r)
        words = ls.normalised(cases[r.doc_id])[r.first_word : r.first_word + r.n_words]
        template = ls.normalised(ls.TEMPLATES[r.license])
        assert len(ls.align(words, template)) >= r.coverage * len(template) - 1e-6
    names = {k: sorted(x.license for x in v) for k, v in got.items()}
    assert names[1] == ["mit-statement"] and names[2] == ["mit"] and names[3] == ["mit"] and names[5] == ["cc-by-nc-4.0-statement"] * 3
    assert names[6] == ["all-rights-reserved", "apache-2.0-statement"] and names[10] == ["apache-2.0", "apache-2.0-statement"]
    assert not {4, 7, 8, 9, 11} & set(names)
    assert got[2][0].coverage == 1.0 and got[3][0].coverage < 1
    assert ls.license_scan(df.limit(0)).count() == 0


def test_every_window_against_the_votes():
    """Aligning at every word of the text finds no license that the scan doesn't."""
    scanner = ls.Scanner(ls.TEMPLATES, 0.8)
    for text in _cases().values():
        words = ls.normalised(text or "")
        found = {n for n, *_ in scanner.scan(words, [i for i, w in enumerate(words) if w in scanner.places])}
        brute = set()
        for name, t in scanner.templates:
            slack = max(2, len(t) // 4)
            for i in range(len(words)):
                if len(ls.align(words[i : i + len(t) + slack], t)) >= 0.8 * len(t) and len(t) > 8:
                    brute.add(name)
        assert brute <= found


def test_words_put_in():
    """Places with words put in, held against alignment over the whole text; other words are in no template."""
    scanner = ls.Scanner(ls.TEMPLATES, 0.8)
    scan = lambda words: {n for n, *_ in scanner.scan(words, [i for i, w in enumerate(words) if w in scanner.places])}
    assert "apache-2.0-statement" in scan(ls.normalised("Licensed under the terms of the Apache License, Version 2.0"))
    assert "cc-by-4.0-statement" in scan(ls.normalised("Licensed under the Creative Commons CC BY 4.0"))
    assert "all-rights-reserved" in scan(ls.normalised("here all of our rights reserved"))
    rng = random.Random(1)
    for name, template in scanner.templates:
        m = len(template)
        for n in (1, 3, 4, m // 4, m // 3, m // 2, m - 1, 2 * m):
            middle, around = [f"q{k}" for k in range(n)], [f"z{k}" for k in range(50)]
            cut = rng.randrange(1, m)
            if n <= (2 * m if m >= ls.LONG else max(ls.INSERTED, m)):
                words = around + template[:cut] + middle + template[cut:] + around
                assert len(ls.align(words, template)) >= 0.8 * m and name in scan(words), (name, n, cut)
        # one to one with other words
        words = around + [w for pair in zip(template, (f"q{k}" for k in range(m))) for w in pair] + around
        assert len(ls.align(words, template)) < 0.8 * m or name in scan(words), name
        words = list(template)
        for k in range(min(m, ls.INSERTED)):
            words.insert(rng.randrange(1, len(words)), f"q{k}")
        words = around + words + around
        assert len(ls.align(words, template)) < 0.8 * m or name in scan(words), name


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the BSD License.", {"bsd-statement"}),
        ("Released under the ISC License.", {"isc-statement"}),
        ("Released under the Foo License.", set()),
        ("Released under MIT License.", {"mit-statement"}),
        ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0-statement"}),
        ("Licensed under CC BY-NC-SA 4.0.", {"cc-by-nc-sa-4.0-statement"}),
        ("Licensed under CC BY-NC 4.0.\nNd edin on the", {"cc-by-nc-4.0-statement"}),
        ("Licensed under CC BY 3.0.", set()),
        ("Licensed under CC BY-SA 3.0.", set()),
        ("Licensed under CC0 1.0.", {"cc0-1.0-statement"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0-statement"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl-3.0-statement"}),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", {"lgpl-2.1-statement"}),
        ("This work is licensed under the GNU Library General Public License, version 3.", set()),
        ("Licensed under the Apache License, Version 1.1.", set()),
        *((ls.TEMPLATES.get(name, ""), {name}) for name in ("gpl-2.0", "gpl-3.0", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause", "unlicense", "mit", "isc", "mpl-2.0")),
    ],
)
def test_names_tell_licenses_apart(text, want):
    scanner = ls.Scanner(ls.TEMPLATES, 0.8)
    for words in (ls.normalised(text), ["here", *ls.normalised(text), "there"]):
        assert {n for n, *_ in scanner.scan(words, [i for i, w in enumerate(words) if w in scanner.places])} == want


def test_other_templates(spark):
    df = spark.createDataFrame([(1, "a b c of the d e f g h")], "doc_id long, text string")
    assert ls.license_scan(df, {"own": "of the", "none": "!!", "two": "d e f g x"}, 0.8).select("license").distinct().count() == 2
    with pytest.raises(ValueError):
        ls.license_scan(df, coverage=0)
