import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, language="en"):
    words = {"en": "the of and to in is with thorn shore being other there then into water stone", "fr": "le la de et les des pour avec été mère eaux lieu vous nous chant rêve", "de": "der die das und nicht mit ein auch über große wälder straße schön immer wieder"}[language].split()
    return " ".join(rng.choice(words) + (str(rng.randrange(9000)) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Prose with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        rows.append([i, sentence(rng, rng.randrange(20, 200), lang), lang, f"s{i % 4}"])
    passage = sentence(rng, 70)
    for i in range(60, 66):
        rows.append([i, f"{sentence(rng, 30)} {passage} {sentence(rng, 25)}", "en", "s1"])
    for i in range(66, 72):
        words = rows[i - 66][1].split()
        words[len(words) // 2] = "changed"
        rows.append([i, " ".join(words), rows[i - 66][2], "s2"])
    rows += [[72, rows[3][1], "en", "s0"], [73, rows[3][1], None, None], [74, "", "en", "s0"], [75, "", None, "s3"], [76, None, "en", "s0"], [None, None, None, None]]
    rows += [[77, "a", "en", "s0"], [78, "!!! ???", "en", "s1"], [79, "word " * 40, "en", "s1"], [80, "same line here\n" * 60, "en", "s1"], [81, "x" * 70_000, "en", "s2"], [82, sentence(rng, 12_000), "en", "s2"]]
    rows += [[None, sentence(rng, 80), "en", "s0"], [5, rows[5][1], "fr", "s9"], [5, rows[5][1], rows[5][2], rows[5][3]], [83, "Été à la mer 漢字 🙂 naïve " * 30, "fr", "s3"]]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """With columns of the names that operators use inside."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("rh", "m", "w", "n", "k", "sig", "root", "passages", "tf_rh", "tf_k", "tf_copies", "tf_quota", "quota", "label", "language", "block", "ids", "row_index"):
        out = out.withColumn(name, F.lit(name))
    return out
