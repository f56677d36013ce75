"""Columns of any name, and ids that repeat with different texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thermocline.llm import line_dedup, mixing, near_dedup, toxicity

NAMES = ("mix_size mix_source_size mix_target mix_copies mix_source mix_copy source_size target weight gone gone_id gone_hash gone_near cut _cut "
         "tox_score tox_sentences row score sentences h1 h2 id bands class_id copies found_id line line_no text_hash word toxic").split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "You are vile and stupid. Go away now.", "a"), (2, "A clean line of some words here.\nShared line of more than twenty letters", "a"),
            (3, "Another clean text of words.\nShared line of more than twenty letters", "b"), (4, None, None), (5, "", "b"), (2, "again two", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({n: F.lit(f"{n} ") for n in NAMES})


def test_no_clash_in_mixing(clashing):
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns and out.filter("mix_size = 'mix_size ' and mix_copy = 'mix_copy '").count() == out.count()
    plain = mixing.mix(clashing.select("doc_id", "text", "source"))
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, plain.select("doc_id", "text").collect()))
    assert mixing.copies(clashing).columns[-4:] == ["_mix_size", "_mix_source_size", "_mix_target", "_mix_copies"]
    assert mixing.mix(clashing.limit(0)).count() == 0


def test_no_clash_in_line_dedup(clashing):
    out = line_dedup.dedup_lines(clashing)
    assert out.columns == clashing.columns and out.count() == 6
    assert {r["text"] for r in out.filter("doc_id = 3 and gone = 'gone '").collect()} == {"Another clean text of words."}
    assert line_dedup.dedup_lines(clashing.limit(0)).count() == 0


def test_no_clash_in_toxicity(spark, clashing):
    words = ["vile", "stupid", "calm", "kind"]
    r = random.Random(1)
    train = spark.createDataFrame([(i, " ".join(r.choices(words[:2] if i % 2 else words[2:], k=5)) + ".") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(train, labels)
    out = toxicity.score(clashing, model)
    assert out.columns == [*clashing.columns, "_tox_score", "_tox_sentences"] and out.filter("tox_score = 'tox_score '").count() == 6
    assert [r["doc_id"] for r in out.filter("_tox_score >= 0.5").collect()] == [1]
    odd = clashing.withColumnRenamed("row", "a name, with: <signs>")
    assert toxicity.score(odd, model).count() == 6
    assert toxicity.without_toxic(clashing.limit(0), labels).columns == clashing.columns


def similarity(a, b):
    """Probability Jaccard of the runs of five words, from its definition."""
    x, y = (Counter(tuple(t.split()[i:i + 5]) for i in range(max(len(t.split()) - 4, 1))) for t in (a, b))
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in {*x, *y}) for d in x if d in y)


def brute_classes(rows):
    parent = {i: i for i in range(len(rows))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, t) in enumerate(rows):
        for j in range(i):
            if rows[j][0] == d or similarity(t, rows[j][1]) >= 0.8 - 1e-9:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def near(text, r, edits=1):
    words = text.split()
    return " ".join(words[:-edits] + [f"x{r.randrange(10 ** 6)}" for _ in range(edits)])


def test_ids_that_repeat_keep_all_their_links(spark):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(n))
    a, b = text(40), text(10)
    rows = [(1, a), (5, near(a, r)), (5, b), (7, near(b, r))]
    assert similarity(rows[2][1], rows[3][1]) < 0.8  # five of seven runs: no link
    b = text(14)
    rows[2:] = [(5, b), (7, near(b, r))]
    assert similarity(rows[2][1], rows[3][1]) > 0.8
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 7: 1}


@pytest.mark.parametrize("estimate", [True, False])
def test_random_repeated_ids_equal_brute_force(spark, estimate):
    r = random.Random(8)
    bases = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = [(r.randrange(60), near(r.choice(bases), r, r.randint(1, 4)) if r.random() < 0.8 else r.choice(bases)) for _ in range(90)]
    found = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), estimate=estimate)
    got = {}
    for x in found.collect():
        assert got.setdefault(x["doc_id"], x["class_id"]) == x["class_id"]
    assert got == brute_classes(rows)
    kept = {x["doc_id"] for x in near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(got.values())
