"""The pipeline as a whole: stage by stage on the given tables, and on planted cases against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from thermocline.llm import decontamination, near_dedup, toxicity


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
        sizes.append(docs.count())
        assert docs.columns == columns, name
    assert all(a >= b > 0 for a, b in zip(sizes[:4], sizes[1:5])) and sizes[0] > sizes[4]


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert out.count() > 0 and decontamination.hits(out, benchmark).filter("size(spans) > 0").count() == 0
    assert near_dedup.classes(out).filter("doc_id <> class_id").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


# Planted documents, and what plain Python makes of them

SHARED = "This very line stands in many documents of the corpus"


def planted():
    r = random.Random(17)
    clean, bad = [f"clean{i}" for i in range(300)], ["vilest", "scum", "filthy", "idiot"]
    sentence = lambda n, extra=(): " ".join(r.sample([*r.choices(clean, k=n), *extra], n + len(extra))).capitalize() + "."
    items = [(i, sentence(14)) for i in range(5)] + [(90, "short passage of few words"), (91, None)]
    docs, toxic = [], {}
    for i in range(420):
        lines = [sentence(r.randint(6, 14)) for _ in range(r.randint(1, 4))]
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            lines[r.randrange(len(lines))] = sentence(8, r.sample(bad, 3))
        if i % 5 == 1:
            lines.insert(r.randrange(len(lines) + 1), SHARED)
        if i % 5 == 2:
            lines.append(SHARED[:-1] + r.choice("xyz"))  # one edit apart
        if i % 17 == 3:
            lines.append(items[r.randrange(5)][1])
        if i % 29 == 5:
            lines.append("A short Passage, of few words!")
        docs.append((i, "\n".join(lines), "en", r.choice(["a", "a", "a", "b", "c", None])))
    long = [(400 + k, " ".join(r.choices(clean, k=120))) for k in range(1, 4)]
    for k, (base, text) in enumerate(long):
        docs.append((1000 + k, text, "en", "b"))
        words = text.split()
        words[60] = "changed"
        docs.append((1100 + k, " ".join(words), "en", "a"))  # a near copy
        docs.append((1200 + k, text, "en", "c"))  # an exact one: its only line goes
    docs += [(2000, None, "en", "a"), (2001, "", "en", None), (2002, " \n ", "en", "b")]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in docs], items, toxic


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    docs, items, toxic = planted()
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, items, toxic


def noisy_or(text, model):
    """The score from its definition: the probability that neither the leak nor any sentence is toxic, taken from one."""
    clean = 1 - model.leak
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for sentence in re.split(r"[.!?\n]", lower):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence) if w]
        if words:
            features = {f for w in words for f in (w, *(w[:n] + "-" for n in toxicity.STEMS if len(w) >= n))}
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in features))))
    return 1 - clean


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def without_lines(docs):
    seen, out = [], []
    for d in sorted(docs):
        text = d[1]
        if text is None:
            out.append(d)
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            t = line.strip(" \t\r\x0b\x0c")
            if t and any(t == s or (max(len(t), len(s)) >= 20 and one_edit(t, s)) for s in seen):
                gone += 1
            else:
                kept.append(line)
            if t:
                seen.append(t)
        new = "\n".join(kept)
        if not gone or new.strip():
            out.append((*d[:1], new, *d[2:4], len(new)))
    return out


def similarity(a, b):
    runs = lambda t: Counter(tuple(w[i:i + 5]) for w in [re.findall(r"\w+", t.lower())] for i in range(max(len(w) - 4, 1)))
    x, y = runs(a), runs(b)
    return sum(1 / sum(max(x[e] / x[k], y[e] / y[k]) for e in {*x, *y}) for k in x if k in y)


def one_of_each(docs):
    parent = {d[0]: d[0] for d in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    worded = [d for d in docs if re.findall(r"\w+", d[1] or "")]
    for i, a in enumerate(worded):
        for b in worded[:i]:
            if similarity(a[1], b[1]) >= 0.8 - 1e-9:
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    return [d for d in docs if root(d[0]) == d[0]]


def without_passages(docs, items):
    cut = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    windows = set()
    for _, text in items:
        w = cut(text)
        windows |= {tuple(w)} if 0 < len(w) < 10 else {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    hit = lambda w: any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    return [d for d in docs if not hit(cut(d[1]))]


def mixed(docs):
    sizes = {}
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + len((d[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
        open_ -= over
    out = []
    for d in docs:
        rate = target[d[3]] / sizes[d[3]] if sizes[d[3]] else 0.0
        u = int(hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()[:13], 16) / 16 ** 13
        out += [d] * min(int(rate) + (u < rate - int(rate)), 3)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_noisy_or_from_its_definition(spark, world):
    path, docs, _, toxic = world
    frame = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{path}/labels.parquet"))
    scored = {r["doc_id"]: r["tox_score"] for r in toxicity.score(frame, model).collect()}
    assert all(abs(scored[d[0]] - noisy_or(d[1], model)) < 1e-6 for d in docs)
    held = [d for d in toxic if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((scored[d] >= 0.5) == toxic[d] for d in held) >= 0.97 * len(held)


def test_planted_cases_equal_plain_python(spark, world):
    path, docs, items, toxic = world
    frame = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{path}/labels.parquet"))
    plain = [
        lambda d: [x for x in d if noisy_or(x[1], model) < 0.5],
        without_lines, one_of_each, lambda d: without_passages(d, items), mixed]
    expected = sorted(docs)
    for (name, stage), same in zip(corpus_pipeline.STAGES, plain):
        before = len(expected)
        frame = stage(spark, frame, path).checkpoint()
        expected = same(expected)
        assert rows(frame) == sorted(expected, key=str), name
        assert name == "mixing" or 0 < len(expected) < before, name
    assert rows(corpus_pipeline.run(spark, path)) == sorted(expected, key=str)
    left = {d[0] for d in without_lines([x for x in docs if not toxic.get(x[0])])}
    assert {1000, 1001, 1002} <= left and not {1200, 1201, 1202} & left
