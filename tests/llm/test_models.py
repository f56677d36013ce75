"""Operators without SQL: token counts, near dedup, embeddings, toxicity and LM scoring against plain computations."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from thermocline.llm import embedding_dedup, language_model, near_dedup, token_counts, toxicity
from thermocline.llm.common import components
from thermocline.llm.queries import QUERIES

LONG = "alpha beta gamma delta " * 3000


def test_token_counts_equal_the_whole_text(spark, odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, " leading", "two  spaces\n\nand\tlines ", "don't stop", "x<|endoftext|> y <|endoftext|>", "é ü     x", "1 000 000", "a" * 5000, LONG,
             "emoji \U0001F600\U0001F600 end", " ", "\n", "tab\t x \x1c y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, "byte_bpe_50k.json").collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512), t
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert token_counts.token_counts(odd_docs, name).count() == odd_docs.count()


def test_forgetting_pieces_changes_nothing(monkeypatch):
    texts = [f"some words {i} and more {i * i} words" for i in range(50)]
    whole = token_counts.text_lengths(texts, "byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 16)
    assert token_counts.text_lengths(texts, "byte_bpe_50k.json") == whole


def direct_jaccard(a: Counter, b: Counter) -> float:
    """The definition, term by term."""
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a if d in b)


def weighted(c: Counter):
    return np.array(sorted(c), dtype=np.int64), np.array([c[k] for k in sorted(c)])


def test_similarity_and_signatures_agree():
    rng = random.Random(2)
    for _ in range(20):
        a = Counter(rng.choices(range(30), k=40))
        b = a + Counter(rng.choices(range(40), k=rng.randrange(1, 30)))
        exact = direct_jaccard(a, b)
        assert abs(near_dedup.similarity(*weighted(a), *weighted(b)) - exact) < 1e-12
        elements = np.concatenate([near_dedup._mixed(weighted(c)[0].astype(np.uint64)) for c in (a, b)])
        weights = np.concatenate([weighted(c)[1] for c in (a, b)]).astype(float)
        owner = np.repeat([0, 1], [len(a), len(b)])
        one, two = near_dedup.signatures(elements, weights, owner, 2, 4096)
        assert abs((one == two).mean() - exact) < 0.05


def brute_classes(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = Counter(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()
    low = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and direct_jaccard(sets[a], sets[b]) >= 0.8 - 1e-9:
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = {k: new if v == old else v for k, v in low.items()}
    return low


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return words


def test_near_classes_equal_all_pairs(spark):
    rng, texts = random.Random(3), {}
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 80, 120]))]
        for _ in range(8):
            base = edited(base, rng, rng.choice([0, 0, 1, 2])) if rng.random() < 0.5 else base  # chains as well as stars
            texts[len(texts)] = " ".join(edited(base, rng, rng.choice([0, 0, 1, 3])))
    texts |= {100: None, 101: "", 102: "one", 103: "one", 104: "  "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert all(got.get(i, i) == c for i, c in want.items()) and len(set(want.values())) < len(texts) - 10
    kept = {r["doc_id"] for r in near_dedup.dedup(docs).collect()}
    assert kept == set(want.values())


def test_links_keep_chains_between_members_of_one_bucket(spark):
    """All members share one bucket; settled ones may not hide a link of another."""
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(24):
        rows.append((i, list(words)))
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(200)] = f"x{i}.{rng.randrange(10**6)}"
    sets = {i: Counter(abs(hash(w)) % 2**40 for w in ws) for i, ws in rows}
    frame = spark.createDataFrame([(i, *(x.tolist() for x in weighted(c))) for i, c in sets.items()], "id long, set array<long>, count array<int>")
    members = spark.createDataFrame([(1, i) for i in sets], "bucket long, id long")
    drawn = near_dedup.sketches(near_dedup.signatures(
        np.concatenate([near_dedup._mixed(weighted(c)[0].astype(np.uint64)) for c in sets.values()]),
        np.concatenate([weighted(c)[1] for c in sets.values()]).astype(float), np.repeat(np.arange(24), [len(c) for c in sets.values()]),
        24, near_dedup.BANDS * near_dedup.ROWS))
    found = near_dedup.links(members, frame, spark.createDataFrame([(i, drawn[i].tolist()) for i in sets], "id long, sketch array<long>"))
    got = {r["id"]: r["component"] for r in components(members.select("id"), found, "id").collect()}
    low = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and direct_jaccard(sets[a], sets[b]) >= 0.8 - 1e-9:
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = {k: new if v == old else v for k, v in low.items()}
    assert got == low


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(70, 71), (71, 70)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 70, 71, 99]], "node long")
    got = {r["node"]: r["component"] for r in components(nodes, links).collect()}
    assert all(got[i] == (0 if i <= 30 else 31) for i in range(61)) and got[70] == got[71] == 70 and got[99] == 99


def test_odd_documents_are_deduplicated(spark, odd_docs, no_docs):
    out = near_dedup.dedup(odd_docs)
    assert out.columns == odd_docs.columns and near_dedup.dedup(no_docs).count() == 0
    left = [r["doc_id"] for r in out.collect()]
    assert left.count(4) == 2 and None in left and 1 in left and 2 in left and 6 not in left


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    for i in range(60, 200):
        near = base[i % 60] / np.linalg.norm(base[i % 60]) + rng.standard_normal(24) * rng.choice([0.0, 0.02, 0.05, 0.1, 0.2])
        rows.append((i, (near * rng.choice([0.5, 2.0])).astype(np.float32).tolist()))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] + [1.0] * 23), (304, []),
             (305, rows[0][1][:7]), (306, [2 * x for x in rows[0][1][:7]]), (307, [float("inf")] * 24), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and (i < 300 or i in (305, 306))}
    linked = {(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b])
              and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95}
    got = {r["vec_id"]: r for r in embedding_dedup.groups(df).collect()}
    assert len(got) == len(rows)
    n = Counter(x for p in linked for x in p)
    found = sum(got[i]["n_links"] for i in ok)
    assert found >= 0.9 * 2 * len(linked) and all(got[i]["n_links"] <= n[i] for i in ok)
    for i in (300, 301, 302, 303, 304, 307, None):
        assert got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i
    assert got[305]["n_links"] == got[306]["n_links"] == 1 and got[306]["component_id"] == 305
    assert got[201]["component_id"] == got[3]["component_id"] and got[201]["n_links"] == got[3]["n_links"] >= 2
    assert embedding_dedup.groups(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = 0.97 * x[:200] + np.sqrt(1 - 0.97**2) * (lambda r: r / np.linalg.norm(r, axis=1, keepdims=True))(np.random.default_rng(6).standard_normal((200, x.shape[1])))
    made = [(r["vec_id"], r["embedding"]) for r in rows] + [(10**6 + i, v.tolist()) for i, v in enumerate(near)]
    every = np.vstack([x, near / np.linalg.norm(near, axis=1, keepdims=True)])
    want = int((np.triu(every @ every.T, 1) >= 0.95).sum())
    got = embedding_dedup.groups(spark.createDataFrame(made, "vec_id long, embedding array<float>")).agg({"n_links": "sum"}).first()[0] / 2
    assert want > 100 and 0.9 * want <= got <= want


INSULTS = ["vilest", "rotten", "wicked"]


def labelled(n, seed=7):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(80)}" for _ in range(rng.randrange(20, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(INSULTS) + rng.choice(["", "ly", "ness"])
        docs.append((i, ". ".join(" ".join(words[k:k + 8]) for k in range(0, len(words), 8))))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark, monkeypatch):
    docs, labels = labelled(500)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setitem(QUERIES["op9_toxicity"].__globals__, "table", lambda _s, _d, t: {"documents": d, "labels": y}[t])
    got = QUERIES["op9_toxicity"](spark, "").toPandas()
    held = got[got.held_out].assign(y=[labels[i][1] for i in got[got.held_out].doc_id])
    assert 50 < len(held) < 150 and (held.predicted == held.y).mean() > 0.95
    model = toxicity.train(d, y)
    row = toxicity.score(spark.createDataFrame([(1, "é fine words here! w1 vilest w2. more")], "doc_id long, text string"), model).first()
    (hit,) = row["tox_sentences"]
    assert row["text"][hit["start"]:hit["stop"]] == " w1 vilest w2" and hit["number"] == 1 and row["tox_score"] > 0.5


def test_toxicity_of_odd_documents(spark, monkeypatch, odd_docs, no_docs):
    docs, labels = labelled(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels + [(5, None), (None, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.train(d, y)
    scored = toxicity.score(odd_docs, model)
    assert scored.count() == odd_docs.count() and scored.columns[:len(odd_docs.columns)] == odd_docs.columns
    assert scored.filter("text is null or trim(text) = ''").filter("tox_score >= 0.5").count() == 0
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.train(d, y.limit(0)).leak == 0.0 and toxicity.train(no_docs, y).leak == 0.0
    assert toxicity.train(d, y.filter("toxic = 1")).leak == 1.0
    broadcast = sorted(map(tuple, toxicity.labelled(d, y).collect()))
    known = {i: max(t for j, t in (*labels, (7, 1), (7, 0)) if j == i) for i, _ in labels}
    assert broadcast == sorted((i, text, known[i]) for i, text in docs if i in known and zlib.crc32(str(i).encode()) % 5)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, toxicity.labelled(d, y).collect())) == broadcast  # met in a shuffle


def unigram(texts, training):
    counts = Counter(w for t in training for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    return {i: (len(words(t)), sum(counts[w] > 0 for w in words(t)),
                sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in texts}, n


@pytest.mark.parametrize("hot,outputs", [(200_000, 1024), (40, 16)])
def test_base_scores_and_learning(spark, monkeypatch, hot, outputs):
    rng = random.Random(8)
    # The second half of each pair of words follows from the first one, which a unigram cannot see.
    texts = [(i, " ".join(f"a{k} B{k}" for k in (rng.randrange(12) for _ in range(rng.randrange(4, 60)))) + f" rare{i}") for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "Unseen words\x0bonly"), (1003, LONG)]
    monkeypatch.setattr(language_model.vocabulary, "__defaults__", (hot, outputs))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    training = docs.filter("doc_id % 10 <> 0")
    want, n = unigram(texts, [t for i, t in texts if i % 10])
    got = {r["doc_id"]: r for r in language_model.score(docs, training).collect()}
    assert len(got) == len(texts)
    for i, (size, known, base) in want.items():
        row = got[i]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (size, known, n) and abs(row["base_score"] - base) < 1e-6 * size
    held = [i for i in want if i % 10 == 0 and i < 1000]
    if outputs > 100:
        assert sum(got[i]["score"] for i in held) > sum(want[i][2] for i in held)


def test_network_gradients_are_right():
    v = language_model.Vocabulary([b"", *(f"w{i}".encode() for i in range(8))], np.arange(20, 2, -2), 200, 20, 9)
    net = language_model.Network.initial(v, hidden=3)
    rng = np.random.default_rng(9)
    net.p = {k: (a + rng.standard_normal(a.shape) * 0.3).astype(np.float64) for k, a in net.p.items()}
    texts = [np.append(rng.integers(1, 10, n), 0).astype(np.int32) for n in (5, 9, 3)]
    (inputs, fresh, targets, real, _), *_ = language_model.windows(texts)
    h = np.zeros((inputs.shape[1], 3))

    def cost():
        states, _ = net.run(inputs, fresh, h)
        keep = real.ravel()
        return -net.log_probabilities(states.reshape(-1, 3)[keep].astype(np.float64), targets.ravel()[keep])[0].mean()

    grad, used, rows, _ = net.gradients(inputs, fresh, targets, real, h)
    grad["table"] = np.zeros_like(net.p["table"])
    grad["table"][used] = rows
    for name, g in grad.items():
        flat = net.p[name].reshape(-1)
        for at in rng.integers(0, flat.size, 6):
            old, step = flat[at], 1e-3
            flat[at] = old + step
            up = cost()
            flat[at] = old - step
            down = cost()
            flat[at] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[at]) < 2e-3, name


def test_probabilities_sum_to_one():
    v = language_model.Vocabulary([b"", *(f"w{i}".encode() for i in range(8))], np.arange(20, 2, -2), 200, 20, 9)
    net = language_model.Network.initial(v, hidden=3)
    states = np.zeros((10, 3), np.float32)
    logs, _ = net.log_probabilities(states, np.arange(10))
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_state_is_carried_over_windows(monkeypatch):
    v = language_model.Vocabulary([b"", b"x", b"y"], np.array([5, 50, 40]), 100, 5, 3)
    net = language_model.Network.initial(v, hidden=4)
    net.p["class_w"] += 0.5
    texts = [np.array([1, 2] * 50 + [0], np.int32), np.array([2, 2, 0], np.int32), np.array([0], np.int32)]
    whole = language_model.text_log10(net, v, texts)
    monkeypatch.setattr(language_model, "WINDOW_TOKENS", 1)
    monkeypatch.setattr(language_model, "SHORTEST", 3)
    assert np.allclose(language_model.text_log10(net, v, texts), whole, atol=1e-5)
