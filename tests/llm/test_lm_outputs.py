"""Every word whose counts travel has an input and an output of its own, in a class of words as frequent as itself."""

import random
from collections import Counter

import numpy as np

from thermocline.llm import language_model


def test_all_frequent_words_have_outputs(spark):
    assert language_model.HIDDEN >= 16
    rng = random.Random(1)
    texts = [(i, " ".join(f"w{int(3000 * rng.random() ** 2)}" for _ in range(200))) for i in range(60)]
    counts = Counter(w for _, t in texts for w in t.split())
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    v = language_model.vocabulary(language_model.word_counts(docs))
    assert v.outputs == len(v.words) == len(counts) + 1 > 1_600
    net = language_model.Network.initial(v)
    assert len(net.p["table"]) == v.outputs + 1 and len(net.p["word_w"]) == v.outputs and net.classes < 200


def test_words_beyond_the_first_thousand_are_predicted(spark):
    """Pairs of words, 1,500 of them: only who has an output for the second word can learn what the first one says."""
    rng = random.Random(2)
    texts = [(i, " ".join(f"a{k} b{k}" for k in (rng.randrange(1_500) for _ in range(150)))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(1)
    v = language_model.vocabulary(language_model.word_counts(docs))
    net = language_model.train(docs, v)
    used = {w for w, row in zip(v.words, net.p["word_w"]) if np.abs(row).max() > 0}
    assert len(used) > 2_900


def test_classes_cover_the_words_and_probabilities_sum_to_one():
    counts = np.array([50, *(10_000 // k for k in range(1, 3_000))])
    v = language_model.Vocabulary([b"", *(f"w{i}".encode() for i in range(2_999))], counts, int(counts.sum()) + 500, 3_400, 3_000)
    edges = v.edges
    assert edges[0] == 0 and edges[-1] == 3_000 and (np.diff(edges) > 0).all() and np.diff(edges)[-2] > 4 * np.diff(edges)[0]
    net = language_model.Network.initial(v)
    net.p = {k: a + np.random.default_rng(3).standard_normal(a.shape).astype(np.float32) * 0.1 for k, a in net.p.items()}
    logs, _ = net.log_probabilities(np.tile(np.linspace(-1, 1, 16, dtype=np.float32), (3_001, 1)), np.arange(3_001))
    assert abs(np.exp(logs.astype(np.float64)).sum() - 1) < 1e-3


def test_odd_tables_and_repeated_rows(spark, odd_docs, no_docs):
    """A row per row, also for repeated ids and texts; empty tables; columns with names used inside."""
    training = odd_docs.filter("doc_id < 5")
    got = language_model.score(odd_docs, training).toPandas()
    assert len(got) == 9 and got["score"].notna().all() and (got["n_tokens"] >= 1).all() and got["doc_id"].isna().sum() == 1
    assert (got.groupby("text_hash")["score"].nunique() == 1).all() and (got[got.doc_id == 4]["n_tokens"] == 12_001).all()
    assert language_model.score(no_docs, training).count() == 0
    alone = language_model.score(odd_docs, no_docs).toPandas()
    assert len(alone) == 9 and (alone["n_known"] == 0).all() and (alone["train_tokens"] == 0).all()


def test_pieces_step_as_whole_gradients_do():
    """Weights that step piece by piece end where one step with the whole gradient brings them."""
    rng = np.random.default_rng(4)
    counts = np.array([90, *(5_000 // k for k in range(1, 400))])
    v = language_model.Vocabulary([b"", *(f"w{i}".encode() for i in range(399))], counts, int(counts.sum()), 400, 400)
    one, two = language_model.Network.initial(v), language_model.Network.initial(v)
    texts = [np.append(rng.integers(1, 400, n), 0).astype(np.int32) for n in (50, 90, 31, 7)]
    memory = {k: np.zeros_like(a) for k, a in one.p.items()}
    language_model.fit(one, texts, memory)
    assert len(list(language_model.windows(texts, language_model.LONGEST))) == 1
    (inputs, fresh, targets, real, _), = language_model.windows(texts, language_model.LONGEST)
    grad, used, rows, _ = two.gradients(inputs, fresh, targets, real, np.zeros((inputs.shape[1], language_model.HIDDEN), np.float32),
                                        1.0 / language_model.WINDOW_TOKENS)
    for k, g in grad.items():
        two.p[k] -= language_model.FIRST_RATE * g / np.sqrt(g * g + language_model.FLAT)
    two.p["table"][used] -= language_model.FIRST_RATE * rows / np.sqrt(rows * rows + language_model.FLAT)
    assert all(np.allclose(one.p[k], two.p[k], atol=1e-5) for k in one.p)


def many_words(n: int) -> language_model.Vocabulary:
    counts = np.array([n, *(10 * n // k for k in range(1, n))])
    return language_model.Vocabulary([b"", *(f"w{i}".encode() for i in range(n - 1))], counts, int(counts.sum()) + 500, n + 400, n)


def test_a_word_meets_few_others():
    """A target costs and moves its part of a class, at most 16 words, not the whole class; every level starts at the counts."""
    v = many_words(20_000)
    net = language_model.Network.initial(v)
    start = net.p["word_b"].copy()
    words = np.array([3, 700, 5_000, 12_000, 19_990], np.int32)
    logs, _ = net.log_probabilities(np.zeros((len(words), 16), np.float32), words)
    shares = (v.counts[words] + 0.1) / (v.counts.sum() + 20_000 * 0.1 + v.rare_total)
    assert np.allclose(logs, np.log(shares), atol=1e-4)
    language_model.fit(net, [np.append(words, 0).astype(np.int32)], {k: np.zeros_like(a) for k, a in net.p.items()})
    moved = np.flatnonzero(net.p["word_b"] != start)
    assert set(words[1:]) <= set(moved) and len(moved) <= 16 * (len(words) + 1)
    sizes = np.diff(net.edges)
    assert sizes.max() > 400 and np.diff(net.parts).max() == 16 and set(net.edges) <= set(net.parts)


def test_learning_in_stacks_equals_whole_gradients():
    """Parts met once, often, whole and cut short: what is learned piece by piece is the gradient of all."""
    v, rng = many_words(900), np.random.default_rng(6)
    net = language_model.Network.initial(v)
    net.p = {k: a + rng.standard_normal(a.shape).astype(np.float32) * 0.2 for k, a in net.p.items()}
    targets = np.concatenate([rng.integers(0, 901, 700), np.full(300, 5), np.full(37, 899)]).astype(np.int32)
    states, whole, pieces = rng.uniform(-1, 1, (len(targets), 16)).astype(np.float32), {}, {k: np.zeros_like(a) for k, a in net.p.items()}
    logs, back = net.log_probabilities(states, targets, whole)

    def learn(name, place, g):
        (language_model._runs(pieces[name]) if g.ndim > pieces[name].ndim else pieces[name])[place] += g

    again, also = net.log_probabilities(states, targets, scale=1.0, learn=learn)
    assert np.allclose(logs, again) and np.allclose(back, also, atol=1e-5) and all(np.allclose(whole[k], pieces[k], atol=1e-4) for k in whole)
    for i in (0, 350, 800, 1_036):
        every, _ = net.log_probabilities(np.repeat(states[i:i + 1], 901, axis=0), np.arange(901, dtype=np.int32))
        assert abs(np.exp(every.astype(np.float64)).sum() - 1) < 1e-3 and abs(every[targets[i]] - logs[i]) < 1e-4
    step = 1e-2  # by the state, against differences
    for i in (1, 702, 1_030):
        for k in (0, 9):
            up, down = states[i:i + 1].copy(), states[i:i + 1].copy()
            up[0, k], down[0, k] = up[0, k] + step, down[0, k] - step
            slope = (net.log_probabilities(down, targets[i:i + 1])[0] - net.log_probabilities(up, targets[i:i + 1])[0]) / (2 * step)
            assert abs(slope[0] - back[i, k]) < 5e-3


def test_sums_and_order():
    rng = np.random.default_rng(7)
    words = np.concatenate([rng.integers(0, 90, 300), np.full(70, 4)]).astype(np.int32)
    values = rng.standard_normal((len(words), 5)).astype(np.float32)
    order = language_model._order(words)
    assert (order == np.argsort(words, kind="stable")).all()
    used, starts = np.unique(words[order], return_index=True)
    assert np.allclose(language_model._sums(values, order, starts), [values[words == w].sum(axis=0) for w in used], atol=1e-4)


def test_changes_are_packed_without_loss():
    rng = np.random.default_rng(8)
    values = (rng.standard_normal(8_192) * 0.1).astype(np.float16)
    values[100:3_000] = 0
    packed = language_model._packed(values)
    assert (language_model._unpacked(packed, len(values)) == values).all() and len(packed) < 0.95 * 2 * (len(values) - 2_900)
    assert (language_model._unpacked(language_model._packed(values[:3]), 3) == values[:3]).all()
