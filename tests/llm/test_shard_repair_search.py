"""Sharding, conversation repair and lexical search against their SQL on odd tables and against plain Python."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from thermocline.llm import conversation_repair as repair
from thermocline.llm import lexical_search as lexical
from thermocline.llm import sharding
from thermocline.llm.common import free_name
from thermocline.llm.queries import QUERIES, SQL
from tools.compare import same


def over(monkeypatch, spark, name, **tables):
    """The query and its SQL over given tables."""
    query = QUERIES[name]
    monkeypatch.setitem(query.__globals__, "table", lambda _s, _d, t: tables[t])
    duck = duckdb.connect()
    for t, df in tables.items():
        duck.register(t, df.toArrow())
    return query(spark, "").toPandas(), duck.execute(SQL[name]).df()


# Sharding

def test_shards_of_odd_documents(monkeypatch, spark, odd_docs):
    got, wanted = over(monkeypatch, spark, "op11_sharding", documents=odd_docs)
    assert same(got, wanted) is None and len(got) == 9
    assert sorted(got["size"])[:2] == [1, 1]  # null and empty


def test_shards_keep_columns_of_their_names(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s", 1, 2, 3, 4) for i in range(50)],
                                 "doc_id long, text string, shard string, Size int, ident int, arc int, number int")
    placed = sharding.place(docs)
    assert placed.columns == [*docs.columns, "_size", "text_crc32", "_shard", "slot"]
    assert placed.select(*docs.columns).exceptAll(docs).count() == 0 and placed.count() == 50
    assert free_name(["A", "_a"], "a") == "__a"


def test_hot_ids_are_spread(monkeypatch, spark):
    """A third of the rows repeat id and text; numbering in parts, joins shuffled."""
    rows = [(7, "the same again")] * 900 + [(None, None)] * 300 + [(i, f"document {i} " * (i % 9 + 1)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for limit in (sharding.BROADCAST_ROWS, 0):
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", limit)
        got, wanted = over(monkeypatch, spark, "op11_sharding", documents=docs)
        assert same(got, wanted) is None
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() <= loads.mean() + got["size"].max() * 3 and len(loads) == 16
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert got[got.doc_id == 7].shard.nunique() > 1


def test_more_shards_move_few(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    few = sharding.place(docs, shards=4, excess=0.25, keep=["doc_id"]).toPandas().set_index("doc_id")["shard"].sort_index()
    more = sharding.place(docs, shards=5, excess=0.25, keep=["doc_id"]).toPandas().set_index("doc_id")["shard"].sort_index()
    assert (few != more).mean() < 0.45  # a hash modulo the number of shards moves 0.8
    around = sharding.ring(4, 16)
    assert set(around) < set(sharding.ring(5, 16))


def test_place_on_the_ring(spark):
    around = sharding.ring(3, 8)
    places = [0, 1, around[0][0], around[0][0] + 1, around[-1][0], around[-1][0] + 1, (1 << 52) - 1] + [random.Random(1).randrange(1 << 52) for _ in range(200)]
    got = spark.createDataFrame([(p,) for p in places], "p long").select("p", sharding._arc(F.col("p"), around).alias("arc")).collect()
    assert all(r["arc"] == sum(q < r["p"] for q, _ in around) % len(around) for r in got)


def test_shards_written(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


def test_no_documents(spark, no_docs):
    assert sharding.place(no_docs, keep=["doc_id"]).count() == 0
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert lexical.search(no_docs, items).count() == 0


# Conversation repair

def cheapest(rows):
    """All edit sequences of one conversation by plain search: cost, audit and repaired lines."""
    seen, faults = set(), []
    for role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    inserts = [(), ("user",), ("assistant",), ("assistant", "user"), ("user", "assistant")]
    choices = []
    for (role, text), fault in zip(rows, faults):
        extra = 5 if fault == "truncated" else 0
        row = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            row += [(extra, "K", (role, text)), *[(1 + extra, "R", (r, text)) for r in ("user", "assistant")]]
        choices.append(row)
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        if sum(map(len, gaps)) > 2:
            continue
        for picks in itertools.product(*choices):
            lines, audit, cost = [], "", 0
            for i, gap in enumerate(gaps):
                for role in gap:
                    lines, audit, cost = [*lines, (role, "")], audit + "I", cost + 5
                if i < len(rows):
                    more, letter, line = picks[i]
                    audit, cost = audit + letter, cost + more
                    lines = [*lines, line] if line else lines
            if best and (cost, audit) >= best[:2]:
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return (*best, *[faults.count(f) for f in ("blank", "duplicate", "truncated")])


def test_repairs_are_the_cheapest(spark):
    r = random.Random(4)
    texts = ["Yes.", "No!", "what", " ", "", "and then", "So?", "end.  \n"]
    convs = {c: [(r.choice(["user", "assistant", "system", "tool", "user", "assistant"]), r.choice(texts)) for _ in range(r.randint(1, 4))] for c in range(60)}
    rows = [(c, t, role, text) for c, lines in convs.items() for t, (role, text) in enumerate(lines)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for row in repair.repair(df).collect():
        assert (row["cost"], row["audit"], row["repaired_sha256"], row["blank"], row["duplicate"], row["truncated"]) == cheapest(convs[row["conv_id"]])


ODD = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be kind."), (None, 1, "user", "Who?"),
       (None, 2, "assistant", "Me."), (None, None, None, None), (2, None, None, "x"), (3, 5, "user", ""), (3, 9, "", "Empty role."),
       (4, 1, "assistant", "First."), (4, 1, "user", "Same turn."), (5, 1, "user", "long " * 30_000 + "."), (5, 2, "assistant", "é́ ü 中文。"),
       (6, 3, "user", "Tab\t.\n\n "), (6, 3, "user", "Tab\t.\n\n ")]
CONVS = "conv_id long, turn long, role string, text string, audit string, seen int, word string"


def test_odd_conversations(monkeypatch, spark):
    r = random.Random(9)
    more = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["A.", "B", "C!", "", "D?"])) for c in range(10, 80) for t in range(r.randint(1, 9))]
    df = spark.createDataFrame([(*row, "w", 1, "x") for row in ODD + more], CONVS)
    got, wanted = over(monkeypatch, spark, "op12_conversation_repair", conversations=df)
    assert same(got, wanted) is None and got["conv_id"].isna().sum() == 1
    assert repair.repair(df.limit(0)).count() == 0


def test_long_conversation_in_pieces(spark):
    """A conversation with most of the rows: the same word whatever the pieces, and a legal repair."""
    r = random.Random(2)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "no"]) + f" {t}" * (t % 3) + r.choice([".", "", "!"])) for t in range(5000)]
    rows += [(c, t, "user", "Hi.") for c in range(2, 40) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = (sorted(map(tuple, repair.words(repair._plain(df), piece=n).collect())) for n in (1 << 16, 7))
    assert whole == cut and len(whole[0][1]) == 5000
    fixed = [x["role"][0] for x in repair.repaired_rows(df).filter("conv_id = 1").orderBy("place").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(fixed)) and len(fixed) > 1000
    audit = repair.planned(repair._plain(df)).filter("conv_id = 1").first()["audit"]
    assert len(audit) - audit.count("I") == 5000 and len(audit) - audit.count("D") == len(fixed)


def test_words_that_end_alike_share_nodes():
    import pyarrow as pa

    words = ["E", "AE", "EI", "IEI", "EIEI", "BEIEI", "HEIEI"]
    batch = pa.record_batch([pa.array(sorted(words, key=lambda w: w[::-1]))], ["word"])
    alone = {w: next(repair._solver(iter([pa.record_batch([pa.array([w])], ["word"])]))).to_pylist()[0] for w in words}
    for row in next(repair._solver(iter([batch]))).to_pylist():
        assert row == alone[row["word"]]


# Lexical search

def brute(docs, items, k):
    """All scores of all pairs in plain Python."""
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    terms = [(i, cut(t)) for i, t in docs if cut(t)]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, ts in terms:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, ts in terms:
            m = 10 + 90 * len(ts) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) * (10 ** 9 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in set(cut(text)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"block_postings": 40}, {"item_bytes": 1}, {"k": 3, "block_postings": 1}])
def test_search_equals_all_scores(spark, settings):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Émile", "naïve", "X1", "中文"]
    text = lambda n: " ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n)) + r.choice(["", ".", "!"])
    docs = [(i, text(r.randint(1, 60))) for i in range(120)] + [(500 + i, "w1 w5 copied text") for i in range(30)]
    docs += [(3, text(5)), (3, text(5)), (None, "w1 w5 copied text"), (None, text(9)), (900, None), (901, ""), (902, "--- ..."), (903, "w39 " * 9000)]
    items = [(1, text(8)), (2, "w5 copied"), (2, "w7 other words of a repeated item"), (3, None), (4, ""), (None, "W39 NAÏVE Émile"), (5, "unknown")]
    r.shuffle(docs)
    d = spark.createDataFrame([(*x, 1.0, "t") for x in docs], "doc_id long, text string, score double, terms string").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = [tuple(x) for x in lexical.search(d, q, **settings).collect()]
    assert sorted(got, key=str) == brute(docs, items, settings.get("k", 10))


def test_search_same_as_sql_on_odd_tables(monkeypatch, spark, odd_docs):
    items = spark.createDataFrame([(1, "the quick brown fox"), (1, "alpha id text"), (None, "here"), (2, None)], "item_id long, text string")
    got, wanted = over(monkeypatch, spark, "op13_lexical_search", documents=odd_docs, benchmark=items)
    assert same(got, wanted) is None and len(got)
