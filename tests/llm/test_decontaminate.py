"""Benchmark passages against brute force, and the index against plain counts."""

import hashlib
import random
import re

import numpy as np
import pytest

from galespark.llm import decontaminate, fm_index, queries

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(doc, items):
    hit, found = [False] * len(doc), set()
    for name, item in items:
        k = min(10, len(item))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        for i in range(len(doc) - k + 1):
            if tuple(doc[i : i + k]) in windows:
                found.add(name)
                hit[i : i + k] = [True] * k
    return hit, found - {None}


def test_suffix_order_and_ranks():
    rng = random.Random(1)
    for _ in range(60):
        v = rng.choice([1, 2, 5, 300])
        text = np.array([rng.randint(0, v) if rng.random() < 0.9 else 0 for _ in range(rng.randint(0, 200))] * rng.randint(1, 2) + [0])
        zeros = np.cumsum(text == 0)
        full = [int(c) + len(text) if c else int(z) for c, z in zip(text, zeros)]
        order = fm_index.suffix_order(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: full[i:])
        index = fm_index.Index(text, v)
        assert np.array_equal(index.locate(np.arange(len(text))), order)
        at, symbol = np.arange(len(text) + 1), rng.randint(0, v)
        before = text[order - 1]
        assert index.ranks.rank(np.full(len(at), symbol), at).tolist() == np.append(0, np.cumsum(before == symbol)).tolist()
        assert [x.tolist() for x in index.ranks.symbol_and_rank(at[:-1])] == [before.tolist(), [int((before[:i] == s).sum()) for i, s in enumerate(before)]]


@pytest.mark.parametrize("seed", range(30))
def test_search_against_plain(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(5):
        monkeypatch.setattr(decontaminate, "SHARD", rng.choice([1 << 20, 25, 60]))
        words = [f"w{i}" for i in range(rng.choice([2, 3, 10, 40]))]
        items = [(rng.choice([None, *"0123"]), rng.choices(words, k=rng.choice([1, 3, 9, 10, 11, 30]))) for _ in range(rng.randint(0, 10))]
        docs = []
        for _ in range(rng.randint(1, 8)):
            d = rng.choices([*words, "foreign"], k=rng.choice([0, 1, 5, 40, 200]))
            if items and rng.random() < 0.7:
                a = rng.randint(0, len(d))
                d[a:a] = rng.choice(items)[1][rng.randint(0, 3) :]
            docs += [d] * rng.randint(1, 2)
        phrases = decontaminate.Phrases.of(*map(list, zip(*items))) if items else decontaminate.Phrases([], {}, [])
        spans, pairs = decontaminate.search([decontaminate.numbered(" ".join(d).encode(), phrases.numbers) for d in docs], phrases)
        for t, d in enumerate(docs):
            hit, found = plain(d, items)
            mine = spans[spans[:, 0] == t, 1:].tolist()
            assert [any(s <= i < e for s, e in mine) for i in range(len(d))] == hit
            assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
            assert {phrases.names[i] for _, i in pairs[pairs[:, 0] == t]} == found


LONG = " ".join(f"t{i}" for i in range(40))
ITEMS = [
    (1, LONG), (10, "short item"), (2, None), (3, ""), (4, "?!"), (5, "t5 T6 t7 t8 t9 t10 t11 t12 t13 t14"), (5, "École à 1 2 3 4 5 6 7 8 9"),
    (None, "nameless passage"), (6, " ".join(f"u{i}" for i in range(2500))), (6, " ".join(f"u{i}" for i in range(2500))),
]
DOCS = [
    (1, None), (2, ""), (3, " .\n"), (4, "t5-t6, T7 t8 t9 t10 t11 t12 t13 t14 t16"), (4, "t5-t6, T7 t8 t9 t10 t11 t12 t13 t14 t16"),
    (None, "a Short  ITEM, a nameless passage"), (6, "école à 1 2 3 4 5 6 7 8 9"), (7, "École à 1 2 3 4 5 6 7 8 9"), (8, "clean " * 30_000 + LONG + " x"),
    (9, " ".join(f"u{i}" for i in range(990, 1020)) + " and " + " ".join(f"u{i}" for i in range(2490, 2500))), (11, "short " * 9),
]


def expected(docs, items):
    items = [(None if i is None else str(i), words_of(t)) for i, t in items]
    out = []
    for i, t in docs:
        hit, found = plain(words_of(t), items)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(hit), sum(hit), len(found), digest, any(hit)))
    return sorted(out, key=str)


def written(spark, path, docs, items):
    spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id bigint, text string, spans string, items int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t, "a") for i, t in items], "item_id bigint, text string, words string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("block", [1 << 18, 700])
def test_query_on_odd_rows(spark, tmp_path, monkeypatch, block):
    """With the benchmark in one block and in several."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    got = queries.QUERIES["op13_decontaminate"](spark, written(spark, tmp_path, DOCS, ITEMS))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(DOCS, ITEMS)


@pytest.mark.parametrize("docs,items", [([], ITEMS), (DOCS[:6], []), (DOCS[:6], [(1, None), (2, ".")]), ([], [])])
def test_empty_tables(spark, tmp_path, docs, items):
    got = queries.QUERIES["op13_decontaminate"](spark, written(spark, tmp_path, docs, items))
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op13_decontaminate"](spark, sf).collect()), key=str)
    assert got == expected(docs, items) and any(r[-1] for r in got)
