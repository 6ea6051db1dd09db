"""Periodic runs against plain comparison of words."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from galespark.llm import ntt, periodic_runs, queries


def plain_runs(words):
    """(start, length, period) by start, then period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def with_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("block", [2, 4, 8, 64, 128, 256, 512, 4096])
def test_transform_is_exact(block):
    rng = np.random.default_rng(block)
    x, w = rng.integers(-ntt.PRIME // 2, ntt.PRIME // 2, (3, block)), rng.integers(-ntt.PRIME // 2, ntt.PRIME // 2, (3, 2 * block - 1))
    got = ntt.mismatch(x.astype(float), w.astype(float))
    for r in range(3):
        for t in rng.integers(0, block, 5):
            assert (sum((int(a) - int(b)) ** 2 for a, b in zip(x[r], w[r, t:])) - int(got[r, t])) % ntt.PRIME == 0


@pytest.mark.parametrize("seed", range(40))
def test_search_against_plain(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        n, k = rng.choice([0, 1, 11, 12, 13, 24, 60, 150, 400]), rng.choice([1, 2, 2, 3, 5, 50])
        words = [b"%d" % rng.randrange(k) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, n // 3)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts += [words] * rng.randint(1, 2)
    counts, rows, kept = periodic_runs.search(texts)
    at, word = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum([len(t) for t in texts]))
    for i, t in enumerate(texts):
        runs = plain_runs(t)
        assert [tuple(r) for r in rows[at[i] : at[i + 1]].tolist()] == runs
        assert [w for w, k in zip(t, kept[word[i] : word[i + 1]]) if k] == plain_kept(t, runs)


def test_many_periods_at_once():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 1500:
        a, b = b, b + a
    assert [tuple(r) for r in periodic_runs.search([b])[1].tolist()] == plain_runs(b)


def test_long_texts(monkeypatch):
    """One word over and over, a long period, and distances beyond the longest transform."""
    rng = random.Random(1)
    unit = [b"%d" % rng.randrange(1000) for _ in range(9000)]
    assert periodic_runs.search([[b"a"] * 100_000])[1].tolist() == [[0, 100_000, 1]]
    head = [b"x%d" % i for i in range(777)]
    rows = periodic_runs.search([head + unit * 3 + unit[:100]])[1].tolist()
    assert [777, 27_100, 9000] in rows
    monkeypatch.setattr(ntt, "ORDER", 64)
    small = [b"%d" % rng.randrange(30) for _ in range(300)]
    text = head + small * 2 + head[:5] + small[:40] * 3
    assert [tuple(r) for r in periodic_runs.search([text])[1].tolist()] == plain_runs(text)


ODD = [
    (None, "x " * 20), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a"), (4, "a"), (5, "é à " * 9 + "ende"),
    (6, "x\x1cy z " * 8), (7, "A a " * 8), (20, "la " * 40), (35, "one two three four five six seven eight nine ten eleven twelve"),
]


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = with_tail(doc_id, [w.decode() for w in (text or "").encode().split()])
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(plain_kept(words, runs)))]
        out.append((doc_id, len(runs), *four, *digest))
    return out


def result(spark, tmp_path, rows):
    table = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id bigint, text string, words string, g string, runs int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))


def key(row):
    return tuple((x is not None, x) for x in row)


def test_query_on_odd_rows(spark, tmp_path):
    got = result(spark, tmp_path, ODD)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(ODD), key=key)


def test_query_on_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [r for r in rows if len(r[1] or "") < 12_000]
    got = queries.QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001")
    keep = {r[0] for r in rows}
    assert sorted(tuple(r) for r in got.collect() if r.doc_id in keep) == sorted(expected(rows))


def test_empty_table(spark, tmp_path):
    assert result(spark, tmp_path, []).collect() == []
