"""Exact, near and embedding dedup against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from galespark.llm import embed_dedup, exact_dedup, simhash
from galespark.llm.components import components

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, id int, locator string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1, "y") for i, t in rows], DOC)


ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "Word"), (5, "wORD"), (6, "École"), (7, "école"), (7, "école"), (None, "word"), (8, "a " * 30_000),
    (9, "A " * 30_000), (10, "x" * 200_000),
]


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def exact_expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    return sorted(
        (
            (i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest())
            for t, g in groups.items() for i in g
        ),
        key=str,
    )


def test_exact_odd_rows(spark):
    got = exact_dedup.dedup(docs(spark, ODD)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=str) == exact_expected(ODD)
    kept = [r.digest for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({fold(t) for _, t in ODD})


def test_exact_empty(spark):
    assert exact_dedup.dedup(docs(spark, ODD).limit(0)).collect() == []
    assert exact_dedup.keep_one(docs(spark, ODD).limit(0)).collect() == []


def test_exact_compares_texts_when_digests_clash(spark):
    weak = lambda t: F.length(t).cast("string")
    rows = [(i, random.Random(i // 2).choice(["aa", "bb", "cc", "A", "b", "ccc"])) for i in range(60)]
    got = exact_dedup.dedup(docs(spark, rows), digest=weak).collect()
    want = {i: (k, n) for i, k, n, _ in exact_expected(rows)}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert {r.doc_id for r in got if r.kept} == {k for k, _ in want.values()}


def test_exact_state_outlives_the_stream(spark, tmp_path):
    for part, rows in enumerate([[(1, "a"), (2, "b")], [(5, "A"), (3, "c")], [(4, "a")]]):
        exact_dedup.events(docs(spark, rows)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("doc_id bigint, digest string, locator bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        exact_dedup.track(stream, f"{tmp_path}/state", f"{tmp_path}/out")
    state = {r.digest: (r.keep_id, r.group_size) for r in exact_dedup.state_of(spark, f"{tmp_path}/out").collect()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in "abc"}
    assert state == {sha["a"]: (5, 3), sha["b"]: (2, 1), sha["c"]: (3, 1)}


def test_exact_keep_one(spark):
    out = exact_dedup.keep_one(docs(spark, ODD))
    assert out.columns == docs(spark, ODD).columns
    assert sorted(fold(r.text) for r in out.collect()) == sorted({fold(t) for _, t in ODD})


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(n, pairs):
    at = list(range(n))
    def find(x):
        while at[x] != x:
            x = at[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return [find(x) for x in range(n)]


def simhash_expected(rows):
    fp = [print_of(t) for _, t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    root = closure(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fp, root)), key=str)


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == simhash_expected(ODD)
    assert simhash.near_duplicates(docs(spark, ODD).limit(0)).collect() == []


def test_simhash_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = simhash.near_duplicates(table).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == simhash_expected(rows)


def drawn_codes(rng, n):
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("n, max_node", [(700, 4096), (600, 60)])
def test_simhash_links_are_complete(spark, n, max_node):
    codes = drawn_codes(random.Random(n + max_node), n)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in codes]
    edges = simhash.link_edges(spark.createDataFrame([(x,) for x in signed], "fp bigint"), max_node=max_node).collect()
    at = {x: i for i, x in enumerate(signed)}
    got = closure(n, [(at[r.a], at[r.b]) for r in edges])
    want = closure(n, [(a, b) for a, b in itertools.combinations(range(n), 2) if (codes[a] ^ codes[b]).bit_count() <= 4])
    assert got == want


def test_simhash_keeps_one_of_a_group(spark):
    rows = [(1, "a b c d e"), (2, "A B c d e"), (3, "quite another text here"), (None, "a b c d e")]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs(spark, rows)).collect()) == ["1", "3"]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    order = list(range(1, 60))
    rng.shuffle(order)
    path = list(zip(order, order[1:]))
    star = [(1000, 1000 + i) for i in range(1, 400)] + [(5000 - i, 5000) for i in range(1, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(path + star + [(7, 7)], "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in order)
    assert all(got[1000 + i] == 1000 for i in range(400)) and all(got[5000 - i] == 4801 for i in range(200))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


VEC = "vec_id bigint, embedding array<float>, label int, id int, weight string, n_links int"


def cosine_expected(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    vs = [np.array(v, np.float32).astype(float) if g else None for g, (_, v) in zip(ok, rows)]
    near = lambda a, b: ok[a] and ok[b] and len(vs[a]) == len(vs[b]) and vs[a] @ vs[b] / math.sqrt(vs[a] @ vs[a] * (vs[b] @ vs[b])) >= 0.9
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if near(a, b)]
    root, n = closure(len(rows), pairs), [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return sorted((i, k, least[r], i == least[r]) for (i, _), k, r in zip(rows, n, root))


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[rng.integers(12)] * rng.uniform(0.5, 2) + rng.standard_normal(24) * 0.12).tolist()) for i in range(260)]
    rows += [(300 + i, rows[3][1]) for i in range(70)] + [(400, None), (401, []), (402, [0.0] * 24), (403, [1.0, None]), (404, [float("nan")] * 24)]
    rows += [(405, [float("inf")] * 24), (406, [1.0, 0.0]), (407, [3.0, 0.0]), (408, rows[5][1]), (408, rows[5][1])]
    table = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], VEC)
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(table, block=block).collect())
    assert got == cosine_expected(rows)


def test_embedding_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(table).collect())
    assert got == cosine_expected([(r.vec_id, r.embedding) for r in table.collect()])
    assert embed_dedup.near_duplicates(table.limit(0)).collect() == []
