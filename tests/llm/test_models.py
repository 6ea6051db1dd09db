"""Language identification, quality, language model: odd rows, held-out accuracy, plain recomputation."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from galespark.llm import elias_fano, langid, lm, quality
from galespark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, lang_score string"
ODD = [None, "", "  \n", "123 456 !!", "the and of", "der die und " * 40_000, "é", "中文", "the and of", "\x00 x"]


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang and lang[i], "s", 1, 0.5, "x", "y") for i, t in enumerate(texts)], DOC)


def test_language_held_out(spark):
    rows = QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == 1000
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98 and not any(r.rejected for r in rows)


def test_language_odd_rows(spark):
    table = docs(spark, ODD)
    model = langid.learn(docs(spark, ["the and of to in", "der die und das", "les des que et"] * 5, ["en", "de", "fr"] * 5))
    out = langid.identify(table, model)
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in range(len(ODD))][:6] == ["und"] * 4 + ["en", "de"]
    assert all(got[i].lang_rejected and got[i].lang_score == 0 for i in range(4)) and got[7].lang_pred != "und" and got[7].lang_rejected
    assert not got[4].lang_rejected and got[4].lang_score == got[8].lang_score
    nothing = langid.learn(table)
    assert {r.lang_pred for r in langid.identify(table, nothing).collect()} == {"und"}
    assert langid.identify(table.limit(0), model).collect() == []


def test_language_rejects_what_it_has_not_learned(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n)) for n in (300, 1000, 4000) for _ in range(20)]
    noise += ["".join(rng.choice("\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438 ") for _ in range(1000))]
    drawn = spark.createDataFrame([(i, t, None) for i, t in enumerate(noise)], table.schema)
    assert all(r.lang_rejected for r in langid.identify(drawn, langid.learn(table)).collect())
    for left in ("de", "es", "fr"):
        out = langid.identify(table, langid.learn(table.filter(f"lang <> '{left}'"))).collect()
        of = [r.lang_rejected for r in out if r.lang == left and len(set(r.text.split())) > 30]
        kept = [r.lang_rejected for r in out if r.lang != left]
        assert len(of) > 20 and np.mean(of) > 0.9 and np.mean(kept) < 0.005, (left, np.mean(of), np.mean(kept))


def test_quality_held_out(spark):
    rows = QUERIES["op1_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and np.mean(np.array(good) >= 0.3) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (8, 1), (9, None), (None, 1), (77, 1)], "doc_id bigint, quality int")
    table = docs(spark, ODD)
    model = quality.learn(table, labels)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert len(got) == len(ODD) and got[0] == got[1] == pytest.approx(model.labels.mean()) and got[4] == got[8]
    assert {r.score for r in quality.score(table, quality.learn(table, labels.limit(0))).collect()} == {0.5}
    assert quality.score(table.limit(0), model).collect() == []


def batches(model, texts, size):
    """Scores of ``texts`` by a language or quality model, so many at a time."""
    got = [model(texts[i : i + size]) for i in range(0, len(texts), size)]
    return [x for g in got for x in (zip(g[0], g[1].tolist(), g[2].tolist()) if isinstance(g, tuple) else g.tolist())]


def some_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts = [t[:3000] for t in texts if t]
    return [*texts, *ODD, *texts[::-1]]


@pytest.fixture(scope="module")
def models(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = table.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) as quality")
    return {"language": langid.learn(table), "quality": quality.learn(table, labels, size=150)}


@pytest.mark.parametrize("kind", ["language", "quality"])
def test_equal_texts_have_equal_scores_in_any_batch(spark, models, kind):
    texts = some_texts(spark)
    want = batches(models[kind], texts, 128)
    assert all(batches(models[kind], texts, size) == want for size in (1, 7, len(texts)))
    of = {}
    assert all(of.setdefault(t, x) == x for t, x in zip(texts, want))


def unit(row):
    size = math.sqrt(math.fsum(x * x for x in row))
    return [x / size for x in row] if size else list(row)


def dot(a, b):
    return math.fsum(x * y for x, y in zip(a, b))


def test_language_by_plain_loops(spark, models):
    model = models["language"]
    texts = [t for t in some_texts(spark)[::9] if langid.has_letter(t)]
    for text, name, score, least in zip(texts, *model(texts)):
        counts = langid.count(text).tolist()
        x = unit([math.log1p(c) * w for c, w in zip(counts, model.idf.tolist())])
        near = [dot(x, c) for c in model.centroids.tolist()]
        best = max(range(len(near)), key=near.__getitem__)
        enough = min(1, sum(c > 0 for c in counts) / langid.ENOUGH)
        assert name == model.languages[model.owner[best]] and score == pytest.approx(near[best], abs=1e-6)
        assert least == pytest.approx(model.least[model.owner[best]] * enough, abs=1e-9)


def test_vote_by_plain_loops(spark, models):
    model = models["quality"]
    points, labels = model.points.tolist(), model.labels.tolist()
    texts = some_texts(spark)[::7]
    for text, score in zip(texts, model(texts)):
        x = unit((quality.weighted(quality.count(text)[None], model.idf)[0] @ model.axes.T).tolist())
        near = sorted(((-dot(x, p), i) for i, p in enumerate(points)))[: model.k]
        weight = [(max(0, -s), labels[i]) for s, i in near]
        total = sum(w for w, _ in weight)
        want = sum(w * v for w, v in weight) / total if total else sum(labels) / len(labels)
        assert score == pytest.approx(want, abs=1e-6)


def test_nearest_takes_the_first_of_ties():
    got = quality.nearest(np.array([[0.5, 0.7, 0.5, 0.5, 0.1], [0.0, 0.0, 0.0, 0.0, 0.0]]), 3)
    assert got.tolist() == [[True, True, True, False, False], [True, True, True, False, False]]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1, 2**63), (5, 3), (4000, 10**6), (3000, 2**62), (2000, 50)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        head, low, high = elias_fano.Sequence.encode(v)
        s = elias_fano.Sequence(int(head[0]), int(head[1]), low, high)
        assert (s[np.arange(n)] == v).all()
        x = np.concatenate([v, v + np.uint64(1), rng.integers(0, top, 50, dtype=np.uint64), np.array([0, 2**63 - 1], np.uint64)])
        assert (s.successor(x) == np.searchsorted(v, x)).all()
        assert (np.where(np.isin(x, v), np.searchsorted(v, x), -1) == s.find(x)).all()


def test_trie():
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(30) * 1000, rng.randrange(200)) for _ in range(900)})
    p = np.array([rng.uniform(1e-6, 1) for _ in pairs])
    trie = elias_fano.Trie(elias_fano.write_trie(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), p))
    want = dict(zip(pairs, p))
    asked = [(a * 1000, b) for a in range(-1 + 1, 31) for b in range(0, 210, 3)]
    got = trie.lookup(np.array([a for a, _ in asked]), np.array([b for _, b in asked]))
    for q, g in zip(asked, got):
        assert (g == 0) == (q not in want) and (g == 0 or abs(math.log10(g / want[q])) < 0.003)


def tokens(text):
    return (text or "").encode().lower().split() + [None]


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_scores_equal_plain_computation(spark, size):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = ODD + [r.text for r in table.collect()]
    rows = list(enumerate(texts))
    train = [t for i, t in rows if i % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    every = docs(spark, texts).repartition(5)
    voc, model = lm.learn(every.filter("doc_id % 7 <> 2"), size=size)
    numbered = {w for w in c if w is None or voc.number(w) >= 0}
    assert len(numbered) <= size + 1
    pairs, begin = Counter(), object()
    for t in train:
        x = [begin, *tokens(t)]
        pairs.update((a, b) for a, b in zip(x, x[1:]) if (a is begin or a in numbered) and b in numbered)
    kept = {k: m for k, m in pairs.items() if m >= lm.MIN_COUNT}
    count = lambda w: len(train) if w is begin else c[w]
    mass = Counter()
    for (a, _), m in kept.items():
        mass[a] += (m - lm.DISCOUNT) / count(a)
    other = (n - sum(c[w] for w in numbered) + 1) / (n + 1) / (v - len(numbered) + 1)
    uni = lambda w: c[w] / (n + 1) if w in numbered else other
    got = {r.doc_id: r for r in lm.score(every, voc, model).collect()}
    assert len(got) == len(rows) == every.count()
    for i, t in rows:
        x = [begin, *tokens(t)]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x[1:])
        score = sum(
            math.log10((kept[a, b] - lm.DISCOUNT) / count(a) * ((a, b) in kept) + (1 - mass[a]) * uni(b)) if (a, b) in kept
            else math.log10((1 - mass[a]) * uni(b)) for a, b in zip(x, x[1:])
        )
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x) - 1, sum(c[w] > 0 for w in x[1:]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) <= 0.003 * len(x)


def test_scores_do_not_depend_on_which_words_have_numbers(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every = docs(spark, ODD + [r.text for r in table.collect()] + ["never seen words", "der unseen und"]).repartition(5)
    train = every.filter("doc_id % 7 <> 2")
    (voc, model), (few, others) = lm.learn(train), lm.learn(train, numbered=40)
    assert len(few.hashes) <= 40 < len(voc.hashes)
    want, got = ({r.doc_id: r for r in lm.score(every, *m).collect()} for m in ((voc, model), (few, others)))
    assert len(want) == len(got) == every.count()
    for i, r in want.items():
        assert got[i][:4] == r[:4]
        assert got[i].base_score == pytest.approx(r.base_score, rel=1e-9) and got[i].score == pytest.approx(r.score, rel=1e-5)


def test_pair_seen_once_is_kept(spark):
    table = docs(spark, ["a b", "a c", "d b", "b"])
    voc, model = lm.learn(table.filter("doc_id < 3"))
    got = {r.doc_id: r.score for r in lm.score(table, voc, model).collect()}
    # counts: a 2, b 2, c 1, d 1, begin and end 3; N = 9; the pairs of (begin, a) and (b, end) are seen twice
    n = 10
    after_begin = (2 - 0.75) / 3 + (1 - (1.25 + 0.25) / 3) * 2 / n
    b_after_a, end_after_b = 0.25 / 2 + (1 - 0.5 / 2) * 2 / n, 1.25 / 2 + (1 - 1.25 / 2) * 3 / n
    assert abs(got[0] - math.log10(after_begin * b_after_a * end_after_b)) < 0.01
    assert abs(got[3] - math.log10((1 - 1.5 / 3) * 2 / n * end_after_b)) < 0.01


def test_model_of_nothing(spark):
    table = docs(spark, ODD)
    voc, model = lm.learn(table.limit(0))
    rows = lm.score(table, voc, model).collect()
    assert len(rows) == len(ODD) and all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in rows)
    voc, model = lm.learn(table)
    assert lm.score(table.limit(0), voc, model).collect() == []
