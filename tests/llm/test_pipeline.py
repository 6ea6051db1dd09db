"""The pipeline against its stages done by hand, and odd rows through every stage."""

import numpy as np
import public_tokenizers
from test_dedup import closure, fold, print_of
from test_secrets import expected
from tokenizers import Tokenizer

import corpus_pipeline
from galespark.llm import exact_dedup, secret_scan, simhash

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def marked(text):
    parts = sorted(tuple(map(int, s.split(":")[1:])) for s in expected(text)[4].split(",") if s)
    out, at = "", 0
    for a, b in parts:
        if a >= at:
            out += text[at:a] + secret_scan.MARK
        at = max(at, b)
    return out + text[at:]


def by_hand(rows):
    """doc_id -> text after exact dedup, near dedup and redaction of (doc_id, text) with letters."""
    last = {}
    for i, t in rows:
        last[fold(t)] = max(i, last.get(fold(t), i))
    rows = [(i, t) for i, t in rows if last[fold(t)] == i]
    fp = [print_of(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4]
    root, least = closure(len(rows), pairs), {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    return {i: marked(t) for (i, t), r in zip(rows, root) if least[r] == i}


def test_pipeline_equals_its_stages_by_hand(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = by_hand([(i, t) for i, t in rows if any(map(str.isalpha, t))])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, used = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048


def test_stages_take_odd_rows(spark):
    texts = [None, "", "123 !!", "the same text of some words here", "THE same text of some words here", "x password=abcdefgh12 the and of to in", "long " * 20_000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no name has this text of words", "en", "s", 3), (3, texts[3], "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOC)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), DOC)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {4, 5, 6, None} and kept[5] == "x [secret] the and of to in"
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, SF)
        assert empty_out.collect() == []


CLASH = ["__id", "__digest", "__key", "__strong", "__new", "__drop", "__fp", "__AT", "lang_pred", "lang_score", "lang_rejected", "a.b", "c`d", "fp", "digest"]


def test_stages_keep_columns_with_clashing_names(spark):
    texts = ["the and of to in it is a plain text", "x password=abcdefgh12 the and of to in", "the and of to in it is another plain text of words"]
    rows = [(i, t, "en", "s", len(t), *(f"mine {c}" for c in CLASH)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *CLASH])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and len(got) == 3, name
        assert all(tuple(r)[5:] == tuple(f"mine {c}" for c in CLASH) for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 3


def test_stages_lose_no_rows_that_share_an_identifier(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words)
    rows = [(1, near), (7, near + " more"), (7, "a text of its own that resembles nothing else here at all"), (None, near + " less"), (None, "one text without a name at all")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    kept = sorted(r.text for r in simhash.keep_one(docs).collect())
    alone = [rows[2][1], rows[4][1]]
    assert set(alone) < set(kept) and near in kept
    group = {t for _, t in rows} - set(alone)
    linked = [t for t in group if (print_of(t) ^ print_of(near)).bit_count() <= 4]
    assert len(kept) == len(alone) + 1 + len(group) - len(linked)
    copies = spark.createDataFrame([(7, near, "en", "s", 1), (7, near + " ", "en", "s", 2), (None, near, "en", "s", 3)], DOC)
    assert [r.doc_id for r in simhash.keep_one(copies).collect()] == [7]
    assert len(exact_dedup.keep_one(docs).collect()) == 5
