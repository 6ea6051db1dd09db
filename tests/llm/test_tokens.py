"""Token counts and packing against the library and a plain packing check."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from galespark.llm import packing, token_counts

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, pid int, used string, piece string"
SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n  word\n", "don't we'll I'D 12345 ½²", "a<|endoftext|>b <|endoftext|> <|endoftext|>", "<|startoftext|>x  <|endoftext|>\ty",
    "tab\t\tend　wide nbsp\x1cfs\x85nel​zero", "é É ÉCOLE İstanbul ΟΔΟΣ ß", "😀😀 👩‍👩‍👧 \U0001f1e9\U0001f1ea", "x" * 30_000, "ab " * 9000,
    "$$$ ### !!! a.b,c;d", "trailing   ", "  leading", "a \n b \r\n c", "   q", "word's 's 'S",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 1, 5, "u", "p") for i, t in enumerate(texts)], DOC)


def table_texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_counts_equal_the_library(spark):
    texts = ODD + table_texts(spark)
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, texts), BYTE, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), repr(t)[:80]
    assert token_counts.token_counts(docs(spark, ODD).limit(0), BYTE, public_tokenizers.PATTERN).collect() == []


def test_memory_stays_bounded():
    m = token_counts.Memory(len, limit=10)
    assert [m["x" * (i % 37)] for i in range(500)] == [i % 37 for i in range(500)]
    assert len(m) <= 10 and len(m.old) <= 10


def test_packing_is_whole_and_tight(spark):
    texts = ODD + table_texts(spark)
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(packing.pieces(docs(spark, texts).repartition(7), WORD, ids=True)).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, ids[k : k + 2048].tobytes())
    assert {(r.doc_id, r.piece): (r.start, bytes(r.ids)) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.03 * sum(r.length for r in rows) / 2048 + 2


def test_words_follow_the_rule_and_are_looked_up_once(monkeypatch):
    rng, library = random.Random(3), Tokenizer.from_file(WORD)
    plain, odd = "aAsStTrReEvVmMlLdD'\"!.,<|>09 \t\n\réÉŸÿžŽßÇ" + 4 * "'", "½²İſ中😀\x00\x7f×÷ŉ́\xa0　Δς"
    texts = ["".join(rng.choice(plain) for _ in range(rng.randrange(12))) for _ in range(5000)]
    found, sizes = packing.words(pa.array([t.lower() for t in texts], pa.string()))
    shown = token_counts._shown_bytes()
    rule = [[w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(t))] for t in texts]
    assert sizes.tolist() == [len(r) for r in rule]
    assert ["".join(shown[b] for b in w.encode()) for w in found.to_pylist()] == [w for r in rule for w in r]
    letters = "".join(c for c in map(chr, range(0x180)) if re.match(f"[{packing.LETTERS}]", c))
    assert packing.pc.utf8_lower(pa.array([letters])).to_pylist() == [letters.lower()]

    texts += ["".join(rng.choice(plain + odd) for _ in range(rng.randrange(12))) for _ in range(3000)] + ODD
    rng.shuffle(texts)
    asked, rows = [], packing.Encoder._rows
    monkeypatch.setattr(packing.Encoder, "_rows", lambda self, chunks, words: (words and asked.extend(chunks)) or rows(self, chunks, words))
    ids, sizes = packing.Encoder(WORD)(pa.array(texts, pa.string()).slice(5))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[5:]]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(asked) == len(set(asked)) > 1000  # not once for each occurrence


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 300)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sizes[b].sum() <= 100 for b in bins)
    rooms = []
    for s in sorted(sizes.tolist(), reverse=True):
        fit = min((r for r in rooms if r >= s), default=None)
        if fit is None:
            rooms.append(100 - s)
        else:
            rooms[rooms.index(fit)] -= s
    assert len(bins) == len(rooms)


@pytest.mark.parametrize("chunk", [7, 50_000])
def test_rounds_end_with_bounded_tasks(spark, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rows = packing.pack(packing.pieces(docs(spark, ["alpha beta " * (350 + i % 9) for i in range(60)] + ODD).repartition(6), WORD)).collect()
    assert len(rows) == len({(r.doc_id, r.piece) for r in rows})


def test_packing_nothing(spark):
    assert packing.pack(packing.pieces(docs(spark, ODD).limit(0), WORD)).collect() == []
