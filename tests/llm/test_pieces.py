"""Sampled segmentations against all paths of small lattices."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from galespark.llm import piece_sampling as X

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id bigint, text string, lang string, ids binary, draw string"
ODD = [None, "", " ", "a", "  two  spaces ", "tab\tnew\n\nline", "é É 中文 😀 👩‍👩‍👧", "x" * 20_000, "word " * 5000, "\x00\x7f", "▁odd▁"]


def all_paths(voc, text):
    """Every segmentation with its probability, by plain recursion over pieces."""
    text = voc.normalised(text)
    known = {b.decode(): i for i, b in enumerate(voc.bytes_of) if b and i not in voc.byte_id.values() and not _bad(b)}
    out = []

    def walk(at, ids, w):
        if at == len(text):
            out.append((tuple(ids), w))
            return
        for j in range(at + 1, len(text) + 1):
            if (i := known.get(text[at:j])) is not None:
                walk(j, [*ids, i], w + voc.weight[i])
        if text[at] not in known:
            b = [voc.byte_id[x] for x in text[at].encode()]
            walk(at + 1, ids + b, w + len(b) * voc.weight[b[0]])

    walk(0, [], 0.0)
    total = math.log(sum(math.exp(w) for _, w in out))
    return {p: w - total for p, w in out}


def _bad(b):
    try:
        b.decode()
        return False
    except UnicodeDecodeError:
        return True


def test_draws_are_distinct_paths_with_their_probability():
    voc = X.pieces(PATH)
    for text in ("the cat", "a b", "éx\nq", "inter nal"):
        paths = all_paths(voc, text)
        for key, rows in enumerate(X.segmentations(voc, [text] * 40, np.arange(40), 6)):
            got = [tuple(ids.tolist()) for _, _, ids in rows]
            assert len(set(got)) == len(got) == min(6, len(paths)), (text, key)
            assert all(abs(lp - paths[p]) < 1e-9 for (lp, _, _), p in zip(rows, got))
        every = X.segmentations(voc, [text], np.array([7]), len(paths) + 3)[0]
        assert {tuple(ids.tolist()) for _, _, ids in every} == set(paths) and all(q == 0 for _, q, _ in every)


def test_frequencies_and_inclusion():
    voc, text, n, k = X.pieces(PATH), "the in", 6000, 2
    paths = all_paths(voc, text)
    rows = X.segmentations(voc, [text] * n, np.arange(n), k)
    first, second = Counter(tuple(r[0][2].tolist()) for r in rows), Counter(tuple(r[1][2].tolist()) for r in rows)
    for path, lp in paths.items():
        p = math.exp(lp)
        after = sum(math.exp(o) * p / (1 - math.exp(o)) for x, o in paths.items() if x != path)  # without replacement
        for seen, want in ((first[path], p), (second[path], after)):
            assert abs(seen / n - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-3
    # weights p / inclusion estimate sums over all paths without bias, here the sum of p
    estimate = [sum(math.exp(lp - q) for lp, q, _ in r) for r in rows]
    assert abs(np.mean(estimate) - 1) < 5 * np.std(estimate) / math.sqrt(n)


def test_table_round_trips(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    table = spark.createDataFrame([(i, t, "x", b"", "y") for i, t in enumerate(texts)], DOC)
    out = X.sample(table, PATH)
    rows = out.collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    by = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<i4").tolist()
        assert r.round_trip and r.n_pieces == len(ids) and -math.inf < r.log_inclusion <= 0 and r.log_prob <= 0
        by.setdefault(r.doc_id, []).append((r.draw, ids))
        if "▁" not in (texts[r.doc_id] or ""):
            assert sp.decode(ids) == (texts[r.doc_id] or "")
    assert len(by) == len(texts) and all(len({tuple(i) for _, i in v}) == len(v) <= X.K for v in by.values())
    again = {(r.doc_id, r.draw): bytes(r.ids) for r in X.sample(table.repartition(7), PATH).collect()}
    assert again == {(r.doc_id, r.draw): bytes(r.ids) for r in rows}
    text = {(r.doc_id, r.draw): r.text for r in X.decode(out, PATH).collect()}
    assert all(text[d, j] == (texts[d] or "").replace("▁", " ") for d, v in by.items() for j, _ in v)
    assert X.sample(table.limit(0), PATH).collect() == []


def test_walks_end_where_no_piece_goes_on(monkeypatch):
    voc = X.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    asked = []
    step = X.Pieces.step
    monkeypatch.setattr(X.Pieces, "step", lambda self, node, code: asked.append(node) or step(self, node, code))
    lat = X.Lattice(voc, ["▁understanding", "▁the", "zz", "€ü"])
    goes_on = set((voc.keys >> 21).tolist())
    assert asked and goes_on.issuperset(np.concatenate(asked).tolist())
    # all pieces are found for all that
    found = {(int(s), int(d)) for s, d, p in zip(lat.src, lat.dst, lat.piece) if s < 14}
    ids = {b.decode("utf-8", "ignore") for b in voc.bytes_of}
    text = "▁understanding"
    assert found == {(i, j) for i in range(14) for j in range(i + 1, 15) if text[i:j] in ids}
    part = X.stirred(X.U64(X.SEED), 3, np.arange(4))
    assert (X.mixed(7, start=part) == X.mixed(3, np.arange(4), 7)).all()


def test_lattices_of_a_batch_are_built_in_blocks(monkeypatch):
    voc = X.pieces(PATH)
    texts = [t or "" for t in ODD] + [f"word{i % 7} of a text  with {i} chunks" for i in range(60)]
    distinct, which, count = voc.chunks(texts)
    rule = re.compile(f"{X.SPACE}*[^{X.SPACE}]+|{X.SPACE}+")
    want = [rule.findall(voc.normalised(t)) for t in texts]
    chunks = [c.decode("utf-32-le") for c in distinct.to_pylist()]
    assert count.tolist() == [len(w) for w in want] and [chunks[i] for i in which] == [c for w in want for c in w]
    assert chunks == list(dict.fromkeys(c for w in want for c in w))

    whole, built, build = X.Lattice(voc, distinct), [], X._lattice
    monkeypatch.setattr(X, "BLOCK", 30)
    monkeypatch.setattr(X, "_lattice", lambda voc, code, size, *at: built.append(size.tolist()) or build(voc, code, size, *at))
    parts = X.Lattice(voc, chunks)
    assert [n for b in built for n in b] == [len(c) for c in chunks] and all(sum(b[:-1]) <= 30 for b in built) and len(built) > 5
    for name in ("first", "last", "start", "src", "dst", "piece", "several", "spelled", "spelled_at"):
        assert (getattr(whole, name) == getattr(parts, name)).all(), name
    assert np.allclose(whole.logp, parts.logp, rtol=0, atol=1e-12) and np.allclose(whole.up_to, parts.up_to, rtol=0, atol=1e-8)
    assert (parts.ids(np.arange(len(parts.src))) == whole.ids(np.arange(len(whole.src)))).all()
