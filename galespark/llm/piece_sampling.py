"""Sampled SentencePiece segmentations without replacement.

The lattice of a text holds every way to write it in vocabulary pieces. A path
weighs the product of its pieces' weights; a BPE vocabulary gives only ranks,
so a piece of rank r weighs 1 / (r + 2.7) up to a constant (Zipf's law), and a
character without a piece is its bytes, each with the weight of the last rank.

Perturbed A* search: the whole lattice is a set with one Gumbel-distributed
maximum. The best set is taken from the queue, its maximum is drawn (an
ancestral sample of the set), and what remains of the set is split along the
drawn path into the sets that leave it at each place, each with the log mass of
its paths and a Gumbel maximum truncated by its parent's. The first k drawn are
k distinct paths without replacement; with the next maximum as threshold each
gets its inclusion probability 1 - exp(-exp(log p - threshold)). No path is ever
listed that is not drawn.

Chunks between spaces do not share pieces, so the lattice of a distinct chunk is
built once per batch. All random numbers are functions of the row key, the draw
and the place, so batches, retries and order do not matter.

Defined results: null and empty texts have one segmentation without pieces; a
text with fewer than k segmentations gives all of them, each certain (log inclusion 0);
repeated rows draw alike; a null key counts as 0; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, SEED = 2, 11
BATCH_CHARS = 3_000_000
BLOCK = 100_000  # characters whose lattices are built together, so that arrays stay in the processor's cache
LOW = 512  # characters below it are looked up two at a time
SPACE = "▁"
U64 = np.uint64


def stirred(x, *parts) -> np.ndarray:
    """The state ``x`` of the random numbers, moved on by integer coordinates."""
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.int64).view(U64)) + U64(0x9E3779B97F4A7C15)
            x ^= x >> U64(30)
            x *= U64(0xBF58476D1CE4E5B9)
            x ^= x >> U64(27)
            x *= U64(0x94D049BB133111EB)
            x ^= x >> U64(31)
    return x


def mixed(*parts, start=U64(SEED)) -> np.ndarray:
    """Uniform numbers in (0, 1) of integer coordinates."""
    return ((stirred(start, *parts) >> U64(12)).astype(np.float64) + 0.5) / 2.0**52


class Pieces:
    """A vocabulary as a character trie in sorted arrays, with log weights."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        rank = np.array([min(max(-sp.get_score(i), 0.0), n) for i in range(n)])
        self.bytes_of, self.byte_id, trie, self.piece = [b""] * n, {}, {}, [-1]
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(text[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(text[3:5], 16)])
                rank[i] = n
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = text.encode()
                node = 0
                for c in text:
                    nxt = trie.setdefault(node << 21 | ord(c), len(self.piece))
                    if nxt == len(self.piece):
                        self.piece.append(-1)
                    node = nxt
                self.piece[node] = i
        self.weight = -np.log(rank + 2.7) - math.log(math.log(n))
        size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.letters, self.size, self.begin = np.frombuffer(b"".join(self.bytes_of), np.uint8), size, np.cumsum(size) - size
        self.keys = np.array(sorted(trie), np.int64)
        self.next = np.array([trie[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(self.piece, np.int64)
        self.inner = np.zeros(len(self.piece), bool)  # nodes that go on
        self.inner[self.keys >> 21] = True
        first = self.keys[self.keys < 1 << 21]  # characters from the root, looked up directly
        self.root = np.zeros(int(first.max()) + 1, np.int64)
        self.root[first] = self.next[: len(first)]
        # the node of two characters, for the common ones
        self.two = np.zeros((LOW, LOW), np.int64)
        for c in first[first < LOW].tolist():
            a, b = np.searchsorted(self.keys, [int(self.root[c]) << 21, (int(self.root[c]) << 21) + LOW])
            self.two[c, self.keys[a:b] & (LOW - 1)] = self.next[a:b]
        # whether pieces go on over spaces; if not, chunks end before each run of them
        self.crossing = any(re.search(f"[^{SPACE}]{SPACE}", b.decode("utf-8", "ignore")) for b in self.bytes_of)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next nodes, 0 where the trie goes no further."""
        key = node << 21 | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], 0)

    def normalised(self, text: str | None) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def chunks(self, texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
        """The distinct chunks of texts, which one each chunk is, and how many chunks each text has."""
        normal = [self.normalised(t) for t in texts]
        ends = np.append(0, np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal))))
        code = np.frombuffer(utf32("".join(normal)), np.uint32)
        begin = np.zeros(len(code), bool)
        if not self.crossing:
            space = code == ord(SPACE)
            begin[1:] = space[1:] & ~space[:-1]
        begin[ends[:-1][ends[:-1] < ends[1:]]] = True
        start = np.flatnonzero(begin)
        bounds = 4 * np.append(start, len(code))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(code)])
        found = found.dictionary_encode()
        return found.dictionary, found.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(start, ends))

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of a segmentation."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.letters[np.repeat(self.begin[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def utf32(text: str) -> bytes:
    return text.encode("utf-32-le", "surrogatepass")


def content(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All characters of texts of four bytes each, and where each text begins and the last ends."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint32)[: at[-1] // 4], at // 4


class Lattice:
    """Edges of all distinct chunks of a batch, with conditional log probabilities."""

    def __init__(self, voc: Pieces, chunks: list[str] | pa.LargeBinaryArray):
        if isinstance(chunks, list):
            chunks = pa.array([utf32(c) for c in chunks], pa.large_binary())
        code, ends = content(chunks)
        size = np.diff(ends)
        self.first, self.last = ends[:-1] + np.arange(len(size)), ends[1:] + np.arange(len(size))  # nodes
        block = ends[:-1] // BLOCK
        cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(size)]
        parts, edges, bare = [], 0, 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            parts.append(_lattice(voc, code[ends[a] : ends[b]].astype(np.int64), size[a:b], int(ends[a]) + a, edges, bare))
            edges, bare = edges + len(parts[-1][0]), bare + len(parts[-1][-1])
        self.src, self.dst, self.piece, self.logp, self.up_to, self.several, start, spelled, n_bytes = map(np.concatenate, zip(*parts))
        self.start = np.append(start, edges)
        self.spelled, self.spelled_at = spelled, np.append(0, np.cumsum(n_bytes))

    def left(self, edge: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log probability of leaving each edge's node by another."""
        return np.where(self.several[edge], np.log(np.maximum(-np.expm1(logp), 1e-300)), -np.inf)

    def ids(self, edge: np.ndarray) -> np.ndarray:
        """Pieces of a path, characters without one as bytes."""
        ids = self.piece[edge]
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids
        which = -1 - ids[bare].astype(np.int64)
        size = np.ones(len(ids), np.int64)
        size[bare] = self.spelled_at[which + 1] - self.spelled_at[which]
        out = np.repeat(ids, size)
        begin = (np.cumsum(size) - size)[bare]
        for i in range(int(size.max())):
            on = size[bare] > i
            out[begin[on] + i] = self.spelled[self.spelled_at[which[on]] + i]
        return out

    def draw(self, node: np.ndarray, uniform) -> np.ndarray:
        """An edge of each node by its conditional probabilities; ``uniform``
        gives the random numbers of some places. Long pieces are the likelier
        ones, so the search goes down from a node's last edge."""
        low, edge = self.start[node], self.start[node + 1] - 1
        todo = np.flatnonzero(low < edge)
        goal = node[todo] + uniform(todo)
        low, at = low[todo], edge[todo]
        while len(todo):
            on = np.flatnonzero((at > low) & (self.up_to[at - 1] > goal))
            todo, goal, low, at = todo[on], goal[on], low[on], at[on] - 1
            edge[todo] = at
        return edge


def _lattice(voc: Pieces, code: np.ndarray, size: np.ndarray, node0: int, edge0: int, bare0: int) -> tuple:
    """The part of a lattice over some chunks, which begins at a node, an edge
    and a character without a piece: source, target, piece, log probability,
    bound and having others beside it of each edge, first edge of each node, bytes of the characters
    without a piece, and how many bytes each has."""
    owner = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)
    limit = end[owner]
    pos, node, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
    single = np.zeros(len(code), bool)
    length = 1
    while len(pos):
        if length == 1:
            node = np.where(code < len(voc.root), voc.root[np.minimum(code, len(voc.root) - 1)], 0)
            on = node > 0
            pos, node = pos[on], node[on]
        elif length == 2:
            a, b = code[pos], code[pos + 1]
            low = (a < LOW) & (b < LOW)
            node[low] = voc.two[a[low], b[low]]
            node[~low] = voc.step(node[~low], b[~low])
            on = node > 0
            pos, node = pos[on], node[on]
        else:
            node = voc.step(node, code[pos + length - 1])
            on = node > 0
            pos, node = pos[on], node[on]
        whole = voc.piece[node] >= 0
        found.append((pos[whole], np.full(int(whole.sum()), length), voc.piece[node[whole]]))
        if length == 1:
            single[pos[whole]] = True
        more = (pos + length < limit[pos]) & voc.inner[node]
        pos, node = pos[more], node[more]
        length += 1
    src, span, piece = (np.concatenate(x) for x in zip(*found))
    bare = np.flatnonzero(~single)  # characters as bytes
    spelled = [[voc.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in code[bare].tolist()]
    n_bytes = np.array([len(x) for x in spelled], np.int64)
    w = np.concatenate([n_bytes * voc.weight[voc.byte_id[0]], voc.weight[piece]])
    src, span = np.concatenate([bare, src]), np.concatenate([np.ones(len(bare), np.int64), span])
    piece = np.concatenate([-1 - bare0 - np.arange(len(bare)), piece])
    s = src + owner[src]
    nodes = len(code) + len(size)
    degree = np.bincount(s, minlength=nodes)
    start = np.cumsum(degree) - degree
    # edges were found by growing length; each goes to its node's next free place
    free, place = start.copy(), np.empty(len(s), np.int64)
    bounds = np.cumsum([0, len(bare), *(len(x[0]) for x in found)])
    for a, b in zip(bounds[:-1], bounds[1:]):
        place[a:b] = free[s[a:b]]
        free[s[a:b]] += 1
    order = np.empty(len(s), np.int64)
    order[place] = np.arange(len(s))
    src = np.repeat(np.arange(nodes), degree)
    dst, piece, w = src + span[order], piece[order].astype(np.int32), w[order]
    far = np.repeat(np.repeat(end + np.arange(len(size)), size + 1) - np.arange(nodes), degree)  # characters to the chunk's end
    narrow = np.int16 if len(far) and far.max() < 1 << 15 else np.int64  # sixteen bits sort by radix
    by = np.argsort(far.astype(narrow), kind="stable")  # nodes stay together inside a distance
    cuts = np.searchsorted(far[by], np.arange(1, int(far.max()) + 2)) if len(by) else []
    beta = np.zeros(nodes)
    for a, b in zip(cuts[:-1], cuts[1:]):
        e = by[a:b]
        own = src[e]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        beta[own[new]] = np.logaddexp.reduceat(w[e] + beta[dst[e]], new)
    logp = np.minimum(w + beta[dst] - np.repeat(beta, degree), 0)
    run = np.cumsum(np.exp(logp))
    before = np.repeat(np.append(0, run)[start], degree)
    src += node0
    up_to = src + np.minimum(run - before, 1)
    return src, dst + node0, piece, logp, up_to, np.repeat(degree > 1, degree), start + edge0, np.fromiter(chain.from_iterable(spelled), np.int32), n_bytes


def _sample(lattice, key, occ_doc, occ_rank, occ_end, occ, node, step, draw):
    """Walk to the end of each chunk; (occurrence, step, edge) of every piece in
    text order. Occurrences come in rising order, each once."""
    out, first, number, drawn = [], step, np.zeros(len(occ), np.int64), stirred(U64(SEED), draw, key)
    walker, every = np.arange(len(occ)), occ
    while len(walker):
        mine = every[walker]
        edge = lattice.draw(node, lambda i: mixed(occ_rank[mine[i]] << 24 | step[i], start=drawn[occ_doc[mine[i]]]))  # noqa: B023
        out.append((walker, edge))
        number[walker] += 1
        node = lattice.dst[edge]
        on = node < occ_end[mine]
        walker, node, step = walker[on], node[on], step[on] + 1
    start = np.cumsum(number) - number
    edges = np.empty(int(number.sum()), np.int64)
    for i, (walker, edge) in enumerate(out):
        edges[start[walker] + i] = edge
    steps = np.arange(len(edges)) - np.repeat(start - first, number)
    return np.repeat(every, number), steps, edges


def largest(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest numbers; k is small."""
    if len(x) <= k or k > 3:
        return np.argsort(-x, kind="stable")[:k]
    out, x = [], x.copy()
    for _ in range(k):
        out.append(int(x.argmax()))
        x[out[-1]] = -np.inf
    return np.array(out)


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))); long texts need the logarithm, their paths have tiny probabilities."""
    return 0.0 if x > 6 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def segmentations(voc: Pieces, texts: list[str], keys: np.ndarray, k: int = K) -> list[list[tuple]]:
    """Per text the drawn paths as (log p, log inclusion, ids), best perturbed first."""
    n = len(texts)
    result: list[list] = [[] for _ in range(n)]
    distinct, occ_chunk, count = voc.chunks(texts)
    if not len(occ_chunk):
        return [[(0.0, 0.0, np.zeros(0, np.int32))] for _ in range(n)]
    lat = Lattice(voc, distinct)
    occ_doc = np.repeat(np.arange(n), count)
    doc_occ = np.r_[0, np.cumsum(count)]
    occ_rank = np.arange(len(occ_doc)) - doc_occ[occ_doc]
    occ_end = lat.last[occ_chunk]
    live = [d for d in range(n) if count[d]]
    bound = -np.log(-np.log(mixed(keys, -1, 0)))
    queue: list[list] = [[] for _ in range(n)]
    kept: dict[tuple, tuple] = {}
    todo = {d: (bound[d], None, 0, ()) for d in live}
    for r in range(k):
        # the sets taken from the queues: prefix, one edge that leaves the old path, the rest drawn anew
        head, occ, node, step = {}, [], [], []
        if r == 0:  # the whole lattices of all texts
            occ, node, step = [np.arange(len(occ_chunk))], [lat.first[occ_chunk]], [np.zeros(len(occ_chunk), np.int64)]
        for d, (g, old, t, banned) in todo.items() if r else ():
            a, b = doc_occ[d], doc_occ[d + 1]
            if old is not None:
                o, s, e = kept[old]
                here = lat.src[e[t]]
                edges = np.array([x for x in range(lat.start[here], lat.start[here + 1]) if x not in banned])
                p = np.cumsum(np.exp(lat.logp[edges] - lat.logp[edges].max()))
                pick = edges[min(np.searchsorted(p, mixed(keys[d], r, -2, t) * p[-1]), len(edges) - 1)]
                head[d] = o[: t + 1], s[: t + 1], np.append(e[:t], pick)
                if lat.dst[pick] < occ_end[o[t]]:
                    occ.append(np.array([o[t]]))
                    node.append(np.array([lat.dst[pick]]))
                    step.append(np.array([s[t] + 1]))
                a = o[t] + 1
            occ.append(np.arange(a, b))
            node.append(lat.first[occ_chunk[a:b]])
            step.append(np.zeros(b - a, np.int64))
        if not occ:
            break
        o, s, e = _sample(lat, keys, occ_doc, occ_rank, occ_end, np.concatenate(occ), np.concatenate(node), np.concatenate(step), r)
        cut, gumbel = np.searchsorted(occ_doc[o], np.arange(n + 1)), stirred(U64(SEED), keys, r, -3)
        for d, (g, old, t, banned) in todo.items():
            path = o[cut[d] : cut[d + 1]], s[cut[d] : cut[d + 1]], e[cut[d] : cut[d + 1]]
            if old is not None:
                path = tuple(np.concatenate(x) for x in zip(head[d], path))
            kept[d, r] = path
            edge = path[2]
            logp = lat.logp[edge]
            upto = np.cumsum(logp)
            result[d].append((float(upto[-1]), edge))
            places = np.arange(t, len(edge))
            left = lat.left(edge[t:], logp[t:])
            out = (*banned, int(edge[t]))
            here = lat.src[edge[t]]
            rest = [x for x in range(lat.start[here], lat.start[here + 1]) if x not in out]
            left[0] = np.logaddexp.reduce(lat.logp[rest]) if len(rest) else -np.inf
            mass = upto[t:] - logp[t:] + left
            free = mass - np.log(-np.log(mixed(places, start=gumbel[d])))  # Gumbel maxima, and in the same order truncated at g
            top = largest(free, k - r)
            new = -np.logaddexp(-free[top], -g)
            queue[d] += [(float(x), (d, r), int(t + i), out if i == 0 else (int(edge[t + i]),)) for x, i in zip(new, top) if x > -np.inf]
        todo = {}
        for d in live:
            if queue[d] and len(result[d]) == r + 1:
                best = max(range(len(queue[d])), key=lambda i: queue[d][i][0])
                todo[d] = queue[d].pop(best) if r + 1 < k else queue[d][best]
    final = []
    for d in range(n):
        threshold = todo[d][0] if d in todo else -math.inf
        rows = []
        for logp, edge in result[d]:
            q = _log_inclusion(logp - threshold)
            rows.append((logp, q, lat.ids(edge)))
        final.append(rows or [(0.0, 0.0, np.zeros(0, np.int32))])
    return final


def sample(docs: DataFrame, path: str, k: int = K) -> DataFrame:
    """doc_id, draw, log_prob, log_inclusion, ids (little-endian 32 bit), n_pieces, round_trip: up to k rows per document."""
    names = ["doc_id", "draw", "log_prob", "log_inclusion", "ids", "n_pieces", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = pieces(path)
        ids, texts, total = [], [], 0

        def flush():
            key = np.array([i or 0 for i in ids], np.int64)
            rows = []
            for i, t, found in zip(ids, texts, segmentations(voc, texts, key, k)):
                want = voc.normalised(t).encode("utf-8", "surrogatepass")
                rows += [
                    (i, j + 1, lp, q, x.astype("<i4").tobytes(), len(x), voc.spelled(x) == want) for j, (lp, q, x) in enumerate(found)
                ]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                total += len(texts[-1])
                if total >= BATCH_CHARS or len(ids) >= 10_000:
                    yield flush()
                    ids, texts, total = [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, draw int, log_prob double, log_inclusion double, ids binary, n_pieces bigint, round_trip boolean")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (doc_id, draw, ids) -> doc_id, draw, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = pieces(path)
        for b in batches:
            text = pa.array([voc.decode(np.frombuffer(x.as_py() or b"", "<i4").tolist()) for x in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], names=["doc_id", "draw", "text"])

    return rows.select("doc_id", "draw", "ids").mapInArrow(run, "doc_id bigint, draw int, text string")
