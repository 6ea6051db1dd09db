"""Secret scan that links the parts of multipart credentials.

Plain patterns find strong spans in each text: assignments of long values,
access identifiers and long hexadecimal runs. Looser patterns find weak
candidates: named identifiers, named or bare secret values, endpoints. A weak
candidate says little alone, so it is reported only where a complementary part
(a secret for an identifier or an endpoint, an identifier or an endpoint for a
secret) lies at most ``SCOPE`` code points away in the same text. Names may have
prefixes (``DB_USER``); a weak candidate that overlaps a strong span is not
reported again, but is a part for others. A URL with a user and a password is
both an endpoint and a secret. The search for parts is an interval join on (row, bucket of positions) with a residual overlap test, run
as semi joins, so pairs are never listed.

Everything is built from DataFrame functions. Spans are code points, end
exclusive.

Defined results: a null text counts as empty; an empty table gives an empty
result; repeated rows are scanned each on their own; a null identifier stays
null; overlapping spans of different kinds are all reported; further columns
are ignored by ``scan`` and kept, whatever their names, by ``redact``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.llm.names import free, quoted
from galespark.session import cut

SCOPE, BUCKET = 200, 1000
# fixed values: the strong patterns, with the length that a match (or its value) needs
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a greedy run of 16 or more; shorter runs hold no longer one
HEX = r"[0-9a-f]{32,}"
VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)"""
NAMED_ID = r"(?<![A-Za-z0-9])((?i:access_?key_?id|client_?id|user_?name|user|login|account))" + VALUE
NAMED_SECRET = r"(?<![A-Za-z0-9])((?i:pass|passphrase|pwd|auth|credential|private_?key|secret_?access_?key))" + VALUE
BARE_SECRET = r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])"
SCHEME = r"(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]++://"
IN_URL = SCHEME + r"""[^\s"'<>|/@:]*:[^\s"'<>|/@]+@"""
ENDPOINT = SCHEME + r"""[^\s"'<>|/@]+@[^\s"'<>|,;)]+|https?://[^\s"'<>|,;)]+|(?<![A-Za-z0-9])(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+"""
KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]
STRONG = 3  # the first kinds
SECRETS = [0, 2, 4]  # kinds that are the secret part of a credential
MARK = "[secret]"


class Names(NamedTuple):
    """Helper columns, under names that clash with none of the caller's."""

    key: str = "__key"
    strong: str = "__strong"
    weak: str = "__weak"
    cross: str = "__cross"
    loose: str = "__loose"
    linked: str = "__linked"
    new: str = "__new"


def found(text, pattern: str, kind: int, keep=None) -> F.Column:
    """Spans (start, kind, end) of all matches, leftmost first, without overlap.

    Splitting and extracting with one pattern alternate gaps and matches; their
    running lengths are the positions."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>")
    start = F.struct(F.lit(0).alias("pos"), empty.alias("out"))

    def step(acc, x):
        at = acc["pos"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    if keep is not None:
        spans = F.filter(spans, lambda x: keep(x["hit"]))
    plain = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), plain).otherwise(none)


def _value(pattern: str, group: int, least: int):
    return lambda hit: F.length(F.regexp_extract(hit, pattern, group)) >= least


def _mixed(hit) -> F.Column:
    return hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")


def strong(text) -> F.Column:
    spans = [found(text, ASSIGN, 0, _value(ASSIGN, 2, 8)), found(text, ACCESS, 1), found(text, HEX, 2)]
    return F.sort_array(F.concat(*spans))


def weak(text) -> F.Column:
    return F.concat(
        found(text, NAMED_ID, 3, _value(NAMED_ID, 2, 3)),
        found(text, NAMED_SECRET, 4, _value(NAMED_SECRET, 2, 6)),
        found(text, BARE_SECRET, 4, _mixed),
        found(text, IN_URL, 4),
        found(text, ENDPOINT, 5),
    )


def _names(docs: DataFrame) -> Names:
    return Names(*free(docs.columns, *Names._fields))


def _parts(docs: DataFrame, n: Names, *columns) -> DataFrame:
    """``columns`` with a row key, strong spans, weak spans that cross no strong one, and those that do."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*columns, strong(text).alias(n.strong), weak(text).alias(n.loose), F.monotonically_increasing_id().alias(n.key))
    crosses = lambda w: F.exists(n.strong, lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"]))
    return rows.withColumns({n.weak: F.filter(n.loose, lambda w: ~crosses(w)), n.cross: F.filter(n.loose, crosses)}).drop(n.loose)


def linked(parts: DataFrame, scope: int = SCOPE, n: Names = Names()) -> DataFrame:
    """(key, linked): weak spans with a complementary part in scope."""
    part = lambda spans, weak: F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"], F.lit(weak).alias("weak")))
    spans = F.concat(part(n.strong, False), part(n.cross, False), part(n.weak, True))
    spans = parts.filter(F.size(n.weak) > 0).select(F.col(n.key).alias("key"), F.explode(spans).alias("x")).select("key", "x.*")
    secret = F.col("kind").isin(SECRETS)
    sides = []
    for side, reach in ((spans.filter(secret), scope), (spans.filter(~secret), 0)):
        first, last = F.floor((F.col("start") - reach) / BUCKET), F.floor((F.col("end") + reach) / BUCKET)
        sides.append(side.withColumn("bucket", F.explode(F.sequence(first, last))))
    hits = []
    for own, other in (sides, sides[::-1]):
        near = other.select(F.col("key").alias("k"), F.col("bucket").alias("b"), F.col("start").alias("s"), F.col("end").alias("e"))
        within = (F.col("s") <= F.col("end") + scope) & (F.col("e") + scope >= F.col("start"))
        same = (F.col("key") == F.col("k")) & (F.col("bucket") == F.col("b"))
        hits.append(own.filter("weak").join(near, same & within, "left_semi").select("key", "start", "kind", "end"))
    found = F.collect_set(F.struct("start", "kind", "end")).alias(n.linked)
    return hits[0].unionByName(hits[1]).groupBy(F.col("key").alias(n.key)).agg(found)


def _written(spans) -> F.Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])))


def _all(strong_spans, linked_spans) -> F.Column:
    return F.sort_array(F.when(linked_spans.isNull(), strong_spans).otherwise(F.concat(strong_spans, linked_spans)))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of strong spans, their digest, all spans."""
    n = _names(docs)
    parts = cut(_parts(docs, n, F.col("doc_id").cast("bigint").alias("doc_id")))
    of = lambda kind: F.size(F.filter(n.strong, lambda x: x["kind"] == kind)).cast("bigint")
    return parts.join(linked(parts, scope, n), n.key, "left").select(
        "doc_id", *(of(k).alias(f"n_{KINDS[k]}") for k in range(STRONG)),
        F.sha2(F.encode(_written(F.col(n.strong)), "utf-8"), 256).alias("base_sha256"),
        _written(_all(F.col(n.strong), F.col(n.linked))).alias("spans"),
        F.coalesce(F.size(n.linked), F.lit(0)).alias("n_linked"),
    )


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by a mark; other texts stay as they are."""
    n = _names(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = reduce(lambda a, b: a | b, (text.rlike(p) for p in (ASSIGN, ACCESS, HEX, NAMED_ID, NAMED_SECRET, BARE_SECRET, IN_URL, ENDPOINT)))
    parts = cut(_parts(docs.filter(some), n, *quoted(docs)))
    rows = parts.join(linked(parts, scope, n), n.key, "left")
    spans = _all(F.col(n.strong), F.col(n.linked))

    def step(acc, x):
        gap = F.col("text").substr(acc["pos"] + 1, x["start"] - acc["pos"])
        out = F.when(x["start"] >= acc["pos"], F.concat(acc["out"], gap, F.lit(MARK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), out.alias("out"))

    whole = F.aggregate(
        spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.col("text").substr(acc["pos"] + 1, F.length("text"))),
    )
    changed = F.size(spans) > 0
    rows = rows.withColumn(n.new, F.when(changed, whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length(n.new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    done = rows.withColumn("text", F.col(n.new)).select(*quoted(docs))
    return docs.filter(~some).unionByName(done)
