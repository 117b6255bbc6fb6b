"""Secret scans: multipart credential linking.

Every text is scanned for parts: identifiers, secrets and endpoints. Assignments,
access ids and long hex runs (the base kinds) are always reported. Weak parts
(login names, mail addresses, blobs, endpoints) are reported only when a
complementary part lies within ``reach`` characters in the same scope, a
paragraph. The link is an interval join over position buckets of that width: for
each scope, role and bucket only the outermost positions are kept, so a scope full
of parts gives a row for each bucket and not a row for each pair.

Null and empty texts hold no parts. Equal texts are linked once, by their digest;
repeated rows each return a row. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourscale.llm.common import text_digest, unused, written

KINDS = ["assign", "access", "hex", "login", "mail", "blob", "endpoint"]
BASE = 3
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
ROLE = [SECRET, IDENTIFIER, SECRET, IDENTIFIER, IDENTIFIER, SECRET, ENDPOINT]
REACH = 100
SPAN = "struct<start: bigint, kind: int, end: bigint>"
PART = "struct<start: bigint, kind: int, end: bigint, scope: int>"

_letters = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_key = "|".join(map(_letters, ["password", "passwd", "secret", "token"])) + "|" + _letters("api") + "_?" + _letters("key")
ASSIGN = re.compile(rf"""({_key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_LOGIN_KEYS = [b"user", b"login", b"client_id", b"account"]
LOGIN = re.compile(rf"""(?:{"|".join(map(_letters, ["username", "user", "login", "client_id", "account"]))})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{3,}}""")
MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
BLOB = re.compile(r"[A-Za-z0-9+/_=-]{32,}")
ENDPOINTS = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+""")
_ASSIGN_KEYS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
_as_run = lambda chars: bytes(120 if b in chars else 32 for b in range(256))
_HEX_RUN = _as_run(b"0123456789abcdef")
_BLOB_RUN = _as_run(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def base_spans(text: str, raw: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds. The byte tests only spare texts that can't match."""
    found = []
    if any(k in low for k in _ASSIGN_KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_RUN):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, raw: bytes, low: bytes, base: list) -> list[tuple[int, int, int]]:
    """Parts that alone say little, outside the base spans."""
    found = []
    if any(k in low for k in _LOGIN_KEYS):
        found += [(m.start(), 3, m.end()) for m in LOGIN.finditer(text)]
    if b"@" in raw:
        found += [(m.start(), 4, m.end()) for m in MAIL.finditer(text)]
    if b"x" * 32 in raw.translate(_BLOB_RUN):
        found += [(m.start(), 5, m.end()) for m in BLOB.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]
    if b"://" in raw:
        found += [(m.start(), 6, m.end()) for m in ENDPOINTS.finditer(text)]
    ends, most = [], 0
    for s in base:
        most = max(most, s[2])
        ends.append(most)
    starts = [s[0] for s in base]
    return sorted(p for p in found if not (i := bisect_right(starts, p[2] - 1)) or ends[i - 1] <= p[0])


def scan(text: str | None) -> list[tuple[int, int, int, int]]:
    """All parts of a text, with the number of the paragraph each begins in."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower()
    base = base_spans(text, raw, low)
    found = sorted(base + weak_parts(text, raw, low, base)) if raw else []
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)] if found else []
    return [(*p, bisect_right(breaks, p[0])) for p in found]


def _parts(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("start", "kind", "end", "scope"), p)) for p in scan(t)] for t in texts], dtype=object)


def parts_of(text: str):
    return F.pandas_udf(_parts, f"array<{PART}>")(text)


def _role(kind):
    return F.element_at(F.array(*map(F.lit, ROLE)), kind + 1)


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts with a complementary part in reach. parts: key, start, kind, end, scope; returns key, start, kind, end.

    Complementary: a secret for an identifier or endpoint, either of them for a secret.
    """
    parts = parts.withColumn("secret", _role(F.col("kind")) == SECRET)
    bucket = lambda c: F.floor(c / reach)
    near = parts.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))))
    near = near.groupBy("key", "scope", "bucket", (~F.col("secret")).alias("secret")).agg(
        F.min(F.greatest("start", F.col("bucket") * reach)).alias("first"), F.max(F.least("end", (F.col("bucket") + 1) * reach)).alias("last")
    )
    weak = parts.where(F.col("kind") >= BASE).withColumn("bucket", F.explode(F.sequence(bucket(F.col("start") - reach), bucket(F.col("end") + reach))))
    pairs = weak.join(near, ["key", "scope", "bucket", "secret"])
    return pairs.where((F.col("first") <= F.col("end") + reach) & (F.col("last") >= F.col("start") - reach)).select("key", "start", "kind", "end").distinct()


def _with_spans(rows: DataFrame, linked: DataFrame, key: str, parts: str, spans: str) -> DataFrame:
    """Adds the reported spans to rows that hold parts."""
    plain = F.transform(F.filter(parts, lambda p: p.kind < BASE), lambda p: F.struct(p.start.alias("start"), p.kind.alias("kind"), p.end.alias("end")))
    more = linked.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "kind", "end")).alias(spans))
    has_weak = F.exists(parts, lambda p: p.kind >= BASE)
    with_weak = rows.where(has_weak).join(more, key, "left")
    return rows.where(~has_weak).withColumn(spans, plain).unionByName(
        with_weak.withColumn(spans, F.array_sort(F.concat(plain, F.coalesce(spans, F.array().cast(f"array<{SPAN}>")))))
    )


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id and spans (array of start, kind, end by start, then kind), a row for each row of docs."""
    seen = written(docs.select("doc_id", text_digest().alias("key"), parts_of("text").alias("parts")), "secret-parts")
    weak = seen.where(F.exists("parts", lambda p: p.kind >= BASE)).dropDuplicates(["key"])
    linked = linked_parts(weak.select("key", F.inline("parts")), reach)
    return _with_spans(seen, linked, "key", "parts", "spans").select("doc_id", "spans")


def spans_text(spans):
    """kind:start:end of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.start.cast("string"), s.end.cast("string"))), ",")


def _without_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with each run of overlapping spans replaced by a mark of its first kind."""
    out = []
    for text, found in zip(texts, spans):
        made, at = [], 0
        for s in sorted(found, key=lambda s: (s["start"], s["kind"], s["end"])):
            if s["start"] >= at:
                made += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
            at = max(at, s["end"])
        out.append("".join([*made, text[at:]]))
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs with the reported spans of text masked and n_chars, if there is one, kept in step. Every row stays."""
    key, parts, spans = unused(docs, "text_key"), unused(docs, "text_parts"), unused(docs, "text_spans")
    seen = docs.withColumn(parts, parts_of("text"))
    clean = seen.where(F.size(parts) == 0).select(docs.columns)
    dirty = written(seen.where(F.size(parts) > 0).withColumn(key, text_digest()), "secret-texts")
    weak = dirty.where(F.exists(parts, lambda p: p.kind >= BASE)).dropDuplicates([key])
    linked = linked_parts(weak.select(F.col(key).alias("key"), F.inline(parts)), reach)
    masked = _with_spans(dirty, linked, key, parts, spans).withColumn("text", F.pandas_udf(_without_spans, "string")("text", spans))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(masked.select(docs.columns))
