import hashlib
import re

from pyspark.sql import functions as F
from tables import CLASHING, documents, empty

from pourscale.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HEX = "0123456789abcdef" * 2
KEY = "AKIA" + "B2" * 8
TEXTS = [
    f'é token = "{HEX}" end', "token=token:abcdefgh", "password=abc", f"{KEY} and AKIA123", f"see {KEY}{HEX}", None, "", "plain words", "PASSWORD: hunter22 user=bob.smith",
    "user=bob.smith only", "mail ann@example.com here", f"mail ann@example.com\n\npassword=hunter22 {'x ' * 60}", f"host https://a.example.com/x key {'aB3' * 12}", f"blob {'aB3' * 12} alone",
    "api_key='abcdef' apikey:abcdef", "ſecret=abcdef", "word " * 40000 + "secret=abcdef", "a" * 5000 + "\n" + "token=abcdef", f'é token = "{HEX}" end',
]


def base_of(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24])


def linked_of(text, reach):
    """All pairs of parts compared."""
    parts = secrets.scan(text)
    gap = lambda p, q: max(p[0] - q[2], q[0] - p[2])
    other = lambda p, q: (secrets.ROLE[p[1]] == secrets.SECRET) != (secrets.ROLE[q[1]] == secrets.SECRET)
    return sorted(p[:3] for p in parts if p[1] < secrets.BASE or any(p[3] == q[3] and other(p, q) and gap(p, q) <= reach for q in parts))


def spans_of(rows):
    return {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rows.collect()}


def test_spans_equal_brute_force(spark):
    for reach in (5, 100):
        found = spans_of(secrets.find_secrets(documents(spark, TEXTS, schema=CLASHING), reach))
        assert len(found) == len(TEXTS)
        for i, text in enumerate(TEXTS):
            assert [s for s in found[i] if s[1] < secrets.BASE] == base_of(text)
            assert found[i] == linked_of(text, reach)
    assert [s[1] for s in found[8]] == [0, 3] and found[9] == [] and found[10] == []
    assert 4 not in [s[1] for s in found[11]]  # another paragraph
    assert {s[1] for s in found[12]} == {5, 6} and found[13] == []


def test_query_digest(spark, tmp_path):
    from pourscale.llm.queries import QUERIES

    documents(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op1_secret_linking"](spark, str(tmp_path)).collect():
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_of(TEXTS[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base_of(TEXTS[r["doc_id"]])) for k in range(3))


def test_redact_keeps_rows_and_clean_texts(spark):
    docs = documents(spark, TEXTS, schema=CLASHING)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts[7] == ("plain words", 11) and texts[5][0] is None and texts[6][0] == "" and texts[9][0] == TEXTS[9]
    assert texts[8] == ("<assign> <login>", 16) and HEX not in texts[0][0]


def test_empty_table(spark):
    assert secrets.find_secrets(empty(spark)).count() == 0 and secrets.redact(empty(spark)).count() == 0


def test_many_parts_in_one_scope(spark):
    text = " ".join(f"user=u{i}xyz password=hunter{i:04d}" for i in range(3000))
    found = spans_of(secrets.find_secrets(documents(spark, [text])))[0]
    assert len(found) == 6000 and sum(s[1] == 3 for s in found) == 3000
