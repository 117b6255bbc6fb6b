"""Small hand-made tables for the tests of this folder."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that share names with what the operators make.
CLASHING = DOCS + ", key string, parts string, spans string, taken int, language int, fp int, shard int, size int"


def documents(spark, texts, langs=None, sources=None, schema=DOCS):
    rows = []
    for i, text in enumerate(texts):
        row = (i, text, (langs or ["en"])[i % len(langs or ["en"])], (sources or ["a"])[i % len(sources or ["a"])], len(text or ""))
        rows.append(row + ("x", "x", "x", 1, 1, 1, 1, 1) if schema == CLASHING else row)
    return spark.createDataFrame(rows, schema)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)
