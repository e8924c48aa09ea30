"""Small tables with the rows that break things: nulls, empty and odd texts, ties, repeated rows, clashing columns."""

import zlib

LONG = "word " * 30_000
ODD = ["", None, " \t\n\x0b\x0c\r ", "a", "Same text here now", "Same  text here\nnow", "same text here now", "ﬁ Straße é \U0001f600  x", "nul\0 in it"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, kept string, shard int, fp long, row int, key int, start int"


def documents(spark, texts=None, first=0, repeat=True):
    texts = [*ODD, LONG] if texts is None else texts
    rows = [(first + i, t, "en", f"src{i % 3}", len(t or ""), "h", "k", 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    if repeat and rows:
        rows += [rows[0], rows[-1], (None, "no id", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string, score double")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
