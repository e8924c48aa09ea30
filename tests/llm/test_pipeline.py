import re

from helpers import labels, rows

import corpus_pipeline
from quern.llm import queries


def test_stages(spark, tmp_path):
    clean = ["the cat number %d sat on a mat and " % i + " ".join(f"word{j}" for j in range(i * 50, i * 50 + 60)) for i in range(30)]
    junk = ["THE!! CAT!! NUMBER!! %d!! " % i + " ".join(f"WORD{j}!!" for j in range(i, i + 60)) for i in range(30)]
    extra = [clean[0], clean[1].replace(" ", "  "), clean[2] + " password = hunter2hunter2", None, ""]
    data = [(i, t, "en", "src0", len(t or ""), 7) for i, t in enumerate(clean + junk + extra)] + [(65, clean[0], "en", "src0", 1, 7)] * 2
    folder = f"file:{tmp_path}/t"
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept int").write.parquet(f"{folder}/documents.parquet")
    labels(spark, [(i, int(i < 30), 0, "x", 0.0) for i in range(60)]).write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/out{k}"
        stage(spark, docs, folder).write.parquet(out)
        if name != "packing":
            assert spark.read.parquet(out).columns == docs.columns
        docs = spark.read.parquet(out)
        kept.append({r[0] for r in rows(docs, "doc_id")})
    assert set(range(30)) - {1} <= kept[0] and not kept[0] & set(range(30, 60))
    assert 61 in kept[1] and 1 not in kept[1] and not kept[1] & {60, 65}  # the longer copy stays
    assert kept[2] <= kept[1] and kept[3] == kept[2]
    masked = dict(rows(spark.read.parquet(f"{folder}/out3"), "doc_id", "text"))
    assert 62 in masked and masked[62].endswith("[SECRET]") or 62 not in kept[2] and 2 in kept[2]
    assert kept[4] == kept[3] and corpus_pipeline.run(spark, folder).count() == docs.count()


def test_empty_tables_and_rows_without_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, start int"
    for name, data in (("none", []), ("unnamed", [(None, "some words here and there " * 5, "en", "s", 1, 0), (None, None, None, None, None, None), (None, "other words", "en", "s", 1, 0), (None, "other words", "en", "s", 1, 0), (3, "other words", "en", "s", 1, 0)])):
        folder = f"file:{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        labels(spark, []).write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert len(got) == 0 if not data else sorted((r.doc_id is None, r.doc_tokens) for r in got)[0] == (False, 3)
        if data:  # one row of each text: of "other words" the one with an id
            assert sum(r.doc_id is None for r in got if r.start == 0) == 2


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
