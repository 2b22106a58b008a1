"""Registered queries and the pipeline on the driver's tables."""
import hashlib
import os
import sys
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from finlake.llm import chat, decontam, langid, ngram_join, packing, quality_crf, queries, secrets_scan

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_similarity_operators import join_by_pairs  # noqa: E402
from test_text_operators import check_packing, plain_hits  # noqa: E402

SF, SF_L = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(cur.fetchall())


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


def test_quality_on_held_out_documents(spark):
    out = queries.QUERIES["op7_quality_classifier"](spark, SF_L)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    docs = table(spark, "documents", SF_L).count()
    assert len(rows) == docs
    labels = {r.doc_id: r.quality for r in table(spark, "labels", SF_L).collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [i for i in labels if rows[i].held_out]
    assert sum(rows[i].predicted == labels[i] for i in held) / len(held) > 0.95


def test_quality_odd_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (None, 1, "x"), (4, None, "x"), (1, 1, "x")], "doc_id long, quality int, text string")
    docs = frame([(1, "A good line.\nAnother one."), (3, "$$$ ### $$$"), (None, "x"), (5, None), (6, ""), (7, " \n "), (1, "again"), (8, "w " * 90000)],
                 extra=("score", "predicted", "_", "row"))
    out = quality_crf.score_quality(docs, labels)
    rows = out.collect()
    assert len(rows) == 8 and out.columns == ["doc_id", "text", "_", "row", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.doc_id in (5, 6, 7)} == {0.0}
    assert quality_crf.score_quality(docs.limit(0), labels).collect() == []
    assert quality_crf.score_quality(docs, labels.limit(0)).count() == 8


def test_quality_does_not_learn_from_held_out_labels(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    turned = labels.withColumn("quality", F.when(quality_crf.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_crf.score_quality(docs, x, keep=["doc_id"]).collect())) for x in (labels, turned))
    assert a == b


def test_language_on_held_out_documents(spark):
    out = queries.QUERIES["op8_language_id"](spark, SF_L)
    lang = {r.doc_id: r.lang for r in table(spark, "documents", SF_L).collect()}
    rows = [r for r in out.collect() if r.held_out]
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_code_switched_words(spark):
    docs = table(spark, "documents", SF_L)
    names, weights, move = langid.train(docs)
    held = docs.where(quality_crf.held_out("doc_id"))
    import pyarrow as pa
    en = held.where("lang = 'en' and n_chars > 600").first().text[:400]
    de = held.where("lang = 'de' and n_chars > 600").first().text[:400]
    words, p = langid.label_words(pa.array([en + " " + de]), weights, move)
    half = len(langid._Words(pa.array([en])).word)
    assert (p[:half - 3].argmax(1) == names.index("en")).mean() > 0.9
    assert (p[half + 3:].argmax(1) == names.index("de")).mean() > 0.9


def test_language_odd_rows(spark):
    rows = [(1, "the house and the garden", "en"), (3, "das Haus und der Garten", "de"), (None, "the", "en"), (4, None, "de"), (5, "", "en"),
            (7, "123 456 !!", "en"), (8, "\u2014 \u2026", None), (9, "\u4e2d\u6587", None), (1, "the", None), (10, "und " * 60000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, id string")
    out = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {i for i, p in out if p == "und"} == {4, 5, 7, 8} and (10, "de") in out
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_stages(spark):
    """The pipeline's decisions again, stage by stage, by plain Python on what
    the classifier keeps."""
    docs = table(spark, "documents")
    kept = {r.doc_id: r for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    pairs = join_by_pairs_of(sorted((i, r.text) for i, r in kept.items()))
    single = {i: t for i, t in pairs}
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    return kept, {i: t for i, t in single.items() if plain_hits(t, items)[1] == 0}


def join_by_pairs_of(docs):
    import test_similarity_operators as s
    old = s.sets
    s.sets = lambda d, k=5: old(d, 5)
    try:
        comp = {i: c for (i, _, c) in join_by_pairs(docs, 80)}
    finally:
        s.sets = old
    return [(i, t) for i, t in docs if comp[i] == i]


def test_pipeline_stages(spark):
    kept, clean = plain_stages(spark)
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    assert sum(labels[i] == 1 for i in kept if i in labels) / max(1, sum(i in labels for i in kept)) > 0.95
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(clean)
    masked = {i: mask(t) for i, t in clean.items()}
    check_packing(rows, list(masked.items()))


def mask(text):
    from test_text_operators import base
    covered = [False] * len(text)
    spans = [(s, e) for _, s, e in base(text)]
    for m in __import__("re").finditer(r"[A-Za-z0-9+/_.=-]+", text):
        spans += [(m.start() + a, m.start() + b) for a, b in secrets_scan.entropy_spans(m[0])]
    out, at = [], 0
    for s, e in sorted(spans):
        if e > at:
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = e
    return "".join(out) + text[at:]


def test_pipeline_keeps_columns(spark):
    docs = table(spark, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()


def test_quality_stage_keeps_documents_without_both_labels(spark, tmp_path):
    docs, labels = table(spark, "documents").limit(40), table(spark, "labels")
    for name, some in (("none", labels.limit(0)), ("good", labels.where("quality = 1"))):
        some.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.keep_quality(spark, docs, f"{tmp_path}/{name}").count() == 40
