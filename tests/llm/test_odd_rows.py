"""Every operator and stage over odd rows, extra columns with clashing names, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqdrift.llm import decontaminate, language, licenses, lm, neardup, packing, quality, secrets, sharding, suffixes
from seqdrift.llm.queries import tokenizer_path


def bench(spark, rows=((1, "one"), (2, None), (3, ""), (None, "zebra crossing"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


RUNS = {
    "pack": (lambda s, d: packing.pack(d, tokenizer_path()), None),
    "language": (lambda s, d: language.predict(d, language.fit(language.training_rows(d))), 13),
    "secrets": (lambda s, d: secrets.find_secrets(d), 13),
    "neardup": (lambda s, d: neardup.near_duplicates(d), 13),
    "suffixes": (lambda s, d: suffixes.repeated_passages(d), 2),
    "decontaminate": (lambda s, d: decontaminate.contamination(d, bench(s)), 13),
    "lm": (lambda s, d: lm.score(d, lm.training_rows(d), rounds=1), 13),
    "shards": (lambda s, d: sharding.interleave(d), 13),
    "licences": (lambda s, d: licenses.find_licences(d, licenses.train(d)), None),
    "quality": (lambda s, d: quality.apply_policy(quality.ledger(d)), 13),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_clashing_columns(spark, table, odd_rows, name):
    run, n = RUNS[name]
    docs = table([(*r, "en" if i % 2 else None, "s") for i, r in enumerate(odd_rows)])
    for extra in ("n", "n_words", "band", "sequence_id", "row", "run", "kept", "_tail", "fraction", "text_key", "a"):
        docs = docs.withColumn(extra, F.lit("clash"))
    rows = run(spark, docs).collect()
    assert n is None or len(rows) == n


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, table, name):
    assert RUNS[name][0](spark, table([])).collect() == []


def test_stages_keep_columns_and_empty_tables(spark, table, odd_rows, tmp_path):
    bench(spark, []).write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd_rows, []):
        docs = table(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()


def test_quality_of_blank_texts(spark, table):
    rows = {r.doc_id: r for r in quality.apply_policy(quality.ledger(table([(1, None), (2, ""), (3, " \n\t")]))).collect()}
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows.values())


def test_language_of_texts_without_letters(spark, table):
    docs = table([(i, t, "en", None) for i, t in enumerate([None, "", "12 34 !", "the cat and the dog"])])
    rows = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert [rows[i].lang_pred for i in range(4)] == ["und", "und", "und", "en"]
    assert all(rows[i].rejected and rows[i].score == 0 for i in range(3))
    nothing = language.fit(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
