"""Registered queries against their SQL, and the pipeline against a plain version, over a small given table."""

import os
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from checks.run import compare, database
from seqdrift.llm import language, secrets
from seqdrift.llm.base import documents
from seqdrift.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.test_neardup import plain
from tests.llm.test_passages import plain_contamination

DIR = os.environ.get("SEQDRIFT_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, DIR)
    found = database(DIR).execute(ORACLES[name])
    assert compare((df.columns, [tuple(r) for r in df.collect()]), ([c[0] for c in found.description], found.fetchall())) == ""


def test_pipeline_equals_a_plain_version(spark):
    docs = documents(spark, DIR)
    model = language.fit(language.training_rows(docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if language.classify([r[1]], model)[2][0]]
    groups = plain(rows)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    dirty = plain_contamination(rows, items)
    rows = [(i, secrets.redacted(t, "[secret]")) for i, t in rows if not dirty[i][4]]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = set()
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 1024):
            own = ids[a : a + 1024]
            want.add((i, a, len(own), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in own)), len(ids)))
    got = corpus_pipeline.run(spark, DIR).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert len(rows) > 100
