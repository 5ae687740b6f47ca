import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqdrift.llm import neardup
from seqdrift.llm.words import NOT_SPACE, slices, words_of


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(docs, percent=75):
    sets, parent = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(draw, words, share):
    return [f"new{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


def check(docs, table):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(docs, 4)).collect()}
    assert got == plain(docs)


def test_groups_equal_the_plain_version(table):
    draw, docs = random.Random(1), []
    for g in range(25):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([3, 5, 30, 200]))]
        for _ in range(draw.choice([1, 2, 6])):
            docs.append(" ".join(edited(draw, words, draw.choice([0, 0.005, 0.02, 0.1]))))
    docs += ["", None, "one two", "ONE  two", "one two three", *["same text in many copies here"] * 7]
    draw.shuffle(docs)
    check(list(enumerate(docs)), table)


@pytest.mark.parametrize("block", [256, 8])
def test_a_dense_group_of_almost_similar_documents(table, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    draw = random.Random(2)
    words = [f"w{draw.randrange(4000)}" for _ in range(120)]
    check([(i, " ".join(edited(draw, words, draw.choice([0.01, 0.025, 0.04])))) for i in range(150)], table)


def test_signatures_estimate_similarity():
    draw = random.Random(3)
    m, estimates = 96, []
    base = [f"w{i}" for i in range(400)]
    for _ in range(20):
        pair = [" ".join(base), " ".join(edited(draw, base, 0.03))]
        [texts] = slices(pa.array(pair))
        sets, owner = neardup.shingle_sets(words_of(texts, NOT_SPACE), 5)
        sig = neardup.superminhash(sets, owner, 2, m)
        a, b = map(shingles, pair)
        estimates.append((sig[0] == sig[1]).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(estimates)) < 0.03


@pytest.mark.parametrize("n", [1, 3, 50, 2000])
def test_signatures_of_a_set_do_not_depend_on_its_neighbours(n):
    elements = neardup.stream(9, n + 40)
    alone = neardup.superminhash(elements[:n], np.zeros(n, int), 1, 96)
    owner = np.repeat([0, 1], [n, 40])
    assert (neardup.superminhash(elements, owner, 2, 96)[0] == alone[0]).all()
    assert alone.max() < 96 and len(np.unique(alone)) == 96


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.doc_id: r.component_id for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_few_texts_without_a_partner_are_dealt_out(spark):
    docs = spark.range(20_000).select((F.col("id") * 7 - 50_000).alias("doc_id"), F.lit("x").alias("text"))
    docs = docs.union(spark.sql("select cast(null as bigint), 'x'"))
    wanted = docs.where("doc_id % 10 = 0").select("doc_id")
    found = neardup.perhaps(docs, wanted)
    assert found.columns == docs.columns
    assert found.join(wanted, "doc_id", "left_semi").count() == wanted.count()
    assert found.count() < wanted.count() + 100
    assert neardup.perhaps(docs, wanted.limit(0)).count() == 0
    named = docs.where("doc_id is not null").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert neardup.perhaps(named, named.select("doc_id")).count() == 20_000


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_the_stage_deals_out_few_texts_of_documents_that_stay(spark, table, monkeypatch):
    """Repeated rows count once, rows without an id stay, and of the others only those that may go are shuffled with their texts."""
    rows = [(i, f"text {i}") for i in range(3000)] + [(i, f"text {i}") for i in range(2000, 2010)] + [(2000, "other"), (None, "a"), (None, "a"), (None, None)]
    group = F.when(F.col("doc_id") % 100 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    found = lambda docs: docs.select("doc_id", F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept"))
    monkeypatch.setattr(neardup, "near_duplicates", found)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = corpus_pipeline.keep_one_of_each_group(spark, corpus_pipeline.written(table(rows), "rows"), "")
        got = out.collect()
        dealt = 0
        for node in nodes(out._jdf.queryExecution().executedPlan()):
            if node.nodeName() == "Exchange" and "text#" in node.output().mkString(" "):
                dealt += node.metrics().apply("shuffleRecordsWritten").value()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted({r for r in rows if r[0] is not None and r[0] % 100 != 1})
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 3
    assert 0 < dealt < 200


def test_links_become_stars_around_the_smallest_id():
    draw = random.Random(4)
    for n, kind in [(1, int), (40, int), (400, int), (400, str)]:
        pairs = [(kind(draw.randrange(n)), kind(draw.randrange(n))) for _ in range(n)] + [(kind(3), kind(5))]
        v, u = neardup.contracted(*(np.array(x, object if kind is str else np.int64) for x in zip(*pairs)))
        group = {i: {i} for p in pairs for i in p}
        for a, b in pairs:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for i in group[b]:
                    group[i] = group[a]
        assert dict(zip(v, u)) == {i: min(g) for i, g in group.items() if i != min(g)}
        assert len(v) == len(set(v))


@pytest.mark.parametrize("shape", ["path", "random", "hub"])
def test_components_of_links_dealt_over_many_tasks(spark, table, shape):
    draw = random.Random(5)
    links = {
        "path": [(i, i + 1) for i in range(600) if i != 300],
        "random": [(draw.randrange(700), draw.randrange(700)) for _ in range(500)],
        "hub": [(10_000, i) for i in range(400)] + [(i, i + 500) for i in range(0, 400, 7)],
    }[shape]
    v, u = neardup.contracted(*np.array(links).T)
    want = {**{int(i): int(i) for i in u}, **{int(i): int(j) for i, j in zip(v, u)}}
    rows = neardup.components(spark.createDataFrame(links, "a long, b long").repartition(40)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and len(rows) == len(want)


def test_shuffles_of_a_whole_run_stay_few(spark, table):
    """Groups of exact and near copies, buckets left in several components: what each shuffle costs at least must not add up."""
    draw, docs = random.Random(6), []
    for _ in range(12):
        words = [f"w{draw.randrange(4000)}" for _ in range(120)]
        docs += [" ".join(edited(draw, words, draw.choice([0, 0.01, 0.025, 0.04]))) for _ in range(25)]
    rows, partitions = table(list(enumerate(docs)), 4), 23
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("shuffles", "")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows).collect()}
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("shuffles") for s in tracker.getJobInfo(job).stageIds}
        infos = [tracker.getStageInfo(s) for s in stages]
        full = sum(i is not None and i.numCompletedTasks == partitions for i in infos)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain(list(enumerate(docs)))
    assert 0 < full <= 30
