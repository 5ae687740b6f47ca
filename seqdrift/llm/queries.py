"""Registered queries of the subpackage, each over its whole table, and the SQL of those that have one."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift.llm import decontaminate, language, licenses, lm, manifest, neardup, packing, quality, runs, secrets, sharding, suffixes, webtext
from seqdrift.llm.base import documents, remainder, shipped

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            shipped(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


OP8_SQL = """
with tab as (
  select list(c order by i) as tab from (
    select i, list_reduce(list_prepend(i::bigint, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
h as (select doc_id, source, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as hex from documents),
b as (
  select *, list_prepend(4294967295, list_transform(range(0, n),
    lambda i: ('0x' || substr(hex, (2 * i + 1)::bigint, 2))::bigint)) as bytes from h),
r as (
  select doc_id, n + 1 as size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) as crc,
    coalesce('=' || source, '') as stratum, md5('0:' || coalesce(doc_id::varchar, '')) as draw
  from b, tab),
f as (
  select *, (2 * row_number() over (partition by stratum order by draw, doc_id, crc, size) - 1)::double
    / (2.0 * count(*) over (partition by stratum))::double as fraction from r),
p as (select *, row_number() over (order by fraction, draw, doc_id, crc, size) - 1 as pos, count(*) over () as total from f),
s as (select *, (pos * 16) // total as shard from p)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'rows' as law, shard::int as shard,
  (pos - (shard * total + 15) // 16)::bigint as slot, null::int as grown_shard from s
"""


@query("op8_stratified_shards", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP10_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) as ls
  from documents),
g as (
  select doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
d as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, count(distinct i + k) as n from d, (values (0), (1), (2)) v(k) group by doc_id),
m as (
  select w.doc_id, len(ws)::bigint as n_words,
    length(regexp_replace(t, '[ \t\n\x0b\f\r]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words
  from w left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_words > 1000000 or n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)
    or 4 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines) as kept
from b
"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_policy(quality.ledger(documents(spark, sf_dir)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
k as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from k left join n using (doc_id)
"""


@query("op4_superminhash_groups", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


@query("op1_min_slack_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


OP6_SQL = r"""
with wd as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
wb as (
  select coalesce(item_id::varchar, '') as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from benchmark),
b as (
  select item, least(len(ws), 10) as k, array_to_string(ws[i : i + 9], ' ') as g
  from (select item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from wb where len(ws) > 0)),
k as (select distinct k from b),
d as (
  select doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') as g
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from wd, k where len(ws) >= k)),
h as (select distinct d.doc_id, d.k, d.i, b.item from d join b on d.g = b.g and d.k = b.k),
c as (
  select doc_id, count(distinct p) as n from
  (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, k, i from h)) group by doc_id),
t as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from h) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(t.n, 0)::bigint as n_items,
  sha256(coalesce(t.s, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from wd left join c using (doc_id) left join t using (doc_id)
"""


@query("op6_fm_index_decontamination", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_nearest_centroid_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language.predict(docs, language.fit(language.training_rows(docs)))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op3_recursive_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


@query("op7_hashed_maxent_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = lm.score(docs, lm.training_rows(docs))
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP5_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as ws from documents),
g as (
  select doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) as h
  from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as i from w where len(ws) >= 50)),
r as (select h from g group by h having min(doc_id) <> max(doc_id)),
k as (select distinct doc_id, i from g where h in (select h from r)),
s as (select *, i > lag(i) over (partition by doc_id order by i) + 50 as new from k),
n as (select *, sum(coalesce(new, true)::int) over (partition by doc_id order by i) as run from s)
select doc_id, min(i)::bigint as first_word, (max(i) + 50)::bigint as end_word, (max(i) + 50 - min(i))::bigint as n_words
from n group by doc_id, run
"""


@query("op5_repeated_passages", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir), length=50)


@query("op9_licence_paragraphs")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.find_licences(docs, licenses.train(docs))


OP13_SQL = r"""
with recursive tab as (
  select list(c order by i) as tab from (
    select i, list_reduce(list_prepend(i::bigint, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
d as (
  select *, 'd' || coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::varchar) + 1),
      lambda i: ord(substr(doc_id::varchar, i::bigint, 1))::bigint)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0 as even
  from documents, tab),
l as (
  select doc_id, source, sha256(substr(head, 2) || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(substr(head, 2) || case when text is null then '-' when even
      then strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') else strlen(text) || ':' || text end) as altered
  from d),
p as (select *, dense_rank() over (order by source nulls first) as g,
  row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from l),
t as (
  select g, 0 as lvl, pos, leaf as h from p
  union all
  select g, lvl + 1, q, sha256(string_agg(h, '' order by pos)) from (
    select *, pos // 3 as q, count(*) over (partition by g) as n from t) where n > 1 group by g, lvl, q),
s as (select g, max_by(h, lvl) as subroot, max(lvl) as height from t group by g),
u as (
  select 0 as lvl, g - 1 as pos, subroot as h from s
  union all
  select lvl + 1, q, sha256(string_agg(h, '' order by pos)) from (
    select *, pos // 3 as q, count(*) over () as n from u) where n > 1 group by lvl, q),
r as (select max_by(h, lvl) as root, max(lvl) as height from u),
a as (
  select p.g, p.pos, k.lvl, p.pos // (3 ** k.lvl)::bigint as own from p join s using (g), range(0, 40) k(lvl) where k.lvl < s.height),
b as (select s.g, k.lvl, (s.g - 1) // (3 ** k.lvl)::bigint as own from s, r, range(0, 40) k(lvl) where k.lvl < r.height),
x as (
  select a.g, a.pos, a.lvl, coalesce(string_agg(h, '' order by t.pos) filter (t.pos < own), '') || '|'
    || coalesce(string_agg(h, '' order by t.pos) filter (t.pos > own), '') as sides
  from a join t on t.g = a.g and t.lvl = a.lvl and t.pos // 3 = own // 3 group by all),
y as (
  select b.g, b.lvl, coalesce(string_agg(h, '' order by u.pos) filter (u.pos < own), '') || '|'
    || coalesce(string_agg(h, '' order by u.pos) filter (u.pos > own), '') as sides
  from b join u on u.lvl = b.lvl and u.pos // 3 = own // 3 group by all),
e as (select g, pos, list(sides order by lvl) as path from x group by all),
f as (select g, list(sides order by lvl) as path from y group by all),
o as (
  select p.*, subroot, root, list_concat(coalesce(e.path, []), coalesce(f.path, [])) as path
  from p join s using (g) left join e on e.g = p.g and e.pos = p.pos left join f on f.g = p.g, r),
z as (select *, list_reduce(list_prepend(altered, path),
  lambda c, x: sha256(split_part(x, '|', 1) || c || split_part(x, '|', 2))) as folded_root from o)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) as proof_sha256, folded_root,
  folded_root = root as verified
from z
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(manifest.manifest(documents(spark, sf_dir)))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.implanted(documents(spark, sf_dir))))


@query("op12_page_templates")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
