"""One registered query per operator, and the pipeline's."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import cut_to_table
from ..sources.tables import load
from . import backoff, divergence, imatch, jaccard, langmix, packing, phrases, pii, quality, reuse, secrets, shards, warc


def op1_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langmix.predict(docs, langmix.fit(docs))


def op4_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.op4_jump_hash(spark, load(spark, sf_dir, "documents"))


def op5_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_next(load(spark, sf_dir, "documents"))


def op7_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.encode_documents(load(spark, sf_dir, "documents"))


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(load(spark, sf_dir, "documents"))


def op9_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut_to_table(quality.text_stats(load(spark, sf_dir, "documents")))
    rules = quality.fit_list(stats, load(spark, sf_dir, "labels"))
    return quality.judge(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("base_failed"), F.col("kept"))


def op11_stripes_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(load(spark, sf_dir, "documents"))


def op13_skyband_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


def op12_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(load(spark, sf_dir, "documents")).withColumns(
        {c: F.round(c, 6) for c in ("base_score", "score")})


QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (
    op1_parity_jaccard, op2_skip_chain_pii, op3_language_mixture, op4_jump_hash, op5_boundary_chain, op6_imatch, op7_chunk_reuse, op8_trigram_secrets, op9_tiered_packing, op10_decision_list, op11_stripes_phrases, op13_skyband_divergence, op12_backoff_automaton)}

ORACLES: dict[str, str] = {
    "op1_parity_jaccard": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents),
shingle as (
  select distinct doc_id, unnest(
    case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
         else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) as s
  from words),
size as (select doc_id, count(*) as n from shingle group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k
  from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (
  select a, b from shared join size x on x.doc_id = a join size y on y.doc_id = b
  where 100 * k >= 85 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach as (
  select doc_id as id, doc_id as c from documents
  union
  select edge.b, reach.c from reach join edge on reach.id = edge.a),
low as (select id, min(c) as component_id from reach group by id)
select d.doc_id, cast(coalesce(size.n, 0) as bigint) as n_shingles, low.component_id
from documents d left join size on size.doc_id = d.doc_id join low on low.id = d.doc_id""",
    "op4_jump_hash": r"""
with recursive step(doc_id, n, k, b, j) as (
  select doc_id, n, ((coalesce(doc_id, 0)::hugeint % 18446744073709551616) + 18446744073709551616) % 18446744073709551616,
         cast(-1 as bigint), cast(0 as bigint) from documents, (values (16), (17)) v(n)
  union all
  select doc_id, n, kk, j, cast(floor((j + 1) * (2147483648::double / (kk // 8589934592 + 1)::double)) as bigint)
  from (select *, (k * 2862933555777941757 + 1) % 18446744073709551616 as kk from step where j < n) s),
place as (select doc_id, n, b as shard from step where j >= n),
crc as (
  select [list_reduce(range(8), lambda a, k: case when (a & 1) = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i::bigint) for i in range(256)] as t),
bytes as (
  select doc_id, [('0x' || substr(h, 2 * i + 1, 2))::bigint for i in range(length(h) // 2)] as c
  from (select doc_id, hex(encode(coalesce(text, ''))) as h from documents) x)
select d.doc_id, cast(len(c) + 1 as bigint) as size,
  cast(xor(coalesce(list_reduce(c, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295), 4294967295) as bigint) as text_crc32,
  'key' as law, cast(p.shard as integer) as shard,
  row_number() over (partition by p.shard order by d.doc_id) - 1 as slot, cast(q.shard as integer) as grown_shard
from crc, documents d join bytes on bytes.doc_id = d.doc_id
join place p on p.doc_id = d.doc_id and p.n = 16 join place q on q.doc_id = d.doc_id and q.n = 17""",
    "op5_boundary_chain": r"""
with payload as (
  select page_id, octet_length(encode(coalesce(html, ''))) as size, sha1(coalesce(html, '')) as x from pages),
first as (select x, size, min(page_id) as low from payload group by all)
select page_id, cast(p.size as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((('0x' || substr(p.x, 1 + 5 * (i // 4), 5))::bigint >> cast(15 - 5 * (i % 4) as integer)) & 31 as integer), 1) for i in range(32)], '') as payload_digest,
  case when page_id <> low then 'revisit' else 'response' end as record_type,
  case when page_id <> low then low end as refers_to
from payload p join first f on f.x = p.x and f.size = p.size""",
    "op11_stripes_phrases": r"""
with piece as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
  from documents),
pos as (select lang, w, unnest(range(1, len(w) + 1)) as i from piece),
gram as (
  select lang, k, w[i] as x, case when k > 1 then w[i + 1] end as y, case when k > 2 then w[i + 2] end as z, count(*) as a
  from pos, (values (1), (2), (3)) s(k) where i + k - 1 <= len(w) group by all),
size as (select lang, sum(a) as n from gram where k = 1 group by lang),
one as (select lang, x, a from gram where k = 1),
two as (select lang, x, y, a from gram where k = 2 and a >= 10),
three as (select lang, x, y, z, a from gram where k = 3 and a >= 10),
cut as (
  select t.lang, t.x || ' ' || t.y as phrase, t.a, 1 as k, p.a as l, q.a as r
  from two t join one p on p.lang = t.lang and p.x = t.x join one q on q.lang = t.lang and q.x = t.y
  where not exists (select 1 from three u where u.lang = t.lang and 100 * u.a >= 50 * t.a
                    and ((u.x = t.x and u.y = t.y) or (u.y = t.x and u.z = t.y)))
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 1, p.a, q.a
  from three t join one p on p.lang = t.lang and p.x = t.x join two q on q.lang = t.lang and q.x = t.y and q.y = t.z
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 2, p.a, q.a
  from three t join two p on p.lang = t.lang and p.x = t.x and p.y = t.y join one q on q.lang = t.lang and q.x = t.z),
scored as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from cut),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from lowest)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, score
from ranked join size using (lang) where rank <= 2000""",
    "op13_skyband_divergence": r"""
with d as (
  select row_number() over () as i, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
word as (
  select i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
per_doc as (select lang, source, term, i, count(*) as n from word group by all),
kept as (select lang, term, sum(n) as total from per_doc group by lang, term having count(*) >= 3),
cnt as (select p.lang, p.source, p.term, sum(p.n) as n from per_doc p join kept k on k.lang = p.lang and k.term = p.term group by all),
grp as (select distinct lang, source from d),
v as (select l.lang, count(k.term) as v, coalesce(sum(k.total), 0) as n from (select distinct lang from d) l left join kept k on k.lang = l.lang group by l.lang),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from grp g left join cnt c on c.lang = g.lang and c.source = g.source group by all),
share as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as c,
         cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + v.v) as hugeint) as p,
         cast(1 + (1000000000::hugeint * (k.total + 1)) // (v.n + v.v) as hugeint) as q
  from gn g join v on v.lang = g.lang join kept k on k.lang = g.lang left join cnt c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from share a join share b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(p.value, 0) as bigint) as value
  from grp a join grp b on b.lang = a.lang and b.source <> a.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
term as (
  select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // q as bigint) as value from share where c > 0 and p > q),
ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank
  from (select * from pair union all select * from term) x)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200""",
    "op12_backoff_automaton": r"""
with crc as (
  select [list_reduce(range(8), lambda a, k: case when (a & 1) = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i::bigint) for i in range(256)] as t),
doc as (
  select row_number() over () as i, doc_id, coalesce(xor(list_reduce(
      [('0x' || substr(hex(encode(doc_id::varchar)), 2 * j + 1, 2))::bigint for j in range(length(doc_id::varchar))],
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 5 = 1, false) as held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x20\x09-\x0D]+'), ' ') as w
  from documents, crc),
tok as (select i, doc_id is not null and not held_out as learn, w[j] as y, case when j = 1 then '' else w[j - 1] end as x
        from (select *, unnest(range(1, len(w) + 1)) as j from doc) d),
two as (select x, y, count(*) as c from tok where learn group by all),
one as (select y, sum(c) as c from two group by y),
state as (select x, sum(c) as c, count(*) as t from two group by x),
size as (select coalesce(sum(c), 0) as n, count(*) as v from one),
step as (
  select k.i, coalesce(o.c, 0) as c, (coalesce(o.c, 0) + 0.5::double) / (n + 0.5::double * (v + 1)) as p, s.c as sc, s.t as st, p2.c as pc, n
  from tok k cross join size left join one o on o.y = k.y left join state s on s.x = k.x left join two p2 on p2.x = k.x and p2.y = k.y),
total as (
  select i, count(*) as n_tokens, count(*) filter (where c > 0) as n_known, any_value(n) as n, fsum(log10(p)) as base_score,
         fsum(log10(case when pc is not null then (pc + st * p) / (sc + st) when sc is not null then st * p / (sc + st) else p end)) as score
  from step group by i)
select doc_id, held_out, n_tokens, n_known, cast(n as bigint) as train_tokens, round(base_score, 6) as base_score, round(score, 6) as score
from doc join total using (i)""",
}
