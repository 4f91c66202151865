"""The corpus queries as registered for the driver: thin calls of the operators with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, codebooks, decontaminate, html, language, mixing, neardup, repeats, secrets, topk, tries, warc
from spanloom.llm.common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.identify(rows, language.train(docs), keep=["doc_id", "held_out"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), repeats.sentence_rule(), keep=["doc_id", "text"]).withColumnsRenamed({"n_units": "n_sentences"})


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), repeats.line_rule(), keep=["doc_id", "text"]).withColumnsRenamed({"n_units": "n_lines"})


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.encode_decode(_read(spark, sf_dir, "documents"), f.read(), keep=["doc_id"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"), keep=["doc_id"], redacted=False)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "archives").path("warc")
    return warc.read_pages(spark, warc.write(_read(spark, sf_dir, "pages"), folder)).drop("url")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(_read(spark, sf_dir, "embeddings"))


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_topk": op3_exact_topk,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_html_text": op8_html_text,
    "op9_near_dedup": op9_near_dedup,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_mix_sources": op12_mix_sources,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

_LINES = """
with parts as (
  select d.doc_id, d.text, u.pos, u.part, trim(u.part, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) as key
  from documents d, lateral (select unnest(string_split(d.text, chr(10))) as part, unnest(range(len(string_split(d.text, chr(10))))) as pos) u
),
units as (select *, row_number() over (partition by doc_id order by pos) as unit from parts where key <> ''),
runs as (
  select a.doc_id, a.unit as f, a.unit + 2 as l, a.key || chr(10) || b.key || chr(10) || c.key as body
  from units a join units b on a.doc_id = b.doc_id and b.unit = a.unit + 1 join units c on a.doc_id = c.doc_id and c.unit = a.unit + 2
),
later as (select doc_id, f, l from (select *, row_number() over (partition by body order by doc_id, f) as k from runs) where k > 1),
gone as (select distinct u.doc_id, u.pos from units u join later r on u.doc_id = r.doc_id and u.unit between r.f and r.l),
kept as (select p.doc_id, string_agg(p.part, chr(10) order by p.pos) as text from parts p anti join gone g on p.doc_id = g.doc_id and p.pos = g.pos group by p.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
  (select count(*) from units u where u.doc_id = d.doc_id) as n_lines, (select count(*) from gone g where g.doc_id = d.doc_id) as n_removed
from documents d left join kept k on k.doc_id = d.doc_id
"""

_SENTENCES = """
with parts as (
  select d.doc_id, u.pos, u.part, trim(regexp_replace(case when u.part = chr(10) then '' else u.part end, '[ \\t\\r\\f\\v]+', ' ', 'g')) as key
  from documents d, lateral (
    select unnest(regexp_extract_all(d.text, '[^.!?\\n]*[.!?]+|[^.!?\\n]+|\\n')) as part, unnest(range(len(regexp_extract_all(d.text, '[^.!?\\n]*[.!?]+|[^.!?\\n]+|\\n')))) as pos) u
),
units as (
  select *, row_number() over w as unit, sum(length(key) - length(replace(key, ' ', '')) + 1) over w as total
  from parts where key <> '' window w as (partition by doc_id order by pos)
),
long_enough as (
  select a.doc_id, a.unit as f, b.unit as l
  from units a join units b on a.doc_id = b.doc_id and b.unit between a.unit + 1 and a.unit + 15
  where b.total - a.total + length(a.key) - length(replace(a.key, ' ', '')) + 1 >= 16
),
runs as (select doc_id, f, min(l) as l from long_enough group by doc_id, f union select doc_id, max(f) as f, l from long_enough group by doc_id, l),
bodies as (
  select r.doc_id, r.f, r.l, string_agg(u.key, chr(10) order by u.unit) as body
  from runs r join units u on u.doc_id = r.doc_id and u.unit between r.f and r.l group by r.doc_id, r.f, r.l
),
later as (select doc_id, f, l from (select *, row_number() over (partition by body order by doc_id, f, l) as k from bodies) where k > 1),
gone as (select distinct u.doc_id, u.pos from units u join later r on u.doc_id = r.doc_id and u.unit between r.f and r.l),
kept as (select p.doc_id, string_agg(p.part, '' order by p.pos) as text from parts p anti join gone g on p.doc_id = g.doc_id and p.pos = g.pos group by p.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
  (select count(*) from units u where u.doc_id = d.doc_id) as n_sentences, (select count(*) from gone g where g.doc_id = d.doc_id) as n_removed
from documents d left join kept k on k.doc_id = d.doc_id
"""

_WINDOWS = """
with forms as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
),
windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') as body
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from items where len(w) > 0)
),
sizes as (select distinct size from windows),
places as (
  select doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') as body
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p from forms, sizes)
),
found as (select doc_id, p, size, item_id from places join windows using (size, body)),
hit as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + size)) as q from found) group by doc_id),
who as (select doc_id, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from found group by doc_id)
select f.doc_id, cast(len(f.w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(who.n, 0) as n_items, sha256(coalesce(who.ids, '')) as items_sha256, hit.n is not null as contaminated
from forms f left join hit using (doc_id) left join who using (doc_id)
"""

_INNER = """
with codes as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from codes q join codes c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 10
"""

_NEAR = """
with recursive forms as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
),
shingles as (
  select distinct doc_id, array_to_string(w[p:p + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from forms where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
link as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a, min(b) as m from reach group by a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.m as component_id, d.doc_id = l.m as kept
from documents d join least l on l.a = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""

_ARCHIVE = """
with rows as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
digests as (
  select page_id, html, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as bigint), 1)), '') as payload_digest,
    min(page_id) over (partition by html) as first
  from rows
)
select page_id, octet_length(encode(html)) as payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from digests
"""

_START = """
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
parts as materialized (select vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] as v from kept, (select unnest(range(4)) as p)),
b0 as materialized (select p, e, v from (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from parts) where e < 256)"""

_ASSIGN = """,
a{r} as materialized (
  select x.vec_id, x.p, any_value(x.v) as v,
    min(struct_pack(d := list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v), e := b.e)) as best
  from parts x join b{r} b using (p) group by x.vec_id, x.p
)"""

_UPDATE = """,
b{n} as materialized (
  select p, e, coalesce(m.v, b.v) as v from b{r} b left join (
    select p, e, list(x order by i) as v from (
      select p, best.e as e, i, floor(sum(v[i]) / count(*)) as x from (select p, best, v, unnest(range(1, len(v) + 1)) as i from a{r}) group by p, best.e, i) group by p, e
  ) m using (p, e)
)"""

_CODES = """,
codes as (select vec_id, string_agg(printf('%02x', best.e), '' order by p) as code, cast(sum(best.d) as bigint) as error from a4 group by vec_id),
books as (select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by p, e, i)) as digest from (select p, e, unnest(v) as x, unnest(range(len(v))) as i from b4))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select digest from books) as codebooks_sha256, label
from codes join kept using (vec_id)
"""

_LLOYD = _START + "".join(_ASSIGN.format(r=r) + _UPDATE.format(r=r, n=r + 1) for r in range(4)) + _ASSIGN.format(r=4) + _CODES

_TRIE = """
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as k
  from conversations where conv_id is not null
),
convs as (
  select conv_id, conv_id - conv_id % 5 as base, xor(4294967295, list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
    lambda c, b: list_reduce(range(8), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(c, b)), cast(4294967295 as bigint))) % 9 as h
  from (select distinct conv_id from own)
),
built as (
  select c.conv_id, 0 as part, k, role, text from convs c join own o on o.conv_id = c.base and o.k <= c.h
  union all select c.conv_id, 1 as part, k, role, text from convs c join own o on o.conv_id = c.conv_id and o.k > c.h
),
paths as (
  select c.conv_id, coalesce(list(md5(length(role) || ':' || role || text) order by part, k) filter (part is not null), []) as d, list(octet_length(encode(text)) order by part, k) filter (part is not null) as b
  from convs c left join built using (conv_id) group by c.conv_id
),
starts as materialized (
  select conv_id, depth, len(d) = depth as ends, array_to_string(d[1:depth], ',') as key, array_to_string(d[1:depth - 1], ',') as above, case when depth > 0 then b[depth] else 0 end as size
  from paths, lateral (select unnest(range(len(d) + 1)) as depth)
),
nodes as materialized (
  select depth, key, min(conv_id) as conv_id, any_value(above) as above, count(*) as n_convs, any_value(size) as size,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
  from starts group by depth, key
),
kids as (select depth - 1 as depth, above as key, count(*) as n_children from nodes where depth > 0 group by depth, above),
sums as (
  select s.depth, s.key, count(*) filter (k.key is null) as n_leaves, sum((n.n_convs - 1) * n.size) as saved
  from nodes n join starts s on s.conv_id = n.conv_id and s.depth <= n.depth left join kids k on k.depth = n.depth and k.key = n.key group by s.depth, s.key
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from nodes n join sums s using (depth, key) left join kids k using (depth, key) left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.key = n.above
"""

ORACLES: dict[str, str] = {
    "op11_vector_codes": _LLOYD,
    "op13_prefix_trie": _TRIE,
    "op3_exact_topk": _INNER,
    "op9_near_dedup": _NEAR,
    "op10_warc": _ARCHIVE,
    "op2_substring_dedup": _SENTENCES,
    "op4_line_dedup": _LINES,
    "op6_decontamination": _WINDOWS,
}
