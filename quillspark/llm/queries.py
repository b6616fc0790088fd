"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, clustering, fingerprint, htmltext, knn, langid, linededup, mixing, neardup, phrases, sigtree, suffixdedup, tokencount
from quillspark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.assign_positions(docs, mixing.ranked_schedule(docs))
    return mixed.orderBy(F.get("occurrences", F.lit(0))["position"], "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return f.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.digest(F.col("vector")).alias("fingerprint"),
        fingerprint.digest(F.col("edited_vector")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        fingerprint.likeness(F.col("vector"), F.col("next_sketch")).alias("near_next"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_topk_search": op2_topk_search,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_main_text": op6_main_text,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_phrases": op11_phrases,
    "op12_clustering": op12_clustering,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE: dict[str, str] = {}
ORACLE["op1_mixing"] = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         coalesce(md5(doc_id::varchar), '') as k
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 2 * source_size as cap, [3.0, 1.0, 2.0][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::double as weight from s),
o as (select coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as before,
             sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following)::double as after,
             (sum(source_size) over ())::double * 1.5 as budget from w),
l as (select max((budget - before) / after) as level from o),
t as (select source, source_size, least(coalesce(weight * level, cap::double), cap::double) as target from w, l),
p as (
  select d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls last, d.size rows between unbounded preceding and 1 preceding), 0) as start,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as passes
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, floor(target - passes * source_size) - start)))::bigint as taken
from p
"""
ORACLE["op2_topk_search"] = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q, true), lambda z: z[1] * z[2])), 0)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 10
"""
ORACLE["op5_near_duplicates"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when ws is null or len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as sh
  from w),
n as (select doc_id, len(sh)::bigint as n_shingles from s),
e as (select doc_id, unnest(sh) as g from s),
r as (select g from e group by g having count(*) > 1),
f as (select e.doc_id, hash(e.g) as h from e join r using (g)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from f a join f b on a.h = b.h and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
u as (select a, b from l union all select b, a from l),
c(doc_id, root) as (select doc_id, doc_id from documents union select u.b, c.root from c join u on u.a = c.doc_id where c.root < u.b)
select n.doc_id, n.n_shingles, m.root as component_id, n.doc_id = m.root as kept
from n join (select doc_id, min(root) as root from c group by doc_id) m using (doc_id)
"""
ORACLE["op8_line_dedup"] = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
o as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as no from l),
d as (select line, length(line) as n, min(struct_pack(d := doc_id, k := no)) as first from o where length(line) >= 10 group by line),
v as (select line, n, first, i, substr(line, 1, i - 1) || substr(line, i + 1) as rest
      from (select *, unnest(range(1, n + 1)) as i from d where n >= 20)),
s as (select i, rest, min(first) as first from v group by i, rest having count(*) > 1),
near as (
  select v.line from v join s on s.i = v.i and s.rest = v.rest and s.first < v.first
  union
  select v.line from v join d on d.line = v.rest and d.n >= 20 and d.first < v.first
  union
  select d.line from v join d on d.line = v.rest and d.n >= 20 and v.first < d.first),
g as (select o.doc_id, o.no from o join d on d.line = o.line
      where o.line in (select line from near) or struct_pack(d := o.doc_id, k := o.no) > d.first),
k as (select o.doc_id, string_agg(o.line, chr(10) order by o.no) as kept from o anti join g on g.doc_id = o.doc_id and g.no = o.no group by o.doc_id)
select l.doc_id, (case when text <> '' then len(ls) else 0 end)::bigint as n_lines,
       coalesce((select count(*) from g where g.doc_id = l.doc_id), 0)::bigint as n_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from l left join k using (doc_id)
"""
ORACLE["op6_main_text"] = r"""
with a as (select page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') as parts from pages),
b as (select page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(
        replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;?', '"', 'g'), '&amp', '&')
        .replace('&;', '&'), '\s+', ' ', 'g'), '^ | $', '', 'g')) as texts from a),
t as (select page_id, url, array_to_string(list_filter(texts, lambda x: x <> ''), chr(10) || chr(10)) as text from b)
select page_id, url, text, length(text)::bigint as n_chars from t
"""
ORACLE["op10_suffix_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(n - 49)) as p from d where n >= 50)),
m as (select s, min(doc_id) as first from w group by s),
r as (select w.doc_id, w.p from w join m using (s) where w.doc_id > m.first),
g as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as opens from r),
o as (select *, sum(opens) over (partition by doc_id order by p) as k from g),
s as (select doc_id, k, min(p) as a, max(p) + 50 as b from o group by doc_id, k),
f as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as z from s),
c as (select f.doc_id, sum(b - a) as removed, count(*) as spans, max(b) as last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) as kept
      from f join d using (doc_id) group by f.doc_id)
select d.doc_id, d.n as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join c using (doc_id)
"""

ORACLE["op11_phrases"] = r"""
with p as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws
  from documents),
t as (select lang, sum(len(ws))::bigint as n from p group by lang),
g as (select lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from p, range(1, 5) s(k) where len(ws) >= k),
f as (select lang, phrase, string_split(phrase, ' ') as ws, count(*)::bigint as a from g group by lang, phrase having count(*) >= 30),
c as (select *, unnest(range(1, len(ws))) as k from f where len(ws) > 1),
s as (select c.lang, c.phrase, c.ws, c.a, x.a as l, y.a as r, ((2000000 * c.a::hugeint) // (x.a + y.a))::bigint as score, k
      from c join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, a, len(ws) as m, ws, unnest(range(2, len(ws))) as k from f where len(ws) > 2),
h as (select lang, max(a) as around, phrase from (
        select lang, a, array_to_string(ws[j:j + k - 1], ' ') as phrase from (select *, unnest(range(1, m - k + 2)) as j from i)) group by lang, phrase),
k as (select b.* from b left join h on h.lang = b.lang and h.phrase = b.phrase where h.around is null or 100 * h.around::hugeint < 80 * b.a::hugeint),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k)
select r.lang, rank, phrase, a, l, r, n, score from r join t on t.lang = r.lang where rank <= 2000
"""
_ROUND = """
a{i} as materialized (
  select v.r, v.vec_id, v.q, arg_min(c.c, struct_pack(d := list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, c := c.c)) as c,
         min(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint) as d
  from v, c{i} c group by v.r, v.vec_id, v.q),
m{i} as (select c, j, sum(q[j]) as s, count(*) as n from a{i}, range(1, 65) t(j) group by c, j),
n{i} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as q from m{i} group by c),
c{k} as materialized (select c{i}.c, coalesce(n{i}.q, c{i}.q) as q from c{i} left join n{i} on n{i}.c = c{i}.c),"""
ORACLE["op12_clustering"] = (
    """
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q
  from embeddings where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select (row_number() over (order by sha256('3:' || vec_id::varchar) nulls last, q) - 1)::int as c, q from v
  qualify row_number() over (order by sha256('3:' || vec_id::varchar) nulls last, q) <= 8),"""
    + "".join(_ROUND.format(i=i, k=i + 1) for i in range(11))
    + """
t as (select c, sum(d)::bigint as s from a10 group by c)
select a10.vec_id, a10.c as cluster, a10.d as distance, t.s as cluster_inertia, (select sum(s) from t)::bigint as inertia,
       sha256(array_to_string(list_transform(c10.q, lambda x: x::varchar), ',')) as centroid_sha256
from a10 join t on t.c = a10.c join c10 on c10.c = a10.c
"""
)
ORACLE["op13_jaccard_join"] = ORACLE["op5_near_duplicates"].replace("100 * common >= 80 *", "100 * common >= 85 *").replace(", n.doc_id = m.root as kept", "")
