"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP1 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
twice as (select h from win group by h having count(*) > 1),
hit as (select r, i from win where h in (select h from twice)),
word as (select r, doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as t from d),
gone as (select distinct r, i + o as p from hit, range(0, 35) as x(o)),
marked as (select word.r, word.doc_id, word.p, t, gone.p is not null as g from word left join gone on word.r = gone.r and word.p = gone.p),
sums as (select r, count(*) as n_words, count(*) filter (where g) as n_removed, coalesce(string_agg(t, ' ' order by p) filter (where not g), '') as k from marked group by r)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join sums on d.r = sums.r
"""

OP3 = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

OP5 = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
g as (
  select distinct doc_id, md5(array_to_string(w[i:i + 3], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from d where len(w) >= 4)
  union all select doc_id, md5(array_to_string(w, ' ')) from d where len(w) between 1 and 3
),
n as (select doc_id, count(*) as n from g group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as other from d union select r.doc_id, b.y from reach r join both_ways b on r.other = b.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from d left join n on d.doc_id = n.doc_id join (select doc_id, min(other) as component_id from reach group by doc_id) c on d.doc_id = c.doc_id
"""

OP11 = r"""
with crc as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) as c from range(256) as r(i))),
tok as (
  select true as own, row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select false, row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
),
feat as (
  select own, r, unnest(w) as f from tok
  union all select own, r, w[i] || ' ' || w[i + 1] from (select own, r, w, unnest(range(1, len(w))) as i from tok where len(w) >= 2)
),
per as (select own, r, f, count(*) as n from feat group by all),
code as (
  select f, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as b
  from (select distinct f from per), crc
),
held as (select own, r, b, sum(n)::bigint as n from per join code using (f) group by all),
sums as (select b, coalesce(sum(n) filter (where own), 0)::bigint as s, coalesce(sum(n) filter (where not own), 0)::bigint as t from held group by b),
whole as (select coalesce(sum(s), 0)::double + 10000 as s_all, coalesce(sum(t), 0)::double + 10000 as t_all from sums),
gain as (select b, floor(1000 * ln(((t + 1)::double * s_all) / ((s + 1)::double * t_all)))::bigint as g from sums, whole),
weights as (select r, sum(n)::bigint as n_features, floor(sum(n * g)::double / sum(n))::bigint as weight from held join gain using (b) where own group by r),
scored as (
  select tok.r, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::varchar, ''))[:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from tok left join weights using (r) where own
),
drawn as (select r, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20),
quota as (select 25 * count(*) // 100 as q from scored where n_words >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= q then rank end as rank from scored left join drawn using (r), quota
"""

OP13 = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
flags as (
  select r, part,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails,
    coalesce(doc_id in (select doc_id from labels where quality = 1 and doc_id is not null), false) as good, coalesce(doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null), false) as toxic
  from d
),
masks as (select part, list_sum(list_transform(fails, lambda x, i: x::int << (i - 1)::int))::int as m, good, toxic, count(*) as n from flags group by all),
one as (select unnest(range(1, 6))::int as i),
steps as (
  select chr((64 + a.i)::int) || chr((64 + b.i)::int) || chr((64 + c.i)::int) || chr((64 + e.i)::int) || chr((64 + g.i)::int) as filter_order, unnest([1, 2, 3, 4, 5]) as step,
    unnest([a.i, b.i, c.i, e.i, g.i]) - 1 as f,
    unnest([0, 1 << (a.i - 1), (1 << (a.i - 1)) | (1 << (b.i - 1)), (1 << (a.i - 1)) | (1 << (b.i - 1)) | (1 << (c.i - 1)), 31 - (1 << (g.i - 1))])::int as before
  from one a, one b, one c, one e, one g where len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5
),
cells as (
  select part, f, before,
    coalesce(sum(n) filter (where m & (before | (1 << f)) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where m & before = 0 and m & (1 << f) <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where m & before <> 0 and m & (1 << f) <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where m = 1 << f), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (where m & before = 0 and m & (1 << f) <> 0 and good), 0)::bigint as good_lost,
    coalesce(sum(n) filter (where m & before = 0 and m & (1 << f) <> 0 and toxic), 0)::bigint as toxic_lost
  from masks, (select distinct f, before from steps) group by part, f, before
),
rows as (select part, filter_order, step::int as step, cells.* exclude (part) from steps join cells using (f, before))
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f)::bigint as shapley from rows
"""

ORACLE = {"op1_substring_dedup": OP1, "op3_exact_top_k": OP3, "op5_ngram_join": OP5, "op11_importance": OP11, "op13_filter_audit": OP13}
