"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from .line_dedup import LINE, LONG, PLACE

WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = r"""
with recursive bit(k, i, v) as (select 0, i, i from range(256) t(i) union all select k + 1, i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bit where k < 8),
crc(t) as (select list(v order by i) from bit where k = 8),
raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
bytes as (select doc_id, len(h) // 2 as n, list_prepend(cast(4294967295 as bigint), list_transform(range(len(h) // 2), lambda i: cast(strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 17 as bigint))) as b from raw),
sized as (select doc_id, cast(n + 1 as bigint) as size, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) as text_crc32 from bytes, crc),
run as (select *, sum(size) over (order by text_crc32, doc_id) - size as before, sum(size) over () as total, row_number() over (order by text_crc32, doc_id) as r from sized),
placed as (select *, cast((8 * (2 * before + size)) // (2 * total) as integer) as shard from run)
select doc_id, size, text_crc32, 'bytes' as law, shard, r - min(r) over (partition by shard) as slot, cast(null as integer) as grown_shard from placed"""

OP3 = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
f as (select *, min(page_id) over (partition by d) as first from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id <> first then first end as refers_to from f"""

OP4 = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
u as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as n from v where list_inner_product(e, e) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) as b from r group by a), d as (select a, count(*) as n from l group by a)
select vec_id, coalesce(d.n, 0) as n_links, least(vec_id, coalesce(c.b, vec_id)) as component_id, vec_id <= coalesce(c.b, vec_id) as kept from embeddings left join c on c.a = vec_id left join d on d.a = vec_id"""

OP5 = f"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {WORDS})) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '') || 'mix') as key from documents),
s as (select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, [1, 2, 3][cast(rank % 3 as integer) + 1] as weight, 3 * source_size as cap from s),
f as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as left_size, sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as left_weight from w),
level as (select cast(left_size as double) / cast(left_weight as double) as level from f where left_size * weight <= cap * left_weight order by cap / weight, rank limit 1),
t as (select source, source_size, rank, least(cast(cap as double), level * weight) as target from f, level),
q as (select d.*, t.source_size, t.rank, t.target, sum(size) over (partition by t.rank order by key, doc_id) - size as before, row_number() over (partition by t.rank order by key, doc_id) as r from d join t on d.source is not distinct from t.source),
c as (select q.*, pass from q, range(3) p(pass) where pass < greatest(1, coalesce(ceil(target / nullif(source_size, 0)), 1))),
g as (select *, coalesce((cast(pass * source_size + before as double) + size / 2.0) / nullif(target, 0), 0) as finish from c),
m as (select *, sum(size) over (order by finish, rank, pass, r rows unbounded preceding) as upto, sum(size) filter (pass = 0) over () as total from g)
select any_value(doc_id) as doc_id, any_value(size) as size, cast(any_value(source_size) as bigint) as source_size, any_value(target) as target, cast(count(*) filter (upto <= total) * any_value(size) as bigint) as taken from m group by rank, r"""

OP9 = rf"""
with l as (select row_number() over () as n, doc_id, text, list_filter(regexp_extract_all(coalesce(text, ''), '{LINE}'), lambda x: x <> '') as ls from documents),
u as (select n, doc_id, text, flatten(list_transform(ls, lambda x: case when length(x) <= {LONG} or contains(x, chr(65535)) then [x] else
  list_filter(string_split(regexp_replace(x, '{PLACE}', '\0' || chr(65535), 'g'), chr(65535)), lambda p: p <> '') end)) as us from l),
b as (select n, coalesce(doc_id, 9223372036854775807) as rank, us, list_transform(us, lambda x: rtrim(x, ' ' || chr(10))) as bare from u),
w as (select n, rank, unnest(list_concat(list_transform(range(1, greatest(len(us), 1)), lambda i: {{'k': i, 'to': i + 1, 'a': bare[i], 'b': bare[i + 1]}}), list_transform(list_filter(range(1, len(us) + 1), lambda i: length(us[i]) > {LONG}), lambda i: {{'k': i, 'to': i, 'a': bare[i], 'b': cast(null as varchar)}}))) as w from b),
o as (select n, w.k as k, w.to as upto, rank > min(rank) over (partition by w.a, w.b) or w.k > min(w.k) over (partition by n, w.a, w.b) as lost from w),
gone as (select distinct n, unnest([k, upto]) as k from o where lost),
x as (select n, unnest(range(1, len(us) + 1)) as k, unnest(us) as line from u),
kept as (select x.n, coalesce(string_agg(line, '' order by x.k) filter (gone.k is null), '') as text, count(gone.k) as n_removed from x left join gone on gone.n = x.n and gone.k = x.k group by x.n)
select doc_id, cast(len(us) as bigint) as n_lines, coalesce(n_removed, 0) as n_removed, case when u.text is null then null else coalesce(kept.text, '') end as text from u left join kept using (n)"""

OP10 = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(ws) - 2, 2)), lambda i: array_to_string(ws[i : i + 3], ' '))) end as ss from w),
n as (select doc_id, cast(len(ss) as bigint) as n, md5(array_to_string(list_sort(ss), chr(1))) as same from s),
rep as (select same, min(doc_id) as rep, any_value(n) as n from n where n > 0 group by same),
x as (select doc_id, unnest(ss) as v from s where doc_id in (select rep from rep)),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.v = b.v and a.doc_id < b.doc_id group by 1, 2),
k as (select i.a, i.b from i join rep p on p.rep = i.a join rep q on q.rep = i.b where 100 * c >= 80 * (p.n + q.n - c)),
l as (select a, b from k union all select b, a from k),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
m as (select rep.same, least(rep.rep, coalesce(min(r.b), rep.rep)) as c from rep left join r on r.a = rep.rep group by rep.same, rep.rep)
select n.doc_id, n.n as n_shingles, coalesce(m.c, n.doc_id) as component_id, coalesce(m.c, n.doc_id) = n.doc_id as kept from n left join m on m.same = n.same and n.n > 0"""

SQL = {"op1_sharding": OP1, "op3_warc": OP3, "op4_embedding_dedup": OP4, "op5_mixing": OP5, "op9_line_dedup": OP9, "op10_minhash": OP10}
