"""The testbed's queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from .functions.globs import glob_to_regex
from .testbed import CX, FLOOR, FORBID, K, KEYWORDS, LAYERS, SCORE

SPAN = "cast(0 as bigint) as start_byte, cast(0 as bigint) as end_byte, cast(1 as integer) as start_line"
ORD = "{file} || chr(0) || lpad(cast({id} as varchar), 10, '0')"

FUNCTIONS = """fn as (select cast(o_custkey as varchar) as file, o_orderkey as id, 'f' || o_orderkey as name, 1 + (select count(*) from lineitem l where l.l_orderkey = o.o_orderkey) as cx from orders o)"""
COMPLEXITY = f"""select 'complexity' as rule, case when cx >= {2 * CX} then 'warning' else 'info' end as severity, 'function `' || name || '` has high cyclomatic complexity (' || cx || ')' as message, file, {SPAN}, 'certain' as confidence, {ORD.format(file="file", id="id")} as ord from fn where cx > {CX}"""
CHURN = "churn as (select cast(user_id as varchar) as file, count(*) as commits from events group by user_id)"
HOTSPOT = f"""select 'hotspot' as rule, 'info' as severity, 'hotspot: `' || name || '` complexity ' || cx || ' x churn ' || coalesce(commits, 0) || ' = ' || cx * coalesce(commits, 0) as message, fn.file, {SPAN}, 'certain' as confidence, {ORD.format(file="fn.file", id="id")} as ord from fn left join churn on churn.file = fn.file where cx >= {FLOOR} and cx * coalesce(commits, 0) > {SCORE}"""
CALLS = """e as (select a.l_partkey as f, b.l_partkey as t, bool_or(a.l_returnflag = 'N') as sure from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_quantity > 47 group by 1, 2),
anyr(n) as (select p_partkey from part where p_size = 1 union select e.t from anyr join e on e.f = anyr.n),
cert(n) as (select p_partkey from part where p_size = 1 union select e.t from cert join e on e.f = cert.n where e.sure)"""
DEAD = f"""select 'dead_code' as rule, case when p_partkey in (select n from anyr) then 'info' else 'warning' end as severity, case when p_partkey in (select n from anyr) then 'possibly unused function `f' else 'unused function `f' end || p_partkey || '`' as message, 'p' as file, {SPAN}, case when p_partkey in (select n from anyr) then 'likely' else 'certain' end as confidence, {ORD.format(file="'p'", id="p_partkey")} as ord from part where p_partkey not in (select n from cert)"""
NATIONS = """sold as (select c_nationkey, s_nationkey, sum(cast(round(l_extendedprice * 100) as bigint)) as cents from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2),
best as (select c_nationkey, s_nationkey from (select *, row_number() over (partition by c_nationkey order by cents desc, s_nationkey) as r from sold) where r <= 2),
path as (select n_nationkey, r_name as layer, r_name || '/' || n_name as path from nation join region on n_regionkey = r_regionkey),
uses as (select distinct a.path as src, b.path as dst, a.layer as src_layer, b.layer as dst_layer from best join path a on c_nationkey = a.n_nationkey join path b on s_nationkey = b.n_nationkey where a.path <> b.path)"""
RULES = " or ".join(f"(src_layer = '{a}' and dst_layer = '{b}')" for a, b in FORBID)
BOUNDARY = f"""select 'boundary' as rule, 'warning' as severity, 'layer `' || src_layer || '` must not import `' || dst_layer || '` (' || src || ' -> ' || dst || ')' as message, src as file, {SPAN}, 'certain' as confidence, src || chr(0) || dst as ord from uses where {RULES}"""
ALL = f"with recursive {FUNCTIONS}, {CHURN}, {CALLS}, {NATIONS}, allf as ({DEAD} union all {COMPLEXITY} union all {HOTSPOT} union all {BOUNDARY})"
SEVERITY = "case severity when 'info' then 0 when 'warning' then 1 else 2 end"
RANK = "case rule when 'dead_code' then 0 when 'duplication' then 1 when 'complexity' then 2 when 'hotspot' then 3 when 'cycle' then 4 else 5 end"
TOKENS = r"""words as (select lpad(cast(doc_id as varchar), 12, '0') as file, regexp_extract_all(text, '[A-Za-z0-9_]+|[^ \t\n\x0B\f\rA-Za-z0-9_]') as ws from documents),
tok as (select file, unnest(range(len(ws))) as pos, unnest(ws) as norm from words)"""
WINDOWS = f"""{TOKENS}, win as (select file, pos, array_to_string(w, chr(1)) as key from (select file, pos, list(norm) over (partition by file order by pos rows between current row and {K - 1} following) as w from tok) where len(w) = {K}),
grp as (select key, count(*) as n, min(file || chr(0) || lpad(cast(pos as varchar), 10, '0')) as first from win group by key),
dup as (select file, pos, win.key, first, file || chr(0) || lpad(cast(pos as varchar), 10, '0') as place from win join grp using (key) where n > 1)"""
DUPLICATION = f"""anchor as (select * from dup d where place = first and not exists (select 1 from dup b where b.file = d.file and b.pos = d.pos - 1)),
pair as (select a.file, a.pos, a.place, min(o.place) as partner, count(*) as n from anchor a join dup o on o.key = a.key and (o.file <> a.file or o.pos >= a.pos + {K}) group by 1, 2, 3)
select 'duplication' as rule, 'warning' as severity, 'duplicated code block (>= {K} tokens) also at ' || split_part(partner, chr(0), 1) || ':1' || case when n > 1 then ' and ' || (n - 1) || ' more' else '' end as message, file, cast(pos as bigint) as start_byte, cast(pos + {K} as bigint) as end_byte, cast(1 as integer) as start_line, 'certain' as confidence, place as ord from pair"""
LAYER = "case " + " ".join(f"when {' or '.join(f"regexp_matches(path, '{glob_to_regex(g)}')" for g in gs)} then '{name}'" for name, gs in sorted(LAYERS.items())) + " end"
FILES = "src as (select 'f' || c_custkey || ['.java', '.rb', '.ts', '.py', '.go', '.rs'][c_custkey % 6 + 1] as file, c_custkey as k, c_nationkey as n, c_custkey % 6 as l, c_custkey % 3 + 1 as times from customer)"
PATHS = "paths as (select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages)"

SQL: dict[str, str] = {
    "complexity_findings": f"with {FUNCTIONS} {COMPLEXITY}",
    "hotspot_findings": f"with {FUNCTIONS}, {CHURN} {HOTSPOT}",
    "churn_by_user": "select cast(user_id as varchar) as file, count(*) as commits from events group by user_id",
    "dead_code_findings": f"with recursive {CALLS} {DEAD}",
    "reachable_any": f"with recursive {CALLS} select n as node from anyr",
    "reachable_certain": f"with recursive {CALLS} select n as node from cert",
    "promote_edges": """with n as (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2), f as (select o_custkey, min(o_orderkey) as from_id from orders group by 1)
select cast(o.o_custkey as varchar) as file, f.from_id, o.o_orderkey as to_id, case when n.n = 1 then 'certain' else 'likely' end as confidence from orders o join f using (o_custkey) join n on n.o_custkey = o.o_custkey and n.o_orderpriority = o.o_orderpriority""",
    "cross_file_calls": """with fn as (select cast(s_suppkey % 10 as varchar) as file, s_suppkey as id, s_nationkey || '-' || cast(floor(s_acctbal / 1000) as bigint) as name from supplier),
call as (select cast(c_custkey % 10 as varchar) as file, c_custkey as id, c_nationkey || '-' || cast(floor(c_acctbal / 1000) as bigint) as name from customer),
known as (select c.file, c.id as from_id, fn.file as to_file, fn.id as to_id from call c join fn using (name) where c.id % 7 = 0)
select file, from_id, to_file, to_id, 'certain' as confidence from known union all
select distinct c.file, c.id, fn.file, fn.id, 'likely' from call c join fn using (name) where c.file <> fn.file and not exists (select 1 from known k where k.file = c.file and k.from_id = c.id and k.to_file = fn.file and k.to_id = fn.id)""",
    "go_suffix_resolve": f"""with {PATHS}, dirs as (select distinct case when page_id % 2 = 0 then array_to_string(string_split(path, '/')[-1:], '/') else array_to_string(string_split(path, '/')[-2:], '/') end as dir from paths where page_id % 3 = 0 and len(string_split(path, '/')) > 2),
best as (select page_id, arg_max(dir, length(dir)) as dir from paths join dirs on dir <> '' and (path = dir or suffix(path, '/' || dir)) group by page_id)
select page_id, coalesce(dir, path) as name from paths left join best using (page_id)""",
    "clone_windows": f"with {WINDOWS} select n, count(*) as groups from grp group by n",
    "duplication_findings": f"with {WINDOWS}, {DUPLICATION}",
    "token_normalize": f"with {TOKENS} select case when regexp_matches(norm, '^[0-9]+$') then 'NUM' when regexp_matches(norm, '^[A-Za-z0-9_]+$') and norm not in ({', '.join(repr(k) for k in sorted(KEYWORDS))}) then 'ID' else norm end as norm, count(*) as n from tok group by 1",
    "cycle_findings_single": f"""with recursive {NATIONS.replace('r <= 2', 'r <= 1')}, walk(start, place, path) as (select src, dst, [src] from uses union all select start, u.dst, list_append(path, place) from walk join uses u on u.src = place where place <> start and not list_contains(path, place)),
ring as (select start, path from walk where place = start and start = list_min(path))
select 'cycle' as rule, 'warning' as severity, 'circular dependency: ' || array_to_string(path, ' -> ') as message, start as file, {SPAN}, 'certain' as confidence, array_to_string(path, chr(0)) as ord from ring""",
    "parse_functions": f"with {FILES} select file, 'f' || k as name, cast([2, 1, 1, 3, 3, 1][l + 1] as bigint) as start_line, cast(1 + 2 * times + case l when 3 then 1 else 0 end as bigint) as cx from src union all select file, 'g' || k, 4, 2 from src where l = 3",
    "parse_calls": f"with {FILES} select file, 'f' || k as owner, 'h' || n as callee from src union all select file, 'g' || k, 'h' || n from src where l = 3 union all select file, 'f' || k, 'x' from src where l = 1",
    "parse_edges": f"""with {FILES} select file, 'file' as src, 'f' || k as dst, 'defines' as kind, 'certain' as confidence from src union all select file, 'file', 'g' || k, 'defines', 'certain' from src where l = 3
union all select file, 'file', 'C' || k, 'defines', 'certain' from src where l = 0 union all select file, 'f' || k, 'g' || k, 'calls', 'likely' from src where l = 3 union all select file, 'g' || k, 'f' || k, 'calls', 'likely' from src where l = 3""",
    "enclosing_function": """with p as (select o_orderkey as l_orderkey, unnest(range(10)) as place from orders)
select l_orderkey, place, cast(l_linenumber as bigint) as start, l_partkey from (select p.l_orderkey, place, l_linenumber, l_partkey, row_number() over (partition by p.l_orderkey, place order by 10 - l_linenumber, l_partkey) as r from p join lineitem l on l.l_orderkey = p.l_orderkey and l_linenumber <= place) where r = 1""",
    "import_graph": f"with {NATIONS} select src, dst from uses",
    "file_import_graph": f"with {NATIONS} select src, dst from uses",
    "boundary_findings": f"with {NATIONS} {BOUNDARY}",
    "layer_classify_glob": f"with {PATHS} select page_id, {LAYER} as layer from paths",
    "scc_members": f"""with recursive {NATIONS}, r(a, b) as (select src, dst from uses union select r.a, u.dst from r join uses u on u.src = r.b),
m as (select x.a, x.b from r x join r y on x.a = y.b and x.b = y.a where x.a <> x.b) select a as node, least(a, min(b)) as component from m group by a""",
    "scan_stats": f"""with {FUNCTIONS} select (select count(*) from customer) as files, count(*) as functions, max(cx) as cx_max, round(avg(cx), 6) as cx_mean, (select string_agg(s, ',' order by s) from (select distinct lower(c_mktsegment) as s from customer)) as languages from fn""",
    "gate_by_threshold": f"{ALL}, top as (select coalesce(max({SEVERITY}), -1) as t from allf) select unnest(['info', 'warning', 'error']) as threshold, unnest([t >= 0, t >= 1, t >= 2]) as fails from top",
    "metrics_grouped": f"{ALL} select rule, severity, coalesce(lower(c_mktsegment), 'unknown') as language, confidence, count(*) as value from allf left join customer on cast(c_custkey as varchar) = file group by 1, 2, 3, 4",
    "run_event": f"{ALL} select rule, severity, count(*) as value from allf group by grouping sets ((rule), (severity), ())",
    "findings_union": f"{ALL} select * from allf",
    "findings_by_rule": f"with {FUNCTIONS}, {CHURN} {HOTSPOT}",
    "lsp_diagnostics": f"{ALL} select file, count(*) as items, arg_min(message, {RANK} || ord) as first_message from allf group by file",
    "sarif_rules_first_seen": f"{ALL} select distinct rule, cast({RANK} as integer) as place from allf",
    "parse_headers": "select event_id, cast(user_id as varchar) as user_header, 'last' as kind_header, event_type as v_header, cast(3 as bigint) as headers from events",
    "remote_names": """with p as (select page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^[^/]*/', ''), '/'), lambda x: x <> '') as even, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^[^:]*:', ''), '\\.git$', ''), '/'), lambda x: x <> '') as odd from pages), s as (select page_id, case when page_id % 2 = 0 then even else odd end as segs from p)
select page_id, segs[-2] as namespace, segs[-1] as repo from s""",
}
