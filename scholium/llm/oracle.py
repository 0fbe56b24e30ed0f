"""SQL for DuckDB that checks the queries of this subpackage which SQL can express."""

from __future__ import annotations

_LINKS = """
 m as (select decision_id, list_distinct(list_filter(list_concat(coalesce(node_ids, []), coalesce(affected_nodes, [])), lambda x: x is not null)) as l from decisions where action = 'merge'),
 e as (select distinct decision_id, unnest(l) as k from m),
 a as (select distinct x.k as u, y.k as v from (select decision_id, min(k) as k from e group by 1 having count(*) > 1) x join e y using (decision_id) where x.k <> y.k),
 s as (select u, v from a union select v, u from a),
 r(node, reach) as (select u, u from s union select r.node, s.v from r join s on s.u = r.reach),
 g as (select node as node_key, min(reach) as group_key from r group by 1)
"""
_STAND_INS = "'none','null','nil','nan','na','nodefinition','undefined','unknown','tbd','tba','todo','empty','missing','无','空','暂无','未知','未定','不详','待定','待补','待补充','待填','缺','缺失','未填','未命名','没有','略','同上'"

#: CTEs that end in best: the member of each group that no other beats.
_BEST = f"""
 n as (select distinct on (textbook_id, node_id) *, textbook_id || ':' || node_id as node_key, lower(regexp_replace(coalesce(definition, ''), '[\\s\\p{{P}}\\p{{S}}\\p{{Z}}]+', '', 'g')) as w from nodes),
 f as (select g.group_key, g.node_key, (coalesce(w, '') <> '' and w not in ({_STAND_INS}))::int as a, (trim(coalesce(chapter_title, '')) <> '')::int as b, (page_start is not null)::int as c, (page_end is not null)::int as d,
   (frequency is not null)::int as x, (trim(coalesce(source_excerpt, '')) <> '')::int as y, length(trim(coalesce(definition, ''))) as l0, coalesce(updated_at, timestamp '0001-01-01') as t, coalesce(trust, -1) as z
   from g left join n using (node_key) left join extractors using (extractor)),
 h as (select *, case when a = 1 then l0 else 0 end as l from f),
 best as (select p.group_key, p.node_key from h p where not exists (select 1 from h q where q.group_key = p.group_key and q.node_key <> p.node_key and not (
  p.a >= q.a and p.b >= q.b and p.c >= q.c and p.d >= q.d and p.x >= q.x and p.y >= q.y and p.l >= q.l and p.t >= q.t and p.z >= q.z
  and (p.a > q.a or p.b > q.b or p.c > q.c or p.d > q.d or p.x > q.x or p.y > q.y or p.l > q.l or p.t > q.t or p.z > q.z))))
"""

SQL: dict[str, str] = {
    "p3_found": f"with recursive {_LINKS} select group_key, node_key from g",
    "p4_found": f"with recursive {_LINKS}, {_BEST} select group_key, node_key from best",

    "p5_found": """
select distinct 'chapter' as item_kind, textbook_id || ':' || chapter_id as item_key from chapters where length(content) > (select max_size from size_limits where item_kind = 'chapter')
union select distinct 'chunk', chunk_id from chunks where length(text) > (select max_size from size_limits where item_kind = 'chunk')""",
    "p6_found": """
with m as (select distinct chunk_id, trim(embedding_model) as g from chunks where trim(coalesce(embedding_model, '')) <> ''),
 v as (select distinct on (chunk_id) chunk_id, list_transform(embedding, lambda x: x::double) as e from chunk_vectors where len(embedding) = 64),
 u as (select m.chunk_id, m.g, v.e from m join v using (chunk_id) where list_sum(list_transform(e, lambda x: x * x)) > 0)
select a.chunk_id as chunk_a, b.chunk_id as chunk_b from u a join u b on a.g = b.g and a.chunk_id < b.chunk_id where list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p4_winners": f"""
with recursive {_LINKS}, {_BEST}, sizes as (select group_key, count(*) as member_count from g group by 1)
select group_key, node_key, member_count, definition, extractor, chapter_title, page_start, page_end, source_excerpt, frequency, node_type, level from best join sizes using (group_key)
 left join (select distinct on (textbook_id, node_id) *, textbook_id || ':' || node_id as node_key from nodes) using (node_key)""",
    "p5_limits": """
with l as (select * from size_limits where unit = 'characters'),
 i as (select 'chapter' as item_kind, textbook_id || ':' || chapter_id as item_key, content as text from chapters union all select 'chunk', chunk_id, text from chunks)
select item_kind, count(distinct item_key) as items, 0 as pieces_over, 0 as wrong_overlaps, 0 as not_covered from i join l using (item_kind) where length(text) > max_size group by 1""",
    "p8_limits": """
select count(*) as documents, count(*) filter (coalesce(trim(text), '') = '') as blank, 0 as cut_though_fitting, 0 as over_tokens, 0 as over_segments, 0 as over_loss from documents""",
}
