"""SQL for DuckDB that checks the registered queries: written on its own, not derived from the Spark plans."""

from __future__ import annotations

import unicodedata

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NUMERAL = r"[一二三四五六七八九十百千万零〇两\d]"
LOW = "(?i)(前言|序|目录|版权|编委|主编|副主编|简介|封面|扉页|致谢|附录|索引|参考文献|数字版)"


def latest(name: str, *keys: str) -> str:
    return f"(select * from {name} qualify row_number() over (partition by {', '.join(keys)} order by ingested_at desc) = 1)"


CHAPTERS = latest("chapters", "textbook_id", "chapter_id")
BOOKS = latest("textbooks", "textbook_id")
CHUNKS = "(select * from chunks qualify row_number() over (partition by chunk_id order by chunk_index) = 1)"
NODES = latest("nodes", "textbook_id", "node_id")
EDGES = latest("edges", "textbook_id", "edge_id")
DECISIONS = latest("decisions", "decision_id")


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS}+|{WS}+\z', '', 'g')"


def heading(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '({WS}|[|｜])+', '', 'g')"


def query_key(c: str) -> str:
    return f"lower(regexp_replace(coalesce({c}, ''), '{WS}+', '', 'g'))"


def title(c: str) -> str:
    extracted = squeeze(rf"regexp_replace(regexp_replace({c}, '[\x{{feff}}\x{{200b}}-\x{{200d}}]', '', 'g'), '[\x{{fffd}}\x08]+', ' ', 'g')")
    no_page = squeeze(rf"regexp_replace({extracted}, '{WS}+[0-9]+{WS}*\z', '', 'g')")
    return strip(rf"regexp_replace({no_page}, '^#+|#+\z', '', 'g')")


def level(c: str) -> str:
    h = heading(c)
    return (
        f"case when {h} = '绪论' or regexp_matches({h}, '^第{NUMERAL}+章') then 'primary' when regexp_matches({h}, '^第{NUMERAL}+节') or regexp_matches({h}, '^[一二三四五六七八九十]+、') "
        f"or regexp_matches({h}, '^（[一二三四五六七八九十]+）') then 'secondary' else 'content' end"
    )


LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def body(c: str) -> str:
    lines = f"string_split(regexp_replace(coalesce({c}, ''), '{LINE_END}', chr(10), 'g'), chr(10))"
    clean = strip(r"regexp_replace(x, '[ \t]+', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform({lines}, lambda x: {clean}), lambda x: x <> ''), chr(10))"


def low_chapter(t: str, c: str) -> str:
    return f"(({strip(f"coalesce({t}, '')")} = '' and {body(c)} = '') or regexp_matches({strip(f"coalesce({t}, '')")}, '{LOW}') or (length({body(c)}) < 120 and regexp_matches(substring({body(c)}, 1, 80), '{LOW}')))"


def grams(k: str, n: int) -> str:
    return f"(case when length({k}) >= {n} then list_transform(range(1, length({k}) - {n} + 2), lambda i: substring({k}, i::int, {n})) else [] end)"


def terms(c: str) -> str:
    """Terms of a text as a list: a CJK run and its grams, Latin words of two or more letters."""
    run = "regexp_matches(r, '^[一-鿿]')"
    return (
        f"flatten(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[一-鿿]+|[a-z0-9]+'), lambda r: case when {run} and length(r) > 2 then list_concat(list_concat([r], {grams('r', 2)}), list_concat({grams('r', 3)}, {grams('r', 4)})) "
        f"when {run} then [r] when length(r) > 1 then [r] else [] end))"
    )


STOPS = "'什么','哪些','为何','为什么','如何','有何','根据','内容','概括','定义','人体','不同','部位'"


def pages(s: str, e: str) -> str:
    return f"case when {s} > 0 and {e} > 0 and {s} <> {e} then '第 ' || {s} || '-' || {e} || ' 页' when {s} > 0 then '第 ' || {s} || ' 页' else '页码未知' end"


_PLACED = f"""
 c as (select *, {level('title')} as lvl, {heading('title')} as h from {CHAPTERS}),
 p as (select *, case when lvl = 'primary' then first_value(textbook_id || '_' || chapter_id || '_primary') over (partition by textbook_id, lvl, h order by chapter_ord) end as pid,
        case when lvl = 'primary' then row_number() over (partition by textbook_id, lvl, h order by chapter_ord) end as nth from c),
 q as (select *, last_value(pid ignore nulls) over (partition by textbook_id order by chapter_ord rows between unbounded preceding and current row) as parent from p),
 b as (select * from q where lvl <> 'primary' and parent is not null and h not in ('', '正文', '本章数字资源', '推荐阅读', '中英文名词对照索引') and char_count >= 80
        and not regexp_matches(h, '^\\d+(主编|副主编)') and not regexp_matches({strip('title')}, '^[A-Za-z ]+\\z'))
"""

_DICE = f"""
 ch as materialized (select chunk_id, chapter_title, page_start, text, {terms('text')} as ts, {terms('chapter_title')} as tt, {query_key('text')} as k from {CHUNKS}),
 qs as materialized (select question_id, {terms('question')} as ts, {query_key('question')} as k from eval_items)
"""


def _search(mode: str) -> str:
    """The whole search as SQL: token tables, overlaps, measures, ranks."""
    return f"""
with {_DICE},
 qt as (select question_id, unnest(ts) as t from qs), qc as (select question_id, t, count(*) as n from qt group by all),
 ct as (select chunk_id, unnest(ts) as t from ch), cc as (select chunk_id, t, count(*) as n from ct where t in (select t from qt) group by all),
 ht as (select chunk_id, unnest(tt) as t from ch), hc as (select chunk_id, t, count(*) as n from ht where t in (select t from qt) group by all),
 qg0 as (select question_id, unnest(list_concat({grams('k', 2)}, {grams('k', 3)})) as t from qs), qg as (select question_id, t, count(*) as n from qg0 group by all),
 cg0 as (select chunk_id, unnest(list_concat({grams('k', 2)}, {grams('k', 3)})) as t from ch), cg as (select chunk_id, t, count(*) as n from cg0 group by all),
 qn as (select question_id, sqrt(sum(n * n)) as norm from qg group by 1), cn as (select chunk_id, sqrt(sum(n * n)) as norm from cg group by 1),
 o1 as (select question_id, chunk_id, sum(least(a.n, b.n)) as s from qc a join cc b using (t) group by all),
 o2 as (select question_id, chunk_id, sum(least(a.n, b.n)) as s from qc a join hc b using (t) group by all),
 o3 as (select question_id, chunk_id, sum(a.n * b.n) as s from qg a join cg b using (t) group by all),
 pr as (select question_id, chunk_id from o1 union select question_id, chunk_id from o2 union select question_id, chunk_id from o3),
 m as (select pr.question_id, pr.chunk_id, coalesce(o1.s, 0) as s1, coalesce(o2.s, 0) as s2, coalesce(o3.s, 0) as s3, len(qs.ts) as qn, len(ch.ts) as dn, len(ch.tt) as tn, qn.norm as qnorm, cn.norm as cnorm,
    case when qs.k <> '' and contains(ch.k, qs.k) then 0.15 else 0.0 end as w,
    case when regexp_matches({strip("coalesce(ch.chapter_title, '')")}, '{LOW}') or (coalesce(ch.page_start, 0) <= 15 and length({strip('ch.text')}) < 320) then 0.12 else 0.0 end as low
   from pr left join o1 using (question_id, chunk_id) left join o2 using (question_id, chunk_id) left join o3 using (question_id, chunk_id) join qs using (question_id) join ch using (chunk_id) left join qn using (question_id) left join cn using (chunk_id)),
 x as (select question_id, chunk_id, case when qn = 0 or dn = 0 then 0.0 else s1::double / (qn + dn - s1) end as kw, case when qn = 0 or tn = 0 then 0.0 else s2::double / (qn + tn - s2) end as ti,
    case when coalesce(qnorm, 0) = 0 or coalesce(cnorm, 0) = 0 then 0.0 else s3::double / (qnorm * cnorm) end as ng, w, low from m),
 s as (select question_id, chunk_id, greatest(0.0, least(1.0, {'kw + ti * 0.18 + w - low' if mode == 'keyword' else 'ng + ti * 0.12 + w - low'})) as score from x),
 r as (select question_id, chunk_id, score, row_number() over (partition by question_id order by score desc, chunk_id) as rank from s where score > 0 and score >= 0.02)
select question_id, chunk_id, round(score, 4) as score, rank::int as rank from r where rank <= 5"""



_MARKED = "[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+"


def marked(flat: str) -> str:
    """Sentences with their marks as a list."""
    return f"list_filter(list_transform(regexp_extract_all({flat}, '{_MARKED}'), lambda x: {strip('x')}), lambda x: x <> '')"


def excerpt(content: str, term: str) -> str:
    at, n = f"strpos({content}, {term})", f"length({content})"
    start, end = f"greatest(1, {at} - 180)", f"least({n}, {at} - 1 + length({term}) + 180)"
    return (
        f"case when length({term}) > 0 and {at} > 0 then case when {start} > 1 then '...' else '' end || {strip(f'substring({content}, {start}, {end} - {start} + 1)')} || case when {end} < {n} then '...' else '' end "
        f"else substring({content}, 1, 360) end"
    )


def first_sentence(text: str) -> str:
    """What comes before and with the first sentence mark, else 220 characters."""
    first = strip(rf"regexp_extract({text}, '^[^。！？!?；;]*[。！？!?；;]?')")
    return f"case when {first} <> '' then {first} else substring({text}, 1, 220) end"


VECTORS = "(select distinct on (chunk_id) chunk_id, list_transform(embedding, lambda x: x::double) as v from chunk_vectors)"
#: The query set of vector search and its k nearest.
_NEAR = f"""
 nv as (select chunk_id, v, len(v) as n, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from {VECTORS} where v is not null),
 vs as (select * from nv where l > 0),
 vp as (select a.chunk_id as query_id, b.chunk_id, greatest(0.0, list_dot_product(a.v, b.v) / (a.l * b.l)) as similarity from vs a join vs b on a.n = b.n and a.chunk_id <> b.chunk_id
   where ('0x' || substring(md5(a.chunk_id), 1, 6))::int % 50 = 0),
 vr as (select *, row_number() over (partition by query_id order by round(similarity, 6) desc, chunk_id) as rank from vp)
"""


def _lexical(questions: str, chunks: str) -> str:
    """CTEs that end in lx: the measures of every pair of a question and a chunk with something in common."""
    return f"""
 lc as materialized (select chunk_id, chapter_title, page_start, text, {terms('text')} as ts, {terms("coalesce(chapter_title, '')")} as tt, {query_key('text')} as k from {chunks}),
 lq as materialized (select question_id, {terms('question')} as ts, {query_key('question')} as k from {questions}),
 lqc as (select question_id, t, count(*) as n from (select question_id, unnest(ts) as t from lq) group by all),
 lcc as (select chunk_id, t, count(*) as n from (select chunk_id, unnest(ts) as t from lc) group by all),
 lhc as (select chunk_id, t, count(*) as n from (select chunk_id, unnest(tt) as t from lc) group by all),
 lqg as (select question_id, t, count(*) as n from (select question_id, unnest(list_concat({grams('k', 2)}, {grams('k', 3)})) as t from lq) group by all),
 lcg as (select chunk_id, t, count(*) as n from (select chunk_id, unnest(list_concat({grams('k', 2)}, {grams('k', 3)})) as t from lc) group by all),
 lqn as (select question_id, sqrt(sum(n * n)) as norm from lqg group by 1), lcn as (select chunk_id, sqrt(sum(n * n)) as norm from lcg group by 1),
 l1 as (select question_id, chunk_id, sum(least(a.n, b.n)) as s from lqc a join lcc b using (t) group by all),
 l2 as (select question_id, chunk_id, sum(least(a.n, b.n)) as s from lqc a join lhc b using (t) group by all),
 l3 as (select question_id, chunk_id, sum(a.n * b.n) as s from lqg a join lcg b using (t) group by all),
 lp as (select question_id, chunk_id from l1 union select question_id, chunk_id from l2 union select question_id, chunk_id from l3),
 lm as (select lp.question_id, lp.chunk_id, coalesce(l1.s, 0) as s1, coalesce(l2.s, 0) as s2, coalesce(l3.s, 0) as s3, len(lq.ts) as qn, len(lc.ts) as dn, len(lc.tt) as tn, lqn.norm as qnorm, lcn.norm as cnorm,
    case when lq.k <> '' and contains(lc.k, lq.k) then 0.15 else 0.0 end as w,
    case when regexp_matches({strip("coalesce(lc.chapter_title, '')")}, '{LOW}') or (coalesce(lc.page_start, 0) <= 15 and length({strip('lc.text')}) < 320) then 0.12 else 0.0 end as low
   from lp left join l1 using (question_id, chunk_id) left join l2 using (question_id, chunk_id) left join l3 using (question_id, chunk_id) join lq using (question_id) join lc using (chunk_id) left join lqn using (question_id) left join lcn using (chunk_id)),
 lx as (select question_id, chunk_id, case when qn = 0 or dn = 0 then 0.0 else s1::double / (qn + dn - s1) end as kw, case when qn = 0 or tn = 0 then 0.0 else s2::double / (qn + tn - s2) end as ti,
    case when coalesce(qnorm, 0) = 0 or coalesce(cnorm, 0) = 0 then 0.0 else s3::double / (qnorm * cnorm) end as ng, w, low from lm)
"""


def _sources(n: int) -> str:
    """CTEs that end in src: the first segments of usable chapters."""
    mark = rf"length(regexp_extract(substring(b, {{0}} + 501, 60), '[^。！？!?；;\n]*\z'))"
    end = lambda at: f"case when n - {at} <= 560 then n else {at} + case when {mark.format(at)} < 60 then 560 - {mark.format(at)} else 560 end end"
    low = LOW.replace("|数字版", "|英文版|数字版")
    return f"""
 uc as (select *, {body('content')} as b, length({body('content')}) as n from {CHAPTERS} where coalesce(page_start, 0) >= 20 and char_count >= 1200 and {strip("coalesce(title, '')")} <> '' and not regexp_matches({strip("coalesce(title, '')")}, '{low}')),
 sp as (select *, 0 as s, {end('0')} as e, 1 as i from uc where b <> ''),
 sq as (select * from sp union all select * exclude (s, e, i, s2), s2 as s, {end('s2')} as e, 2 as i from (select *, greatest(e - 80, s + 1) as s2 from sp where e < n)),
 sx as (select *, {strip('substring(b, s + 1, (e - s)::int)')} as excerpt from sq),
 sr as (select *, row_number() over (partition by textbook_id order by page_start, char_count desc, chapter_ord, i) as rank from sx where length(excerpt) >= 220),
 src as (select textbook_id || ':' || chapter_id || ':src_' || lpad(i::varchar, 2, '0') as source_id, textbook_id, chapter_id, title, rank, substring(excerpt, 1, 720) as excerpt from sr
   where rank <= (select greatest(6, ceil({n} * 1.6 / greatest(1, count(distinct textbook_id)))) from {CHAPTERS}))
"""


def _kind(c: str) -> str:
    return f"case when {heading(c)} in ('', '正文') then 'front' when {level(c)} = 'primary' then 'level1' when {level(c)} = 'secondary' then 'level2' else 'other' end"


TOKENS = """case when coalesce({0}, '') = '' then 0 else greatest(1, round_even(length(regexp_replace({0}, '[^一-鿿]+', '', 'g')) * 0.7::double + len(regexp_extract_all({0}, '[a-zA-Z0-9_]+')) * 1.1::double + greatest(0, length({0}) - length(regexp_replace({0}, '[^一-鿿]+', '', 'g')) - length(regexp_replace({0}, '[^a-zA-Z0-9_]+', '', 'g'))) * 0.15::double, 0))::int end"""

_PLANS = f"""
{_sources(24)},
 num as (select *, row_number() over (order by textbook_id, rank) - 1 as i from src),
 slots as (select 'factual' as question_type, 0 as o, unnest(range(8)) as j union all select 'reasoning', 1, unnest(range(6)) union all select 'comparative', 2, unnest(range(5))),
 single as (select question_type, o, j, [source_id] as source_ids from slots join num on num.i = slots.j % (select count(*) from src)),
 tk as (select source_id, textbook_id, list_distinct({terms('title')}) as t, list_distinct({terms('substring(excerpt, 1, 220)')}) as e from src),
 jac as (select a.source_id as l, b.source_id as r, len(list_intersect(a.t, b.t)) as ti, len(list_distinct(list_concat(a.t, b.t))) as tu, len(list_intersect(a.e, b.e)) as ei, len(list_distinct(list_concat(a.e, b.e))) as eu
   from tk a join tk b on a.source_id < b.source_id and a.textbook_id <> b.textbook_id),
 sim as (select l, r, round((case when tu = 0 then 0.0 else ti::double / tu end) * 0.7 + (case when eu = 0 then 0.0 else ei::double / eu end) * 0.3, 4) as score from jac),
 best as (select l, r, row_number() over (order by score desc, l, r) - 1 as j from sim where score >= 0.16),
 every as (select * from single union all select 'cross_textbook', 3, j, [l, r] from best where j < 5),
 pl as (select 'plan_' || lpad((row_number() over (order by o, j))::varchar, 3, '0') as plan_id, question_type, case question_type when 'factual' then 'easy' when 'cross_textbook' then 'hard' else 'medium' end as difficulty, source_ids from every)
"""

#: The plans as the reference makes them: pairs for comparative ones too, reasoning ones from the second source on, factual ones for what is missing.
_WHOLE_PLANS = f"""
{_sources(24)},
 num as (select *, row_number() over (order by textbook_id, rank) - 1 as i from src),
 tk as (select i, source_id, textbook_id, list_distinct({terms('title')}) as t, list_distinct({terms('substring(excerpt, 1, 220)')}) as e from num),
 jac as (select a.i as l, b.i as r, [a.source_id, b.source_id] as source_ids, len(list_intersect(a.t, b.t)) as ti, len(list_distinct(list_concat(a.t, b.t))) as tu, len(list_intersect(a.e, b.e)) as ei, len(list_distinct(list_concat(a.e, b.e))) as eu
   from tk a join tk b on a.i < b.i and a.textbook_id <> b.textbook_id),
 sim as (select l, r, source_ids, round((case when tu = 0 then 0.0 else ti::double / tu end) * 0.7 + (case when eu = 0 then 0.0 else ei::double / eu end) * 0.3, 4) as score from jac),
 best as (select source_ids, row_number() over (order by score desc, l, r) - 1 as j from sim where score >= 0.16),
 paired as (select case when j < 5 then 'comparative' else 'cross_textbook' end as question_type, case when j < 5 then 2 else 3 end as o, j, source_ids from best where j < 10),
 slots as (select 'factual' as question_type, 0 as o, j, j as place from (select unnest(range(8)) as j) union all select 'reasoning', 1, j, j + 1 from (select unnest(range(6)) as j)
   union all select 'factual', 4, j, j from (select unnest(range(24)) as j) where j >= 14 + (select count(*) from paired)),
 single as (select question_type, o, j, [source_id] as source_ids from slots join num on num.i = slots.place % (select count(*) from src)),
 every as (select * from single union all select * from paired),
 pl as (select 'plan_' || lpad((row_number() over (order by o, j))::varchar, 3, '0') as plan_id, question_type, case question_type when 'factual' then 'easy' when 'cross_textbook' then 'hard' else 'medium' end as difficulty, source_ids from every)
"""


# -- names compared by compatibility form: DuckDB has none, so a table of characters is made by rule -----------------------


def _compatibility() -> str:
    """CTE km: (ch, becomes) of the characters whose compatibility form differs."""
    ranges = ((0xA0, 0x24F), (0x2000, 0x2FE0), (0x3000, 0x3400), (0xF900, 0xFB07), (0xFE30, 0xFFF0))
    changed = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for low, high in ranges for c in range(low, high)]
    changed = [(a, b) for a, b in changed if a != b and unicodedata.normalize("NFC", a) != b]
    quoted = lambda texts: ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f" km as (select unnest([{quoted(a for a, _ in changed)}]) as ch, unnest([{quoted(b for _, b in changed)}]) as becomes)"


def _compatible(name: str, source: str) -> str:
    """CTE of (id, t) with t of the source in compatibility form and lower case."""
    return f""" {name}_c as (select id, unnest(string_split(t, '')) as ch, generate_subscripts(string_split(t, ''), 1) as i from ({source})),
 {name}_s as (select id, lower(nfc_normalize(string_agg(coalesce(becomes, {name}_c.ch), '' order by i))) as t from {name}_c left join km using (ch) group by id),
 {name} as (select x.id, coalesce({name}_s.t, '') as t from ({source}) x left join {name}_s using (id))"""


# Punctuation that names are compared without, and synonyms.
_PUNCTUATION = r"""[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\-_·•:：,，.。;；、/\\|()\[\]{}<>《》“”"''`~!！?？]+"""
_SYNONYM = "白细胞"
_SOUNDS = ("leukocyte", "leucocyte", "whitebloodcell", "whitebloodcells", "白blood细胞", "白血球")


def _key(t: str) -> str:
    return f"regexp_replace({t}, '{_PUNCTUATION}', '', 'g')"


def _meaning(norm: str) -> str:
    parts = norm
    for sound in _SOUNDS:
        parts = f"replace({parts}, '{sound}', '{_SYNONYM}')"
    return f"case when {norm} in ({', '.join(repr(x) for x in _SOUNDS)}) then '{_SYNONYM}' else {parts} end"


def _name_tokens(t: str) -> str:
    han = f"regexp_extract_all({t}, '[一-鿿]')"
    pairs = f"case when len({han}) > 1 then list_transform(range(1, len({han})), lambda i: {han}[i::int] || {han}[i::int + 1]) else [] end"
    return f"list_distinct(list_concat(list_concat(regexp_extract_all({t}, '[a-z0-9]+'), {han}), {pairs}))"


def _chars(c: str = "") -> str:
    return f"(length(coalesce({c}name, '')) + length(coalesce({c}definition, '')) + coalesce(list_sum(list_transform({c}aliases, lambda x: length(x))), 0))"


_EMPTY = "(norm = '' or regexp_matches(norm, '(?i)^(无|空|n/?a|none|null|unknown|未命名)\\z'))"
#: CTEs that end in nd: the nodes with what comparing needs.
_PREPARED = f"""
{_compatibility()},
 n0 as (select *, textbook_id || ':' || node_id as qid from {NODES}),
 {_compatible('cn', "select qid as id, coalesce(name, '') as t from n0")},
 {_compatible('cf', "select qid as id, coalesce(name, '') || ' ' || array_to_string(coalesce(aliases, []), ' ') as t from n0")},
 {_compatible('cd', "select qid as id, coalesce(definition, '') as t from n0")},
 n1 as (select n0.*, {_key('cn.t')} as norm, {_name_tokens('cf.t')} as tokens, {_name_tokens('cd.t')} as said, level = 'primary' or node_type = 'primary' as structure from n0 join cn on cn.id = qid join cf on cf.id = qid join cd on cd.id = qid),
 nd as materialized (select *, {_meaning('norm')} as semantic, {_EMPTY} as vacant from n1)
"""
_JACCARD = "case when len(list_distinct(list_concat(a.{0}, b.{0}))) = 0 then 0.0 else len(list_intersect(a.{0}, b.{0}))::double / len(list_distinct(list_concat(a.{0}, b.{0}))) end"
#: CTEs that end in pf: every pair of valid nodes with its score, by brute force.
_PAIRS = f"""
{_PREPARED},
 va as materialized (select qid, textbook_id, norm, semantic, tokens, said, structure from nd where not vacant),
 pj as (select a.qid as l, b.qid as r, a.textbook_id = b.textbook_id as same, a.structure or b.structure as strict, (a.norm <> '' and a.norm = b.norm) or (a.semantic <> '' and a.semantic = b.semantic) as exact,
   a.norm <> '' and b.norm <> '' and (contains(a.norm, b.norm) or contains(b.norm, a.norm)) as part, {_JACCARD.format('tokens')} as tj, {_JACCARD.format('said')} as dj from va a join va b on a.qid < b.qid),
 pk as (select *, case when exact then 1.0 when part then 0.85 else 0.0 end as nm from pj),
 pe as (select *, round(greatest(0.45::double * nm + 0.35::double * tj + 0.20::double * dj, 0.25::double * tj + 0.15::double * dj + 0.10::double * nm)::varchar::decimal(38, 20), 4)::double as base from pk),
 pf as materialized (select l, r, greatest(case when same then 0.9 else 0.72 end, case when strict then 0.96 else 0 end) as threshold, case when exact then greatest(base, 0.9) else base end as final from pe)
"""
_GROUPS = f"""
{_PAIRS},
 mg as materialized (select l, r, final from pf where final >= threshold),
 sy as (select l as u, r as v from mg union select r, l from mg),
 rc(node, reach) as (select u, u from sy union select rc.node, sy.v from rc join sy on sy.u = rc.reach),
 gr as materialized (select qid, coalesce(component, qid) as component from va left join (select node as qid, min(reach) as component from rc group by 1) using (qid))
"""
_MERGED = f"""
{_GROUPS},
 gm as (select nd.*, component, case when regexp_matches(name, '[一-鿿]') then 0 else 1 end as foreign_, length(coalesce(definition, '')) as dl, {strip("coalesce(definition, '')")} as sd from nd join gr using (qid)),
 top as (select *, row_number() over (partition by component order by foreign_, dl desc, length(name), name, textbook_id, node_ord, qid) as place, row_number() over (partition by component order by (sd = '')::int, length(sd) desc, textbook_id, node_ord, qid) as longest,
   row_number() over (partition by component order by textbook_id, node_ord, qid) as earliest from gm),
 m0 as (select component, max(case when place = 1 then name end) as name, max(case when place = 1 then norm end) as norm, max(case when longest = 1 then nullif(sd, '') end) as definition, count(*) as source_count, max(case when earliest = 1 then textbook_id end) as f1,
   max(case when earliest = 1 then node_ord end) as f2, max(case when earliest = 1 then qid end) as f3, list_distinct(list_transform(flatten(list(list_concat([name], coalesce(aliases, [])))), lambda x: {strip('x')})) as every from top group by 1),
 me as materialized (select component, name, norm, definition, source_count, list_filter(every, lambda x: x <> '' and x <> name) as aliases, 'kg_node_' || lpad((row_number() over (order by norm, f1, f2, f3))::varchar, 4, '0') as node_id from m0),
 mp as (select qid, node_id from gr join me using (component)),
 en as (select s.node_id as s, t.node_id as t, coalesce(relation, 'related') as relation, weight from {EDGES} e join mp s on s.qid = e.textbook_id || ':' || e.source join mp t on t.qid = e.textbook_id || ':' || e.target where s.node_id <> t.node_id),
 je as materialized (select least(s, t) as source, greatest(s, t) as target, relation, round(avg(weight), 4) as weight, count(*) as source_edge_count from en group by all),
 tot as (select sum({_chars()}) as chars, count(*) as nodes, greatest(1, floor(sum({_chars()}) * 0.30::double))::bigint as budget from nd),
 dg as (select node_id, count(*) as degree from (select unnest([source, target]) as node_id from je) group by 1),
 it as materialized (select node_id, {_chars()} as size, length(name) as nl, coalesce(list_sum(list_transform(aliases, lambda x: length(x))), 0) as al, length(coalesce(definition, '')) as dl,
   row_number() over (order by source_count desc, coalesce(degree, 0) desc, (coalesce(definition, '') <> '')::int desc, node_id) as i from me left join dg using (node_id)),
 fo(i, node_id, used, kept, cut) as (
  select 0::bigint, '', 0::bigint, false, null::bigint
  union all
  select x.i, x.node_id, (case when fits then used + size when trims then used + (case when cuts then nl + al + least(room, dl) + 3 else size end) else used end)::bigint, fits or trims, (case when cuts and not fits then room end)::bigint
  from (select it.*, used, budget - used as rest, greatest(0, budget - used - nl - al - 4) as room, size <= budget - used as fits, budget - used > nl + 36 as trims, budget - used > nl + 36 and greatest(0, budget - used - nl - al - 4) > 20 and dl > 0 as cuts
   from fo join it on it.i = fo.i + 1, tot) x),
 whole as (select (select sum(size) from it) <= budget as ok from tot),
 kept as materialized (select me.*, case when cut is not null and not ok then rtrim(substring(definition, 1, cut::int)) || '...' else definition end as said from me join fo using (node_id), whole where kept or ok)
"""


_COMMANDED = f"""
{_compatibility()}, n as (select *, textbook_id || ':' || node_id as qid from {NODES}),
 {_compatible('cn', "select qid as id, coalesce(name, '') as t from n")},
 al as (select qid, unnest(aliases) as a, generate_subscripts(aliases, 1) as i from n),
 {_compatible('ca', "select qid || '#' || i as id, coalesce(a, '') as t from al")},
 k as (select qid, name, {_key('cn.t')} as k from n join cn on cn.id = qid),
 own as (select qid, k as x from k union select qid, {_key('ca.t')} from al join ca on ca.id = qid || '#' || i),
 w(step, t, x) as (values (1, 0, 'co2敏感血小板'), (2, 0, '未命名'), (3, 0, '骨的生长'), (3, 1, 'lpkα信号')),
 gone as (select distinct qid from own where x = '未命名'),
 left_ as (select * from own where qid not in (select qid from gone)),
 e1 as (select step, t, left_.qid from w join left_ using (x)),
 e2 as (select w.step, w.t, k.qid from w join k on k.k <> '' and (contains(k.k, w.x) or contains(w.x, k.k)) where not exists (select 1 from e1 where e1.step = w.step and e1.t = w.t) and k.qid not in (select qid from gone)),
 f as (select step, qid, min(t) as t from (select * from e1 union all select * from e2) group by 1, 2),
 base as (select qid from f where step = 3 order by t, qid limit 1)
"""


_CONFLICTS = f"""
 us as (select *, row_number() over (order by textbook_id, node_ord, qid) as o from nd where length(norm) >= 2 and not vacant and length(definition) >= 20 and not regexp_matches(norm, '^第[一二三四五六七八九十百千万零〇两\\d]+([章节篇编部讲]|节概述)\\z')
   and not regexp_matches(norm, '概述|临床病例分析|本章小结|学习目标|复习题') and norm not in ('正文', '目录', '前言', '绪论', '附录')),
 pr as (select a.norm as normalized_name, a.qid as left_id, b.qid as right_id, round({_JACCARD.format('tokens')}, 4) as token_jaccard, round({_JACCARD.format('said')}, 4) as definition_jaccard from us a join us b on a.norm = b.norm and a.textbook_id <> b.textbook_id and a.o < b.o),
 cf_ as (select * from pr where token_jaccard > 0.6 and definition_jaccard < 0.3)
"""


SQL: dict[str, str] = {
    "chapter_quality": f"""
with c as {CHAPTERS}, t as {BOOKS},
 a as (select textbook_id, count(*) as chapter_count, count(*) filter (where char_count = 0) as empty_chapter_count, count(*) filter (where char_count between 1 and 79) as short_chapter_count,
        count(*) filter (where page_start > page_end) as page_span_inversions from c group by 1),
 d as (select textbook_id, count(*) as duplicate_title_count from (select textbook_id, lower({squeeze('title')}) as k from c where {squeeze('title')} <> '' group by 1, 2 having count(*) > 1) group by 1),
 j as (select t.textbook_id, t.total_chars, t.total_pages, coalesce(chapter_count, 0) as chapter_count, coalesce(empty_chapter_count, 0) as empty_chapter_count, coalesce(short_chapter_count, 0) as short_chapter_count,
        coalesce(page_span_inversions, 0) as page_span_inversions, coalesce(duplicate_title_count, 0) as duplicate_title_count from t left join a using (textbook_id) left join d using (textbook_id)),
 f as (select *, chapter_count = 0 as r1, total_chars = 0 as r2, empty_chapter_count > 0 as r3, chapter_count > 0 and short_chapter_count / greatest(chapter_count, 1) > 0.4 as r4, duplicate_title_count > 0 as r5,
        page_span_inversions > 0 as r6, coalesce(total_pages <= 0, false) as r7 from j),
 s as (select *, greatest(0.0::double, round(1.0::double - r1::int * 0.45::double - r2::int * 0.45::double - r3::int * least(0.2::double, empty_chapter_count * 0.04::double) - r4::int * 0.12::double
        - r5::int * least(0.12::double, duplicate_title_count * 0.03::double) - r6::int * 0.18::double - r7::int * 0.08::double, 2)) as score from f)
select textbook_id, chapter_count, empty_chapter_count, short_chapter_count, page_span_inversions, duplicate_title_count,
 case when chapter_count > 0 then round(total_chars::double / chapter_count, 2) else 0.0::double end as avg_chars_per_chapter, score,
 case when score >= 0.85 then 'good' when score >= 0.6 then 'warning' else 'poor' end as level, (r1::int + r2::int + r3::int + r4::int + r5::int + r6::int + r7::int)::int as warnings from s""",
    "clean_titles": f"""
select textbook_id, chapter_id, {title('title')} as clean, {heading('title')} as heading, {level('title')} as level,
 case when {heading('title')} in ('', '正文') then 'front' when {level('title')} = 'primary' then 'level1' when {level('title')} = 'secondary' then 'level2' else 'other' end as kind from {CHAPTERS}""",
    "content_normalised": f"""
select textbook_id, chapter_id, sha1({body('content')}) as body_hash, length({body('content')})::int as body_length, sha1({query_key('content')}) as key_hash from {CHAPTERS}""",
    "store_chunks": f"""
with c as (select textbook_id, chapter_id, {strip("coalesce(content, '')")} as b from {CHAPTERS}),
 o as (select *, unnest(range(0, length(b), 1040)) as s from c where b <> ''),
 x as (select *, least(length(b), s + 1200) as e, {strip('substring(b, (s + 1)::int, 1200)')} as text from o),
 n as (select *, row_number() over (partition by textbook_id, chapter_id order by s) as i from x where text <> '')
select textbook_id || ':' || chapter_id || ':chunk_' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') as chunk_id, i::int as chunk_index, s::int as char_start, e::int as char_end, sha1(text) as text_hash from n""",
    "search_chunks": rf"""
with recursive c as (select textbook_id, chapter_id, {body('content')} as b from {CHAPTERS} where not {low_chapter('title', 'content')}),
 w(textbook_id, chapter_id, b, n, i, s, e) as (
  select textbook_id, chapter_id, b, length(b), 0, 0, case when length(b) <= 800 then length(b) else
    case when length(regexp_extract(substring(b, 501, 300), '[^。！？!?；;\n]*\z')) < 300 then 800 - length(regexp_extract(substring(b, 501, 300), '[^。！？!?；;\n]*\z')) else 800 end end from c where b <> ''
  union all
  select textbook_id, chapter_id, b, n, i + 1, s2, case when n - s2 <= 800 then n else s2 + case when length(regexp_extract(substring(b, s2 + 501, 300), '[^。！？!?；;\n]*\z')) < 300
    then 800 - length(regexp_extract(substring(b, s2 + 501, 300), '[^。！？!?；;\n]*\z')) else 800 end end
  from (select *, greatest(e - 80, s + 1) as s2 from w where e < n))
select textbook_id || ':' || chapter_id || ':chunk_' || lpad((i + 1)::varchar, greatest(4, length((i + 1)::varchar))::int, '0') as chunk_id, (i + 1)::int as chunk_index, s::int as char_start, e::int as char_end,
 sha1({strip('substring(b, s + 1, e - s)')}) as text_hash from w where {strip('substring(b, s + 1, e - s)')} <> ''""",
    "chunk_estimates": f"""
select textbook_id, sum(greatest(1, ceil((length({body('content')}) - 80) / 720.0)))::bigint as chunks from {CHAPTERS} where not {low_chapter('title', 'content')} and length({body('content')}) > 0 group by 1""",
    "term_statistics": f"""
with t as (select chunk_id, unnest({terms('text')}) as term from {CHUNKS}) select chunk_id, count(*) as terms, count(distinct term) as distinct_terms, max(term) as last_term from t group by 1""",
    "gram_statistics": f"""
with k as (select chunk_id, {query_key('text')} as k from {CHUNKS}), g as (select chunk_id, list_concat({grams('k', 2)}, {grams('k', 3)}) as g from k)
select chunk_id, len(g)::int as grams, len(list_distinct(g))::int as distinct_grams from g""",
    "salient_terms": rf"""
with k as (select question_id, {query_key('question')} as k from eval_items),
 g as (select distinct question_id, unnest(list_concat(list_concat({grams('k', 4)}, {grams('k', 3)}), {grams('k', 2)})) as g from k),
 r as (select *, row_number() over (partition by question_id order by length(g) desc, g) as n from g where regexp_matches(g, '^([一-鿿]+|[a-z0-9]+)\z') and g not in ({STOPS}))
select question_id, string_agg(g, ' ' order by n) as salient from r where n <= 6 group by 1""",
    "opening_sentences": rf"""
select chunk_id, {strip(f"array_to_string(list_transform(list_slice(regexp_extract_all(coalesce(text, ''), '[^。！？!?；;\n]+[。！？!?；;]?'), 1, 2), lambda x: {strip('x')}), ' ')")} as opening from {CHUNKS}""",
    "citation_labels": f"""
select chunk_id, '[' || concat_ws(', ', textbook_title, chapter_title, {pages('page_start', 'page_end')}) || ']' as citation from {CHUNKS}""",
    "token_estimates": f"""
with x as (select textbook_id, text, length(regexp_replace(text, '[^一-鿿]+', '', 'g')) as han, len(regexp_extract_all(text, '[a-zA-Z0-9_]+')) as words, length(regexp_replace(text, '[^a-zA-Z0-9_]+', '', 'g')) as letters from {CHUNKS})
select textbook_id, sum(case when text = '' then 0 else greatest(1, round_even(han * 0.7::double + words * 1.1::double + greatest(0, length(text) - han - letters) * 0.15::double, 0)) end)::bigint as tokens, count(*) as chunks from x group by 1""",
    "embedding_texts": f"""
select textbook_id, node_id, substring({strip("concat_ws(chr(10), nullif(coalesce(name, ''), ''), nullif(array_to_string(coalesce(aliases, []), ' '), ''), nullif(coalesce(definition, ''), ''), nullif(coalesce(category, ''), ''), nullif(coalesce(chapter_title, ''), ''))")}, 1, 1200) as embedding_text,
 (length(coalesce(name, '')) + length(coalesce(definition, '')) + coalesce(list_sum(list_transform(aliases, lambda x: length(x))), 0))::int as char_count from {NODES}""",
    "textbook_signatures": f"""
with c as (select textbook_id, string_agg(sha1(chapter_id || chr(0) || title || chr(0) || coalesce(content, '')), chr(0) order by chapter_ord) as h from {CHAPTERS} group by 1)
select textbook_id, sha1(coalesce(filename, '') || chr(0) || coalesce(title, '') || chr(0) || coalesce(h, '') || chr(0)) as signature from {BOOKS} left join c using (textbook_id)""",
    "low_signal_chapters": f"select textbook_id, chapter_id from {CHAPTERS} where {low_chapter('title', 'content')}",
    "graph_edges": f"""
with {_PLACED},
 n as (select *, textbook_id || '_' || chapter_id || '_block' as id, row_number() over (partition by textbook_id order by chapter_ord) as i, lead(textbook_id || '_' || chapter_id || '_block') over (partition by textbook_id order by chapter_ord) as nxt from b)
select textbook_id, i::int as edge_ord, textbook_id || '_' || chapter_id || '_parent_' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') as edge_id, parent as source, id as target, 'contains' as relation, 1.0::double as weight from n
union all select textbook_id, i::int, textbook_id || '_chapter_prereq_' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0'), id, nxt, 'prerequisite', 0.8::double from n where nxt is not null""",
    "distinct_edges": f"""
with e as (select textbook_id, least(source, target) as source, greatest(source, target) as target, lower(relation) as relation, weight, evidence from {EDGES} where source <> target),
 v as (select distinct textbook_id, source, target, relation, {strip('x')} as x from (select *, unnest(evidence) as x from e)),
 l as (select textbook_id, source, target, relation, string_agg(x, chr(10) order by x) as evidence from v where x <> '' group by all),
 g as (select textbook_id, source, target, relation, round(avg(weight), 4) as weight, count(*) as source_edge_count from e group by all)
select g.*, coalesce(l.evidence, '') as evidence from g left join l using (textbook_id, source, target, relation)""",
    "node_degrees": f"select textbook_id, node_id, count(*) as degree from (select textbook_id, unnest([source, target]) as node_id from {EDGES}) group by all",
    "graph_statistics": f"""
select textbook_id, 'nodes:' || level as measure, count(*) as n from {NODES} group by all union all select textbook_id, 'edges:' || lower(relation), count(*) from {EDGES} group by all""",
    "graph_union": f"select textbook_id || ':' || edge_id as edge_id, textbook_id || ':' || source as source, textbook_id || ':' || target as target, relation, weight from {EDGES}",
    "keyword_search": _search("keyword"),
    "ngram_search": _search("char_ngram"),
    "eval_coverage": """
select 'question_type' as dimension, question_type as value, count(*) as n from eval_items group by 2 union all select 'difficulty', difficulty, count(*) from eval_items group by 2
union all select 'textbook', c.textbook_id, count(*) from (select unnest(expected_citations) as c from eval_items) group by 2""",
    "decision_counts": f"""
select action, coalesce(reason, '') as reason, count(*) as n, round(avg(confidence), 4) as confidence, sum(coalesce(len(node_ids), 0))::bigint as nodes from {DECISIONS} group by 1, 2""",
    "node_search": f"""
select textbook_id, node_id, name, case when level = 'primary' or node_type = 'chapter' then 'hexagon' when category = '内容块' then 'square' when category in ('疾病', '方法') then 'diamond' else 'circle' end as shape
from {NODES} where contains(lower(concat_ws(chr(10), name, definition, chapter_title, textbook_id, array_to_string(coalesce(aliases, []), chr(10)))), 'lpk')""",
    "visible_edges": f"""
with n as {NODES}, e as {EDGES}, p as (select min(parent_id) as id from n), s as (select distinct textbook_id, node_id from n, p where level = 'primary' or parent_id = p.id)
select textbook_id, edge_id, source, target from e where (textbook_id, source) in (select textbook_id, node_id from s) and (textbook_id, target) in (select textbook_id, node_id from s)""",
    "node_layout": f"""
with n as {NODES}, d as (select textbook_id, node_id, count(*) as degree from (select textbook_id, unnest([source, target]) as node_id from {EDGES}) group by all),
 r as (select n.textbook_id, n.node_id, n.frequency, row_number() over (partition by n.textbook_id order by coalesce(degree, 0) desc, coalesce(n.frequency, 0) desc, n.node_id) - 1 as i from n left join d using (textbook_id, node_id)),
 a as (select *, case when i = 0 then 0.0::double else 92 + 46 * ceil(sqrt(i)) end as ring, i * (pi() * (3 - sqrt(5))) as angle from r)
select textbook_id, node_id, i::int as i, round(600 + cos(angle) * ring, 3) as x, round(380 + sin(angle) * ring * 0.72::double, 3) as y, round(least(42.0::double, greatest(17.0::double, 15 + 3.2::double * sqrt(greatest(1, coalesce(frequency, 1))))), 3) as r from a""",
    "chat_history": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5",
    "event_windows": "select date_trunc('hour', ts)::timestamp as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "graph_nodes": f"""
with {_PLACED},
 x as (
  select textbook_id, chapter_ord, pid as node_id, title as name, 'primary' as level, null as parent_id, greatest(1, floor(char_count / 1000))::int as frequency, coalesce(content, '') as t, title,
   {squeeze("coalesce(content, '')")} as f, true as head from q where lvl = 'primary' and nth = 1
  union all
  select textbook_id, chapter_ord, textbook_id || '_' || chapter_id || '_block', {squeeze("replace(title, '|', ' | ')")}, 'secondary', parent, greatest(1, floor(char_count / 800))::int, coalesce(content, ''), title, {squeeze("coalesce(content, '')")}, false from b),
 y as (select *, {marked('f')} as m from x),
 z as (select *, case when f = '' then null when head then coalesce(list_filter(m, lambda v: contains(v, title) and length(v) between 12 and 260)[1], substring(list_filter(m, lambda v: length(v) >= 24)[1], 1, 260), substring(f, 1, 260))
   else coalesce(substring(list_filter(m, lambda v: length(v) >= 28)[1], 1, 260), substring(f, 1, 260)) end as d from y)
select textbook_id, row_number() over (partition by textbook_id order by chapter_ord)::int as node_ord, node_id, name, level, parent_id, frequency,
 sha1(coalesce(d, case when head then substring(t, 1, 220) end, '')) as definition_hash, sha1({excerpt('t', 'title')}) as excerpt_hash from z""",
    "chapter_groups": f"""
with c as (select *, {_kind('title')} as kind, {heading('title')} as k, nullif(page_start, 0) as ps, nullif(page_end, 0) as pe from {CHAPTERS}),
 l as (select *, lead(kind) over w as nk, lead(ps) over w as np, lead(chapter_ord) over w as no from c window w as (partition by textbook_id order by chapter_ord)),
 s as (select *, coalesce(kind = 'level2' and nk = 'level1' and ps = np, false) as swap from l),
 a as (select *, case when swap then no + 0.5 else chapter_ord::double end as pos, coalesce(lag(swap) over (partition by textbook_id order by chapter_ord), false) as after from s),
 o as (select *, case when kind = 'level1' then case when after then chapter_id else first_value(chapter_id) over (partition by textbook_id, k order by pos) end end as opened from a),
 g as (select *, last_value(opened ignore nulls) over (partition by textbook_id order by pos rows between unbounded preceding and current row) as gid from o)
select textbook_id, 'group_' || gid as group_id, arg_min(title, pos) as title, min(ps) as page_start, max(pe) as page_end, sum(char_count)::bigint as char_count,
 count(distinct case when kind <> 'level1' then k || chr(0) || coalesce(ps, -chapter_ord) end) as children from g where gid is not null and kind <> 'front' group by 1, 2""",
    "vector_search": f"with {_NEAR} select query_id, chunk_id, round(similarity, 4) as similarity, rank::int as rank from vr where rank <= 5",
    "hybrid_search": f"""
with {_NEAR},
 cand as materialized (select query_id as question_id, chunk_id, similarity from vr where rank <= 10),
 ask as (select chunk_id as question_id, {strip(f"array_to_string(list_transform(list_slice(regexp_extract_all(coalesce(text, ''), '[^。！？!?；;\\n]+[。！？!?；;]?'), 1, 1), lambda x: {strip('x')}), ' ')")} as question from {CHUNKS} where chunk_id in (select question_id from cand)),
 {_lexical('ask', f"(select * from {CHUNKS} where chunk_id in (select chunk_id from cand))")},
 sc as (select question_id, chunk_id, greatest(0.0, least(1.0, similarity * 0.45 + coalesce(kw, 0) * 0.22 + coalesce(ng, 0) * 0.18 + coalesce(ti, 0) * 0.15 + coalesce(w, 0) - coalesce(low, 0))) as score from cand left join lx using (question_id, chunk_id)),
 rk as (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from sc where score > 0)
select question_id, chunk_id, round(score, 4) as score, rank::int as rank from rk where rank <= 5""",
    "search_answers": f"""
with m as ({_search('keyword')}), c as {CHUNKS}
select question_id, trim({first_sentence('text')} || ' ' || '[' || concat_ws(', ', textbook_title, chapter_title, {pages('page_start', 'page_end')}) || ']') as answer from m join c using (chunk_id) where rank = 1""",
    "eval_sources": f"with {_sources(24)} select source_id, textbook_id, chapter_id, rank::int as rank, sha1(excerpt) as excerpt_hash from src",
    "eval_plans": f"with {_WHOLE_PLANS} select * from pl",

    "entity_groups": f"with recursive {_GROUPS} select qid, component from gr",
    "integrated_nodes": f"with recursive {_MERGED} select node_id, name, said as definition, source_count from kept",
    "integrated_edges": f"""
with recursive {_MERGED} select source, target, relation, weight, source_edge_count from je where source in (select node_id from kept) and target in (select node_id from kept)""",
    "integration_stats": f"""
with recursive {_MERGED}, k as (select count(*) as n, coalesce(sum(length(coalesce(name, '')) + length(coalesce(said, '')) + coalesce(list_sum(list_transform(aliases, lambda x: length(x))), 0)), 0) as c from kept)
select nodes as source_node_count, n as merged_node_count, chars::int as source_char_count, c::bigint as merged_char_count, budget as char_budget, round(n::double / nodes, 4) as compression_ratio, round(1.0 - n::double / nodes, 4) as node_reduction_ratio,
 round(c::double / chars, 4) as char_compression_ratio, c <= budget as budget_met from k, tot""",
    "integration_decisions": f"""
with recursive {_MERGED},
 nb as (select q, max(final) as near from (select l as q, final from pf union all select r, final from pf) group by 1),
 mb as (select x.component, max(final) as score from pf join gr x on x.qid = l join gr y on y.qid = r where x.component = y.component group by 1)
select 'remove' as action, null as result_node, name as canonical_name, 1.0::double as score, 1.0::double as confidence, 'empty name' as reason from nd where vacant
union all select 'merge', node_id, name, score, score, 'equivalent nodes' from me left join mb using (component) where source_count > 1
union all select 'keep', node_id, name, coalesce(near, 0), round((1 - least(coalesce(near, 0), 0.72) / 0.72::double)::varchar::decimal(38, 20), 4)::double, case when coalesce(near, 0) >= 0.48 then 'weakly similar' else 'nothing similar' end from me left join nb on nb.q = component where source_count = 1
union all select 'remove', null, name, 0.72, 0.72, 'character budget' from me where node_id not in (select node_id from kept)""",
    "definition_conflicts": f"with {_PREPARED}, {_CONFLICTS} select * from cf_",

    "decision_ranking": f"""
with {_compatibility()}, d as {DECISIONS},
 {_compatible('ct', "select decision_id as id, concat_ws(' ', canonical_name, reason, result_node, array_to_string(coalesce(affected_nodes, []), ' '), array_to_string(coalesce(node_ids, []), ' ')) as t from d")},
 m as (select d.*, (action = 'merge')::int * 2 + case when contains({_key('ct.t')}, 'lpkα信号') or contains('lpkα信号', {_key('ct.t')}) then 4 else 0 end as match from d join ct on ct.id = decision_id)
select decision_id, match, confidence from m where match > 0 order by match desc, confidence desc, score desc, decision_ord limit 10""",
    "feedback_applied": f"with {_COMMANDED} select k.qid as node_id, name, case when k.qid in (select qid from base) then 'merge' when k.qid in (select qid from f where step = 1) then 'keep' end as teacher_feedback from k where k.qid not in (select qid from gone) and (k.qid not in (select qid from f where step = 3) or k.qid in (select qid from base))",

    "eval_dataset": rf"""
with {_PLANS},
 ct as (select plan_id, question_type, difficulty, i as pos, source_id from (select *, unnest(source_ids) as source_id, generate_subscripts(source_ids, 1) as i from pl)),
 so as (select ct.*, src.title as chapter, src.excerpt, b.title as book, {strip(r"array_to_string(list_transform(list_slice(regexp_extract_all(src.excerpt, '[^。！？!?；;\n]+[。！？!?；;]?'), 1, 1), lambda x: " + strip('x') + "), ' ')")} as said from ct join src using (source_id) left join {BOOKS} b on b.textbook_id = src.textbook_id),
 g as (select plan_id, question_type, difficulty, arg_min(coalesce(book, ''), pos) as b1, arg_min(coalesce(chapter, ''), pos) as c1, arg_max(coalesce(book, ''), pos) as b2, arg_min(excerpt, pos) as e1, count(*) as citations, substring(trim(string_agg(said, ' ' order by pos)), 1, 220) as answer from so group by all)
select replace(plan_id, 'plan', 'q') as question_id, question_type, difficulty, citations::int as citations, case when answer <> '' then answer else substring(e1, 1, 180) end as expected_answer,
 case question_type when 'factual' then '根据《' || b1 || '》中“' || c1 || '”的内容，请概括该知识点的核心定义或要点。' when 'reasoning' then '根据《' || b1 || '》中“' || c1 || '”的片段，概括其中描述的机制、原因或后果。'
  else '结合《' || b1 || '》和《' || b2 || '》相关片段，比较两段内容的联系与差异。' end as question from g""",
    "requested_textbooks": f"""
select ord, i.textbook_id, b.title, b.textbook_id is not null as found from (values (1, 'book_02'), (2, 'no_such_book'), (3, 'book_00'), (4, 'book_01')) i(ord, textbook_id) left join {BOOKS} b using (textbook_id)""",
    "query_tokens": """
select question_id, TOKQ as input_tokens, TOKA as output_tokens, (TOKQ) + (TOKA) as total_tokens from eval_items""".replace("TOKQ", TOKENS.format("question")).replace("TOKA", TOKENS.format("expected_answer")),
    "index_job": f"""
select 'queued' as status, (select count(distinct textbook_id) from {CHAPTERS}) as textbook_count, (select count(*) from {CHAPTERS}) as chapter_count,
 coalesce((select sum(greatest(1, ceil((length({body('content')}) - 80) / 720.0)))::bigint from {CHAPTERS} where not {low_chapter('title', 'content')} and length({body('content')}) > 0), 0) as estimated_chunk_count""",
    "decision_sources": f"""
with x as (select decision_id, unnest(list_distinct(list_concat(coalesce(affected_nodes, []), coalesce(node_ids, [])))) as qid from {DECISIONS}),
 y as (select distinct decision_id, name from x join {NODES} n on n.textbook_id || ':' || n.node_id = x.qid) select decision_id, string_agg(name, '|' order by name) as sources from y group by 1""",
    "graph_view": f"""
select n.textbook_id, node_id as id, name as label, coalesce(frequency, 1) as frequency, coalesce(source_textbook_id, n.textbook_id) as source_id, b.title as source_title, coalesce(chapter_title, chapter_id, '') as chapter_title, coalesce(definition, '') as description,
 node_type as type, category, level from {NODES} n left join {BOOKS} b on b.textbook_id = n.textbook_id""",
    "node_conflicts": f"""
with recursive {_MERGED}, {_CONFLICTS},
 nc as (select distinct mp.node_id, left_id, right_id, left_id || '|' || right_id as cid from (select unnest([left_id, right_id]) as qid, left_id, right_id from cf_) join mp using (qid) where mp.node_id in (select node_id from kept))
select node_id, count(*)::int as conflicts, arg_min(left_id, cid) as left_id, arg_min(right_id, cid) as right_id from nc group by 1""",
    "feedback_decisions": f"""
with {_COMMANDED}
select 'feedback_' || lpad(f.step::varchar, 3, '0') as decision_id, case f.step when 1 then 'keep' when 2 then 'remove' else 'merge' end as action, f.qid as affected_node, case when f.step = 3 then (select qid from base) end as result_node,
 first_value(k.name) over (partition by f.step order by f.t, f.qid) as canonical_name from (select * from f where step <> 2 union all select 2, qid, 0 from gone) f join k using (qid)""",
}
