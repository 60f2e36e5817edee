"""SQL for DuckDB that gives the rows of those corpus queries that SQL can express."""

from __future__ import annotations

from . import decontam, licenses
from .common import ASCII_UPPER


def _words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"
    return rf"list_filter(string_split_regex({lower}, '{decontam.SPLIT}'), lambda x: x <> '')"


def decontamination(window: int = 13) -> str:
    return f"""with d as (select doc_id, {_words("text")} as w from documents), i as (select distinct item_id, {_words("text")} as w from benchmark),
    n as (select item_id, w, least({window}, len(w)) as span from i where len(w) > 0), iw as (select distinct item_id, span, w[s:s + span - 1] as v from n, lateral (select unnest(range(1, len(w) - span + 2)) as s)),
    z as (select distinct span from iw), dw as (select doc_id, span, s, w[s:s + span - 1] as v from d, z, lateral (select unnest(range(1, len(w) - span + 2)) as s)),
    o as (select doc_id, s, span, item_id from dw join iw using (span, v)), h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + span)) as p from o) group by 1),
    t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from o) group by 1)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join h using (doc_id) left join t using (doc_id)"""


def license_scan() -> str:
    """Runs of segments of a paragraph are looked up; from left to right the longest at each place counts."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in licenses.SENTENCES.items())
    most = max(len(v.split()) for v in licenses.SENTENCES.values())
    rules = ", ".join("case when regexp_matches(line, '{}') then '{}' end".format("," + ",(?:.*,)?".join(seq) + ",", name) for name, seq in licenses.RULES)
    return rf"""with recursive k as (select * from (values {known}) t(sid, sentence)),
    m as (select doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{licenses.PARAGRAPH_END}', ' H ', 'g'), '[.!?;:]+(\s)', ' S \1', 'g'), '\n', ' S ', 'g') as x from documents),
    p as (select doc_id, unnest(string_split(regexp_replace(x, '[^a-z0-9HS]+', ' ', 'g'), 'H')) as para, generate_subscripts(string_split(regexp_replace(x, '[^a-z0-9HS]+', ' ', 'g'), 'H'), 1) as pn from m),
    s as (select doc_id, pn, unnest(string_split(para, 'S')) as seg, generate_subscripts(string_split(para, 'S'), 1) as sn from p), g as (select doc_id, pn, trim(seg) as seg, row_number() over (partition by doc_id order by pn, sn) as i from s where trim(seg) <> ''),
    first as (select sentence, sid, string_split(sentence, ' ')[1] as head from k),
    runs as (select g.doc_id, g.pn, g.i, g.i as j, g.seg as text from g join (select distinct head from first) f on g.seg = f.head or starts_with(g.seg, f.head || ' ')
      union all select r.doc_id, r.pn, r.i, g.i, r.text || ' ' || g.seg from runs r join g on g.doc_id = r.doc_id and g.pn = r.pn and g.i = r.j + 1 where len(string_split(r.text, ' ')) < {most} and exists (select 1 from k where starts_with(k.sentence, r.text || ' '))),
    c as (select doc_id, i, max(struct_pack(j := j, sid := sid)) as best from runs join k on runs.text = k.sentence group by 1, 2),
    r as (select doc_id, min(struct_pack(i := i, best := best)) as x, 1 as n from c group by 1 union all select c.doc_id, min(struct_pack(i := c.i, best := c.best)), any_value(r.n) + 1 from r join c on c.doc_id = r.doc_id and c.i > r.x.best.j group by c.doc_id),
    l as (select doc_id, count(*) as n, ',' || string_agg(x.best.sid, ',' order by n) || ',' as line from r group by 1),
    j as (select doc_id, n, line[2:-2] as sentence_ids, array_to_string(list_sort(list_distinct([x for x in [{rules}] if x is not null])), ',') as licenses from l)
    select d.doc_id, coalesce(n, 0)::bigint as n_sentences, coalesce(sentence_ids, '') as sentence_ids, coalesce(licenses, '') as licenses from documents d left join j using (doc_id)"""


def lexical_search(k: int = 10) -> str:
    """All scores of all documents that share a term with an item, then the best of each."""
    terms = rf"list_filter(string_split_regex(translate(coalesce({{}}, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""with d as (select row_number() over () as r, doc_id, {terms.format("text")} as t from documents), s as (select count(*) filter (len(t) > 0) as big_n, sum(len(t))::bigint as big_l from d),
    p as (select r, doc_id, term, count(*) as tf, any_value(n) as n from (select r, doc_id, len(t) as n, unnest(t) as term from d) group by all), w as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s group by term, big_n),
    q as (select distinct item_id, unnest({terms.format("text")}) as term from benchmark),
    x as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::bigint as score from q join p using (term) join w using (term), s group by all)
    select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int as rank, doc_id, score from x where score > 0 qualify rank <= {k}"""


def conversation_repair() -> str:
    """The cheapest edits row by row: of each state after a row, the least cost and, of equal costs, the least audit."""
    word = lambda name: f"coalesce({name}::varchar, ' ')"
    spaces = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return rf"""with recursive crc_table as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as t),
    raw as (select conv_id, turn, {word("role")} as role, {word("text")} as text, {word("conv_id")} || ':' || {word("turn")} as key from conversations),
    drawn as (select raw.*, xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda x: ord(x)::bigint), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) % 20 as k from raw, crc_table),
    hurt as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when k = 3 then [0, 1] else [0] end) as copy from drawn where k <> 0),
    o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, rtrim(text, {spaces}) as kept, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as initial from hurt),
    f as (select *, case when kept = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(kept, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault, lag(initial) over (partition by conv_id order by i) || initial as pair from o),
    n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
      count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as last from f group by 1),
    -- states: nothing written, s, ends in u, ends in a
    reach as (select * from (values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)) t(q, z, n)),
    moves as (select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) t(q, role, z)),
    edits as (select q, null as initial, 'D' as letter, 3 as cost, '' as role, q as z from range(4) t(q) union all select q, role, 'K', 0, role, z from moves union all select q, null, 'R', 2, role, z from moves where role in ('u', 'a')),
    steps as (select e.q, e.initial, e.letter, e.cost + 2 * r.n as cost, r.z, e.letter || repeat('I', r.n) as audit, e.z as mid, e.role from edits e join reach r on e.z = r.q),
    walk as (select conv_id, 0::bigint as i, z, struct_pack(cost := (2 * n)::bigint, audit := repeat('I', n)) as best from n as c, reach where q = 0
      union all select w.conv_id, w.i + 1, s.z, min(struct_pack(cost := w.best.cost + s.cost + case when f.fault = 'truncated' and s.letter <> 'D' then 1 else 0 end, audit := w.best.audit || s.audit))
      from walk w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 join steps s on s.q = w.z and (s.initial is null or s.initial = f.initial) and (s.letter = 'D' or f.fault not in ('blank', 'duplicate')) group by w.conv_id, w.i, s.z),
    done as (select n.conv_id, min(best) as best from walk w join n on n.conv_id is not distinct from w.conv_id and n.last = w.i where z in (0, 3) group by 1),
    letters as (select conv_id, unnest(string_split(best.audit, '')) as letter, generate_subscripts(string_split(best.audit, ''), 1) as p from done where best.audit <> ''),
    placed as (select *, count(*) filter (letter <> 'I') over (partition by conv_id order by p) as i from letters),
    spoken as (select p.conv_id, p.p, letter, case when letter = 'I' then '' else f.role end as role, case when letter = 'I' then '' else f.text end as text, case when letter = 'I' then '' else f.initial end as initial from placed p join f on f.conv_id is not distinct from p.conv_id and f.i = greatest(p.i, 1) where letter <> 'D'),
    turns as (select *, row_number() over (partition by conv_id order by p) - (first(initial = 's' and letter = 'K') over (partition by conv_id order by p))::int as place from spoken),
    said as (select conv_id, sha256(string_agg(case when letter = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by p)) as h from turns group by 1)
    select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
    from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id left join done d on d.conv_id is not distinct from c.conv_id left join said s on s.conv_id is not distinct from c.conv_id"""
