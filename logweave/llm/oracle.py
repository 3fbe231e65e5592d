"""SQL (DuckDB) forms of operators whose own modules have none."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
with docs as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
rows as (select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from docs),
keyed as (select *, translate(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), '{UPPER}', '{LOWER}') as key from rows),
shared as (select key, max(doc_id) as stays from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.rid, k.doc_id, k.pos, k.line, s.stays is not null and s.stays <> k.doc_id as lost from keyed k left join shared s on s.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from marked group by rid, doc_id
"""

NEAREST = """
with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.vec_id as query_id, c.vec_id, list_distance(q.e, c.e) as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d) where rank <= 10
"""
