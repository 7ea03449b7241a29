"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _clusters(k: int, rounds: int) -> str:
    """Lloyd's rounds as one common table expression after the other."""
    nearest = """
        a{i} as (
            select vec_id, q, cluster, distance from (
                select v.vec_id, v.q, c.cluster,
                       list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
                from v, c{i} c
            ) qualify row_number() over (partition by vec_id order by distance, cluster) = 1
        )"""
    move = """
        m{i} as (
            select cluster, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as x
            from (select cluster, unnest(q) as x, generate_subscripts(q, 1) as d from a{i}) group by cluster, d
        ), c{j} as (
            select c.cluster, coalesce(m.q, c.q) as q
            from c{i} c left join (select cluster, list(x::bigint order by d) as q from m{i} group by cluster) m using (cluster)
        )"""
    steps = [nearest.format(i=0)]
    for i in range(rounds):
        steps += [move.format(i=i, j=i + 1), nearest.format(i=i + 1)]
    return f"""
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), c0 as (
            select (row_number() over (order by h) - 1)::int as cluster, q
            from (select q, sha256('1:' || vec_id) as h from v order by h limit {k})
        ), {", ".join(steps)}
        select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
               sum(distance) over ()::bigint as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
        from a{rounds} join c{rounds} c using (cluster)
    """


ORACLES: dict[str, str] = {
    "op4_chat": r"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e as (
            select *, regexp_replace(t, '([<\[])(\\*)(\|[A-Za-z0-9_]*\|>|/?s>|/?SYS>>|/?INST\])', '\1\2\\\3', 'g') as et,
                   regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z0-9_]*\|>|/?s>|/?SYS>>|/?INST\])', '\1\2\\\3', 'g') as er
            from c
        )
        select conv_id,
               count(*) as n_turns,
               sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn nulls first, role, et)) as turns_sha256,
               coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(t, '' order by turn nulls first, role, et) filter (role = 'assistant'), '')) as loss_sha256,
               sum(23 + length(er) + length(et))::bigint as formatted_chars
        from e group by conv_id
    """,
    "op5_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id,
               max(doc_id) over w as keep_id,
               count(*) over w as group_size,
               doc_id is not distinct from max(doc_id) over w as kept,
               sha256(t) as text_sha256
        from d window w as (partition by t)
    """,
    "op11_mixing": r"""
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
        ), s as (
            select *, [1, 2, 3][(number % 3 + 1)::int] as w from (
                select source, sum(size)::bigint as n, row_number() over (order by source nulls last) - 1 as number from d group by source
            )
        ), l as (
            select *, sum(n) over () as words,
                   (sum(n) over () - coalesce(sum(3 * n) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level
            from s window o as (order by n / w, number rows between unbounded preceding and 1 preceding)
        ), t as (
            select source, number, n, words, least((3 * n)::double, w * max(level) over ()) as target from l
        ), c as (
            select *, least(2147483648, coalesce(round(sum(target) over (order by number) / nullif(words, 0) * 2147483648), 0)::bigint) as high from t
        ), b as (
            select *, lag(high, 1, 0) over (order by number) as low from c
        ), p as (
            select (i % 2147483648) * 1327217885 % 2147483648 as point
            from (select unnest(range(((select sum(size) from d) + 63)::bigint // 64)) as i)
        ), k as (
            select number, count(*) * 64 as upto from b join p on low <= point and point < high group by number
        ), e as (
            select d.doc_id, d.size, b.n, b.target, coalesce(k.upto, 0) as upto,
                   sum(d.size) over (partition by b.number
                       order by md5('mix|' || coalesce(d.doc_id::varchar, '') || '|' || d.size), d.doc_id, d.size
                       rows unbounded preceding) as until
            from d join b on d.source is not distinct from b.source left join k on k.number = b.number
        )
        select doc_id, size, n as source_size, target,
               list_sum(list_transform([0, 1, 2], lambda r: greatest(0, least(until + r * n, upto) - (until - size + r * n))))::bigint as taken
        from e
    """,
    "op12_hard_negatives": """
        with r as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as a, r.vec_id as id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
            from r a join r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id
        ), p as (
            select a, id, score from s where same qualify row_number() over (partition by a order by score desc, id) <= 5
        )
        select p.a as anchor_id, p.id as positive_id,
               (row_number() over (partition by p.a, p.id order by n.score desc, n.id))::int as rank,
               n.id as negative_id, p.score as positive_score, n.score as negative_score
        from p join s n on n.a = p.a and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
        qualify rank <= 3
    """,
    "op13_clustering": _clusters(16, 3),
}
