"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _number(text: str, salt: str, least: int, count: int) -> str:
    return f"(('0x' || substr(md5('{salt}' || {text}), 1, 8))::bigint % {count} + {least})"


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"

_CRC32 = """xor(4294967295::bigint, list_reduce(
      list_concat([4294967295::bigint], list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
        lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)))"""


def _tree(name: str, levels: int) -> str:
    """Tables `name`1, .. of a 16-ary hash tree's nodes (g, i, h, n) over `name`0, and `name`0g, .. with the runs of each level."""
    steps = [
        f"""{name}{k}g as (select g, i // 16 as p, list(h order by i) as hs, any_value(n) as n from {name}{k} group by g, i // 16),
        {name}{k + 1} as (select g, p as i, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h, (n + 15) // 16 as n
          from {name}{k}g)"""
        for k in range(levels)
    ]
    return ",\n        ".join(steps)


def _proof(name: str, levels: int, start: str) -> str:
    """Tables `name`p0, .. over `start` (g, i, proof, folded and more): proof and folded hash after each level."""
    steps, last = [], start
    for k in range(levels):
        at = f"(i // {16**k} % 16)::int"
        steps.append(
            f"""{name}p{k} as (select l.* replace (
            l.proof || case when t.n > 1 then array_to_string(t.hs[1:{at}], '') || array_to_string(t.hs[{at} + 2:], '') else '' end as proof,
            case when t.n > 1 then sha256(array_to_string(t.hs[1:{at}], '') || l.folded || array_to_string(t.hs[{at} + 2:], ''))
              else l.folded end as folded)
          from {last} l join {name}{k}g t on l.g is not distinct from t.g and l.i // {16 ** (k + 1)} = t.p)"""
        )
        last = f"{name}p{k}"
    return ",\n        ".join(steps)


def _fields(text: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)]
    return f"sha256({' || '.join(parts)})"


_LEVELS = 5  # enough for a million rows in a source and a million sources

ORACLES = {
    "op1_pfair_mixing": """
        with recursive n as (select source, count(*) as n from documents group by source),
        w as (select source, n, ceil(n / 16.0)::bigint as blocks,
            greatest(1, floor(sqrt(n) * 1000 / (select sum(sqrt(n) order by source) from n) + 0.5))::bigint as a from n),
        src as (select list(a order by source nulls last) as a, list(blocks order by source nulls last) as blocks,
            list(source order by source nulls last) as names, count(*)::bigint as k from w),
        run(t, start, phase, base, used, pick, rel, due) as (
          select -1::bigint, 0::bigint, 0::bigint, list_transform(names, lambda x: 0::bigint),
            list_transform(names, lambda x: 0::bigint), 0::bigint, 0::bigint, 0::bigint from src
          union all
          select t, case when used[pick] = blocks[pick] then t + 1 else start end,
            case when used[pick] = blocks[pick] then phase + 1 else phase end,
            case when used[pick] = blocks[pick] then used else base end, used, pick, rel, due
          from (
            select t, start, phase, base, blocks, best[2] as pick, best[3] as rel, best[1] as due,
              list_transform(range(1, k + 1), lambda s: used[s] + case when s = best[2] then 1 else 0 end) as used
            from (
              select t, start, phase, base, used, blocks, k, list_min(list_transform(
                list_filter(range(1, k + 1), lambda s: used[s] < blocks[s] and (used[s] - base[s]) * total // a[s] <= t - start),
                lambda s: [start - ((-((used[s] - base[s]) + 1) * total) // a[s]), s, start + (used[s] - base[s]) * total // a[s]])) as best
              from (
                select run.t + 1 as t, start, phase, base, used, a, blocks, k,
                  list_sum(list_transform(list_filter(range(1, k + 1), lambda s: used[s] < blocks[s]), lambda s: a[s]))::bigint as total
                from run, src where list_sum(used) < list_sum(blocks)
              )
            )
          )
        ),
        slots as (
          select t as slot, names[pick] as source, rel, due,
            row_number() over (partition by pick order by t) - 1 as block, used, pick, t
          from run, src where t >= 0
        ),
        phases as (select t, coalesce(lag(phase) over (order by t), 0) as phase from run),
        docs as (
          select doc_id, source, row_number() over (partition by source
            order by md5(coalesce(doc_id::varchar, '')), doc_id) - 1 as k from documents
        )
        select doc_id, docs.source, (docs.k // 16)::bigint as block, phases.phase::bigint as phase, rel::bigint as release,
          due::bigint as due, slot::bigint as slot,
          (row_number() over (order by slot, docs.k) - 1)::bigint as position
        from docs join slots on docs.source is not distinct from slots.source and docs.k // 16 = slots.block
          join phases on phases.t = slots.slot
    """,
    "op2_exact_topk": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
          where vec_id is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
        ),
        s as (
          select q.vec_id as query_id, c.vec_id,
            list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::bigint as score
          from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
        ),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op3_url_filters": f"""
        with c as (
          select page_id, url, date '2024-01-01' + {_number("concat_ws('|', page_id::varchar, url)", 'fetched', 0, 366)}::int as fetched,
            nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') as host, nullif(regexp_extract(url, '{_SEGMENT}', 1), '') as seg
          from pages
        ),
        p as (
          select *, unnest([1, 2, 3, 4]) as level, unnest([host || '/' || seg, host,
            case when len(string_split(host, '.')) > 3 then array_to_string(string_split(host, '.')[-3:], '.') end,
            case when len(string_split(host, '.')) > 2 then array_to_string(string_split(host, '.')[-2:], '.') end]) as pattern from c
        ),
        l as (
          select distinct pattern, list, kind, one_in from p,
            (values ('adult', 'block', 5), ('malware', 'block', 7), ('trusted', 'allow', 6), ('spam', 'block', 4)) x(list, kind, one_in)
          where pattern is not null
        ),
        a as (
          select pattern, list, kind, date '2024-01-01' + {_number("list || '|' || pattern", 'add', 0, 180)}::int as since,
            case when {_number("list || '|' || pattern", 'half', 0, 2)} = 0 then
              {_number("list || '|' || pattern", 'remove', 30, 150)}::int end as days
          from l where {_number("list || '|' || pattern", 'in', 0, 1000)} % one_in = 0
        ),
        hit as (
          select page_id, url, fetched, level, a.pattern, max(kind) as decision, array_to_string(list_sort(list(list)), ',') as lists
          from p join a on p.pattern = a.pattern and fetched >= since and (days is null or fetched < since + days)
          group by all
        ),
        one as (select * from hit qualify row_number() over (partition by page_id, url, fetched order by level) = 1)
        select c.page_id, c.url, c.fetched::date::varchar as fetched, coalesce(decision, 'none') as decision, pattern, lists
        from c left join one using (page_id, url, fetched)
    """,
    "op5_ngram_jaccard_join": f"""
        with recursive w as (
          select row_number() over () as r, doc_id, {_WORDS.format(_LOWER.format('text'))} as w from documents
        ),
        s as (
          select distinct r, doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w
        ),
        n as (select w.r, w.doc_id, count(s.g) as n from w left join s using (r) group by all),
        rare as (select *, count(*) over (partition by g) as df from s),
        cut as (
          select *, row_number() over (partition by r order by df, g) as k from rare
        ),
        head as (select cut.r, g, n from cut join n using (r) where 100 * (k - 1) <= 25 * n),
        cand as (
          select distinct a.r as a, b.r as b from head a join head b using (g)
          where a.r < b.r and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
        ),
        both_ as (
          select a, b, count(*) as i from cand join s x on x.r = a join s y on y.r = b and x.g = y.g group by a, b
        ),
        link as (
          select a, b from both_ join n x on x.r = a join n y on y.r = b where 100 * i >= 75 * (x.n + y.n - i)
        ),
        e as (select a, b from link union select b, a from link),
        reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a)
        select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(o.doc_id), n.doc_id)) as component_id
        from n left join reach on reach.a = n.r left join n o on o.r = reach.b group by n.r, n.doc_id, n.n
    """,
    "op10_substring_dedup": f"""
        with d as (
          select row_number() over () as r, doc_id, {_WORDS.format('text')} as w from documents
        ),
        win as (
          select r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as h
          from (select r, doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from d where len(w) >= 50)
        ),
        own as (select h, min(doc_id) as lo, max(doc_id) as hi from win group by h having min(doc_id) < max(doc_id)),
        bad as (select r, i from win join own using (h) where doc_id > lo),
        gone as (select distinct r, unnest(generate_series(i, i + 49)) as i from bad),
        lost as (select r, count(*) as n, list(i) as gone from gone group by r)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
          sha256(case when n is null then array_to_string(w, ' ') else coalesce(array_to_string(
            list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: not list_contains(gone, x[2])),
              lambda x: x[1]), ' '), '') end) as kept_sha256
        from d left join lost using (r)
    """,
    "op11_fill_in_middle": """
        with d as (
          select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as s,
            sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents
        ),
        n as (select *, case when s[-1] = '' then len(s) - 1 else len(s) end as n from d),
        u as (
          select *, list_transform(range(1, n + 1), lambda i: s[i] || case when i < len(s) then chr(10) else '' end) as u,
            list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::bigint) as r from n
        ),
        c as (
          select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 then 'plain'
              when r[4] % 100 < 50 then 'spm' else 'psm' end as form from u
        ),
        p as (
          select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c
        )
        select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end as prefix_chars,
          case when form <> 'plain' then length(mid) end as middle_chars,
          sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
            else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
        from p
    """,
    "op13_merkle_manifest": f"""
        with d as (
          select doc_id, source, {_fields('text')} as leaf,
            case when {_CRC32.format('doc_id::varchar')} % 5 = 0 then {_fields(_LOWER.replace("coalesce({0}, '')", 'text'))} end as tampered
          from documents
        ),
        a0 as materialized (
          select source as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, leaf as h,
            count(*) over (partition by source) as n, doc_id, coalesce(tampered, leaf) as folded, '' as proof from d
        ),
        {_tree('a', _LEVELS)},
        b0 as materialized (
          select 0 as g, row_number() over (order by g nulls first) - 1 as i, h, count(*) over () as n, g as source from a{_LEVELS}
        ),
        {_tree('b', _LEVELS)},
        {_proof('a', _LEVELS, 'a0')},
        up as (
          select p.doc_id, p.h as leaf, b0.h as subroot, 0 as g, b0.i, p.proof, p.folded
          from ap{_LEVELS - 1} p join b0 on p.g is not distinct from b0.source
        ),
        {_proof('b', _LEVELS, 'up')}
        select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.h as verified
        from bp{_LEVELS - 1} cross join b{_LEVELS} r
    """,
}
