"""DuckDB SQL of the queries that SQL can express, by name: sets of shingles, windows and pairs are compared all with all.

The others rest on tokenizers, learned models or an iteration over held-out counts; tests compare them with brute force.
"""

from __future__ import annotations

from .secret_scan import ALLOWED, CLASSES, weights_of, most_weight

#: A-Z alone become small.
_SMALL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str) -> str:
    """Common table expressions ending in roots: for every node with a link the smallest node reachable."""
    return f"reach as (select a as node, b as other from {links} union select r.node, l.b from reach r join {links} l on l.a = r.other),\nroots as (select node, least(node, min(other)) as root from reach group by node)"


_WORDS = f"list_filter(string_split_regex({_SMALL.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_NEAR = f"""with recursive words as (select doc_id, {_WORDS} as w from documents),
sets as (select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from words),
each as (select doc_id, len(s) as n, unnest(s) as s from sets),
shared as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c from each a join each b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared where 100 * c >= 85 * (n + m - c)),
{_components('links')}
select doc_id, len(s)::bigint as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept from sets left join roots on node = doc_id"""

_SIGNS = f"list_filter(string_split_regex({_SMALL.format('text')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_LEAKS = f"""with items as (select item_id, {_SIGNS} as w from benchmark where text is not null),
windows as (select distinct item_id, least(len(w), 10) as m, unnest(case when len(w) < 10 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) end) as t from items where len(w) > 0),
docs as (select doc_id, coalesce({_SIGNS}, []) as w from documents),
grams as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as t from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from docs, (select distinct m from windows) where len(w) >= m)),
found as (select g.doc_id, w.item_id, g.i, g.m from grams g join windows w on w.m = g.m and w.t = g.t),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + m)) as place from found) group by doc_id),
listed as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from docs left join hit using (doc_id) left join listed using (doc_id)"""

_VECTORS = f"""with recursive v as (select vec_id, embedding::double[] as x from embeddings where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false))) and list_bool_or(list_transform(embedding, lambda c: coalesce(c, 0) <> 0))),
links as (select p.vec_id as a, q.vec_id as b from v p join v q on p.vec_id <> q.vec_id and len(p.x) = len(q.x) and list_cosine_similarity(p.x, q.x) >= 0.95),
{_components('links')}
select vec_id, (select count(*) from links where a = vec_id) as n_links, coalesce(root, vec_id) as component_id, vec_id = coalesce(root, vec_id) as kept from embeddings left join roots on node = vec_id"""



def _codes_sql(rounds: int = 2) -> str:
    """Lloyd rounds with all sums anew. Components are integers, so nothing depends on an order of adding."""
    steps = ["""kept as (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where embedding is not null and list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))),
parts as (select r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] as x from kept, range(16) as places(p)),
book0 as (select p, r - 1 as e, x as c from parts where r <= 64)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} as (select r, p, any_value(x) as x, arg_min(e, (d, e)) as e, min(d) as d from (select r, p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts join book{k} using (p)) group by r, p)""")
        if k < rounds:
            steps.append(f"""sums{k} as (select p, e, i, sum(x)::bigint as s, count(*) as n from (select p, e, unnest(x) as x, unnest(range(len(x))) as i from near{k}) group by p, e, i),
means{k} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as m from sums{k} group by p, e),
book{k + 1} as (select p, e, coalesce(m, c) as c from book{k} left join means{k} using (p, e))""")
    steps.append(f"""coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near{rounds} group by r),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (r), digest""")
    return "with " + ",\n".join(steps)


def _matches(name: str, pattern: str, condition: str = "true", group: int = 0) -> str:
    """Common table expression of the spans (doc_id, a, b, g) of a pattern's matches: what lies before each is what splitting leaves."""
    quoted = pattern.replace("'", "''")
    return f"""{name} as (select doc_id, a, a + length(t) as b, t, g from (select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::bigint)) as a, unnest(m) as t, unnest(gs) as g from (select doc_id, regexp_extract_all(text, '{quoted}') as m, regexp_extract_all(text, '{quoted}', {group}) as gs, string_split_regex(text, '{quoted}') as p from texts)) where {condition})"""


def _secrets_sql() -> str:
    """Every window is counted anew. Hexadecimal strings and keys are asked with their least length, which finds the same and less to drop."""
    words = ["password", "passwd", "secret", "token", "api_?key"]
    small = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    steps = [
        "texts as (select doc_id, coalesce(text, '') as text from documents)",
        _matches("assign", rf"""({small})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 12", 2),
        _matches("access", "AKIA[A-Z0-9]{14,}"),
        _matches("hex", "[0-9a-f]{16,}"),
        "known as (select doc_id, a, b, 0 as k from assign union all select doc_id, a, b, 1 from access union all select doc_id, a, b, 2 from hex)",
    ]
    for i, own in enumerate(CLASSES):
        groups = " and ".join(f"regexp_matches(w, '[{g}]')" for g in own.groups)
        steps += [
            _matches(f"strings{i}", f"[{own.characters}]{{{own.window},}}={{0,{own.padding}}}"),
            f"""windows{i} as (select doc_id, a, b, body, j, substr(body, j + 1, {own.window}) as w from (select *, unnest(range(0, length(body) - {own.window - 1})) as j from (select doc_id, a, b, rtrim(t, '=') as body from strings{i})))""",
            f"""passed{i} as (select *, j - lag(j) over (partition by doc_id, a order by j) <= {own.window} as joined from windows{i} where {groups} and list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda n: {weights_of(own.window)}[n::bigint + 1])) <= {most_weight(own.window, own.bits)})""",
            f"""ranges{i} as (select doc_id, a + min(j) as a, case when max(j) + {own.window} = any_value(length(body)) then any_value(b) else a + max(j) + {own.window} end as b from (select *, sum(case when joined then 0 else 1 end) over (partition by doc_id, a order by j) as island from passed{i}) group by doc_id, a, island)""",
        ]
    steps += [
        "ranges as (" + " union all ".join(f"select * from ranges{i}" for i in range(len(CLASSES))) + ")",
        "united as (select doc_id, min(a) as a, max(b) as b from (select *, sum(case when a <= reach then 0 else 1 end) over (partition by doc_id order by a, b rows unbounded preceding) as island from (select *, max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) as reach from ranges)) group by doc_id, island)",
        *(_matches(f"allowed{i}", p) for i, p in enumerate(ALLOWED)),
        "allowed as (" + " union all ".join(f"select doc_id, a, b from allowed{i}" for i in range(len(ALLOWED))) + ")",
        "random as (select doc_id, a, b, 3 as k from united u where not exists (from allowed o where o.doc_id = u.doc_id and o.a < u.b and o.b > u.a) and not exists (from known o where o.doc_id = u.doc_id and o.a <= u.a and o.b >= u.b))",
        "named as (select doc_id, a, k, b, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || a || ':' || b as s from (from known union all by name from random))",
        "listed as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, string_agg(s, ',' order by a, k, b) filter (k < 3) as base, string_agg(s, ',' order by a, k, b) as spans from named group by doc_id)",
    ]
    return "with " + ",\n".join(steps) + "\nselect doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from texts left join listed using (doc_id)"


#: crc32 of a number in decimal, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

_RUNS = f"""with plain as (select doc_id, coalesce(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), []) as w, {_CRC} as h from documents),
rules as (select doc_id, w, len(w) as n, h, case when len(w) > 0 then (h // 10) % len(w) end as a from plain),
periods as (select *, case when h % 10 = 0 and n > 0 then 1 + (n - a) // (3 + (h // 10) % 8) end as p from rules),
docs as (select doc_id, n, case when p is null then w else list_transform(range(n), lambda i: w[(case when i < a then i else a + (i - a) % p end) + 1]) end as w from periods),
words as (select doc_id, n, unnest(w) as w, unnest(range(n)) as i from docs),
same as (select x.doc_id, y.i - x.i as q, x.i from words x join words y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
stretches as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from same) group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length),
dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
listed as (select doc_id, count(*) as n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id),
kept as (select doc_id, string_agg(w, ' ' order by i) as left_over from words anti join dropped using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(left_over, '')) as collapsed_sha256 from docs left join listed using (doc_id) left join kept using (doc_id)"""

ORACLES: dict[str, str] = {"op3_near_duplicates": _NEAR, "op5_decontamination": _LEAKS, "op9_vector_duplicates": _VECTORS, "op11_vector_codes": _codes_sql(), "op12_secrets": _secrets_sql(), "op13_periodic_runs": _RUNS}
