"""DuckDB equivalents of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from html.entities import html5

SPACE = r"\x20\x09-\x0D"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DEDUP = f"""
with recursive d as (
    select doc_id, regexp_extract_all({LOWERED}, '[^{SPACE}]+') as w from documents
), s as (
    select distinct doc_id, unnest(
        case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
             when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
    from d
), n as (select doc_id, count(*) as n from s group by 1
), p as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared
    from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), e as (
    select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
    where 100 * shared >= 85 * (x.n + y.n - shared)
), u as (select a, b from e union select b, a from e
), r(node, root) as (
    select doc_id, doc_id from d union select u.b, r.root from r join u on u.a = r.node
), c as (select node, min(root) as root from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.root as component_id, d.doc_id = c.root as kept
from d left join n using (doc_id) join c on c.node = d.doc_id
"""

VECTORS = """
with recursive v as (
    select vec_id, embedding::double[] as x from embeddings
), g as (
    select * from v where x is not null and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0
        and len(list_filter(x, lambda y: y <> 0)) > 0
), e as (
    select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.9
), r(node, root) as (
    select vec_id, vec_id from v union select e.b, r.root from r join e on e.a = r.node
), c as (select node, min(root) as root from r group by 1
), n as (select a, count(*) as n from e group by 1)
select vec_id, coalesce(n, 0) as n_links, root as component_id, vec_id = root as kept
from v left join n on n.a = vec_id join c on c.node = vec_id
"""

# The checksum has no SQL function here: a table of 256 remainders is made by shifting, and
# each text's bytes (from its hex digits) are folded through it.
SHARDS = """
with recursive bits(v, c, k) as (
    select i, i::bigint, 0 from range(256) t(i)
    union all select v, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), m as (select list(c order by v) as m from bits where k = 8
), d as (
    select doc_id, strlen(coalesce(text, '')) + 1 as size,
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(coalesce(text, ''))),
            lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
            lambda c, x: xor(c >> 8, m[(xor(c, x) & 255) + 1]))) as text_crc32
    from (select *, hex(encode(coalesce(text, ''))) as h from documents), m
), p as (
    select *, coalesce(sum(size) over (order by doc_id, text_crc32, size rows between unbounded preceding and 1 preceding), 0) as before,
        sum(size) over () as total from d
), s as (select *, ((before * 2 + size) * 16 // (2 * total))::int as shard from p)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard,
    row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, null::int as grown_shard
from s
"""

MIX = f"""
with s as (
    select d.doc_id, coalesce(source, '') as named, source is null as unnamed,
        coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::bigint as size, coalesce(w.weight, 1) as weight
    from documents d left join (
        select doc_id, case when max(quality) = 1 then 2.0 else 0.5 end as weight
        from labels where quality is not null group by 1) w using (doc_id)
), t as (
    select named, unnamed, sum(size)::bigint as source_size,
        row_number() over (order by unnamed, named) - 1 as nth from s group by 1, 2
), w as (
    select *, [3, 1, 2][nth % 3 + 1] as part, 2 * source_size as cap, 1.5 * sum(source_size) over () as budget from t
), f as (
    select *, coalesce(sum(cap) over (order by cap / part, nth rows between unbounded preceding and 1 preceding), 0) as before,
        sum(part) over (order by cap / part, nth rows between current row and unbounded following) as rest from w
), k as (select *, cap * rest <= (budget - before) * part as full_ from f
), g as (
    select *, case when full_ then cap::double
        else part * (budget - coalesce(sum(cap) filter (full_) over (), 0)) / sum(part) filter (not full_) over () end as target
    from k
), x as (
    select s.doc_id, s.size, g.source_size::bigint as source_size, g.target::double as target,
        floor(g.target / nullif(g.source_size, 0)) as epochs,
        coalesce(sum(s.size) over (partition by g.nth order by
            -ln((('0x' || substr(md5(s.doc_id || ':1'), 1, 12))::bigint + 0.5) / 281474976710656.0) / s.weight, s.doc_id, s.size
            rows between unbounded preceding and 1 preceding), 0) as before
    from s join g using (named, unnamed)
)
select doc_id, size, source_size, target,
    (coalesce(epochs, 0) * size + least(greatest(floor(target - coalesce(epochs, 0) * source_size + 0.5) - before, 0), size))::bigint as taken
from x
"""

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _found(nth: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Rows of the matches of one kind, from the matches and the pieces between them."""
    return f"""
    select doc_id, {nth} as nth, '{kind}' as kind, len(regexp_extract(m[i], '{pattern}', {group})) as n,
        list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) as first,
        len(m[i]) as size
    from (select doc_id, m, b, unnest(range(1, len(m) + 1)) as i from (
        select doc_id, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as b from documents))
    where n >= {least}"""


SECRETS = f"""
with f as ({_found(0, "assign", ASSIGN, 2, 6)} union all {_found(1, "access", "AKIA[A-Z0-9]+", 0, 20)}
    union all {_found(2, "hex", "[0-9a-f]+", 0, 24)}
), g as (
    select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
        count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || first::bigint || ':' || (first + size)::bigint, ',' order by first, nth) as spans
    from f group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join g using (doc_id)
"""


#: Names of entities, with and without the semicolon as HTML has them, and their characters.
ENTITIES = {f"&{name}": value for name, value in html5.items()} | {"&nbsp;": " "}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _decoded(text: str) -> str:
    """Entities replaced once: the text in pieces, of which those that are entities have their characters."""
    piece = "&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z0-9]+);?|&|[^&]+"
    one = """coalesce(m[e], case when regexp_matches(e, '^&#[xX]') then chr(('0x' || regexp_extract(e, '[xX]([0-9A-Fa-f]+)', 1))::int)
        when regexp_matches(e, '^&#[0-9]') then chr(regexp_extract(e, '[0-9]+')::int) end, e)"""
    return f"array_to_string(list_transform(regexp_extract_all({text}, '{piece}'), lambda e: {one}), '')"


def _replaced(text: str, steps) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


def _text(html: str) -> str:
    tags = (
        ("(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>", " "),
        ("(?s)<!--.*?-->", " "),
        ("(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|table|section|article|header|footer|nav|title)\\b[^>]*>", "\n"),
        ("<[^>]*>", ""),
    )
    white = (("[ \\t\\r\\f]+", " "), (" ?\\n[ \\n]*", "\n"), ("^[ \\n]+|[ \\n]+$", ""))
    return _replaced(_decoded(_replaced(html, tags)), white)


CRLF = "chr(13) || chr(10)"


def _uuid(parts: str) -> str:
    h = f"md5({parts})"
    pieces = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {pieces} || '>'"


QUOTES = "trim(t, chr(34) || chr(39))"
LINES = ("'HTTP/1.1 200 OK'", "'Content-Type: text/html; charset=utf-8'", "'Content-Length: ' || size")
TARGET = _decoded(QUOTES)
SEEN = _replaced("html", (("(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>", " "), ("(?s)<!--.*?-->", " ")))
LINKS = f"""regexp_extract_all({SEEN}, '(?i)<a(?:\\s[^>]*?)?\\shref=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']*)', 1)"""
WARC = f"""
with entities as materialized (select map([{", ".join(map(_quoted, ENTITIES))}], [{", ".join(map(_quoted, ENTITIES.values()))}]) as m
), p as (select page_id, url, coalesce(html, '') as html, m from pages, entities
), s as (
    select page_id, url, html, m, 'sha256:' || sha256(html) as source_digest,
        {_uuid("'response' || chr(10) || coalesce(page_id::varchar, '') || chr(10) || coalesce(url, '') || chr(10) || html")} as refers_to,
        strlen(html) as size from p
), r as (
    select page_id, url, refers_to, source_digest, size, 'conversion' as warc_type, 'text/plain; charset=utf-8' as content_type,
        {_text("html")} as block from s
    union all
    select page_id, url, refers_to, source_digest, size, 'metadata', 'application/warc-fields',
        'title: ' || {_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")} || {CRLF}
        || 'lang: ' || regexp_extract(html, '(?i)<html[^>]*\\blang\\s*=\\s*["'']?([^"''\\s>]*)', 1) || {CRLF}
        || 'charset: ' || regexp_extract(html, '(?i)<meta[^>]*\\bcharset\\s*=\\s*["'']?([A-Za-z0-9_-]+)', 1) || {CRLF}
        || 'outlinks: ' || len({LINKS}) || {CRLF}
        || 'source-payload-digest: ' || source_digest || {CRLF}
        || {" || ".join(f"'source-http-header: ' || {line} || {CRLF}" for line in LINES)}
        || array_to_string(list_transform({LINKS},
            lambda t: 'outlink: ' || trim(regexp_replace({TARGET}, '[\\t\\r\\n]', '', 'g')) || {CRLF}), '')
    from s
), o as (
    select *, {_uuid("warc_type || chr(10) || refers_to || chr(10) || 'sha256:' || sha256(block)")} as record_id,
        'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length from r
)
select page_id, record_id, warc_type, refers_to, url as target_uri, content_type, source_digest, block_digest, content_length,
    'WARC/1.1' || {CRLF} || 'WARC-Type: ' || warc_type || {CRLF} || 'WARC-Record-ID: ' || record_id || {CRLF}
    || 'WARC-Date: 2024-01-01T00:00:00Z' || {CRLF} || coalesce('WARC-Target-URI: ' || url || {CRLF}, '')
    || 'WARC-Refers-To: ' || refers_to || {CRLF} || 'WARC-Source-Payload-Digest: ' || source_digest || {CRLF}
    || 'WARC-Block-Digest: ' || block_digest || {CRLF} || 'Content-Type: ' || content_type || {CRLF}
    || 'Content-Length: ' || content_length || {" || ".join(f"{CRLF} || 'WARC-Source-HTTP-Header: ' || {line}" for line in LINES)} as header,
    block
from o
"""

# Words as the documents have them after the deletions, and their neighbours by deleting one
# character of either word (a deletion) or of both at the same place (a replacement).
SPELLING = f"""
with recursive bits(v, c, k) as (
    select i, i::bigint, 0 from range(256) t(i)
    union all select v, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), m as (select list(c order by v) as m from bits where k = 8
), e as (select doc_id, unnest(regexp_extract_all({LOWERED}, '[a-z\u00C0-\u00FF]+')) as run from documents
), r as (select coalesce(doc_id::varchar, '') || ':' || run as k, run, count(*) as n from e where length(run) >= 5 group by 1, 2
), h as (
    select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(k)), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::bigint)),
        lambda c, x: xor(c >> 8, m[(xor(c, x) & 255) + 1]))) as h
    from r, m
), x as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h
), w as materialized (select word, sum(n)::bigint as n from x group by 1 having sum(n) >= 3 and length(word) >= 5
), g as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as g from (select word, unnest(range(1, length(word) + 1)) as i from w)
), p as (
    select word as a, g as b from g where g in (select word from w)
    union select g, word from g where g in (select word from w)
    union select x.word, y.word from g x join g y on x.i = y.i and x.g = y.g and x.word <> y.word
), t as (select a as word, count(*) as n_near, first(b order by n desc, b) as b, max(n) as bn from p join w on w.word = p.b group by 1
), f as materialized (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when bn >= 2 * w.n then b end as form, case when bn >= 2 * w.n then bn end as form_n
    from w left join t using (word)
), c(word, here) as (select word, word from f union all select c.word, f.form from c join f on f.word = c.here where f.form is not null)
select f.word, form, c.here as root, n, n_near, form_n from f join c on c.word = f.word
where c.here in (select word from f where form is null)
"""


def _clusters(count: int = 40, rounds: int = 5) -> str:
    """Every round as a step: distances to all centroids, the nearest, and the floors of the means."""
    steps = [
        """v as materialized (
    select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""",
        f"c0 as materialized (select row_number() over (order by h) - 1 as k, x as c from (select sha256('2:' || vec_id) as h, x from v where vec_id is not null order by h limit {count}))",
    ]
    for n in range(rounds + 1):
        far = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        steps.append(f"a{n} as materialized (select rid, arg_min(k, [d, k]) as k, min(d)::bigint as d from (select rid, k, {far} as d from v, c{n}) group by 1)")
        if n < rounds:
            steps.append(f"""c{n + 1} as materialized (
    select k, coalesce(m.c, o.c) as c from c{n} o left join (
        select k, list(s order by i) as c from (select k, i, floor(sum(x[i]) / count(*)) as s from a{n} join v using (rid), range(1, 65) r(i) group by 1, 2) group by 1
    ) m using (k))""")
    return "with " + ", ".join(steps) + f"""
select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
    sha256(array_to_string(list_transform(c, lambda x: x::bigint), ',')) as centroid_sha256
from a{rounds} join v using (rid) join c{rounds} using (k)
"""


ORACLES = {
    "op2_warc_derivatives": WARC,
    "op4_minhash_dedup": DEDUP,
    "op5_embedding_dedup": VECTORS,
    "op6_byte_shards": SHARDS,
    "op8_source_mix": MIX,
    "op9_secret_ledger": SECRETS,
    "op12_spelling_variants": SPELLING,
    "op13_ball_clusters": _clusters(),
}
