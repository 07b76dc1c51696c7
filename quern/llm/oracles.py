"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS s,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
tot AS (SELECT sn, s, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY sn, s) AS r FROM d GROUP BY sn, s),
w AS (SELECT *, (CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size::DOUBLE * 2 AS stop FROM tot),
o AS (SELECT *, stop / weight AS sl, sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE AS budget,
    coalesce(sum(stop) OVER (ORDER BY stop / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY stop / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM w),
c AS (SELECT *, sl * wl <= budget - before AS stopped FROM o),
l AS (SELECT *, (budget - coalesce(sum(CASE WHEN stopped THEN stop END) OVER (), 0)) / sum(CASE WHEN NOT stopped THEN weight END) OVER () AS lev FROM c),
t AS (SELECT sn, s, source_size, r, budget, CASE WHEN stopped THEN stop ELSE least(lev * weight, stop) END AS target FROM l),
a AS (SELECT d.*, source_size, r, budget, target, sum(size) OVER (PARTITION BY d.sn, d.s ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM d JOIN t ON d.sn = t.sn AND d.s = t.s),
p AS (SELECT doc_id, size, cum, r, k, p, budget, (p::DOUBLE * source_size + cum) / target AS f FROM a, (VALUES (0), (1)) AS v(p) WHERE target > 0 AND size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY f, r, p, k ROWS UNBOUNDED PRECEDING) AS spent FROM p),
u AS (SELECT r, k, doc_id, size, cum, count(*) AS n FROM g WHERE spent <= budget GROUP BY ALL)
SELECT a.doc_id, a.size, a.source_size, a.target, (a.size * coalesce(n, 0))::BIGINT AS taken
FROM a LEFT JOIN u ON a.r = u.r AND a.k = u.k AND a.doc_id IS NOT DISTINCT FROM u.doc_id AND a.size = u.size AND a.cum = u.cum
"""

OP10 = r"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
bh AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '.') AS ls FROM p),
sl AS (SELECT *, CASE WHEN regexp_matches(array_to_string(ls, '.'), '(?s)^([0-9.]+|\[.*)$') THEN 100000
    WHEN array_to_string(list_slice(ls, -2, -1), '.') IN ('appspot.com', 'azurewebsites.net', 'blogspot.com', 'cloudfront.net', 'firebaseapp.com', 'fly.dev', 'github.io', 'gitlab.io', 'glitch.me', 'herokuapp.com',
      'id.au', 'ltd.uk', 'me.uk', 'neocities.org', 'netlify.app', 'onrender.com', 'pages.dev', 'plc.uk', 'readthedocs.io', 'surge.sh', 'vercel.app', 'web.app', 'weebly.com', 'wordpress.com', 'workers.dev') THEN 2
    WHEN len(ls) > 1 AND regexp_matches(ls[-1], '^[a-z][a-z]$') AND ls[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gouv', 'gov', 'mil', 'ne', 'net', 'or', 'org', 'sch') THEN 2 ELSE 1 END AS k FROM bh),
q AS (SELECT page_id, url, host, path, array_to_string(list_slice(ls, -least(k + 1, len(ls)), -1), '.') AS domain, array_to_string(list_slice(ls, -least(k, len(ls)), -1), '.') AS suffix FROM sl),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END)::DOUBLE AS bad
  FROM q JOIN labels ON page_id = labels.doc_id GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT coalesce(sum(bad), 0) + 0.5::DOUBLE AS a, coalesce(sum(n) - sum(bad), 0) + 0.5::DOUBLE AS b FROM s),
s1 AS (SELECT s.*, g.a / (g.a + g.b) AS m FROM s, g),
ks AS (SELECT count(*) AS j, sum(n) AS t, sum(n * n) AS sq, sum(n * (bad / n - m) * (bad / n - m)) AS bt, sum(n * m * (1 - m)) AS wt FROM s1),
s2 AS (SELECT suffix, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM s1, (SELECT 1 / greatest(0.001::DOUBLE, least(0.9::DOUBLE,
  CASE WHEN wt / t > 0 AND t - sq / t - (j - 1) > 0 THEN (bt - (j - 1) * (wt / t)) / (wt / t * (t - sq / t - (j - 1))) ELSE 0 END)) - 1 AS k FROM ks)),
d1 AS (SELECT d.*, s2.a / (s2.a + s2.b) AS m FROM d JOIN s2 USING (suffix)),
kd AS (SELECT count(*) AS j, sum(n) AS t, sum(n * n) AS sq, sum(n * (bad / n - m) * (bad / n - m)) AS bt, sum(n * m * (1 - m)) AS wt FROM d1),
d2 AS (SELECT domain, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM d1, (SELECT 1 / greatest(0.001::DOUBLE, least(0.9::DOUBLE,
  CASE WHEN wt / t > 0 AND t - sq / t - (j - 1) > 0 THEN (bt - (j - 1) * (wt / t)) / (wt / t * (t - sq / t - (j - 1))) ELSE 0 END)) - 1 AS k FROM kd)),
h1 AS (SELECT h.*, d2.a / (d2.a + d2.b) AS m FROM h JOIN d2 USING (domain)),
kh AS (SELECT count(*) AS j, sum(n) AS t, sum(n * n) AS sq, sum(n * (bad / n - m) * (bad / n - m)) AS bt, sum(n * m * (1 - m)) AS wt FROM h1),
h2 AS (SELECT host, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM h1, (SELECT 1 / greatest(0.001::DOUBLE, least(0.9::DOUBLE,
  CASE WHEN wt / t > 0 AND t - sq / t - (j - 1) > 0 THEN (bt - (j - 1) * (wt / t)) / (wt / t * (t - sq / t - (j - 1))) ELSE 0 END)) - 1 AS k FROM kh)),
x AS (SELECT q.page_id, q.host, q.path, coalesce(h2.a, d2.a, s2.a, g.a) AS a, coalesce(h2.b, d2.b, s2.b, g.b) AS b
  FROM q LEFT JOIN h2 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix), g),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM x)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

SQL = {"op2_mix_sources": OP2, "op10_url_reputation": OP10}


#: The same spellings once more, for the SQL doesn't read the operator's: another one, and the one it becomes.
SPELLED = """
acknowledgement acknowledgment, analogue analog, artefact artifact, authorisation authorization, authorised authorized, calibre caliber, cancelled canceled, capitalisations capitalizations, catalogue catalog,
categorise categorize, centre center, emphasised emphasized, favour favor, favourite favorite, fulfil fulfill, fulfilment fulfillment, initialise initialize, judgement judgment, labelling labeling, labour labor,
licence license, licenced licensed, maximise maximize, modelled modeled, modelling modeling, offence offense, optimise optimize, organisation organization, organise organize, practise practice, programme program,
realise realize, recognise recognize, signalling signaling, utilisation utilization, whilst while, wilful willful, wilfull willful, willfull willful, non_commercial noncommercial, per_cent percent,
sub_license sublicense, copyright_holder copyright_owner
"""
#: Lines that canonical texts leave out, for lower-case texts.
_NAMED = "(mit|expat|isc|zlib|zlib/libpng|bsd|new bsd|modified bsd|simplified bsd|bsd zero[ -]clause|zero[ -]clause bsd|[023]-clause bsd|bsd [023]-clause|bsd 2-clause \"simplified\"|bsd 3-clause \"(new|revised)\"( or \"revised\")?)"
_TITLED = rf"[\t #*=]*(the )?({_NAMED} licen[sc]e|zero[ -]clause bsd|unlicense)( \([a-z0-9/-]+\))?[.:*]*[\t\r ]*"
_HELD = r"[\t ]*(copyright|\(c\)|\x{A9})([\t ]+[^\t \n]+){1,8}[\t\r ]*"
LEFT_OUT = "(?m)" + "|".join((
    rf"(\A[\t\n\r ]*|\n[\t\r ]*\n)({_TITLED}\n)?{_HELD}(\n{_HELD})*$", r"^[\t ]*(copyright[\t ]*(\(c\)|\x{A9})|copyright\b[^\n]*[0-9]{4}|\(c\)[^\n]*[0-9]{4}|\x{A9})[^\n]*$",
    rf"^{_TITLED}$", r"^[\t ]*all rights reserved[.]?[\t\r ]*$",
))
BETWEEN = r"[\x00-/:-@\[-`{-\x7F\x{A0}\x{AB}\x{B7}\x{BB}\x{2000}-\x{2026}\x{2028}\x{2029}\x{202F}\x{2039}\x{203A}\x{2060}\x{FEFF}]+"


def _canonical(text: str) -> str:
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace(' ' || regexp_replace({out}, '{LEFT_OUT}', '', 'g') || ' ', '{BETWEEN}', '  ', 'g')"
    for pair in SPELLED.replace("\n", " ").split(","):
        other, one = (x.replace("_", "  ") for x in pair.split())
        out = f"replace({out}, ' {other} ', ' {one} ')"
    return f"sha256(trim(replace({out}, '  ', ' ')))"


def _op6() -> str:
    from quern.llm.licenses import LICENSES, NOTICES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    whole = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in LICENSES.items())
    lines = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, ts in NOTICES.items() for t in ts)
    return rf"""
WITH w AS (SELECT l, {_canonical('t')} AS d FROM (VALUES {whole}) AS v(l, t)),
n AS (SELECT l, {_canonical('t')} AS d FROM (VALUES {lines}) AS v(l, t)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT r, unnest(string_split(text, chr(10))) AS t FROM d),
m AS (SELECT DISTINCT r, n.l FROM (SELECT r, {_canonical('t')} AS d FROM x WHERE regexp_matches(t, '(?i)licen[sc]e')) AS y JOIN n USING (d)),
a AS (SELECT r, string_agg(l, ',' ORDER BY l) AS notices FROM m GROUP BY r),
c AS (SELECT r, doc_id, {_canonical('text')} AS canonical_sha256 FROM d)
SELECT doc_id, canonical_sha256, w.l AS license, coalesce(notices, '') AS notices
FROM c LEFT JOIN w ON c.canonical_sha256 = w.d LEFT JOIN a ON c.r = a.r
"""


#: Payloads as UTF-8; digests in base 32 by groups of five bits.
OP1 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS x, h FROM p),
r AS (SELECT h, max(page_id) AS m FROM d GROUP BY h),
b AS (SELECT d.page_id, d.n, r.m, array_to_string(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(x, i + 1, 1))::INT), 4, '0')), '') AS bits FROM d JOIN r USING (h))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, i * 5 + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM b
"""

#: Shingles as texts, all pairs that share one, and the closure of the links: for small tables.
OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n AS x ON u = x.doc_id JOIN n AS y ON v = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(doc, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc, min(m) AS component_id FROM r GROUP BY doc) AS c ON c.doc = d.doc_id
"""

SQL |= {"op7_near_duplicates": OP7, "op1_warc": OP1, "op6_licenses": _op6()}
