"""The registered queries of this subpackage in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from .mixing import sample_sql
from .quality_rules import BODY, RATIOS, SPARED
from .url_filter import AMPERSAND, BASE, CANONICAL, FOLDER, HIDDEN, HREF, ORIGIN, PAGE, REFRESH, SCHEME, TAGS, TO, TRACKING, VIEWS, Rule

_SPACES = "[\\x20\\x09-\\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '')"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

WORD_RUNS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(coalesce(doc_id, 9223372036854775807)) AS first FROM g GROUP BY s),
hit AS MATERIALIZED (SELECT DISTINCT g.r, g.i + k AS p FROM g JOIN f USING (s), range(13) t(k) WHERE f.first < coalesce(g.doc_id, 9223372036854775807)),
x AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT x.r, string_agg(x.x, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN hit ON x.r = hit.r AND x.p = hit.p GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN (SELECT r, count(*) AS c FROM hit GROUP BY r) USING (r)
"""


def quality_sql(spread: float = 5.0, enough: int = 50) -> str:
    part = ", ".join(f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a}::DOUBLE / {b} END AS {n}" for n, (a, b) in RATIOS.items())
    middle, upper = (lambda n, level=level: f"quantile_disc({n}, {level})" for level in BODY)
    rare = lambda n: f"quantile_disc({n}, {SPARED[n]})"
    tails = ", ".join(f"CASE WHEN {upper(n)} > {middle(n)} THEN {upper(n)} + {spread}::DOUBLE * ({upper(n)} - {middle(n)}) ELSE {rare(n)} END AS l_{n}" for n in RATIOS)
    good = " AND ".join(f"{n} <= CASE WHEN g.n IS NULL THEN a.l_{n} ELSE (g.n * g.l_{n} + {enough} * a.l_{n}) / (g.n + {enough}) END" for n in RATIOS)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g3 AS MATERIALIZED (SELECT r, i, w[i:i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT i + k) AS c FROM (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g3) WHERE c > 1), range(3) t(k) GROUP BY r),
m AS MATERIALIZED (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM d LEFT JOIN rep USING (r)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {part} FROM m),
g AS (SELECT lang, source, count(*) AS n, {tails} FROM b WHERE NOT base_failed GROUP BY lang, source),
a AS (SELECT {tails} FROM b WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {good}, false) AS kept
FROM b LEFT JOIN g ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source, a
"""


def url_sql(rules: list[Rule]) -> str:
    def host(u: str) -> str:
        return f"translate(regexp_extract(substr({u}, instr({u}, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def path(u: str) -> str:
        return f"regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1)"

    def either(u: str, x: str) -> str:
        return f"CASE WHEN instr({u}, '://') > 0 THEN {x} ELSE '' END"

    def rule(u: str) -> str:
        h, p = either(u, host(u)), either(u, path(u))
        fits = [f"WHEN ({h} = '{r.parts[0]}' OR ends_with({h}, '.{r.parts[0]}')) AND starts_with({p}, '{r.parts[1]}') THEN '{r.text}'" for r in sorted(rules, key=lambda r: -len(r.text))]
        return f"CASE {' '.join(fits)} END"

    def text(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def address(u: str) -> str:
        told = " OR ".join(f"starts_with(x, '{t}')" for t in TRACKING)
        query = f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: NOT ({told} OR x = ''))"
        views = "|".join(v[:-1] for v in VIEWS)
        plain = f"regexp_replace(regexp_replace({path(u)}, '(?:/index)?\\.html?$', ''), '/+$', '')"
        return f"CASE WHEN instr({u}, '://') > 0 THEN regexp_replace({host(u)}, '^(?:{views})\\.', '') || {plain} || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END END"

    def whole(u: str, x: str) -> str:
        folder = f"regexp_extract({u}, {text(FOLDER)}, 1)"
        return f"CASE WHEN regexp_matches({x}, {text(SCHEME)}) THEN CASE WHEN contains({x}, '://') THEN {x} END WHEN {x} = '' OR starts_with({x}, '#') THEN NULL WHEN starts_with({x}, '//') THEN regexp_extract({u}, '^([^:]*:)', 1) || {x} WHEN starts_with({x}, '/') THEN regexp_extract({u}, {text(ORIGIN)}, 1) || {x} WHEN starts_with({x}, '?') THEN regexp_extract({u}, {text(PAGE)}, 1) || {x} ELSE {folder} || CASE WHEN ends_with({folder}, '/') THEN '' ELSE '/' END || {x} END"

    def undotted(u: str) -> str:
        parts = f"list_transform(string_split(regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: [s])"
        kept = f"list_reduce({parts}, lambda k, s: CASE s[1] WHEN '.' THEN k WHEN '..' THEN k[1:greatest(len(k) - 1, 1)] ELSE list_concat(k, s) END)"
        return f"regexp_extract({u}, {text(ORIGIN)}, 1) || array_to_string({kept}, '/') || regexp_extract({u}, '^[^?#]*(.*)$', 1)"

    does = " ".join(f"WHEN '{r.text}' THEN '{r.action}'" for r in rules)
    plain = lambda x: f"regexp_replace({x}, {text(AMPERSAND)}, '&', 'g')"
    return f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, url, {either('url', host('url'))} AS host, {either('url', path('url'))} AS path, {rule('url')} AS rule, {address('url')} AS address, html FROM pages),
shown AS (SELECT url, regexp_replace(html, {text(HIDDEN)}, '', 'g') AS h FROM p),
named AS (SELECT url, h, {plain(f"regexp_extract(h, {text(BASE)}, 1)")} AS n FROM shown),
based AS (SELECT url, h, CASE WHEN n <> '' THEN {whole('url', 'n')} END AS b FROM named),
page AS MATERIALIZED (SELECT url, h, coalesce({undotted('b')}, url) AS base FROM based),
tag AS (SELECT url, base, unnest(regexp_extract_all(h, {text(TAGS)})) AS t FROM page),
target AS (SELECT url, base, {plain(f"regexp_extract(t, {text(HREF)}, 1)")} AS x FROM tag WHERE regexp_matches(t, {text(CANONICAL)}) UNION ALL SELECT url, base, {plain(f"regexp_extract(t, {text(TO)}, 1)")} FROM tag WHERE regexp_matches(t, {text(REFRESH)})),
led AS (SELECT url, {whole('base', 'x')} AS y FROM target),
straight AS (SELECT url, {undotted('y')} AS y FROM led),
edge AS MATERIALIZED (SELECT {address('url')} AS a, {address('y')} AS b, url, y FROM straight WHERE y IS NOT NULL),
both_ways AS MATERIALIZED (SELECT a, b FROM edge WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM edge WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a),
member AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
said AS (SELECT address, CASE rule {does} END AS action FROM p UNION ALL SELECT a, CASE {rule('url')} {does} END FROM edge UNION ALL SELECT b, CASE {rule('y')} {does} END FROM edge),
decided AS (SELECT coalesce(component, address) AS alias_of, min(action) AS action FROM said LEFT JOIN member ON address = node WHERE address IS NOT NULL AND action IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(CASE rule {does} END, decided.action, 'allow') AS verdict, coalesce(component, address) AS alias_of
FROM p LEFT JOIN member ON address = node LEFT JOIN decided ON decided.alias_of = coalesce(component, address)
"""


def oracle_sql(rules: list[Rule]) -> dict[str, str]:
    return {"op2_mixing": sample_sql(), "op3_url_rules": url_sql(rules), "op6_exact_top_k": TOP_K, "op7_quality_rules": quality_sql(), "op8_fixed_block_anchors": WORD_RUNS}
