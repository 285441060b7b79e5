"""DuckDB SQL for the operators that SQL can express."""

from .linededup import MIN_WORDS
from .quality_rules import STOP_WORDS
from .urlfilter import STRONGEST, TWO_LABEL_SUFFIXES, WEAKEST

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_SUFFIXES = ", ".join(f"'{w}'" for w in TWO_LABEL_SUFFIXES)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), best AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), q AS (
  SELECT p.*, b.quality FROM p LEFT JOIN best b
    ON TRY_CAST(regexp_extract(path, '^/[a-z][a-z]/([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) = b.doc_id
), h0 AS (
  SELECT host, count(*) FILTER (WHERE quality = 1) AS k, count(*) FILTER (WHERE quality IN (0, 1)) AS n, regexp_replace(host, ':[0-9]*$', '') AS name FROM q GROUP BY host
), h1 AS (
  SELECT *, regexp_extract(name, '([^.]+\\.[^.]+)$', 1) AS two FROM h0
), h AS (
  SELECT host, k, n, CASE WHEN two IN ({_SUFFIXES}) THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix,
         CASE WHEN two IN ({_SUFFIXES}) THEN regexp_extract(name, '((?:[^.]+\\.)?[^.]+\\.[^.]+)$', 1) WHEN two <> '' THEN two ELSE name END AS domain FROM h1
), d AS (SELECT suffix, domain, sum(k) AS k, sum(n) AS n FROM h GROUP BY suffix, domain
), s AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM d GROUP BY suffix
), t AS (SELECT (coalesce(sum(k), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2) AS mu FROM s
), spread AS (
  SELECT level, sum(k * k / n::DOUBLE) AS q, sum(k)::DOUBLE AS k, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS g
  FROM (SELECT 'h' AS level, k, n FROM h UNION ALL SELECT 'd', k, n FROM d UNION ALL SELECT 's', k, n FROM s) WHERE n > 0 GROUP BY level
), rho AS (
  SELECT level, CASE WHEN n <= g THEN 1 / (1 + {WEAKEST}::DOUBLE) ELSE
    least(greatest(((q - 2 * mu * k + mu * mu * n) / (mu * (1 - mu)) - g) / (n - g), 1 / (1 + {STRONGEST}::DOUBLE)), 1 / (1 + {WEAKEST}::DOUBLE)) END AS rho FROM spread, t
), m AS (
  SELECT coalesce(max(1 / rho - 1) FILTER (WHERE level = 'h'), {WEAKEST}) AS mh, coalesce(max(1 / rho - 1) FILTER (WHERE level = 'd'), {WEAKEST}) AS md,
         coalesce(max(1 / rho - 1) FILTER (WHERE level = 's'), {WEAKEST}) AS ms FROM rho
), ps AS (SELECT suffix, (k + ms * mu) / (n + ms) AS p FROM s, m, t
), pd AS (SELECT d.suffix, d.domain, (d.k + md * ps.p) / (d.n + md) AS p FROM d JOIN ps USING (suffix), m
), ab AS (SELECT h.host, h.k + mh * pd.p AS a, h.n - h.k + mh * (1 - pd.p) AS b FROM h JOIN pd USING (suffix, domain), m
), bad AS (SELECT host FROM ab WHERE a / (a + b) + 1.6448536269514722 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < 0.8
), ruled AS (
  SELECT q.*, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM q
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP4_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), x AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda z: z <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda z: length(translate(z, {_BLANKS}, '')) > 0) AS lines FROM w
), grams AS (
  SELECT r, i, [words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM x WHERE len(words) >= 5)
), twice AS (
  SELECT r, unnest(ii) AS i FROM (SELECT r, list(i) AS ii FROM grams GROUP BY r, g HAVING count(*) > 1)
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + o AS p FROM twice, (SELECT unnest(range(0, 5)) AS o)) GROUP BY r
), f AS (
  SELECT doc_id, len(words) AS n_words, length(translate(t, {_BLANKS}, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda z: lower(z) IN ({_STOP}))) AS n_stop FROM x LEFT JOIN covered c USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars::DOUBLE / n_words BETWEEN 2 AND 15 AND n_symbols::DOUBLE / n_words <= 0.1
    AND n_stop::DOUBLE / n_words >= 0.02 AND n_dup_lines::DOUBLE / n_lines <= 0.5 AS kept
FROM f
"""

OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d
), f AS (
  SELECT r, doc_id, i, trim(line, {_BLANKS}) AS line, len(string_split_regex(trim(line, {_BLANKS}), '[ \\t\\n\\x0B\\f\\r]+')) AS n,
         row_number() OVER (PARTITION BY r ORDER BY i) AS p FROM l WHERE trim(line, {_BLANKS}) <> ''
), near AS (
  SELECT r, doc_id, p, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c, n AS na, lead(n) OVER o AS nb, lead(n, 2) OVER o AS nc FROM f WINDOW o AS (PARTITION BY r ORDER BY i)
), made AS (
  SELECT r, doc_id, p, CASE WHEN na >= {MIN_WORDS} THEN md5(a) WHEN na + nb >= {MIN_WORDS} THEN md5(a || chr(10) || b) WHEN c IS NOT NULL THEN md5(a || chr(10) || b || chr(10) || c) END AS print,
         coalesce(na >= {MIN_WORDS} OR na + nb >= {MIN_WORDS} OR na + nb + nc >= {MIN_WORDS}, false) AS rich FROM near
), w AS (
  SELECT *, lag(print) OVER o AS before, lead(print) OVER o AS after FROM made WHERE print IS NOT NULL WINDOW o AS (PARTITION BY r ORDER BY p)
), prints AS (
  SELECT r, doc_id, p, print FROM w WHERE rich OR print <= before OR print < after OR before IS NULL AND after IS NULL
), first AS (
  SELECT print, min((doc_id, p)) AS spot FROM prints GROUP BY print HAVING count(*) > 1
), later AS (
  SELECT r, p, spot[1] AS first_id, p - spot[2] AS down FROM prints JOIN first USING (print) WHERE (doc_id, p) > spot
), equal AS (
  SELECT x.r, x.first_id, x.down, a.p, a.p - row_number() OVER (PARTITION BY x.r, x.first_id, x.down ORDER BY a.p) AS island
  FROM (SELECT DISTINCT r, first_id, down FROM later) x JOIN f a ON a.r = x.r JOIN f b ON b.doc_id = x.first_id AND b.p = a.p - x.down AND b.line = a.line
), runs AS (
  SELECT r, first_id, down, min(p) AS a, max(p) AS b FROM equal GROUP BY r, first_id, down, island
), gone AS (
  SELECT DISTINCT f.r, f.i FROM later JOIN runs ON runs.r = later.r AND runs.first_id = later.first_id AND runs.down = later.down AND later.p BETWEEN runs.a AND runs.b
    JOIN f ON f.r = runs.r AND f.p BETWEEN runs.a AND runs.b
), kept AS (
  SELECT l.r, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS t
  FROM l LEFT JOIN gone g ON l.r = g.r AND l.i = g.i GROUP BY l.r
)
SELECT d.doc_id, n_lines, n_removed, sha256(kept.t) AS kept_sha256 FROM d JOIN kept USING (r)
"""
