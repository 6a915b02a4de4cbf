"""SQL counterparts of the text queries, where SQL can express them."""

from __future__ import annotations

from .collocations import COVER, LEAST, TOP
from .licenses import COPYRIGHT, KNOWN, SPELLINGS
from .mixing import SEED
from .quality_rules import ERROR, GRID, RISK, RULES
from .spot_signatures import ANCHORS, CHAIN
from .url_rules import METHOD

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT)}, '', 'g')"
    for pattern, by in SPELLINGS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    return out


def _flat(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[ \n]+', ' ', 'g'), ' ')"


LICENSES = f"""
WITH known AS (
  SELECT DISTINCT license, sha256({_flat(_canonical("body"))}) AS digest
  FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)}) v(license, body)
), shaped AS (
  SELECT row_number() OVER () AS r, doc_id, {_canonical("text")} AS c FROM documents
), whole AS (SELECT r, doc_id, c, {_flat("c")} AS w FROM shaped
), units AS (
  SELECT r, doc_id, w AS u, true AS entire FROM whole WHERE w <> ''
  UNION ALL
  SELECT r, doc_id, u, false FROM (
    SELECT DISTINCT r, doc_id, w, {_flat("unnest(list_concat(regexp_split_to_array(c, '\\n *\\n'), string_split(c, chr(10))))")} AS u FROM whole
  ) WHERE u <> '' AND u <> w
), hits AS (
  SELECT doc_id, min(CASE WHEN entire THEN license END) AS license,
         array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses
  FROM units JOIN known ON sha256(u) = digest GROUP BY doc_id
)
SELECT w.doc_id, CASE WHEN w.w <> '' THEN sha256(w.w) END AS digest, h.license, h.licenses
FROM whole w LEFT JOIN hits h ON w.doc_id IS NOT DISTINCT FROM h.doc_id
"""

MIXING = rf"""
WITH sizes AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, source_size * 2.0::DOUBLE AS most FROM totals
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM levels
), held AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), rows_ AS (
  SELECT s.doc_id, s.size, h.source_size, h.target, h.whole,
         floor(h.target - h.whole * h.source_size + 0.5::DOUBLE)::BIGINT AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN held h ON s.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM rows_
"""


def _spots(name: str, text: str) -> str:
    """Signatures (id, s) of a table (id, text), by windows over its words."""
    anchors = ", ".join(_quoted(a) for a in sorted(set(ANCHORS)))
    return f"""
{name}_words AS (
  SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS words FROM pairs)
), {name}_marked AS (
  SELECT id, word, pos, word IN ({anchors}) AS anchor,
         count(*) FILTER (WHERE word NOT IN ({anchors})) OVER (PARTITION BY id ORDER BY pos) AS content
  FROM {name}_words
), {name}_content AS (
  SELECT id, content, word, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3
  FROM {name}_marked WHERE NOT anchor WINDOW w AS (PARTITION BY id ORDER BY pos)
), {name}_starts AS (
  SELECT id, word AS anchor, content + 1 AS content FROM {name}_marked WHERE anchor
  UNION ALL SELECT DISTINCT id, '^', 1 FROM {name}_words
), {name} AS (
  SELECT s.id, list_sort(list(DISTINCT substr(md5(s.anchor || ':' || concat_ws(' ', c.word, c.w2, c.w3)), 1, 12))) AS s
  FROM {name}_starts s JOIN {name}_content c ON s.id = c.id AND s.content = c.content GROUP BY s.id
)"""


SPOTS = f"""
WITH ordered AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS id, count(*) OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), pairs AS (
  SELECT a.id, a.doc_id, a.text, length(a.text) AS n_chars, b.text AS next_text,
         left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM ordered a JOIN ordered b ON b.id = a.id % a.n + 1
), {_spots("own", "text")}, {_spots("cut", "edited")}, {_spots("nxt", "next_text")}
, sets AS (
  SELECT p.doc_id, p.n_chars, p.edited, coalesce(o.s, []) AS o, coalesce(e.s, []) AS e, coalesce(x.s, []) AS x
  FROM pairs p LEFT JOIN own o USING (id) LEFT JOIN cut e USING (id) LEFT JOIN nxt x USING (id)
)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(o, ',') AS fingerprint,
       array_to_string(e, ',') AS edited_fingerprint,
       CASE WHEN len(o) + len(e) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(o, e))::DOUBLE / (len(o) + len(e) - len(list_intersect(o, e))) END AS near_edited,
       CASE WHEN len(o) + len(x) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(o, x))::DOUBLE / (len(o) + len(x) - len(list_intersect(o, x))) END AS near_next
FROM sets
"""
assert CHAIN == 3

REPEATS = rf"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, {WORDS} AS w FROM documents)
), windows AS (
  SELECT doc_id, pos, word, CASE WHEN count(*) OVER w = 13 THEN list(word) OVER w END AS seq FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), judged AS (
  SELECT doc_id, pos, word, CASE WHEN seq IS NOT NULL AND min(doc_id) OVER (PARTITION BY seq) < doc_id THEN 1 ELSE 0 END AS again
  FROM windows
), marked AS (
  SELECT doc_id, pos, word,
         max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM judged
), done AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""

LINES = r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM numbered
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY r
"""

URLS = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN {" OR ".join(f"regexp_matches(host || path, {_quoted(p)})" for _, _, p, _ in METHOD)} THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""

_RATIOS = ("n_symbols / nullif(word_chars, 0)", "n_dup_lines / nullif(n_lines, 0)", "n_repeat_words / nullif(n_words, 0)", "n_capitals / nullif(word_chars, 0)")
_SHARE = f"{RISK / len(RULES)!r}::DOUBLE"

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w FROM documents
), listed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs
), windows AS (
  SELECT r, pos, CASE WHEN count(*) OVER w = 8 THEN list(word) OVER w END AS seq FROM listed
  WINDOW w AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), judged AS (
  SELECT r, pos, CASE WHEN seq IS NOT NULL AND count(*) OVER (PARTITION BY r, seq) > 1 THEN 1 ELSE 0 END AS again FROM windows
), covered AS (
  SELECT r, max(again) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM judged
), repeated AS (SELECT r, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY r
), lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs
), full_lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
  FROM docs LEFT JOIN repeated USING (r) LEFT JOIN full_lines USING (r)
), valued AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         {", ".join(f"coalesce({v}, 0.0) AS v{i}" for i, v in enumerate(_RATIOS))}
  FROM measured
), good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), held AS (
  SELECT lang, unnest([0, 1, 2, 3]) AS rule, unnest([v0, v1, v2, v3]) AS v FROM valued JOIN good USING (doc_id) WHERE NOT base_failed
), grid AS (SELECT * FROM (VALUES {", ".join(f"({i}, {c!r}::DOUBLE)" for i, c in enumerate(GRID))}) g(step, c)
), counts AS (
  SELECT lang, rule, step, c, count(*) AS n, count(*) FILTER (WHERE v > c) AS x FROM held, grid GROUP BY ALL
), tested AS (
  SELECT *, CASE WHEN x >= n * {_SHARE} THEN 1.0::DOUBLE
    ELSE list_sum(list_transform(range(x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                                                             + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE})))) END AS p,
    {ERROR!r}::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM held)) * {len(RULES)}) AS level
  FROM counts
), stopped AS (SELECT *, min(step) FILTER (WHERE p > level) OVER (PARTITION BY lang, rule) AS stop FROM tested
), cuts AS (
  SELECT lang, {", ".join(f"min(c) FILTER (WHERE rule = {i}) AS c{i}" for i in range(len(RULES)))} FROM stopped
  WHERE step < coalesce(stop, {len(GRID)}) GROUP BY lang
), ruled AS (
  SELECT v.*, CASE {" ".join(f"WHEN v{i} > c{i} THEN '{r}'" for i, r in enumerate(RULES))} END AS rejected_by
  FROM valued v LEFT JOIN cuts ON v.lang IS NOT DISTINCT FROM cuts.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected_by IS NULL AS kept, rejected_by
FROM ruled
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (
    SELECT lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents
  )
), places AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p
  FROM pieces, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k
), f AS (SELECT lang, p, k, count(*) AS c FROM places GROUP BY ALL
), totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), often AS (SELECT * FROM f WHERE k > 1 AND c >= {LEAST}
), held AS (
  SELECT lang, p, max(c) AS most
  FROM (SELECT lang, p[1:2] AS p, c FROM often WHERE k = 3 UNION ALL SELECT lang, p[2:3], c FROM often WHERE k = 3) GROUP BY ALL
), cuts AS (
  SELECT lang, p, c AS a, k, unnest(range(1, k)) AS after FROM often
), scored AS (
  SELECT x.lang, x.p, x.a, x.after, l.c AS l, r.c AS r,
         ((1000000::HUGEINT * x.a * x.a) // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM cuts x
  JOIN f l ON l.lang = x.lang AND l.p = x.p[1:x.after]
  JOIN f r ON r.lang = x.lang AND r.p = x.p[x.after + 1:x.k]
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, after) AS o FROM scored
), ranked AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN held h ON h.lang = s.lang AND h.p = s.p
  WHERE s.o = 1 AND (h.most IS NULL OR 100 * h.most < {COVER} * s.a)
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= {TOP}
"""

SQL: dict[str, str] = {
    "op3_quality_rules": QUALITY,
    "op2_license_digest": LICENSES,
    "op5_water_filling": MIXING,
    "op6_spot_signatures": SPOTS,
    "op8_suffix_trees": REPEATS,
    "op9_line_runs": LINES,
    "op10_url_rules": URLS,
    "op13_collocations": COLLOCATIONS,
}
