"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORDS = rf"list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '')"

LINE_RULES = rf"""WITH
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') || CASE WHEN source IS NULL THEN '-' ELSE '+' END AS host,
                   coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, {WORDS} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
            FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w) x),
starts AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) x WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM starts) x GROUP BY rid),
lines AS MATERIALIZED (SELECT rid, length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars,
          trim(translate(regexp_replace(lower(line), '{SPACE}+', ' ', 'g'), '123456789', '000000000')) AS norm
          FROM (SELECT rid, unnest(lines) AS line FROM w) x),
often AS (SELECT host, norm FROM lines JOIN d USING (rid) GROUP BY host, norm HAVING count(DISTINCT t) > 10),
gone AS (SELECT rid, sum(chars) AS n FROM lines JOIN d USING (rid) JOIN often USING (host, norm) GROUP BY rid),
base AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS removed_chars
         FROM d JOIN w USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN gone g USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND removed_chars <= 0.5 * word_chars AS kept, CAST(removed_chars AS BIGINT) AS removed_chars
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base) x"""

JACCARD_JOIN = rf"""WITH RECURSIVE
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {WORDS} AS words FROM d),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(words[i:i + 4], ' ') AS sh FROM (
        SELECT rid, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0) x),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.rid <> y.rid GROUP BY x.rid, y.rid) c
  JOIN n na ON na.rid = c.a JOIN n nb ON nb.rid = c.b WHERE 5 * k >= 4 * (na.n + nb.n - k)),
cc(id, comp) USING KEY (id) AS (
  SELECT rid, rid FROM d
  UNION
  SELECT l.b AS id, min(c.comp) AS comp FROM cc c JOIN links l ON l.a = c.id LEFT JOIN recurring.cc r ON r.id = l.b
  GROUP BY l.b, r.comp HAVING min(c.comp) < r.comp)
SELECT doc_id, min(doc_id) OVER (PARTITION BY comp) AS class_id, coalesce(k, 0) AS n_links
FROM d JOIN cc ON cc.id = d.rid LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) l ON l.a = d.rid"""

ORACLES = {"op4_line_rules": LINE_RULES, "op6_jaccard_join": JACCARD_JOIN}
