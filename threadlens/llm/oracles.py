"""DuckDB counterparts of those corpus queries that SQL can express."""

from __future__ import annotations

from threadlens.llm.url_filter import LONG_SUFFIXES

LEVEL = """
{name}_m AS (SELECT c.*, p.rate AS m FROM {counts} c JOIN {parents} p USING ({parent})),
{name}_s AS (
  SELECT sum(n * power(good / n - m, 2)) FILTER (n > 0) - sum(m * (1 - m)) FILTER (n > 0) AS more,
         sum((n - 1) * m * (1 - m)) FILTER (n > 0) AS weight FROM {name}_m),
{name}_p AS (
  SELECT 1 / least(greatest(CASE WHEN weight > 0 THEN more / weight ELSE 0.001 END, 0.001), 0.999) - 1 AS prior FROM {name}_s),
{name} AS (
  SELECT * EXCLUDE (m), (prior * m + good) / (prior + n) AS rate, prior + n AS strength FROM {name}_m, {name}_p)"""

OP10 = (
    """
WITH urls AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
pairs AS (SELECT DISTINCT host, path FROM urls),
fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM pairs JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path),
known AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
names AS (
  SELECT host, CASE WHEN ends_with(bare, '.') THEN bare[:-2] ELSE bare END AS name
  FROM (SELECT host, regexp_replace(list_last(string_split(host, '@')), ':[0-9]*\\z', '') AS bare FROM (SELECT DISTINCT host FROM urls))),
parts AS (
  SELECT host, name, starts_with(name, '[') OR regexp_full_match(name, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS address,
    string_split(name, '.') AS labels, array_to_string(labels[-2:], '.') AS two, two IN (LONG_SUFFIXES) AS long FROM names),
places AS (
  SELECT host, CASE WHEN address THEN name WHEN long THEN array_to_string(labels[-3:], '.') ELSE two END AS domain,
    CASE WHEN address THEN '[ip]' WHEN long THEN two ELSE labels[-1] END AS suffix FROM parts),
hosts AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix,
    count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS good
  FROM urls JOIN places USING (host) LEFT JOIN known USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good, 1 AS one FROM domains GROUP BY suffix),
whole AS (SELECT one, CASE WHEN sum(n) > 0 THEN sum(good) / sum(n) ELSE 1.0 END AS rate FROM suffixes GROUP BY one),
"""
    + ",".join([
        LEVEL.format(name="by_suffix", counts="suffixes", parents="whole", parent="one"),
        LEVEL.format(name="by_domain", counts="domains", parents="by_suffix", parent="suffix"),
        LEVEL.format(name="by_host", counts="hosts", parents="by_domain", parent="domain"),
    ])
    + """
SELECT page_id, u.host, u.path, f.rule,
  coalesce(f.verdict, CASE WHEN h.rate + 1.645 * sqrt(h.rate * (1 - h.rate) / (h.strength + 1)) < 0.6 THEN 'block' ELSE 'allow' END) AS verdict,
  h.n AS n_labelled, CAST(h.good AS BIGINT) AS n_good
FROM urls u LEFT JOIN fits f ON u.host = f.host AND u.path = f.path JOIN by_host h ON u.host = h.host"""
).replace("LONG_SUFFIXES", ", ".join(f"'{s}'" for s in LONG_SUFFIXES))

OP13 = r"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list FROM (SELECT DISTINCT text FROM rows)),
facts AS (
  SELECT text, len(list) < 50 AS a, 100 * len(list_distinct(list)) < 65 * len(list) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d
  FROM words),
firsts AS (SELECT text, min(doc_id) AS least FROM rows GROUP BY text),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END,
           CASE WHEN r.doc_id > least THEN 'E' END) AS fails
  FROM rows r JOIN facts USING (text) JOIN firsts USING (text) LEFT JOIN said ON r.doc_id = said.doc_id),
sets AS (SELECT part, good, toxic, fails, count(*) AS n FROM marked GROUP BY ALL),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE q.l != p.l AND r.l NOT IN (p.l, q.l) AND s.l NOT IN (p.l, q.l, r.l) AND t.l NOT IN (p.l, q.l, r.l, s.l)),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, left(filter_order, step - 1) AS earlier
  FROM orders, range(1, 6) t(step)),
cases AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS failed, fails = letter AS alone,
    translate(fails, earlier, '') != fails AS gone
  FROM sets, steps),
counted AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM cases GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted"""


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": OP10, "op13_filter_interactions": OP13}
