"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from nearfield.llm import quality_rules, secret_scan, url_trust
from nearfield.llm.mixing import CAP, SEED

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _secrets() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    placed = lambda p, group: f"""
  SELECT r, part, CAST(e - length(x) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
    SELECT r, x, part, sum(length(x) + length(gap)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, unnest(m) AS x, unnest(p) AS part, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM (
        SELECT r, regexp_extract_all(t, {quoted(p)}) AS m, regexp_extract_all(t, {quoted(p)}, {group}) AS p, string_split_regex(t, {quoted(p)}) AS g
        FROM d WHERE regexp_matches(t, {quoted(p)}))))"""  # noqa: E731
    tables, spans = [], []
    for k, (kind, pattern, group, least) in enumerate(secret_scan.BASE):
        tables.append(f"{kind} AS ({placed(pattern, group)}\n)")
        spans.append(f"SELECT r, {k} AS k, '{kind}' AS kind, s, e FROM {kind} WHERE length(part) >= {least}")
    for k, c in enumerate(secret_scan.CLASSES, len(secret_scan.BASE)):
        n, w = c.kind, c.window
        tables += [
            f"{n}_runs AS ({placed(f'[{c.characters}]{{{w},}}', 0)}\n)",
            f"{n}_windows AS (SELECT r, s, j, substr(part, CAST(j + 1 AS BIGINT), {w}) AS w FROM {n}_runs, unnest(range(0, length(part) - {w - 1})) AS u(j)"
            f" WHERE NOT regexp_matches(part, {quoted(secret_scan.ALLOW)}))",
            f"{n}_dense AS (SELECT r, s, j FROM {n}_windows WHERE list_sum([({secret_scan.weights(w)[1:]})[{w} - length(replace(w, x, ''))]"
            f" FOR x IN list_distinct(string_split(w, ''))]) <= {secret_scan.limit(c)})",
            f"{n}_spans AS (SELECT r, s + min(j) AS s, s + max(j) + {w} AS e FROM (SELECT *, sum(new) OVER (PARTITION BY r, s ORDER BY j) AS island FROM"
            f" (SELECT *, CASE WHEN j <= lag(j) OVER (PARTITION BY r, s ORDER BY j) + {w} THEN 0 ELSE 1 END AS new FROM {n}_dense)) GROUP BY r, s, island)",
        ]
        spans.append(f"SELECT r, {k}, '{n}', s, e FROM {n}_spans")
    count = lambda k: f"CAST(count(*) FILTER (k = {k}) AS BIGINT)"
    listed = lambda only: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) {only}, '')"
    first = len(secret_scan.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(tables)},
spans AS ({" UNION ALL ".join(spans)})
SELECT doc_id, {", ".join(f"{count(k)} AS n_{kind}" for k, (kind, *_) in enumerate(secret_scan.BASE))},
  sha256({listed(f"FILTER (k < {first})")}) AS base_sha256, {listed("FILTER (k IS NOT NULL)")} AS spans,
  CAST(count(*) FILTER (k >= {first}) AS BIGINT) AS n_added
FROM d LEFT JOIN spans USING (r) GROUP BY r, doc_id"""


_SEARCH = r"""
WITH term_of AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
asked AS (SELECT DISTINCT item_id, item_text, unnest(regexp_extract_all(translate(item_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text AS item_text FROM benchmark)),
lengths AS (SELECT r, doc_id, count(*) AS n FROM term_of GROUP BY r, doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
counts AS (SELECT r, term, count(*) AS tf FROM term_of WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term, docs),
parts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS part
  FROM counts JOIN lengths USING (r) JOIN weights USING (term), total),
scored AS (SELECT item_id, item_text, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, item_text ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50"""


def _quality_rules() -> str:
    symbols = quality_rules.SYMBOLS
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in quality_rules.STOP_WORDS)
    tests = []
    for rule in quality_rules.RULES:
        base = rule.base or "1"
        if rule.low is not None:
            tests.append(f"{rule.measure} >= CAST({rule.low} AS DOUBLE) * {base}")
        if rule.high is not None:
            tests.append(f"{rule.measure} <= CAST({rule.high} AS DOUBLE) * {base}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 8) AS k(k) GROUP BY r),
lines AS (SELECT r, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
line_counts AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM lines GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{symbols}', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(len([x FOR x IN w IF lower(x) IN ({stop})]) AS BIGINT) AS n_stop_words,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (r) LEFT JOIN line_counts USING (r)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept
FROM b"""


_MIX = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {CAP} AS lim FROM per
),
leveled AS (
  SELECT *, row_number() OVER rising AS place,
    CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (rising ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted
  WINDOW rising AS (ORDER BY CAST(lim AS DOUBLE) / weight, source ASC NULLS LAST)
),
final AS (SELECT arg_min(level, place) AS level FROM leveled WHERE level * weight <= lim),
targets AS (SELECT source, source_size, least(final.level * weight, CAST(lim AS DOUBLE)) AS target FROM leveled, final),
rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t), 1, 13) AS BIGINT) AS DOUBLE)
      / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated"""


def _url_trust() -> str:
    host = lambda u: (
        f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_trust.UPPER}', '{url_trust.LOWER}')"
    )
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    cases = {"rule": [], "v": []}
    for verdict, rule in sorted(url_trust.RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}'))"
        cases["rule"].append(f"WHEN {fits} THEN '{rule}'")
        cases["v"].append(f"WHEN {fits} THEN '{verdict}'")
    link = url_trust.LINK.replace("'", "''")
    low, c = f"translate(regexp_extract(link, '//(.*)$', 1), '{url_trust.UPPER}', '{url_trust.LOWER}')", url_trust.DAMPING
    steps = "".join(
        f""",
r{k + 1} AS MATERIALIZED (
  SELECT kind, host, sum(mass) AS mass FROM (
    SELECT w.kind, w.b AS host, r.mass * w.share * {c} AS mass FROM r{k} r JOIN ways w ON r.kind = w.kind AND r.host = w.a
    UNION ALL SELECT kind, host, mass FROM r0) GROUP BY kind, host)"""
        for k in range(url_trust.ROUNDS)
    )
    return f"""
WITH p AS (SELECT page_id, {host("url")} AS host, {path} AS path, coalesce(html, '') AS html FROM pages),
j AS (SELECT *, CASE {" ".join(cases["rule"])} END AS rule, CASE {" ".join(cases["v"])} END AS v FROM p),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p),
edges AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, {low} AS dst FROM links)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
),
both_ways AS (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
ways AS (SELECT kind, a, b, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind, a) AS share FROM both_ways),
seeds AS (
  SELECT host, CAST(count(*) FILTER (v = 'allow') AS DOUBLE) / count(*) AS trust,
    CAST(count(*) FILTER (v = 'block') AS DOUBLE) / count(*) AS distrust
  FROM j WHERE v IS NOT NULL GROUP BY host
),
r0 AS (
  SELECT kind, host, mass * {1 - c!r} AS mass FROM (
    SELECT 'trust' AS kind, host, trust AS mass FROM seeds UNION ALL SELECT 'distrust', host, distrust FROM seeds) WHERE mass > 0
){steps},
hosts AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS t, sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS u
  FROM r{url_trust.ROUNDS} GROUP BY host
)
SELECT page_id, j.host, path, rule,
  coalesce(v, CASE WHEN round(u, 9) > round({url_trust.THRESHOLD} * (t + u), 9) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN hosts ON j.host = hosts.host"""


ORACLES = {
    "op6_url_trust": _url_trust(),
    "op9_quality_rules": _quality_rules(),
    "op10_source_mix": _MIX,
    "op11_lexical_search": _SEARCH,
    "op12_secret_scan": _secrets(),
}
