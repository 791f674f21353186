"""DuckDB SQL that gives the operators' results on the same tables."""

from __future__ import annotations

from .fill_middle import KEPT_PERCENT, MIDDLE, PREFIX, SEED, SPM_PERCENT, SUFFIX
from .filter_audit import CAPITALS_PERCENT, DISTINCT_PERCENT, FILTERS
from .filter_audit import MIN_WORDS as AUDIT_WORDS
from .filter_audit import SIGNS
from .mixing import Mix
from .quality_rules import CAPITALS, FENCE, MARKS, METRICS, MIN_ROWS, MIN_WORDS
from .url_filters import LISTED_NAMES, LISTED_SUFFIXES, NUMBERED, RULES

WORD = r"[^\x20\x09-\x0D]+"


def exact_dedup(docs: str = "documents") -> str:
    return f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM {docs} WINDOW same AS (PARTITION BY coalesce(text, ''))"""


EXACT_DEDUP = exact_dedup()


def quality_measures(docs: str = "documents") -> str:
    """Common table expressions up to `judged`: every row of docs with its measures and kept."""
    metrics = ", ".join(f"('{m}', {m})" for m in METRICS)
    within = " AND ".join(f"{m} <= max_{m}" for m in METRICS)
    coarse_limit = f"CASE WHEN w.rows_ >= {MIN_ROWS} THEN w.fence ELSE e.fence END"
    limit = f"CASE WHEN o.rows_ >= {MIN_ROWS} THEN least(o.fence, {coarse_limit}) ELSE {coarse_limit} END"
    pivot = ", ".join(f"max(CASE WHEN o.metric = '{m}' THEN {limit} END) AS max_{m}" for m in METRICS)
    signs = MARKS.replace("'", "''")
    quart = "min(CASE WHEN upto * 4 >= total * {q} THEN bucket END)"
    most = "({q3} + (1::BIGINT << greatest(length(bin(({q3})::BIGINT)) - 7, 0)) - 1)".format(q3=quart.format(q=3))
    fence = f"{most} + {FENCE} * ({most} - {quart.format(q=1)} + 1)"
    return rf"""
texts AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {docs}),
worded AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM texts),
windows AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM worded WHERE len(words) >= 3),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
counted AS (
  SELECT w.*, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM worded w LEFT JOIN covered c USING (rid)),
measured AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * (length(t) - length(translate(t, '{signs}', ''))) // greatest(word_chars, 1) AS marks,
         1000 * (length(t) - length(translate(t, '{CAPITALS}', ''))) // greatest(word_chars, 1) AS capitals,
         1000 * word_chars // greatest(n_words, 1) AS word_len
  FROM counted),
metrics AS (SELECT rid, lang, source, metric, value FROM measured, LATERAL (VALUES {metrics}) AS m(metric, value) WHERE NOT base_failed),
fine AS (SELECT lang, source, metric, value - value % (1::BIGINT << greatest(length(bin(value::BIGINT)) - 7, 0)) AS bucket, count(*) AS n FROM metrics GROUP BY ALL),
coarse AS (SELECT lang, metric, bucket, sum(n) AS n FROM fine GROUP BY ALL),
whole AS (SELECT metric, bucket, sum(n) AS n FROM fine GROUP BY ALL),
own AS (SELECT lang, source, metric, {fence} AS fence, max(total) AS rows_ FROM (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM fine) GROUP BY lang, source, metric),
wider AS (SELECT lang, metric, {fence} AS fence, max(total) AS rows_ FROM (
  SELECT *, sum(n) OVER (PARTITION BY lang, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, metric) AS total FROM coarse) GROUP BY lang, metric),
widest AS (SELECT metric, {fence} AS fence FROM (
  SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY metric) AS total FROM whole) GROUP BY metric),
limits AS (SELECT o.lang, o.source, {pivot} FROM own o JOIN wider w ON o.metric = w.metric AND o.lang IS NOT DISTINCT FROM w.lang JOIN widest e ON e.metric = o.metric GROUP BY o.lang, o.source),
judged AS (SELECT m.*, NOT base_failed AND coalesce({within}, true) AS kept FROM measured m LEFT JOIN limits l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source)"""


QUALITY_RULES = f"""
WITH {quality_measures()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {", ".join(f"{m}::BIGINT AS {m}" for m in METRICS)}, kept FROM judged"""


def url_filters() -> str:
    def cases(what: str) -> str:
        rules = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[1:]))
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'" for v, h, p in rules) + " END"

    values = lambda x: ", ".join(f"('{v}')" for v in x)
    return f"""
WITH names AS (SELECT * FROM (VALUES {values(LISTED_NAMES)}) n(n)), suffixes AS (SELECT * FROM (VALUES {values(LISTED_SUFFIXES)}) s(s)),
listed AS (SELECT n || '.' || s || '/' AS key FROM names, suffixes UNION ALL SELECT n || k || '.' || s || '/' FROM names, suffixes, range(1, {NUMBERED + 1}) r(k)
  UNION ALL SELECT 'redirect.' || s || '/' || n || '/' || k || '/' FROM names, suffixes, range(1, {NUMBERED + 1}) r(k)),
parts AS (
  SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {cases("rule")} AS rule, {cases("verdict")} AS said, regexp_replace(regexp_replace(host, ':[0-9]*$|[.]$', ''), '^www[.]', '') AS bare FROM parts),
keys AS (SELECT rid, bare || rtrim(path, '/') || '/' AS key FROM ruled WHERE bare <> '' UNION ALL SELECT rid, array_to_string(labels[i:], '.') || '/' FROM (SELECT rid, string_split(bare, '.') AS labels, unnest(range(1, len(string_split(bare, '.')) + 1)) AS i FROM ruled WHERE bare <> '')),
hits AS (SELECT DISTINCT rid FROM keys JOIN listed USING (key))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN hits.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN hits USING (rid)"""


URL_FILTERS = url_filters()


def mixing_plan(docs: str = "documents", mix: Mix | None = None) -> str:
    """Common table expressions up to `planned`: every row of docs with domain, n_tokens and times."""
    mix = mix or Mix()

    def weight(key: str, weights) -> str:
        return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END" if weights else "1"

    def fill(name: str, nodes: str, parents: str, child: str) -> str:
        by = f"PARTITION BY {parents}" if parents else ""
        return f"""
{name}_a AS (SELECT *, coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER ({by} ORDER BY capacity / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM ({nodes})),
{name}_b AS (SELECT *, capacity::HUGEINT * open <= (budget - before)::HUGEINT * weight AS full_ FROM {name}_a),
{name}_c AS (SELECT *, sum(CASE WHEN full_ THEN capacity ELSE 0 END) OVER ({by}) AS taken, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({by}) AS thirsty FROM {name}_b),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN full_ THEN capacity ELSE (budget - taken)::HUGEINT * weight // thirsty END AS share FROM {name}_c)"""

    top = f"SELECT domain, sum(tokens) * {mix.max_epochs} AS capacity, {weight('domain', mix.domains)} AS weight, (SELECT sum(tokens) * {mix.budget_permille} // 1000 FROM leaves) AS budget FROM leaves GROUP BY domain"
    mid = f"SELECT l.domain, lang, sum(tokens) * {mix.max_epochs} AS capacity, {weight('lang', mix.langs)} AS weight, any_value(share) AS budget FROM leaves l JOIN top USING (domain) GROUP BY l.domain, lang"
    low = f"SELECT l.domain, l.lang, l.source, tokens, tokens * {mix.max_epochs} AS capacity, {weight('l.source', mix.sources)} AS weight, m.share AS budget FROM leaves l JOIN mid m ON l.domain = m.domain AND l.lang IS NOT DISTINCT FROM m.lang"
    return rf"""
mrows AS (SELECT row_number() OVER () AS mid_, *, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'reference' ELSE 'forum' END AS domain,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM mrows GROUP BY ALL),
{fill("top", top, "", "domain")},
{fill("mid", mid, "domain", "lang")},
{fill("low", low, "domain, lang", "source")},
placed AS (SELECT r.*, CASE WHEN tokens > 0 THEN share // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest
  FROM mrows r JOIN low l ON r.domain = l.domain AND r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source),
ordered AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5(concat_ws(':', '{mix.seed}', epochs::VARCHAR, coalesce(doc_id::VARCHAR, ''))), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed),
planned AS (SELECT *, (epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS times FROM ordered)"""


MIXING = f"WITH {mixing_plan()} SELECT doc_id, domain, lang, source, n_tokens, times FROM planned"


FILL_IN_MIDDLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
u AS (SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS c2,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR ('0x' || h[17:24])::BIGINT % 100 >= {KEPT_PERCENT} THEN 'plain'
       WHEN ('0x' || h[25:32])::BIGINT % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t),
cut AS (SELECT *, array_to_string(units[1:least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(units[greatest(c1, c2) + 1:], '') AS s FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM cut"""

FILTER_AUDIT = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, len(w) < {AUDIT_WORDS} AS a, 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(text) AS c, regexp_matches(text, '[{SIGNS}]') AS d,
  coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e FROM t LEFT JOIN said ON said.doc_id = t.doc_id),
masks AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
letters AS (SELECT unnest(['{"', '".join(FILTERS)}']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, list_transform(string_split(filter_order[1:step], ''), lambda x: ascii(x) - 64) AS upto FROM orders, range(1, 6) r(step)),
met AS (SELECT part, filter_order, step, own, n, good, bad, fails[ascii(own) - 64] AS failing, len(list_filter(upto[1:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS how_many FROM masks, steps),
counted AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failing AND how_many = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN bad ELSE 0 END) AS toxic_lost FROM met GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted"""
