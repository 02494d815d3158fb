"""The opN_ queries and, where SQL can express them, the same results as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, mixing, near_dup, packing, passages, quality, secrets, tiff, url_filter
from .common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(read(spark, sf_dir, "conversations"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.without_passages(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "n_removed", "removed_chars", spans.alias("spans"), "text")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


_SAID = "'<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10)"
OP3_SQL = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(lower(trim(role)), 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
turns AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, ',') OVER (w ROWS UNBOUNDED PRECEDING)) AS h
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
ends AS (SELECT conv_id, n, h FROM turns WHERE pos = n AND (n, h) NOT IN (SELECT (pos, h) FROM turns WHERE pos < n)),
kept AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_equal FROM ends GROUP BY n, h)
SELECT conv_id, (pos - 1) // {chat.BLOCK} AS part, n_turns, n_equal, string_agg({_SAID}, '' ORDER BY pos) AS text
FROM turns JOIN kept USING (conv_id) GROUP BY ALL
"""

_BLANK = "[\\x20\\x09-\\x0D]"
_UNSPACED = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in passages.UNSPACED)
_WORDS = f"[{_UNSPACED}]|[^\\x20\\x09-\\x0D{_UNSPACED}]+"
_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS ws, string_split_regex(text, '{_WORDS}') AS gaps FROM documents WHERE text <> ''),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS gap, generate_subscripts(ws, 1) AS i FROM cut),
spot AS (SELECT doc_id, i, {_FOLDED.format('w')} AS w, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(w) AS size FROM word),
run AS (SELECT doc_id, i, e - size AS s, lead(e, {passages.WINDOW - 1}) OVER d AS e, md5(string_agg(w, ' ') OVER (d ROWS BETWEEN CURRENT ROW AND {passages.WINDOW - 1} FOLLOWING)) AS run FROM spot WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, row_number() OVER r AS k, first(doc_id) OVER r AS d0, first(e) OVER r AS e0 FROM run WHERE e IS NOT NULL WINDOW r AS (PARTITION BY run ORDER BY doc_id, i)),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
forms AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY place) - length(line) - 1 AS s, {_FOLDED.format(f"regexp_replace(regexp_replace(line, '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g')")} AS form FROM lines),
gone AS (
  SELECT doc_id, CASE WHEN doc_id = d0 THEN greatest(s, e0) ELSE s END AS s, e FROM placed WHERE k > 1
  UNION ALL
  SELECT doc_id, s, s + length(line) FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY doc_id, place) AS k FROM forms
    WHERE length(form) - length(replace(form, ' ', '')) + 1 >= {passages.WINDOW} OR length(replace(form, ' ', '')) >= {passages.LONG}) WHERE k > 1),
trimmed AS (SELECT g.doc_id, s + length(part) - length(ltrim(part, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s, e FROM (SELECT g.*, substr(text, (s + 1)::BIGINT, (e - s)::BIGINT) AS part FROM gone g JOIN documents USING (doc_id) WHERE s < e) g),
steps AS (SELECT *, s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new FROM trimmed WHERE s < e),
islands AS (SELECT doc_id, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM steps) GROUP BY doc_id, no),
kept AS (SELECT i.doc_id, s, e, substr(text, (1 + coalesce(lag(e) OVER d, 0))::BIGINT, (s - coalesce(lag(e) OVER d, 0))::BIGINT) AS part, CASE WHEN lead(s) OVER d IS NULL THEN substr(text, e + 1) ELSE '' END AS tail FROM islands i JOIN documents USING (doc_id) WINDOW d AS (PARTITION BY i.doc_id ORDER BY s)),
per AS (SELECT doc_id, count(*) AS n, sum(e - s) AS chars, string_agg(s || ':' || e, ',' ORDER BY s) AS spans, string_agg(part || tail, '' ORDER BY s) AS rest FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_removed, coalesce(chars, 0)::BIGINT AS removed_chars, coalesce(spans, '') AS spans, CASE WHEN n > 0 THEN rest ELSE text END AS text
FROM documents LEFT JOIN per USING (doc_id)
"""

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""

_KINDS_SQL = "\nUNION ALL BY NAME\n".join(
    f"SELECT doc_id, '{r.kind}' AS kind, {i} AS no, {r.least if r.group else 1} AS least, "
    + "list_transform(string_split_regex(t, p), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, p), lambda x: length(x)) AS sizes, "
    + f"list_transform(regexp_extract_all(t, p, {r.group}), lambda x: length(x)) AS tested "
    + f"FROM (SELECT doc_id, coalesce(text, '') AS t, '{r.pattern.replace(chr(39), chr(39) * 2)}' AS p FROM documents) WHERE regexp_matches(t, p)"
    for i, r in enumerate(secrets.RULES)
)
OP8_SQL = f"""
WITH hits AS ({_KINDS_SQL}),
hit AS (SELECT doc_id, kind, no, least, unnest(range(1, len(sizes) + 1)) AS i, gaps, sizes, tested FROM hits),
spans AS (
  SELECT doc_id, kind, no, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS s, list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS e
  FROM hit WHERE tested[i] >= least),
per AS (
  SELECT doc_id, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS b, count(*) FILTER (no = 2) AS c,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, no) FILTER (no < 3) AS own,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, no) AS whole
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(whole, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""

_RULE_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
    for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
)


#: Levels that the SQL goes down, more than the tables' paths have; the operator goes as deep as they are.
DEPTH = 8


def _tree_sql() -> str:
    steps, last = [], "leaves"
    for n in range(1, DEPTH + 1):
        steps.append(f"""
branch{n} AS (SELECT host, tree[1:{n - 1}] AS above, tree[{n}] AS child, sum(n) AS pages FROM {last} WHERE len(tree) >= {n} GROUP BY ALL),
wild{n} AS (SELECT host, above FROM branch{n} GROUP BY ALL HAVING count(*) > {url_filter.MANY} AND sum(pages) < {url_filter.FEW} * count(*)),
tree{n} AS (SELECT l.* REPLACE (CASE WHEN w.host IS NOT NULL AND len(tree) >= {n} THEN tree[1:{n - 1}] || ['*'] || tree[{n + 1}:] ELSE tree END AS tree)
  FROM {last} l LEFT JOIN wild{n} w ON l.host = w.host AND l.tree[1:{n - 1}] = w.above)""")
        last = f"tree{n}"
    return ",".join(steps)


_K = url_filter.STRENGTH
OP9_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parsed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT *, CASE {_RULE_CASES} END AS hit FROM parsed),
rows AS (SELECT page_id, host, path, split_part(hit, '|', 1) AS rule, split_part(hit, '|', 2) AS said, list_transform(string_split(regexp_replace(path, '^/', ''), '/'),
    lambda s: regexp_replace(s, '^([0-9]+|[0-9a-f]{{16,}})(\\.|$)', '*\\2')) AS segs FROM ruled),
cutoff AS (SELECT * EXCLUDE segs, segs AS parts FROM rows),
leaves AS (SELECT host, parts, parts AS tree, count(*) AS n, count(*) FILTER (said = 'block') AS n_block, count(*) FILTER (said = 'allow') AS n_allow FROM cutoff GROUP BY ALL),
{_tree_sql()},
named AS (SELECT *, '/' || array_to_string(tree, '/') AS template, '/' || array_to_string(tree[1:len(tree) - 1], '/') AS parent FROM tree{DEPTH}),
total AS (SELECT (sum(n_block) + {_K / 2}) / (sum(n_block) + sum(n_allow) + {_K}) AS base FROM named),
hosts AS (SELECT host, (sum(n_block) + any_value(base) * {_K}) / (sum(n_block) + sum(n_allow) + {_K}) AS host_rate FROM named, total GROUP BY host),
nodes AS (SELECT host, parent, template, sum(n_block) AS n_block, sum(n_allow) AS n_allow FROM named GROUP BY ALL),
rated AS (SELECT *, (n_block + host_rate * {_K}) / (n_block + n_allow + {_K}) AS rate, n_block + n_allow + {_K} AS weight FROM nodes JOIN hosts USING (host)),
steps AS (SELECT *, CASE WHEN rate - lag(rate) OVER s > {url_filter.ERRORS} * sqrt(0.25 / weight + 0.25 / lag(weight) OVER s) THEN 1 ELSE 0 END AS apart
  FROM rated WINDOW s AS (PARTITION BY host, parent ORDER BY rate, template)),
branches AS (SELECT *, sum(apart) OVER (PARTITION BY host, parent ORDER BY rate, template) AS branch FROM steps),
merged AS (SELECT host, parent, branch, (sum(n_block) + any_value(host_rate) * {_K}) / (sum(n_block) + sum(n_allow) + {_K}) AS block_rate FROM branches GROUP BY ALL),
verdicts AS (SELECT DISTINCT b.host, b.template, block_rate FROM branches b JOIN merged m USING (host, parent, branch))
SELECT page_id, r.host, path, CASE WHEN rule <> '' THEN rule END AS rule,
  CASE WHEN said <> '' THEN said WHEN block_rate > 0.5 THEN 'block' ELSE 'allow' END AS verdict, n.template, block_rate
FROM cutoff r JOIN named n ON r.host = n.host AND r.parts = n.parts JOIN verdicts v ON v.host = n.host AND v.template = n.template
"""

_W = mixing.WEIGHTS
OP10_SQL = f"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(map(str, _W))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_W)}) + 1]::BIGINT AS w FROM rows GROUP BY source),
capped AS (SELECT *, {mixing.MAX_EPOCHS} * source_size AS cap, row_number() OVER (ORDER BY {mixing.MAX_EPOCHS} * source_size / w, source NULLS LAST) AS k FROM sources),
levels AS (SELECT *, (SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM capped),
first_fit AS (SELECT k AS k0, words_left AS l0, weight_left AS w0 FROM levels WHERE words_left * w <= cap * weight_left ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN k >= k0 THEN l0::DOUBLE * w / w0 ELSE cap::DOUBLE END AS target FROM levels, first_fit),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
extras AS (SELECT *, least(round(target - whole * source_size)::BIGINT, source_size) AS extra FROM plan),
dealt AS (SELECT r.doc_id, r.source, r.size, source_size, target, whole, greatest(0, least(r.size, extra - coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS part
  FROM rows r JOIN extras e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, whole + (part = size AND size > 0)::BIGINT AS copies,
  CASE WHEN part = size AND size > 0 THEN 0 ELSE part END AS part_words, size * whole + part AS taken
FROM dealt
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op6_passage_dedup": OP6_SQL, "op4_exact_dedup": OP4_SQL, "op8_secret_scan": OP8_SQL, "op9_url_filter": OP9_SQL, "op10_source_mix": OP10_SQL}
