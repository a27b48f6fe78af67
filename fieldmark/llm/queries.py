"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import (
    alignment, byte_bpe, chat, decontam, langid, near_dedup, passage_dedup, quality_rules, repair, secrets, simhash_dedup, substring_dedup, token_counts, token_files,
)
from fieldmark.llm.frames import bounded_batches, new_path, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path)
    return token_files.with_crc32(token_files.read_tokens(spark, path))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(documents(spark, sf_dir), with_text=False)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    return chat.read_back(chat.examples(rows.unionByName(two)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir)))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), near_dedup.Similar(width=3, percent=85))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.repeated_units(documents(spark, sf_dir))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select("doc_id", "n_units", "n_removed", "n_removed_words", spans.alias("removed_spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damage(rows), rows)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(documents(spark, sf_dir))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_id_output, op2_quality_rules, op3_benchmark_decontamination, op4_language_id, op5_chat_formatting, op6_token_counts, op7_byte_bpe, op8_near_dedup,
        op9_secret_scans, op10_substring_dedup, op11_conversation_repair, op12_token_alignment, op13_simhash_dedup,
    )
}


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated whole lines of five words or more."""
    rows = substring_dedup.repeated_units(documents(spark, sf_dir), "line", least_words=5, run_words=0)
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select("doc_id", "n_units", "n_removed", "n_removed_words", spans.alias("removed_spans"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words wherever they start, by all windows and not by units."""
    rows = passage_dedup.repeated_passages(documents(spark, sf_dir))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select("doc_id", "n_words", "n_removed", "n_removed_words", spans.alias("removed_spans"))


#: Queries beside the one that each operator has above.
MORE = {"op10_line_dedup": op10_line_dedup, "op10_passage_dedup": op10_passage_dedup}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS name
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (
  SELECT *, role = 'assistant' OR k = n AS is_example, 4 + length(name) + 2 + length(body) + 8 AS chars FROM turns),
upto AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (is_example) AS BIGINT) AS formatted_chars,
  count(*) FILTER (is_example) AS n_examples
FROM upto GROUP BY conv_id"""

ORACLE_SQL["op10_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
placed AS (
  SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM lines),
units AS (SELECT doc_id, start, start + length(line) AS stop, len(words) AS n, array_to_string(words, ' ') AS unit FROM placed WHERE len(words) >= 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, start) AS place FROM units)
SELECT d.doc_id, count(r.unit) AS n_units, count(r.unit) FILTER (place > 1) AS n_removed,
  CAST(coalesce(sum(n) FILTER (place > 1), 0) AS BIGINT) AS n_removed_words,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start) FILTER (place > 1), '') AS removed_spans
FROM documents d LEFT JOIN ranked r USING (doc_id) GROUP BY d.doc_id"""

ORACLE_SQL["op10_substring_dedup"] = r"""
WITH tiles AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\n.!?,;:]+[.!?,;:]*|[\n.!?,;:]+')) AS tile,
    generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\n.!?,;:]+[.!?,;:]*|[\n.!?,;:]+'), 1) AS k FROM documents),
placed AS (
  SELECT doc_id, k, tile, CAST(sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop,
    regexp_extract_all(translate(tile, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM tiles),
units AS (
  SELECT doc_id, stop - length(tile) AS start, stop, len(words) AS n, array_to_string(words, ' ') AS unit,
    row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, CAST(sum(len(words)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS upto
  FROM placed WHERE len(words) > 0 AND NOT regexp_matches(tile, '^[\n.!?,;:]')),
whole AS (SELECT doc_id, array_agg(unit ORDER BY k) AS all_units FROM units GROUP BY doc_id),
runs AS (
  SELECT a.doc_id, a.start, a.k, b.k AS last, array_to_string(all_units[a.k : b.k], ' ') AS run
  FROM units a ASOF JOIN units b ON a.doc_id = b.doc_id AND a.upto - a.n + 30 <= b.upto JOIN whole w ON w.doc_id = a.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS place FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, last + 1)) AS k FROM ranked WHERE place > 1),
cut AS (SELECT u.*, u.k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM units u JOIN gone USING (doc_id, k)),
spans AS (SELECT doc_id, island, min(start) AS start, max(stop) AS stop, count(*) AS n, sum(n) AS words FROM cut GROUP BY doc_id, island),
by_doc AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_removed, CAST(sum(words) AS BIGINT) AS n_removed_words,
    string_agg(CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start) AS removed_spans FROM spans GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed_words, 0) AS n_removed_words, coalesce(removed_spans, '') AS removed_spans
FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN by_doc USING (doc_id)"""

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, line, {_LOWER.format(x='line')} AS low, regexp_extract_all(line, '{_WORD}') AS words FROM cut WHERE regexp_matches(line, '{_WORD}')),
judged AS (SELECT *, len(words) AS k, CASE
    WHEN length(regexp_replace(line, '[^{quality_rules.SEPARATORS}]', '', 'g')) >= 3 THEN 'navigation'
    WHEN len(words) <= 8 AND NOT list_has_any(list_transform(regexp_extract_all(low, '{_WORD}'), lambda w: list_contains([{', '.join(f"'{w}'" for w in quality_rules.NAV_WORDS)}], w)), [false]) THEN 'navigation'
    WHEN regexp_matches(low, '{quality_rules.BOILERPLATE}') THEN 'boilerplate'
    WHEN length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 0.2 * length(line) THEN 'punctuation'
    WHEN len(words) >= 4 AND NOT contains('{quality_rules.ENDS.replace("'", "''")}', right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1)) AND NOT regexp_matches(line, '[.!?…] ') THEN 'punctuation' END AS fault FROM lines),
by_doc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fault = 'navigation') AS n_navigation, count(*) FILTER (fault = 'boilerplate') AS n_boilerplate,
  count(*) FILTER (fault = 'punctuation') AS n_punctuation, CAST(coalesce(sum(k) FILTER (fault IS NOT NULL), 0) AS BIGINT) AS n_lost_words FROM judged GROUP BY doc_id),
windows AS (SELECT doc_id, i, words[i : i + 2] AS w FROM d, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM often, range(0, 3) r(j) WHERE n > 1 GROUP BY doc_id),
base AS (SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(c.n, 0) AS n_repeat_words, b.* EXCLUDE (doc_id) FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN by_doc b USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(n_lost_words, 0) <= 0.5 * n_words AS kept, coalesce(n_lines, 0) AS n_lines, coalesce(n_navigation, 0) AS n_navigation,
  coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_lost_words, 0) AS n_lost_words FROM base"""

ORACLE_SQL["op8_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_WORD}') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 2))) AS i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

#: Nodes of the edit lattice as (from, insertions, to, price), and what a row does to a state; one step a row of a conversation.
ORACLE_SQL["op11_conversation_repair"] = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS UBIGINT)) AS bytes
  FROM conversations),
kinds AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM damaged),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT contains('.!?', last) THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS adjacent FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (adjacent NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
adding(q, ins, q2, price, added) AS (VALUES ('E', '', 'E', 0, []), ('S', '', 'S', 0, []), ('U', '', 'U', 0, []), ('A', '', 'A', 0, []), ('E', 'I', 'U', 2, ['user:']), ('S', 'I', 'U', 2, ['user:']),
  ('A', 'I', 'U', 2, ['user:']), ('U', 'I', 'A', 2, ['assistant:']), ('E', 'II', 'A', 4, ['user:', 'assistant:']), ('S', 'II', 'A', 4, ['user:', 'assistant:'])),
acting(q, act, initial, q2, price) AS (VALUES ('E', 'K', 's', 'S', 0), ('E', 'K', 'u', 'U', 0), ('S', 'K', 'u', 'U', 0), ('A', 'K', 'u', 'U', 0), ('U', 'K', 'a', 'A', 0),
  ('E', 'R', NULL, 'U', 2), ('S', 'R', NULL, 'U', 2), ('A', 'R', NULL, 'U', 2), ('U', 'R', NULL, 'A', 2), ('E', 'D', NULL, 'E', 3), ('S', 'D', NULL, 'S', 3), ('U', 'D', NULL, 'U', 3), ('A', 'D', NULL, 'A', 3)),
ways AS (
  SELECT conv_id, 1::BIGINT AS k, 'E' AS q, {'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.k + 1, t.q2, min({'cost': w.best.cost + a.price + t.price + CASE WHEN t.act <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || a.ins || t.act,
    'out': list_concat(w.best.out, a.added, CASE t.act WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE t.q2 WHEN 'U' THEN 'user:' ELSE 'assistant:' END || f.text] ELSE [] END)})
  FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k JOIN adding a ON a.q = w.q
    JOIN acting t ON t.q = a.q2 AND (t.initial IS NULL OR t.initial = f.initial) AND (t.act = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, w.k, t.q2),
ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + a.price, 'audit': w.best.audit || a.ins, 'out': list_concat(w.best.out, a.added)}) AS best
  FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = c.n + 1 JOIN adding a ON a.q = w.q AND a.q2 IN ('E', 'A') GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
