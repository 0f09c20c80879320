"""DuckDB SQL for the queries that SQL can express."""

#: Escaping, template text and order of turns as chat_format.Template has them.
OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), steps AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(length('[TURN ][/TURN]') + length(regexp_replace(role, '[\\\[\]<>]', '__', 'g')) + length(regexp_replace(text, '[\\\[\]<>]', '__', 'g'))) AS BIGINT) AS formatted_chars,
  bool_and(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END)
    AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM steps GROUP BY conv_id
"""

_UNITS = "km|cm|mm|m|kg|g|mg|lb|oz|l|ml|s|ms|min|h|hz|w|kw|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|dollars?|euros?|cents?|usd|eur|percent|degrees?|%"


def _tagged(text: str) -> str:
    """Slots marked as in decontaminate.tagged; this dialect has no look-behind, so names that follow names take a second pass."""
    for pattern, to in (
        (r"(\p{Nd})[.,](\p{Nd})", r"\1\2"),
        (r"(\p{Nd}+)", r"§n\1"),
        (rf"(§n\p{{Nd}}+) ?({_UNITS})([^\p{{L}}\p{{N}}]|$)", r"\1 §u\2\3"),
        (r"([\p{Ll},;] )(\p{Lu}\p{L}+)", r"\1§a\2"),
        (r"([\p{Ll},;] )(\p{Lu}\p{L}+)", r"\1§a\2"),
        (r"(^|[^\p{L}\p{N}§])(\p{Lu}\p{L}+)", r"\1§s\2"),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}§%]+', ' ', 'g'))"


def _split(source: str, keys: str) -> str:
    """Both readings of a text as lists: raw words and template words."""
    return rf"""SELECT {keys}, kind, string_split(r, ' ') AS raw, string_split(regexp_replace(r, '§([nua])[\p{{L}}\p{{N}}%]*', '§\1', 'g'), ' ') AS words
  FROM (SELECT *, unnest([0, 1]) AS kind, replace(tagged, '§s', CASE kind WHEN 0 THEN '' ELSE '§a' END) AS r FROM {source})"""


#: Windows are joined as text here, without hashes; items without a window are looked for inside whole texts.
OP4 = rf"""
WITH d AS (
  SELECT doc_id, hash(text) AS t, {_tagged('text')} AS tagged FROM documents
), b AS (
  SELECT item_id, {_tagged('text')} AS tagged FROM benchmark
), ds AS ({_split('d', 'doc_id, t')}
), bs AS ({_split('b', 'item_id')}
), dw AS (
  SELECT doc_id, t, kind, i, array_to_string(words[i:i+7], ' ') AS w, raw[i:i+7] AS raw FROM (SELECT *, unnest(range(1, len(words) - 6)) AS i FROM ds)
), bw AS (
  SELECT * FROM (
    SELECT item_id, kind, i, array_to_string(words[i:i+7], ' ') AS w, raw[i:i+7] AS raw, len(list_filter(words[i:i+7], lambda x: NOT starts_with(x, '§'))) AS plain
    FROM (SELECT *, unnest(range(1, len(words) - 6)) AS i FROM bs)
  ) WHERE plain >= 4
), total AS (SELECT item_id, count(DISTINCT i) AS n_windows FROM bw GROUP BY item_id
), met AS (
  SELECT doc_id, t, item_id, kind, dw.i - bw.i AS shift, bw.i AS place, unnest(range(1, 9)) AS k, bw.raw AS br, dw.raw AS dr FROM dw JOIN bw USING (w, kind)
), slots AS MATERIALIZED (
  SELECT doc_id, t, item_id, kind, shift, br[k] AS a, count(DISTINCT dr[k]) AS n FROM met WHERE starts_with(br[k], '§') GROUP BY ALL
), bad AS (SELECT DISTINCT doc_id, t, item_id, kind, shift FROM slots WHERE n > 1
), places AS (
  SELECT doc_id, t, item_id, count(DISTINCT place) AS n FROM met ANTI JOIN bad USING (doc_id, t, item_id, kind, shift) GROUP BY ALL
), values_ AS (
  SELECT doc_id, t, item_id, count(DISTINCT a) AS s FROM slots ANTI JOIN bad USING (doc_id, t, item_id, kind, shift) GROUP BY ALL
), windows_ AS (
  SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_matched, any_value(n_windows) AS n_windows, CAST(max(coalesce(s, 0)) AS BIGINT) AS n_slots
  FROM places LEFT JOIN values_ USING (doc_id, t, item_id) JOIN total USING (item_id) GROUP BY doc_id, item_id HAVING max(n) >= 0.5 * any_value(n_windows)
), rest AS (
  SELECT item_id, regexp_replace(tagged, '§[nuas]', '', 'g') AS plain, len(list_distinct(list_filter(string_split(tagged, ' '), lambda x: regexp_matches(x, '^§[nua]')))) AS n_slots
  FROM b WHERE tagged <> '' AND item_id NOT IN (SELECT item_id FROM total)
), texts AS (SELECT doc_id, regexp_replace(tagged, '§[nuas]', '', 'g') AS plain FROM d)
SELECT * FROM windows_ UNION ALL
SELECT doc_id, item_id, 1, 1, CAST(max(n_slots) AS BIGINT) FROM texts x JOIN rest r
  ON CASE WHEN len(string_split(r.plain, ' ')) >= 4 THEN contains(' ' || x.plain || ' ', ' ' || r.plain || ' ') ELSE x.plain = r.plain END
GROUP BY doc_id, item_id
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents
), occurring AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n_lang FROM occurring GROUP BY ALL HAVING count(DISTINCT rid) >= 10
), langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d
), seen AS (SELECT lang, source, term, count(*) AS n FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (SELECT lang, source, sum(n) AS total FROM seen GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(s.n, 0) + 2) // (CAST(coalesce(t.total, 0) AS HUGEINT) + 2 * l.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n_lang + 2) // (CAST(l.total AS HUGEINT) + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""

_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: CRC-32 of an ASCII text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP12 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS rid FROM (
    SELECT doc_id, lang, sha256({_HEAD} || {_PART.format("text")}) AS leaf,
      CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({_HEAD} || {_PART.format(_LOWER.format("text"))}) END AS claimed FROM documents)
), nodes AS (
  SELECT lang, 0 AS l, pos, leaf AS h FROM d
  UNION ALL
  SELECT lang, l + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM nodes) WHERE c > 1 GROUP BY lang, l, pos // 8
), subroots AS MATERIALIZED (SELECT lang, max(l) AS steps, arg_max(h, l) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes GROUP BY lang
), tops AS (
  SELECT 0 AS l, place AS pos, subroot AS h FROM subroots
  UNION ALL
  SELECT l + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY l, pos // 8
), top AS (SELECT max(l) AS steps, arg_max(h, l) AS root FROM tops
), sides AS MATERIALIZED (
  SELECT rid, n.l AS step, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < d.pos // CAST(8 ** n.l AS BIGINT)), '') AS before, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > d.pos // CAST(8 ** n.l AS BIGINT)), '') AS after
  FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang JOIN nodes n ON n.lang IS NOT DISTINCT FROM d.lang AND n.l < s.steps AND n.pos // 8 = d.pos // CAST(8 ** (n.l + 1) AS BIGINT)
  GROUP BY rid, n.l
  UNION ALL
  SELECT rid, s.steps + t.l, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.place // CAST(8 ** t.l AS BIGINT)), ''), coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.place // CAST(8 ** t.l AS BIGINT)), '')
  FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang JOIN top ON true JOIN tops t ON t.l < top.steps AND t.pos // 8 = s.place // CAST(8 ** (t.l + 1) AS BIGINT)
  GROUP BY rid, s.steps, t.l
), folded AS (
  SELECT rid, 0 AS step, coalesce(claimed, leaf) AS h FROM d
  UNION ALL
  SELECT rid, f.step + 1, sha256(before || h || after) FROM folded f JOIN sides USING (rid, step)
), proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY step) AS proof FROM sides GROUP BY rid
), ends AS (SELECT rid, arg_max(h, step) AS folded_root FROM folded GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang JOIN top ON true JOIN ends USING (rid) LEFT JOIN proofs USING (rid)
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM (SELECT rid, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d)
), frequent AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN frequent f ON l.key = f.key GROUP BY rid
"""

ORACLES = {"op4_decontaminate": OP4, "op8_chat_format": OP8, "op11_source_divergence": OP11, "op12_merkle_manifest": OP12, "op13_line_dedup": OP13}
