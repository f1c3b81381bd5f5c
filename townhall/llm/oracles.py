"""Oracle SQL of the operators that SQL can express."""

from __future__ import annotations

from townhall.llm import quality_rules

# Every position of a text as hexadecimal; positions whose 400 bytes occur again are joined to runs.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT r, unnest(range(1, length(h) // 2 - 398)) AS s FROM d WHERE length(h) >= 800),
 k AS (SELECT p.r, p.s, md5(substring(d.h, 2 * p.s - 1, 800)) AS m FROM p JOIN d USING (r)),
 again AS (SELECT r, s FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
 start AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM again),
 span AS (SELECT r, min(s) AS lo, max(s) + 400 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM start) GROUP BY r, g),
 edge AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS kept_from, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS next_ FROM span),
 cut AS (SELECT e.r, sum(hi - lo) AS n_removed, count(*) AS n_spans,
   string_agg(substring(h, 2 * kept_from - 1, 2 * (lo - kept_from)) || CASE WHEN next_ IS NULL THEN substring(h, 2 * hi - 1) ELSE '' END, '' ORDER BY lo) AS kept FROM edge e JOIN d USING (r) GROUP BY e.r)
SELECT doc_id, length(h) // 2 AS n_bytes, cast(coalesce(n_removed, 0) as bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""


def _either_case(word: str) -> str:
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)


ASSIGN = (
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _matches(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches with their start: the pieces between them and their own lengths are summed up."""
    return f"""SELECT r, {rank} AS k, '{kind}' AS kind, coalesce(sum(g + n) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + g AS s, n, length(part) >= {least} AS ok
  FROM (SELECT r, i, length(gaps[i]) AS g, length(hits[i]) AS n, parts[i] AS part FROM (
    SELECT r, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS parts FROM d), unnest(range(1, len(hits) + 1)) u(i))"""


SECRETS = f"""WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
 m AS (SELECT * FROM ({_matches('assign', 0, ASSIGN, 2, 12)} UNION ALL {_matches('access', 1, 'AKIA[A-Z0-9]+', 0, 18)} UNION ALL {_matches('hex', 2, '[0-9a-f]+', 0, 16)}) WHERE ok),
 f AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
   string_agg(kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint), ',' ORDER BY s, k) AS spans FROM m GROUP BY r)
SELECT doc_id, source, sha256(t) AS blob, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)"""

def _bound(rule: quality_rules.Rule) -> str:
    unit, scale = ("1", 1) if rule.per is None else (rule.per, 100)
    parts = [f"{scale} * {rule.count} {sign} {bound} * {unit}" for sign, bound in ((">=", rule.least), ("<=", rule.most)) if bound is not None]
    return "(" + " AND ".join(parts) + ")"


# Words, lines and windows of every text as lists; windows are rows.
QUALITY_RULES = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
 win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] AS g FROM w, unnest(range(1, len(words) - 3)) u(i)),
 twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
 rep AS (SELECT r, sum(step) AS n FROM (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS step FROM twice) GROUP BY r),
 c AS (SELECT doc_id, cast(len(words) as bigint) AS n_words, cast(length(array_to_string(words, '')) as bigint) AS word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) AS n_symbols,
   len(list_filter(words, lambda x: NOT regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]'))) AS n_bare_words, len(list_filter(words, lambda x: x IN ({", ".join(f"'{x}'" for x in quality_rules.stop_words())}))) AS n_stop_words,
   len(lines) AS n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) AS n_dup_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS n_bullet_lines,
   len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_cut_lines, cast(coalesce(n, 0) as bigint) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
 b AS (SELECT *, NOT ({" AND ".join(map(_bound, quality_rules.BASE))}) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_bound, quality_rules.RULES))} AS kept FROM b"""

# All counts of all groups, zeros included, as exact integers.
SOURCE_AUDIT = """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 lt AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
 lv AS (SELECT lang, count(*) AS v, sum(n) AS total FROM lt GROUP BY lang),
 q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS q FROM lt JOIN lv USING (lang)),
 g AS (SELECT DISTINCT lang, source FROM d),
 gc AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
 cells AS (SELECT g.lang, g.source, lt.term, coalesce(gc.n, 0) AS n FROM g JOIN lt USING (lang) LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = lt.term),
 p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
 pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 every_pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
 own AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 ranked AS (SELECT *, 'pair' AS part FROM every_pair UNION ALL BY NAME SELECT *, 'term' AS part FROM own)
SELECT lang, source, part, item, cast(value AS bigint) AS value, cast(rank AS int) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 10"""

# crc32 from its table, near words from equal strings after a deletion, roots by recursion.
SPELLING = """WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS crc FROM (
   SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) x(i))),
 d AS (SELECT row_number() OVER () AS r, coalesce(cast(doc_id AS varchar), '') AS doc,
   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
 u AS (SELECT r, doc, run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
 b AS (SELECT *, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes FROM u),
 h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, c: xor(a >> 8, crc[(xor(a, c) & 255) + 1])), 4294967295) AS h FROM b, tab),
 m AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
 voc AS (SELECT word, cast(sum(n) AS bigint) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 cut AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS d FROM voc, unnest(range(1, length(word) + 1)) x(i)),
 near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
   UNION SELECT cut.word, voc.word FROM cut JOIN voc ON cut.d = voc.word UNION SELECT voc.word, cut.word FROM cut JOIN voc ON cut.d = voc.word),
 best AS (SELECT near.word, other, v.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS k FROM near JOIN voc v ON v.word = other),
 form AS (SELECT voc.word, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * voc.n THEN other END AS form, CASE WHEN other_n >= 10 * voc.n THEN other_n END AS form_n
   FROM voc LEFT JOIN best ON best.word = voc.word AND k = 1),
 walk AS (SELECT word, word AS stop FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.stop WHERE form.form IS NOT NULL),
 root AS (SELECT walk.word, stop AS root FROM walk JOIN form ON form.word = stop WHERE form.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN root USING (word)"""

ORACLES = {"op5_secrets_ledger": SECRETS, "op8_suffix_dedup": SUFFIX_DEDUP, "op11_source_audit": SOURCE_AUDIT, "op12_spelling": SPELLING, "op13_quality_rules": QUALITY_RULES}
