"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from docloom.llm.decontaminate import WINDOW, needed
from docloom.llm.secret_scan import RULES
from docloom.llm.suffix_dedup import LEAST


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _run(length: int) -> int:
    """Equal words without a gap that any overlap of a window of `length` words has: the replaced ones part it."""
    equal, parts = needed(length), length - needed(length) + 1
    return -(-equal // parts)


# Overlaps without masks: places that share the shortest unbroken run, compared word by word. The empty words stand beside a document's own.
_CASES = lambda f: "CASE l " + " ".join(f"WHEN {n} THEN {f(n)}" for n in range(1, WINDOW + 1)) + " END"
_PAD = max(n - needed(n) for n in range(1, WINDOW + 1))

DECONTAMINATION = f"""
WITH d AS (SELECT DISTINCT doc_id, text, {_words("text")} AS own FROM documents),
e AS (SELECT row_number() OVER () AS n, doc_id, text, list_concat(list_concat({["" for _ in range(_PAD)]}, own), {["" for _ in range(_PAD)]}) AS w FROM d),
i AS (SELECT DISTINCT item_id, {_words("text")} AS w FROM benchmark),
j AS (SELECT row_number() OVER () AS k, item_id, w, least(len(w), {WINDOW}) AS l FROM i WHERE len(w) > 0),
t AS (SELECT k, item_id, w, l, {_CASES(_run)} AS g, {_CASES(needed)} AS needed FROM j),
ig AS (SELECT k, g, p, array_to_string(w[p + 1 : p + g], ' ') AS run FROM (SELECT k, g, w, unnest(range(0, len(w) - g + 1)) AS p FROM t)),
dg AS (SELECT n, g, p, array_to_string(w[p + 1 : p + g], ' ') AS run FROM (
  SELECT n, w, g, unnest(range(0, greatest(0, len(w) - g + 1))) AS p FROM e, (SELECT DISTINCT g FROM t))),
a AS (SELECT DISTINCT n, k, dg.p - ig.p AS shift FROM dg JOIN ig USING (g, run)),
s AS (SELECT n, k, shift, unnest(range(0, len(w) - l + 1)) AS s FROM a JOIN t USING (k)),
v AS (SELECT doc_id, text, item_id, l, needed, shift + s - {_PAD} AS begins,
  len(list_filter(range(1, l + 1), lambda q: shift + s + q >= 1 AND e.w[shift + s + q] = t.w[s + q])) AS equal
  FROM s JOIN e USING (n) JOIN t USING (k) WHERE shift + s + l >= 1 AND shift + s < len(e.w)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY equal DESC, l DESC, greatest(begins, 0)) AS turn FROM v WHERE equal >= needed)
SELECT doc_id, item_id, CAST(greatest(begins, 0) AS INTEGER) AS start_word, CAST(l AS INTEGER) AS n_words, CAST(equal AS INTEGER) AS n_equal
FROM r WHERE turn = 1
"""

_SAID = "\\### Assistant: </turn> ok"
# A backslash goes before each backslash, each place where ### begins, and each </turn>.
_ESCAPES = r"""(len(regexp_extract_all({0}, '\\')) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0)
  + len(regexp_extract_all({0}, '</turn>')))"""

CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
s AS (SELECT *, length(role) + {_ESCAPES.format("role")} + len(regexp_extract_all(role, ':')) + length(text) + {_ESCAPES.format("text")} + 14 AS size FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def _secrets() -> str:
    parts = []
    for turn, rule in enumerate(RULES):
        pattern, needs = rule.pattern.replace("'", "''"), rule.needs.replace("'", "''")
        parts.append(f"""
    SELECT n, '{rule.kind}' AS kind, {turn} AS turn, {rule.least} AS least, string_split_regex(text, '{pattern}') AS gaps,
      regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {rule.part}) AS part
    FROM d WHERE regexp_matches(text, '{needs}')""")
    counts = ", ".join(f"count(*) FILTER (f.kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT n, kind, turn, least, unnest(range(1, len(found) + 1)) AS k, gaps, found, part FROM m),
x AS (SELECT n, kind, turn, least, k, length(gaps[k]) AS gap, length(found[k]) AS size, length(part[k]) AS long FROM u),
y AS (SELECT *, sum(gap + size) OVER (PARTITION BY n, turn ORDER BY k) AS stop FROM x),
f AS (SELECT n, kind, turn, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM y WHERE long >= least),
g AS (SELECT d.n, any_value(d.doc_id) AS doc_id, {counts},
  coalesce(string_agg(f.kind || ':' || f.start || ':' || f.stop, ',' ORDER BY f.start, f.turn), '') AS spans
  FROM d LEFT JOIN f ON f.n = d.n GROUP BY d.n)
SELECT doc_id, {", ".join(f"n_{r.kind}" for r in RULES)}, sha256(spans) AS base_sha256, spans FROM g
"""


SECRETS = _secrets()

SUFFIX_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT n, doc_id, a, substr(h, 2 * a + 1, {2 * (LEAST + 99)}) AS s FROM (
  SELECT n, doc_id, h, unnest(range(0, length(h) // 2 - {LEAST - 1}, 100)) AS a FROM d WHERE length(h) >= {2 * LEAST})),
w AS MATERIALIZED (SELECT n, doc_id, a + q AS p, substr(s, 2 * q + 1, {2 * LEAST}) AS s FROM (
  SELECT n, doc_id, a, s, unnest(range(0, least(100, length(s) // 2 - {LEAST - 1}))) AS q FROM b)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING max(doc_id) > min(doc_id)),
g AS (SELECT n, p, coalesce(p > lag(p) OVER (PARTITION BY n ORDER BY p) + {LEAST}, true) AS new FROM w JOIN m USING (s) WHERE first < doc_id),
i AS (SELECT n, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY n ORDER BY p) AS turn FROM g),
r AS (SELECT n, min(p) AS a, max(p) + {LEAST} AS b FROM i GROUP BY n, turn),
k AS (SELECT n, a, b, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS past FROM r),
j AS (SELECT n, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS gone, max(b) AS last, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) AS kept
  FROM k JOIN d USING (n) GROUP BY n)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN j USING (n)
"""

FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS fails
  FROM w LEFT JOIN m USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x)
  JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
  CAST(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS BIGINT) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
e AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN fails & (bit | coalesce(before, 0)) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0) <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0) = 0 THEN n_good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0) = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM e
"""
