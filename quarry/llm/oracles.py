"""SQL for those pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

import unicodedata

from quarry.llm.forms import LOOK_ALIKES, _changing_points, _invisible_points, _ranges
from quarry.llm.rankmix import _CENTRE, _MIDDLE, _TAIL

P5_FOUND = """
WITH ranked AS (
  SELECT qid, source, doc_id, chunk_id, score,
         row_number() OVER (PARTITION BY qid, source, doc_id, chunk_id ORDER BY run_ts DESC NULLS LAST, CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST) AS r
  FROM hits WHERE qid IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL),
best AS (
  SELECT qid, source, doc_id, max(score) AS score FROM ranked
  WHERE r = 1 AND score IS NOT NULL AND NOT isnan(score) GROUP BY qid, source, doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc_id) AS place FROM best),
lists AS (SELECT qid, count(DISTINCT source) AS n FROM best GROUP BY qid)
SELECT p.qid, p.doc_id FROM placed p JOIN lists l ON p.qid = l.qid
WHERE p.place <= 10 GROUP BY p.qid, p.doc_id, l.n HAVING count(*) = l.n
"""

P3_FOUND = """
WITH cur AS (
  SELECT doc_id, text, length(text) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated DESC NULLS LAST, doc_ord DESC NULLS LAST) AS r FROM docs WHERE doc_id IS NOT NULL)
  WHERE r = 1 AND text IS NOT NULL),
pieces AS (
  SELECT *, try_cast(regexp_extract(chunk_id, '[^#]*$') AS BIGINT) AS ordinal
  FROM (SELECT DISTINCT chunk_id, doc_id, "start" AS s, "end" AS e FROM chunks)),
placed AS (
  SELECT *, lag(e) OVER w AS before, row_number() OVER w AS k FROM pieces
  WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal NULLS FIRST, s, e, chunk_id))
SELECT chunk_id FROM placed p LEFT JOIN cur c ON p.doc_id = c.doc_id
WHERE s IS NULL OR e IS NULL OR s < 0 OR e <= s OR e > n OR e - s > 1200
   OR (k > 1 AND coalesce(before - s, -1) NOT BETWEEN 80 AND 160)
   OR (e > 0 AND e < n AND regexp_full_match(substring(text, e, 2), '[\\p{L}\\p{N}]{2}')
       AND regexp_matches(substring(text, s + (e - s + 1) // 2 + 1, e - (s + (e - s + 1) // 2)), '[ \\t\\r\\n]'))
"""


CURRENT = """cur AS (
  SELECT doc_id, text FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated DESC NULLS LAST, doc_ord DESC NULLS LAST) AS r FROM docs WHERE doc_id IS NOT NULL)
  WHERE r = 1 AND text IS NOT NULL)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(text: str) -> str:
    """The consistent form in SQL: invisible characters out, single characters
    by one translation, longer equivalents by replacements, accents composed.
    Only code points below U+3000 and the presentation and width forms."""
    one: dict[str, str] = {}
    more: list[tuple[str, str]] = []
    points = [cp for cp in _changing_points() if cp < 0x3100 or 0xF900 <= cp < 0xFFF0]
    for ch in [*map(chr, points), *LOOK_ALIKES]:
        plain = unicodedata.normalize("NFKC", "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFKD", ch)))
        if len(plain) == 1 and plain != ch:
            one[ch] = plain
        elif len(plain) > 1 and ch in "ﬀﬁﬂﬃﬄ…№½¼¾ⅡⅢⅣⅥⅦⅧⅨⅪⅫⅱⅲⅳⅵⅶⅷⅸⅺⅻ":
            more.append((ch, plain))
    hidden = _ranges(cp for cp in _invisible_points() if cp < 0x10000)
    sql = f"regexp_replace({text}, {_quoted('[' + _plain_class(hidden) + ']')}, '', 'g')"
    for ch, plain in more:
        sql = f"replace({sql}, {_quoted(ch)}, {_quoted(plain)})"
    sql = f"translate({sql}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    return f"nfc_normalize({sql})"


def _plain_class(ranges: str) -> str:
    """A character class of escapes as characters."""
    return ranges.encode("ascii").decode("unicode_escape")


_RUNS = "regexp_extract_all(form, '[\\p{L}\\p{N}]+')"


def _terms() -> str:
    return f"""{CURRENT},
forms AS (SELECT doc_id, text, {_form("text")} AS form FROM cur),
occ AS (SELECT doc_id, strip_accents(lower(unnest({_RUNS}))) AS term, unnest(range(len({_RUNS}))) AS i FROM forms),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term)"""


P9_FOUND = """
WITH spans AS (
  SELECT DISTINCT doc_id, hash(substr(text, i, 240)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS i FROM documents WHERE length(text) >= 240)),
shared AS (SELECT h FROM spans GROUP BY h HAVING count(*) > 1),
kept AS (SELECT doc_id, h FROM spans SEMI JOIN shared USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM kept a JOIN kept b ON a.h = b.h AND a.doc_id < b.doc_id
"""

_SPANS = """
WITH win AS (
  SELECT doc_id, i - 1 AS s, hash(substr(text, i, 240)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS i FROM documents WHERE length(text) >= 240)),
shared AS (SELECT h FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
kept AS (SELECT doc_id, s FROM win SEMI JOIN shared USING (h)),
cuts AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 240 THEN 0 ELSE 1 END AS new FROM kept),
spans AS (
  SELECT doc_id, min(s) AS s, max(s) + 240 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM cuts) GROUP BY doc_id, k)
"""


def _quantile(p: str) -> str:
    """The normal quantile of a column expression in SQL, by its public rational approximation."""

    def ratio(parts: tuple, x: str) -> str:
        up, down = (" + ".join(f"{c!r}::DOUBLE * pow({x}, {k})" for k, c in enumerate(side)) for side in parts)
        return f"(({up}) / ({down}))"

    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(_MIDDLE, f'({r} - 1.6)')} ELSE {ratio(_TAIL, f'({r} - 5)')} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(_CENTRE, f'(0.180625 - {q} * {q})')} ELSE sign({q}) * ({tail}) END"


def _order() -> str:
    best = P5_FOUND.split("placed AS")[0].rstrip().rstrip(",")
    return f"""{best},
pct AS (
  SELECT qid, doc_id, source, count(*) OVER l AS n, (rank() OVER (l ORDER BY score) - 1 + (count(*) OVER (PARTITION BY qid, source, score) + 1) / 2.0) AS pos
  FROM best WINDOW l AS (PARTITION BY qid, source)),
z AS (SELECT qid, doc_id, source, n, {_quantile("(pos::DOUBLE / (n + 1))")} AS z, {_quantile("(0.5::DOUBLE / (n + 1))")} AS low FROM pct),
base AS (SELECT qid, sum(low) AS base, count(*) AS k FROM (SELECT DISTINCT qid, source, low FROM z) GROUP BY qid),
fused AS (SELECT z.qid, doc_id, round((sum(z - low) + max(base)) / max(k), 9) AS fused FROM z JOIN base ON base.qid = z.qid GROUP BY z.qid, doc_id)
SELECT qid, doc_id, CASE WHEN fused = 0 THEN 0.0::DOUBLE ELSE fused END AS fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, doc_id) AS rank FROM fused"""


_GROUPS = """
five AS (SELECT doc_id, hash(term, lead(term) OVER w, lead(term, 2) OVER w, lead(term, 3) OVER w, lead(term, 4) OVER w) AS h, lead(term, 4) OVER w AS last FROM occ WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT DISTINCT doc_id, h FROM five WHERE last IS NOT NULL),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
edge AS (SELECT x, y, c = p.n AND c = q.n AS same FROM met JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE c * 5 >= 4 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y),
label AS (SELECT x, least(x, min(y)) AS group_id FROM reach GROUP BY x),
rep AS (SELECT d.doc_id, least(d.doc_id, min(e.y)) AS rep FROM cur d LEFT JOIN edge e ON e.x = d.doc_id AND e.same GROUP BY d.doc_id),
link AS (SELECT e.x, count(DISTINCT rep) AS links FROM edge e JOIN rep ON rep.doc_id = e.y WHERE NOT e.same GROUP BY e.x)
SELECT cur.doc_id, coalesce(group_id, cur.doc_id) AS group_id, coalesce(links, 0) AS links FROM cur LEFT JOIN label ON label.x = cur.doc_id LEFT JOIN link ON link.x = cur.doc_id"""

P8_QUOTAS = """
WITH goals AS (
  SELECT source, sum(weight) AS weight, max(max_repeats) AS most
  FROM (SELECT DISTINCT source, coalesce(weight, 0) AS weight, coalesce(max_repeats, 1) AS max_repeats FROM mix_targets WHERE source IS NOT NULL) GROUP BY source),
own AS (SELECT g.source, weight, most, coalesce(sum(length(text)), 0)::BIGINT AS own FROM goals g LEFT JOIN documents d ON d.source = g.source GROUP BY ALL),
totals AS (
  SELECT 'all' AS basis, (SELECT sum(length(text)) FROM documents)::DOUBLE AS total
  UNION ALL SELECT 'balanced', coalesce(min(most * own / weight) FILTER (own > 0 AND weight > 0), 0) FROM own)
SELECT basis, source, own, floor(least(round(weight * total, 6), most * own))::BIGINT AS planned, weight * total > most * own AS capped, true AS exact, true AS repeats_kept FROM own CROSS JOIN totals"""

P3_COVER = """
SELECT doc_id, length(text) AS n_chars, 0 AS first, length(text) AS last, true AS longest_kept, true AS overlaps_kept, true AS pieces_needed FROM cur WHERE length(text) > 0"""


def oracle_sql() -> dict[str, str]:
    terms = _terms()
    return {
        "p1_found": f"WITH {terms} SELECT doc_id, tf.term FROM tf JOIN df ON tf.term = df.term WHERE tf >= 3 AND df BETWEEN 2 AND 4 AND length(tf.term) >= 5 AND regexp_full_match(tf.term, '\\p{{L}}+')",
        "p1_scores": f"""WITH {terms}, n AS (SELECT count(*) AS n FROM cur)
SELECT doc_id, tf.term, tf, df, cf::BIGINT AS cf, round(-log2(df / n) + log2(1 - exp(-cf / n)), 6) AS ridf, round(tf * (-log2(df / n) + log2(1 - exp(-cf / n))), 6) AS score FROM tf JOIN df ON tf.term = df.term CROSS JOIN n""",
        "p2_found": f"""WITH {terms}, n AS (SELECT count(*) AS n FROM cur)
SELECT term, 'rare' AS mark FROM df WHERE df < 3 UNION ALL SELECT term, 'common' FROM df CROSS JOIN n WHERE df * 3 > n""",
        "p2_census": f"""WITH {terms}, n AS (SELECT count(*) AS n FROM cur)
SELECT term, cf::BIGINT AS occurrences, df AS records, unnest(CASE WHEN df < 3 AND df * 3 > n THEN ['rare', 'common'] WHEN df < 3 THEN ['rare'] WHEN df * 3 > n THEN ['common'] ELSE [NULL] END) AS mark FROM df CROSS JOIN n""",
        "p3_audit": "SELECT NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS doc_id, 0 AS start, 0 AS \"end\", false AS bad_range, false AS too_long, false AS bad_overlap, false AS torn_word WHERE false",
        "p3_found": P3_FOUND,
        "p3_cover": f"WITH {CURRENT} {P3_COVER}",
        "p4_groups": f"WITH RECURSIVE {terms}, {_GROUPS}",
        "p5_order": _order(),
        "p7_decoded": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents",
        "p8_quotas": P8_QUOTAS,
        "p4_found": f"""WITH {terms},
tri AS (SELECT DISTINCT doc_id, hash(term, lead(term) OVER w, lead(term, 2) OVER w) AS h, lead(term, 2) OVER w AS last FROM occ WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT DISTINCT doc_id, h FROM tri WHERE last IS NOT NULL),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT x AS doc_id_a, y AS doc_id_b FROM met JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y JOIN forms f ON f.doc_id = x JOIN forms g ON g.doc_id = y
WHERE c * 5 >= 3 * (p.n + q.n - c) AND f.form <> g.form""",
        "p5_found": P5_FOUND,
        "p6_found": f"""WITH {CURRENT}, forms AS (SELECT doc_id, text, {_form("text")} AS form FROM cur WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]'))
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id""",
        "p9_found": P9_FOUND,
        "p9_spans": f"{_SPANS} SELECT doc_id, s::INT AS start, e::INT AS \"end\" FROM spans",
        "p9_report": f"""{_SPANS}
SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(k, 0) AS spans, coalesce(c, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0)::DOUBLE / length(text) END AS share
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS k, sum(e - s) AS c FROM spans GROUP BY doc_id) x ON x.doc_id = d.doc_id""",
    }
