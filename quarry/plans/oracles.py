"""The SQL of each registered query, for DuckDB over the same tables."""

from __future__ import annotations

from quarry.functions.text import WHITE_SPACE
from quarry.operators.chunking import SLOTS

MAX_CHARS = 2500
OWN_LISTS = ("dense", "lexical")
SOURCE_WEIGHTS = {"dense": 1.0, "lexical": 3.0, "rerank": 0.5}
WHERE = {"ano": {"$gte": 2005}, "tipo": {"$in": ["lei", "acordao", "parecer"]}}

FILTERS: dict[str, dict] = {
    "filter_eq": {"tipo": "lei"},
    "filter_ne": {"uf": {"$ne": "SP"}},
    "filter_range": {"ano": {"$gt": 2001, "$lte": 2015}},
    "filter_in": {"uf": {"$in": ["SP", "MG", "BA"]}},
    "filter_nin": {"tipo": {"$nin": ["lei", "faq"]}},
    "filter_exists": {"ano": {"$exists": True}},
    "filter_missing": {"tags": {"$exists": False}},
    "filter_contains": {"tags": {"$contains": "ta"}},
    "filter_prefix": {"tipo": {"$startswith": "p"}},
    "filter_suffix": {"tipo": {"$endswith": "a"}},
    "filter_multi": {"tipo": {"$ne": "lei"}, "ano": {"$gte": 2010, "$lt": 2020}},
    "filter_and": {"$and": [{"tipo": {"$in": ["lei", "sumula"]}}, {"uf": "SP"}]},
    "filter_or": {"$or": [{"tipo": "faq"}, {"ano": {"$lt": 2000}}]},
    "filter_mixed_kinds": {"ano": {"$gte": "2000"}},
}

_WS = "||".join(f"chr({ord(ch)})" for ch in WHITE_SPACE)
_MD5_TOKEN = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+')"

CURRENT = """cur AS (
  SELECT doc_id, doc_ord, meta, text AS raw, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated DESC NULLS LAST, doc_ord DESC NULLS LAST) AS r FROM docs WHERE doc_id IS NOT NULL)
  WHERE r = 1 AND text IS NOT NULL)"""

QUERIES = """qs AS (SELECT _id AS qid, max(text) AS text FROM queries WHERE _id IS NOT NULL AND text IS NOT NULL GROUP BY _id)"""
QRELS = """qr AS (
  SELECT "query-id" AS qid, "corpus-id" AS doc_id, max(score) AS rel FROM qrels
  WHERE "query-id" IS NOT NULL AND "corpus-id" IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2)"""
WANTED = """want AS (
  SELECT qid, doc_id, min(pos) AS pos FROM (
    SELECT qid, unnest(ids) AS doc_id, unnest(range(len(ids))) AS pos FROM (
      SELECT "query-id" AS qid, max_by("corpus-ids", len("corpus-ids")) AS ids FROM top_ranked
      WHERE "query-id" IS NOT NULL AND "corpus-ids" IS NOT NULL GROUP BY 1))
  WHERE doc_id IS NOT NULL GROUP BY 1, 2)"""


def _cut(text: str, at: str) -> str:
    window = f"substr({text}, {at} + 1, {MAX_CHARS})"
    last = f"(length(regexp_replace({window}, '[^ ]*$', '')) - 1)"
    return f"CASE WHEN length({text}) - ({at}) <= {MAX_CHARS} THEN length({text}) - ({at}) WHEN {last} < {MAX_CHARS // 2} THEN {MAX_CHARS} ELSE {last} END"


def _spans(source: str) -> str:
    """ch: chunks of src(doc_id, doc_ord, base, part), cut at the last space."""
    return f"""{source},
step(doc_id, doc_ord, base, part, off, size) AS (
  SELECT doc_id, doc_ord, base, part, 0, {_cut("part", "0")} FROM src WHERE length(part) > 0
  UNION ALL
  SELECT doc_id, doc_ord, base, part, off + size, {_cut("part", "off + size")} FROM step WHERE off + size < length(part)),
piece AS (SELECT doc_id, doc_ord, base + off AS off, substr(part, off + 1, size) AS p FROM step),
stripped AS (
  SELECT doc_id, doc_ord, off + length(p) - length(ltrim(p, {_WS})) AS s, trim(p, {_WS}) AS text FROM piece),
ch AS (
  SELECT doc_id, doc_ord, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_ord, s, s + length(text) AS e, text,
         doc_ord * {SLOTS} + row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS slot
  FROM stripped WHERE text <> '')"""


WINDOW = "WITH RECURSIVE " + CURRENT + ",\n" + _spans("src AS (SELECT doc_id, doc_ord, 0 AS base, t AS part FROM cur)")
PARAGRAPH = "WITH RECURSIVE " + CURRENT + ",\n" + _spans(f"""parts AS (SELECT doc_id, doc_ord, unnest(string_split(t, chr(10) || chr(10))) AS part, unnest(range(len(string_split(t, chr(10) || chr(10))))) AS i FROM cur),
placed AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS base FROM parts),
src AS (SELECT doc_id, doc_ord, base, part FROM placed WHERE trim(part, {_WS}) <> '')""")
# paragraphs joined one after the other; what is joined is cut by words
STRUCTURE = "WITH RECURSIVE " + CURRENT + ",\n" + _spans(f"""parts AS (SELECT doc_id, doc_ord, t, unnest(string_split(t, chr(10) || chr(10))) AS part, unnest(range(len(string_split(t, chr(10) || chr(10))))) AS i FROM cur),
placed AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS base FROM parts),
para AS (
  SELECT doc_id, base + length(part) - length(ltrim(part, {_WS})) AS s, base + length(part) - length(ltrim(part, {_WS})) + length(trim(part, {_WS})) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM placed WHERE trim(part, {_WS}) <> ''),
joined(doc_id, k, hs, he, os, oe) AS (
  SELECT doc_id, k, s, e, NULL::INT, NULL::INT FROM para WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k,
    CASE WHEN p.e - hs <= {MAX_CHARS} AND (he - hs < 100 OR p.e - p.s < 100) THEN hs ELSE p.s END, p.e,
    CASE WHEN p.e - hs <= {MAX_CHARS} AND (he - hs < 100 OR p.e - p.s < 100) THEN NULL ELSE hs END,
    CASE WHEN p.e - hs <= {MAX_CHARS} AND (he - hs < 100 OR p.e - p.s < 100) THEN NULL ELSE he END
  FROM joined j JOIN para p ON p.doc_id = j.doc_id AND p.k = j.k + 1),
whole AS (
  SELECT doc_id, os AS s, oe AS e FROM joined WHERE os IS NOT NULL
  UNION ALL SELECT doc_id, arg_max(hs, k), arg_max(he, k) FROM joined GROUP BY doc_id),
src AS (SELECT w.doc_id, doc_ord, s AS base, substr(t, s + 1, e - s) AS part FROM whole w JOIN cur ON cur.doc_id = w.doc_id)""")
DOCUMENT = f"""WITH {CURRENT},
ch AS (SELECT doc_id, 0 AS chunk_ord, length(t) - length(ltrim(t, {_WS})) AS s, length(t) - length(ltrim(t, {_WS})) + length(trim(t, {_WS})) AS e FROM cur WHERE trim(t, {_WS}) <> '')"""
HARD = f"""WITH {CURRENT},
ch AS (SELECT doc_id, i AS chunk_ord, i * {MAX_CHARS} AS s, least((i + 1) * {MAX_CHARS}, length(t)) AS e
       FROM (SELECT doc_id, t, unnest(range((length(t) + {MAX_CHARS - 1}) // {MAX_CHARS})) AS i FROM cur))"""
SPAN = 'SELECT doc_id, chunk_ord, s AS start, e AS "end" FROM ch'

TOKENS = r"""tok AS (SELECT slot, doc_id, strip_accents(lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')))) AS term FROM ch),
tf AS (SELECT slot, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT slot, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS dl FROM ch),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
QTERMS = r"""qt AS (SELECT DISTINCT qid, strip_accents(lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')))) AS term FROM qs)"""


def _bm25(only: str = "") -> str:
    return f"""bm AS (
  SELECT qid, tf.slot, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.8 / (tf + 0.8 * (1 - 0.8 + 0.8 * dl / avgdl))) AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN df ON df.term = tf.term JOIN dl ON dl.slot = tf.slot CROSS JOIN stats {only} GROUP BY ALL)"""


BM = WINDOW + ",\n" + QUERIES + ",\n" + TOKENS + ",\n" + QTERMS + ",\n" + _bm25()


def _top(source: str, k: int, name: str, tie: str = "slot") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, {tie}) AS rank FROM {source}) WHERE rank <= {k})"""


# documents from chunk scores named sc(qid, slot, doc_id, score)
POOL = """best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 6) DESC, slot) AS r FROM sc) WHERE r = 1),
docs_of AS (
  SELECT b.qid, b.doc_id, b.score, b.slot, row_number() OVER (PARTITION BY b.qid ORDER BY round(b.score, 6) DESC, cur.doc_ord) AS rank
  FROM best b JOIN cur ON cur.doc_id = b.doc_id)"""
HITS = """SELECT d.qid, d.rank, d.doc_id, round(d.score, 6) AS score, d.doc_id || '#' || ch.chunk_ord AS chunk_id, ch.s AS start, ch.e AS "end"
FROM docs_of d JOIN ch ON ch.slot = d.slot WHERE d.rank <= 10"""

# the hashing encoder: dimension and sign of a term from its digest
_DIM = "(('0x' || substr(md5(term), 1, 4))::INT % 64)"
_SIGN = "(CASE WHEN ('0x' || substr(md5(term), 5, 1))::INT < 8 THEN 1.0 ELSE -1.0 END)"
VECTORS = f"""cv AS (SELECT slot, {_DIM} AS i, sum({_SIGN} * tf)::DOUBLE AS x FROM tf GROUP BY ALL),
cn AS (SELECT slot, greatest(sqrt(sum(x * x)), 1e-12) AS norm FROM cv GROUP BY slot),
qtok AS (SELECT qid, strip_accents(lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')))) AS term FROM qs),
qv AS (SELECT qid, {_DIM} AS i, sum({_SIGN})::DOUBLE AS x FROM qtok GROUP BY ALL),
qn AS (SELECT qid, greatest(sqrt(sum(x * x)), 1e-12) AS norm FROM qv GROUP BY qid),
dot AS (SELECT qv.qid, cv.slot, sum(qv.x * cv.x) AS dot FROM qv JOIN cv ON qv.i = cv.i GROUP BY ALL),
ds AS (
  SELECT q.qid, ch.slot, ch.doc_id, round(coalesce(dot / qn.norm / cn.norm, 0), 6) AS score
  FROM qs q CROSS JOIN ch LEFT JOIN dot ON dot.qid = q.qid AND dot.slot = ch.slot LEFT JOIN qn ON qn.qid = q.qid LEFT JOIN cn ON cn.slot = ch.slot)"""

LISTS = """counting AS (
  SELECT qid, source, doc_id, chunk_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, source, doc_id, chunk_id ORDER BY run_ts DESC NULLS LAST, CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST) AS r
    FROM hits WHERE qid IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL AND chunk_id IS NOT NULL)
  WHERE r = 1 AND score IS NOT NULL AND NOT isnan(score)),
lists AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM counting)"""
RANKING = LISTS.split(",\nlists AS")[0] + """,
pooled AS (SELECT qid, doc_id, max(round(score, 6)) AS score FROM counting WHERE source = 'lexical' GROUP BY ALL),
ranking AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM pooled),
judged AS (SELECT r.qid, r.doc_id, r.rank, coalesce(qr.rel, 0) AS rel FROM ranking r LEFT JOIN qr ON qr.qid = r.qid AND qr.doc_id = r.doc_id WHERE r.qid IN (SELECT qid FROM qr))"""
EVAL = f"WITH {QRELS},\n{RANKING}"


def _measure(kind: str, k: int) -> str:
    if kind == "ndcg":
        return f"""SELECT i.qid, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0.0 END AS value
FROM (SELECT qid, sum(rel / log2(r + 1.0)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM qr) WHERE r <= {k} GROUP BY qid) i
LEFT JOIN (SELECT qid, sum(rel / log2(rank + 1.0)) AS dcg FROM judged WHERE rank <= {k} GROUP BY qid) d ON d.qid = i.qid"""
    relevant = "(SELECT qid, count(*) FILTER (rel > 0) AS n FROM qr GROUP BY qid) a"
    if kind == "recall":
        return f"SELECT a.qid, CASE WHEN n > 0 THEN coalesce(f, 0)::DOUBLE / n ELSE 0.0 END AS value FROM {relevant} LEFT JOIN (SELECT qid, count(*) AS f FROM judged WHERE rank <= {k} AND rel > 0 GROUP BY qid) j ON j.qid = a.qid"
    if kind == "mrr":
        return f"SELECT a.qid, coalesce(1.0::DOUBLE / f, 0.0) AS value FROM {relevant} LEFT JOIN (SELECT qid, min(rank) AS f FROM judged WHERE rank <= {k} AND rel > 0 GROUP BY qid) j ON j.qid = a.qid"
    return f"""SELECT a.qid, CASE WHEN n > 0 THEN coalesce(p, 0)::DOUBLE / n ELSE 0.0 END AS value FROM {relevant} LEFT JOIN (
  SELECT qid, sum(hits::DOUBLE / rank) AS p FROM (SELECT *, count(*) FILTER (rel > 0) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM judged WHERE rank <= {k}) WHERE rel > 0 GROUP BY qid) j ON j.qid = a.qid"""


# (task, model, score): measures of every stored list
LISTS_MEASURED = f"""WITH {QRELS},
{LISTS.split(",{chr(10)}lists AS")[0]},
pooled AS (SELECT source, qid, doc_id, max(round(score, 6)) AS score FROM counting GROUP BY ALL),
ranking AS (SELECT source, qid, doc_id, row_number() OVER (PARTITION BY source, qid ORDER BY score DESC, doc_id) AS rank FROM pooled),
names AS (SELECT DISTINCT source FROM counting),
asked AS (SELECT source, qid, sum(CASE WHEN r <= 10 THEN rel / log2(r + 1.0) ELSE 0 END) AS idcg, count(*) FILTER (rel > 0) AS relevant
  FROM names CROSS JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM qr) GROUP BY ALL),
got AS (SELECT source, qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1.0) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 100 AND rel > 0) AS found, min(rank) FILTER (rank <= 10 AND rel > 0) AS first
  FROM ranking JOIN qr USING (qid, doc_id) GROUP BY ALL),
each AS (SELECT a.source AS model, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg, CASE WHEN relevant > 0 THEN coalesce(found, 0)::DOUBLE / relevant ELSE 0 END AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr
  FROM asked a LEFT JOIN got g ON g.source = a.source AND g.qid = a.qid),
measured AS (
  SELECT 'ndcg_at_10' AS task, model, round(avg(ndcg), 6) AS score FROM each GROUP BY model UNION ALL
  SELECT 'recall_at_100', model, round(avg(recall), 6) FROM each GROUP BY model UNION ALL
  SELECT 'mrr_at_10', model, round(avg(mrr), 6) FROM each GROUP BY model)"""


def _rounded(sql: str) -> str:
    return f"{EVAL} SELECT qid, round(value, 6) AS value FROM ({sql})"


def _summary(kinds: tuple[tuple[str, int], ...] = tuple((kind, k) for k in (10, 100) for kind in ("ndcg", "recall", "mrr"))) -> str:
    each = [f"SELECT '{kind}_at_{k}' AS metric, count(*) AS queries, round(avg(value), 6) AS value FROM ({_measure(kind, k)}) HAVING count(*) > 0" for kind, k in kinds]
    return EVAL + " " + " UNION ALL ".join(each)


def _json(field: str) -> str:
    return f"json_extract(CASE WHEN json_valid(meta) THEN meta END, '$.{field}')"


def _text(field: str) -> str:
    return f"(CASE WHEN json_type({_json(field)}) = 'VARCHAR' THEN json_extract_string(CASE WHEN json_valid(meta) THEN meta END, '$.{field}') END)"


def _number(field: str) -> str:
    return f"(CASE WHEN json_type({_json(field)}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({_json(field)} AS DOUBLE) END)"


def _there(field: str) -> str:
    return f"coalesce(json_type({_json(field)}) <> 'NULL', false)"


def _no(sql: str) -> str:
    return f"NOT coalesce({sql}, false)"


_WHERE_SQL = {
    "filter_eq": f"{_text('tipo')} = 'lei'",
    "filter_ne": _no(f"{_text('uf')} = 'SP'"),
    "filter_range": f"{_number('ano')} > 2001 AND {_number('ano')} <= 2015",
    "filter_in": f"{_text('uf')} IN ('SP', 'MG', 'BA')",
    "filter_nin": _no(f"{_text('tipo')} IN ('lei', 'faq')"),
    "filter_exists": _there("ano"),
    "filter_missing": "NOT " + _there("tags"),
    "filter_contains": f"contains({_text('tags')}, 'ta')",
    "filter_prefix": f"starts_with({_text('tipo')}, 'p')",
    "filter_suffix": f"ends_with({_text('tipo')}, 'a')",
    "filter_multi": _no(f"{_text('tipo')} = 'lei'") + f" AND {_number('ano')} >= 2010 AND {_number('ano')} < 2020",
    "filter_and": f"{_text('tipo')} IN ('lei', 'sumula') AND {_text('uf')} = 'SP'",
    "filter_or": f"{_text('tipo')} = 'faq' OR {_number('ano')} < 2000",
    "filter_mixed_kinds": f"{_text('ano')} >= '2000'",
}
_ALLOWED = f"SELECT doc_id FROM cur WHERE {_number('ano')} >= 2005 AND {_text('tipo')} IN ('lei', 'acordao', 'parecer')"

_RERANK = WINDOW + ",\n" + QUERIES + ",\n" + WANTED + ",\n" + TOKENS + ",\n" + QTERMS + ",\n" + _bm25() + ",\n" + VECTORS + """,
present AS (SELECT want.qid, want.doc_id, want.pos, ch.slot FROM want JOIN ch ON ch.doc_id = want.doc_id),
lex AS (SELECT p.qid, p.doc_id, p.pos, max(coalesce(bm.score, 0)) AS score FROM present p LEFT JOIN bm ON bm.qid = p.qid AND bm.slot = p.slot GROUP BY ALL),
den AS (SELECT p.qid, p.doc_id, p.pos, max(ds.score) AS score FROM present p JOIN ds ON ds.qid = p.qid AND ds.slot = p.slot GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, pos) AS r FROM lex),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, pos) AS r FROM den),
hyb AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT qid, doc_id, r FROM lr UNION ALL SELECT qid, doc_id, r FROM dr) GROUP BY ALL)"""


def _rerank(source: str) -> str:
    return f"""{_RERANK}
SELECT want.qid, want.doc_id, round(x.score, 6) AS score, row_number() OVER (PARTITION BY want.qid ORDER BY round(x.score, 6) DESC NULLS LAST, want.doc_id) AS rank
FROM want LEFT JOIN {source} x ON x.qid = want.qid AND x.doc_id = want.doc_id"""


def _weights() -> str:
    return "CASE " + " ".join(f"WHEN source = '{s}' THEN {w}::DOUBLE" for s, w in SOURCE_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"


_HYBRID = BM + ",\n" + VECTORS


# ng(qid, slot, doc_id, score): the n-gram reranker's scores of pairs(qid, slot, doc_id)
def _grams(text: str) -> str:
    line = f"array_to_string(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda x: strip_accents(lower(x))), ' ')"
    return f"(SELECT list_distinct(list_transform(range(greatest(1, length(l) - 2)), lambda i: substr(l, i + 1, 3))) FROM (SELECT {line} AS l))"


_NGRAM = f"""qi AS (SELECT qid, qt.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM qt JOIN df ON df.term = qt.term CROSS JOIN stats),
qg AS (SELECT qid, g, len(g) AS many FROM (SELECT qid, {_grams('text')} AS g FROM qs)),
cg AS (SELECT slot, {_grams('text')} AS g FROM ch WHERE slot IN (SELECT slot FROM pairs)),
word AS (SELECT p.qid, p.slot, sum(CASE WHEN tf.slot IS NOT NULL THEN idf ELSE 0 END) / sum(idf) AS share FROM pairs p JOIN qi ON qi.qid = p.qid LEFT JOIN tf ON tf.slot = p.slot AND tf.term = qi.term GROUP BY ALL),
ng AS (
  SELECT p.qid, p.slot, p.doc_id, (coalesce(share, 0) + len(list_intersect(qg.g, cg.g))::DOUBLE / greatest(1, many)) / 2 AS score
  FROM pairs p JOIN qg ON qg.qid = p.qid JOIN cg ON cg.slot = p.slot LEFT JOIN word w ON w.qid = p.qid AND w.slot = p.slot)"""


def _first(order: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS r FROM docs WHERE doc_id IS NOT NULL) WHERE r = 1)"


def _merged(field: str) -> str:
    old, new = (f"CASE WHEN json_valid({a}.meta) THEN {a}.meta END" for a in "on")
    return f"""CASE WHEN json_type(json_extract({new}, '$.{field}')) IS NOT NULL THEN nullif(json_extract_string({new}, '$.{field}'), NULL)
       ELSE json_extract_string({old}, '$.{field}') END AS {field}"""


DELIMITED = f"""
WITH blobs AS (
  SELECT doc_id AS k, 'lost' || chr(10) || '=== texto ===' || chr(10) || text || chr(10) || '=== ===' || chr(10) || coalesce(title, '') || chr(10) || '=== texto ===' || chr(10) || coalesce(norma, '') || chr(10) || '==== fim====' || chr(10) || coalesce(lang, '') AS blob
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT k, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT k, string_split(replace(replace(blob, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM blobs)),
heads AS (SELECT *, starts_with(trim(line, {_WS}), '===') AND ends_with(trim(line, {_WS}), '===') AS head, trim(trim(trim(line, {_WS}), '= '), {_WS}) AS name FROM lines),
seen AS (SELECT *, sum(head::INT) OVER w AS section, count(*) FILTER (head AND name = '') OVER w AS bare FROM heads WINDOW w AS (PARTITION BY k ORDER BY i)),
-- the names before a header without one are as many as different named headers and headers without a name
named AS (SELECT s.*, CASE WHEN name <> '' THEN name ELSE 'doc' || ((SELECT count(DISTINCT name) FROM seen o WHERE o.k = s.k AND o.head AND o.name <> '' AND o.i < s.i) + bare - 1) END AS doc_id FROM seen s WHERE head),
body AS (SELECT k, section, string_agg(line, chr(10) ORDER BY i) AS text FROM seen WHERE NOT head GROUP BY k, section),
docs_ AS (SELECT n.k, n.doc_id, n.section, trim(coalesce(text, ''), {_WS}) AS text, min(n.section) OVER (PARTITION BY n.k, n.doc_id) AS first, row_number() OVER (PARTITION BY n.k, n.doc_id ORDER BY n.section DESC) AS last FROM named n LEFT JOIN body b ON b.k = n.k AND b.section = n.section),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first) - 1 AS doc_ord FROM docs_ WHERE last = 1)
SELECT k, doc_id, doc_ord, length(text) AS n, md5(text) AS text_md5 FROM placed WHERE text <> ''"""


def oracle_sql() -> dict[str, str]:
    ws_class = "[" + WHITE_SPACE.replace("\\", "\\\\") + "]+"
    html = f"trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{ws_class}', ' ', 'g'), ' ')"
    canonical = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    tokens = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"
    line = "replace(text, chr(10), ' ')"
    found = {
        "canonicalize": f"SELECT doc_ord, md5({canonical}) AS text_md5, length({canonical}) AS n FROM docs WHERE text IS NOT NULL",
        "tokenize": f"WITH {CURRENT} SELECT doc_id, i AS pos, strip_accents(lower(tok)) AS term FROM (SELECT doc_id, unnest({tokens.replace('text', 'raw')}) AS tok, unnest(range(len({tokens.replace('text', 'raw')}))) AS i FROM cur)",
        "token_counts": f"SELECT doc_id, len({tokens}) AS n_tokens, len(list_distinct(list_transform({tokens}, lambda x: strip_accents(lower(x))))) AS n_terms FROM documents WHERE text IS NOT NULL",
        "strip_html": f"SELECT doc_id, md5({html}) AS text_md5, length({html}) AS n FROM documents WHERE text IS NOT NULL",
        "doc_char_cap": "SELECT doc_id, length(substr(text, 1, 32000)) AS n, length(text) > 32000 AS cut FROM documents WHERE text IS NOT NULL",
        "hit_preview": f"SELECT DISTINCT chunk_id, CASE WHEN length({line}) > 220 THEN substr({line}, 1, 220) || '...' ELSE {line} END AS preview FROM chunks WHERE text IS NOT NULL",
        "chunk_document": f"{DOCUMENT} {SPAN}",
        "chunk_hard_window": f"{HARD} {SPAN}",
        "chunk_paragraph": f"{PARAGRAPH} {SPAN}",
        "chunk_window": f"{WINDOW} {SPAN}",
        "chunk_structure": f"{STRUCTURE} {SPAN}",
        "chunk_contract": "SELECT * FROM (VALUES ('not_a_substring', 0), ('overlap', 0), ('text_lost', 0), ('too_long', 0)) v(rule, violations)",
        "chunk_gaps": f"{WINDOW} SELECT doc_id, chunk_ord, s - before AS gap FROM (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY chunk_ord) AS before FROM ch) WHERE before IS NOT NULL",
        "resolve_offsets": f"""WITH {CURRENT}, spans AS (SELECT DISTINCT doc_id, start AS s, "end" AS e FROM hits)
SELECT spans.doc_id, s AS start, e AS "end", length(substr(t, s + 1, e - s)) AS n, md5(substr(t, s + 1, e - s)) AS text_md5 FROM spans LEFT JOIN cur ON cur.doc_id = spans.doc_id""",
        "term_freq": f"{WINDOW}, {TOKENS} SELECT slot, term, tf FROM tf",
        "doc_freq": f"{WINDOW}, {TOKENS} SELECT term, df FROM df",
        "corpus_stats": f"{WINDOW}, {TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
        "idf": f"{WINDOW}, {TOKENS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN stats",
        "bm25_postings": f"{BM} SELECT tf.term, tf.slot, tf, dl FROM tf JOIN dl ON dl.slot = tf.slot WHERE tf.term IN (SELECT term FROM qt)",
        "index_stats": f"{WINDOW}, {TOKENS} SELECT (SELECT count(*) FROM cur) AS documents, (SELECT count(*) FROM ch) AS chunks, count(DISTINCT term) AS terms, count(*) AS postings, sum(tf)::BIGINT AS tokens FROM tf",
        "index_documents": f"WITH {CURRENT} SELECT row_number() OVER (ORDER BY doc_ord, doc_id) - 1 AS doc_ord, doc_id FROM cur",
        "index_chunks": f"""{WINDOW}, place AS (SELECT doc_id, row_number() OVER (ORDER BY doc_ord, doc_id) - 1 AS doc_ord FROM cur)
SELECT p.doc_ord * {SLOTS} + chunk_ord AS slot, ch.doc_id || '#' || chunk_ord AS chunk_id, ch.doc_id, p.doc_ord, s AS start, e AS "end" FROM ch JOIN place p ON p.doc_id = ch.doc_id""",
        "index_stored_stats": f"""{WINDOW}, {TOKENS}
SELECT (SELECT count(*) FROM cur) AS documents, (SELECT count(*) FROM ch) AS chunks, count(DISTINCT term) AS terms, count(*) AS postings, 64 AS dim, 'window' AS chunk_mode,
       (SELECT count(*) FROM cur) + (SELECT count(*) FROM ({_ALLOWED})) - 1 AS max_ordinal, (SELECT count(*) FROM ch) AS n_chunks, 0 AS seen FROM tf""",
        "join_chunks_docs": f'WITH {CURRENT} SELECT c.doc_id, chunk_id, start, "end", doc_ord FROM (SELECT DISTINCT chunk_id, doc_id, start, "end" FROM chunks) c JOIN cur ON cur.doc_id = c.doc_id',
        "bm25_scores": f"{BM} SELECT qid, slot, round(score, 6) AS score FROM bm",
        "bm25_topk": f"{BM}, {_top('bm', 100, 'b')} SELECT qid, slot, round(score, 6) AS score, rank FROM b",
        "bm25_topk_padded": f"""{BM}, {_top('bm', 100, 'b')},
have AS (SELECT qs.qid, count(b.slot) AS have FROM qs LEFT JOIN b ON b.qid = qs.qid GROUP BY qs.qid),
lack AS (
  SELECT h.qid, c.slot, have, row_number() OVER (PARTITION BY h.qid ORDER BY c.slot) AS i
  FROM have h CROSS JOIN ch c WHERE have < 100 AND NOT EXISTS (SELECT 1 FROM b WHERE b.qid = h.qid AND b.slot = c.slot))
SELECT qid, slot, round(score, 6) AS score, rank FROM b UNION ALL SELECT qid, slot, 0.0, i + have FROM lack WHERE i + have <= 100""",
        "search_lexical": f"{BM}, {_top('bm', 100, 'sc')}, {POOL} {HITS}",
        "l2_normalize": "WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 3) AS v FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, unnest(range(len(v))) AS i, round(unnest(v) / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12), 6) AS x FROM x",
        "dense_scores": "SELECT q.vec_id AS qid, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0",
        "dense_topk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10",
        "search_dense": f"{_HYBRID}, {_top('ds', 100, 'sc')}, {POOL} {HITS}",
        "rrf_fuse": f"WITH {LISTS} SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY ALL",
        "rrf_weighted": f"WITH {LISTS} SELECT qid, chunk_id, round(sum({_weights()} / (60 + rank)), 9) AS score FROM lists GROUP BY ALL",
        "doc_maxpool": f"""WITH {LISTS}, f AS (SELECT qid, chunk_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY ALL)
SELECT qid, doc_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 6) DESC, chunk_id) AS r FROM f) WHERE r = 1""",
        "search_hybrid": f"""{_HYBRID}, {_top('bm', 100, 'lt')}, {_top('ds', 100, 'dt')},
sc AS (SELECT qid, slot, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, slot, doc_id, rank FROM lt UNION ALL SELECT qid, slot, doc_id, rank FROM dt) GROUP BY ALL), {POOL} {HITS}""",
        "search_chunks": f"""{_HYBRID}, {_top('bm', 10, 'lt')}, {_top('ds', 10, 'dt')},
f AS (SELECT qid, slot, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, slot, rank FROM lt UNION ALL SELECT qid, slot, rank FROM dt) GROUP BY ALL), {_top('f', 10, 'best')}
SELECT qid, rank, doc_id || '#' || chunk_ord AS chunk_id, round(score, 6) AS score, s AS start, e AS "end" FROM best JOIN ch ON ch.slot = best.slot""",
        "retrieve_ranking": f"{BM}, {_top('bm', 100, 'sc')}, {POOL} SELECT qid, doc_id, rank FROM docs_of WHERE rank <= 100",
        "score_documents": f"{_RERANK} SELECT want.qid, want.doc_id, round(x.score, 6) AS score FROM want LEFT JOIN lex x ON x.qid = want.qid AND x.doc_id = want.doc_id",
        "rerank_lexical": _rerank("lex"),
        "rerank_dense": _rerank("den"),
        "rerank_hybrid": _rerank("hyb"),
        "rerank_ngram": f"""{_RERANK}, pairs AS (SELECT qid, slot, doc_id FROM present), {_NGRAM},
best AS (SELECT qid, doc_id, max(score) AS score FROM ng GROUP BY ALL)
SELECT want.qid, want.doc_id, round(x.score, 6) AS score, row_number() OVER (PARTITION BY want.qid ORDER BY round(x.score, 6) DESC NULLS LAST, want.doc_id) AS rank
FROM want LEFT JOIN best x ON x.qid = want.qid AND x.doc_id = want.doc_id""",
        "search_hybrid_rerank": f"""{_HYBRID}, {_top('bm', 100, 'lt')}, {_top('ds', 100, 'dt')},
fu AS (SELECT qid, slot, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, slot, doc_id, rank FROM lt UNION ALL SELECT qid, slot, doc_id, rank FROM dt) GROUP BY ALL),
{_top('fu', 100, 'pairs')}, {_NGRAM}, sc AS (SELECT * FROM ng), {POOL}
SELECT d.qid, d.rank, d.doc_id, round(d.score, 6) AS score, d.doc_id || '#' || ch.chunk_ord AS chunk_id FROM docs_of d JOIN ch ON ch.slot = d.slot WHERE d.rank <= 10""",
        "rerank_unknown_last": f"SELECT qid, count(*) FILTER (score IS NULL) AS unknown, min(rank) FILTER (score IS NULL) AS first_unknown, max(rank) FILTER (score IS NOT NULL) AS last_known FROM ({_rerank('lex')}) GROUP BY qid",
        "filtered_search": WINDOW + ",\n" + QUERIES + ",\n" + TOKENS + ",\n" + QTERMS + ",\n" + _bm25(f"WHERE tf.doc_id IN ({_ALLOWED})") + f",\n{_top('bm', 100, 'sc')}, {POOL} {HITS}",
        "json_filter": "SELECT event_id FROM events WHERE json_type(json_extract(CASE WHEN json_valid(props) THEN props END, '$.k')) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract(CASE WHEN json_valid(props) THEN props END, '$.k') AS DOUBLE) >= 50",
        "task_queries": f"WITH {QUERIES}, {QRELS} SELECT * FROM qs WHERE qid IN (SELECT qid FROM qr)",
        "task_candidates": f"""WITH {QUERIES}, {QRELS},
one AS (SELECT "query-id" AS qid, max_by("corpus-ids", len("corpus-ids")) AS ids FROM top_ranked WHERE "query-id" IS NOT NULL AND "corpus-ids" IS NOT NULL GROUP BY 1),
each AS (SELECT qid, unnest(ids) AS doc_id, unnest(range(len(ids))) AS pos FROM one)
SELECT qid, pos, doc_id FROM each WHERE doc_id IS NOT NULL AND qid IN (SELECT qid FROM qs) AND qid IN (SELECT qid FROM qr)""",
        "eval_ndcg": _rounded(_measure("ndcg", 10)),
        "eval_recall": _rounded(_measure("recall", 100)),
        "eval_mrr": _rounded(_measure("mrr", 10)),
        "eval_map": _rounded(_measure("map", 1000)),
        "eval_summary": _summary(),
        "eval_reranking": _summary((("map", 1000), ("ndcg", 10), ("mrr", 10))),
        "task_stats": f"""WITH {QUERIES}, {QRELS},
one AS (SELECT "query-id" AS qid, max_by("corpus-ids", len("corpus-ids")) AS ids FROM top_ranked WHERE "query-id" IS NOT NULL AND "corpus-ids" IS NOT NULL GROUP BY 1),
j AS (SELECT qid, count(*) AS judged, count(*) FILTER (rel > 0) AS relevant FROM qr GROUP BY qid)
SELECT count(*) AS queries, round(avg(judged), 6) AS judged, round(avg(relevant), 6) AS relevant, round(avg(coalesce(len(list_filter(ids, lambda x: x IS NOT NULL)), 0)), 6) AS candidates
FROM qs JOIN j ON j.qid = qs.qid LEFT JOIN one ON one.qid = qs.qid""",
        "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
        "leaderboard_pct": f"""{LISTS_MEASURED},
ours AS (SELECT task, max(score) AS best, arg_min(model, (-score, model)) AS mode FROM measured WHERE model IN {OWN_LISTS} GROUP BY task)
SELECT m.task, best, mode, max(score) AS best_other, list_sort(list(score))[count(*) // 2 + 1] AS median, count(*) AS models, round(100.0::DOUBLE * count(*) FILTER (score < best) / count(*), 6) AS below
FROM measured m JOIN ours o ON o.task = m.task WHERE model NOT IN {OWN_LISTS} GROUP BY m.task, best, mode""",
        "best_experiments": f"{LISTS_MEASURED} SELECT task, arg_min(model, (-score, model)) AS experiment, max(score) AS score FROM measured GROUP BY task",
        "source_delimited": DELIMITED,
        "source_files": "SELECT uf, sum(length(t) + 1)::BIGINT AS chars, count(*) AS lines FROM (SELECT coalesce(uf, 'none') AS uf, regexp_replace(title, '[\\r\\n]', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL AND title IS NOT NULL) GROUP BY uf",
        "task_judged": f"""WITH {QUERIES}, {QRELS} SELECT qid, md5(text) AS text_md5 FROM qs WHERE qid IN (SELECT qid FROM qr)
AND qid IN (SELECT "query-id" FROM (SELECT "query-id", unnest("corpus-ids") AS doc_id FROM top_ranked) WHERE doc_id IS NOT NULL)""",
        "task_csv_docs": f"WITH {CURRENT}, x AS (SELECT doc_id, {html.replace('text', 'raw')} AS t FROM cur) SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM x WHERE t <> ''",
        "task_csv_qrels": f"WITH {QUERIES}, {QRELS} SELECT qid, doc_id, rel FROM qr WHERE qid IN (SELECT qid FROM qs WHERE trim(text, {_WS}) <> '')",
        "task_json_docs": f"WITH {CURRENT} SELECT doc_id, doc_id AS title, md5(substr(trim(raw, {_WS}), 1, 500)) AS text_md5 FROM cur WHERE trim(raw, {_WS}) <> ''",
        "task_json_qrels": f"WITH {QUERIES}, {QRELS}, {CURRENT} SELECT qid, doc_id, CASE WHEN rel > 1 THEN 2 ELSE 1 END AS rel FROM qr WHERE qid IN (SELECT qid FROM qs WHERE trim(text, {_WS}) <> '') AND doc_id IN (SELECT doc_id FROM cur WHERE trim(raw, {_WS}) <> '')",
        "stream_ingest": f"SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {canonical} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY doc_ord DESC) AS r FROM docs WHERE doc_id IS NOT NULL AND text IS NOT NULL) WHERE r = 1",
        "assign_metadata": f"WITH {CURRENT} SELECT doc_id, CASE WHEN {_text('tipo')} = 'lei' THEN '{{\"n\":' || length(raw) || '}}' ELSE '{{\"n\": 0}}' END AS meta FROM cur",
        "upsert_docs": "SELECT doc_id, doc_ord, length(text) AS n_chars, md5(text) AS text_md5 FROM " + _first("doc_ord DESC"),
        "delete_docs": f"WITH {CURRENT} SELECT doc_id, doc_ord FROM cur WHERE {_no(_number('ano') + ' < 2005')}",
        "update_metadata": f"SELECT o.doc_id, {', '.join(_merged(f) for f in ('ano', 'tipo', 'uf', 'tags'))} FROM {_first('doc_ord')} o JOIN {_first('doc_ord DESC')} n ON o.doc_id = n.doc_id",
    }
    found["index_search"] = found["hits_json"] = found["search_lexical"]
    return found | {name: f"WITH {CURRENT} SELECT doc_id FROM cur WHERE {_WHERE_SQL[name]}" for name in FILTERS}
