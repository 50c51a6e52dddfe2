"""ANSI SQL (DuckDB dialect) equivalents of the catalogue queries, over the raw test tables.

Each string is self-contained; common CTEs are composed here in Python.  DuckDB's RE2
has no back-references: ``tokenize`` cuts runs of other characters where the character
changes, and the keyword queries use the letter and digit classes only (another token is
never a keyword, as its tag is punctuation).
"""

from __future__ import annotations

# The values the results depend on, written out here and not taken from the code under test.
SEARCH_CATEGORY = "src3"
SEARCH_KEYWORDS = ("der", "les", "hotel")
FIRST_N = 200
LEXICON = (
    ("It", "PRP"), ("it", "PRP"), ("Le", "DT"), ("le", "DT"), ("La", "DT"), ("la", "DT"),
    ("les", "DT"), ("des", "DT"), ("de", "IN"), ("Der", "DT"), ("der", "DT"), ("die", "DT"),
    ("und", "CC"), ("el", "DT"), ("en", "IN"), ("y", "CC"), ("only", "JJ"), ("early", "JJ"),
)
CONTEXT_LEXICON = (
    ("la", "DT", 100), ("la", "PRP", 900), ("le", "DT", 100), ("le", "PRP", 900), ("les", "DT", 100), ("les", "PRP", 900),
    ("que", "IN", 300), ("que", "PRP", 300), ("en", "IN", 200), ("en", "PRP", 700), ("die", "DT", 100), ("die", "VB", 1200),
    ("der", "DT", 100), ("der", "PRP", 1100), ("that", "IN", 400), ("that", "DT", 400), ("thing", "NN", 100), ("thing", "VB", 1500),
    ("in", "IN", 0), ("in", "RP", 1500), ("only", "JJ", 500), ("only", "RB", 300), ("and", "CC", 0), ("the", "DT", 0),
    ("has", "VBZ", 100), ("un", "DT", 200), ("un", "CD", 900), ("des", "DT", 300), ("des", "IN", 500), ("con", "IN", 100),
    ("con", "NN", 1200), ("de", "IN", 0), ("und", "CC", 0), ("y", "CC", 0), ("to", "IN", 200), ("to", "RP", 600),
    ("on", "IN", 300), ("on", "RP", 500), ("on", "PRP", 800), ("el", "DT", 50), ("est", "VBZ", 300), ("est", "NN", 600),
)
RULE_TAGS = (".", "CD", "NN", "NNP", "RB", "VBD", "VBG")
DEFAULT_CATEGORY_ORDER = ("health", "technology", "travel", "finance")
DEFAULT_DICTIONARY = (
    ("health", ("medical", "health", "fitness", "wellness", "diet")),
    ("technology", ("computer", "software", "hardware", "digital", "tech")),
    ("travel", ("travel", "vacation", "tourism", "hotel", "flight")),
    ("finance", ("money", "bank", "investment", "stock", "finance")),
)
NEWS_LABELS = ("World", "Sports", "Business", "Sci/Tech")
RELEVANT_TAGS = (
    "NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ",
)
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "about", "as",
    "like", "through", "over", "before", "between", "after", "since", "without", "under", "within", "along",
    "following", "across", "behind", "beyond", "plus", "except", "up", "down", "from", "into", "out", "off",
    "above", "below", "near", "far", "this", "that", "these", "those", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may",
    "might", "must", "can", "could",
)


def _strs(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOPS = "(" + _strs(dict.fromkeys(STOP_WORDS)) + ")"
TAGS = "(" + _strs(RELEVANT_TAGS) + ")"
CATEGORY_NAMES = "[" + _strs(DEFAULT_CATEGORY_ORDER) + "]"
LABEL_NAMES = "[" + _strs(NEWS_LABELS) + "]"
SEARCH_LIST = "[" + _strs(SEARCH_KEYWORDS) + "]"
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"^{WS}+|{WS}+$"
LABEL_PAT = rf"(?s)^__label__([\p{{L}}\p{{N}}_]+){WS}+(.*)$"

ANY_LABEL = rf"(?s)^__label__(\S+?){WS}+(.*)$"


def _rule_tag(t: str) -> str:
    return (rf"CASE WHEN NOT regexp_matches({t}, '[\p{{L}}\p{{Nd}}]') THEN '.' "
            rf"WHEN regexp_matches({t}, '^\p{{Nd}}+$') THEN 'CD' "
            f"WHEN suffix({t}, 'ing') THEN 'VBG' WHEN suffix({t}, 'ed') THEN 'VBD' "
            f"WHEN suffix({t}, 'ly') THEN 'RB' "
            rf"WHEN regexp_matches({t}, '^\p{{Lu}}') THEN 'NNP' ELSE 'NN' END")


def _keyword_ctes(lexicon: bool = False, large: bool = False) -> str:
    if lexicon:
        values = ", ".join(f"({_strs([a])}, {_strs([b])})" for a, b in LEXICON)
        more = "CASE WHEN suffix(k.t, 'en') THEN 'RB' END, " if large else ""
        tag = f"coalesce(lx.tag, {more}{_rule_tag('k.t')})"
        cand = (f"lex(token, tag) AS (VALUES {values}),\n"
                f"kw_cand AS (SELECT k.doc_id, lower(k.t) AS keyword FROM kw_tok k "
                f"LEFT JOIN lex lx ON lx.token = k.t WHERE {tag} IN {TAGS} AND lower(k.t) NOT IN {STOPS}),\n")
    else:
        cand = (f"kw_cand AS (SELECT doc_id, lower(t) AS keyword FROM kw_tok "
                f"WHERE {_rule_tag('t')} IN {TAGS} AND lower(t) NOT IN {STOPS}),\n")
    return (
        r"kw_tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+|\p{Nd}+')) AS t FROM documents),"
        "\n" + cand +
        "kw_counts AS (SELECT doc_id, keyword, count(*) AS n FROM kw_cand GROUP BY doc_id, keyword),\n"
        "kw_ranked AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS rn "
        "FROM kw_counts),\n"
        "kw AS (SELECT d.doc_id, coalesce(string_agg(r.keyword, ',' ORDER BY r.rn), '') AS keywords "
        "FROM documents d LEFT JOIN kw_ranked r ON r.doc_id = d.doc_id AND r.rn <= 10 GROUP BY d.doc_id),\n"
        "web AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages),\n"
        "kpages AS (SELECT d.doc_id, w.url, w.title, d.text AS content, "
        "d.source AS category, d.lang AS author, NULL::VARCHAR AS publishedAt, kw.keywords "
        "FROM documents d JOIN kw USING (doc_id) "
        "LEFT JOIN web w ON w.page_id = d.doc_id % (SELECT count(*) FROM pages))"
    )


# Tokens of all classes in text order.
TOKENS = (r"flatten(list_transform(regexp_extract_all(text, '\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}\x09-\x0D ]+'), "
          r"lambda x: CASE WHEN regexp_matches(x, '^[\p{L}\p{Nd}]') THEN [x] ELSE string_split(list_reduce("
          r"string_split(x, ''), lambda a, c: a || CASE WHEN right(a, 1) = c THEN '' ELSE chr(1) END || c), "
          r"chr(1)) END))")


def _context_keywords() -> str:
    """Transitions counted between tokens of one tag; the search over runs of ambiguous tokens, a token at
    a time; the ten most frequent relevant tokens."""
    words = ", ".join(f"({_strs([w])}, {_strs([t])}, {c})" for w, t, c in CONTEXT_LEXICON)
    rules = ", ".join(f"({_strs([t])})" for t in RULE_TAGS)
    return (
        f"WITH RECURSIVE lex(token, tag, cost) AS (VALUES {words}), rules(tag) AS (VALUES {rules}),\n"
        f"tok AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {TOKENS} AS l FROM documents)),\n"
        "cand AS (SELECT doc_id, i, t, tag, cost FROM tok JOIN lex ON lex.token = tok.t UNION ALL "
        f"SELECT doc_id, i, t, {_rule_tag('t')}, 0 FROM tok WHERE t NOT IN (SELECT token FROM lex)),\n"
        "kind AS (SELECT doc_id, i, t, count(*) AS tags, min(tag) AS tag FROM cand GROUP BY doc_id, i, t),\n"
        "line AS (SELECT doc_id, i, tags, tag FROM kind UNION ALL SELECT doc_id, 0, 1, '^' FROM kind GROUP BY doc_id "
        "UNION ALL SELECT doc_id, max(i) + 1, 1, '$' FROM kind GROUP BY doc_id),\n"
        "pair AS (SELECT a.tag AS before, b.tag AS tag, count(*) AS n FROM line a JOIN line b ON b.doc_id = a.doc_id AND b.i = a.i + 1 "
        "WHERE a.tags = 1 AND b.tags = 1 GROUP BY a.tag, b.tag),\n"
        "follow AS (SELECT count(*) + 1 AS k FROM (SELECT tag FROM lex UNION SELECT tag FROM rules)),\n"
        "move AS (SELECT before, tag, round(-1000 * ln((n + 1) / (sum(n) OVER (PARTITION BY before) + k)))::BIGINT AS cost "
        "FROM pair, follow),\n"
        "many AS (SELECT c.doc_id, c.i, c.tag, c.cost FROM cand c JOIN kind k USING (doc_id, i) WHERE k.tags > 1),\n"
        "run AS (SELECT doc_id, min(i) AS s, max(i) AS e FROM (SELECT doc_id, i, i - row_number() OVER "
        "(PARTITION BY doc_id ORDER BY i) AS r FROM kind WHERE tags > 1) GROUP BY doc_id, r),\n"
        "path AS (SELECT run.doc_id, s - 1 AS i, line.tag, {'c': 0::BIGINT, 'p': []::VARCHAR[]} AS best "
        "FROM run JOIN line ON line.doc_id = run.doc_id AND line.i = s - 1\n"
        "UNION ALL SELECT doc_id, i, tag, min(best) FROM (SELECT m.doc_id, m.i, m.tag, "
        "{'c': p.best.c + coalesce(move.cost, 20000) + m.cost, 'p': list_append(p.best.p, m.tag)} AS best "
        "FROM path p JOIN many m ON m.doc_id = p.doc_id AND m.i = p.i + 1 "
        "LEFT JOIN move ON move.before = p.tag AND move.tag = m.tag) GROUP BY doc_id, i, tag),\n"
        "done AS (SELECT run.doc_id, s, min({'c': p.best.c + coalesce(move.cost, 20000), 'p': p.best.p}) AS best "
        "FROM run JOIN path p ON p.doc_id = run.doc_id AND p.i = run.e JOIN line ON line.doc_id = run.doc_id AND line.i = run.e + 1 "
        "LEFT JOIN move ON move.before = p.tag AND move.tag = line.tag GROUP BY run.doc_id, s),\n"
        "chosen AS (SELECT doc_id, i, tag FROM kind WHERE tags = 1 UNION ALL "
        "SELECT doc_id, s + generate_subscripts(best.p, 1) - 1, unnest(best.p) FROM done),\n"
        "kw AS (SELECT doc_id, lower(tok.t) AS keyword, count(*) AS n FROM chosen JOIN tok USING (doc_id, i) "
        f"WHERE tag IN {TAGS} AND lower(tok.t) NOT IN {STOPS} GROUP BY 1, 2),\n"
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS rn FROM kw)\n"
        "SELECT d.doc_id, coalesce(string_agg(r.keyword, ',' ORDER BY r.rn), '') AS keywords FROM documents d "
        "LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.rn <= 10 GROUP BY d.doc_id"
    )


HIT_COLS = "doc_id, url, title, category, author, publishedAt, keywords"
KW_MATCH = f"list_has_any(string_split(keywords, ','), {SEARCH_LIST})"

def _vector_ctes(cats: str) -> str:
    """CTEs of the vectors and similarities, with ``cats`` (category, ord, keyword) as given."""
    return (
        r"""vt AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[\d\.:,"''\(\)\[\]|/?!;]+', '', 'g'), '[ \t\n\r\f]+'), lambda x: x <> '')) AS token FROM documents),"""
        "\ntf AS (SELECT doc_id, token, count(*) AS n FROM vt GROUP BY doc_id, token),\n"
        f"freq AS (SELECT token, sum(n) AS n FROM tf WHERE token NOT IN {STOPS} GROUP BY token),\n"
        "vocab AS (SELECT f.token, e.embedding AS vector, e.label FROM "
        "(SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS vec_id FROM freq) f "
        "JOIN embeddings e USING (vec_id)),\n"
        f"cats AS ({cats}),\n"
        "dv_el AS (SELECT t.doc_id, t.n, v.vector FROM tf t JOIN vocab v USING (token)),\n"
        "dv_known AS (SELECT doc_id, sum(n) AS n_known FROM dv_el GROUP BY doc_id),\n"
        "dv_dim AS (SELECT doc_id, i - 1 AS dim, sum(n * x::DOUBLE) AS s FROM "
        "(SELECT doc_id, n, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM dv_el) GROUP BY doc_id, i),\n"
        "dv AS (SELECT m.doc_id, m.dim, m.s / k.n_known AS v FROM dv_dim m JOIN dv_known k USING (doc_id)),\n"
        "cv AS (SELECT category, ord, i - 1 AS dim, avg(x::DOUBLE) AS value FROM "
        "(SELECT c.category, c.ord, unnest(v.vector) AS x, generate_subscripts(v.vector, 1) AS i "
        "FROM cats c JOIN vocab v ON v.token = c.keyword) GROUP BY category, ord, i),\n"
        "dots AS (SELECT dv.doc_id, cv.category, cv.ord, sum(dv.v * cv.value) AS dot FROM dv JOIN cv USING (dim) "
        "GROUP BY dv.doc_id, cv.category, cv.ord),\n"
        "dn AS (SELECT doc_id, sqrt(sum(v * v)) AS nd FROM dv GROUP BY doc_id),\n"
        "cn AS (SELECT category, sqrt(sum(value * value)) AS nc FROM cv GROUP BY category),\n"
        "sims AS (SELECT d.doc_id, c.category, c.ord, "
        "CASE WHEN dn.nd * cn.nc = 0 OR dn.nd IS NULL THEN NULL ELSE dots.dot / (dn.nd * cn.nc) END AS similarity "
        "FROM documents d CROSS JOIN (SELECT DISTINCT category, ord FROM cv) c "
        "JOIN cn ON cn.category = c.category LEFT JOIN dn ON dn.doc_id = d.doc_id "
        "LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.category = c.category),\n"
        "best AS (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, ord) AS rn "
        "FROM sims WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND similarity > -1),\n"
        "classified AS (SELECT d.doc_id, coalesce(b.category, 'unknown') AS category FROM documents d "
        "LEFT JOIN best b ON b.doc_id = d.doc_id AND b.rn = 1)"
    )


LABEL_CATS = (f"SELECT {CATEGORY_NAMES}[label + 1] AS category, label AS ord, token AS keyword "
              f"FROM vocab WHERE label BETWEEN 0 AND {len(DEFAULT_CATEGORY_ORDER) - 1}")
DICTIONARY_CATS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {i}, '{w}')" for i, (c, words) in enumerate(DEFAULT_DICTIONARY) for w in words
) + ") AS t(category, ord, keyword)"
VECTOR_CTES = _vector_ctes(LABEL_CATS)

LABEL_CTES = (
    "ex AS (SELECT d.doc_id, l.quality * 2 + l.toxic AS label, d.text FROM documents d JOIN labels l USING (doc_id)),\n"
    f"label_lines AS (SELECT doc_id, '__label__' || {LABEL_NAMES}[label + 1] || '  ' || "
    f"regexp_replace(regexp_replace(text, '{STRIP}', '', 'g'), '\\r\\n|\\r|\\n', ' ', 'g') AS value FROM ex),\n"
    "raw_lines AS (SELECT value AS raw FROM label_lines WHERE value IS NOT NULL),\n"
    f"stripped AS (SELECT regexp_replace(raw, '{STRIP}', '', 'g') AS line FROM raw_lines),\n"
    f"parsed AS (SELECT regexp_extract(line, '{LABEL_PAT}', 1) AS category, "
    f"regexp_extract(line, '{LABEL_PAT}', 2) AS content FROM stripped "
    f"WHERE line <> '' AND regexp_matches(line, '{LABEL_PAT}'))"
)


TIMED = "(SELECT make_timestamp(1704067200000000 + doc_id * 977000000) AS ts FROM documents)"


def _period(unit: str, rows: str = "events") -> str:
    return (
        f"WITH b AS (SELECT date_trunc('{unit}', ts) AS bucket, count(*) AS count FROM {rows} "
        "WHERE ts IS NOT NULL GROUP BY 1), "
        f"r AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 {unit.upper()})) AS bucket FROM b) "
        "SELECT strftime(r.bucket, '%Y-%m-%dT%H:%M:%S.000Z') AS period, coalesce(b.count, 0)::BIGINT AS count "
        "FROM r LEFT JOIN b USING (bucket)"
    )


def oracle_sql() -> dict[str, str]:
    kw = "WITH " + _keyword_ctes()
    vec = "WITH " + VECTOR_CTES
    top_keywords = (
            ", ex AS (SELECT category, unnest(string_split(keywords, ',')) AS keyword FROM kpages "
            "WHERE keywords <> '' AND category IS NOT NULL), "
            "c AS (SELECT category, keyword, count(*) AS pages FROM ex GROUP BY category, keyword), "
            "r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pages DESC, keyword) AS rn FROM c) "
            "SELECT category, string_agg(keyword, ',' ORDER BY rn) AS keywords FROM r WHERE rn <= 5 GROUP BY category")
    return {
        "tokenize": "SELECT doc_id, len(l)::BIGINT AS n_tokens, array_to_string(list_transform(l, lambda x: lower(x)), ' ') "
                    f"AS tokens FROM (SELECT doc_id, {TOKENS} AS l FROM documents)",
        "keyword_counts": kw + " SELECT doc_id, keyword, n FROM kw_counts",
        "keywords_top10": kw + " SELECT doc_id, keywords FROM kw",
        "keywords_page": kw + " SELECT doc_id, url, title, content, category, author, publishedAt, keywords FROM kpages",
        "keywords_by_tag": "WITH " + _keyword_ctes(lexicon=True) + " SELECT doc_id, keywords FROM kw",
        "keywords_by_large_lexicon": "WITH " + _keyword_ctes(lexicon=True, large=True) + " SELECT doc_id, keywords FROM kw",
        "by_category": kw + f" SELECT {HIT_COLS} FROM kpages WHERE category = '{SEARCH_CATEGORY}'",
        "by_keywords": kw + f" SELECT {HIT_COLS} FROM kpages WHERE {KW_MATCH}",
        "search_both": kw + f" SELECT {HIT_COLS} FROM kpages WHERE category = '{SEARCH_CATEGORY}' AND {KW_MATCH}",
        "search_keywords_only": kw + f" SELECT {HIT_COLS} FROM kpages WHERE {KW_MATCH}",
        "search_indexed": kw + f" SELECT {HIT_COLS} FROM kpages WHERE category = '{SEARCH_CATEGORY}' AND {KW_MATCH}",
        "keyword_postings": kw + " SELECT keyword, category, count(*) AS pages FROM (SELECT category, "
                                 "unnest(string_split(keywords, ',')) AS keyword FROM kpages WHERE keywords <> '') GROUP BY 1, 2",
        "keywords_by_context": _context_keywords(),
        "search_total": kw + f" SELECT count(*) AS total FROM kpages WHERE category = '{SEARCH_CATEGORY}' AND {KW_MATCH}",
        "pages_per_category": "SELECT source AS category, count(*) AS count FROM documents WHERE source IS NOT NULL "
                              "GROUP BY source",
        "pages_per_category_top10": "SELECT source AS category, count(*) AS count FROM documents "
                                    "WHERE source IS NOT NULL GROUP BY source ORDER BY count DESC, category LIMIT 10",
        "top_keywords_per_category": kw + top_keywords,
        "rollup_per_category": "SELECT source AS category, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY source",
        "rollup_top_keywords": kw + top_keywords,
        "rollup_per_hour": _period("hour", TIMED),
        "rollup_per_day": _period("day", TIMED),
        "pages_per_hour": _period("hour"),
        "pages_per_day": _period("day"),
        "json_fields": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "doc_vector_norm": vec + (
            " SELECT d.doc_id, round(coalesce(sqrt(sum(dv.v * dv.v)), 0.0), 6) AS norm, "
            "coalesce(max(k.n_known), 0)::BIGINT AS n_known FROM documents d "
            "LEFT JOIN dv ON dv.doc_id = d.doc_id LEFT JOIN dv_known k ON k.doc_id = d.doc_id GROUP BY d.doc_id"),
        "doc_vector_norm_joined": vec + (
            " SELECT d.doc_id, round(coalesce(sqrt(sum(dv.v * dv.v)), 0.0), 6) AS norm, "
            "coalesce(max(k.n_known), 0)::BIGINT AS n_known FROM documents d "
            "LEFT JOIN dv ON dv.doc_id = d.doc_id LEFT JOIN dv_known k ON k.doc_id = d.doc_id GROUP BY d.doc_id"),
        "stream_classify_stateless": vec + " SELECT doc_id, category FROM classified",
        "category_centroid": vec + " SELECT category, dim::BIGINT AS dim, round(value, 6) AS value FROM cv",
        "cosine_per_category": vec + " SELECT doc_id, category, round(similarity, 6) AS similarity FROM sims",
        "classify": vec + " SELECT doc_id, category FROM classified",
        "classify_many": "WITH " + _vector_ctes("SELECT token AS category, 0 AS ord, token AS keyword FROM vocab") +
                         " SELECT doc_id, category FROM classified",
        "classify_default": "WITH " + _vector_ctes(DICTIONARY_CATS) + " SELECT doc_id, category FROM classified",
        # Words seen five times in the training lines are the model's vocabulary.
        "w2v_classify": "WITH " + VECTOR_CTES.split(",\nfreq AS")[0] + ",\n" + LABEL_CTES + (
            r""", lt AS (SELECT unnest(string_split_regex(regexp_replace(lower(value), '[\d\.:,"''\(\)\[\]|/?!;]+', '', 'g'), '[ \t\n\r\f]+')) AS token FROM label_lines),"""
            " learned AS (SELECT token FROM lt WHERE token <> '' GROUP BY token HAVING count(*) >= 5),"
            " known AS (SELECT doc_id, sum(n) AS n FROM tf JOIN learned USING (token) GROUP BY doc_id)"
            " SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_known, true AS dimension_100, true AS in_dictionary,"
            " true AS reloaded_equal FROM documents d LEFT JOIN known k USING (doc_id)"),
        "classify_bucketed": vec + " SELECT doc_id, category FROM classified",
        "label_lines": "WITH " + LABEL_CTES + " SELECT doc_id, value FROM label_lines",
        "label_parse": "WITH " + LABEL_CTES + " SELECT category, content FROM parsed",
        "label_parse_all": "WITH " + LABEL_CTES + f" SELECT regexp_extract(line, '{ANY_LABEL}', 1) AS category, "
                           f"regexp_extract(line, '{ANY_LABEL}', 2) AS content FROM stripped "
                           f"WHERE line <> '' AND regexp_matches(line, '{ANY_LABEL}')",
        "dropped_lines": "WITH " + LABEL_CTES + " SELECT count(*) AS dropped FROM stripped "
                         f"WHERE line <> '' AND NOT regexp_matches(line, '{LABEL_PAT}')",
        "saved_rows": "SELECT count(*) AS rows FROM documents",
        "stream_content_fn": "SELECT 'http://pages.test/' || doc_id AS url, replace(text, 'e', 'E') AS content, "
                             "(1704067200 + doc_id)::BIGINT AS seconds FROM documents WHERE text IS NOT NULL",
        "classify_by_url": vec + " SELECT CASE WHEN doc_id % 10 <> 0 THEN 'u' || (doc_id % 50) END AS url, category "
                                 "FROM classified",
        "first_n": f"SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT {FIRST_N}",
        "collection_roundtrip": kw + f" SELECT {HIT_COLS} FROM kpages WHERE category = '{SEARCH_CATEGORY}'",
        "union_collections": "WITH " + _keyword_ctes() + ",\n" + VECTOR_CTES + ",\n" + LABEL_CTES + (
            " SELECT category, content, keywords, NULL::BIGINT AS millis FROM kpages"
            " UNION ALL SELECT c.category, d.text AS content, NULL::VARCHAR AS keywords, 1704067200000 + doc_id AS millis"
            " FROM classified c JOIN documents d USING (doc_id)"
            " UNION ALL SELECT category, content, NULL::VARCHAR AS keywords, NULL::BIGINT AS millis FROM parsed"),
        "classified_now": "SELECT doc_id, source AS category, true AS just_now FROM documents",
        "typed_ingestion": "SELECT event_id::VARCHAR AS url, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN "
                           "epoch(date_trunc('second', ts))::BIGINT END AS seconds, CASE WHEN event_id % 7 = 0 THEN 'timestamp' END AS rejected FROM events",
        "retried_save": "SELECT source AS category, count(*) + CASE WHEN source = 'src3' THEN count(*) ELSE 0 END AS pages, "
                        "(SELECT count(*) FROM documents) AS reported FROM documents GROUP BY source",
        "word2vec_vocab": "WITH " + VECTOR_CTES.split(",\nfreq AS")[0] +
                          " SELECT token FROM tf GROUP BY token HAVING sum(n) >= 5",
        "stream_classify": vec + " SELECT doc_id, category FROM classified",
        "stream_from_latest": kw + " SELECT doc_id, keywords FROM kw JOIN documents USING (doc_id) "
                              "WHERE text IS NOT NULL AND doc_id % 3 <> 0",
        "stream_message_sink": vec + " SELECT doc_id, 'http://pages.test/' || doc_id AS url, category FROM classified "
                               "JOIN documents USING (doc_id) WHERE text IS NOT NULL AND doc_id % 3 <> 2",
        "stream_keywords": kw + " SELECT doc_id, keywords FROM kw",
    }
