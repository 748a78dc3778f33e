"""The same results as ANSI-style SQL over the given tables, for DuckDB."""

from __future__ import annotations

from checks.fixtures import TOPICS
from checks.queries import MIN_DOCUMENTS, REPORT_TOPICS, ROUNDED, STOP_WORDS, TOP
from threadmine.functions.porter2 import FINAL_AFTER_STEP_1A, INVARIANT_OR_IRREGULAR
from threadmine.functions.text import DOMAIN_STOP_WORDS, SPARK_TAGS

PUNCTUATION = r"""[!@#$%^&*()_=+.,<>:;?/{}`~''"\[\]\-]"""


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _clean(text: str) -> str:
    out = f"lower(regexp_replace({text}, '[\\x00-\\x1F]', '', 'g'))"
    for pattern in ("<pre>.+</pre>", "<[^>]+>", r"\d+(\.\d+)*", PUNCTUATION):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return out


def _tokens(text: str, stop: bool = True, least: int = 2) -> str:
    kept = f" AND t NOT IN ({_list(STOP_WORDS)})" if stop else ""
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[\\W_]+'), "
        f"lambda t: length(t) >= {least}{kept})"
    )


POSTS = """
first_turn AS (
  SELECT conv_id, min(turn) AS qturn FROM conversations WHERE role = 'user' GROUP BY conv_id
),
posts AS (
  SELECT c.conv_id * 100 + c.turn AS id,
    CASE WHEN c.turn = q.qturn THEN 1 WHEN c.role = 'assistant' THEN 2 ELSE 3 END AS "postTypeId",
    CASE WHEN c.turn = q.qturn AND c.conv_id % 3 = 0 THEN c.conv_id * 100 + c.turn + 1 END
      AS "acceptedAnswerId",
    CASE WHEN c.turn <> q.qturn AND c.role = 'assistant' THEN c.conv_id * 100 + q.qturn END
      AS "parentId",
    (2010 + c.conv_id % 8) || '-03-04 05:06:' || lpad(CAST(c.turn % 60 AS VARCHAR), 2, '0')
      AS "creationDate",
    CAST(2010 + c.conv_id % 8 AS INT) AS creation_year,
    CAST(c.conv_id * 7 % 40 - 10 AS INT) AS score,
    CASE WHEN c.turn = q.qturn AND c.conv_id % 6 <> 0 THEN CAST(c.conv_id * 13 % 1000 AS INT) END
      AS "viewCount",
    '<p>' || c.text || '</p>'
      || CASE WHEN c.conv_id % 5 = 0 THEN '<pre>val x = 1</pre> tail' ELSE '' END AS body,
    CASE WHEN c.turn = q.qturn THEN c.text END AS title,
    CASE WHEN c.turn = q.qturn THEN CASE c.conv_id % 4 WHEN 0 THEN '<apache-spark><scala>'
      WHEN 1 THEN '<pyspark-sql>' WHEN 2 THEN '<java>' ELSE '' END END AS tags,
    CASE WHEN c.turn = q.qturn THEN CAST(c.conv_id % 5 AS INT) END AS "answerCount",
    CASE WHEN c.turn = q.qturn AND c.conv_id % 4 <> 1 THEN CAST(c.conv_id % 9 AS INT) END
      AS "commentCount",
    CASE WHEN c.turn = q.qturn AND c.conv_id % 3 = 0 THEN CAST(c.conv_id % 7 AS INT) END
      AS "favoriteCount"
  FROM conversations c LEFT JOIN first_turn q ON c.conv_id = q.conv_id
)"""
TAGGED = " OR ".join(f"contains(tags, '{t}')" for t in SPARK_TAGS)
ASKED = f"""{POSTS},
asked AS (
  SELECT * FROM posts WHERE creation_year > 2012 AND "postTypeId" = 1 AND ({TAGGED})
),
replies AS (
  SELECT a.* FROM posts a SEMI JOIN asked q ON a."parentId" = q.id
  WHERE a.creation_year > 2012 AND a."postTypeId" = 2
),
answer_texts AS (
  SELECT "parentId" AS id, {_clean("string_agg(body, ' ' ORDER BY id)")} AS cleaned
  FROM replies GROUP BY "parentId"
),
together AS (
  SELECT q.*, {_clean("q.title || ' ' || q.body")} || ' ' || coalesce(a.cleaned, '') AS whole
  FROM asked q LEFT JOIN answer_texts a ON q.id = a.id
)"""
POST_COLUMNS = (
    'id, "postTypeId", "acceptedAnswerId", "parentId", "creationDate", score, "viewCount", body, '
    'title, tags, "answerCount", "commentCount", "favoriteCount"'
)


def _stems(words: str) -> str:
    """CTEs ``stems(term, stem)`` for the distinct values of ``words(term)``: Porter2 as
    pattern rules, one rule step per CTE."""
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in INVARIANT_OR_IRREGULAR.items())
    region = "'^.*?[aeiouy][^aeiouy]'"
    short = "'(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$'"
    step_2 = (
        "ization|ational|fulness|ousness|iveness|tional|biliti|lessli|entli|ation|alism|aliti|"
        "ousli|iviti|fulli|enci|anci|abli|izer|ator|alli|bli|ogi|li"
    )
    step_3 = "ational|tional|alize|icate|iciti|ative|ical|ness|ful"
    step_4 = (
        "ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|ion|al|er|ic"
    )

    def suffix(name: str, source: str, pattern: str) -> str:
        return (
            f"{name} AS (SELECT *, regexp_extract(w, '({pattern})$', 1) AS s, "
            f"length(w) - length(regexp_extract(w, '({pattern})$', 1)) AS b FROM {source})"
        )

    return f"""
p0 AS (
  SELECT term, CASE term {irregular} WHEN '' THEN '' END AS fixed,
    CASE WHEN length(term) <= 2 THEN term END AS tiny,
    regexp_replace(term, '(^|[aeiouy])y', '\\1Y', 'g') AS w
  FROM (SELECT DISTINCT term FROM {words})
),
p1 AS (
  SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5
    WHEN starts_with(w, 'commun') THEN 6
    WHEN regexp_matches(w, {region}) THEN length(regexp_extract(w, {region}))
    ELSE length(w) END AS r1 FROM p0
),
p2 AS (
  SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), {region})
    THEN r1 + length(regexp_extract(substr(w, r1 + 1), {region})) ELSE length(w) END AS r2 FROM p1
),
p3 AS (
  SELECT term, fixed, tiny, r1, r2, CASE
    WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
    WHEN regexp_matches(w, '(ied|ies)$')
      THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN w LIKE '%us' OR w LIKE '%ss' THEN w
    WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1)
    ELSE w END AS w FROM p2
),
p4 AS (
  SELECT *, w IN ({_list(sorted(FINAL_AFTER_STEP_1A))}) AS final,
    regexp_replace(w, '(edly|ingly|ed|ing)$', '') AS base,
    regexp_replace(w, 'eed(ly)?$', '') AS ee FROM p3
),
p5 AS (
  SELECT term, fixed, tiny, r1, r2, CASE WHEN final THEN w END AS done, CASE
    WHEN regexp_matches(w, 'eed(ly)?$') THEN CASE WHEN length(ee) >= r1 THEN ee || 'ee' ELSE w END
    WHEN base <> w AND regexp_matches(base, '[aeiouy]') THEN CASE
      WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
      WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, length(base) - 1)
      WHEN length(base) <= r1 AND regexp_matches(base, {short}) THEN base || 'e'
      ELSE base END
    ELSE w END AS w FROM p4
),
p6 AS (
  SELECT term, fixed, tiny, done, r1, r2,
    regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w FROM p5
),
{suffix("p7", "p6", step_2)},
p8 AS (
  SELECT term, fixed, tiny, done, r1, r2, CASE WHEN s = '' OR b < r1 THEN w ELSE CASE
    WHEN s = 'tional' THEN left(w, b) || 'tion'
    WHEN s IN ('enci', 'anci') THEN left(w, b) || left(s, 3) || 'e'
    WHEN s = 'abli' THEN left(w, b) || 'able'
    WHEN s = 'entli' THEN left(w, b) || 'ent'
    WHEN s IN ('izer', 'ization') THEN left(w, b) || 'ize'
    WHEN s IN ('ational', 'ation', 'ator') THEN left(w, b) || 'ate'
    WHEN s IN ('alism', 'aliti', 'alli') THEN left(w, b) || 'al'
    WHEN s = 'fulness' OR s = 'fulli' THEN left(w, b) || 'ful'
    WHEN s IN ('ousli', 'ousness') THEN left(w, b) || 'ous'
    WHEN s IN ('iveness', 'iviti') THEN left(w, b) || 'ive'
    WHEN s IN ('biliti', 'bli') THEN left(w, b) || 'ble'
    WHEN s = 'ogi' THEN CASE WHEN b > 0 AND w[b] = 'l' THEN left(w, b) || 'og' ELSE w END
    WHEN s = 'lessli' THEN left(w, b) || 'less'
    WHEN b > 0 AND w[b] IN ('c','d','e','g','h','k','m','n','r','t') THEN left(w, b)
    ELSE w END END AS w FROM p7
),
{suffix("p9", "p8", step_3)},
p10 AS (
  SELECT term, fixed, tiny, done, r1, r2, CASE WHEN s = '' OR b < r1 THEN w ELSE CASE
    WHEN s = 'ational' THEN left(w, b) || 'ate'
    WHEN s = 'tional' THEN left(w, b) || 'tion'
    WHEN s = 'alize' THEN left(w, b) || 'al'
    WHEN s IN ('icate', 'iciti', 'ical') THEN left(w, b) || 'ic'
    WHEN s = 'ative' THEN CASE WHEN b >= r2 THEN left(w, b) ELSE w END
    ELSE left(w, b) END END AS w FROM p9
),
{suffix("p11", "p10", step_4)},
p12 AS (
  SELECT term, fixed, tiny, done, r1, r2, CASE
    WHEN s = '' OR b < r2 OR (s = 'ion' AND (b = 0 OR w[b] NOT IN ('s', 't'))) THEN w
    ELSE left(w, b) END AS w FROM p11
),
p13 AS (
  SELECT term, fixed, tiny, done, CASE
    WHEN w LIKE '%e' AND (length(w) > r2 OR (length(w) > r1
      AND NOT regexp_matches(left(w, length(w) - 1), {short}))) THEN left(w, length(w) - 1)
    WHEN w LIKE '%ll' AND length(w) > r2 THEN left(w, length(w) - 1)
    ELSE w END AS w FROM p12
),
stems AS (
  SELECT term, coalesce(tiny, fixed, replace(coalesce(done, w), 'Y', 'y')) AS stem FROM p13
)"""


def _stemmed(source: str, key: str, tokens: str) -> str:
    """CTEs ``placed(key, pos, stem)`` for the token lists of ``source``."""
    return f"""
listed AS (SELECT {key} AS key, {tokens} AS ts FROM {source}),
spread AS (SELECT key, generate_subscripts(ts, 1) AS pos, unnest(ts) AS term FROM listed),
{_stems("spread")},
placed AS (SELECT key, pos, stem FROM spread JOIN stems USING (term))"""


def _lists(condition: str = "TRUE") -> str:
    return (
        "lists AS (SELECT key, string_agg(stem, ' ' ORDER BY pos) AS words FROM placed "
        f"WHERE {condition} GROUP BY key)"
    )


def _corpus(source: str, cleaned: str) -> str:
    return f"""WITH {ASKED}, {_stemmed(source, "id", _tokens(cleaned))}, {_lists()}
SELECT id, "creationDate", score, "viewCount", title, coalesce(words, '') AS document, tags,
  "answerCount", "commentCount", "favoriteCount"
FROM asked LEFT JOIN lists ON id = key"""


NOT_DOMAIN = f"stem NOT IN ({_list(DOMAIN_STOP_WORDS)})"
DOCS = f"""{_stemmed("documents", "doc_id", _tokens(_clean("text")))},
words AS (SELECT key AS id, pos, stem AS term FROM placed WHERE {NOT_DOMAIN}),
vocabulary AS (
  SELECT term, count(*) AS n FROM words GROUP BY term HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}
)"""

WEIGHTS = """
sizes AS (
  SELECT vec_id AS id, list_transform(range({k}), lambda t: list_sum(list_transform(
      list_filter(embedding, lambda x, i: (i - 1) % {k} = t), lambda x: abs(CAST(x AS DOUBLE))
    ))) AS v
  FROM embeddings
),
td AS (
  SELECT id, generate_subscripts(v, 1) AS topic, unnest(v) / list_sum(v) AS weight FROM sizes
)"""
TD = WEIGHTS.format(k=TOPICS)
CORPUS = """
corpus AS (
  SELECT doc_id AS id, CAST(n_chars % 50 - 10 AS INT) AS score,
    CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars % 1000 AS INT) END AS view,
    source || ' ' || doc_id AS title,
    CAST(n_chars % 6 AS INT) AS answer, CAST(n_chars % 11 AS INT) AS comment,
    CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars % 4 AS INT) END AS favorite
  FROM documents
)"""
ENGAGEMENT = ("view", "answer", "comment", "favorite", "score")


def _matrix(value: str, source: str = "td", more: str = "", as_type: str = "DOUBLE") -> str:
    cells = ", ".join(
        f"CAST(round(max(CASE WHEN topic = {i} THEN v END), 9) AS {as_type}) AS \"Topic {i}\""
        for i in range(1, TOPICS + 1)
    )
    return f"""WITH {TD}, {CORPUS}, valued AS (
  SELECT id, topic, {value} AS v FROM (
    SELECT *, max(weight) OVER (PARTITION BY id) AS top FROM {source}) {more})
SELECT id, {cells} FROM valued GROUP BY id"""


METRICS = f"""{TD}, {CORPUS},
topped AS (SELECT *, max(weight) OVER (PARTITION BY id) AS top FROM td),
model AS (
  SELECT topic, count(*) AS documents, CAST(sum(CASE WHEN weight = top THEN 1 ELSE 0 END) AS BIGINT) AS nddt,
    sum(CASE WHEN weight >= 0.1 THEN weight ELSE 0 END) AS impact,
    sum(CASE WHEN weight >= 0.1 THEN -weight * log10(weight) ELSE 0 END) AS entropy
  FROM topped GROUP BY topic
),
engaged AS (
  SELECT topic, {", ".join(
      f"sum(CASE WHEN weight >= 0.1 THEN weight * coalesce({m}, 0) ELSE 0 END) AS {m}_sum"
      for m in ENGAGEMENT)}
  FROM td JOIN corpus ON td.id = corpus.id GROUP BY topic
),
totals AS (SELECT {", ".join(f"sum({m}) AS {m}_total" for m in ENGAGEMENT)} FROM corpus),
metrics AS (
  SELECT model.topic, documents, nddt, impact, entropy, nddt / documents AS pddt,
    impact / documents AS share, {", ".join(f"{m}_sum" for m in ENGAGEMENT)},
    {", ".join(f"{m}_sum / {m}_total AS {m}_share" for m in ENGAGEMENT)}
  FROM model JOIN engaged ON model.topic = engaged.topic, totals
)"""


def _wide(metric: str, pattern: str) -> str:
    value = metric if metric == "nddt" else f"round({metric}, {ROUNDED})"
    cells = ", ".join(
        f'max(CASE WHEN topic = {i} THEN {value} END) AS "{pattern.format(i)}"'
        for i in range(1, TOPICS + 1)
    )
    return f"WITH {METRICS} SELECT {cells} FROM metrics"


DESCRIBED = f"""
spread AS (
  SELECT lang, unnest({_tokens("text", stop=False)}) AS term FROM documents
),
counted AS (SELECT lang, term, count(*) AS n FROM spread GROUP BY lang, term),
shares AS (
  SELECT dense_rank() OVER (ORDER BY lang) AS topic, term, n / sum(n) OVER (PARTITION BY lang) AS weight,
    row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank
  FROM counted
),
terms AS (SELECT topic, rank, term, weight FROM shares WHERE rank <= {TOP})"""
TOP_DOCUMENTS = """
ranked AS (
  SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, id) AS rank, id, weight
  FROM td
),
best AS (
  SELECT topic, rank, r.id, title, weight FROM ranked r LEFT JOIN corpus c ON r.id = c.id
  WHERE rank <= 10
)"""
REPORT = f"""{DESCRIBED}, {WEIGHTS.format(k=REPORT_TOPICS)}, {CORPUS}, {TOP_DOCUMENTS},
report AS (
  SELECT topic, 'term' AS kind, rank, printf('%s (%.3f)', term, weight) AS label,
    printf('%s (%.3f)', term, weight) AS detail FROM terms
  UNION ALL
  SELECT topic, 'document', rank, printf('%d : %s : %.4f', id, coalesce(title, ''), weight),
    printf('%.4f : %d : %s', weight, id, coalesce(title, '')) FROM best
)"""
UNSTEMMED_TERMS = f"""{ASKED},
words AS (SELECT id, unnest({_tokens("whole")}) AS term FROM together)"""
COVERED = f"""WITH {DOCS}
SELECT DISTINCT id, 4 AS topics, CAST(1 AS DOUBLE) AS total_weight
FROM words SEMI JOIN vocabulary USING (term)"""

JUDGED = f"""WITH {DOCS},
train AS (SELECT * FROM words WHERE id % 5 <> 0),
known AS (
  SELECT term, count(*) AS n FROM train GROUP BY term HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}
),
held AS (
  SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY pos) % 2 AS seen
  FROM words WHERE id % 5 = 0
),
usable AS (SELECT DISTINCT id FROM held SEMI JOIN known USING (term) WHERE seen = 1),
judged AS (
  SELECT count(*) AS n, sum(ln(known.n / (SELECT sum(n) FROM known))) AS unigram
  FROM held JOIN known USING (term) SEMI JOIN usable USING (id) WHERE seen = 0
)
SELECT CAST(topic AS INT) AS topic, CAST({TOP} AS BIGINT) AS terms, true AS weights_fall,
  true AS weights_in_range, true AS terms_distinct, true AS terms_known, n AS held_out_words,
  round(unigram, 3) AS unigram_log_likelihood, true AS better
FROM judged, range(1, 5) r(topic)"""

ORACLES: dict[str, str] = {
    "posts_from_dump": f"WITH {POSTS} SELECT {POST_COLUMNS} FROM posts",
    "dump_line_validity": f"""WITH {POSTS}
SELECT true AS valid, count(*) AS lines, CAST(sum(id) AS BIGINT) AS id_sum FROM posts
UNION ALL SELECT false, count(*), NULL FROM posts""",
    "dump_files_scan": f"""WITH {POSTS}
SELECT "postTypeId", count(*) AS posts, CAST(sum(score) AS BIGINT) AS score_sum,
  CAST(sum(length(body)) AS BIGINT) AS body_characters FROM posts GROUP BY "postTypeId" """,
    "staged_posts_by_year": f"""WITH {POSTS}
SELECT creation_year, count(*) AS posts, count(tags) AS tagged FROM posts
WHERE creation_year >= 2014 GROUP BY creation_year""",
    "stop_word_file_scan": f"""
SELECT DISTINCT unnest({_tokens("text", stop=False, least=1)}) AS word FROM benchmark""",
    "corpus_parquet_files": _corpus("asked", _clean("title || ' ' || body")),
    "corpus_csv_files": f"""WITH {ASKED},
{_stemmed("asked", "id", _tokens(_clean("title || ' ' || body")))}, {_lists()}
SELECT id, words AS doc FROM asked LEFT JOIN lists ON id = key""",
    "posts_since_2013": f"WITH {POSTS} SELECT id, creation_year FROM posts WHERE creation_year > 2012",
    "questions": f'WITH {POSTS} SELECT id, title, tags FROM posts WHERE "postTypeId" = 1',
    "answers": f'WITH {POSTS} SELECT id, "parentId" FROM posts WHERE "postTypeId" = 2',
    "tagged_questions": f"WITH {ASKED} SELECT id, tags FROM asked",
    "answers_of_tagged_questions": f"""WITH {ASKED}
SELECT id, "parentId", length(body) AS body_characters FROM replies""",
    "conditional_post_fields": f"""WITH {POSTS}
SELECT "postTypeId", count("acceptedAnswerId") AS "acceptedAnswerId",
  count("parentId") AS "parentId", count(title) AS title, count(tags) AS tags,
  count("viewCount") AS "viewCount", count("answerCount") AS "answerCount",
  count("commentCount") AS "commentCount", count("favoriteCount") AS "favoriteCount"
FROM posts GROUP BY "postTypeId" """,
    "clean_documents": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "clean_pages": f"SELECT page_id, {_clean('html')} AS cleaned FROM pages",
    "cleaning_steps": f"""WITH {POSTS}
SELECT id, md5(regexp_replace(body, '[\\x00-\\x1F]', '', 'g')) AS controls,
  md5(lower(body)) AS lowered, md5(regexp_replace(body, '<pre>.+</pre>', ' ', 'g')) AS code,
  md5(regexp_replace(body, '<[^>]+>', ' ', 'g')) AS markup,
  md5(regexp_replace(body, '\\d+(\\.\\d+)*', ' ', 'g')) AS numbers,
  md5(regexp_replace(body, '{PUNCTUATION}', ' ', 'g')) AS punctuation FROM posts""",
    "sql_functions": f"""WITH {POSTS}
SELECT id, coalesce({TAGGED}, false) AS related, {_clean("body")} AS cleaned FROM posts""",
    "document_tokens": f"""
SELECT doc_id, array_to_string({_tokens(_clean("text"), stop=False)}, ' ') AS tokens
FROM documents""",
    "tokens_without_stop_words": f"""
SELECT doc_id, array_to_string({_tokens(_clean("text"))}, ' ') AS words FROM documents""",
    "words_outside_benchmark": f"""
WITH spread AS (
  SELECT doc_id, unnest({_tokens("text", stop=False)}) AS term FROM documents
), listed AS (SELECT unnest({_tokens("text", stop=False)}) AS term FROM benchmark)
SELECT doc_id, count(*) AS words FROM spread ANTI JOIN listed USING (term) GROUP BY doc_id""",
    "stems_of_terms": f"""
WITH spread AS (SELECT unnest({_tokens("text", stop=False)}) AS term FROM documents),
{_stems("spread")} SELECT term, stem FROM stems""",
    "stemmed_pages": f"""
WITH {_stemmed("pages", "page_id", _tokens(_clean("html"), stop=False))}, {_lists()}
SELECT page_id, coalesce(words, '') AS stems FROM pages LEFT JOIN lists ON page_id = key""",
    "domain_words_removed": f"""
WITH {_stemmed("documents", "doc_id", _tokens(_clean("text")))}, {_lists(NOT_DOMAIN)}
SELECT doc_id AS id, coalesce(words, '') AS removed FROM documents LEFT JOIN lists ON doc_id = key""",
    "title_corpus": _corpus("asked", _clean("title")),
    "question_corpus": _corpus("asked", _clean("title || ' ' || body")),
    "answer_corpus": f"""WITH {ASKED}
SELECT id, title, cleaned FROM answer_texts JOIN asked USING (id)""",
    "answer_corpus_per_answer": f"""WITH {ASKED}, own AS (
  SELECT "parentId" AS id, string_agg({_clean("body")}, ' ' ORDER BY id) AS cleaned
  FROM replies GROUP BY "parentId")
SELECT id, title, own.cleaned FROM own JOIN asked USING (id)""",
    "question_answer_corpus": _corpus("together", "whole"),
    "question_answer_terms_of_spread_documents": f"""WITH {UNSTEMMED_TERMS}
SELECT id, term, count(*) AS count FROM words GROUP BY id, term""",
    "top_question_terms": f"""WITH {ASKED}, words AS (
  SELECT unnest({_tokens(_clean("title || ' ' || body"))}) AS term FROM asked)
SELECT term, count(*) AS count FROM words WHERE term NOT IN ({_list(DOMAIN_STOP_WORDS)})
GROUP BY term ORDER BY count DESC, term LIMIT {TOP}""",
    "corpus_size": f"WITH {ASKED} SELECT count(*) AS documents FROM asked",
    "term_frequency": f"WITH {DOCS} SELECT term, count(*) AS count FROM words GROUP BY term",
    "top_terms": f"""WITH {DOCS} SELECT term, count(*) AS count FROM words GROUP BY term
ORDER BY count DESC, term LIMIT {TOP}""",
    "document_frequency": f"""WITH {DOCS}
SELECT term, count(DISTINCT id) AS documents FROM words GROUP BY term
HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}""",
    "document_frequency_of_spread_documents": f"""WITH {UNSTEMMED_TERMS}
SELECT term, count(DISTINCT id) AS documents FROM words GROUP BY term
HAVING count(DISTINCT id) >= 2""",
    "term_counts": f"WITH {DOCS} SELECT id, term, count(*) AS count FROM words GROUP BY id, term",
    "vocabulary_size": f"WITH {DOCS} SELECT count(*) AS terms FROM vocabulary",
    "count_vectors": f"""WITH {DOCS}
SELECT id, term, count(*) AS count FROM words SEMI JOIN vocabulary USING (term) GROUP BY id, term""",
    "numbered_terms": f"""WITH {DOCS}
SELECT CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INT) AS "termIndex", term, n AS count
FROM vocabulary""",
    "saved_vectorizer": f"""WITH {DOCS}
SELECT CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INT) AS "termIndex", term
FROM vocabulary""",
    "topic_membership": _matrix("weight"),
    "topic_membership_rows": f"WITH {TD} SELECT id, CAST(topic AS INT) AS topic, round(weight, 9) AS weight FROM td",
    "topic_membership_from_rows": _matrix("weight"),
    "dominant_topic_matrix": _matrix("CASE WHEN weight = top THEN weight ELSE 0 END"),
    "dominant_topic_flags": _matrix("CASE WHEN weight = top THEN 1 ELSE 0 END", as_type="INT"),
    "weights_above_threshold": _matrix("CASE WHEN weight >= 0.1 THEN weight ELSE 0 END"),
    "entropy_matrix": _matrix("CASE WHEN weight >= 0.1 THEN weight * log10(weight) ELSE 0 END"),
    **{
        f"{m}_weighted_matrix": _matrix(
            f"CASE WHEN weight >= 0.1 THEN weight * coalesce({m}, 0) ELSE 0 END",
            more="JOIN corpus USING (id)",
        )
        for m in ENGAGEMENT
    },
    "corpus_totals": f"""WITH {CORPUS}
SELECT 'Spark' AS "Dataset", count(*) AS "Questions", CAST(sum(answer) AS BIGINT) AS "Answers",
  CAST(sum(comment) AS BIGINT) AS "Comments", CAST(sum(view) AS BIGINT) AS "Views",
  CAST(sum(favorite) AS BIGINT) AS "Favorites", CAST(sum(score) AS BIGINT) AS "Scores"
FROM corpus""",
    "topic_metrics": f"""WITH {METRICS}
SELECT CAST(topic AS INT) AS topic, documents, nddt, {", ".join(
    f"round({c}, {ROUNDED}) AS {c}" for c in ["impact", "entropy", "pddt", "share"]
    + [f"{m}_sum" for m in ENGAGEMENT] + [f"{m}_share" for m in ENGAGEMENT])} FROM metrics""",
    "model_metrics": f"""WITH {METRICS}
SELECT CAST(topic AS INT) AS topic, documents, nddt, {", ".join(
    f"round({c}, {ROUNDED}) AS {c}" for c in ["impact", "entropy", "pddt", "share"])}
FROM metrics""",
    "model_metrics_single_winner": f"""WITH {TD},
tied AS (SELECT id, topic, round(weight, 1) AS weight FROM td),
placed AS (
  SELECT id, topic, row_number() OVER (PARTITION BY id ORDER BY weight DESC, topic) AS place FROM tied
)
SELECT CAST(topic AS INT) AS topic, count(*) AS documents,
  CAST(sum(CASE WHEN place = 1 THEN 1 ELSE 0 END) AS BIGINT) AS nddt FROM placed GROUP BY topic""",
    **{
        f"{m}_by_topic": _wide(m, pattern)
        for m, pattern in {
            "nddt": "sum(Topic {})", "impact": "sum(Topic {})", "pddt": "D(T{})",
            "share": "Share(T{})", "view_share": "ViewShare(T{})",
            "answer_share": "AnswerShare(T{})", "comment_share": "CommentShare(T{})",
            "favorite_share": "FavoriteShare(T{})", "score_share": "ScoreShare(T{})",
            "entropy": "TE(T{})",
        }.items()
    },
    "topic_terms_by_index": f"""WITH {DESCRIBED}
SELECT CAST(topic AS INT) AS topic, CAST(rank AS INT) AS rank, term,
  round(weight, {ROUNDED}) AS weight FROM terms""",
    "top_documents": f"""WITH {TD}, {CORPUS}, {TOP_DOCUMENTS}
SELECT CAST(topic AS INT) AS topic, CAST(rank AS INT) AS rank, id,
  round(weight, {ROUNDED}) AS weight FROM best""",
    "top_documents_with_titles": f"""WITH {TD}, {CORPUS}, {TOP_DOCUMENTS}
SELECT CAST(topic AS INT) AS topic, CAST(rank AS INT) AS rank, id, title,
  round(weight, {ROUNDED}) AS weight FROM best""",
    "report_rows": f"""WITH {REPORT}
SELECT CAST(topic AS INT) AS topic, kind, CAST(rank AS INT) AS rank, label, detail FROM report""",
    "horizontal_report": f"""WITH {REPORT}
SELECT kind, CAST(rank AS INT) AS rank, {", ".join(
    f'max(CASE WHEN topic = {i} THEN label END) AS "TOPIC {i}"'
    for i in range(1, REPORT_TOPICS + 1))} FROM report GROUP BY kind, rank""",
    "vertical_report": f"""WITH {REPORT}
SELECT CAST(topic AS INT) AS topic, kind, CAST(rank AS INT) AS rank, detail AS line FROM report""",
    "em_distributions": COVERED,
    "online_distributions": COVERED,
    "sweep_statistics": f"""WITH {DOCS}, ks AS (SELECT unnest([3, 5]) AS k)
SELECT 'D' AS corpus, (SELECT count(*) FROM documents) AS documents,
  (SELECT count(*) FROM vocabulary) AS terms, CAST(k AS INT) AS k,
  round(50 / k + 1, {ROUNDED}) AS alpha, CAST(1.01 AS DOUBLE) AS beta, 5 AS iterations FROM ks""",
    "em_topics": JUDGED,
    "online_topics": JUDGED,
    "sweep_reports": f"""WITH ks AS (SELECT unnest([3, 5]) AS k),
listed AS (
  SELECT 'term' AS kind, rank FROM range(1, {TOP + 1}) t(rank)
  UNION ALL SELECT 'document', rank FROM range(1, 11) t(rank)
)
SELECT CAST(k AS INT) AS k, CAST(topic AS INT) AS topic, kind, CAST(rank AS INT) AS rank,
  true AS well_labelled
FROM ks, range(1, 6) r(topic), listed WHERE topic <= k""",
    "metrics_of_saved_models": f"""WITH {DOCS}, ks AS (SELECT unnest([3, 5]) AS k),
modelled AS (SELECT count(DISTINCT id) AS n FROM words SEMI JOIN vocabulary USING (term))
SELECT CAST(k AS INT) AS k, CAST(topic AS INT) AS topic, n AS documents, true AS nddt_holds,
  true AS every_document_dominated, true AS impact_holds, true AS weights_within_documents,
  true AS entropy_holds, true AS engagement_holds, true AS score_holds
FROM modelled, ks, range(1, 6) r(topic) WHERE topic <= k""",
    "reloaded_model_topics": f"""WITH {DOCS}, size AS (SELECT count(*) AS n FROM vocabulary)
SELECT CAST(topic AS INT) AS topic, least(n, {TOP}) AS terms, least(n, {TOP}) AS known_terms,
  true AS as_reported
FROM size, range(1, 4) r(topic)""",
}
