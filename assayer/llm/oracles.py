"""SQL, for DuckDB, of the queries that SQL can express.

Fingerprints with XXH64, the tokenizer, trained models and seeded draws have no SQL form.  Tests hold fingerprints,
packing and mixing against brute force, and trained models' results against their formulas worked out by hand.
"""

from assayer.llm.licenses import BLOCK, PHRASES, SENTENCE_END, STEP, TEMPLATES, THRESHOLD

URL_FILTER = r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/$', '') END AS key FROM h),
listed AS (SELECT DISTINCT key FROM k WHERE contains(url, 'utm_source=') AND key IS NOT NULL),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT DISTINCT host, path, arg_max(rh || rp, length(rh || rp)) OVER w AS rule, arg_max(rv, length(rh || rp)) OVER w AS rv
         FROM (SELECT DISTINCT host, path FROM k) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) WINDOW w AS (PARTITION BY host, path))
SELECT k.page_id, k.host, k.path, best.rule, coalesce(best.rv, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed.key IS NOT NULL AS is_listed
FROM k LEFT JOIN best ON best.host = k.host AND best.path = k.path LEFT JOIN listed ON listed.key = k.key
"""

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
c AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_distinct(w)) AS n_distinct FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words * 3 OR n_dup_lines * 10 > len(string_split(t, chr(10))) * 5 OR word_chars > 24 * n_words OR word_chars < 2 * n_words
       OR len(regexp_extract_all(t, '!')) * 10 > n_words * 5 OR len(regexp_extract_all(t, '[0-9]')) * 2 > word_chars OR len(regexp_extract_all(t, '[A-Z]')) * 2 > word_chars
       OR (n_words > 200 AND n_distinct * 20 < n_words)) AS kept
FROM b
"""

HAMMING_TOP_K = """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: ((x[1] > 0) <> (x[2] > 0))::INT))::BIGINT AS distance
  FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, rank, neighbour_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS rank FROM s) WHERE rank <= 10
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _places() -> str:
    parts = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))
        parts.append(f"SELECT r, i, '{label}' AS label FROM spots WHERE {test}")
    return " UNION ALL ".join(parts)


def _templates() -> str:
    return ", ".join(f"('{label}', [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for label, t in TEMPLATES)


LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM d), spots AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM w),
places AS ({_places()}), base AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels FROM places GROUP BY r),
sentences AS (SELECT r, regexp_extract_all(s, '{_WORD}') AS w FROM (SELECT r, unnest(regexp_split_to_array(t, '{SENTENCE_END}')) AS s FROM d)),
blocks AS (SELECT r, list_distinct(w[i * {STEP} + 1 : i * {STEP} + {BLOCK}]) AS b
           FROM (SELECT r, w, unnest(range(0, greatest(0, ceil((len(w) - {BLOCK}) / {STEP}.0))::BIGINT + 1)) AS i FROM sentences)),
templates(label, t) AS (VALUES {_templates()}),
m AS (SELECT r, label, max(len(list_intersect(b, t)) / len(t)) AS score FROM blocks, templates WHERE len(list_intersect(b, t)) / len(t) >= {THRESHOLD} GROUP BY r, label),
x AS (SELECT r, list(label) AS labels, max(score) AS score FROM m GROUP BY r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first::BIGINT AS first_word, base.last::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(x.labels, [])))), ','), '') AS labels, coalesce(x.score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN x USING (r)
"""

SQL = {"op1_url_filter": URL_FILTER, "op3_quality_rules": QUALITY_RULES, "op7_hamming_top_k": HAMMING_TOP_K, "op9_licenses": LICENSES}
