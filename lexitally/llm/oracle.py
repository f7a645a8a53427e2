"""SQL twins of the queries that SQL can express, from their definitions."""

from __future__ import annotations

from lexitally.llm.quality import RULES, Risk
from lexitally.llm.queries import LISTED, URL_RULES

WORD = r"[^\x20\x09-\x0D]+"


def url_verdicts() -> str:
    fits = [
        f"""SELECT page_id, url, '{host}{path}' AS rule, '{verdict}' AS verdict FROM split
  WHERE (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"""
        for host, path, verdict in URL_RULES
    ]
    return rf"""
WITH split AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS ({" UNION ALL ".join(fits)}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT s.page_id, s.host, s.path, b.rule,
  coalesce(b.verdict, CASE WHEN regexp_matches(s.host, '{LISTED}') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best b ON s.page_id = b.page_id"""


SEARCH = """
WITH q AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

PASSAGES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
least AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos
  FROM windows JOIN least USING (key) WHERE doc_id > first),
gone AS (SELECT doc_id, list(pos) AS gone FROM covered GROUP BY doc_id),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w) p
  ANTI JOIN covered c USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id LEFT JOIN left_over l ON w.doc_id = l.doc_id"""


def quality_rules() -> str:
    risk = Risk()
    measured = {r.name: "CASE WHEN n_words > 0 THEN {}::DOUBLE / {} ELSE 0 END".format(*r.measure.split(" / ")) for r in RULES}
    steps = [(r.name, c) for r in RULES for c in r.cutoffs]
    cells = " UNION ALL ".join(
        f"SELECT lang, '{name}' AS rule, {cutoff}::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER ({measured[name]} > {cutoff}) AS k FROM good GROUP BY lang"
        for name, cutoff in steps
    )
    share = risk.share / len(RULES)
    fails = " OR ".join(
        f"coalesce({measured[r.name]} > (SELECT min(cutoff) FROM passed p WHERE p.rule = '{r.name}' AND p.lang IS NOT DISTINCT FROM f.lang), false)"
        for r in RULES
    )
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
five AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, key FROM five GROUP BY doc_id, key HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT pos) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM five JOIN twice USING (doc_id, key)) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, lang, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeats r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
good AS (SELECT * FROM b SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON b.doc_id = l.doc_id WHERE NOT base_failed),
cells AS ({cells}),
tails AS (
  SELECT lang, rule, cutoff, CASE WHEN k >= n * {share} THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({share}) + (n - i) * ln(1 - {share})))) END AS tail
  FROM cells),
passed AS (
  SELECT lang, rule, cutoff FROM tails
  WHERE tail * {len(steps)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)) <= {risk.error})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({fails}) AS kept
FROM b f"""


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
  FROM lists, (SELECT unnest(range(1, 6))::INTEGER AS k)),
counts AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL),
words AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM counts WHERE k > 1 AND f >= 100),
parts AS (
  SELECT lang, array_to_string(w[s:s + j - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, w, f, j, unnest(range(1, k - j + 2)) AS s
        FROM (SELECT lang, k, w, f, unnest(range(2, k)) AS j FROM candidates))
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN parts p ON c.lang = p.lang AND c.phrase = p.phrase
  WHERE p.longer IS NULL OR 100 * p.longer < 100 * c.f),
cuts AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, cut,
    ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON c.lang = x.lang AND c.head = x.phrase
    JOIN counts y ON c.lang = y.lang AND c.rest = y.phrase JOIN words n ON c.lang = n.lang),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""


def statements() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules(),
        "op5_repeated_passages": PASSAGES,
        "op6_bit_sliced_search": SEARCH,
        "op8_url_verdicts": url_verdicts(),
        "op12_collocations": COLLOCATIONS,
    }
