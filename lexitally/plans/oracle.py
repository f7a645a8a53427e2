"""The queries of the catalog as plain SQL, for checking.

Written from the definitions, not from the Spark plans: no hot keys, no
arrays of runs, stems by patterns over whole words.
"""

from __future__ import annotations

from lexitally.functions.stem import IRREGULAR, STEP_2, STEP_3, STEP_4
from lexitally.functions.words import CUSTOM_STOPWORDS, ENGLISH_STOPWORDS, STYLE_LEXICON, matchable
from lexitally.plans.variants import VARIANTS, Variant, crossed

WORD = r"[\p{L}\p{N}_]{2,}"
PUNCT = r"[!-/:-@\[-`{-~]"
NON_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"
SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END"

CORPUS = f"""corpus AS (
  SELECT d.doc_id, d.text, d.lang, l.toxic AS label, CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
WRITTEN = """written AS (
  SELECT d.doc_id, d.text, CASE l.toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'not toxic' END AS written
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def words_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def tokens(text: str = "text") -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')"


def stripped(text: str = "text") -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), '{PUNCT}', ' ', 'g')"


def clean_list(text: str = "text", stop=()) -> str:
    found = f"regexp_extract_all({stripped(text)}, '{NON_SPACE}')"
    kept = matchable(stop)
    return f"list_filter({found}, lambda w: w NOT IN {words_list(kept)})" if kept else found


def pairs(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


# Stemming

V, C = "[aeiouy]", "[^aeiouy]"
M0, M1 = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}"


def _m(pattern: str, suffix: str) -> str:
    return f"regexp_matches(w, '{pattern}.*{suffix}$')"


def _suffixes(rules) -> str:
    arms = []
    for suffix, condition, replacement in sorted(rules, key=lambda r: -len(r[0])):
        new = f"regexp_replace(w, '{suffix}$', '{replacement}')"
        arms.append(
            f"WHEN suffix(w, '{suffix}') THEN "
            + (f"CASE WHEN {condition} THEN {new} ELSE w END" if condition else new)
        )
    return "CASE " + " ".join(arms) + " ELSE w END"


def stem_steps() -> list[str]:
    cvc = "[^aeiouy][aeiouy][^aeiouywxY]"
    short = f"regexp_matches(b, '{cvc}$|^{V}{C}$')"
    m = lambda p, s: f"regexp_matches({s}, '{p}')"
    bare = "left(w, length(w) - 1)"
    step2 = [(s, _m(M0, s), r) for s, r in STEP_2 if s != "abli"]
    step2 += [("bli", _m(M0, "bli"), "ble"), ("fulli", _m(M0, "fulli"), "ful")]
    step2 += [("logi", m(M0, "left(w, length(w) - 3)"), "log")]
    step4 = [(s, _m(M1, s), "") for s in STEP_4 if s != "ion"]
    step4 += [("ion", m(M1, "left(w, length(w) - 3)") + " AND regexp_matches(w, '[st]ion$')", "")]
    return [
        "regexp_replace(w, '(^|[aeiouy])y', '\\1Y', 'g')",
        "CASE WHEN regexp_matches(w, '^.ies$') THEN left(w, 3) WHEN suffix(w, 'sses') OR suffix(w, 'ies')"
        " THEN left(w, length(w) - 2) WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN left(w, length(w) - 1)"
        " ELSE w END",
        "CASE WHEN regexp_matches(w, '^.ied$') THEN left(w, 3) WHEN suffix(w, 'ied') THEN left(w, length(w) - 2)"
        f" WHEN suffix(w, 'eed') THEN CASE WHEN {_m(M0, 'eed')} THEN left(w, length(w) - 1) ELSE w END"
        f" WHEN regexp_matches(w, '{V}.*ed$') THEN regexp_replace(w, 'ed$', '#')"
        f" WHEN regexp_matches(w, '{V}.*ing$') THEN regexp_replace(w, 'ing$', '#') ELSE w END",
        "CASE WHEN NOT suffix(w, '#') THEN w WHEN regexp_matches(w, '(at|bl|iz)#$') THEN regexp_replace(w, '#$', 'e')"
        f" WHEN regexp_matches(w, '(ll|ss|zz)#$') THEN {bare}"
        " WHEN length(w) >= 3 AND w[-2] = w[-3] AND w[-2] NOT IN ('a', 'e', 'i', 'o', 'u', 'y')"
        " THEN left(w, length(w) - 2)"
        f" WHEN {m(M0, bare)} AND NOT {m(M1, bare)} AND {short.replace('(b,', f'({bare},')}"
        f" THEN regexp_replace(w, '#$', 'e') ELSE {bare} END",
        f"CASE WHEN regexp_matches(w, '^.+{C}y$') THEN regexp_replace(w, 'y$', 'i') ELSE w END",
        f"CASE WHEN suffix(w, 'alli') AND {_m(M0, 'alli')} THEN left(w, length(w) - 2) ELSE w END",
        _suffixes(step2),
        _suffixes([(s, _m(M0, s), r) for s, r in STEP_3]),
        _suffixes(step4),
        f"CASE WHEN suffix(w, 'e') AND ({m(M1, bare)} OR ({m(M0, bare)} AND NOT"
        f" {short.replace('(b,', f'({bare},')})) THEN {bare} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {m(M1, bare)} THEN {bare} ELSE w END",
    ]


def settle(word: str, stem: str) -> str:
    odd = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    return (
        f"CASE WHEN length({word}) <= 2 THEN {word} ELSE CASE {word} {odd} ELSE replace({stem}, 'Y', 'y') END END"
    )


def stem_lists(source: str, name: str) -> str:
    """Materialised CTEs, one per step, that turn (…, words) of `source` into (…, words, stems) as `name`."""
    parts, previous = [], source
    for k, step in enumerate(stem_steps()):
        column = "words" if k == 0 else "stems"
        keep = "*" if k == 0 else "* EXCLUDE (stems)"
        parts.append(
            f"{name}_{k} AS MATERIALIZED (SELECT {keep}, list_transform({column}, lambda w: {step}) AS stems FROM {previous})"
        )
        previous = f"{name}_{k}"
    parts.append(
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE (stems), list_transform(words, lambda w, i: {settle('w', 'stems[i]')}) AS stems"
        f" FROM {previous})"
    )
    return ",\n".join(parts)


def stem_words_table(source: str, name: str) -> str:
    """Materialised CTEs, one per step, that turn (…, word) of `source` into (…, word, stem) as `name`."""
    parts, previous = [], source
    for k, step in enumerate(stem_steps()):
        head = "*, word AS w" if k == 0 else "* EXCLUDE (w0), w0 AS w"
        parts.append(f"{name}_{k} AS MATERIALIZED (SELECT * EXCLUDE (w), {step} AS w0 FROM (SELECT {head} FROM {previous}))")
        previous = f"{name}_{k}"
    parts.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (w0), {settle('word', 'w0')} AS stem FROM {previous})")
    return ",\n".join(parts)


# Naive Bayes over grams(variant, doc_id, label, split, term), one row per occurrence


def lists_for(v: Variant) -> tuple[str, str]:
    """(source CTE, expression of the token list) of a variant."""
    source = {"raw": "corpus", "default": "stemmed", "custom": "corpus"}[v.cleaning]
    text = {
        "raw": "text",
        "default": "array_to_string(stems, ' ')",
        "custom": f"array_to_string({clean_list('text', CUSTOM_STOPWORDS)}, ' ')",
    }[v.cleaning]
    return source, tokens(text)


def grams(variants) -> str:
    parts, extra = [], []
    if any(v.cleaning == "default" for v in variants):
        extra.append(f"cleaned AS (SELECT *, {clean_list('text', ENGLISH_STOPWORDS)} AS words FROM corpus)")
        extra.append(stem_lists("cleaned", "stemmed"))
    for v in variants:
        source, listed = lists_for(v)
        every = pairs("t") if v.high == 2 else "t"
        parts.append(
            f"SELECT '{v.name}' AS variant, doc_id, label, split, unnest({every}) AS term"
            f" FROM (SELECT doc_id, label, split, {listed} AS t FROM {source})"
        )
    extra.append("grams AS (" + "\nUNION ALL ".join(parts) + ")")
    return ",\n".join(extra)


def bayes(variants) -> str:
    floors = " ".join(f"WHEN '{v.name}' THEN {v.min_df}" for v in variants)
    tfidf = words_list([v.name for v in variants if v.weighting == "tfidf"] or ["none"])
    names = ", ".join(f"('{v.name}')" for v in variants)
    return f"""
{CORPUS},
{grams(variants)},
names(variant) AS (VALUES {names}),
tf AS (SELECT variant, doc_id, label, split, term, count(*) AS tf FROM grams GROUP BY ALL),
sizes AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1
          FROM corpus WHERE split = 'train'),
prior AS (SELECT ln(n_0 / n) AS p_0, ln(n_1 / n) AS p_1, n FROM sizes),
dfs AS (SELECT variant, term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY ALL),
idf AS (SELECT variant, term, df,
               CASE WHEN variant IN {tfidf} THEN ln((1 + n) / (1 + df)) + 1 ELSE 1.0::DOUBLE END AS weight
        FROM dfs, prior WHERE df >= CASE variant {floors} END),
raw AS (SELECT tf.*, tf * weight AS x FROM tf JOIN idf USING (variant, term)),
norms AS (SELECT variant, doc_id, CASE WHEN variant IN {tfidf} THEN sqrt(sum(x * x)) ELSE 1.0::DOUBLE END AS norm
          FROM raw GROUP BY variant, doc_id),
w AS (SELECT raw.*, x / norm AS w FROM raw JOIN norms USING (variant, doc_id)),
sums AS (SELECT variant, term, coalesce(sum(w) FILTER (label = 0), 0) AS s_0, coalesce(sum(w) FILTER (label = 1), 0) AS s_1
         FROM w WHERE split = 'train' GROUP BY ALL),
mass AS (SELECT variant, sum(s_0) AS m_0, sum(s_1) AS m_1, count(*) AS v FROM sums GROUP BY variant),
lik AS (SELECT variant, term, ln(s_0 + 1) - ln(m_0 + v) AS l_0, ln(s_1 + 1) - ln(m_1 + v) AS l_1
        FROM sums JOIN mass USING (variant)),
parts AS (SELECT variant, doc_id, sum(w * l_0) AS a_0, sum(w * l_1) AS a_1
          FROM w JOIN lik USING (variant, term) WHERE split = 'test' GROUP BY ALL),
scores AS (SELECT names.variant, c.doc_id, c.label, p_0 + coalesce(a_0, 0) AS score_0, p_1 + coalesce(a_1, 0) AS score_1
           FROM corpus c CROSS JOIN names CROSS JOIN prior LEFT JOIN parts ON parts.doc_id = c.doc_id AND parts.variant = names.variant
           WHERE c.split = 'test'),
predicted AS (SELECT *, CASE WHEN score_1 > score_0 THEN 1 ELSE 0 END AS prediction FROM scores)"""


def _variant(name: str) -> list[Variant]:
    return [v for v in VARIANTS if v.name == name]


def scored(name: str) -> str:
    return f"""WITH {bayes(_variant(name))}
SELECT doc_id, label, round(score_0, 4) AS score_0, round(score_1, 4) AS score_1, prediction FROM predicted"""


def evaluated(body: str) -> str:
    return f"""WITH {bayes(_variant("C1"))},
{REPORT}
{body}"""


REPORT = """classes(label) AS (VALUES (0), (1)),
per_class AS (
  SELECT c.label, c.variant,
         count(*) FILTER (p.label = c.label AND p.prediction = c.label) AS hits,
         count(*) FILTER (p.label = c.label) AS support,
         count(*) FILTER (p.prediction = c.label) AS chosen
  FROM (SELECT * FROM classes CROSS JOIN names) c JOIN predicted p ON p.variant = c.variant GROUP BY c.label, c.variant),
report AS (
  SELECT variant, label, coalesce(hits / nullif(chosen, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
         coalesce(2 * hits / nullif(support + chosen, 0), 0) AS f1, support FROM per_class)"""

LIKELIHOODS = """
SELECT term, 0 AS label, round(l_0, 6) AS log_prob FROM lik
UNION ALL SELECT term, 1, round(l_1, 6) FROM lik"""

TF = f"""WITH {CORPUS},
tf AS (SELECT doc_id, label, term, count(*) AS tf FROM (SELECT doc_id, label, unnest({tokens()}) AS term FROM corpus) GROUP BY ALL)"""
TF_2 = f"""WITH {CORPUS},
tf AS (SELECT doc_id, label, term, count(*) AS tf FROM (
  SELECT doc_id, label, unnest({pairs('t')}) AS term FROM (SELECT doc_id, label, {tokens()} AS t FROM corpus)) GROUP BY ALL)"""

ALL_TF = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens()}) AS term FROM documents) GROUP BY ALL)"""
ALL_TF_2 = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({pairs('t')}) AS term FROM (SELECT doc_id, {tokens()} AS t FROM documents)) GROUP BY ALL)"""

CENTROIDS = """parts AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, dim, avg(x) AS value FROM parts GROUP BY ALL)"""
APART = f"""{CENTROIDS},
apart AS (SELECT p.vec_id, p.label, m.label AS other, sqrt(sum((p.x - m.value) * (p.x - m.value))) AS d
          FROM parts p JOIN means m ON p.dim = m.dim GROUP BY ALL),
nearest AS (SELECT vec_id, label, max(d) FILTER (other = label) AS own, min(d) AS best FROM apart GROUP BY ALL)"""

NEW_TEXTS = f"""WITH {CORPUS},
tf AS (SELECT label, unnest({tokens()}) AS term FROM corpus),
prior AS (SELECT ln(count(*) FILTER (label = 0) / count(*)) AS p_0, ln(count(*) FILTER (label = 1) / count(*)) AS p_1 FROM corpus),
sums AS (SELECT term, count(*) FILTER (label = 0) AS s_0, count(*) FILTER (label = 1) AS s_1 FROM tf GROUP BY term),
mass AS (SELECT sum(s_0) AS m_0, sum(s_1) AS m_1, count(*) AS v FROM sums),
lik AS (SELECT term, ln(s_0 + 1) - ln(m_0 + v) AS l_0, ln(s_1 + 1) - ln(m_1 + v) AS l_1 FROM sums, mass),
fresh AS (SELECT conv_id || '-' || turn AS doc_id, text FROM conversations),
parts AS (SELECT doc_id, sum(l_0) AS a_0, sum(l_1) AS a_1
          FROM (SELECT doc_id, unnest({tokens()}) AS term FROM fresh) JOIN lik USING (term) GROUP BY doc_id)
SELECT f.doc_id, CASE WHEN p_1 + coalesce(a_1, 0) > p_0 + coalesce(a_0, 0) THEN 1 ELSE 0 END AS prediction
FROM fresh f CROSS JOIN prior LEFT JOIN parts USING (doc_id)"""


def text_query(listed: str) -> str:
    return f"SELECT doc_id, len(t)::BIGINT AS n, array_to_string(t, ' ') AS text FROM (SELECT doc_id, {listed} AS t FROM documents)"


def stem_vocabulary() -> str:
    return f"""vocab AS (SELECT word, count(*) AS n FROM (SELECT unnest({clean_list()}) AS word FROM documents) GROUP BY word),
{stem_words_table('vocab', 'stemmed')}"""


def style() -> str:
    lexicon = ", ".join(f"('{c}', '{w}')" for c, ws in STYLE_LEXICON.items() for w in ws)
    return f"""WITH {CORPUS},
texts AS (SELECT lang, label, {tokens()} AS t FROM corpus),
words AS (SELECT lang, label, unnest(t) AS word FROM texts),
lexicon(category, word) AS (VALUES {lexicon}),
totals AS (SELECT lang, label, sum(len(t)) AS tokens FROM texts GROUP BY ALL),
hits AS (SELECT lang, label, category, count(*) AS hits FROM words JOIN lexicon USING (word) GROUP BY ALL),
cells AS (SELECT lang, label, category, tokens FROM totals CROSS JOIN (SELECT DISTINCT category FROM lexicon))
SELECT cells.lang, cells.label, cells.category, coalesce(hits, 0)::BIGINT AS hits, tokens::BIGINT AS tokens,
       coalesce(round(1000.0::DOUBLE * coalesce(hits, 0) / nullif(tokens, 0), 6), 0) AS per_1000
FROM cells LEFT JOIN hits ON cells.lang IS NOT DISTINCT FROM hits.lang AND cells.label IS NOT DISTINCT FROM hits.label
  AND cells.category = hits.category"""


def phrases() -> str:
    return f"""WITH opening AS (SELECT {tokens()} AS t FROM benchmark),
entries AS (
  SELECT 'opening' AS category, array_to_string(t[1:3], ' ') AS phrase FROM opening
  UNION SELECT 'word', t[1] FROM opening UNION SELECT 'ending', array_to_string(t[-2:], ' ') FROM opening),
lexicon AS (SELECT DISTINCT category, phrase FROM entries WHERE phrase IS NOT NULL AND phrase <> ''),
texts AS MATERIALIZED (SELECT lang, source, {tokens()} AS t FROM documents),
runs AS (
  SELECT lang, source, array_to_string(t[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, source, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM texts, (SELECT unnest([1, 2, 3]) AS k))),
hits AS (SELECT lang, source, category, count(*) AS hits FROM runs JOIN lexicon USING (phrase) GROUP BY ALL),
totals AS (SELECT lang, source, sum(len(t))::BIGINT AS tokens FROM texts GROUP BY ALL),
cells AS (SELECT * FROM totals CROSS JOIN (SELECT DISTINCT category FROM lexicon))
SELECT c.lang, c.source, c.category, coalesce(hits, 0)::BIGINT AS hits, tokens,
  coalesce(round(1000.0::DOUBLE * coalesce(hits, 0) / nullif(tokens, 0), 6), 0) AS per_1000
FROM cells c LEFT JOIN hits h ON c.lang IS NOT DISTINCT FROM h.lang AND c.source IS NOT DISTINCT FROM h.source AND c.category = h.category"""


def punctuation() -> str:
    marks = {
        "exclamation": "!",
        "question": r"\?",
        "ellipsis": r"\.\.\.|…",
        "quote": '["“”«»]',
    }
    counts = {name: f"len(regexp_extract_all(text, '{p}'))" for name, p in marks.items()}
    counts["all_caps"] = (
        r"len(list_filter(regexp_extract_all(text, '\p{L}{2,}'), lambda w: regexp_matches(w, '^\p{Lu}+$')))"
    )
    inner = ", ".join(f"{c} AS {name}" for name, c in counts.items())
    outer = ", ".join(
        f"sum({name})::BIGINT AS {name}, round(avg({name}), 6) AS {name}_per_text" for name in counts
    )
    return f"""WITH {CORPUS}
SELECT label, count(*) AS n, {outer} FROM (SELECT label, {inner} FROM corpus) GROUP BY label"""


def linear_head() -> str:
    scores = ", ".join(
        f"sum(x * ((7 * dim + 13 * {c}) % 11 - 5) / 10.0::DOUBLE) AS s_{c}" for c in range(3)
    )
    return f"""WITH {CENTROIDS}, scores AS (SELECT vec_id, {scores} FROM parts GROUP BY vec_id)
SELECT vec_id, round(s_0, 6) AS score_0, round(s_1, 6) AS score_1, round(s_2, 6) AS score_2,
       CASE WHEN s_0 >= s_1 AND s_0 >= s_2 THEN 0 WHEN s_1 >= s_2 THEN 1 ELSE 2 END AS prediction
FROM scores"""


SQUARINGS = 12


def leading(source: str, name: str) -> str:
    """CTEs that end in <name>(dim, v): the leading eigenvector of source(i, j, v), by repeated squaring.

    The 4096th power of a matrix is its leading direction, many digits exact
    unless the next value is within a thousandth of the first.
    """
    steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {source}) AS v FROM {source})"]
    for k in range(SQUARINGS):
        steps.append(f"{name}_p{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k} a JOIN {name}_{k} b ON a.j = b.i GROUP BY ALL)")
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {name}_p{k}) AS v FROM {name}_p{k})")
    last = f"{name}_{SQUARINGS}"
    steps.append(f"{name}_c AS (SELECT i AS dim, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j))")
    steps.append(
        f"{name} AS MATERIALIZED (SELECT dim, v / (SELECT sqrt(sum(v * v)) FROM {name}_c)"
        f" * (SELECT sign(arg_max(v, abs(v))) FROM {name}_c) AS v FROM {name}_c)"
    )
    return ",\n".join(steps)


def points() -> str:
    return f"""WITH {CENTROIDS},
centre AS (SELECT dim, avg(x) AS m FROM parts GROUP BY dim),
apart_of AS MATERIALIZED (SELECT vec_id, label, p.dim, x - m AS x FROM parts p JOIN centre c ON p.dim = c.dim),
cov AS MATERIALIZED (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) AS v FROM apart_of a JOIN apart_of b ON a.vec_id = b.vec_id GROUP BY ALL),
{leading("cov", "one")},
size_of AS (SELECT sum(a.v * c.v * b.v) AS s FROM cov c JOIN one a ON a.dim = c.i JOIN one b ON b.dim = c.j),
rest AS MATERIALIZED (SELECT i, j, c.v - s * a.v * b.v AS v FROM cov c JOIN one a ON a.dim = c.i JOIN one b ON b.dim = c.j, size_of),
{leading("rest", "two")}
SELECT vec_id, label, round(sum(x * one.v), 4) AS x, round(sum(x * two.v), 4) AS y
FROM apart_of p JOIN one ON one.dim = p.dim JOIN two ON two.dim = p.dim GROUP BY vec_id, label"""


def model_comparison() -> str:
    variants = crossed()
    factors = ", ".join(f"('{v.name}', '{v.cleaning}', {v.high}, {v.min_df})" for v in variants)
    return f"""WITH {bayes(variants)},
{REPORT},
totals AS (SELECT variant, count(*) AS n, avg((label = prediction)::INT) AS accuracy FROM predicted GROUP BY variant),
factors(variant, cleaning, high, min_df) AS (VALUES {factors}),
shown AS (
  SELECT variant, n, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1
  FROM report JOIN totals USING (variant) WHERE label = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY shown.f1 DESC, shown.accuracy DESC, variant)::INTEGER AS rank FROM shown),
best AS (SELECT doc_id, label = prediction AS hit FROM predicted JOIN ranked USING (variant) WHERE rank = 1),
paired AS (
  SELECT variant, count(*) FILTER (hit AND label <> prediction) AS worse, count(*) FILTER (NOT hit AND label = prediction) AS better
  FROM predicted JOIN best USING (doc_id) GROUP BY variant)
SELECT variant, cleaning, high, min_df, rank, n, accuracy, precision, recall, f1, worse, better,
  CASE WHEN worse + better = 0 THEN 0.0::DOUBLE ELSE round(greatest(abs(worse - better) - 1, 0)::DOUBLE ** 2 / (worse + better), 4) END AS chi2
FROM ranked JOIN factors USING (variant) JOIN paired USING (variant)"""


# All entries are fractions of powers of two, so sums are exact.
NETWORK = f"""ids AS (
  SELECT doc_id, list_concat([1::BIGINT],
    list_transform({tokens()}[1:127], lambda w: ('0x' || left(md5(w), 8))::BIGINT % 30000 + 2)) AS ids FROM documents),
entries AS (
  SELECT doc_id, len(ids)::INT AS n_ids, dim, ((2 * dim + 3 + 7 * dim) % 31 - 15) / 16.0::DOUBLE AS own,
    list_sum(list_transform(ids, lambda t: (t * (2 * dim + 3) + 7 * dim) % 31 - 15))::DOUBLE / 16 AS total
  FROM ids, (SELECT unnest(range(8))::INT AS dim) d)"""


def network_scores() -> str:
    heads = ", ".join(f"sum((own + total / 128) * ((7 * dim + 13 * {c}) % 11 - 5) / 8.0::DOUBLE) AS s_{c}" for c in range(3))
    return f"""WITH {NETWORK}, scores AS (SELECT doc_id, any_value(n_ids) AS n_ids, {heads} FROM entries GROUP BY doc_id)
SELECT doc_id, n_ids, s_0 AS score_0, s_1 AS score_1, s_2 AS score_2,
       CASE WHEN s_0 >= s_1 AND s_0 >= s_2 THEN 0 WHEN s_1 >= s_2 THEN 1 ELSE 2 END AS prediction
FROM scores"""


def statements() -> dict[str, str]:
    new = NEW_TEXTS
    return {
        "split_counts": f"SELECT {SPLIT} AS split, toxic AS label, count(*) AS n FROM labels GROUP BY ALL",
        "csv_round_trip": "SELECT doc_id, text FROM documents",
        "project_text_label": f"WITH {CORPUS} SELECT doc_id, text, label FROM corpus",
        "filter_class": f"WITH {CORPUS} SELECT doc_id, text FROM corpus WHERE label = 1",
        "encode_label": f"""WITH {WRITTEN} SELECT doc_id, written,
            CASE written WHEN 'not toxic' THEN 0 WHEN 'toxic' THEN 1 END AS label FROM written""",
        "null_text_to_empty": f"""WITH {WRITTEN} SELECT doc_id,
            coalesce(written, '') AS text FROM written""",
        "drop_null_pairs": f"WITH {WRITTEN} SELECT doc_id, written FROM written WHERE text IS NOT NULL AND written IS NOT NULL",
        "head_rows": f"WITH {CORPUS} SELECT doc_id, text, label FROM corpus ORDER BY doc_id LIMIT 5",
        "class_balance": """SELECT toxic AS label, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total,
            round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY toxic""",
        "corpus_profile": f"""WITH {CORPUS}, m AS (SELECT label, text, length(text)::INT AS chars, len({tokens()})::INT AS words FROM corpus)
            SELECT label, count(*) AS n, count(*) FILTER (text IS NULL) AS n_null, min(chars) AS min_chars,
            round(avg(chars), 4) AS avg_chars, max(chars) AS max_chars, min(words) AS min_words,
            round(avg(words), 4) AS avg_words, max(words) AS max_words FROM m GROUP BY label""",
        "strip_punctuation": f"SELECT doc_id, {stripped()} AS text FROM documents",
        "split_words": text_query(f"regexp_extract_all(coalesce(text, ''), '{NON_SPACE}')"),
        "remove_stopwords_default": text_query(clean_list("text", ENGLISH_STOPWORDS)),
        "remove_stopwords_custom": text_query(clean_list("text", CUSTOM_STOPWORDS)),
        "stem_vocabulary": f"WITH {stem_vocabulary()} SELECT word, n, stem FROM stemmed",
        "stem_families": f"""WITH {stem_vocabulary()}
            SELECT stem, count(*) AS words, sum(n)::BIGINT AS n, min(length(word))::INT AS shortest FROM stemmed GROUP BY stem""",
        "clean_text_default": f"""WITH source AS (SELECT doc_id, {clean_list('text', ENGLISH_STOPWORDS)} AS words FROM documents),
            {stem_lists('source', 'stemmed')} SELECT doc_id, array_to_string(stems, ' ') AS text FROM stemmed""",
        "clean_text_custom": f"SELECT doc_id, array_to_string({clean_list('text', CUSTOM_STOPWORDS)}, ' ') AS text FROM documents",
        "tokenize_words": text_query(tokens()),
        "ngrams_1_2": f"SELECT doc_id, unnest({pairs('t')}) AS term FROM (SELECT doc_id, {tokens()} AS t FROM documents)",
        "truncate_tokens": text_query(f"{tokens()}[1:128]"),
        "vocabulary": f"{ALL_TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
        "vocabulary_min_df": f"{ALL_TF_2} SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3",
        "term_counts": f"{ALL_TF} SELECT doc_id, term, tf FROM tf",
        "term_counts_known": f"""{TF}, known AS MATERIALIZED (SELECT DISTINCT term FROM tf WHERE doc_id % 5 <> 0)
            SELECT doc_id, term, tf FROM tf JOIN known USING (term) WHERE doc_id % 5 = 0""",
        "term_totals": f"{ALL_TF} SELECT term, sum(tf)::BIGINT AS n FROM tf GROUP BY term",
        "top_words_in_class": f"""{TF} SELECT term, sum(tf)::BIGINT AS n FROM tf
            WHERE label = 1 AND term NOT IN {words_list(matchable(ENGLISH_STOPWORDS))}
            GROUP BY term ORDER BY n DESC, term LIMIT 30""",
        "idf_weights": f"""{ALL_TF} SELECT term, count(*) AS df,
            round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS weight FROM tf GROUP BY term""",
        "tfidf_l2": f"""{ALL_TF}, idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS weight FROM tf GROUP BY term),
            raw AS (SELECT doc_id, term, tf * weight AS x FROM tf JOIN idf USING (term)),
            norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY doc_id)
            SELECT doc_id, term, round(x / norm, 6) AS value FROM raw JOIN norms USING (doc_id)""",
        "nb_priors": f"""WITH {bayes(_variant('C1'))} SELECT 0 AS label, n_0 AS n, round(p_0, 6) AS log_prior FROM sizes, prior
            UNION ALL SELECT 1, n_1, round(p_1, 6) FROM sizes, prior""",
        "nb_likelihoods": f"WITH {bayes(_variant('C1'))} {LIKELIHOODS}",
        "nb_likelihoods_tfidf": f"WITH {bayes(_variant('C3'))} {LIKELIHOODS}",
        "nb_predict_counts": scored("C1"),
        "nb_predict_bigrams": scored("C2"),
        "nb_predict_tfidf": scored("C3"),
        "nb_ml_pipeline": f"WITH {bayes(_variant('C1'))} SELECT doc_id, label, prediction FROM predicted",
        "variant_metrics": f"""WITH {bayes(VARIANTS)},
            {REPORT},
            totals AS (SELECT variant, count(*) AS n, avg((label = prediction)::INT) AS accuracy FROM predicted GROUP BY variant)
            SELECT variant, n, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall,
            round(f1, 4) AS f1 FROM report JOIN totals USING (variant) WHERE label = 1""",
        "model_comparison": model_comparison(),
        "classify_new_texts": new,
        "classify_new_texts_stream": new,
        "batch_score_vectors": linear_head(),
        "score_texts": network_scores(),
        "embed_texts": f"WITH {NETWORK} SELECT doc_id, dim, own + total / 128 AS value FROM entries",
        "embed_texts_mean": f"WITH {NETWORK} SELECT doc_id, dim, (total + n_ids * (total / 128)) / n_ids AS value FROM entries",
        "embedding_profile": """SELECT label, count(*) AS n, min(len(embedding))::INT AS min_width, max(len(embedding))::INT AS max_width,
            round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm
            FROM embeddings GROUP BY label""",
        "accuracy": evaluated("SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM predicted"),
        "confusion_matrix": evaluated("""SELECT a.label, b.label AS prediction,
            (SELECT count(*) FROM predicted p WHERE p.label = a.label AND p.prediction = b.label) AS n FROM classes a, classes b"""),
        "class_report": evaluated("""SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall,
            round(f1, 4) AS f1, support FROM report"""),
        "report_averages": evaluated("""SELECT 'macro' AS average, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall,
            round(avg(f1), 4) AS f1, sum(support)::BIGINT AS support FROM report
            UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 4),
            round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM report"""),
        "sample_fixed": "SELECT doc_id, source, n_chars FROM documents ORDER BY md5(concat(doc_id, '-42')), doc_id LIMIT 100",
        "sample_stratified": """WITH sizes AS (SELECT toxic AS label, count(*) AS size, sum(count(*)) OVER () AS total FROM labels GROUP BY toxic),
            shares AS (SELECT *, floor(least(100, total) * size / total) AS whole,
                       least(100, total) * size / total - floor(least(100, total) * size / total) AS rest FROM sizes),
            quotas AS (SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY round(rest, 9) DESC, label)
                       <= least(100, total) - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
            ranked AS (SELECT doc_id, toxic AS label,
                       row_number() OVER (PARTITION BY toxic ORDER BY md5(concat(doc_id, '-42')), doc_id) AS place FROM labels)
            SELECT doc_id, label FROM ranked JOIN quotas USING (label) WHERE place <= quota""",
        "points_2d": points(),
        "dense_counts": f"""{ALL_TF}, top AS (SELECT term, row_number() OVER (ORDER BY n DESC, term)::INT - 1 AS at
              FROM (SELECT term, sum(tf) AS n FROM tf GROUP BY term) QUALIFY row_number() OVER (ORDER BY n DESC, term) <= 30)
            SELECT d.doc_id, top.at, coalesce(tf.tf, 0)::DOUBLE AS value
            FROM documents d CROSS JOIN top LEFT JOIN tf ON tf.doc_id = d.doc_id AND tf.term = top.term""",
        "embedding_covariance": f"""WITH {CENTROIDS}
            SELECT a.dim::INT AS i, b.dim::INT AS j, round(covar_samp(a.x, b.x), 8) AS value
            FROM parts a JOIN parts b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL""",
        "class_centroids": f"WITH {CENTROIDS} SELECT label, dim::INT AS dim, round(value, 6) AS value FROM means",
        "class_dispersion": f"""WITH {APART} SELECT label, count(*) AS n, round(avg(own), 6) AS mean_distance,
            round(max(own), 6) AS max_distance FROM nearest GROUP BY label""",
        "centroid_distances": f"""WITH {CENTROIDS} SELECT a.label AS label_a, b.label AS label_b,
            round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 6) AS distance
            FROM means a JOIN means b ON a.dim = b.dim AND a.label < b.label GROUP BY ALL""",
        "mixed_region": f"""WITH {APART} SELECT label, count(*) AS n, count(*) FILTER (best < own) AS n_mixed,
            round(avg((best < own)::INT), 6) AS share FROM nearest GROUP BY label""",
        "discriminative_words": f"""WITH {bayes(_variant('C1'))}, margins AS (SELECT term, l_1 - l_0 AS margin FROM lik)
            (SELECT 1 AS label, term, round(margin, 6) AS margin FROM margins ORDER BY round(margins.margin, 9) DESC, term LIMIT 20)
            UNION ALL
            (SELECT 0 AS label, term, round(margin, 6) AS margin FROM margins ORDER BY round(margins.margin, 9), term LIMIT 20)""",
        "top_ngrams_by_class": f"""{TF_2}, n AS (SELECT label, term, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
            r AS (SELECT label, term, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, term)::INT AS rank FROM n)
            SELECT label, term, n, rank FROM r WHERE rank <= 20""",
        "lexical_difference": f"""{TF}, s AS (SELECT term, coalesce(sum(tf) FILTER (label = 0), 0)::BIGINT AS n_0,
              coalesce(sum(tf) FILTER (label = 1), 0)::BIGINT AS n_1, count(*) FILTER (label = 0) AS docs_0,
              count(*) FILTER (label = 1) AS docs_1 FROM tf GROUP BY term),
            m AS (SELECT count(*) AS v, sum(n_0)::DOUBLE AS m_0, sum(n_1)::DOUBLE AS m_1 FROM s),
            z AS (SELECT count(*) FILTER (label = 0) AS z_0, count(*) FILTER (label = 1) AS z_1 FROM corpus)
            SELECT term, n_0, n_1, round(n_0 / m_0, 8) AS rate_0, round(n_1 / m_1, 8) AS rate_1,
            round(ln(((n_1 + 1) / (m_1 + v)) / ((n_0 + 1) / (m_0 + v))), 8) AS log_ratio,
            round(docs_0 / z_0, 8) AS presence_0, round(docs_1 / z_1, 8) AS presence_1 FROM s, m, z""",
        "style_lexicon_rates": style(),
        "lexicon_phrase_rates": phrases(),
        "punctuation_patterns": punctuation(),
    }
