"""The training-data operators against plain versions of themselves, on rows of every awkward kind."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexitally.llm import bit_sliced, bpe, components, packing, pseudonyms, quality, queries, secrets, sharding, simhash, substrings, url_filter

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[i * i % 397] + str(i) for i in range(5000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one two three",
    "ONE two  three",
    LONG,
    "before " + LONG[2000:9000] + " after",
    LONG,
    "key: api_key = 'Abc123xyz' AKIA" + "Q" * 20 + " " + "0af9" * 8 + " é\U0001f600 password=short secret: longer+than/six",
    "call (212) 555-1234 on 1999-12-31 or 31.12.1999, 4111 1111 1111 1111, 123-45-6789, a.b9@x.org, 10.1.2.3",
    "a b c d e " * 30 + "\nsame line\nsame line\n# * $ % & | < >",
    "日本語 \x1c ½ \u0301 ＡＢ <|endoftext|> \x85x",
]
ROWS = [(i, t, "en" if i % 3 else None, "x", -i, "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "x", 0, "y")]
SCHEMA = "doc_id bigint, text string, lang string, n_words string, _uid int, `a b` string"
LABELS = "doc_id bigint, quality int, toxic int, split string, extra string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def tables(awkward, given):
    return [awkward, given]


def texts(docs):
    """(doc_id, text) with null as empty."""
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def sha(data):
    return hashlib.sha256(data).hexdigest()


SECRET_RULES = [
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "assign", 1, 6),
    ("AKIA[A-Z0-9]+", "access", 0, 20),
    ("[0-9a-f]+", "hex", 0, 24),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "private_key", 0, 1),
    ("gh[pousr]_[A-Za-z0-9]{36}", "forge_token", 0, 1),
    ("xox[abprs]-[A-Za-z0-9-]{10,}", "chat_token", 0, 1),
    (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "web_token", 0, 1),
]
SECRETS = [
    "-----BEGIN RSA PRIVATE KEY----- x -----BEGIN PRIVATE KEY-----",
    "ghp_" + "a1" * 18 + " ghx_" + "a1" * 18 + " gho_" + "Z" * 37,
    "xoxb-1234567890-abc xoxz-1234567890 xoxp-short",
    "eyJ" + "a" * 8 + ".eyJ" + "b" * 9 + "." + "c" * 10 + " xeyJ" + "a" * 8 + ".eyJ" + "b" * 9 + "." + "c" * 10,
    "é token = " + "k" * 6 + " AKIA" + "A" * 16 + "\n" + "0af9" * 6 + " TOKEN:short passwd='longer_than_six'" * 3,
    None,
]


def plain_secrets(text):
    """All spans by start, then rule."""
    return sorted(
        (m.start(), i, m.end(), kind)
        for i, (pattern, kind, group, least) in enumerate(SECRET_RULES)
        for m in re.finditer(pattern, text, re.ASCII)
        if len(m.group(group)) >= least
    )


def test_secrets(spark, tables):
    planted = spark.createDataFrame([(i % 4 or None, t) for i, t in enumerate(SECRETS * 2)], "doc_id bigint, text string")
    written = lambda spans: ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in spans)
    for docs in [*tables, planted]:
        wanted = []
        for doc, text in texts(docs):
            spans = plain_secrets(text)
            counts = Counter(s[1] for s in spans)
            base = written(s for s in spans if s[1] < 3)
            wanted.append((doc, counts[0], counts[1], counts[2], sha(base.encode()), written(spans)))
        found = secrets.secret_report(docs)
        columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(wanted, key=str)


def test_many_secrets_in_one_text(spark):
    """Spans of a text of very many matches, and starts that would be read again and again."""
    many = " ".join(["0123456789abcdef" * 2, "token=abcdefgh"] * 20_000)
    docs = spark.createDataFrame([(1, many), (2, "eyJ" * 100_000), (3, "eyJaaaaaaaa." * 30_000)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
    assert (found[1].n_hex, found[1].n_assign) == (20_000, 20_000)
    assert found[1].spans == ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in plain_secrets(many))
    assert found[2].spans == "" and found[3].spans == ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in plain_secrets("eyJaaaaaaaa." * 30_000))


def test_running_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(rng.integers(0, 9, n).tolist(),) for n in (0, 1, 2, 127, 128, 129, 256, 1000)]
    frame = spark.createDataFrame(rows, "x array<bigint>").select("x", secrets.running_sums(F.col("x")).alias("s"))
    for r in frame.collect():
        assert r.s == np.cumsum(r.x).tolist()


def test_trigram_queries():
    """Every match of a pattern meets the pattern's query; a pattern without long strings asks for nothing."""
    assert secrets.trigram_query("[0-9a-f]+") == [] and secrets.trigram_query("a.c|xyz") == []
    assert secrets.trigram_query("abcd") == [[frozenset({"abc", "bcd"})]]
    assert sorted(map(sorted, secrets.trigram_query("(?:abc|xyz)[0-9]+"  "")[0])) == [["abc"], ["xyz"]]
    for pattern, kind, *_ in SECRET_RULES:
        query = secrets.trigram_query(next(r.pattern for r in secrets.RULES if r.kind == kind))
        for text in [*filter(None, SECRETS), *filter(None, TEXTS)]:
            for m in re.finditer(pattern, text, re.ASCII):
                held = secrets.trigrams(m.group().lower())
                assert all(any(grams <= held for grams in clause) for clause in query)


def test_shards(tables):
    for docs in tables:
        first, size = {}, Counter()
        for doc, text in texts(docs):
            first[text] = min(first.get(text, doc), doc)
            size[text] += len(text.encode()) + 8
        sizes = [size[t] for t in sorted(first, key=first.get)]

        def enough(capacity):
            used, room = 1, capacity
            for s in sizes:
                if s > room:
                    used, room = used + 1, capacity
                room -= s
            return room >= 0 and used <= 5

        smallest = next(c for c in range(max(sizes), sum(sizes) + 1) if enough(c))
        for cells in (sharding.CELLS, 3):
            rows = sharding.shard_documents(docs, 5, cells).toPandas()
            assert len(rows) == docs.count()
            assert rows.groupby("shard")["size"].sum().max() == smallest
            for _, part in rows.groupby("shard"):
                assert sorted(part["slot"]) == list(range(len(part)))
            of_text = {d: t for d, t in texts(docs)}
            assert rows.assign(t=rows.doc_id.map(of_text)).groupby("t").shard.nunique().max() == 1
            assert all(zlib.crc32(of_text[d].encode()) == c for d, c in zip(rows.doc_id, rows.text_crc32))


@pytest.mark.parametrize("seed, n, share, place", [(1, 300_000, 0.2, 0.5), (2, 300_000, 0.2, 0.02), (3, 50_000, 0.0, 0), (4, 5_000, 0.9, 0.9), (5, 7, 0.5, 0)])
def test_cuts_fetch_few_ends(monkeypatch, seed, n, share, place):
    """The exact capacity with few ends on the driver, also where one group is larger than a shard."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(9, 4000, n)
    if share:
        sizes[int(place * n)] = int(sizes.sum() * share / (1 - share))
    ends = np.cumsum(sizes)
    fetched = []

    def fetch(_, windows, width):
        inside = np.zeros(n, dtype=bool)
        for a, b in windows:
            inside |= (ends >= a) & (ends <= b)
        rows = np.flatnonzero(inside)
        rows = rows[np.append(np.diff(ends[rows] // width) > 0, True)] if len(rows) else rows
        fetched.append(len(rows))
        return np.stack([ends[rows], rows + 1], axis=1)

    monkeypatch.setattr(sharding, "_fetch", fetch)
    cuts = sharding.find_cuts(None, int(ends[-1]), 24, cells=20_000, largest=int(sizes.max()))
    assert max(fetched) <= 20_000 + 2 * 24
    largest = max(b - a for a, b in zip([0, *[c for c, _ in cuts]], [c for c, _ in cuts]))
    low, high = int(sizes.max()), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sharding.greedy(ends, middle, 24)[-1] == ends[-1] else (middle + 1, high)
    assert largest == low and cuts[-1][0] == ends[-1]


@pytest.mark.parametrize("heavy", [components.HEAVY, 3])
def test_components(spark, monkeypatch, heavy):
    """Paths, hubs, cliques, loops and repeated edges, over several tasks, with hubs split and not split."""
    monkeypatch.setattr(components, "HEAVY", heavy)
    monkeypatch.setattr(components, "CHUNK", 50)
    rng = np.random.default_rng(11)
    edges = [(i, i + 1) for i in range(-200, 300)] + [(1000, 1000 + i) for i in range(300)] + [(5000 + i, 5000) for i in range(50)]
    edges += [(int(a), int(b)) for a, b in rng.integers(10_000, 10_400, (300, 2))] + [(7, 7), (1000, 1001)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)
    found = components.components(frame).collect()
    assert len(found) == len(linked) and {r.node: r.root for r in found} == {x: find(x) for x in linked}
    assert components.components(frame.limit(0)).collect() == []


def test_layout_of_segments():
    """However many fingerprints: at least two segments, few values asked for, and no link can be missed."""
    for count in (1, 2, 10**3, 2**21, 2**22, 2**32, 2 * 10**10, 2**60):
        layout = simhash.segments(count, 4)
        assert len(layout) >= 2
        assert sum(len(simhash._ball(width, radius)) for _, width, radius in layout) <= 600
        for cut in range(6):
            # Any 4 differing bits leave some segment within its radius.
            bits = np.random.default_rng(cut).choice(64, 4, replace=False)
            assert any(sum(at <= b < at + width for b in bits) <= radius for at, width, radius in layout)


def test_small_examples_fill_sequences(spark):
    """Very short documents: no limit of segments leaves a sequence half empty."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text")).coalesce(1)
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    used = [r.used for r in rows.groupBy("sequence_id").agg(F.sum("length").alias("used")).collect()]
    assert sum(used) == 45_000
    assert all(u == 4096 or u & (u - 1) == 0 for u in used)


def test_packer_keeps_every_limit():
    """Tokens, segments and loss-bearing tokens of each sequence; nothing is lost or cut where that is not allowed."""
    rng = np.random.default_rng(8)
    for limits, cut in (((100, 5, 40), True), ((100, 5, 40), False), ((64, 64, 64), True), ((100, 1, 100), False)):
        packer = packing.Packer(limits, cut, buffer=16)
        examples = [(int(t), int(min(t, l))) for t, l in zip(rng.integers(1, 60 if not cut else 300, 400), rng.integers(0, 41, 400))]
        placed = [p for i, (t, l) in enumerate(examples) for p in packer.add(i, t, l)] + list(packer.finish())
        used = {}
        for key, start, length, sequence, offset in placed:
            tokens, loss = examples[key]
            row = used.setdefault(sequence, [0, 0, 0])
            assert row[0] == offset
            row[0] += length
            row[1] += 1
            row[2] += max(0, start + length - max(start, tokens - loss))
        assert all(a <= b for row in used.values() for a, b in zip(row, limits))
        for i, (tokens, _) in enumerate(examples):
            mine = sorted((s, n) for k, s, n, *_ in placed if k == i)
            assert sum(n for _, n in mine) == tokens and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:]))
            assert cut or len(mine) == 1
    with pytest.raises(ValueError):
        list(packing.Packer((10, 5, 10), False).add(0, 11, 1))


def test_quality(spark, tables):
    labels = spark.createDataFrame([], LABELS)
    for docs in tables:
        wanted = []
        for doc, text in texts(docs):
            words = WORD.findall(text)
            windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
            often = Counter(windows)
            covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
            lines = [x for x in text.split("\n") if WORD.search(x)]
            failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
            symbols = sum(text.count(s) for s in "#*$%&|<>")
            n_dup = len(lines) - len(set(lines))
            wanted.append((doc, len(words), sum(map(len, words)), symbols, n_dup, len(covered), failed, not failed))
        assert sorted(map(tuple, quality.quality_report(docs, labels).collect())) == sorted(wanted)


def test_cutoffs_hold_their_risk(spark, given):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    cutoffs = quality.fit_cutoffs(quality.measured(given), labels)
    assert {"stratum", "rule", "cutoff"} <= set(cutoffs.columns)
    good = quality.quality_report(given, labels).join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    left = good.where("NOT base_failed")
    assert left.where("NOT kept").count() <= quality.Risk().share * left.count()


def test_cutoffs_of_planted_labels(spark):
    """One stratum with labels enough for a cutoff, one with too few, one whose good texts are full of symbols."""
    from fractions import Fraction
    from math import comb

    def text(i, symbols):
        return " ".join(f"{k}x{i % 700}" + "#" * (symbols // 40 + (k < symbols % 40)) for k in range(40))

    rng = np.random.default_rng(9)
    planted = []  # (stratum, symbols, quality)
    planted += [("en", int(s), 1) for s in rng.choice([0, 1, 3, 9], 4000, p=[0.9, 0.0975, 0.002, 0.0005])]
    planted += [("fr", 0, 1)] * 200 + [("de", int(s), 1) for s in rng.integers(0, 60, 2500)]
    planted += [(g, 50, 0) for g in ("en", "fr", "de") for _ in range(300)] + [(None, 60, 1)] * 3
    docs = spark.createDataFrame([(i, text(i, s), g) for i, (g, s, _) in enumerate(planted)], "doc_id bigint, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(planted)], "doc_id bigint, quality int")
    risk = quality.Risk()
    strata = {g for g, _, _ in planted}
    share = Fraction(2, 100) / len(risk.rules)
    tests = sum(len(r.cutoffs) for r in risk.rules) * len(strata)
    wanted = {}
    for g in strata:
        good = [s for h, s, q in planted if h == g and q == 1]
        n = len(good)
        for rule in risk.rules:
            for cutoff in rule.cutoffs:
                # No words or lines repeat, and words are shorter than any cutoff.
                k = sum(s / 40 > cutoff for s in good) if rule.name == "symbols" else 0
                tail = sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) if k < n * share else 1
                if tail * tests <= Fraction(5, 100):
                    wanted[g, rule.name] = min(cutoff, wanted.get((g, rule.name), cutoff))
    found = {(r.stratum, r.rule): r.cutoff for r in quality.fit_cutoffs(quality.measured(docs), labels).collect()}
    assert found == wanted
    assert ("en", "symbols") in found and not any(g in ("fr", None) for g, _ in found) and ("de", "symbols") not in found
    kept = {r.doc_id: r.kept for r in quality.quality_report(docs, labels).collect()}
    for i, (g, s, _) in enumerate(planted):
        assert kept[i] == (g != "en" or s / 40 <= found["en", "symbols"])
    gone = [i for i, (g, _, q) in enumerate(planted) if not kept[i]]
    assert sum(planted[i][2] == 0 for i in gone) == 300
    assert sum(planted[i][2] == 1 for i in gone) <= 0.02 * 4000
    rows = quality.keep_good(docs, labels)
    assert rows.columns == docs.columns and rows.count() == len(planted) - len(gone)


def test_binomial_tail(spark):
    from math import comb

    for k, n, p in [(0, 10, 0.1), (2, 100, 0.05), (30, 1000, 0.05)]:
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        row = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), F.lit(p)).alias("t"))
        assert exact - 1e-12 <= row.first().t <= exact * 1.001


def test_packing(tables):
    path = public_tokenizers.path("word_bpe_49k.json")
    reader = Tokenizer.from_file(path)
    for docs in tables:
        ids = {d: packing.pack(reader.encode(t, add_special_tokens=False).ids + [2]) for d, t in texts(docs)}
        rows = packing.pack_documents(docs, path).toPandas()
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
            assert r.doc_tokens == len(ids[r.doc_id]) // 4
        copies = Counter(d for d, _ in texts(docs))
        assert rows.groupby("doc_id").length.sum().to_dict() == {d: len(i) // 4 * copies[d] for d, i in ids.items()}
        rows = rows.sort_values(["sequence_id", "offset"])
        by = rows.groupby("sequence_id").length
        assert (rows.offset == by.cumsum() - rows.length).all() and by.sum().max() <= 4096


def awkward_texts(count):
    rng = random.Random(4)
    signs = [*"aB.,'sS \n\t1éÉßÀµªº\xa0\x85!-_#%×÷½²\x1c\x0b\0", "<|endoftext|>", "<|EndOfText|>", "<|", "İ", "Σ", "œ", "e\u0301", "\u0301", ". ", ", ", "'LL", "###"]
    made = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(count)]
    return made + [chr(c) + d + e for c in range(400) for d in ".,#a1'" for e in ("", " ", "a", ".")]


@pytest.mark.parametrize("kept", [5, packing.WORDS_KEPT])
def test_words_stand_alone(monkeypatch, kept):
    """Case, signs, added tokens and other white space; whatever the cache holds."""
    monkeypatch.setattr(packing, "WORDS_KEPT", kept)
    reader = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = packing.Words(reader)
    for text in awkward_texts(10_000):
        assert packing.tokens_of(text, words, 2) == packing.pack([*reader.encode(text, add_special_tokens=False).ids, 2]), ascii(text)


def test_words_share_entries(monkeypatch):
    """Other case and signs next to a word need no entry; a word in use outlives a full cache."""
    words = packing.Words(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    packing.tokens_of("Über über, ÜBER. über\nüber, Über###", words, 2)
    assert set(words) == {"über", ",", ".", "###", "über###"}
    model, asked = words.model, Counter()

    class Watched:
        def tokenize(self, word):
            asked[word] += 1
            return model.tokenize(word)

    words.model = Watched()
    monkeypatch.setattr(packing, "WORDS_KEPT", 20)
    letters = "abcdefghijklmnop"
    for a in letters:
        packing.tokens_of(" ".join(f"frequent {a}{b}" for b in letters), words, 2)
    assert asked["frequent"] == 1 and len(words) <= 20 and len(words.older) <= 20


def without_repeats(rows, window=50):
    first = {}
    words = [(d, WORD.findall(t)) for d, t in rows]
    for d, ws in words:
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            first[key] = min(first.get(key, d), d)
    for d, ws in words:
        gone = {i + k for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] < d for k in range(window)}
        yield d, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone).encode())


def test_passages(tables, monkeypatch):
    for docs in tables:
        wanted = sorted(without_repeats(texts(docs)))
        for group, heavy in ((substrings.GROUP, substrings.HEAVY), (2, substrings.HEAVY), (2, 20), (2, 1)):
            monkeypatch.setattr(substrings, "HEAVY", heavy)
            assert sorted(map(tuple, substrings.repeat_report(docs, group=group).collect())) == wanted


def test_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4], "x") for i in range(0, 300)]
    # Rows that share an id with a query, with the same and with another vector.
    rows += [(50, rows[50][1], "x"), (50, rows[51][1], "x"), (7, rows[7][1], "x")]
    bad = [(50, None, "x"), (51, [float("nan")] * 5, "x"), (100, [None] * 5, "x"), (None, [1.0] * 5, "x"), (7, [float("inf")] * 5, "x")]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, score string")
    ids = np.array([r[0] for r in rows])
    v = np.floor(256 * np.array([r[1] for r in rows])).astype(int)
    wanted = []
    for q in np.flatnonzero(ids % 50 == 0):
        scores = v @ v[q]
        best = [j for j in np.lexsort((ids, -scores)) if j != q][:5]
        wanted += [(int(ids[q]), k + 1, int(ids[j]), int(scores[j])) for k, j in enumerate(best)]
    for block in (bit_sliced.BLOCK, 64):
        assert sorted(map(tuple, bit_sliced.top_k(frame, block=block).collect())) == sorted(wanted)


def test_pseudonyms(tables):
    for docs in tables:
        hidden = pseudonyms.pseudonymise(docs, "key", counts=False)
        assert hidden.columns == docs.columns
        back = pseudonyms.pseudonymise(hidden, "key", undo=True, counts=False)
        pick = ["doc_id", "text"]
        assert sorted(back.select(pick).collect(), key=repr) == sorted(docs.select(pick).collect(), key=repr)
    before, after = TEXTS[9], pseudonyms.pseudonymise(tables[0].where("doc_id = 9"), "key", counts=False).first().text
    assert "4111 1111 1111 1111" not in after and "a.b9@x.org" not in after and "1999-12-31" not in after
    assert len(before) - len("a.b9@x.org") <= len(after)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.b.COM/fr/x?q#f", "https://spam.net/a", "x://example.org/es/1", "x://sub.example.org/en/12#/",
            "x://notexample.org/es/", "x://de.com/de/", "x://ads.io?x", "x://plain.io/p"] + [f"x://h{i}.spam.io/{i}" for i in range(200)]
    urls += [f"x://h{i}.clean.io/{i}" for i in range(2000)]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(4, urls[4], "x")], "page_id bigint, url string, host string")
    for extra in ({}, {"pass_bits": 100}):
        rows = url_filter.judge_urls(frame, queries.URL_RULES, F.col("host").rlike(queries.LISTED), **extra).collect()
        assert len(rows) == len(urls) + 1
        for r in rows:
            m = re.match(r".*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
            host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
            fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "block" if re.search(queries.LISTED, host) else "allow")
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_bits_of_a_cascade():
    """A short list among very many keys takes more bits a key than a long one; the estimate says so."""
    short, even = url_filter.expected_bits(10**6, 10**12), url_filter.expected_bits(10**6, 10**6)
    assert short > 24 * 10**6 > 12 * 10**6 > even > 5 * 10**6
    assert url_filter.expected_bits(0, 100) == 0 and url_filter.expected_bits(5, 0) >= 5


def test_bpe(tables):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = bpe.read_ranks(lines)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in tables:
        wanted = []
        for doc, text in texts(docs):
            ids = plain.encode_ordinary(text)
            wanted.append((doc, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(text.encode())))
        assert sorted(map(tuple, bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect())) == sorted(wanted)


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(tables):
    for docs in tables:
        rows = texts(docs)
        prints = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
        lowest = np.array([d for d, _ in rows])
        near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= 4) for p in prints]
        while True:
            new = np.array([lowest[n].min() for n in near])
            if (new == lowest).all():
                break
            lowest = new
        wanted = sorted((d, f"{int(p):016x}", int(c)) for (d, _), p, c in zip(rows, prints, lowest))
        for crowd in (simhash.CROWD, 1):
            assert sorted(map(tuple, simhash.near_duplicates(docs, crowd=crowd).collect())) == wanted
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(int(c) for c in lowest))


def test_empty_tables(spark, awkward):
    none = awkward.limit(0)
    labels = spark.createDataFrame([], LABELS)
    results = [
        secrets.secret_report(none),
        sharding.shard_documents(none),
        quality.quality_report(none, labels),
        packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")),
        substrings.repeat_report(none),
        pseudonyms.pseudonymise(none, "key"),
        bpe.encode_documents(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        simhash.near_duplicates(none),
        bit_sliced.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")),
        url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), queries.URL_RULES, F.lit(True)),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, LONG, None), (None, None, None), (1, LONG, None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(None, 1, 0, None, None)], LABELS)
    for rows in (
        secrets.secret_report(docs),
        sharding.shard_documents(docs),
        quality.quality_report(docs, labels),
        substrings.repeat_report(docs),
        simhash.near_duplicates(docs),
        pseudonyms.pseudonymise(docs, "key"),
    ):
        assert rows.count() == 3


def test_pipeline(spark, given):
    docs = given
    for _, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = step(spark, docs, SMALL)
        assert docs.columns == given.columns
        assert docs.count() <= before.count()
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "sequence_id", "ids"} <= set(rows.columns) and rows.count() > 0


def test_pipeline_keeps_extra_columns(spark, awkward):
    docs = awkward
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SMALL)
        assert docs.columns == awkward.columns
