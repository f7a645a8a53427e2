"""Pieces, collocations, resampling and pseudonyms against plain versions of themselves."""

import hashlib
import hmac
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from test_llm import ROWS, SCHEMA, sha, texts

from lexitally.llm import collocations, pieces, pseudonyms, resampling

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def tables(awkward, given):
    return [awkward, given]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Pieces


def test_pieces(tables):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in tables:
        wanted = []
        for doc, text in texts(docs):
            found = library.encode(text, return_type="proto").pieces
            ids = [p.id for p in found]
            spans = np.array([(p.begin, p.end) for p in found], dtype="<u4").tobytes()
            decoded = library.decode(ids) if ids else ""
            wanted.append((doc, len(ids), sha(",".join(map(str, ids)).encode()), sha(decoded.encode()), sha(spans)))
        assert sorted(map(tuple, pieces.encode_documents(docs, MODEL).collect())) == sorted(wanted)


def test_kept_spans_cover_the_text(awkward):
    rows = pieces.encode_documents(awkward, MODEL, keep=True).collect()
    of = dict(texts(awkward))
    own = pieces.Pieces(open(MODEL, "rb").read())
    for r in rows:
        spans = np.frombuffer(r.spans, dtype="<u4").reshape(-1, 2)
        data = of[r.doc_id].encode()
        assert b"".join(data[a:b] for a, b in spans.tolist()) == data
        assert own.decode(np.frombuffer(r.ids, dtype="<u4").tolist()) == of[r.doc_id].replace("▁", " ")


def other_model(rule=None, squeeze=False, prefix=True, by_bytes=True):
    """The model with another normaliser, or without byte pieces."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    if rule:
        normal = pb.ModelProto()
        normal.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = normal.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.normalizer_spec.add_dummy_prefix = prefix
    if not by_bytes:
        model.trainer_spec.byte_fallback = False
        kept = [p for p in model.pieces if p.type != pieces.BYTE]
        del model.pieces[:]
        model.pieces.extend(kept)
    return model.SerializeToString()


@pytest.mark.parametrize(
    "options",
    [{}, {"rule": "nmt_nfkc"}, {"rule": "nmt_nfkc", "squeeze": True}, {"rule": "nfkc_cf", "prefix": False}, {"squeeze": True}, {"by_bytes": False},
     {"rule": "nmt_nfkc", "squeeze": True, "by_bytes": False}],
)
def test_pieces_of_other_models(options, monkeypatch):
    """Character maps, dropped spaces, unknown characters; also where windows of a long text end."""
    data = other_model(**options)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    rng = random.Random(1)
    parts = [*"abcdeABC  .,\n\t▁é日本語½ﬁÅ", "Å", "́", "\U0001f600", "　", "\0", "ｱ", "ﾞ", "the ", " and", "<0x0A>", "­", "​", "<s>", "한국", "١٢"]
    for _ in range(600):
        text = "".join(rng.choices(parts, k=rng.choice([0, 1, 2, 3, 8, 30, 200])))
        monkeypatch.setattr(pieces, "WINDOW", rng.choice([3, 7, 1 << 19]))
        ids, spans, decoded = [], [], ""
        for some, begins, ends, _ in own.encode(text):
            decoded += own.decode(some.tolist(), opening=not ids)
            ids += some.tolist()
            spans += zip(begins.tolist(), ends.tolist())
        found = library.encode(text, return_type="proto").pieces
        assert ids == [p.id for p in found] and spans == [(p.begin, p.end) for p in found]
        assert decoded == (library.decode(ids) if ids else "")


def test_broken_bytes_decode_alike():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Pieces(open(MODEL, "rb").read())
    rng = random.Random(2)
    for _ in range(500):
        ids = rng.choices([*range(0, 300), 28705, 28725, 1707], k=rng.randint(1, 12))
        assert own.decode(ids) == library.decode(ids)


def test_long_segment():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Pieces(open(MODEL, "rb").read())
    for text in ("abcab" * 20_000, " " * 10_001, "日本" * 5_000, "e" * 30_000):
        assert [i for ids, *_ in own.encode(text) for i in ids.tolist()] == library.encode(text)


# Collocations


def plain_collocations(rows, support, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * counts[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [collocations.BLOCK, 500])
@pytest.mark.parametrize("support", [2, 7, 100])
def test_collocations(spark, awkward, given, support, block):
    docs = awkward.select("lang", "text").unionByName(given.select("lang", "text")).repartition(5)
    rows = [(r.lang or "und", r.text or "") for r in docs.collect()]
    found = collocations.collocations(docs, support=support, block=block)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, support)


def test_collocations_of_few_rows(spark, monkeypatch):
    """Nothing but signs, a language of its own, and a bitmap so small that it holds everything."""
    monkeypatch.setattr(collocations, "BITS", 64)
    rows = [("xx", ".,;:!?\n\x0b\r"), (None, "a b a b, A B\ta\tb"), ("en", None), ("", "one two"), ("en", "a b\x1cc a b\x1cc")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocations.collocations(docs, support=3)
    assert sorted(map(tuple, found.collect())) == plain_collocations([("und" if g is None else g, t or "") for g, t in rows], 3)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_collocations_move_packed_rows(spark, monkeypatch):
    """However many phrases a task counts, it hands on a row per block and bucket."""
    made, per_block = [], collocations._per_block

    def watched(*args):
        made.append(per_block(*args))
        return made[-1]

    monkeypatch.setattr(collocations, "_per_block", watched)
    monkeypatch.setattr(collocations, "LEAST_BUCKETS", 4)
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{rng.randrange(20)}" for _ in range(2000)))] * 3
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1), support=3)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 3)
    # A block; of phrases of three to five words, a row of each length.
    assert len(made) == 5 and all(df.count() <= 3 * 4 for df in made)


@pytest.mark.parametrize("numbers", [[], [0], [1, 255, 256, 2**31, 2**32 - 1], range(10_000)])
def test_packed_numbers(numbers):
    numbers = np.array(numbers, dtype=np.int64)
    assert (collocations._unpack(collocations._pack(numbers), len(numbers)) == numbers).all()


def test_cut_score_is_exact(spark):
    rng = random.Random(3)
    rows = [(2, 3, 7, 11), (10**12, 10**13, 10**12, 10**12)]
    for _ in range(300):
        a = rng.randint(1, 10 ** rng.randint(1, 13))
        rows.append((a, rng.randint(a, 10**14), rng.randint(a, 10**13 + a), rng.randint(a, 10**13 + a)))
    frame = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    for row in frame.select("*", collocations.cut_score().alias("s")).collect():
        assert row.s == 1000 * row.a * row.n // (row.l * row.r)


# Resampling


def plain_resampling(docs, target):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = pattern.findall(lowered(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    rows = [(doc, *features(text)) for doc, text in docs]
    s = Counter(b for _, _, buckets in rows for b in buckets)
    t = Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for doc, n, buckets in rows:
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in buckets)
        out.append([doc, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for i, row in enumerate(able[: 5 * len(able) // 100]):
        row[4] = i + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("chunk", [1, 2, 50, resampling.CHUNK])
def test_features_across_chunks(given, monkeypatch, chunk):
    """A text's features are the same wherever chunks of words end."""
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    monkeypatch.setattr(resampling, "LONGEST", chunk)
    some = [t for _, t in texts(given.limit(20))] + [None, "", "one", "a b", "é 日本 x1"]
    counts, found = [], [Counter() for _ in some]
    for owner, n, runs in resampling.features(some, 10_000):
        counts += n
        for at, bucket in runs:
            for i, b in zip(owner[at].tolist(), bucket.tolist()):
                found[i][b] += 1
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in enumerate(some):
        words = pattern.findall(lowered(text or ""))
        grams = [" ".join(words[j : j + k]) for k in (1, 2, 3) for j in range(len(words) - k + 1)]
        assert counts[i] == len(words)
        assert found[i] == Counter(zlib.crc32(g.encode()) % 10_000 for g in grams)


def test_resampling(spark, tables):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bench = [r.text or "" for r in target.collect()]
    for docs in tables:
        found = resampling.resample(docs, target)
        assert sorted(map(tuple, found.collect()), key=str) == plain_resampling(texts(docs), bench)


def test_resampled_rows(spark, given):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    kept = resampling.resampled(given, target, share=20)
    ranks = resampling.resample(given, target, share=20).where("rank IS NOT NULL")
    assert kept.columns == given.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in ranks.collect())
    # Documents that hold passages of the target are worth more than the rest.
    every = resampling.resample(given, target)
    passages = [r.text for r in target.collect()]
    marked = given.where(F.lit(False) | F.expr(" OR ".join(["false", *["contains(text, '" + p[:40].replace("'", "\\'") + "')" for p in passages if p]])))
    mean = lambda df: df.agg(F.avg(F.col("weight") / F.col("n_features"))).first()[0]
    inside = every.join(marked.select("doc_id"), "doc_id", "left_semi")
    if inside.count():
        assert mean(inside) > mean(every.where("n_features > 0"))


def test_resampling_without_rows(spark, awkward):
    none = awkward.limit(0)
    assert resampling.resample(none, none).collect() == []
    without_target = resampling.resample(awkward, none)
    assert without_target.count() == awkward.count()
    nulls = spark.createDataFrame([(None, "w " * 30), (None, None), (1, "w " * 30)], "doc_id bigint, text string")
    rows = resampling.resample(nulls, nulls, share=100).collect()
    assert sorted((r.doc_id is None, r.rank) for r in rows if r.rank) == sorted((r.doc_id is None, r.rank) for r in rows if r.rank)
    assert sum(r.rank is not None for r in rows) == 2


def test_crcs_of_slices():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 3000, 400)
    lengths = np.concatenate([rng.integers(0, 40, 390), [1023, 1024, 1025, 1500, 2000, 0, 1, 1, 2, 2]])
    found = resampling.crcs(data, starts, lengths)
    assert found.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]


# Pseudonyms


def permuted(symbols, radices, key, kind, rounds=8):
    """The network in plain Python: (A, B) to (B, A + stream(B))."""
    half = len(symbols) // 2
    a, ra, b, rb = symbols[:half], radices[:half], symbols[half:], radices[half:]
    for i in range(rounds):
        moved = []
        for at, x in enumerate(a):
            message = "|".join([kind, str(i), ",".join(map(str, b)), str(at)]).encode()
            moved.append((x + int(hmac.new(key, message, hashlib.sha256).hexdigest()[:12], 16)) % ra[at])
        a, ra, b, rb = b, rb, moved, ra
    return a + b


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))


def redigited(value, digits):
    fresh = iter(digits)
    return re.sub("[0-9]", lambda _: str(next(fresh)), value)


def plain_pseudonym(kind, value, key):
    digits = [int(c) for c in value if c in "0123456789"]
    numbers = [int(n) for n in re.findall("[0-9]+", value)]
    if kind == "email":
        local, domain = value.split("@", 1)
        own = [c for c in local if c.isascii() and c.isalnum()]
        symbols = [int(c) if c.isdigit() else ord(c.lower()) - 97 for c in own]
        fresh = permuted(symbols, [10 if c.isdigit() else 26 for c in own], key, kind)
        shown = iter(str(s) if c.isdigit() else chr(s + (97 if c.islower() else 65)) for s, c in zip(fresh, own))
        return re.sub("[A-Za-z0-9]", lambda _: next(shown), local) + "@" + domain
    if kind == "card":
        if luhn(digits) % 10:
            return None
        body = permuted(digits[:-1], [10] * (len(digits) - 1), key, kind)
        return redigited(value, [*body, -luhn([*body, 0]) % 10])
    if kind == "phone":
        low, radix = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0], [8, 10, 10, 8, 10, 10, 10, 10, 10, 10]
        fresh = permuted([d - x for d, x in zip(digits[-10:], low)], radix, key, kind)
        return redigited(value, digits[:-10] + [d + x for d, x in zip(fresh, low)])
    if kind == "ip":
        if max(numbers) > 255 or re.search(r"(^|\.)0[0-9]", value):
            return None
        return ".".join(map(str, permuted(numbers, [256] * 4, key, kind)))
    if kind == "ssn":
        area, group, serial = numbers
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        a, g, s = permuted([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], key, kind)
        return f"{a + (2 if a + 1 >= 666 else 1):03}-{g + 1:02}-{s + 1:04}"
    a, b, c = numbers
    if "-" in value:
        orders, shape = [(a, b, c)], "{0:04}-{1:02}-{2:02}"
    elif "." in value[2] and "." in value[5]:
        orders, shape = [(c, b, a)], "{2:02}.{1:02}.{0:04}"
    elif "/" in value[2] and "/" in value[5]:
        orders, shape = [(c, a, b), (c, b, a)], None
    else:
        return None
    for k, (year, month, day) in enumerate(orders):
        try:
            n = (date(year, month, day) - date(1800, 1, 1)).days
        except ValueError:
            continue
        if not 0 <= n < 189 * 773:
            return None
        x, y = permuted([n // 773, n % 773], [189, 773], key, kind)
        new = date(1800, 1, 1) + timedelta(days=x * 773 + y)
        form = shape or ("{1:02}/{2:02}/{0:04}" if k == 0 else "{2:02}/{1:02}/{0:04}")
        return form.format(new.year, new.month, new.day)
    return None


def plain_pseudonymise(text, key):
    counts = Counter()

    def fresh(match):
        value = match.group()
        kind = next(k for k, p in pseudonyms.PATTERNS.items() if regex.fullmatch(p, value))
        made = plain_pseudonym(kind, value, key)
        counts[kind] += made is not None
        return value if made is None else made

    return regex.sub(pseudonyms.ANY, fresh, text), counts


PERSONAL = [
    "call (212) 555-1234 or +1 212-555-1234 or 1.212.555.1234, not 112-555-1234",
    "1999-12-31 31.12.1999 12/31/1999 31/12/1999 04/05/2001 1999-02-30 1750-01-01 99/99/1999 12/31.1999",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005 6011000990139424 1234567890123",
    "123-45-6789 666-45-6789 900-45-6789 665-01-0001 667-99-9999 123-00-6789 x123-45-6789",
    "10.1.2.3 255.255.255.255 256.1.1.1 01.2.3.4 1.2.3.4.5 10.1.2.3.",
    "a.b9@x.org A_B+c@sub.ex-ample.co.uk, me@x.org. @x.org a@b a@b.c1 Ünï@x.org x@y.z.org",
    "x" * 64 + "@b.org and " + "x" * 65 + "@b.org and a." + "y" * 63 + "@b.org",
    "me@" + "ab1." * 2000 + "org and you@" + "ab." * 126 + "org",
    "a." * 3000 + "z@b.org",
    "",
    "nothing here 12 3.4 5-6",
]


def test_pseudonyms_in_plain_python(spark, given):
    rows = [(i, t, i, f"given {i}", -1) for i, t in enumerate(PERSONAL)] + [(99, None, 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _key int, _done string, n_card int").repartition(4)
    found = pseudonyms.pseudonymise(docs, "a key")
    kinds = [f"n_{k}" for k in pseudonyms.PATTERNS]
    assert found.columns == ["doc_id", "text", "_key", "_done", "n_card_given", *kinds]
    for r in found.collect():
        if r.doc_id == 99:
            assert r.text is None and [r[k] for k in kinds] == [0] * 6
            continue
        wanted, counts = plain_pseudonymise(PERSONAL[r.doc_id], b"a key")
        assert r.text == wanted
        assert [r[f"n_{k}"] for k in pseudonyms.PATTERNS] == [counts[k] for k in pseudonyms.PATTERNS]
        assert (r._key, r._done, r.n_card_given) == (r.doc_id, f"given {r.doc_id}", -1)
    kept = pseudonyms.pseudonymise(docs, "a key", counts=False)
    assert kept.schema == docs.schema
    of = dict(texts(given))
    for r in pseudonyms.pseudonymise(given, "k2").collect():
        wanted, counts = plain_pseudonymise(of[r.doc_id], b"k2")
        assert (r.text or "") == wanted and r.n_email == counts["email"] and r.n_phone == counts["phone"]


def test_pseudonyms_take_linear_time(spark):
    """Texts of a megabyte that made the search start over, or go deep, at every character."""
    long = ["a." * 500_000, "a@" * 300_000, "1" * 1_000_000, "me@" + "a-" * 300_000 + ".org", "q@b." * 200_000, "x" * 1_000_000 + "@b.org"]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string").repartition(6)
    assert {r.doc_id: r.text == long[r.doc_id] for r in pseudonyms.pseudonymise(docs, "k", counts=False).collect()} == {
        i: True for i in range(len(long))
    }


def test_key_is_in_no_plan(given):
    plan = pseudonyms.pseudonymise(given, "very secret words")._jdf.queryExecution().toString()
    assert "very secret" not in plan and "very secret words".encode().hex() not in plan.lower()
    inner = bytes(b ^ 0x36 for b in b"very secret words".ljust(64, b"\0"))
    assert inner.hex() not in plan.lower() and inner.hex().upper() not in plan
