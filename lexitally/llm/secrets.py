"""Secrets in whole texts, found through a trigram index.

From each rule's pattern follows a Boolean query over trigrams: what every match
must contain. The index holds, for the trigrams that some query uses, which
documents contain them. A rule's postings are intersected and united as its
query says, and its pattern runs over the remaining documents only. A rule whose
query asks for nothing is run over all texts.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import let, lower_ascii, stage, whole_text

# More alternatives than this are not spelt out.
MOST_STRINGS = 64
# Numbers summed up in one go.
SUM_BLOCK = 128


@dataclass(frozen=True)
class Rule:
    """A pattern both Python and Spark read alike; `group` must have `least` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base patterns, in the order in which kinds are listed.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 or more are the long ones among all maximal runs.
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Only from the start of a run on, so that a run of many such starts is read once.
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

# A trigram query: all of its clauses hold; a clause holds if for one of its
# sets the text contains all trigrams.
TrigramQuery = list[list[frozenset[str]]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> list[frozenset[str]]:
    """One of the strings occurs. Empty if one of them is too short to tell."""
    sets = {trigrams(s.lower()) for s in strings}
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _strings(kind, value) -> set[str] | None:
    """All strings a part of a pattern matches, if they are few."""
    if kind is op.LITERAL:
        return {chr(value)}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        return {chr(v) for _, v in value}
    if kind is op.SUBPATTERN:
        return _all_of(value[3])
    if kind is op.BRANCH:
        found = [_all_of(branch) for branch in value[1]]
        return None if None in found else set().union(*found)
    if kind is op.MAX_REPEAT and value[1] <= 4 and (once := _all_of(value[2])) is not None:
        out = set()
        for n in range(value[0], value[1] + 1):
            if len(once) ** n > MOST_STRINGS:
                return None
            out |= {"".join(p) for p in product(once, repeat=n)}
        return out
    return None


def _all_of(parts) -> set[str] | None:
    out = {""}
    for kind, value in parts:
        more = _strings(kind, value)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> TrigramQuery:
    """What every match of the pattern contains, in lower case."""
    clauses: TrigramQuery = []
    run = {""}

    def close() -> None:
        nonlocal run
        if clause := _clause(run):
            clauses.append(clause)
        run = {""}

    def walk(parts) -> None:
        nonlocal run
        for kind, value in parts:
            more = _strings(kind, value)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            close()
            if more is not None:
                run = more if len(more) <= MOST_STRINGS else {""}
            elif kind is op.SUBPATTERN:
                walk(value[3])
                close()
            elif kind is op.MAX_REPEAT and value[0] >= 1:
                walk(value[2])
                close()

    walk(parser.parse(pattern))
    close()
    return clauses


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for s in clause for g in s})


def build_index(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """Postings (gram, row): each row once per trigram of the vocabulary it contains.

    A row is known by its id and a hash of its text, so rows without an id, and
    rows of one id, have postings of their own.
    """
    found = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("t"), g))
    return docs.select(row_key(), lower_ascii(whole_text()).alias("t")).select("row", F.explode(found).alias("gram"))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("row")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(row, rules): which rules' queries a row meets. At most one entry per rule."""
    held = index.groupBy("row").agg(F.collect_set("gram").alias("grams"))
    asked = []
    for rule in rules:
        meets = F.lit(True)
        for clause in trigram_query(rule.pattern):
            one = F.lit(False)
            for grams in clause:
                every = F.lit(True)
                for gram in sorted(grams):
                    every = every & F.array_contains("grams", gram)
                one = one | every
            meets = meets & one
        asked.append(F.when(meets, F.lit(rule.kind)))
    return held.select("row", F.array_compact(F.array(*asked)).alias("rules")).where(F.size("rules") > 0)


def no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string>>")


def running_sums(values: Column) -> Column:
    """Sums of the first 1, 2, 3, ... numbers of an array.

    In blocks: an element is only ever copied within its block, so long arrays
    take time in proportion.
    """

    def summed(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(
            block, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"] + x).alias("all"))
        )

    def put_together(blocks: Column) -> Column:
        ends = summed(F.transform(blocks, lambda b: b["sum"]))["all"]
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
        return F.flatten(F.transform(blocks, lambda b, i: F.transform(b["all"], lambda x: x + before(i))))

    n = F.ceil(F.size(values) / SUM_BLOCK).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: summed(F.slice(values, (i - 1) * SUM_BLOCK + 1, F.lit(SUM_BLOCK))))
    return let(parts, put_together)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end, kind): leftmost matches that do not overlap, in code points."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches

    def placed(own: Column) -> Column:
        # Every match with the gap before it; the last gap has no match behind it.
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(own))
        steps = F.zip_with(gaps, own, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        return let(
            running_sums(steps),
            lambda ends: F.transform(
                own,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.lit(number).alias("number"),
                    F.get(ends, i).alias("end"),
                    F.lit(rule.kind).alias("kind"),
                ),
            ),
        )

    def kept(spans: Column) -> Column:
        pairs = F.arrays_zip(spans.alias("span"), checked.alias("checked"))
        return F.transform(F.filter(pairs, lambda p: F.length(p["checked"]) >= rule.least), lambda p: p["span"])

    every = let(matches, placed)
    return F.when(F.rlike(text, pattern), kept(every) if rule.group or rule.least > 1 else every).otherwise(no_spans())


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, found) of every row: all spans by start, then in the order of the rules.

    A null text counts as empty. Equal rows share their postings; so may rows of
    one hash by chance, which only adds texts to verify. An empty table gives no
    rows.
    """
    grams = vocabulary(rules)
    index = stage(build_index(docs, grams))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    texts = docs.select("doc_id", row_key(), whole_text().alias("text"))
    met = texts.join(candidates(index, indexed), "row", "left")
    parts = []
    for number, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, number)
        parts.append(F.when(F.array_contains("rules", rule.kind), spans).otherwise(no_spans()) if rule in indexed else spans)
    return met.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(number: int) -> Column:
    return F.size(F.filter("found", lambda s: s["number"] == number)).cast("long")


def secret_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; see `scan`."""
    found = scan(docs, rules)
    base = F.filter("found", lambda s: s["number"] < len(BASE))
    counts = [_number_of(number).alias(f"n_{rule.kind}") for number, rule in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
