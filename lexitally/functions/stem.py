"""Suffix stripping after Porter (1980) as native column expressions.

Two modes: "paper" follows the published rules; "extended" (the default) adds
the widely used later changes: a short list of irregular words, words of two
letters left alone, ies/ied after one letter to ie, y to i only after a
consonant, and the endings bli, fulli and logi.

For one word, or few, the steps are plain SQL text, one pass per step, so that
each step reads the result of the one before it exactly once and the whole
stemmer stays in the JVM. Whole texts repeat their words: `stem_tokens` looks at
the distinct words of a batch of texts, stems those it has not met, and puts the
stems back by position, all in Arrow; the same rule tables drive both.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix rules of the published algorithm, by step.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)

# Irregular words of the extended mode.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# A y that acts as a consonant is written Y while the steps run, so that two
# character classes describe every word shape.
VOWEL = "[aeiouy]"
CONSONANT = "[^aeiouy]"
MEASURE_ABOVE_0 = f"^{CONSONANT}*{VOWEL}+{CONSONANT}"
MEASURE_ABOVE_1 = f"^{CONSONANT}*{VOWEL}+{CONSONANT}+{VOWEL}+{CONSONANT}"
ENDS_CVC = f"{CONSONANT}{VOWEL}[^aeiouywxY]$"
ENDS_VC_ONLY = f"^{VOWEL}{CONSONANT}$"
ENDS_DOUBLE = "([^aeiouylsz])\\\\1$"
ENDS_DOUBLE_LSZ = "(ll|ss|zz)$"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _matches(text: str, pattern: str) -> str:
    return f"{text} rlike '{pattern}'"


def _suffix_case(rules) -> str:
    """CASE over (suffix, condition on the stem, replacement, length kept of the suffix).

    The longest matching suffix decides; a failed condition leaves the word as
    it is. Rules are grouped by their last letter, so most words are settled by
    one comparison per letter.
    """
    by_letter: dict[str, list] = {}
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        by_letter.setdefault(rule[0][-1], []).append(rule)
    outer = []
    for letter, group in sorted(by_letter.items()):
        arms = []
        for suffix, condition, replacement in group:
            stem = _cut(len(suffix))
            made = f"concat({stem}, '{replacement}')" if replacement else stem
            kept = made if condition is None else f"if({condition(stem)}, {made}, w)"
            arms.append(f"when endswith(w, '{suffix}') then {kept}")
        outer.append(f"when endswith(w, '{letter}') then case {' '.join(arms)} else w end")
    return f"case {' '.join(outer)} else w end"


def _above_0(stem: str) -> str:
    return _matches(stem, MEASURE_ABOVE_0)


def _above_1(stem: str) -> str:
    return _matches(stem, MEASURE_ABOVE_1)


def _cvc(text: str, extended: bool) -> str:
    shape = f"{ENDS_CVC}|{ENDS_VC_ONLY}" if extended else ENDS_CVC
    return _matches(text, shape)


def steps(extended: bool = True) -> list[str]:
    """The algorithm as SQL expressions over `w`, to be applied in order."""
    plural = [("sses", None, "ss"), ("ies", None, "i"), ("ss", None, "ss"), ("s", None, "")]
    step_1a = _suffix_case(plural)
    if extended:
        step_1a = f"if(length(w) = 4 and endswith(w, 'ies'), {_cut(1)}, {step_1a})"

    # The ed/ing rule leaves a # behind, which the next step uses up.
    past = (
        f"case when endswith(w, 'eed') then if({_above_0(_cut(3))}, {_cut(1)}, w)"
        f" when endswith(w, 'ed') then if({_matches(_cut(2), VOWEL)}, concat({_cut(2)}, '#'), w)"
        f" when endswith(w, 'ing') then if({_matches(_cut(3), VOWEL)}, concat({_cut(3)}, '#'), w)"
        " else w end"
    )
    if extended:
        past = (
            f"case when endswith(w, 'ied') then if(length(w) = 4, {_cut(1)}, {_cut(2)}) else {past} end"
        )
    bare = _cut(1)
    repair = (
        "case when not endswith(w, '#') then w"
        f" when {_matches('w', '(at|bl|iz)#$')} then concat({bare}, 'e')"
        f" when {_matches(bare, ENDS_DOUBLE_LSZ)} then {bare}"
        f" when {_matches(bare, ENDS_DOUBLE)} then {_cut(2)}"
        f" when {_above_0(bare)} and not {_above_1(bare)} and {_cvc(bare, extended)} then concat({bare}, 'e')"
        f" else {bare} end"
    )
    # Plain suffix tests come before patterns: they settle most words.
    last_y = f"^.+{CONSONANT}y$" if extended else f"{VOWEL}.*[yY]$"
    step_1c = f"if((endswith(w, 'y') or endswith(w, 'Y')) and {_matches('w', last_y)}, concat({_cut(1)}, 'i'), w)"

    rules_2 = [(s, _above_0, r) for s, r in STEP_2]
    before_2 = []
    if extended:
        rules_2 = [r for r in rules_2 if r[0] != "abli"] + [
            ("bli", _above_0, "ble"),
            ("fulli", _above_0, "ful"),
            # The l of logi counts as part of the stem: geologi but not logi.
            ("logi", lambda stem: _above_0(f"concat({stem}, 'l')"), "log"),
        ]
        # alli is settled first and its result goes through the step again.
        before_2 = [f"if(endswith(w, 'alli') and {_above_0(_cut(4))}, {_cut(2)}, w)"]
    step_2 = _suffix_case(rules_2)

    step_3 = _suffix_case([(s, _above_0, r) for s, r in STEP_3])
    ion = lambda stem: f"{_above_1(stem)} and right({stem}, 1) in ('s', 't')"
    step_4 = _suffix_case([(s, ion if s == "ion" else _above_1, "") for s in STEP_4])
    step_5a = (
        f"if(endswith(w, 'e') and ({_above_1(_cut(1))}"
        f" or ({_above_0(_cut(1))} and not {_cvc(_cut(1), extended)})), {_cut(1)}, w)"
    )
    step_5b = f"if(endswith(w, 'll') and {_above_1(_cut(1))}, {_cut(1)}, w)"
    mark_y = "if(contains(w, 'y'), regexp_replace(w, '(^|[aeiouy])y', '$1Y'), w)"
    return [mark_y, step_1a, past, repair, step_1c, *before_2, step_2, step_3, step_4, step_5a, step_5b]


def stem_words(words: Column, mode: str = "extended") -> Column:
    """Stem every word of an array of lowercase words."""
    if mode not in ("extended", "paper"):
        raise ValueError(f"unknown mode {mode!r}")
    extended = mode == "extended"
    stems = words
    for step in steps(extended):
        stems = F.call_function("transform", stems, _lambda(step))
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])

    def settle(word: Column, stem: Column) -> Column:
        done = F.translate(stem, "Y", "y")
        if not extended:
            return done
        return (
            F.when(F.length(word) <= 2, word)
            .when(word.isin(list(IRREGULAR)), F.element_at(irregular, word))
            .otherwise(done)
        )

    return F.zip_with(words, stems, settle)


def _lambda(step: str) -> Column:
    return F.expr(f"w -> {step}")


def stem_word(word: Column, mode: str = "extended") -> Column:
    """Stem one lowercase word."""
    return F.element_at(stem_words(F.array(word), mode), 1)


def word_stemmer(mode: str = "extended") -> Callable[[str], str]:
    """The same steps as a Python function of one lowercase word."""
    if mode not in ("extended", "paper"):
        raise ValueError(f"unknown mode {mode!r}")
    extended = mode == "extended"
    irregular = IRREGULAR if extended else {}
    has_vowel, above_0, above_1, doubled = (re.compile(p).search for p in (VOWEL, MEASURE_ABOVE_0, MEASURE_ABOVE_1, r"([^aeiouylsz])\1$"))
    cvc = re.compile(f"{ENDS_CVC}|{ENDS_VC_ONLY}" if extended else ENDS_CVC).search
    last_y = re.compile(f"^.+{CONSONANT}[yY]$" if extended else f"{VOWEL}.*[yY]$", re.DOTALL).search
    consonant_y = re.compile("(^|[aeiouy])y").sub

    def table(rules: list[tuple]) -> dict[str, list[tuple]]:
        """Rules (suffix, condition, replacement) by last letter, longest first."""
        found: dict[str, list[tuple]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
            found.setdefault(rule[0][-1], []).append(rule)
        return found

    def apply(word: str, rules: dict[str, list[tuple]]) -> str:
        for suffix, condition, replacement in rules.get(word[-1:], ()):
            if word.endswith(suffix):
                stem = word[: len(word) - len(suffix)]
                return stem + replacement if condition is None or condition(stem) else word
        return word

    plural = table([("sses", None, "ss"), ("ies", None, "i"), ("ss", None, "ss"), ("s", None, "")])
    second = [(s, above_0, r) for s, r in STEP_2 if not (extended and s == "abli")]
    if extended:
        second += [("bli", above_0, "ble"), ("fulli", above_0, "ful"), ("logi", lambda stem: above_0(stem + "l"), "log")]
    ion = lambda stem: above_1(stem) and stem[-1:] in ("s", "t")
    second, third = table(second), table([(s, above_0, r) for s, r in STEP_3])
    fourth = table([(s, ion if s == "ion" else above_1, "") for s in STEP_4])

    def without_past(w: str) -> str:
        """The ed and ing endings, and what is put right after them."""
        if extended and w.endswith("ied"):
            return w[:-1] if len(w) == 4 else w[:-2]
        if w.endswith("eed"):
            return w[:-1] if above_0(w[:-3]) else w
        if w.endswith("ed") and has_vowel(w[:-2]):
            w = w[:-2]
        elif w.endswith("ing") and not w.endswith("ed") and has_vowel(w[:-3]):
            w = w[:-3]
        else:
            return w
        if w.endswith(("at", "bl", "iz")):
            return w + "e"
        if w.endswith(("ll", "ss", "zz")):
            return w
        if doubled(w):
            return w[:-1]
        return w + "e" if above_0(w) and not above_1(w) and cvc(w) else w

    def stem(word: str) -> str:
        if extended and len(word) <= 2:
            return word
        if word in irregular:
            return irregular[word]
        w = consonant_y(r"\1Y", word) if "y" in word else word
        w = w[:-1] if extended and len(w) == 4 and w.endswith("ies") else apply(w, plural)
        w = without_past(w)
        if last_y(w):
            w = w[:-1] + "i"
        if extended and w.endswith("alli") and above_0(w[:-4]):
            w = w[:-2]
        w = apply(apply(apply(w, second), third), fourth)
        if w.endswith("e") and (above_1(w[:-1]) or (above_0(w[:-1]) and not cvc(w[:-1]))):
            w = w[:-1]
        if w.endswith("ll") and above_1(w[:-1]):
            w = w[:-1]
        return w.replace("Y", "y")

    return stem


# Stems a worker keeps.
STEMS_KEPT = 200_000


def stem_tokens(tokens: Column, mode: str = "extended") -> Column:
    """Stem every word of an array of lowercase words; null arrays stay null.

    Only distinct words of a batch leave Arrow, and only those not met before
    are stemmed.
    """
    stem, most = word_stemmer(mode), STEMS_KEPT

    def run(arrays):
        known: dict[str, str] = {}
        for lists in arrays:
            words = lists.flatten().dictionary_encode()
            stems = []
            for word in words.dictionary.to_pylist():
                found = known.get(word)
                if found is None and word is not None:
                    if len(known) >= most:
                        known.clear()
                    found = known[word] = stem(word)
                stems.append(found)
            put_back = pc.take(pa.array(stems, pa.string()), words.indices)
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
            yield pa.ListArray.from_arrays(offsets, put_back, mask=pc.is_null(lists)) if lists.null_count else pa.ListArray.from_arrays(offsets, put_back)

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType="array<string>")(tokens)
