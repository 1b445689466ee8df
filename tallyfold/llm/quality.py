"""Text quality: statistics per document, and how much of a document is running prose.

A document may be prose in part, so the statistics are also taken of its passages (lines, and sentences of long
lines). Gradient-boosted trees learn what prose is from two kinds of weak labels: passages of the corpus on which
general rules of layout, repetition and characters agree, and passages made up from the corpus's own words in layouts
drawn at random and in scripts and languages that no list names. Among the statistics is how usual the order of words
is, by a table of neighbouring words learned from the corpus. All distinct texts of the corpus teach: counts of words and
of their neighbours, the places of cuts and the trees are sums over every passage that a rule labels. Scores are
calibrated on passages written and checked by hand, and a document is judged by the share of its characters that stand
in passages that are not prose.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import boosting, checked_passages, made_up
from tallyfold.llm.boosting import BINS, MOST_STRATA, STRATA, Grown, Part, Trees, dealt, grow, in_memory, slopes, summed_nodes, sums
from tallyfold.llm.checked_passages import CHECKED
from tallyfold.session import forget, sent_by_value, settings, stored

for _name in (__name__, boosting.__name__, made_up.__name__, checked_passages.__name__):
    sent_by_value(_name)

#: Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "a an the of to in and is was for on at by with from that it its as be has had have not but or when which this there "
    "their they her his she he who we you if so than only no were are been before after until since because each between "
    "der die das und ist war nicht von den im zu mit auf für eine ein einer aus wie dass hat es wir aber noch sich dem "
    "le la les de du des et est que pour dans un une il au aux ne pas en sur par si mais dont l d n "
    "el los las y por para se del al con lo fue pero más como cuando no"
).split()
#: Common words and characters of further languages, only used to find passages that are surely prose.
FURTHER_WORDS = (
    "het een van dat niet op te zijn och att det som inte på av och che non di con sono della não uma com os em do da "
    "nie się że na jest do w z i в и не на что с как это по 的 了 是 在 不 我 有 他 们 就 は が の を に で と た て し"
).split()
#: Made-up documents beside those of the corpus, and passages of prose at most that they are made from, drawn from all by a hash.
MADE_UP_DOCUMENTS, MADE_UP_FROM = 3_000, 30_000
#: Labelled passages up to which one task grows the trees; beyond, all tasks do, with equal results.
ONE_TASK = 2_000_000
#: A round of boosting sees this many labelled passages at least, where the corpus has them; every passage is in several rounds.
ROUND_PASSAGES = 50_000
#: Rounds of boosting and depth of the trees.
ROUNDS, DEPTH = 60, 6
#: Words whose order is learned, and words that count as known, at most.
ORDERED_WORDS, KNOWN_WORDS = 300, 50_000
#: A line longer than this is taken sentence by sentence.
LONG_LINE = 200

_COMMON = r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(set(COMMON_WORDS))) + r")(?![\p{L}\p{N}])"


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words``.

    Words are runs of letters; symbols are characters that are neither letters, digits nor white space; blank lines
    don't count. Ratios of nothing are NULL, as are all figures of a NULL text. Whole texts are used, all in one scan.
    """
    t = F.col(text)
    n_words, letters = F.regexp_count(t, F.lit(r"\p{L}+")), F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    lines = F.regexp_count(t, F.lit(r"[^\n]*[^\s][^\n]*"))
    ended = F.regexp_count(t, F.lit(r"[.!?…]['\")]*[ \t\r]*(?:\n|$)"))
    symbols = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", ""))
    return docs.select(
        doc_id, n_words.cast("long").alias("n_words"), (letters / F.nullif(n_words, F.lit(0))).alias("mean_word_length"),
        (symbols / F.nullif(F.length(t), F.lit(0))).alias("symbol_ratio"), (ended / F.nullif(lines, F.lit(0))).alias("punctuated_lines"),
        (F.regexp_count(F.lower(t), F.lit(_COMMON)) / F.nullif(n_words, F.lit(0))).alias("common_words"),
    )


_BULLET = re.compile(r"\s*(?:[-*+•–·▪◦]|\[[ xX]?\]|\(?[a-zA-Z]\)|\(?\d+(?:\.\d+)+[.)]?|\(?\d+[.)])\s")
#: Where long lines are cut: at a stop before a capital or a letter without case, else at a space near this many characters.
_SENTENCE = re.compile(r"([.!?…。！？])(?:(?<=[。！？])|([\"'”»)]?) +(?=[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁІЇŁŚŻŹĆ\"“«א-ת]))")
MOST_PASSAGE = 300
#: Quotation marks of lines, dashes of speech, and inline markup say nothing about prose.
_LEAD = re.compile(r"\s*(?:>\s*)+|\s*—\s+")
_INLINE = re.compile(r"</?(?:a|b|em|i|span|strong|u)(?:\s[^<>]*)?>|&(?:nbsp|amp|quot|shy|#\d+);", re.IGNORECASE)
_LABEL = re.compile(r"\s*\w+:\s")
_CLOSERS, _STOPS = " \t\"'”»)]", frozenset(".!?…。！？؟।")

#: Kinds of characters, as bits.
_LETTER, _UPPER, _LOWER, _DIGIT, _SPACE, _VOWEL, _BRACKET, _BROKEN, _QUIET, _POINT, _UNSPACED, _ODD = (1 << i for i in range(12))
#: Vowels, brackets and marks of code, and what is left of characters that were decoded wrongly.
VOWELS, BRACKETS, BROKEN = "aeiouyáéíóúàèäöüâêîôûAEIOUYÁÉÍÓÚÀÈÄÖÜаеёиоуыэюяαειουω", "{}[]<>\\^~_#@", "�ï¿½ÃÂâ€"
#: Marks that stand inside words and figures of prose, and those inside numbers.
QUIET, POINTS = "'’-.,:;/%°()&，。、：；", ".,:"
#: Fixed value: marks that sentences are full of.
PLAIN_MARKS = ".,'’\"-?!，。"
#: Scripts that put no spaces between words (Thai to Myanmar, Khmer, kana, Han), by first and last code.
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))

#: The statistics of a passage: its own, then those of its neighbours.
_NEAR = ("size", "words", "common", "letters", "ends", "bullet", "columns", "order", "lower_words")
OWN = (
    *_NEAR, "tokens", "word_length", "word_spread", "digits", "symbols", "capitals", "lower_start", "numbers", "mixed", "lone", "capital_words", "long_words",
    "vowels", "no_vowel_words", "commas", "brackets", "inner_marks", "one_mark", "broken", "repeats", "longest_token", "dashes", "labelled",
    "known", "longest_without", "unspaced", "same_length", "short_words", "longest_long",
)
FEATURES = (*OWN, "same_before", "same_after", *(f"before_{k}" for k in _NEAR), *(f"after_{k}" for k in _NEAR))
_AT = {k: i for i, k in enumerate(FEATURES)}
#: Those that depend on the language.
SPOKEN = ("common", "order", "known", "longest_without")
#: Characters of documents taken together in one pass, about.
PASS_CHARS = 400_000


def _kinds() -> np.ndarray:
    """The kind of every character of the basic plane; others count as symbols."""
    out = np.zeros(1 << 16, np.uint16)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            out[code] = _LETTER | (_UPPER if c.isupper() else _LOWER if c.islower() else 0)
        elif c.isdigit():
            out[code] = _DIGIT
        elif c.isspace():
            out[code] = _SPACE
        if not c.isalnum() and not c.isspace() and c not in PLAIN_MARKS:
            out[code] |= _ODD
    for first, last in UNSPACED:
        out[first : last + 1] |= np.where(out[first : last + 1] & _LETTER, _UNSPACED, 0).astype(np.uint16)
    for chars, bit in ((VOWELS, _VOWEL), (BRACKETS, _BRACKET), (BROKEN, _BROKEN), (QUIET, _QUIET), (POINTS, _POINT), (map(chr, range(0x2580, 0x2600)), _BROKEN)):
        for c in chars:
            out[ord(c)] |= bit
    return out


_TABLES: dict[str, np.ndarray] = {}


#: Odd numbers: a number's digits are hashed in powers of the first, and the sum is multiplied by the second.
_BASE, _LAST = 0x9D3C8F1B6A5E4C2B, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(first: int, base: int, n: int) -> np.ndarray:
    """``first`` times the powers of ``base`` from 0 up to ``n``, of their lowest 64 bits."""
    out, done = np.empty(n, np.uint64), 1
    out[:1] = first
    while done < n:
        np.multiply(out[: n - done][:done], np.uint64(pow(base, done, 1 << 64)), out=out[done : 2 * done])
        done *= 2
    return out


class _Hashes:
    """64-bit numbers (the lowest two bits are 0) for pieces of a string of codes, from sums over its beginnings."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        powers = _powers(1, _BASE, len(codes))
        powers *= codes + np.uint64(1)
        np.cumsum(powers, out=self.sums[1:])
        self.back = _powers(_LAST, _INVERSE, len(codes))

    def of(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.back[starts] & np.uint64(2**64 - 4)


def _hashed(words) -> np.ndarray:
    """The numbers of words, as ``_Hashes`` gives them, in the order of the words."""
    coded = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    lengths = np.array([len(w) for w in coded], np.int64)
    # no word is empty, so every piece begins at a code
    return _Hashes(np.concatenate(coded)).of(np.cumsum(lengths) - lengths, lengths) if coded else np.zeros(0, np.uint64)


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        _TABLES["kinds"] = _kinds()
        _TABLES["lower"] = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)
        k = _TABLES["kinds"]
        _TABLES["classes"] = np.select([(k & _UNSPACED) != 0, (k & _UPPER) != 0, (k & _LETTER) != 0, (k & _DIGIT) != 0], [3, 1, 0, 4], 7).astype(np.uint8)
        # beyond the basic plane: other marks
        _TABLES["classes"][[ord(c) for c in ",;:，、；："]], _TABLES["classes"][[ord(c) for c in _STOPS]], _TABLES["classes"][0xFFFF] = 5, 6, 7
    return _TABLES


@dataclass
class Language:
    """What a corpus's prose taught about words: common ones, known ones, and how usual it is that two stand together.

    ``words`` are the numbers of the words in ascending order, ``flags`` say of each whether it is common (1) and known (2),
    ``own`` is its class in the order of words, -1 where it has none of its own; words without one, numbers and
    marks share the classes before those. ``usual`` is the log ratio of a pair of classes to chance.
    """

    words: np.ndarray
    flags: np.ndarray
    own: np.ndarray
    usual: np.ndarray | None = None


def plain_language() -> Language:
    """The listed common words only."""
    words = np.unique(_hashed({*COMMON_WORDS, *FURTHER_WORDS}))
    return Language(words, np.ones(len(words), np.uint8), np.full(len(words), -1, np.int32))


#: Shared classes: word in small letters, with a capital, in capitals, of a script without spaces, number, comma or the like, stop, other mark.
_SHARED = 8


def passages(text: str | None) -> list[str]:
    """The lines of a text, the sentences of its long lines, and the pieces of very long ones; blank ones are left out."""
    out: list[str] = []
    for line in (text or "").splitlines():
        for p in _SENTENCE.sub("\\1\\2\n", line).split("\n") if len(line) > LONG_LINE else (line,):
            while len(p) > MOST_PASSAGE:
                at = p.rfind(" ", MOST_PASSAGE // 2, MOST_PASSAGE)
                at = at if at > 0 else MOST_PASSAGE
                out.append(p[:at])
                p = p[at:]
            out.append(p)
    return [p for p in out if p and not p.isspace()]


def _plain(p: str) -> str:
    if "<" in p or "&" in p:
        p = _INLINE.sub("", p)
    if p.lstrip()[:1] in (">", "—"):
        p = _LEAD.sub("", p, count=1)
    return p or "."


def _starts(flag: np.ndarray) -> np.ndarray:
    """Where runs of True begin."""
    return np.flatnonzero(flag & ~np.append(False, flag[:-1]))


def _runs(at: np.ndarray, least: int) -> np.ndarray:
    """Where runs of ``least`` neighbours or more begin among ascending places."""
    long = at[least - 1 :] - at[: max(0, len(at) - least + 1)] == least - 1
    return at[: len(long)][long & np.append(True, np.diff(at) != 1)[: len(long)]]


def _told(known: np.ndarray, unsure: np.ndarray, test, plain: list[str]) -> np.ndarray:
    """What is known of the passages, and for those that are unsure what a test of them says."""
    out = known.astype(float)
    at = np.flatnonzero(unsure)
    out[at] = [test(plain[i]) for i in at.tolist()]
    return out


def _largest(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The largest of the values of each of ``n`` passages; ``of`` is ascending."""
    out, first = np.zeros(n, int), np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
    if len(first):
        out[of[first]] = np.maximum.reduceat(values, first)
    return out


def _share(flag: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The share of the words of each of ``n`` passages that are flagged."""
    return np.bincount(owner[flag], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)


def _longest_without(flag: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The longest run of words of each passage without a flagged one, 30 at most; ``owner`` is ascending."""
    place = np.arange(len(flag), dtype=np.int32)
    last = np.where(flag, place, np.int32(-1))
    new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    # a passage's first word has the place before it as its last flagged one, where it isn't flagged
    last[new] = np.maximum(last[new], new - 1)
    return np.minimum(_largest(place - np.maximum.accumulate(last) if len(last) else place, owner, n), 30)


@dataclass
class Units:
    """The units (words, numbers, marks) of passages in order: how many each passage has, and the number of each unit.

    Numbers below ``_SHARED`` are classes of units that are no words; each further one is a word of ``words``, its hash with its
    shared class in the lowest two bits.
    """

    counts: np.ndarray
    numbers: np.ndarray
    words: np.ndarray

    def packed(self) -> dict:
        return {"counted": self.counts.astype(np.int32).tobytes(), "units": self.numbers.astype(np.uint16 if len(self.words) < (1 << 16) - _SHARED else np.int32).tobytes(), "heard": self.words.tobytes()}

    def looked_up(self, language: Language) -> tuple[np.ndarray, np.ndarray]:
        """By number of unit: its class in the order of words, and the flags of words."""
        own = self.words & np.uint64(2**64 - 4)
        spot = np.minimum(np.searchsorted(language.words, own), len(language.words) - 1)
        listed = language.words[spot] == own
        cls = np.where(listed & (language.own[spot] >= 0), language.own[spot] + _SHARED, (self.words & np.uint64(3)).astype(np.int32))
        return np.append(np.arange(_SHARED, dtype=np.int32), cls), np.append(np.zeros(_SHARED, np.uint8), np.where(listed, language.flags[spot], 0))

    def pairs(self, cls: np.ndarray, m: int, owner: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the ``m`` classes of neighbouring units as one number each, and their passages; ``of`` flags the passages that count."""
        classes, both = cls[self.numbers], owner[1:] == owner[:-1]
        if of is not None:
            both &= np.repeat(of, self.counts)[1:]
        at = np.flatnonzero(both)
        return classes[at] * np.int32(m) + classes[at + 1], owner[at]

    def spoken(self, language: Language) -> dict[str, np.ndarray]:
        """The statistics of ``SPOKEN``, which depend on the language."""
        n = len(self.counts)
        owner, (cls, flags) = np.repeat(np.arange(n, dtype=np.int32), self.counts), self.looked_up(language)
        order = np.zeros(n)
        if language.usual is not None:
            pair, of = self.pairs(cls, len(language.usual), owner)
            order = np.bincount(of, language.usual.ravel()[pair], n) / np.maximum(np.bincount(of, minlength=n), 1)
        at = np.flatnonzero(self.numbers >= _SHARED)
        flag, owner = flags[self.numbers[at]], owner[at]
        common = (flag & 1) != 0
        return {"common": _share(common, owner, n), "order": order, "known": _share((flag & 2) != 0, owner, n), "longest_without": _longest_without(common, owner, n)}


class _Codes:
    """All characters of all passages as arrays of codes and kinds, with the words and units (words, numbers, marks) among them."""

    def __init__(self, plain: list[str]):
        t = _tables()
        self.n, self.plain = len(plain), plain
        # a line break ends every passage, so no run crosses into the next
        self.text = "\n".join([*plain, ""])
        self.codes = codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter(map(len, plain), np.int64, self.n)
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), self.size + 1)
        wide = codes > 0xFFFF
        small = np.minimum(codes, 0xFFFF).astype(np.intp)
        self.kind, self.lower = t["kinds"][small], t["lower"][small]
        if wide.any():
            self.kind[wide], self.lower[wide] = 0, codes[wide]
        self.letter, self.digit, self.space = (self.kind & _LETTER) != 0, (self.kind & _DIGIT) != 0, (self.kind & _SPACE) != 0
        self.solid = ~self.space
        # every character of a script without spaces is a word
        self.alone = (self.kind & _UNSPACED) != 0
        self.parts = self.alone | np.append(False, self.alone[:-1])
        self.word_at = np.flatnonzero(self.letter & (self.parts | ~np.append(False, self.letter[:-1])))
        self.word_owner, self.word_length = self.owner[self.word_at], self.lengths(self.letter, self.word_at)
        self.hashes = _Hashes(self.lower)

    def lengths(self, flag: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The lengths of the runs of True that begin at ``starts``, where scripts without spaces break them."""
        return np.flatnonzero(flag & ~np.append(flag[1:] & ~self.parts[1:], False)) + 1 - starts

    def units(self) -> Units:
        solid, letter, digit, kind = self.solid, self.letter, self.digit, self.kind
        first = np.zeros(len(kind), bool)
        first[self.word_at] = True
        first |= digit & ~np.append(False, digit[:-1])
        mark = solid & ~letter & ~digit
        # marks inside a word (apostrophes, hyphens) are no units
        joint = mark & np.append(False, letter[:-1]) & np.append(letter[1:], False)
        first |= mark & ~joint & ~(np.append(False, mark[:-1]) & (self.codes == np.append(0, self.codes[:-1])))
        at = np.flatnonzero(first)
        k, c = kind[at], self.codes[at]
        numbers = _tables()["classes"][np.minimum(c, 0xFFFF)].astype(np.int32)
        spots = np.flatnonzero(k & _LETTER)
        # the classes of words: in small letters, with a capital, in capitals, without spaces
        upper_next = (kind[self.word_at + 1] & _UPPER) != 0
        self.word_class = numbers[spots]
        self.word_class[(self.word_class == 1) & upper_next] = 2
        found, words = pd.factorize(self.hashes.of(self.word_at, self.word_length) | self.word_class.astype(np.uint64))
        self.word_number = found.astype(np.int32)
        numbers[spots] = self.word_number + _SHARED
        return Units(np.bincount(self.owner[at], minlength=self.n), numbers, words)


def statistics(ps: list[str], doc_starts: list[int], language: Language | None = None) -> np.ndarray:
    """One row of ``FEATURES`` per passage; ``doc_starts`` are the numbers of the passages with which texts begin.

    All characters of all passages are looked at together, as arrays of codes and kinds; tokens and words are runs in them.
    """
    z = _Codes([_plain(p) for p in ps])
    return _statistics(z, z.units().spoken(language or plain_language()), doc_starts)


def _statistics(z: _Codes, spoken: dict[str, np.ndarray], doc_starts: list[int]) -> np.ndarray:
    n, plain, codes, size, owner, kind = z.n, z.plain, z.codes, z.size, z.owner, z.kind
    letter, digit, solid = z.letter, z.digit, z.solid
    starts = np.cumsum(size + 1) - size - 1
    per = lambda flag: np.bincount(owner[np.flatnonzero(flag)], minlength=n)
    alnum = letter | digit
    # marks and spaces with what they are; before the first character stands the line break at the end
    marks, spaces = np.flatnonzero(solid & ~alnum), np.flatnonzero(z.space)
    mark, mark_kind, mark_owner, space, space_owner = codes[marks], kind[marks], owner[marks], codes[spaces], owner[spaces]
    per_mark = lambda flag: np.bincount(mark_owner[flag], minlength=n)
    digits, capitals, symbols = per(digit), per((kind & _UPPER) != 0), np.bincount(mark_owner, minlength=n)
    letters = size + 1 - np.bincount(space_owner, minlength=n) - digits - symbols

    token_at = np.flatnonzero(solid & (z.parts | ~np.append(False, solid[:-1])))
    mine, k = owner[token_at], len(token_at)
    length = z.lengths(solid, token_at)
    with_letter, with_digit = letter[token_at], digit[token_at]
    for flag, starts_of in ((with_letter, z.word_at), (with_digit, _starts(digit))):
        flag[np.searchsorted(token_at, starts_of[solid[starts_of - 1]], side="right") - 1] = True
    upper_first, lower_first = (kind[token_at] & _UPPER) > 0, (kind[token_at] & _LOWER) > 0
    second = kind[np.minimum(token_at + 1, len(kind) - 1)]
    tokens = np.maximum(np.bincount(mine, minlength=n), 1)
    token = lambda flag: np.bincount(mine[flag], minlength=n) / tokens

    longest = _largest(length, mine, n)
    # the passage's number, then the upper digits of the token's
    low = np.uint64(64 - int(n).bit_length())
    key = np.sort(mine.astype(np.uint64) << low | z.hashes.of(token_at, length) >> np.uint64(64) - low)
    distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])[:k]] >> low).astype(np.intp), minlength=n)

    word_at, word_owner, word_length = z.word_at, z.word_owner, z.word_length
    vowel = (kind & _VOWEL) != 0
    up_to = np.append(np.int32(0), np.cumsum(vowel, dtype=np.int32))
    word_vowels, vowels = up_to[word_at + word_length] - up_to[word_at], up_to[starts + size] - up_to[starts]
    words = np.bincount(word_owner, minlength=n)
    n_words = np.maximum(words, 1)
    word = lambda flag: np.bincount(word_owner[flag], minlength=n) / n_words
    mean_length = letters / n_words
    spread = np.sqrt(np.maximum(np.bincount(word_owner, word_length.astype(float) ** 2, n) / n_words - mean_length**2, 0))
    alphabetic = ~z.alone[word_at] & ((kind[word_at] & (_UPPER | _LOWER)) != 0)
    short = word_length <= 3

    around = lambda flag: flag[marks - 1] & flag[marks + 1]
    blank = codes == 32
    columns = np.bincount(space_owner[space == 9], minlength=n) + np.bincount(owner[np.append(_runs(spaces[space == 32], 3), _runs(marks[mark == 46], 4))], minlength=n)
    columns += per_mark((mark == 124) | (mark == 38) & around(blank) | (mark == 61) & around(solid) | (mark == 60) & ((codes[marks + 1] == 47) | letter[marks + 1]))
    inside = around(alnum) & ((mark_kind & _QUIET) == 0)
    # how often the most frequent mark other than those of sentences occurs
    odd = np.flatnonzero(mark_kind & _ODD)
    one_mark = np.zeros(n)
    if len(odd):
        pair = np.sort(mark_owner[odd].astype(np.int64) << 32 | mark[odd])
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        one_mark = _largest(np.diff(np.append(first, len(pair))), pair[first] >> 32, n)

    # the make-up of a line: words, numbers and the marks between them, words in a row as one
    number_inside = ((kind & _POINT) != 0) & np.append(False, digit[:-1]) & np.append(digit[1:], False)
    numeric = digit | number_inside
    item = np.flatnonzero(solid & ~(letter & np.append(False, letter[:-1])) & ~(numeric & np.append(False, numeric[:-1])))
    made, item_owner = codes[item], owner[item]
    made[numeric[item]], made[letter[item]] = 48, 119
    again = (made == 119) & np.append(False, (made[:-1] == 119) & (item_owner[:-1] == item_owner[1:]))
    made, item_owner = made[~again], item_owner[~again]
    shape = np.zeros(n, np.uint64)
    opens = np.flatnonzero(np.append(True, item_owner[1:] != item_owner[:-1])) if len(item_owner) else np.zeros(0, int)
    shape[item_owner[opens]] = _Hashes(made).of(opens, np.diff(np.append(opens, len(made))))

    opening = np.zeros(n, bool)
    opening[doc_starts] = True
    near_length = np.abs(np.diff(size)) <= 3
    same_length = (np.append(False, near_length & ~opening[1:]).astype(float) + np.append(near_length & ~opening[1:], False)) / 2

    total = np.maximum(size, 1)
    # most passages are told by their first or last character
    first, last = kind[starts], _tables()["classes"][np.minimum(codes[starts + np.maximum(size, 1) - 1], 0xFFFF)]
    ends = _told(last == 6, last == 7, lambda p: p.rstrip(_CLOSERS)[-1:] in _STOPS, plain)
    lower_start = _told((first & _LOWER) != 0, (first & (_LETTER | _DIGIT)) == 0, lambda p: p.lstrip(" \t\"'(«“")[:1].islower(), plain)
    bullet = _told(np.zeros(n, bool), ~(letter[starts] & letter[np.minimum(starts + 1, len(letter) - 1)]), lambda p: _BULLET.match(p) is not None, plain)
    named = _told(np.zeros(n, bool), per_mark(mark == 58) > 0, lambda p: _LABEL.match(p) is not None, plain)
    x = {
        "size": np.minimum(size, 400), "words": words, "common": spoken["common"], "letters": letters / total, "ends": ends,
        "bullet": bullet, "columns": np.minimum(columns, 20), "tokens": np.minimum(tokens, 60), "order": spoken["order"],
        "word_length": mean_length, "word_spread": spread, "digits": digits / total, "symbols": symbols / total, "capitals": capitals / total,
        "lower_start": lower_start, "numbers": token(with_digit & ~with_letter), "mixed": token(with_digit & with_letter),
        "lone": token(~with_digit & ~with_letter), "capital_words": token(upper_first & ((second & _LOWER) > 0)), "long_words": word(word_length >= 18),
        "vowels": vowels / np.maximum(letters, 1), "no_vowel_words": word((word_length >= 3) & (word_vowels == 0) & alphabetic), "commas": per_mark((mark == 44) | (mark == 59)) / tokens,
        "brackets": per_mark((mark_kind & _BRACKET) != 0) / total, "inner_marks": per_mark(inside) / tokens, "one_mark": one_mark / tokens, "broken": per((kind & _BROKEN) != 0) / total, "repeats": 1 - distinct / tokens,
        "longest_token": np.minimum(longest, 100), "dashes": per_mark((mark == 45) & around(blank)) / tokens,
        "labelled": named, "lower_words": token(lower_first & ((second & _LOWER) > 0)),
        "known": spoken["known"], "longest_without": spoken["longest_without"], "unspaced": per(z.alone) / np.maximum(letters, 1), "same_length": same_length,
        "short_words": word(short), "longest_long": _longest_without(short, word_owner, n),
    }
    own = np.column_stack([x[c] for c in OWN]).astype(np.float32)
    return _with_near(own, np.append((shape[:-1] == shape[1:]) & ~opening[1:], False), opening)


def _with_near(own: np.ndarray, same: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Rows of ``FEATURES`` from those of ``OWN``; ``same`` are passages of one make-up with the next, ``opening`` those that begin a text."""
    closing, near = np.append(opening[1:], True), own[:, : len(_NEAR)]
    before_near = np.where(opening[:, None], 0, np.vstack([near[:1] * 0, near[:-1]]))
    after_near = np.where(closing[:, None], 0, np.vstack([near[1:], near[:1] * 0]))
    return np.hstack([own, np.append(False, same[:-1])[:, None], same[:, None], before_near, after_near]).astype(own.dtype)


def _passes(texts) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about ``PASS_CHARS`` characters: how many passages each text has, and all of them."""
    counts, ps, size = [], [], 0
    for t in [*texts, None]:
        if t is not None:
            cut = passages(t)
            counts.append(len(cut))
            ps += cut
            size += len(t)
        if counts and (t is None or size > PASS_CHARS):
            yield counts, ps
            counts, ps, size = [], [], 0


def _openings(counts: list[int]) -> list[int]:
    """The numbers of the passages with which texts begin."""
    n = np.array(counts)
    return (np.cumsum(n) - n)[n > 0].tolist()


def in_passes(texts, language: Language | None = None) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
    """The same with the statistics of the passages."""
    for counts, ps in _passes(texts):
        yield counts, ps, statistics(ps, _openings(counts), language) if ps else np.zeros((0, len(FEATURES)), np.float32)


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 for structural junk, 0 for prose, -1 where no rule is sure or rules disagree.

    The rules know layout, repetition, kinds of characters and common words, no template; they leave much undecided.
    """
    f = lambda name: x[:, _AT[name]]
    alike = (f("same_before") == 1) | (f("same_after") == 1)
    plain = (f("columns") == 0) & (f("bullet") == 0) & (f("symbols") < 0.12) & (f("brackets") == 0) & (f("letters") > 0.55) & (f("broken") < 0.12) & (f("repeats") < 0.5) & (f("mixed") < 0.2)
    # short lines of one make-up stand in lists as often as in prose
    plain &= ~alike | (f("words") > 10)
    prose = [
        plain & (f("words") >= 7) & (f("common") >= 0.25),
        plain & (f("words") >= 5) & (f("common") >= 0.15) & (f("ends") == 1) & (f("commas") < 0.3),
        plain & (f("words") >= 4) & (f("lower_words") >= 0.5) & (f("ends") == 1) & (f("commas") < 0.3) & (f("dashes") == 0) & (f("labelled") == 0) & ~alike,
        plain & (f("lower_start") == 1) & (f("before_common") >= 0.2) & (f("before_words") >= 6) & (f("before_ends") == 0) & (f("before_bullet") == 0) & ~alike,
        plain & (f("words") >= 4) & (f("lower_words") >= 0.7) & (f("commas") < 0.3) & ~alike & (f("common") > 0),
        (f("columns") == 0) & (f("bullet") == 0) & (f("brackets") == 0) & (f("letters") > 0.35) & (f("mixed") < 0.2) & (f("words") >= 5) & (f("common") >= 0.2) & (f("numbers") >= 0.12) & ((f("ends") == 1) | (f("lower_words") >= 0.3)) & (f("commas") < 0.35) & (f("broken") < 0.1) & (~alike | (f("words") > 10)),
    ]
    junk = [
        f("columns") >= 3, f("letters") < 0.3, (f("bullet") == 1) & alike & (f("words") <= 9), alike & (f("words") <= 5) & (f("common") < 0.1), f("mixed") > 0.5, f("no_vowel_words") > 0.5,
        (f("long_words") > 0.5) & (f("unspaced") == 0), (f("words") >= 6) & (f("repeats") > 0.6), f("brackets") > 0.08, f("broken") > 0.25, f("inner_marks") > 0.25, (f("one_mark") > 0.3) & (f("words") >= 4),
        alike & (f("commas") > 0.4) & (f("common") < 0.1), (f("words") >= 8) & (f("common") == 0) & (f("known") + f("unspaced") + f("ends") == 0) & (f("lower_words") < 0.3),
    ]
    p, j = np.array(prose).any(0), np.array(junk).any(0)
    return np.where(j & ~p, 1, np.where(p & ~j, 0, -1))


def count_words(prose: list[str], seen: Counter) -> None:
    """Add to ``seen`` in how many of the plain passages (``_plain``) every word stands; words are runs of letters."""
    if not prose:
        return
    codes = np.frombuffer("\n".join(prose).encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = (codes == 10) | ((codes < 1 << 16) & ((_tables()["kinds"][np.minimum(codes, 0xFFFF)] & _LETTER) != 0))
    for line in np.where(kept, codes, 32).astype(np.uint32).tobytes().decode("utf-32-le").split("\n"):
        seen.update(set(line.split()))


def count_lower_words(z: _Codes, prose: np.ndarray, seen: Counter) -> None:
    """The same for words that don't begin with a capital (``lower_words``), of the flagged passages; ``z.units`` was called."""
    # passages with words that differ from their small letters, or of a script without spaces, are read word by word
    other = np.flatnonzero(z.letter & (z.codes != z.lower) & (np.append(False, z.letter[:-1]) | ((z.kind & _UPPER) == 0)))
    of = np.searchsorted(z.word_at, other, side="right") - 1
    apart = np.zeros(z.n, bool)
    apart[z.word_owner[of[z.word_class[of] == 0]]] = True
    apart[z.owner[np.flatnonzero(z.alone)]] = True
    count_words([z.plain[i] for i in np.flatnonzero(prose & apart)], seen)
    at = np.flatnonzero((prose & ~apart)[z.word_owner] & (z.word_class == 0))
    number, low = z.word_number[at], int(z.word_number.max(initial=0)).bit_length()
    key = np.sort(z.word_owner[at].astype(np.int64) << low | number)
    counts = np.bincount(key[np.append(True, key[1:] != key[:-1])[: len(key)]] & ((1 << low) - 1))
    place = np.zeros(len(counts), int)
    place[number] = at
    found = np.flatnonzero(counts)
    starts = z.word_at[place[found]]
    for first, last, c in zip(starts.tolist(), (starts + z.word_length[place[found]]).tolist(), counts[found].tolist(), strict=True):
        seen[z.text[first:last]] += c


def lower_words(seen: Counter) -> list[tuple[str, int]]:
    """The counted words that don't begin with a capital."""
    return [(w, c) for w, c in seen.items() if w.islower() or not w[:1].isupper()]


def vocabulary(counts: list[tuple[str, int]], n: int) -> Language:
    """Common and known words, and those whose order is learned, from the counts of words in ``n`` passages of prose."""
    counts = sorted(counts, key=lambda e: (-e[1], e[0]))[:KNOWN_WORDS]
    top = [(w, c) for w, c in counts if c >= max(3, 0.002 * n)][:ORDERED_WORDS]
    common = {*COMMON_WORDS, *FURTHER_WORDS, *(w for w, c in top if len(w) <= 4 and c >= 0.01 * n)}
    known = {w for w, c in counts if c >= 2}
    classes = {w: i for i, (w, _) in enumerate(top)}
    listed = sorted({*common, *known, *classes})
    hashes = _hashed(listed)
    _, first = np.unique(hashes, return_index=True)
    return Language(
        hashes[first], np.array([(w in common) + 2 * (w in known) for w in listed], np.uint8)[first], np.array([classes.get(w, -1) for w in listed], np.int32)[first],
    )


def count_pairs(units: Units, prose: np.ndarray, language: Language, pairs: np.ndarray) -> None:
    """Add to ``pairs`` how often the classes of two units stand together in the flagged passages."""
    n = len(pairs)
    owner = np.repeat(np.arange(len(units.counts), dtype=np.int32), units.counts)
    pairs += np.bincount(units.pairs(units.looked_up(language)[0], n, owner, prose)[0], minlength=n * n).reshape(n, n)


def seed_units() -> tuple[Units, np.ndarray]:
    units = _Codes(list(made_up.SEED_PROSE)).units()
    return units, np.ones(len(units.counts), bool)


def no_pairs(language: Language) -> np.ndarray:
    n = _SHARED + int(language.own.max(initial=-1)) + 1
    return np.zeros((n, n), np.int64)


def usual_order(pairs: np.ndarray) -> np.ndarray:
    """The log ratio of every pair of classes to chance."""
    left, right, whole = pairs.sum(1, keepdims=True), pairs.sum(0, keepdims=True), max(pairs.sum(), 1)
    chance = left * (right / whole)
    # as if every pair had been seen a few times more, as often as chance has it
    return np.clip(np.log((pairs + 3 * (chance + 0.5) / (chance + 3)) / (chance + 3 * (chance + 0.5) / (chance + 3))), -4, 4).astype(np.float32)


#: Statistics are kept as numbers with nine binary digits ("codes", ascending with them), exact for whole numbers below 512;
#: those below 2**-24 are zero. No statistic is beyond the largest code.
_STEP, _LEAST, _MOST = 15, 103 << 8, (136 - 103) << 8


def encoded(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    c = np.clip((np.abs(x).view(np.uint32) >> _STEP).astype(np.int32) - _LEAST, 0, _MOST)
    return np.where(x < 0, -c, c).astype(np.int16)


def decoded(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, np.int32)
    x = np.where(c == 0, 0, (np.abs(c) + _LEAST) << _STEP).astype(np.uint32).view(np.float32)
    return np.where(c < 0, -x, x)


@dataclass
class Block:
    """Passages of some texts: the marks of the texts (16 bytes each), their counts of passages, per passage the codes of ``OWN`` and
    of ``same_after`` (one row per statistic), its label (-1 none, 0 and 1 weak, 2 and 3 made up) and its characters."""

    marks: bytes
    counts: np.ndarray
    own: np.ndarray
    y: np.ndarray
    chars: np.ndarray

    def packed(self) -> dict:
        return {"marks": self.marks, "counts": self.counts.astype(np.int32).tobytes(), "own": self.own.tobytes(), "y": self.y.astype(np.int8).tobytes(), "chars": self.chars.astype(np.int32).tobytes()}

    def codes(self) -> np.ndarray:
        """Codes of ``FEATURES``, one row per statistic."""
        opening = np.zeros(len(self.y), bool)
        opening[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = True
        k, near = len(OWN), len(_NEAR)
        out = np.zeros((len(FEATURES), len(self.y)), np.int16)
        out[:k], out[k, 1:], out[k + 1] = self.own[:-1], self.own[-1, :-1], self.own[-1]
        out[k + 2 : k + 2 + near, 1:], out[k + 2 + near :, :-1] = self.own[:near, :-1], self.own[:near, 1:]
        first = np.flatnonzero(opening)
        out[k + 2 : k + 2 + near, first] = 0
        out[k + 2 + near :, first[first > 0] - 1] = 0
        return out

    def groups(self) -> np.ndarray:
        """The group of each passage in boosting, by a hash of its text; made-up ones have their own."""
        of = np.frombuffer(self.marks, np.uint16).reshape(-1, 8)[:, 0] % STRATA
        return np.repeat(of.astype(int), self.counts) + STRATA * (self.y >= 2)


def unpacked(row) -> Block:
    y = np.frombuffer(row.y, np.int8)
    return Block(row.marks, np.frombuffer(row.counts, np.int32), np.frombuffer(row.own, np.int16).reshape(len(OWN) + 1, len(y)), y, np.frombuffer(row.chars, np.int32))


def _units(row) -> Units:
    counts, words = np.frombuffer(row.counted, np.int32), np.frombuffer(row.heard, np.uint64)
    return Units(counts, np.frombuffer(row.units, np.uint16 if len(row.units) == 2 * counts.sum() else np.int32), words)


def _block(marks: list[bytes], counts: list[int], ps: list[str], x: np.ndarray, y: np.ndarray) -> Block:
    own = encoded(np.vstack([x[:, : len(OWN)].T, x[None, :, _AT["same_after"]]]))
    return Block(b"".join(marks), np.array(counts, np.int32), own, y.astype(np.int8), np.array([len(p.strip()) for p in ps], np.int32))


def labelled(marks: list[bytes], texts: list[str], words: Counter) -> Iterator[tuple[Block, list[str], Units]]:
    """The passages of texts in blocks with their weak labels and units, by the words of the lists only; the words of prose are counted."""
    at, language = 0, plain_language()
    for counts, ps in _passes(texts):
        if ps:
            z = _Codes([_plain(p) for p in ps])
            units = z.units()
            x = _statistics(z, units.spoken(language), _openings(counts))
            block = _block(marks[at : at + len(counts)], counts, ps, x, weak_labels(x))
            count_lower_words(z, block.y == 0, words)
            yield block, ps, units
        at += len(counts)


def understood(block: Block, units: Units, language: Language) -> Block:
    """The same block with the statistics that depend on the language."""
    own = block.own.copy()
    for k, v in units.spoken(language).items():
        own[_AT[k]] = encoded(v)
    return Block(block.marks, block.counts, own, block.y, block.chars)


def made_up_blocks(prose: list[str], documents: int, seed: int, language: Language) -> Iterator[Block]:
    """Blocks of made-up documents, from passages of prose."""
    made = made_up.made_up(prose, documents, seed)
    for at in range(0, len(made), 200):
        lines, counts, own = [], [], []
        for ls, ys in made[at : at + 200]:
            cut = [(p, label) for line, label in zip(ls, ys, strict=True) for p in passages(line)]
            lines += [p for p, _ in cut]
            own += [2 + label for _, label in cut]
            counts.append(len(cut))
        x = statistics(lines, _openings(counts), language)
        yield _block([(at + i).to_bytes(16, "little") for i in range(len(counts))], counts, lines, x, np.array(own))


class Drawn:
    """The passages of prose with the lowest numbers, which hashes of text and place give, ``MADE_UP_FROM`` at most."""

    def __init__(self):
        self.rows: list[tuple[int, str]] = []
        #: No passage with a larger number will be among them.
        self.most = np.uint64(2**64 - 1)

    def add(self, block: Block, ps: list[str]) -> None:
        first = np.frombuffer(block.marks, np.uint64).reshape(-1, 2)[:, 0]
        place = np.arange(len(ps)) - np.repeat(np.cumsum(block.counts) - block.counts, block.counts)
        number = (np.repeat(first, block.counts) ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        number = (number ^ (number >> np.uint64(32))) >> np.uint64(1)
        at = np.flatnonzero((block.y == 0) & (number <= self.most))
        self.rows += zip(number[at].tolist(), [ps[i] for i in at.tolist()], strict=True)
        if len(self.rows) > 1.5 * MADE_UP_FROM:
            self.rows = self.lowest()
            self.most = np.uint64(self.rows[-1][0])

    def lowest(self) -> list[tuple[int, str]]:
        return sorted(self.rows)[:MADE_UP_FROM]


#: Tallies of labelled passages: codes of every statistic of those of the corpus, then of the made-up ones, then sizes by label.
_CODES, _TALLIES = 1 << 15, 2 * len(FEATURES) + 1


def tally(block: Block, out: np.ndarray) -> None:
    """Add the labelled passages of a block to ``out``, an array of ``_TALLIES`` rows of ``_CODES``."""
    codes = block.codes()
    for first, of in ((0, (block.y == 0) | (block.y == 1)), (len(FEATURES), block.y >= 2)):
        if of.any():
            for j, c in enumerate(codes[:, of]):
                n = np.bincount(c.astype(int) + _MOST)
                out[first + j, : len(n)] += n
    n = np.bincount(block.y[block.y >= 0].astype(int) * 512 + decoded(block.own[_AT["size"]][block.y >= 0]).astype(int))
    out[-1, : len(n)] += n


@dataclass
class Plan:
    """What boosting needs to know of all labelled passages: the bin of every code, weights by label and size, and of the groups
    of the corpus how many a round sees."""

    bins: np.ndarray
    thresholds: list[np.ndarray]
    weights: np.ndarray
    base: float
    few: int
    rows: int

    def binned(self, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per group: its number, bins (one row per feature), labels and weights of the labelled passages of a block."""
        codes, groups = block.codes(), block.groups()
        size = decoded(block.own[_AT["size"]]).astype(int)
        for g in np.unique(groups[block.y >= 0]):
            at = np.flatnonzero((groups == g) & (block.y >= 0))
            y = block.y[at]
            yield int(g), self.bins[np.arange(len(FEATURES))[:, None], codes[:, at].astype(np.intp) + _MOST], (y & 1).astype(float), self.weights[y, size[at]]

    def seen(self, r: int) -> list[tuple[int, float]]:
        """The groups that a round sees, and what their weights are multiplied by, so that both kinds keep their part in it."""
        return [(s, MOST_STRATA / self.few) for s in dealt(r, self.few)] + [(STRATA + s, 1.0) for s in dealt(r, MOST_STRATA)]

    def grow(self, histograms, seed: int) -> Grown:
        return grow(histograms, [len(t) for t in self.thresholds], self.base, ROUNDS, DEPTH, seed=seed)


def plan_of(tallies: np.ndarray) -> Plan:
    """Cuts at quantiles of all labelled passages and weights of their groups, from the whole tallies."""
    sizes = tallies[-1, : 4 * 512].reshape(4, 512)
    corpus, made = int(sizes[:2].sum()), int(sizes[2:].sum())
    # the corpus counts as much as the made-up passages where it has more of them, so that its size changes no balance
    part = min(1.0, made / max(corpus, 1))
    bins, thresholds = np.zeros((len(FEATURES), 2 * _MOST + 1), np.uint8), []
    for j in range(len(FEATURES)):
        below = (tallies[j] * part + tallies[len(FEATURES) + j]).cumsum()
        edges = np.unique(np.searchsorted(below, np.linspace(0, 1, BINS + 1)[1:-1] * max(below[-1] - 1, 0), side="right")) - _MOST
        bins[j] = np.searchsorted(edges, np.arange(-_MOST, _MOST + 1), side="left")
        # a number is above the threshold where its code is above the edge
        thresholds.append(np.where(edges < 0, decoded(edges), np.nextafter(decoded(edges + 1), np.float32(0))).astype(np.float32))
    # characters count, not passages; made-up passages together weigh as much as those of the corpus, and both labels alike
    weights = np.tile(np.sqrt(np.maximum(np.arange(512), 10.0)), (4, 1))
    whole = (sizes * weights).sum(1)
    weights *= ((made + min(corpus, made)) / max((whole > 0).sum(), 1) / np.maximum(whole, 1e-9))[:, None]
    junk = (sizes * weights)[[1, 3]].sum() / max((sizes * weights).sum(), 1e-9)
    junk = float(np.clip(junk, 0.01, 0.99))
    few = int(np.clip(-(-STRATA * ROUND_PASSAGES // max(corpus, 1)), 1, MOST_STRATA))
    return Plan(bins, thresholds, weights, float(np.log(junk / (1 - junk))), few, corpus + made)


def grown_here(pieces, plan: Plan, seed: int) -> Grown:
    """Trees grown in memory from all ``pieces`` as ``Plan.binned`` gives them."""
    of = defaultdict(list)
    for g, *arrays in pieces:
        of[g].append(arrays)
    parts = {g: Part(np.concatenate([a[0] for a in of[g]], axis=1), *(np.concatenate([a[i] for a in of[g]]) for i in (1, 2))) for g in sorted(of)}
    return plan.grow(in_memory(lambda r: [(parts[g], times) for g, times in plan.seen(r) if g in parts]), seed)


@dataclass
class Judge:
    """The trained trees with what they need to know about words, and the calibration of their scores."""

    language: Language
    trees: Trees
    slope: float = 1.0
    offset: float = 0.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The probability of each passage to be junk, from its statistics."""
        return self._probable(self.trees.margins(x))

    def probabilities_of_codes(self, codes: np.ndarray) -> np.ndarray:
        """The same from codes of statistics, one row per statistic."""
        limits = encoded(np.minimum(self.trees.threshold, decoded(_MOST)))
        # the largest code of a number that isn't above the threshold
        limits -= decoded(limits) > self.trees.threshold
        return self._probable(self.trees.totals(codes, limits, _MOST))

    def _probable(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins * self.slope + self.offset, -50, 50)))


def judge_from(language: Language, trees: Trees) -> Judge:
    """A judge whose scores are calibrated on the checked passages."""
    judge = Judge(language, trees)
    judge.slope, judge.offset = calibrate(list(zip(trees.margins(_checked(CHECKED, language)), [y for y, block in CHECKED for p in block.split("\n") for _ in passages(p)], strict=True)))
    return judge


def fit(texts: list[str], made_up_documents: int, seed: int = 11) -> Judge:
    """What ``train`` gives for documents with these texts, in memory. Always trained, also on no texts."""
    texts = sorted(set(texts))
    words, drawn = Counter(), Drawn()
    count_words(list(made_up.SEED_PROSE), words)
    read = list(labelled([hashlib.md5(t.encode()).digest() for t in texts], texts, words))
    for b, ps, _ in read:
        drawn.add(b, ps)
    language = vocabulary(lower_words(words), len(made_up.SEED_PROSE) + sum(int((b.y == 0).sum()) for b, _, _ in read))
    pairs = no_pairs(language)
    for units, prose in [(units, b.y == 0) for b, _, units in read] + [seed_units()]:
        count_pairs(units, prose, language, pairs)
    language.usual = usual_order(pairs)
    blocks = [understood(b, units, language) for b, _, units in read] + list(made_up_blocks([p for _, p in drawn.lowest()], made_up_documents, seed, language))
    tallies = np.zeros((_TALLIES, _CODES), np.int64)
    for b in blocks:
        tally(b, tallies)
    plan = plan_of(tallies)
    grown = grown_here((piece for b in blocks for piece in plan.binned(b)), plan, seed)
    return judge_from(language, grown.trees(plan.thresholds))


def _checked(blocks: list[tuple[int, str]], language: Language) -> np.ndarray:
    """Statistics of the passages of blocks ``(label, lines)``."""
    cut = [passages(b) for _, b in blocks]
    starts = np.cumsum([0, *map(len, cut)])[:-1]
    return statistics([p for c in cut for p in c], starts.tolist(), language)


def calibrate(rows: list[tuple[float, int]], rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into log odds, by a penalised logistic fit to (margin, is junk)."""
    m, y = np.array(rows, float).reshape(-1, 2).T
    x, w = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.array([1.0, 0.1])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - [1.0, 0.0]))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


#: Tables between the steps: rows are blocks of passages (of the corpus, or made up) or counts by word or by number.
_TABLE = "kind int, marks binary, counts binary, own binary, y binary, chars binary, counted binary, units binary, heard binary, words array<string>, keys array<bigint>, numbers array<bigint>"
_OF_CORPUS, _MADE_UP, _WORDS, _DRAWN, _PROSE, _COUNTS = range(6)
_PIECES = "stratum int, n int, binned binary, y binary, w binary"
#: Blocks are some hundred kilobytes each: few stand in a row group, and few reach a Python worker together.
_NARROW = {"parquet.block.row.count.limit": "8", "compression": "zstd"}
_AT_ONCE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
#: Words that a task counts, and passages that it gathers by group, before it hands them on.
_WORDS_HELD, _PASSAGES_HELD = 100_000, 400_000


def _row(kind: int, **values) -> pd.DataFrame:
    return pd.DataFrame([{**dict.fromkeys(("marks", "counts", "own", "y", "chars", "counted", "units", "heard", "words", "keys", "numbers")), "kind": kind, **values}])


def _some(array: np.ndarray) -> dict:
    """What is not zero in an array of counts, by place."""
    at = np.flatnonzero(array)
    return {"keys": at, "numbers": array.ravel()[at]}


def _array(table: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sums of the counts of a table's rows by place, as an array."""
    pairs = table.where(F.col("kind") == _COUNTS).select(F.explode(F.arrays_zip("keys", "numbers")).alias("e"))
    found = pairs.groupBy(F.col("e.keys").alias("k")).agg(F.sum("e.numbers").alias("n")).toPandas()
    out = np.zeros(shape[0] * shape[1], np.int64)
    out[found["k"].to_numpy(int)] = found["n"].to_numpy(int)
    return out.reshape(shape)


def _read(docs: DataFrame, text: str) -> DataFrame:
    """All passages of all distinct texts with their weak labels, the words of those that are prose, and those to draw from."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, drawn, n = Counter(), Drawn(), 0
        for batch in batches:
            for block, ps, units in labelled([bytes(m) for m in batch["mark"]], list(batch["text"]), words):
                drawn.add(block, ps)
                n += int((block.y == 0).sum())
                yield _row(_OF_CORPUS, **block.packed(), **units.packed())
                if len(words) > _WORDS_HELD:
                    counts = lower_words(words)
                    yield _row(_WORDS, words=[w for w, _ in counts], numbers=[c for _, c in counts])
                    words.clear()
        counts, rows = lower_words(words), drawn.lowest()
        yield _row(_WORDS, words=[w for w, _ in counts], numbers=[c for _, c in counts])
        yield _row(_DRAWN, words=[p for _, p in rows], numbers=[k for k, _ in rows])
        yield _row(_PROSE, numbers=[n])

    _tables()  # sent along, not built in every task
    texts = docs.where(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("mark"), F.col(text).alias("text"))
    return stored(texts.distinct().mapInPandas(read, _TABLE), "passages", _NARROW)


def _language(table: DataFrame) -> Language:
    """The language of all prose of the passages."""
    seed = Counter()
    count_words(list(made_up.SEED_PROSE), seed)
    counted = table.where(F.col("kind") == _WORDS).select(F.explode(F.arrays_zip("words", "numbers")).alias("e")).select(F.col("e.words").alias("word"), F.col("e.numbers").alias("n"))
    counted = counted.union(table.sparkSession.createDataFrame(lower_words(seed), "word string, n bigint")).groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where("n >= 2").orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toPandas()
    n = table.where(F.col("kind") == _PROSE).agg(F.sum(F.col("numbers")[0])).first()[0] or 0
    language = vocabulary(list(zip(rows["word"], rows["n"].astype(int), strict=True)), n + len(made_up.SEED_PROSE))

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = no_pairs(language)
        for batch in batches:
            for row in batch.itertuples():
                count_pairs(_units(row), np.frombuffer(row.y, np.int8) == 0, language, pairs)
        yield _row(_COUNTS, **_some(pairs))

    pairs = no_pairs(language)
    count_pairs(*seed_units(), language, pairs)
    pairs += _array(table.where(F.col("kind") == _OF_CORPUS).select("counted", "units", "heard", "y").mapInPandas(paired, _TABLE), pairs.shape)
    language.usual = usual_order(pairs)
    return language


def _understood(table: DataFrame, language: Language, made: int, seed: int) -> DataFrame:
    """The blocks of the corpus and made-up ones with all statistics, and the tallies of both."""

    def told(blocks: Iterator[Block], kind: int) -> Iterator[pd.DataFrame]:
        tallies = np.zeros((_TALLIES, _CODES), np.int64)
        for block in blocks:
            tally(block, tallies)
            yield _row(kind, **block.packed())
        yield _row(_COUNTS, **_some(tallies))

    def of_corpus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from told((understood(unpacked(row), _units(row), language) for batch in batches for row in batch.itertuples()), _OF_CORPUS)

    rows = table.where(F.col("kind") == _DRAWN).select(F.explode(F.arrays_zip("words", "numbers")).alias("e")).select("e.*")
    drawn = [r["words"] for r in rows.orderBy("numbers", "words").limit(MADE_UP_FROM).collect()]

    def made_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield from told(made_up_blocks(drawn, made, seed, language), _MADE_UP)

    one = table.sparkSession.range(0, 1, 1, 1).mapInPandas(made_here, _TABLE)
    return stored(table.where(F.col("kind") == _OF_CORPUS).mapInPandas(of_corpus, _TABLE).union(one), "statistics", _NARROW)


def _in_pieces(table: DataFrame, plan: Plan) -> DataFrame:
    """The labelled passages as boosting reads them, gathered by group."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = defaultdict(list), 0

        def gathered() -> Iterator[pd.DataFrame]:
            for g, parts in held.items():
                binned, y, w = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
                yield pd.DataFrame([{"stratum": g, "n": len(y), "binned": binned.tobytes(), "y": y.tobytes(), "w": w.tobytes()}])

        for batch in batches:
            for row in batch.itertuples():
                for g, *arrays in plan.binned(unpacked(row)):
                    held[g].append(arrays)
                    n += len(arrays[1])
            if n > _PASSAGES_HELD:
                yield from gathered()
                held.clear()
                n = 0
        yield from gathered()

    return table.where(F.col("kind").isin(_OF_CORPUS, _MADE_UP)).mapInPandas(pieces, _PIECES)


def _piece(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.binned, np.uint8).reshape(len(FEATURES), row.n), np.frombuffer(row.y), np.frombuffer(row.w)


def _grown_by_all(pieces: DataFrame, plan: Plan, seed: int) -> Grown:
    """Trees grown by all tasks: the rows of a round are kept with their slopes, and one job per level takes sums of them."""
    now: dict = {"round": -1, "rows": None}

    def histograms(r: int, out: Grown, used: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        if now["round"] != r:
            if now["rows"] is not None:
                now["rows"].unpersist()
            so_far, times = Grown(out.feature[:r].copy(), out.cut[:r].copy(), out.value[:r].copy(), out.base), dict(plan.seen(r))

            def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for row in batch.itertuples():
                        binned, y, w = _piece(row)
                        g, h = slopes(so_far.advance(binned, np.full(row.n, so_far.base), 0, r), y, w * times[row.stratum])
                        yield pd.DataFrame([{"n": row.n, "seen": binned[used].tobytes(), "g": g.tobytes(), "h": h.tobytes()}])

            now["round"], now["rows"] = r, pieces.where(F.col("stratum").isin(list(times))).mapInPandas(begun, "n int, seen binary, g binary, h binary").persist()
        feature, cut = feature.copy(), cut.copy()

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, len(used), summed_nodes(level), BINS))
            for batch in batches:
                for row in batch.itertuples():
                    seen = np.frombuffer(row.seen, np.uint8).reshape(len(used), row.n)
                    total += sums(seen, np.frombuffer(row.g), np.frombuffer(row.h), feature, cut, level)
            yield pd.DataFrame([{"sums": total.tobytes()}])

        total = np.zeros((2, len(used), summed_nodes(level), BINS))
        for row in now["rows"].mapInPandas(summed, "sums binary").collect():
            total += np.frombuffer(row["sums"]).reshape(total.shape)
        return total

    try:
        return plan.grow(histograms, seed)
    finally:
        if now["rows"] is not None:
            now["rows"].unpersist()


def _grown(table: DataFrame, plan: Plan, seed: int) -> Grown:
    pieces = _in_pieces(table, plan)
    if plan.rows > ONE_TASK:
        pieces = stored(pieces, "pieces", {"parquet.block.row.count.limit": "1", "compression": "zstd"})
        grown = _grown_by_all(pieces, plan, seed)
        forget(pieces)
        return grown

    def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = grown_here(((row.stratum, *_piece(row)) for batch in batches for row in batch.itertuples()), plan, seed)
        yield pd.DataFrame({"grown": [pickle.dumps(vars(grown))]})

    return Grown(**pickle.loads(pieces.repartition(1).mapInPandas(here, "grown binary").first()["grown"]))


def _trained(docs: DataFrame, text: str, seed: int) -> tuple[Judge, DataFrame]:
    """The judge, and the table of all passages of the distinct texts with their statistics."""
    table = _read(docs, text)
    with settings(docs.sparkSession, _AT_ONCE):
        language = _language(table)
        known = _understood(table, language, MADE_UP_DOCUMENTS, seed)
        forget(table)
        plan = plan_of(_array(known, (_TALLIES, _CODES)))
        return judge_from(language, _grown(known, plan, seed).trees(plan.thresholds)), known


def train(docs: DataFrame, text: str = "text", seed: int = 11) -> Judge:
    """A judge fitted to all distinct texts, and to made-up documents.

    Every passage that a rule labels counts in the words, their order, the cuts and the trees. Sums are of whole numbers, so the
    judge does not depend on how rows are split or ordered, nor on copies of a text. A tree sees those groups of passages that
    its round is dealt (``boosting.dealt``): at most 7 of 20, at least one, all groups equally often, so each passage is in three trees or more.
    """
    judge, known = _trained(docs, text, seed)
    forget(known)
    return judge


def junk_shares(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document id ``doc_id, n_chars, junk_share, expected_share``: how much of it is not prose.

    ``junk_share`` is the share of characters in passages more likely junk than prose, ``expected_share`` the mean of
    the calibrated probabilities over the characters. The judge is trained on all these documents and on made-up ones
    (``train``), in the same way at every size; every passage of every text is scored from the statistics it was trained
    on. White space around passages doesn't count. Documents without any passage (NULL or blank texts) and NULL
    ids give no row; repeated rows change no share; other columns are ignored. Only the judge (some hundred thousand
    numbers at most) is sent to the tasks.
    """
    judge, known = _trained(docs, text, 11)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # the trees take the passages of several blocks at once
            blocks = [unpacked(row) for row in batch.itertuples()]
            whole, at = judge.probabilities_of_codes(np.concatenate([b.codes() for b in blocks], axis=1)) if blocks else None, 0
            for block in blocks:
                p = whole[at : at + len(block.y)]
                at += len(block.y)
                size, n = block.chars.astype(float), len(block.counts)
                of = np.repeat(np.arange(n), block.counts)
                total = lambda v: np.bincount(of, v, n)  # noqa: B023, E731
                marks = [block.marks[i : i + 16] for i in range(0, 16 * n, 16)]
                out = pd.DataFrame({"mark": marks, "n_chars": total(size).astype(int), "junk": total(size * (p > 0.5)).astype(int), "expected": total(size * p)})
                yield out[out["n_chars"] > 0]

    with settings(docs.sparkSession, _AT_ONCE):
        scores = stored(known.where(F.col("kind") == _OF_CORPUS).mapInPandas(judged, "mark binary, n_chars bigint, junk bigint, expected double"), "scores")
    forget(known)
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("mark"))
    parts = rows.join(scores, "mark").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n_chars", "junk", "expected")])
    return parts.select(F.col("id").alias(doc_id), "n_chars", (F.col("junk") / F.col("n_chars")).alias("junk_share"), (F.col("expected") / F.col("n_chars")).alias("expected_share"))
