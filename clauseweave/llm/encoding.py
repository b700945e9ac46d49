"""Garbled text from wrong character encodings (problem 10).

Noisy channel: the bytes behind a damaged word are rebuilt under each codec that may have misread
them, as one lattice in which a character stands for itself, for a byte of a multi-byte character or,
where bytes were lost (U+FFFD, or ? inside a word), for any character that fits the bytes that are
left. A Viterbi search through the lattice, under character statistics of the corpus' words weighted
by their frequency, gives the best readings, and the frequencies of the words decide between them.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clauseweave.plans.session import cut, stash

# Codecs that commonly write or misread text.
MISREAD_AS = ["cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman", "koi8-r", "cp866"]
SINGLE_BYTE = ["cp1252", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp866", "mac_roman", "cp437", "cp850"]
LOST = "�"
ALPHABET = r"\\p{Ll}'’\\-–“”„‘"
SUSPECT = r"[^\x00-\x7f]"
# Characters that a correct text of a European language may hold beside ASCII.
PLAUSIBLE = re.compile(r"[A-Za-z0-9¡-ſȘ-țΆ-ώЀ-џҐґ‐-‧‰-›€№™ Ẁ-ỹ←-⇿−≠-≥●•ﬁﬂ]|[\x00-\x7f]")
LETTER = r"\p{L}"
ASKED = r"\p{L}\?\p{L}"


def byte_of(ch: str, codec: str) -> int | None:
    """The byte that ``codec`` shows as ``ch``; bytes that it doesn't define show as themselves."""
    try:
        b = ch.encode(codec)
        return b[0] if len(b) == 1 else None
    except UnicodeEncodeError:
        return ord(ch) if 0x80 <= ord(ch) <= 0x9F else None


@cache
def table_of(codec: str) -> dict[str, int]:
    """Character -> byte for the upper half of a codec."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


@cache
def by_bytes(wild: str) -> dict[tuple[int, int], list[tuple[bytes, str]]]:
    """(lead byte, length) -> the characters of ``wild`` that UTF-8 writes so."""
    out: dict[tuple[int, int], list[tuple[bytes, str]]] = defaultdict(list)
    for x in wild:
        b = x.encode("utf-8")
        out[b[0], len(b)].append((b, x))
    return out


@cache
def traces(codec: str) -> re.Pattern:
    """What UTF-8 read as ``codec`` leaves: the sign of a lead byte before that of a continuation byte."""
    t = table_of(codec)
    signs = lambda lo, hi: "".join(re.escape(c) for c, b in t.items() if lo <= b <= hi)
    return re.compile(f"[{signs(0xC2, 0xF4)}][{signs(0x80, 0xBF)}{LOST}]")


@cache
def recoding(shown: str, meant: str) -> dict[int, str]:
    """Character as read by ``shown`` -> the character that ``meant`` has for its byte, where it has one."""
    out = {}
    for ch, b in table_of(shown).items():
        try:
            out[ord(ch)] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            pass
    return out


KEPT = 50.0  # cost of keeping characters that are one misread character
Arc = tuple[int, str, float, bool]


def misread_utf8(word: str, codec: str, wild: str) -> list[list[Arc]]:
    """The lattice of a word whose UTF-8 was read as ``codec``: (next position, character, cost, odd) from each position.

    A lead byte with its continuation bytes is one character; where continuation bytes were lost,
    any character of ``wild`` with the bytes that are left. A lost byte alone is any character of
    ``wild`` and, beside another, nothing. odd: one of the signs isn't a letter, which no correct
    word has at that place.
    """
    t = table_of(codec)
    out: list[list[Arc]] = []
    for i, ch in enumerate(word):
        here: list[Arc] = []
        b = t.get(ch)
        n = 2 if b and 0xC2 <= b <= 0xDF else 3 if b and 0xE0 <= b <= 0xEF else 4 if b and 0xF0 <= b <= 0xF4 else 0
        seq = [None if c == LOST else t.get(c, -1) for c in word[i : i + n]] if n and i + n <= len(word) else []
        if seq and all(x is None or 0x80 <= x <= 0xBF for x in seq[1:]):
            if None in seq:
                here += [(i + n, x, 0.5, True) for full, x in by_bytes(wild)[seq[0], n] if all(y is None or y == z for y, z in zip(seq, full, strict=True))]
            else:
                try:
                    here.append((i + n, bytes(seq).decode("utf-8"), 0.0, not all(map(str.isalpha, word[i : i + n]))))
                except UnicodeDecodeError:
                    pass
        if ch == LOST and wild:
            here += [(i + 1, x, 0.0, True) for x in wild]
            here += [(i + 1, "", 1.0, True)] if i and word[i - 1] == LOST else []
        else:
            here.append((i + 1, ch, KEPT if here else 0.0, False))
        out.append(here)
    return out


def search(arcs: list[list[Arc]], cost: dict[str, float], best: int) -> list[tuple[str, bool]]:
    """The ``best`` cheapest (reading, odd) through a lattice, by Viterbi search over (position, last character).

    Characters that the corpus' words never show side by side cost 14. Where no byte was lost, every
    step but the first is far dearer than it (``KEPT``), so the first ones are the cheapest path. Only paths to one position
    wait for each other, so time and room grow with the length of the word.
    """
    if best == 1 and all(len(here) == 1 or len(here) == 2 and here[1][2] == KEPT for here in arcs):
        i, out, odd = 0, "", False
        while i < len(arcs):
            i, x, _, o = arcs[i][0]
            out, odd = out + x, odd or o
        return [(out, odd)]
    ahead: dict[int, dict[str, list[tuple[float, str, bool]]]] = {0: {"^": [(0.0, "", False)]}}
    for i, here in enumerate(arcs):
        for prev, paths in ahead.pop(i, {}).items():
            paths = sorted(set(paths))[:best]
            for j, x, c, odd in here:
                step = c + (cost.get(prev + x.lower()[:1], 14.0) if x and cost else 0.0)
                ahead.setdefault(j, {}).setdefault(x.lower()[-1:] or prev, []).extend((d + step, p + x, o or odd) for d, p, o in paths)
    ends = [(d + (cost.get(x + "$", 14.0) if cost else 0.0), p, o) for x, paths in ahead.get(len(arcs), {}).items() for d, p, o in sorted(set(paths))[:best]]
    return [(p, o) for _, p, o in sorted(ends)[:best]]


LONG = 40  # longer words are read once, not in several ways


def readings(word: str, cost: dict[str, float] | None = None, wild: str = "", best: int = 6) -> list[tuple[str, str, bool]]:
    """(reading, how, is the misreading plain) for each way that explains ``word``, best first for each codec.

    UTF-8 may have been misread twice; both steps are offered. Where bytes were lost, ``best``
    readings of each lattice come out (one, if the word is long), without ``wild`` the lost bytes stay.
    """
    cost, out = cost or {}, {}
    lost = LOST in word and bool(wild)
    many = (best if len(word) <= LONG else 1) if lost else 1
    alone = lost  # lost bytes alone make the same lattice under each codec
    for codec in MISREAD_AS:
        if not traces(codec).search(word):
            if not alone:
                continue
            alone = False
        for r, odd in search(misread_utf8(word, codec, wild), cost, many):
            if r == word:
                continue
            how = "lost bytes" if lost else f"utf-8 as {codec}"
            out.setdefault(r, (how, odd))
            if odd and not lost:
                for again in MISREAD_AS:
                    if not traces(again).search(r):
                        continue
                    for twice, odd2 in search(misread_utf8(r, again, wild), cost, 1):
                        if twice != r and odd2:
                            out.setdefault(twice, (f"utf-8 as {codec}, twice", True))
    if LOST not in word:  # each byte of a single-byte codec is one character: the lattice has one path
        signs = {ord(c) for c in word if ord(c) > 127}
        for shown in SINGLE_BYTE:
            for meant in SINGLE_BYTE:
                if shown != meant and signs <= recoding(shown, meant).keys():
                    r = word.translate(recoding(shown, meant))
                    if r != word:
                        out.setdefault(r, (f"{meant} as {shown}", False))
    return [(r, how, odd) for r, (how, odd) in out.items()]


def core(word: str) -> str:
    """The word without ASCII marks at its ends."""
    return word.strip("\t !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _core(c):
    return F.regexp_replace(c, r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$", "")


def _odd_words(text: str):
    """The distinct cores of the words with non-ASCII characters (those longer in bytes than in characters) or ? between letters.

    Such a ? stands for a lost byte, as U+FFFD does.
    """
    odd = F.filter(F.split(text, r"[ \t\r\n\f]+"), lambda w: (F.octet_length(w) != F.length(w)) | (w.contains("?") & w.rlike(ASKED)))
    return F.array_distinct(F.transform(odd, _core))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(core, freq): in how many texts each word with non-ASCII characters occurs, over the whole corpus.

    What a misreading damages is never ASCII, so words of ASCII only are neither damaged nor
    readings of damaged ones.
    """
    return df.select(F.explode(_odd_words(text)).alias("core")).where("core <> ''").groupBy("core").agg(F.count("*").alias("freq"))


def bigrams(freq: DataFrame) -> dict[str, float]:
    """Cost (negative log probability) of each pair of neighbouring characters in corpus words.

    Only pairs of characters of ``ALPHABET`` are kept, so the table is bounded by its square, not
    by the corpus; words enter with the logarithm of their frequency.
    """
    w = freq.where(~F.col("core").contains(LOST)).select(F.concat(F.lit("^"), "core", F.lit("$")).alias("w"), F.log1p("freq").alias("n"))
    pairs = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"), "n")
    rows = pairs.where(F.col("p").rlike(f"^(?:[\\^{ALPHABET}][{ALPHABET}$])$")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    total: dict[str, float] = defaultdict(float)
    for p, n in rows:
        total[p[0]] += n
    return {p: -math.log(n / total[p[0]]) for p, n in rows}


def viterbi(word: str, cost: dict[str, float], wild: str, best: int = 6) -> list[str]:
    """The ``best`` likeliest readings of a word that lost bytes."""
    return [r for r, _ in search(misread_utf8(word, MISREAD_AS[0], wild), cost, best)]


CANDIDATES = "core string, reading string, rcore string, how string, structural boolean, plain boolean"


def candidates(odd: DataFrame, cost: dict[str, float]) -> DataFrame:
    """(core, reading, rcore, how, structural, plain) of the distinct words with non-ASCII characters.

    A word that lost bytes also has a row without reading: it is damaged, whatever fits.
    """
    wild = "".join(sorted({x for p in cost for x in p if ord(x) > 127}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w in b["core"]:
                if LOST in w:
                    out.append((w, w, None, "lost bytes", True, True))
                for r, how, odd_ in readings(w, cost, wild if any(map(str.isalpha, w)) else ""):
                    out.append((w, r, core(r).lower(), how, how.startswith(("utf-8", "lost")), odd_))
            yield pd.DataFrame(out, columns=["core", "reading", "rcore", "how", "structural", "plain"])

    return odd.mapInPandas(run, CANDIDATES)


def sound(reading: str) -> bool:
    """A reading of misread UTF-8 is credible: what it restores are letters or common marks."""
    return all(map(PLAUSIBLE.match, reading)) and not re.search(r"[\x80-\x9f]", reading)


def _sound(s: pd.Series) -> pd.Series:
    return s.map(sound).astype(bool)


SIGN_RATIO = 50.0  # the same for words of one character, which collide by chance


def damaged_words(df: DataFrame, text: str = "text", ratio: float = 4.0) -> DataFrame:
    """(core, reading, how) of each distinct word of the corpus that a misreading produced.

    reading is null where bytes were lost and no known word fits. A word counts as damaged if it
    holds U+FFFD or a C1 control, if a UTF-8 sequence hides in it whose restored form is credible
    (where the sequence consists of letters only, it must also be a corpus word), or if under
    another single-byte codec it is a corpus word at least ``ratio`` times as frequent. Frequencies
    are of texts that hold the word in any case.

    Only the distinct words with non-ASCII characters reach Python; their readings meet the word
    frequencies in equi joins. Only the table of character pairs (``bigrams``), which the alphabet
    bounds, is collected and sent to the tasks. A word with ? between letters counts as damaged only
    if a known word with a non-ASCII character at that place fits it.
    """
    return damaged_among(cut(word_counts(df, text)), ratio)


def damaged_among(counts: DataFrame, ratio: float = 4.0) -> DataFrame:
    """``damaged_words`` of a corpus with these ``word_counts``."""
    freq = cut(counts.groupBy(F.lower("core").alias("core")).agg(F.sum("freq").alias("freq")))
    odd = counts.where(F.col("core").rlike(SUSPECT))
    asked = counts.where(F.col("core").rlike(ASKED) & ~F.col("core").rlike(SUSPECT))
    cand = candidates(odd.select("core"), bigrams(freq))
    mask = lambda c: F.regexp_replace(F.lower(c), r"[^\x00-\x7f]+", LOST)
    known = freq.where(F.col("core").rlike(SUSPECT) & ~F.col("core").contains(LOST) & (F.col("freq") >= 2))
    lost = odd.where(F.col("core").contains(LOST)).unionByName(asked)
    lost = lost.select("core", mask(F.regexp_replace("core", r"(?<=\p{L})\?(?=\p{L})", LOST)).alias("mask"))
    fits = lost.join(known.groupBy(mask("core").alias("mask")).agg(F.max_by("core", F.struct("freq", "core")).alias("reading")), "mask")
    cand = cand.unionByName(fits.select("core", "reading", F.col("reading").alias("rcore"), F.lit("lost bytes").alias("how"), F.lit(True).alias("structural"), F.lit(True).alias("plain")))
    own = odd.unionByName(asked).select("core", F.lower("core").alias("l")).join(freq.select(F.col("core").alias("l"), "freq"), "l").drop("l")
    cand = cand.join(own, "core").join(freq.select(F.col("core").alias("rcore"), F.col("freq").alias("rfreq")), "rcore", "left").fillna({"rfreq": 0})
    credible = F.pandas_udf(_sound, "boolean")
    by_utf8 = (credible("reading") & (F.col("plain") | (ratio * F.col("rfreq") >= F.col("freq")))) | (F.col("rfreq") > F.col("freq"))
    least = F.when(F.length("core") > 1, ratio).otherwise(SIGN_RATIO) * F.col("freq")
    by_count = (F.col("rfreq") >= 2) & (F.col("rfreq") >= least) & F.col("rcore").rlike(LETTER + "|[–—“”‘’„]")
    cand = cand.where(F.when(F.col("how") == "lost bytes", True).when(F.col("structural"), by_utf8).otherwise(by_count))
    best = cand.groupBy("core").agg(F.max_by(F.struct("reading", "how"), F.struct("rfreq", "structural", ~F.col("reading").contains(LOST) & (F.col("how") != "lost bytes"), "reading")).alias("b"))
    best = cut(best.select("core", F.when(~F.col("b.reading").contains(LOST), F.col("b.reading")).alias("reading"), "b.how"))
    c1 = odd.where(F.col("core").rlike(r"[\x{80}-\x{84}\x{86}-\x{9f}]")).select("core")
    rest = c1.join(best, "core", "left_anti").select("core", F.lit(None).cast("string").alias("reading"), F.lit("control characters").alias("how"))
    return best.unionByName(rest)


def garbled_ids(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``key`` of each text with at least one damaged character. Null and empty texts have none."""
    have = stash(df.select(key, F.explode(_odd_words(text)).alias("core")).where("core <> ''"))
    bad = cut(damaged_among(cut(have.groupBy("core").agg(F.count("*").alias("freq")))))
    return have.join(bad.select("core"), "core", "left_semi").select(key).distinct()


def as_written(word: str, reading: str) -> str:
    """``word`` with ``reading`` in place of its core; a reading by word frequency takes its case."""
    own = core(word)
    i = word.find(own) if own else -1
    if i < 0:
        return word
    if LOST in own or "?" in own:
        reading = reading.upper() if own.isupper() and len(own) > 2 else reading[:1].upper() + reading[1:] if own[:1].isupper() else reading
    return word[:i] + reading + word[i + len(own) :]


def restore(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, n_damaged, n_restored) of the garbled texts; white space is kept as it is.

    Words are looked up by equi join and put back by position, so a text is one row before and
    after. What can't be restored stays.
    """
    src = df.select(key, text)
    bad = cut(damaged_words(src, text))
    ids = src.where(F.col(text).rlike(SUSPECT) | F.col(text).rlike(ASKED))
    parts = ids.select(key, F.posexplode(F.split(text, r"(?<=[ \t\r\n\f])(?![ \t\r\n\f])")).alias("pos", "part"))
    parts = parts.withColumn("word", F.regexp_replace("part", r"[ \t\r\n\f]+$", "")).withColumn("core", _core("word"))

    def put(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for w, p, r in batches:
            yield pd.Series([as_written(a, c) + b[len(a) :] if isinstance(c, str) else b for a, b, c in zip(w, p, r, strict=True)])

    put_back = F.pandas_udf(put, "string")
    j = parts.join(bad, "core", "left").withColumn("damaged", F.col("how").isNotNull())
    j = j.withColumn("new", F.when(F.col("reading").isNotNull(), put_back("word", "part", "reading")).otherwise(F.col("part")))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("a"), F.sum(F.col("damaged").cast("int")).alias("n_damaged"), F.sum(F.col("reading").isNotNull().cast("int")).alias("n_restored"))
    return g.where("n_damaged > 0").select(key, F.concat_ws("", F.col("a.new")).alias("restored"), F.col("n_damaged").cast("int").alias("n_damaged"), F.col("n_restored").cast("int").alias("n_restored"))
