"""Variant spellings of names typed by people (problem 6)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clauseweave.llm.components import contract
from clauseweave.plans.session import cut

# Legal forms, titles and joining words, which say nothing about identity.
LEGAL = set(
    """inc incorporated llc ltd limited plc corp corporation company co gmbh mbh gesellschaft ag kg ohg se sa sas sarl srl spa bv nv ab as asa oy oyj aps pty pte pvt
    lp llp gesmbh ek ev sp zoo kft sro doo kk""".split()
)
FILLERS = set("dr prof mr mrs ms mx miss sir and und et y e the of von de van der la le & group holding".split())
# Words of trades and of company names, with their usual abbreviations.
TRADES = {
    "advertising": "adv advt advertizing", "analytics": "anlytcs analyt anlyt", "apps": "app applications", "audio": "", "bank": "banking", "books": "", "cloud": "cld",
    "consulting": "consult", "data": "", "design": "", "digital": "dig digi dgtl", "education": "edu", "energy": "", "entertainment": "ent entmt", "enterprises": "entpr",
    "fashion": "", "finance": "fin financial", "foods": "food fds", "games": "game gaming gms", "health": "hlth healthcare", "home": "", "insurance": "ins", "interactive": "interact intract",
    "international": "intl int'l int", "labs": "lab laboratories", "learning": "", "logistics": "", "maps": "map mapping", "marketing": "mktg mkt mktng", "media": "med", "mobile": "mob mbl",
    "music": "", "networks": "netw network nets networking", "news": "", "online": "", "payments": "pay payment pmts pymts", "photo": "", "pictures": "", "research": "", "retail": "", "security": "sec",
    "services": "svcs service serv svc", "software": "sw softw sftw", "solutions": "solns solution soln", "sports": "", "studios": "stud studio", "systems": "sys system syst",
    "technologies": "tech technology techn", "telecom": "", "trading": "", "travel": "trvl", "ventures": "", "video": "", "web": "",
}
GENERIC = set("privacy team ad ads sdk support help legal office contact app mobile data tracking tag manager library platform service services cdn api pixel".split())
# Given names and what people call their bearers.
NICKNAMES = {
    "alexander": "alex sandy xander sasha lex", "alexandra": "alex sandra sasha lexi", "anastasia": "nastya stasia ana stacy asya nastia", "andrew": "andy drew", "anthony": "tony ant",
    "antonio": "toni tonio", "benjamin": "ben benny", "catherine": "cathy kate katie cat", "charles": "charlie chuck chas", "christina": "tina chris chrissy christy", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave davy", "dorothea": "dora thea dot dorothy doro dolly", "edward": "ed eddie ted ned teddy", "elizabeth": "beth liz lizzie eliza betty lisa bess libby", "emily": "emmy",
    "francisco": "fran paco pancho cisco frank", "frederick": "fred freddy", "george": "geo", "giuseppe": "beppe peppe pino giu", "gregory": "greg", "helena": "lena helen", "james": "jim jimmy jas jamie",
    "johannes": "hannes joh hans jan johan", "john": "jack johnny jon", "jonathan": "jon nathan", "joseph": "joe joey jos", "katherine": "kate katie kathy kat kit kathryn kath", "laurence": "larry",
    "leonard": "leo len", "margaret": "meg maggie peggy greta marge rita daisy", "maria": "mia mary", "matthew": "matt", "michael": "mike mick mickey mikey", "nicholas": "nick nicky", "patricia": "pat patty tricia",
    "peter": "pete", "philip": "phil pip", "rebecca": "becky", "richard": "rick dick rich ricky richie", "robert": "rob bob bobby bert robbie", "samuel": "sam sammy", "stephen": "steve", "susanna": "sue susie suzy sanna anna susan",
    "theodora": "dora thea theo teddy", "theodore": "ted theo teddy", "thomas": "tom tommy thos", "timothy": "tim", "victoria": "vicky tori", "vincent": "vince", "walter": "walt wally", "william": "will bill wm billy willy liam",
}
GIVEN: dict[str, set[str]] = {}
for _g, _n in NICKNAMES.items():
    GIVEN.setdefault(_g, set()).add(_g)
    for _x in _n.split():
        GIVEN.setdefault(_x, set()).add(_g)
TRADE: dict[str, str] = {}
for _g, _n in TRADES.items():
    TRADE[_g] = _g
    for _x in _n.split():
        TRADE[_x] = _g


def plain(s: str) -> str:
    """Without accents and with the letters that don't decompose spelled plainly."""
    s = s.translate(str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"}))
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (a swap of neighbours is one), ``most`` + 1 if above."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return prev[-1]


def slack(n: int) -> int:
    """How many typing errors a word of ``n`` letters may hold."""
    return 0 if n < 4 else 1 if n < 8 else 2


def deletes(w: str, n: int) -> set[str]:
    """``w`` and what is left of it without up to ``n`` of its letters: its symmetric-delete keys."""
    out, last = {w}, {w}
    for _ in range(n):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out |= last
    return out


LEXICON: dict[str, set[str]] = {}
for _x in {*TRADES, *(x for x in TRADE if len(x) > 5), *GIVEN, *LEGAL}:  # short abbreviations must be met exactly
    if len(_x) >= 4:
        for _y in deletes(_x, 1 if len(_x) < 9 else 2):
            LEXICON.setdefault(_y, set()).add(_x)


def near_lexicon(w: str) -> list[str]:
    """Lexicon words that ``w`` may be a misspelling of, the nearest first."""
    cand = {x for y in deletes(w, 1 if len(w) < 8 else 2) for x in LEXICON.get(y, ())}
    found = [(distance(w, x, 1 if len(x) < 9 else 2), x) for x in cand]
    return [x for d, x in sorted(found) if d <= (1 if len(x) < 9 else 2)]


@lru_cache(100_000)
def lexical(w: str) -> tuple[str, frozenset[str]]:
    """Class of a plain lower-case word: 'legal', 'trade', 'given', 'initial', 'short' or 'own', with its canonical forms.

    A short word of two or three letters is a name of its own where a name has no other.
    """
    if len(w) == 1:
        return "initial", frozenset([w])
    if w in LEGAL or w in FILLERS:
        return "legal", frozenset()
    if w in TRADE:
        return "trade", frozenset([TRADE[w]])
    if w in GIVEN:
        return "given", frozenset(GIVEN[w])
    if len(w) < 4:
        return ("own" if w in GENERIC else "legal" if w.isdigit() else "short", frozenset([w]))
    for x in near_lexicon(w):
        if x in TRADE:
            return "trade", frozenset([TRADE[x]])
        if x in GIVEN and len(x) >= 5:
            return "given", frozenset(GIVEN[x])
        if x in LEGAL and len(x) >= 7:
            return "legal", frozenset()
    return "own", frozenset([w])


@dataclass(frozen=True)
class Name:
    """A parsed name: its own words, trades, given names and initials."""

    own: tuple[str, ...] = ()
    trades: frozenset[str] = field(default_factory=frozenset)
    given: frozenset[str] = field(default_factory=frozenset)
    initials: tuple[str, ...] = ()


@lru_cache(100_000)
def parse(text: str) -> Name:
    """Words of a name; order, case, accents, marks and glued capitals don't matter."""
    s = plain(text)
    s = re.sub(r"\b((?:[A-Za-z]\.){2,})", lambda m: m.group(0).replace(".", ""), s)
    s = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})", " ", s)
    own, trades, given, raw, initials, short = [], set(), set(), [], [], []
    for w in re.findall(r"[a-z0-9']+", s.lower()):
        w = w.strip("'")
        kind, forms = lexical(w) if w else ("legal", frozenset())
        if kind == "own" and w not in GENERIC:
            own.append(w)
        elif kind == "trade":
            trades |= forms
        elif kind == "given":
            given |= forms
            raw.append(w)
        elif kind == "initial":
            initials.append(w)
        elif kind == "short":
            short.append(w)
    if trades and given:  # a firm: what looks like a given name is a word of its own or a legal form
        own += raw if len(own) < 2 else []
        given = set()
    if not own and not given:
        own = short
    if len(own) > 2:  # one of them is a badly misspelt common word
        for w in sorted(own, key=len):
            t = {TRADE[x] for x in TRADE if len(x) > 4 and len(w) > 4 and distance(w, x, 2) <= 2}
            g = {y for x in GIVEN if len(x) > 3 and distance(w, x, 2 if len(x) > 6 else 1) <= (2 if len(x) > 6 else 1) for y in GIVEN[x]}
            short = len(w) <= 5 and any(distance(w, x, 1) <= 1 for x in LEGAL | TRADE.keys())
            if len(own) > 2 and (t or g or short):
                own.remove(w)
                trades |= t
                given |= g if not t and not trades else set()
    return Name(tuple(sorted(own)), frozenset(trades), frozenset(given), tuple(sorted(initials)))


def assignment(a: list[str], b: list[str]) -> int | None:
    """Least number of typing errors over all one-to-one alignments of the words ``a`` with ``b``.

    A single letter stands for a word that it begins, free of errors; None if no alignment pairs
    every word of the shorter list within the errors that its length allows.
    """
    if len(a) > len(b):
        a, b = b, a
    best: dict[int, int] = {0: 0}
    for x in a:
        nxt: dict[int, int] = {}
        for used, cost in best.items():
            for j, y in enumerate(b):
                if used >> j & 1:
                    continue
                if len(x) == 1 or len(y) == 1:
                    d, most = (0 if x[0] == y[0] else 9), 0
                else:
                    most = slack(min(len(x), len(y)))
                    d = distance(x, y, most)
                if d <= most:
                    k = used | 1 << j
                    nxt[k] = min(nxt.get(k, 99), cost + d)
        best = nxt
    return min(best.values()) if best else None


def alike(a: str, b: str) -> bool:
    """True if two forms (own words and initials, joined by spaces) name the same person or family of firms."""
    x, y = a.split(), b.split()
    glued = len(x) == 1 or len(y) == 1
    if glued and len(x) != len(y):
        one, two = (x[0], y) if len(x) == 1 else (y[0], x)
        return len(one) >= 9 and all(len(w) > 1 for w in two) and len(two) == 2 and min(distance(one, two[0] + two[1], 2), distance(one, two[1] + two[0], 2)) <= 2
    if glued:
        return len(x[0]) >= 6 and distance(x[0], y[0], 1) <= (1 if min(len(x[0]), len(y[0])) >= 8 else 0)
    d = assignment(x, y)
    return d is not None and len(x) == len(y) and d <= (1 if any(len(w) == 1 for w in x + y) else 2)


def form_of(n: Name) -> str | None:
    """The words that identify a name: two own words, one and an initial, or a lone one."""
    if len(n.own) >= 2:
        return " ".join(n.own)
    if len(n.own) == 1 and n.initials and len(n.own[0]) >= 5:
        return f"{n.initials[0]} {n.own[0]}"
    return n.own[0] if len(n.own) == 1 else None


def is_slight(form: str) -> bool:
    """True for a form of a word and an initial and for a lone word under six letters: it counts only for records that have no fuller one."""
    return form[1:2] == " " or (" " not in form and len(form) < 6)


SLIGHT = r"^. |^[^ ]{1,5}$"


def keys_of(form: str) -> set[str]:
    """Block keys of a form, so that forms within the errors that ``alike`` allows share one.

    The delete neighbourhood of its longest word, of the glued words either way round, and, for two
    errors in the longest word, the other words with the first or last two letters of the longest.
    """
    w = sorted(form.split(), key=lambda x: (len(x), x))
    long = w[-1]
    out = {"d" + x for x in deletes(long, 1)}
    if len(w) == 1:
        return out | {"g" + x for x in deletes(long, 1)}
    rest = " ".join(w[:-1])
    out |= {f"a{rest} {long[:2]}", f"b{rest} {long[-2:]}"}
    if len(w) == 2 and len(w[0]) > 1:
        out |= {"g" + x for y in (w[0] + w[1], w[1] + w[0]) for x in deletes(y, 1)}
        out |= {"d" + x for x in deletes(w[0], 1)} if len(w[0]) >= 8 else set()
    return out


def refined(form: str, key: str) -> set[str]:
    """What ``key`` of ``form`` becomes where too many forms share it; alike forms that share it share one of these.

    A key of one word is refined by the others: their delete neighbourhoods up to the errors they may
    hold, and their first letters for initials. If another word is so near to the key's that an
    alignment may swap the two, the key's own word is one of the others. A key of all words but the
    longest is refined by the longest. Glued words have few neighbours and stay as they are.
    """
    w = sorted(form.split(), key=lambda x: (len(x), x))
    long, kind = w[-1], key[0]
    out = set()
    if kind == "g":
        return {key}
    if kind in "ab":
        out = deletes(long, 2) | ({long[0]} if long[0] in w[:-1] else set())
    else:
        for u in {long, w[0] if len(w) == 2 and len(w[0]) >= 8 else long}:
            if key[1:] not in deletes(u, 1):
                continue
            rest = list(w)
            rest.remove(u)
            out |= {""} if not rest else set()
            if any(len(y) > 1 and max((Counter(y) - Counter(u)).total(), (Counter(u) - Counter(y)).total()) <= 1 + slack(len(y)) for y in rest):
                rest.append(u)
            for y in rest:
                out |= deletes(y, slack(len(y))) | {y[0]}
            out |= {u[0]} if any(len(y) == 1 for y in rest) else set()
    return {f"{key}|{x}" for x in out}


PARSED = "entity_id bigint, form string, trades array<string>, given array<string>, initials array<string>"


def parse_names(records: DataFrame) -> DataFrame:
    """One row per distinct name of a record (``entity_id``, ``name``) with its parse; form may be null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, s in zip(b["entity_id"], b["name"], strict=True):
                n = parse(s)
                out.append((i, form_of(n), sorted(n.trades), sorted(n.given), sorted(n.initials)))
            yield pd.DataFrame(out, columns=["entity_id", "form", "trades", "given", "initials"])

    return records.where("entity_id is not null and trim(name) <> ''").select("entity_id", "name").distinct().mapInPandas(run, PARSED).distinct()


def spread_out(df: DataFrame, column: str) -> DataFrame:
    """``df`` over all shuffle partitions: few small rows that make much work must not be merged into one task.

    By a hash of the column, as a partitioning by the column itself may be there already and would be merged.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(column))


def near_forms(forms: DataFrame, most: int = 64) -> DataFrame:
    """(a, b) of the distinct forms that are alike, a < b, by the symmetric-delete index.

    Forms that share a key are compared. A key that more than ``most`` forms share is ``refined`` by
    the words that didn't give it, which alike forms share as well, so nothing is lost.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, k) for f in b["form"] for k in keys_of(f)], columns=["form", "key"])

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, x) for f, k in zip(b["form"], b["key"], strict=True) for x in refined(f, k)], columns=["form", "key"])

    keyed = cut(spread_out(forms.select("form"), "form").mapInPandas(index, "form string, key string").distinct())
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = keyed.join(sizes, "key")
    fine = live.where(F.col("n") > most).select("form", "key").mapInPandas(refine, "form string, key string").distinct()
    blocks = live.where(F.col("n") <= most).select("form", "key").unionByName(fine)
    pairs = blocks.join(blocks.withColumnRenamed("form", "other"), "key").where("form < other").select(F.col("form").alias("a"), F.col("other").alias("b")).distinct()

    def same(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return pairs.where(F.pandas_udf(same, "boolean")("a", "b"))


def name_families(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parsed names of ``records`` (entity_id and one name each) and (entity_id, family) of those with a form.

    A family is a component of records and name forms; a slight form (a word and an initial, or one
    short word such as "ibm") counts only for records that have no fuller one, so that it doesn't
    tie families together.
    """
    p = cut(parse_names(records))
    named = p.where("form is not null").select("entity_id", "form", F.col("form").rlike(SLIGHT).alias("short")).distinct()
    full = named.where("not short").select("entity_id").distinct()
    named = named.where("not short").unionByName(named.where("short").join(full, "entity_id", "left_anti")).drop("short")
    alike_forms = near_forms(named.select("form").distinct())
    node = F.concat(F.lit("r"), F.col("entity_id").cast("string"))
    links = named.select(node.alias("a"), F.concat(F.lit("f"), "form").alias("b")).unionByName(alike_forms.select(F.concat(F.lit("f"), "a").alias("a"), F.concat(F.lit("f"), "b").alias("b")))
    return p, cut(contract(links).where("id like 'r%'").select(F.substring("id", 2, 30).cast("bigint").alias("entity_id"), F.col("group_id").alias("family")))


def resolve_names(records: DataFrame, evidence: DataFrame, families: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(entity_id, family, kind) of each record: equal values mean the same firm or person.

    records: entity_id and one name each (a record's name and each of its aliases); families: their
    ``name_families``, where they are known already. Within a family, firms differ by trade and persons by given name
    (``kind``). A record that states none takes the only one of its family, else the one that fits
    its initial, else that of records with which it shares most ``evidence`` (entity_id, token), else
    it stays alone. Records without any usable name are alone, too. Nothing is collected: kinds per
    family are bounded by the word lists, all else are joins and combining aggregations.
    """
    p, family = families or name_families(records)
    said = p.where("form is not null").select("entity_id", F.explode(F.array_union("trades", "given")).alias("kind"), F.size(F.array_union("trades", "given")).alias("n"))
    said = said.groupBy("entity_id", "kind").agg(F.sum(1 / F.col("n")).alias("w"))
    top = said.groupBy("entity_id").agg(F.max("w").alias("w"))
    best = said.join(top, ["entity_id", "w"]).groupBy("entity_id").agg(F.collect_set("kind").alias("kinds"))
    initials = p.select("entity_id", F.explode("initials").alias("i")).groupBy("entity_id").agg(F.collect_set("i").alias("initials"))
    r = family.join(best, "entity_id", "left").join(initials, "entity_id", "left")
    r = r.select("entity_id", "family", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.coalesce("initials", F.array().cast("array<string>")).alias("initials"))
    choices = r.where(F.size("kinds") > 0).select("family", (F.size("kinds") == 1).alias("sure"), F.array_join(F.array_sort("kinds"), "/").alias("kind"))
    in_family = choices.groupBy("family").agg(F.collect_set(F.when(F.col("sure"), F.col("kind"))).alias("sure"), F.collect_set("kind").alias("any"))
    in_family = in_family.select("family", F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.col("any")).alias("known"))
    r = cut(r.join(in_family, "family", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))))
    both = F.array_intersect("kinds", "known")
    fits = F.filter("known", lambda k: F.exists("initials", lambda i: k.startswith(i)))
    kind = (
        F.when(F.size("kinds") == 1, F.col("kinds")[0])
        .when((F.size("kinds") > 1) & (F.size(both) == 1), both[0])
        .when((F.size("kinds") == 0) & (F.size("known") == 1), F.col("known")[0])
        .when((F.size("kinds") == 0) & (F.size(fits) == 1), fits[0])
    )
    r = r.withColumn("kind", kind)
    proof = evidence.where("entity_id is not null and token <> ''").distinct()
    open_ = r.where(F.col("kind").isNull() & (F.size("known") > 1)).select("entity_id", "family").join(proof, "entity_id")
    had = r.where(F.col("kind").isNotNull()).select("entity_id", "family", "kind").join(proof, "entity_id").select("family", "kind", "token").distinct()
    shared = open_.join(had, ["family", "token"]).groupBy("entity_id", "kind").agg(F.count("*").alias("n")).groupBy("entity_id").agg(F.max_by("kind", F.struct("n", "kind")).alias("proved"))
    r = r.join(shared, "entity_id", "left")
    alone = F.when(F.size("known") == 0, F.lit("")).otherwise(F.concat(F.lit("#"), F.col("entity_id").cast("string")))
    return r.select("entity_id", "family", F.coalesce("kind", "proved", F.when(F.size("kinds") > 0, F.array_join(F.array_sort("kinds"), "/")), alone).alias("kind"))


def same_records(resolved: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b) of the records of one firm or person, a < b."""
    o = resolved.select(F.col("entity_id").alias("entity_id_b"), "family", "kind")
    return resolved.withColumnRenamed("entity_id", "entity_id_a").join(o, ["family", "kind"]).where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
