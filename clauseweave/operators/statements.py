"""Statements about data practices: a rule language over the sentence's dependencies (COL-*).

A rule is one line: ``name: ROOT; CHAIN, CHAIN, ...; ACTION who what whom``. A chain is a path of hops
from the root verb; a hop is ``lemmas:relation`` (either may be empty), lemmas are ``a|b`` or a verb
class in capitals, ``=NAME`` at a chain's end keeps the token under that name, and ``!`` before a
chain demands a match. Arguments of the action may list alternatives: ``E2|E3``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from clauseweave.operators import tokens as T
from clauseweave.plans.session import cut

# Verb classes.
VERBS = {
    "SHARE": "share trade exchange disclose",
    "PROVIDE": "supply provide",
    "PASS": "provide supply release disclose transfer transmit give divulge pass submit",
    "SELL": "sell rent lease",
    "COLLECT": "collect gather obtain receive solicit acquire request get",
    "USE": "use access process utilize analyze need",
    "STORE": "store save preserve record retain maintain log keep hold",
    "REQUIRE": "ask require need prompt deem oblige",
    "ALLOW": "enable allow permit authorize",
    "HAVE": "have aim intend need seek continue",
}
# The statement rules.
RULES = """
share with: SHARE; subj=A, !obj=D, with obj=B; SHARE A D B
collect from: COLLECT; subj=A, !obj=D, from obj=B; COLLECT A D B
provide with: PROVIDE; subj=A, obj=B, !with obj=D; SHARE A D B
provide to: PASS; subj=A, !obj=D, to obj=B, dative=C; SHARE A D B|C
sell to: SELL; subj=A, !obj=D, to obj=B, dative=C; SELL A D B|C
use: USE; subj=A, !obj=D; USE A D
store: STORE; subj=A, !obj=D; STORE A D
have access to: have|get|gain; subj=A, !access:obj to obj=D; USE A D
make use of: make; subj=A, !use:obj, !use:obj of obj=D; USE A D
require to share: REQUIRE; subj=A, SHARE:xcomp subj=B, !SHARE:xcomp obj=D, SHARE:xcomp with obj=C; SHARE B D C|A
require to provide with: REQUIRE; subj=A, PROVIDE:xcomp subj=B, PROVIDE:xcomp obj=C, !PROVIDE:xcomp with obj=D; SHARE B D C|A
require to provide to: REQUIRE; subj=A, PASS:xcomp subj=B, !PASS:xcomp obj=D, PASS:xcomp to obj=C, PASS:xcomp dative=E; SHARE B D C|E|A
allow to collect: ALLOW; COLLECT:xcomp subj=A, !COLLECT:xcomp obj=D, COLLECT:xcomp from obj=B; COLLECT A D B
allow to share: ALLOW; SHARE:xcomp subj=A, !SHARE:xcomp obj=D, SHARE:xcomp with obj=B; SHARE A D B
allow to use: ALLOW; USE:xcomp subj=A, !USE:xcomp obj=D; USE A D
allow to store: ALLOW; STORE:xcomp subj=A, !STORE:xcomp obj=D; STORE A D
have to collect: HAVE; subj=A, !COLLECT:xcomp obj=D, COLLECT:xcomp from obj=B; COLLECT A D B
have to use: HAVE; subj=A, !USE:xcomp obj=D; USE A D
have to store: HAVE; subj=A, !STORE:xcomp obj=D; STORE A D
data collected include: include; !subj=D, !subj COLLECT:relcl subj=A; COLLECT A D
data used include: include; !subj=D, !subj USE:relcl subj=A; USE A D
data stored include: include; !subj=D, !subj STORE:relcl subj=A; STORE A D
use to collect: USE; subj=A, !COLLECT:xcomp obj=D; COLLECT A D
"""
# action, negated, which argument is the entity, edge key
ACTIONS = [("COLLECT", False, "who", "COLLECT"), ("SHARE", False, "whom", "BE_SHARED"), ("SHARE", False, "who", "COLLECT"), ("SELL", False, "whom", "BE_SOLD"), ("SELL", False, "who", "COLLECT"), ("USE", False, "who", "USE"), ("STORE", False, "who", "STORE"), ("COLLECT", True, "who", "NOT_COLLECT"), ("SHARE", True, "whom", "NOT_BE_SHARED"), ("SELL", True, "whom", "NOT_BE_SOLD"), ("USE", True, "who", "NOT_USE"), ("STORE", True, "who", "NOT_STORE")]


@dataclass
class Rule:
    name: str
    root: list[str]
    chains: list[tuple[bool, str | None, list[tuple[list[str], str]]]]
    action: str
    args: list[list[str]]


def lemmas(spec: str) -> list[str]:
    """Words of a hop: a verb class, alternatives, or any ([])."""
    return VERBS[spec].split() if spec in VERBS else [x for x in spec.split("|") if x]


def parse_rule(line: str) -> Rule:
    """A rule from its line; raises ValueError where it can't be read (COL-17)."""
    try:
        name, rest = line.split(":", 1)
        root, chains, act = (x.strip() for x in rest.split(";"))
    except ValueError:
        raise ValueError(f"not a rule: {line!r}") from None
    out = []
    for c in chains.split(","):
        c = c.strip()
        need, c = c.startswith("!"), c.lstrip("!")
        path, _, keep = c.partition("=")
        hops = []
        for h in path.split():
            if ":" in h:
                lem, rel = h.split(":")
            else:
                lem, rel = ("", h) if h in RELATIONS else (h, "prep")
            hops.append((lemmas(lem), rel))
        out.append((need, keep or None, hops))
    a = act.split()
    return Rule(name.strip(), lemmas(root), out, a[0], [x.split("|") for x in a[1:]])


RELATIONS = {"subj", "obj", "dative", "xcomp", "relcl"}


def relations(tokens: DataFrame) -> DataFrame:
    """(doc, sent, parent, rel, child): dependencies in the few relations that rules speak of (COL-01, COL-04..07).

    Passive subjects are objects, "by" agents subjects; xcomp and ccomp are one; members of a coordination
    share their first member's relations, and coordinated verbs its subject and a
    later one's objects where they have none. An
    apposition takes over the relations of its head. An infinitive without a subject has its verb's object.
    """
    t = tokens.select(*T.SENTENCE, "i", "dep", "head", "lemma")
    rel = F.when(F.col("dep").isin("nsubj", "csubj"), "subj").when(F.col("dep") == "nsubjpass", "obj").when(F.col("dep").isin("dobj", "pobj"), "obj").when(F.col("dep") == "dative", "dative").when(F.col("dep").isin("xcomp", "ccomp", "advcl"), "xcomp").when(F.col("dep") == "relcl", "relcl").when(F.col("dep") == "prep", "prep")
    e = t.where("head <> i").select(*T.SENTENCE, F.col("head").alias("parent"), rel.alias("rel"), F.col("i").alias("child")).where("rel is not null")
    by = t.where("lemma = 'by' and dep in ('agent', 'prep')").select(*T.SENTENCE, F.col("i").alias("by"), F.col("head").alias("parent"))
    agents = t.where("dep = 'pobj'").select(*T.SENTENCE, F.col("head").alias("by"), F.col("i").alias("child")).join(by, [*T.SENTENCE, "by"]).select(*T.SENTENCE, "parent", F.lit("subj").alias("rel"), "child")
    e = e.unionByName(agents)
    app = t.where("dep = 'appos'").select(*T.SENTENCE, F.col("head").alias("child"), F.col("i").alias("other"))
    e = e.unionByName(e.join(app, [*T.SENTENCE, "child"]).select(*T.SENTENCE, "parent", "rel", F.col("other").alias("child")))
    chain = T.conjuncts(tokens)
    first = chain.where("i = first_i").select(*T.SENTENCE, F.col("i").alias("child"), "first_i")
    rest = chain.where("i <> first_i").select(*T.SENTENCE, "first_i", F.col("i").alias("other"))
    e = e.unionByName(e.join(first, [*T.SENTENCE, "child"]).join(rest, [*T.SENTENCE, "first_i"]).select(*T.SENTENCE, "parent", "rel", F.col("other").alias("child"))).distinct()
    lead = chain.where("i = first_i").select(*T.SENTENCE, F.col("i").alias("parent"), "first_i")
    lent = e.where("rel = 'subj'").join(lead, [*T.SENTENCE, "parent"]).join(rest, [*T.SENTENCE, "first_i"]).select(*T.SENTENCE, F.col("other").alias("parent"), "rel", "child")
    have = e.where("rel = 'subj'").select(*T.SENTENCE, "parent").distinct()
    e = e.unionByName(lent.join(have, [*T.SENTENCE, "parent"], "left_anti")).distinct()
    verbs = chain.join(tokens.where("pos = 'VERB'").select(*T.SENTENCE, "i"), [*T.SENTENCE, "i"], "left_semi")
    lender = verbs.select(*T.SENTENCE, "first_i", F.col("i").alias("parent"))
    things = e.where("rel = 'obj'").join(lender, [*T.SENTENCE, "parent"]).select(*T.SENTENCE, "first_i", F.col("parent").alias("owner"), "child")
    shared = verbs.join(things, [*T.SENTENCE, "first_i"]).where("owner > i").select(*T.SENTENCE, F.col("i").alias("parent"), F.lit("obj").alias("rel"), "child")
    e = e.unionByName(shared.join(e.where("rel = 'obj'").select(*T.SENTENCE, "parent"), [*T.SENTENCE, "parent"], "left_anti")).distinct()
    open_ = e.where("rel = 'xcomp'").select(*T.SENTENCE, "parent", F.col("child").alias("v"))
    objects = e.where("rel = 'obj'").select(*T.SENTENCE, "parent", "child")
    heirs = open_.join(objects, [*T.SENTENCE, "parent"]).select(*T.SENTENCE, F.col("v").alias("parent"), F.lit("subj").alias("rel"), "child")
    return e.unionByName(heirs.join(e.where("rel = 'subj'").select(*T.SENTENCE, "parent"), [*T.SENTENCE, "parent"], "left_anti")).distinct()


def negated(tokens: DataFrame) -> DataFrame:
    """(doc, sent, i) of the verbs that "not" or the like denies, through coordination up to a "but" (COL-03)."""
    own = tokens.where("dep = 'neg'").select(*T.SENTENCE, F.col("head").alias("i")).distinct()
    chain = T.conjuncts(tokens)
    but = tokens.where("lemma = 'but' and dep = 'cc'").select(*T.SENTENCE).distinct()
    first = chain.where("i = first_i").join(own, [*T.SENTENCE, "i"], "left_semi").select(*T.SENTENCE, "first_i")
    led = chain.join(first, [*T.SENTENCE, "first_i"], "left_semi").join(but, T.SENTENCE, "left_anti").select(*T.SENTENCE, "i")
    return own.unionByName(led).distinct()


def questions(tokens: DataFrame) -> DataFrame:
    """(doc, sent) of sentences that ask (COL-02)."""
    last = tokens.groupBy(*T.SENTENCE).agg(F.max_by("text", "i").alias("t")).where("t = '?'")
    return last.select(*T.SENTENCE)


def match_rules(rules: list[Rule], tokens: DataFrame, rels: DataFrame, no: DataFrame) -> DataFrame:
    """(doc, sent, rule, root, name, i): the tokens that each rule keeps for each root it matches (COL-08..11).

    All rules run together: roots, chains and hops are small constant tables, broadcast, and each hop is
    one join with the relations, whatever the number of rules. Chains that a rule demands must match;
    a chain through a negated token doesn't. rels: with the child's lemma; no: the negated tokens.
    """
    spark = tokens.sparkSession
    const = lambda data, schema: F.broadcast(spark.createDataFrame(data, schema))
    heads = const([(r, w) for r, x in enumerate(rules) for w in x.root], "rule int, lemma string")
    chains = const([(r, c, need, keep, len(hops)) for r, x in enumerate(rules) for c, (need, keep, hops) in enumerate(x.chains)], "rule int, chain int, need boolean, name string, hops int")
    hops = const([(r, c, h, rel, lem) for r, x in enumerate(rules) for c, (_, _, path) in enumerate(x.chains) for h, (lem, rel) in enumerate(path, 1)], "rule int, chain int, hop int, rel string, lem array<string>")
    roots = tokens.where("dep in ('ROOT', 'ccomp', 'conj')").select(*T.SENTENCE, F.col("i").alias("root"), F.lower("lemma").alias("lemma")).join(heads, "lemma").drop("lemma")
    at = roots.join(chains, "rule").withColumn("at", F.col("root"))
    step = rels.select(*T.SENTENCE, F.col("parent").alias("at"), "rel", F.col("child").alias("next"), F.col("lemma").alias("l"))
    step = step.join(no.select(*T.SENTENCE, F.col("i").alias("next")), [*T.SENTENCE, "next"], "left_anti")
    done = None
    for h in range(1, max(len(p) for x in rules for _, _, p in x.chains) + 1):
        at = at.join(step, [*T.SENTENCE, "at"]).join(hops.where(F.col("hop") == h), ["rule", "chain", "rel"]).where((F.size("lem") == 0) | F.array_contains("lem", F.col("l")))
        at = cut(at.select(*T.SENTENCE, "rule", "chain", "root", "need", "name", "hops", F.col("next").alias("at")).distinct())
        end = at.where(F.col("hops") == h)
        done = end if done is None else done.unionByName(end)
        at = at.where(F.col("hops") > h)
    wanted = const([(r, sum(need for need, _, _ in x.chains)) for r, x in enumerate(rules)], "rule int, wanted int")
    got = done.where("need").groupBy(*T.SENTENCE, "rule", "root").agg(F.countDistinct("chain").alias("got"))
    full = roots.join(got, [*T.SENTENCE, "rule", "root"], "left").join(wanted, "rule").where(F.coalesce("got", F.lit(0)) == F.col("wanted"))
    kept = done.where("name is not null").select(*T.SENTENCE, "rule", "root", "name", F.col("at").alias("i")).distinct()
    return kept.join(full.select(*T.SENTENCE, "rule", "root").distinct(), [*T.SENTENCE, "rule", "root"], "left_semi")


def statements(tokens: DataFrame, rules: str = RULES, typed: bool = True) -> DataFrame:
    """(doc, sent, src, dst, key): collect-like edges between an actor's and a data phrase's token (COL-12..16).

    With ``typed``, ends must be entities of type ACTOR and DATA (or unlabelled). Questions state nothing.
    """
    t = tokens.join(questions(tokens), T.SENTENCE, "left_anti")
    spark = tokens.sparkSession
    rels = cut(relations(t).join(t.select(*T.SENTENCE, F.col("i").alias("child"), F.lower("lemma").alias("lemma")), [*T.SENTENCE, "child"]))
    no = cut(negated(t))
    parsed = [parse_rule(x) for x in rules.strip().splitlines()]
    roles = [(r, n, role, rank) for r, x in enumerate(parsed) for role, names in zip(("who", "what", "whom"), x.args, strict=False) for rank, n in enumerate(names)]
    m = match_rules(parsed, t, rels, no).join(F.broadcast(spark.createDataFrame(roles, "rule int, name string, role string, rank int")), ["rule", "name"])
    best = m.groupBy(*T.SENTENCE, "rule", "root", "role").agg(F.min("rank").alias("rank"))
    m = cut(m.join(best, [*T.SENTENCE, "rule", "root", "role", "rank"]).select(*T.SENTENCE, "rule", "root", "role", "i"))
    data = m.where("role = 'what'").select(*T.SENTENCE, "rule", "root", F.col("i").alias("dst"))
    ends = m.where("role <> 'what'").select(*T.SENTENCE, "rule", "root", "role", F.col("i").alias("src"))
    acts = [(r, neg, role, key) for r, x in enumerate(parsed) for action, neg, role, key in ACTIONS if action == x.action]
    denied = no.select(*T.SENTENCE, F.col("i").alias("root"), F.lit(True).alias("neg"))
    out = ends.join(data, [*T.SENTENCE, "rule", "root"]).join(denied, [*T.SENTENCE, "root"], "left").withColumn("neg", F.coalesce("neg", F.lit(False)))
    out = out.join(F.broadcast(spark.createDataFrame(acts, "rule int, neg boolean, role string, key string")), ["rule", "neg", "role"]).select(*T.SENTENCE, "src", "dst", "key")
    if typed:
        ty = tokens.select(*T.SENTENCE, "i", F.coalesce("ent_type", F.lit("")).alias("type"))
        out = out.join(ty.where("type in ('', 'NN', 'ACTOR')").select(*T.SENTENCE, F.col("i").alias("src")), [*T.SENTENCE, "src"], "left_semi")
        out = out.join(ty.where("type in ('', 'NN', 'DATA')").select(*T.SENTENCE, F.col("i").alias("dst")), [*T.SENTENCE, "dst"], "left_semi")
    return out.distinct()
