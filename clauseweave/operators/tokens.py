"""Token tables: spans, subtrees, conjuncts, and dependency patterns as chains of joins.

tokens: doc, sent, i, text, lemma, pos, dep, head, ent_type, ent_iob. (doc, sent) names a sentence;
heads are token numbers within it, a root is its own head.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F


SCHEMA = "doc string, sent int, i int, text string, lemma string, pos string, dep string, head int, ent_type string, ent_iob string"
SENTENCE = ["doc", "sent"]


def entity_spans(tokens: DataFrame) -> DataFrame:
    """(doc, sent, label, start_i, end_i, n): maximal runs of entity tokens, as gaps and islands (TOK-04, D8)."""
    w = Window.partitionBy(*SENTENCE).orderBy("i")
    e = tokens.where("ent_iob in ('B', 'I')").withColumn("new", ((F.col("ent_iob") == "B") | (F.lag("i").over(w).isNull()) | (F.lag("i").over(w) != F.col("i") - 1) | (F.lag("ent_type").over(w) != F.col("ent_type"))).cast("int"))
    e = e.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(*SENTENCE, "span").agg(F.first("ent_type").alias("label"), F.min("i").alias("start_i"), F.max("i").alias("end_i"), F.count("*").alias("n")).drop("span")


def _sentences(tokens: DataFrame, *columns: str) -> DataFrame:
    """(doc, sent, t): each sentence as one row, t its tokens (i, columns) in order. One shuffle; a sentence is short."""
    return tokens.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("t"))


def _upward(t: Column, i: Column, goes_on) -> Column:
    """Array of the tokens from ``i`` up along the heads, while ``goes_on`` (a token) holds; a loop ends after as many steps as there are tokens."""

    def step(acc: Column, _: Column) -> Column:
        x = t[F.element_at(acc, -1)]
        return F.when(goes_on(x) & (x["head"] != x["i"]) & ~F.array_contains(acc, x["head"]), F.concat(acc, F.array(x["head"]))).otherwise(acc)

    return F.aggregate(t, F.array(i), step)


def below(tokens: DataFrame) -> DataFrame:
    """(doc, sent, i, j, dist): j hangs below i in the sentence's tree, dist links deep; each token is below itself at 0 (TOK-10 `>>`).

    Tokens are numbered from 0 without gaps. Heads are followed inside each sentence's row: no join, no checkpoint.
    """
    s = _sentences(tokens, "head")
    t = F.col("t")
    ups = F.transform(t, lambda x: F.struct(x["i"].alias("j"), _upward(t, x["i"], lambda y: F.lit(True)).alias("up")))
    one = s.select(*SENTENCE, F.explode(ups).alias("r"))
    return one.select(*SENTENCE, F.col("r.j").alias("j"), F.posexplode("r.up").alias("dist", "i")).select(*SENTENCE, "i", "j", "dist")


def conjuncts(tokens: DataFrame) -> DataFrame:
    """(doc, sent, i, first_i): tokens of a coordination carry its first token (TOK-07, GRA-09).

    Members hang below each other by 'conj', so they have the same last token up that chain.
    """
    s = _sentences(tokens, "head", "dep")
    t = F.col("t")
    tops = F.transform(t, lambda x: F.struct(x["i"].alias("i"), F.element_at(_upward(t, x["i"], lambda y: y["dep"] == "conj"), -1).alias("top"), (x["dep"] == "conj").alias("member")))
    r = s.select(*SENTENCE, tops.alias("r"))
    live = F.filter("r", lambda x: F.exists("r", lambda y: y["member"] & (y["top"] == x["top"])))
    firsts = F.transform(live, lambda x: F.struct(x["i"].alias("i"), F.array_min(F.transform(F.filter(live, lambda y: y["top"] == x["top"]), lambda y: y["i"])).alias("first_i")))
    return r.select(*SENTENCE, F.explode(firsts).alias("f")).select(*SENTENCE, "f.i", "f.first_i")


def subtree_bounds(tokens: DataFrame) -> DataFrame:
    """(doc, sent, i, left_i, right_i, n) of the subtree of each token (TOK-06, AGG-07)."""
    return below(tokens).groupBy(*SENTENCE, "i").agg(F.min("j").alias("left_i"), F.max("j").alias("right_i"), F.count("*").alias("n"))


def sentence_text(tokens: DataFrame) -> DataFrame:
    """(doc, sent, text) (TOK-12)."""
    return tokens.groupBy(*SENTENCE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("text"))


# Words that are no part of a term's stem, and the children that are, by the kind of head.
TRIVIAL = ["a", "an", "the", "some", "any", "all", "other", "certain", "such", "this", "that", "these", "those", "our", "your", "their", "its", "his", "her", "my"]
STEM_DEPS = ["compound", "amod", "nmod", "poss", "nummod", "prep", "pobj", "npadvmod"]


def phrase_stems(tokens: DataFrame) -> DataFrame:
    """(doc, sent, i, stem) of the noun phrases: the head and what qualifies it, without trivial words (TOK-09)."""
    t = tokens.select(*SENTENCE, "i", "lemma", "dep", "pos", "head")
    d = below(tokens).join(t.select(*SENTENCE, F.col("i").alias("j"), "lemma", "dep"), [*SENTENCE, "j"])
    bad = d.where(~F.col("dep").isin(STEM_DEPS) & (F.col("dist") > 0)).select(*SENTENCE, "i", F.col("j").alias("cut"))
    off = bad.join(below(tokens).select(*SENTENCE, F.col("i").alias("cut"), "j"), [*SENTENCE, "cut"]).select(*SENTENCE, "i", "j").distinct()
    kept = d.join(off, [*SENTENCE, "i", "j"], "left_anti").where((F.col("dist") == 0) | ~F.col("lemma").isin(TRIVIAL))
    heads = t.where("pos in ('NOUN', 'PROPN') and dep not in ('compound', 'nmod')").select(*SENTENCE, "i")
    return kept.join(heads, [*SENTENCE, "i"], "left_semi").groupBy(*SENTENCE, "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "lemma"))), lambda x: x["lemma"]), " ").alias("stem"))


@dataclass
class Pattern:
    """A dependency pattern: nodes with conditions, tied by relations, in the order in which they are joined."""

    first: str
    nodes: dict[str, str] = field(default_factory=dict)
    ties: list[tuple[str, str, str]] = field(default_factory=list)


NODE = re.compile(r"\s*(\w+)\[([^\]]*)\]\s*")
TIE = re.compile(r"\s*(\w+)\s*(>>|>|<|;)\s*(\w+)\[([^\]]*)\]\s*")


def parse_pattern(text: str) -> Pattern:
    """``a[lemma=as dep=prep], a < u[noun], a > l[noun dep=pobj], a ; s[lemma=such]``.

    Relations: x > y, y is a child of x; x < y, y is the head of x; x >> y, y is below x; x ; y, y stands
    right before x. Conditions: column=one|of|these, column!=..., or noun.
    """
    parts = [p for p in re.split(r",(?![^\[]*\])", text) if p.strip()]
    m = NODE.fullmatch(parts[0])
    if not m:
        raise ValueError(f"no first node in {text!r}")
    p = Pattern(m[1], {m[1]: m[2]})
    for part in parts[1:]:
        m = TIE.fullmatch(part)
        if not m or m[1] not in p.nodes:
            raise ValueError(f"can't read {part!r}")
        p.nodes[m[3]] = m[4]
        p.ties.append((m[1], m[2], m[3]))
    return p


def condition(spec: str) -> Column:
    """The predicate of a node."""
    c = F.lit(True)
    for x in spec.split():
        if x == "noun":
            c &= F.col("pos").isin("NOUN", "PROPN", "PRON")
        else:
            name, no, values = re.fullmatch(r"(\w+)(!?)=(.+)", x).groups()
            one = F.coalesce(F.col({"ent": "ent_type"}.get(name, name)), F.lit("")).isin(values.split("|"))
            c &= ~one if no else one
    return c


def match_pattern(tokens: DataFrame, pattern: Pattern | str) -> DataFrame:
    """One row per match: doc, sent and the token number of each node (TOK-10, OPT-14).

    Each node is a filtered scan of the token table and each relation an equi join within the
    sentence, so the rarest node's filter cuts the joins down. Matches with a negated token are
    dropped (TOK-11).
    """
    p = parse_pattern(pattern) if isinstance(pattern, str) else pattern
    part = lambda n: tokens.where(condition(p.nodes[n])).select(*SENTENCE, F.col("i").alias(n), F.col("head").alias(f"_{n}"))
    j = part(p.first)
    deep = below(tokens) if any(op == ">>" for _, op, _ in p.ties) else None
    for a, op, b in p.ties:
        r = part(b)
        if op == ">":
            j = j.join(r.where(F.col(f"_{b}") != F.col(b)).withColumn(a, F.col(f"_{b}")), [*SENTENCE, a])
        elif op == "<":
            j = j.join(r.withColumn(f"_{a}", F.col(b)), [*SENTENCE, f"_{a}"]).where(F.col(a) != F.col(b))
        elif op == ";":
            j = j.join(r.withColumn(a, F.col(b) + 1), [*SENTENCE, a])
        else:
            d = deep.where("dist > 0").select(*SENTENCE, F.col("i").alias(a), F.col("j").alias(b))
            j = j.join(d, [*SENTENCE, a]).join(r, [*SENTENCE, b])
    names = list(p.nodes)
    j = j.select(*SENTENCE, *names).distinct()
    neg = tokens.where("dep = 'neg'").select(*SENTENCE, F.col("head").alias("_h"), F.col("i").alias("_n"))
    used = F.array(*names)
    bad = j.withColumn("_h", F.explode(used)).join(neg, [*SENTENCE, "_h"]).where(~F.array_contains(F.array(*names), F.col("_n"))).select(*SENTENCE, *names)
    return j.join(bad.distinct(), [*SENTENCE, *names], "left_anti")
