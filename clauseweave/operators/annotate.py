"""Annotators: each turns a token table into rows of the phrase graph (doc, sent, src, dst, rel)."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window, functions as F

from clauseweave.operators import tokens as T

# The wider (u) and the narrower (l) phrase in the ways in which policies list examples.
SUBSUM_PATTERNS = {
    "such_as": "a[lemma=as dep=prep], a ; s[lemma=such], a < u[noun], a > l[noun dep=pobj]",
    "including": "a[lemma=include|like dep=prep], a < u[noun], a > l[noun dep=pobj]",
    "include": "a[lemma=include pos=VERB], a > u[noun dep=nsubj ent!=ACTOR], a > l[noun dep=dobj]",
    "which_include": "a[lemma=include pos=VERB dep=relcl], a < u[noun], a > l[noun dep=dobj]",
    "including_not_limited": "a[lemma=include], a > b[lemma=limit], b > n[dep=neg], b > t[lemma=to], a < u[noun], t > l[noun dep=pobj]",
    "includes_not_limited": "a[lemma=include], a > b[lemma=limit dep=conj], b > n[dep=neg], b > t[lemma=to], a > u[noun dep=nsubj], t > l[noun dep=pobj]",
    "for_example": "u[noun], u > l[noun dep=appos], l > p[lemma=for], p > e[lemma=example]",
    "especially": "u[noun], u > l[noun dep=appos], l > e[lemma=especially|particularly|namely pos=ADV]",
    "eg": "u[noun], u > l[noun dep=appos], l > e[lemma=e.g.|eg|i.e.|ie]",
    "such_n_as": "u[noun], u > s[lemma=such dep=amod], u > p[lemma=as dep=prep], p > l[noun dep=pobj]",
    "collectively": "u[noun dep=appos], u > c[lemma=collectively|hereinafter dep=advmod], u < l[noun]",
    "some_of": "o[text=of pos=ADP], o < l[lemma=some|all|any|type|kind|variety|category|example pos=NOUN|PRON], o > u[noun]",
}
# What a verb acts for, and words that tell of children.
PURPOSE_PATTERNS = {
    "to_verb": "v[dep=xcomp|advcl pos=VERB], v > t[lemma=to], v < r[pos=VERB]",
    "in_order_to": "o[lemma=order], o > v[dep=acl pos=VERB], v > t[lemma=to], o < p[lemma=in], p < r[pos=VERB]",
    "for_noun": "f[lemma=for dep=prep], f > v[noun dep=pobj], f < r[pos=VERB]",
}
SUBJECT_PATTERNS = {
    "from_child": "p[lemma=from|about|of dep=prep], p > c[lemma=child|minor|kid]",
    "under_age": "p[lemma=under|below|between], p > c[lemma=age|13|16|year]",
    "childs_data": "d[ent=DATA], d > c[lemma=child|minor|kid dep=poss]",
}


class Annotator(Protocol):
    """What an annotator offers; any object with this method plugs in (UDX-01)."""

    def transform(self, tokens: DataFrame) -> DataFrame: ...


def _span_types(tokens: DataFrame) -> DataFrame:
    return tokens.select(*T.SENTENCE, "i", F.coalesce("ent_type", F.lit("")).alias("type"))


class Subsumption:
    """Hypernymy by the twelve patterns; an enumeration's later members follow its first, and a pronoun is never the wider phrase (ANN-01..15, ANN-28, ANN-30)."""

    def transform(self, tokens: DataFrame) -> DataFrame:
        found = None
        for name, p in SUBSUM_PATTERNS.items():
            m = T.match_pattern(tokens, p).select(*T.SENTENCE, F.col("u").alias("src"), F.col("l").alias("dst"), F.lit(name).alias("pattern"))
            found = m if found is None else found.unionByName(m)
        found = found.join(tokens.where("pos = 'PRON'").select(*T.SENTENCE, F.col("i").alias("src")), [*T.SENTENCE, "src"], "left_anti")
        chain = T.conjuncts(tokens)
        more = found.join(chain.select(*T.SENTENCE, F.col("i").alias("dst"), "first_i"), [*T.SENTENCE, "dst"]).where("dst = first_i")
        more = more.join(chain.select(*T.SENTENCE, "first_i", F.col("i").alias("other")), [*T.SENTENCE, "first_i"]).where("other <> dst").select(*T.SENTENCE, "src", F.col("other").alias("dst"), "pattern")
        e = found.unionByName(more).where("src <> dst").distinct()
        t = _span_types(tokens)
        e = e.join(t.select(*T.SENTENCE, F.col("i").alias("src"), F.col("type").alias("t1")), [*T.SENTENCE, "src"]).join(t.select(*T.SENTENCE, F.col("i").alias("dst"), F.col("type").alias("t2")), [*T.SENTENCE, "dst"])
        fits = (F.col("t1") == F.col("t2")) | F.col("t1").isin("", "NN") | F.col("t2").isin("", "NN")
        return e.where(fits).groupBy(*T.SENTENCE, "src", "dst").agg(F.min("pattern").alias("pattern")).withColumn("rel", F.lit("SUBSUM"))


class Coreference:
    """Anaphors to the nearest fitting phrase in their own or the previous sentence (ANN-17..20, ANN-31, JON-12).

    A phrase is the head of an entity span. "this/these X" finds a phrase with the same head word, "this
    information" any data phrase, pronouns a phrase of the fitting number.
    """

    def transform(self, tokens: DataFrame) -> DataFrame:
        t = tokens
        heads = t.where("ent_iob in ('B', 'I') and dep not in ('compound', 'amod', 'det', 'poss', 'nummod')").select("doc", "sent", "i", "lemma", "pos", "ent_type", "text")
        det = t.where("lemma in ('this', 'that', 'these', 'those', 'such') and dep in ('det', 'amod')").select("doc", "sent", F.col("head").alias("i"))
        named = heads.join(det, ["doc", "sent", "i"], "left_semi").withColumn("how", F.when(F.col("lemma").isin("data", "datum", "information"), "info").otherwise("same"))
        pron = t.where("pos = 'PRON' and lemma in ('it', 'this', 'they', 'these')").select("doc", "sent", "i", "lemma", "pos", "ent_type", "text").withColumn("how", F.lit("pronoun"))
        a = named.unionByName(pron).withColumnsRenamed({"sent": "a_sent", "i": "a_i", "lemma": "a_lemma", "ent_type": "a_type"}).select("doc", "a_sent", "a_i", "a_lemma", "a_type", "how")
        b = heads.where("pos <> 'PRON'").select("doc", F.col("sent").alias("b_sent"), F.col("i").alias("b_i"), F.col("lemma").alias("b_lemma"), F.col("ent_type").alias("b_type"), F.col("text").alias("b_text"))
        both = a.withColumn("b_sent", F.explode(F.array(F.col("a_sent"), F.col("a_sent") - 1))).join(b, ["doc", "b_sent"])
        before = (F.col("b_sent") < F.col("a_sent")) | (F.col("b_i") < F.col("a_i"))
        plural = F.col("b_text").endswith("s")
        fits = F.when(F.col("how") == "same", F.col("a_lemma") == F.col("b_lemma")).when(F.col("how") == "info", F.col("b_type") == "DATA").otherwise(F.when(F.col("a_lemma").isin("they", "these"), plural).otherwise(~plural))
        w = Window.partitionBy("doc", "a_sent", "a_i").orderBy(F.desc("b_sent"), "b_i")
        c = both.where(before & fits).withColumn("n", F.row_number().over(w)).where("n = 1")
        return c.select("doc", F.col("a_sent").alias("sent"), F.col("a_i").alias("src"), F.col("b_sent").alias("dst_sent"), F.col("b_i").alias("dst"), F.lit("COREF").alias("rel"))


class FirstParty:
    """Whatever stands in apposition to "we" is the first party (ANN-16)."""

    def transform(self, tokens: DataFrame) -> DataFrame:
        we = tokens.where("lemma in ('we', 'us')").select(*T.SENTENCE, F.col("i").alias("src"), "head")
        down = tokens.where("dep = 'appos'").select(*T.SENTENCE, F.col("head").alias("src"), F.col("i").alias("dst"))
        up = tokens.where("dep = 'appos' and lemma in ('we', 'us')").select(*T.SENTENCE, F.col("i").alias("src"), F.col("head").alias("dst"))
        return we.join(down, [*T.SENTENCE, "src"]).select(*T.SENTENCE, "src", "dst").unionByName(up).distinct().withColumn("rel", F.lit("SUBSUM"))


class Purposes:
    """Data phrases to the purposes for which their verb acts (ANN-24..26)."""

    def transform(self, tokens: DataFrame) -> DataFrame:
        found = None
        for p in PURPOSE_PATTERNS.values():
            m = T.match_pattern(tokens, p).select(*T.SENTENCE, "r", "v")
            found = m if found is None else found.unionByName(m)
        stop = tokens.where("lemma in ('period', 'time', 'purpose', 'example')").select(*T.SENTENCE, F.col("i").alias("v"))
        found = found.distinct().join(stop, [*T.SENTENCE, "v"], "left_anti")
        b = T.below(tokens)
        data = tokens.where("ent_type = 'DATA' and dep not in ('compound', 'amod', 'det', 'poss', 'nummod')").select(*T.SENTENCE, F.col("i").alias("src"))
        inside = b.select(*T.SENTENCE, F.col("i").alias("v"), F.col("j").alias("src"))
        j = found.join(b.where("dist > 0").select(*T.SENTENCE, F.col("i").alias("r"), F.col("j").alias("src")), [*T.SENTENCE, "r"]).join(data, [*T.SENTENCE, "src"], "left_semi")
        return j.join(inside, [*T.SENTENCE, "v", "src"], "left_anti").select(*T.SENTENCE, "src", F.col("v").alias("dst")).distinct().withColumn("rel", F.lit("PURPOSE"))


class DataSubjects:
    """Data phrases of sentences that speak of children (ANN-27)."""

    def transform(self, tokens: DataFrame) -> DataFrame:
        hit = None
        for p in SUBJECT_PATTERNS.values():
            m = T.match_pattern(tokens, p).select(*T.SENTENCE)
            hit = m if hit is None else hit.unionByName(m)
        data = tokens.where("ent_type = 'DATA' and dep not in ('compound', 'amod', 'det', 'poss', 'nummod')")
        return data.join(hit.distinct(), T.SENTENCE, "left_semi").select(*T.SENTENCE, F.col("i").alias("src"), F.lit("children").alias("subject"))


def spread_over_items(links: DataFrame, items: DataFrame) -> DataFrame:
    """Links of one list item hold for all items of its list (ANN-21..23).

    links: doc, src, dst, rel; items: doc, list_id, node. A link whose source (target) is an item is
    copied to every item of the list; lists are short, and the copies are the result.
    """
    a = items.select("doc", "list_id", F.col("node").alias("src"))
    b = items.select("doc", "list_id", F.col("node").alias("dst"))
    at_src = links.join(a, ["doc", "src"]).drop("src").join(a, ["doc", "list_id"]).select("doc", "src", "dst", "rel")
    at_dst = links.join(b, ["doc", "dst"]).drop("dst").join(b, ["doc", "list_id"]).select("doc", "src", "dst", "rel")
    return links.select("doc", "src", "dst", "rel").unionByName(at_src).unionByName(at_dst).where("src <> dst").distinct()


ANNOTATORS: dict[str, type] = {"subsumption": Subsumption, "coreference": Coreference, "first_party": FirstParty, "purpose": Purposes, "subject": DataSubjects}


def annotate(tokens: DataFrame, disable: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The results of all annotators but the disabled ones (ANN-29)."""
    unknown = set(disable) - set(ANNOTATORS)
    if unknown:
        raise ValueError(f"no such annotators: {sorted(unknown)}")
    return {k: a().transform(tokens) for k, a in ANNOTATORS.items() if k not in disable}
