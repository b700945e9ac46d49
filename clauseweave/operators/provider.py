"""A rule-based token provider: tags and shallow dependencies for plain declarative sentences.

It stands in where no trained parser is at hand and makes no claim to linguistic accuracy; whatever
gives rows of ``tokens.SCHEMA`` replaces it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clauseweave.operators.normalize import fused_rules
from clauseweave.operators.statements import VERBS
from clauseweave.operators.tokens import SCHEMA

WORD = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")
CLASSES = {
    "DET": "a an the this that these those each every any some all no such",
    "PRON": "we us you they them it i he she your our their its my",
    "ADP": "with from to for of in on at by about under without within outside through as than",
    "AUX": "do does did is are was were be been may might can could will would shall should must has have had isn aren don doesn",
    "CCONJ": "and or nor but",
    "PART": "not n't never",
}
TAG = {w: k for k, ws in CLASSES.items() for w in ws.split()}
VERB_FORMS: dict[str, str] = {}
for _v in {v for ws in VERBS.values() for v in ws.split()} | {"include", "show", "place", "see", "read", "send", "pass", "make", "limit"}:
    _s = _v[:-1] if _v.endswith("e") else _v
    for _f in (_v, _v + "s", _v + "es", _s + "ed", _s + "ing", _v + _v[-1] + "ed", _v + _v[-1] + "ing"):
        VERB_FORMS.setdefault(_f, _v)
VERB_FORMS |= {"gave": "give", "given": "give", "sold": "sell", "kept": "keep", "held": "hold", "got": "get", "sought": "seek"}
DATA_RE, ACTOR_RE = (re.compile("|".join(y for _, y, _ in fused_rules(k)).replace("(?:", "(?-i:"), re.I) for k in ("DATA", "ACTOR"))


# Plurals that the endings don't tell.
PLURALS = {"cookies": "cookie", "movies": "movie", "calories": "calorie", "children": "child", "people": "person", "women": "woman", "men": "man", "media": "medium", "series": "series", "species": "species", "addresses": "address", "processes": "process", "businesses": "business", "searches": "search", "purchases": "purchase", "databases": "database"}


def lemma(word: str) -> str:
    w = word.lower()
    if w in PLURALS:
        return PLURALS[w]
    if w in VERB_FORMS:
        return VERB_FORMS[w]
    if w in ("us", "our"):
        return "we"
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")) else w


@lru_cache(100_000)
def phrase_type(last: str, phrase: str) -> str:
    """ACTOR, DATA or NN for a noun phrase without its determiner, by the normal forms of its words or their lemmas."""
    lemmas = " ".join(map(lemma, phrase.split()))
    if last in ("we", "us", "you") or ACTOR_RE.search(phrase) or ACTOR_RE.search(lemmas):
        return "ACTOR"
    return "DATA" if DATA_RE.search(phrase) or DATA_RE.search(lemmas) else "NN"


def parse_sentence(words: list[str]) -> list[tuple]:
    """(i, text, lemma, pos, dep, head, ent_type, ent_iob) of one sentence."""
    n = len(words)
    pos = []
    for i, w in enumerate(words):
        t = TAG.get(w.lower())
        if not w[0].isalnum():
            t = "PUNCT"
        elif t is None and w.lower() in VERB_FORMS and not (i and pos[i - 1] in ("DET", "ADP") and words[i - 1].lower() != "to"):
            t = "VERB"
        pos.append(t or ("PROPN" if i and w[0].isupper() else "NOUN"))
    chunks, i = [], 0  # noun phrases: (start, end)
    while i < n:
        if pos[i] in ("DET", "NOUN", "PROPN", "PRON"):
            j = i
            while j < n and (pos[j] in ("NOUN", "PROPN") or j == i and pos[j] in ("DET", "PRON") or pos[j] == "DET" and j == i):
                j += 1
            j = max(j, i + 1)
            chunks.append((i, j - 1))
            i = j
        else:
            i += 1
    head_of = {c: b for a, b in chunks for c in range(a, b + 1)}
    verbs = [k for k in range(n) if pos[k] == "VERB"]
    root = verbs[0] if verbs else (chunks[0][1] if chunks else 0)
    dep, head = ["dep"] * n, [root] * n
    dep[root] = "ROOT"
    for a, b in chunks:
        for k in range(a, b):
            dep[k], head[k] = ("det" if pos[k] == "DET" else "poss" if pos[k] == "PRON" else "compound"), b
    passive = bool(verbs) and any(words[k].lower() in ("is", "are", "was", "were", "be", "been") for k in range(max(0, root - 2), root)) and words[root].lower().endswith(("ed", "en", "ld", "pt"))
    last_np, last_verb, prep = None, root, None
    seen_subj = False
    for k in range(n):
        if k == root:
            last_np = None
        elif pos[k] == "VERB":
            to = k and words[k - 1].lower() == "to"
            dep[k], head[k] = ("xcomp", last_verb) if to else ("conj", last_verb) if k and pos[k - 1] == "CCONJ" else ("relcl", last_np) if last_np is not None else ("dep", root)
            last_verb, last_np, prep = k, None, None
        elif pos[k] == "AUX":
            dep[k], head[k] = "aux", root
        elif pos[k] == "PART":
            dep[k], head[k] = "neg", next((v for v in verbs if v > k), root)
        elif pos[k] == "ADP":
            if words[k].lower() == "to" and k + 1 < n and pos[k + 1] == "VERB":
                dep[k], head[k] = "aux", k + 1
            elif words[k].lower() == "as" and k and words[k - 1].lower() == "such" and last_np is not None:
                dep[k], head[k], prep = "prep", last_np, k
            elif words[k].lower() == "of" and last_np is not None:
                dep[k], head[k], prep = "prep", last_np, k
            else:
                dep[k], head[k], prep = ("agent" if words[k].lower() == "by" and passive else "prep"), last_verb, k
        elif k in head_of and head_of[k] == k:
            before = words[next((a for a, b in chunks if b == k)) - 1].lower() if next((a for a, b in chunks if b == k)) else ""
            if words[k].lower() == "such" and k + 1 < n and words[k + 1].lower() == "as":
                dep[k], head[k] = "amod", k + 1
                continue
            if prep is not None and prep < k:
                dep[k], head[k] = "pobj", prep
            elif before in (",", "and", "or") and last_np is not None:
                dep[k], head[k] = "conj", last_np
            elif k < root and not seen_subj and verbs:
                dep[k], head[k], seen_subj = ("nsubjpass" if passive else "nsubj"), root, True
            elif verbs and k > root:
                dep[k], head[k] = "dobj", last_verb
            last_np, prep = k, None
        elif pos[k] == "PUNCT":
            dep[k] = "punct"
        elif pos[k] == "CCONJ":
            dep[k] = "cc"
    ent = ["O"] * n
    kind: list[str | None] = [None] * n
    for a, b in chunks:
        phrase = " ".join(words[a : b + 1])
        core_ = " ".join(words[k] for k in range(a, b + 1) if pos[k] not in ("DET", "PRON")) or phrase
        k2 = phrase_type(words[b].lower(), core_)
        for k in range(a, b + 1):
            ent[k], kind[k] = ("B" if k == a else "I"), k2
    for k in range(n):  # no token may hang below itself
        seen, j = set(), k
        while head[j] != j:
            if j in seen:
                head[j] = root if j != root else j
                break
            seen.add(j)
            j = head[j]
    head[root] = root
    return [(k, words[k], lemma(words[k]), pos[k], dep[k], head[k], kind[k], ent[k]) for k in range(n)]


def english(segments: DataFrame) -> DataFrame:
    """(doc, tokens) of the segments that state English or nothing."""
    s = segments.where("size(tokens) > 0 and (lang is null or lower(trim(lang)) like 'en%' or trim(lang) in ('', 'und', 'unknown'))")
    return s.select(F.concat_ws("#", "policy_id", F.format_string("%06d", F.col("segment_id").cast("int"))).alias("doc"), "tokens")


def sentences(tokens: Iterable[str | None]) -> Iterator[list[str]]:
    """The words of each sentence; it ends at . ! and ? and where a word is missing."""
    cur: list[str] = []
    for w in [*tokens, None]:
        if w is not None and w.strip():
            cur.append(w)
        if cur and (w is None or w in (".", "!", "?")):
            yield cur
            cur = []


def parse(docs: DataFrame) -> DataFrame:
    """Token rows of documents (doc, tokens); sentences end at . ! and ? (TOK-01). Map-side only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, toks in zip(b["doc"], b["tokens"], strict=True):
                out += [(d, sent, *t) for sent, words in enumerate(sentences(toks)) for t in parse_sentence(words)]
            yield pd.DataFrame(out, columns=["doc", "sent", "i", "text", "lemma", "pos", "dep", "head", "ent_type", "ent_iob"])

    return docs.mapInPandas(run, SCHEMA)
