"""Hand-annotated sentences: one token per line as word/lemma/POS/dep/head/entity (B or I and type)."""

from __future__ import annotations

SENTENCES = {
    ("a", 0): "We/we/PRON/nsubj/1/B-ACTOR collect/collect/VERB/ROOT/1 personal/personal/ADJ/amod/3/B-DATA information/information/NOUN/dobj/1/I-DATA such/such/ADJ/amod/5 as/as/ADP/prep/3 your/your/PRON/poss/8/B-DATA email/email/NOUN/compound/8/I-DATA address/address/NOUN/pobj/5/I-DATA and/and/CCONJ/cc/8 phone/phone/NOUN/compound/11/B-DATA number/number/NOUN/conj/8/I-DATA ././PUNCT/punct/1",
    ("a", 1): "We/we/PRON/nsubj/1/B-ACTOR share/share/VERB/ROOT/1 this/this/DET/det/3/B-DATA information/information/NOUN/dobj/1/I-DATA with/with/ADP/prep/1 partners/partner/NOUN/pobj/4/B-ACTOR ././PUNCT/punct/1",
    ("a", 2): "Partners/partner/NOUN/nsubj/3/B-ACTOR do/do/AUX/aux/3 not/not/PART/neg/3 sell/sell/VERB/ROOT/3 device/device/NOUN/compound/5/B-DATA identifiers/identifier/NOUN/dobj/3/I-DATA to/to/ADP/prep/3 advertisers/advertiser/NOUN/pobj/6/B-ACTOR ././PUNCT/punct/3",
    ("b", 0): "Device/device/NOUN/compound/1/B-DATA data/data/NOUN/nsubj/2/I-DATA includes/include/VERB/ROOT/2 identifiers/identifier/NOUN/dobj/2/B-DATA and/and/CCONJ/cc/3 cookies/cookie/NOUN/conj/3/B-DATA ././PUNCT/punct/2",
    ("b", 1): "Cookies/cookie/NOUN/nsubjpass/2/B-DATA are/be/AUX/auxpass/2 used/use/VERB/ROOT/2 by/by/ADP/agent/2 advertisers/advertiser/NOUN/pobj/3/B-ACTOR to/to/PART/aux/6 show/show/VERB/xcomp/2 ads/ad/NOUN/dobj/6 ././PUNCT/punct/2",
    ("b", 2): "Do/do/AUX/aux/2 you/you/PRON/nsubj/2/B-ACTOR sell/sell/VERB/ROOT/2 data/data/NOUN/dobj/2/B-DATA ?/?/PUNCT/punct/2",
    ("c", 0): "We/we/PRON/nsubj/1/B-ACTOR provide/provide/VERB/ROOT/1 advertisers/advertiser/NOUN/dobj/1/B-ACTOR with/with/ADP/prep/1 location/location/NOUN/compound/5/B-DATA data/data/NOUN/pobj/3/I-DATA ././PUNCT/punct/1",
    ("c", 1): "Our/our/PRON/poss/1/B-ACTOR partners/partner/NOUN/nsubj/2/I-ACTOR use/use/VERB/ROOT/2 and/and/CCONJ/cc/2 store/store/VERB/conj/2 usage/usage/NOUN/compound/6/B-DATA data/data/NOUN/dobj/4/I-DATA ,/,/PUNCT/punct/6 especially/especially/ADV/advmod/9 clicks/click/NOUN/appos/6/B-DATA ././PUNCT/punct/2",
    ("c", 2): "They/they/PRON/nsubj/1 collect/collect/VERB/ROOT/1 data/data/NOUN/dobj/1/B-DATA from/from/ADP/prep/1 children/child/NOUN/pobj/3 for/for/ADP/prep/1 analytics/analytics/NOUN/pobj/5 ././PUNCT/punct/1",
    ("d", 0): "Acme/acme/PROPN/nsubj/4/B-ACTOR ,/,/PUNCT/punct/0 we/we/PRON/appos/0/B-ACTOR ,/,/PUNCT/punct/0 require/require/VERB/ROOT/4 users/user/NOUN/dobj/4/B-ACTOR to/to/PART/aux/7 provide/provide/VERB/xcomp/4 names/name/NOUN/dobj/7/B-DATA to/to/ADP/prep/7 us/we/PRON/pobj/9/B-ACTOR ././PUNCT/punct/4",
}


def rows() -> list[tuple]:
    out = []
    for (doc, sent), line in SENTENCES.items():
        for i, t in enumerate(line.split(" ")):
            p = t.split("/")
            ent = p[5] if len(p) > 5 else ""
            out.append((doc, sent, i, p[0], p[1], p[2], p[3], int(p[4]), ent[2:] or None, ent[:1] or "O"))
    return out


def values() -> str:
    """The token table as SQL VALUES."""
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "tok(doc, sent, i, text, lemma, pos, dep, head, ent_type, ent_iob) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows()) + ")"
