"""Hand-annotated sentences, one for each hypernymy pattern and each statement rule; see ``fixture_tokens``."""

from __future__ import annotations

A, D = "B-ACTOR", "B-DATA"
WE = f"We/we/PRON/nsubj/1/{A}"
# pattern -> its sentence
PATTERN_SENTENCES = {
    "such_as": f"data/data/NOUN/ROOT/0/{D} such/such/ADJ/amod/2 as/as/ADP/prep/0 names/name/NOUN/pobj/2/{D}",
    "including": f"data/data/NOUN/ROOT/0/{D} including/include/VERB/prep/0 names/name/NOUN/pobj/1/{D}",
    "include": f"data/data/NOUN/nsubj/1/{D} includes/include/VERB/ROOT/1 names/name/NOUN/dobj/1/{D}",
    "which_include": f"data/data/NOUN/ROOT/0/{D} which/which/PRON/nsubj/2 includes/include/VERB/relcl/0 names/name/NOUN/dobj/2/{D}",
    "including_not_limited": f"data/data/NOUN/ROOT/0/{D} including/include/VERB/prep/0 not/not/PART/neg/3 limited/limit/VERB/conj/1 to/to/ADP/prep/3 names/name/NOUN/pobj/4/{D}",
    "includes_not_limited": f"data/data/NOUN/nsubj/1/{D} includes/include/VERB/ROOT/1 not/not/PART/neg/3 limited/limit/VERB/conj/1 to/to/ADP/prep/3 names/name/NOUN/pobj/4/{D}",
    "for_example": f"data/data/NOUN/ROOT/0/{D} for/for/ADP/prep/3 example/example/NOUN/pobj/1 names/name/NOUN/appos/0/{D}",
    "especially": f"data/data/NOUN/ROOT/0/{D} especially/especially/ADV/advmod/2 names/name/NOUN/appos/0/{D}",
    "eg": f"data/data/NOUN/ROOT/0/{D} e.g./e.g./ADV/advmod/2 names/name/NOUN/appos/0/{D}",
    "such_n_as": f"such/such/ADJ/amod/1 data/data/NOUN/ROOT/1/{D} as/as/ADP/prep/1 names/name/NOUN/pobj/2/{D}",
    "collectively": f"names/name/NOUN/ROOT/0/{D} collectively/collectively/ADV/advmod/2 data/data/NOUN/appos/0/{D}",
    "some_of": f"some/some/PRON/ROOT/0 of/of/ADP/prep/0 data/data/NOUN/pobj/1/{D}",
}
# rule -> its sentence
RULE_SENTENCES = {
    "share with": f"{WE} share/share/VERB/ROOT/1 names/name/NOUN/dobj/1/{D} with/with/ADP/prep/1 partners/partner/NOUN/pobj/3/{A}",
    "collect from": f"{WE} collect/collect/VERB/ROOT/1 names/name/NOUN/dobj/1/{D} from/from/ADP/prep/1 users/user/NOUN/pobj/3/{A}",
    "provide with": f"{WE} supply/supply/VERB/ROOT/1 partners/partner/NOUN/dobj/1/{A} with/with/ADP/prep/1 names/name/NOUN/pobj/3/{D}",
    "provide to": f"{WE} transfer/transfer/VERB/ROOT/1 names/name/NOUN/dobj/1/{D} to/to/ADP/prep/1 partners/partner/NOUN/pobj/3/{A}",
    "sell to": f"{WE} sell/sell/VERB/ROOT/1 names/name/NOUN/dobj/1/{D} to/to/ADP/prep/1 partners/partner/NOUN/pobj/3/{A}",
    "use": f"{WE} analyze/analyze/VERB/ROOT/1 names/name/NOUN/dobj/1/{D}",
    "store": f"{WE} retain/retain/VERB/ROOT/1 names/name/NOUN/dobj/1/{D}",
    "have access to": f"{WE} gain/gain/VERB/ROOT/1 access/access/NOUN/dobj/1 to/to/ADP/prep/2 names/name/NOUN/pobj/3/{D}",
    "make use of": f"{WE} make/make/VERB/ROOT/1 use/use/NOUN/dobj/1 of/of/ADP/prep/2 names/name/NOUN/pobj/3/{D}",
    "require to share": f"{WE} ask/ask/VERB/ROOT/1 users/user/NOUN/dobj/1/{A} to/to/PART/aux/4 share/share/VERB/xcomp/1 names/name/NOUN/dobj/4/{D} with/with/ADP/prep/4 partners/partner/NOUN/pobj/6/{A}",
    "require to provide with": f"{WE} require/require/VERB/ROOT/1 users/user/NOUN/dobj/1/{A} to/to/PART/aux/4 supply/supply/VERB/xcomp/1 us/we/PRON/dobj/4/{A} with/with/ADP/prep/4 names/name/NOUN/pobj/6/{D}",
    "require to provide to": f"{WE} oblige/oblige/VERB/ROOT/1 users/user/NOUN/dobj/1/{A} to/to/PART/aux/4 submit/submit/VERB/xcomp/1 names/name/NOUN/dobj/4/{D} to/to/ADP/prep/4 us/we/PRON/pobj/6/{A}",
    "allow to collect": f"{WE} allow/allow/VERB/ROOT/1 partners/partner/NOUN/dobj/1/{A} to/to/PART/aux/4 gather/gather/VERB/xcomp/1 names/name/NOUN/dobj/4/{D} from/from/ADP/prep/4 users/user/NOUN/pobj/6/{A}",
    "allow to share": f"{WE} permit/permit/VERB/ROOT/1 partners/partner/NOUN/dobj/1/{A} to/to/PART/aux/4 trade/trade/VERB/xcomp/1 names/name/NOUN/dobj/4/{D} with/with/ADP/prep/4 advertisers/advertiser/NOUN/pobj/6/{A}",
    "allow to use": f"{WE} enable/enable/VERB/ROOT/1 partners/partner/NOUN/dobj/1/{A} to/to/PART/aux/4 process/process/VERB/xcomp/1 names/name/NOUN/dobj/4/{D}",
    "allow to store": f"{WE} authorize/authorize/VERB/ROOT/1 partners/partner/NOUN/dobj/1/{A} to/to/PART/aux/4 keep/keep/VERB/xcomp/1 names/name/NOUN/dobj/4/{D}",
    "have to collect": f"{WE} intend/intend/VERB/ROOT/1 to/to/PART/aux/3 receive/receive/VERB/xcomp/1 names/name/NOUN/dobj/3/{D} from/from/ADP/prep/3 partners/partner/NOUN/pobj/5/{A}",
    "have to use": f"{WE} aim/aim/VERB/ROOT/1 to/to/PART/aux/3 utilize/utilize/VERB/xcomp/1 names/name/NOUN/dobj/3/{D}",
    "have to store": f"{WE} continue/continue/VERB/ROOT/1 to/to/PART/aux/3 hold/hold/VERB/xcomp/1 names/name/NOUN/dobj/3/{D}",
    "data collected include": f"data/data/NOUN/nsubj/3/{D} we/we/PRON/nsubj/2/{A} obtain/obtain/VERB/relcl/0 include/include/VERB/ROOT/3 names/name/NOUN/dobj/3/{D}",
    "data used include": f"data/data/NOUN/nsubj/3/{D} we/we/PRON/nsubj/2/{A} process/process/VERB/relcl/0 include/include/VERB/ROOT/3 names/name/NOUN/dobj/3/{D}",
    "data stored include": f"data/data/NOUN/nsubj/3/{D} we/we/PRON/nsubj/2/{A} store/store/VERB/relcl/0 include/include/VERB/ROOT/3 names/name/NOUN/dobj/3/{D}",
    "use to collect": f"{WE} use/use/VERB/ROOT/1 cookies/cookie/NOUN/dobj/1 to/to/PART/aux/4 collect/collect/VERB/xcomp/1 names/name/NOUN/dobj/4/{D}",
}


def rows(sentences: dict[str, str]) -> list[tuple]:
    """Token rows; the document is the name of the pattern or rule."""
    out = []
    for doc, line in sentences.items():
        for i, t in enumerate(line.split(" ")):
            p = t.split("/")
            ent = p[5] if len(p) > 5 else ""
            out.append((doc, 0, i, p[0], p[1], p[2], p[3], int(p[4]), ent[2:] or None, ent[:1] or "O"))
    return out
