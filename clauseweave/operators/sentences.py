"""Sentences as arrays: all annotators in one Arrow pass over documents.

The operators of ``tokens``, ``annotate`` and ``statements`` state each step as joins over a token table.
Where whole corpora are annotated, each step would shuffle every token, though nothing ever leaves its
document. Here a document is one row; its sentences are short lists, and patterns, rules and subtrees
are looked up in them. Both forms give the same rows; the tests compare them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from clauseweave.operators import annotate as A, statements as S, tokens as T
from clauseweave.operators.provider import parse_sentence, sentences

INNER = {"compound", "amod", "det", "poss", "nummod"}


class Sentence:
    """The columns of one sentence's tokens, with children and coordinations."""

    def __init__(self, rows: list[tuple]) -> None:
        self.text, self.lemma, self.pos, self.dep, self.head, self.ent, self.iob = (list(c) for c in list(zip(*rows, strict=True))[1:])
        self.n = len(rows)
        self.words = set(self.lemma)
        self.kids: list[list[int]] = [[] for _ in rows]
        for i, h in enumerate(self.head):
            if h != i:
                self.kids[h].append(i)
        self.chains = self._chains()

    def below(self, i: int) -> dict[int, int]:
        """Token -> distance of all tokens below ``i``, itself included."""
        out, todo = {i: 0}, [i]
        while todo:
            x = todo.pop()
            for k in self.kids[x]:
                if k not in out:
                    out[k] = out[x] + 1
                    todo.append(k)
        return out

    def _chains(self) -> dict[int, int]:
        """Token -> first token of its coordination."""
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for i, d in enumerate(self.dep):
            if d == "conj":
                a, b = find(i), find(self.head[i])
                up[max(a, b)] = min(a, b)
        return {x: find(x) for x in up}

    def others(self, first: int) -> list[int]:
        return [x for x, f in self.chains.items() if f == first and x != first]

    def kind(self, i: int) -> str:
        return self.ent[i] or ""


@cache
def compiled(text: str) -> tuple[str, dict[str, list], list[tuple[str, str, str]], list[set[str]]]:
    """(first node, node -> tests, relations, the lemmas of which each sentence needs one) of a pattern's text."""
    p = T.parse_pattern(text)
    nodes: dict[str, list] = {}
    for name, spec in p.nodes.items():
        tests = []
        for x in spec.split():
            if x == "noun":
                tests.append(("pos", False, {"NOUN", "PROPN", "PRON"}))
            else:
                column, no, values = re.fullmatch(r"(\w+)(!?)=(.+)", x).groups()
                tests.append((column, bool(no), set(values.split("|"))))
        nodes[name] = tests
    return p.first, nodes, p.ties, [v for tests in nodes.values() for c, no, v in tests if c == "lemma" and not no]


def fits(s: Sentence, i: int, tests: list) -> bool:
    return all(((getattr(s, c)[i] or "") in v) != no for c, no, v in tests)


def find(s: Sentence, pattern: str) -> list[dict[str, int]]:
    """All matches of a dependency pattern without a negated token."""
    first, nodes, ties, needs = compiled(pattern)
    if any(s.words.isdisjoint(v) for v in needs):
        return []
    found = [{first: i} for i in range(s.n) if fits(s, i, nodes[first])]
    for a, op, b in ties:
        nxt = []
        for m in found:
            i = m[a]
            if op == ">":
                near = s.kids[i]
            elif op == "<":
                near = [s.head[i]] if s.head[i] != i else []
            elif op == ";":
                near = [i - 1] if i else []
            else:
                near = [j for j, d in s.below(i).items() if d]
            nxt += [m | {b: j} for j in near if fits(s, j, nodes[b])]
        found = nxt
        if not found:
            return []
    out = []
    for m in found:
        used = set(m.values())
        if m not in out and not any(s.dep[k] == "neg" and k not in used for i in used for k in s.kids[i]):
            out.append(m)
    return out


def subsumption(s: Sentence) -> list[tuple[int, int, str]]:
    """(wider, narrower, pattern): hypernymy, an enumeration's later members after its first."""
    found: dict[tuple[int, int], str] = {}
    for name, p in A.SUBSUM_PATTERNS.items():
        for m in find(s, p):
            u, low = m["u"], m["l"]
            if s.pos[u] == "PRON":
                continue
            for x in [low, *(s.others(low) if s.chains.get(low) == low else [])]:
                a, b = s.kind(u), s.kind(x)
                if u != x and (a == b or a in ("", "NN") or b in ("", "NN")):
                    found[u, x] = min(name, found.get((u, x), name))
    return [(u, x, n) for (u, x), n in found.items()]


def coreference(sents: list[Sentence]) -> list[tuple[int, int, int, int]]:
    """(sentence, anaphor, sentence, antecedent)."""
    heads = [[i for i in range(s.n) if s.iob[i] in ("B", "I") and s.dep[i] not in INNER] for s in sents]
    out = []
    for k, s in enumerate(sents):
        named = {s.head[i] for i in range(s.n) if s.lemma[i] in ("this", "that", "these", "those", "such") and s.dep[i] in ("det", "amod")}
        asks = [(i, "info" if s.lemma[i] in ("data", "datum", "information") else "same") for i in heads[k] if i in named]
        asks += [(i, "pronoun") for i in range(s.n) if s.pos[i] == "PRON" and s.lemma[i] in ("it", "this", "they", "these")]
        for i, how in asks:
            for m in (k, k - 1):
                if m < 0:
                    continue
                b = sents[m]
                for j in heads[m]:
                    if b.pos[j] == "PRON" or (m == k and j >= i):
                        continue
                    plural = b.text[j].endswith("s")
                    good = s.lemma[i] == b.lemma[j] if how == "same" else b.kind(j) == "DATA" if how == "info" else plural if s.lemma[i] in ("they", "these") else not plural
                    if good:
                        out.append((k, i, m, j))
                        break
                else:
                    continue
                break
    return out


def first_party(s: Sentence) -> list[tuple[int, int]]:
    """(we, what stands in apposition to it)."""
    we = {i for i in range(s.n) if s.lemma[i] in ("we", "us")}
    return sorted({(s.head[i], i) for i in range(s.n) if s.dep[i] == "appos" and s.head[i] in we} | {(i, s.head[i]) for i in we if s.dep[i] == "appos"})


def data_heads(s: Sentence) -> list[int]:
    return [i for i in range(s.n) if s.ent[i] == "DATA" and s.dep[i] not in INNER]


def purposes(s: Sentence) -> list[tuple[int, int]]:
    """(data phrase, purpose)."""
    out = set()
    for p in A.PURPOSE_PATTERNS.values():
        for m in find(s, p):
            r, v = m["r"], m["v"]
            if s.lemma[v] in ("period", "time", "purpose", "example"):
                continue
            under, inside = s.below(r), s.below(v)
            out |= {(d, v) for d in data_heads(s) if under.get(d, 0) > 0 and d not in inside}
    return sorted(out)


def of_children(s: Sentence) -> list[int]:
    """The data phrases of a sentence that speaks of children."""
    return data_heads(s) if any(find(s, p) for p in A.SUBJECT_PATTERNS.values()) else []


RELATION = {"nsubj": "subj", "csubj": "subj", "nsubjpass": "obj", "dobj": "obj", "pobj": "obj", "dative": "dative", "xcomp": "xcomp", "ccomp": "xcomp", "advcl": "xcomp", "relcl": "relcl", "prep": "prep"}


def relations(s: Sentence) -> set[tuple[int, str, int]]:
    """(parent, relation, child) in the few relations that rules speak of."""
    e = {(s.head[i], RELATION[d], i) for i, d in enumerate(s.dep) if d in RELATION and s.head[i] != i}
    for i, d in enumerate(s.dep):
        h = s.head[i]
        if d == "pobj" and s.lemma[h] == "by" and s.dep[h] in ("agent", "prep"):
            e.add((s.head[h], "subj", i))
    twin: dict[int, list[int]] = defaultdict(list)
    for i, d in enumerate(s.dep):
        if d == "appos":
            twin[s.head[i]].append(i)
    e |= {(p, r, x) for p, r, c in e for x in twin.get(c, ())}
    e |= {(p, r, x) for p, r, c in e if s.chains.get(c) == c for x in s.others(c)}
    if s.chains:
        have = {p for p, r, _ in e if r == "subj"}
        e |= {(x, "subj", c) for p, r, c in e if r == "subj" and s.chains.get(p) == p for x in s.others(p) if x not in have}
        verbs = [i for i in s.chains if s.pos[i] == "VERB"]
        objects = {(p, c) for p, r, c in e if r == "obj"}
        have = {p for p, _ in objects}
        e |= {(i, "obj", c) for i in verbs if i not in have for p, c in objects if p in verbs and p > i and s.chains[p] == s.chains[i]}
    have = {p for p, r, _ in e if r == "subj"}
    return e | {(v, "subj", c) for p, r, v in e if r == "xcomp" and v not in have for q, t, c in e if q == p and t == "obj"}


def negated(s: Sentence) -> set[int]:
    """The verbs that "not" or the like denies, through coordination unless there is a "but"."""
    own = {s.head[i] for i, d in enumerate(s.dep) if d == "neg"}
    if own and not any(w == "but" and d == "cc" for w, d in zip(s.lemma, s.dep, strict=True)):
        firsts = {i for i in own if s.chains.get(i) == i}
        own |= {i for i, f in s.chains.items() if f in firsts}
    return own


@cache
def rules(text: str) -> dict[str, list[S.Rule]]:
    """Root lemma -> the rules that start from it."""
    out: dict[str, list[S.Rule]] = defaultdict(list)
    for x in text.strip().splitlines():
        r = S.parse_rule(x)
        for w in r.root:
            out[w].append(r)
    return out


def statements(s: Sentence, text: str = S.RULES) -> set[tuple[int, int, str, str]]:
    """(actor, data, key, rule): what the rules state; questions state nothing."""
    known = rules(text)
    roots = [i for i, d in enumerate(s.dep) if d in ("ROOT", "ccomp", "conj") and s.lemma[i].lower() in known]
    if not roots or s.text[-1] == "?":
        return set()
    no = negated(s)
    step: dict[tuple[int, str], list[int]] = defaultdict(list)
    for p, r, c in relations(s):
        if c not in no:
            step[p, r].append(c)
    out = set()
    for root in roots:
        for rule in known[s.lemma[root].lower()]:
            kept: dict[str, set[int]] = defaultdict(set)
            for need, name, hops in rule.chains:
                at = {root}
                for lem, rel in hops:
                    at = {c for p in at for c in step.get((p, rel), ()) if not lem or s.lemma[c].lower() in lem}
                if need and not at:
                    break
                if name:
                    kept[name] |= at
            else:
                ends = {}
                for role, names in zip(("who", "what", "whom"), rule.args, strict=False):
                    ends[role] = next((kept[n] for n in names if kept.get(n)), set())
                for action, neg, role, key in S.ACTIONS:
                    if action == rule.action and neg == (root in no):
                        out |= {(a, d, key, rule.name) for a in ends.get(role, ()) for d in ends.get("what", ()) if s.kind(a) in ("", "NN", "ACTOR") and s.kind(d) in ("", "NN", "DATA")}
    return out


def phrase(s: Sentence, i: int) -> tuple[list[int], list[int]]:
    """(tokens of the phrase of ``i``, of its stem): the entity run around it with what follows it without a gap, and the stem."""
    lo = hi = i
    if s.iob[i] in ("B", "I"):
        while lo and s.iob[lo] == "I" and s.iob[lo - 1] in ("B", "I"):
            lo -= 1
        while hi + 1 < s.n and s.iob[hi + 1] == "I":
            hi += 1
    for k in sorted(x for x in s.kids[i] if x > hi):
        sub = sorted(s.below(k))
        if s.dep[k] in ("punct", "dep", "meta", "cc", "preconj", "conj", "appos") or sub[0] != hi + 1 or sub[-1] - sub[0] + 1 != len(sub) or any(s.ent[x] in ("DATA", "ACTOR") for x in sub):
            break
        hi = sub[-1]
    return list(range(lo, hi + 1)), stem(s, i)


def stem(s: Sentence, i: int) -> list[int]:
    """The head and what qualifies it, without trivial words."""
    out, todo = [], [i]
    while todo:
        x = todo.pop()
        if x == i or s.lemma[x] not in T.TRIVIAL:
            out.append(x)
        todo += [k for k in s.kids[x] if s.dep[k] in T.STEM_DEPS]
    return sorted(out)


def noun_phrases(s: Sentence) -> list[tuple[int, int, int]]:
    """(head, first, last) of the noun phrases that part a sentence, outermost first (TOK-02).

    From the root down: a noun, proper noun or pronoun that isn't part of another's name opens a phrase,
    which grows over its children's subtrees to both sides as long as they touch it, aren't a clause, a
    coordination or an apposition, and hold no bracket without its partner. What is left of its subtree
    is parted in the same way.
    """
    out: list[tuple[int, int, int]] = []
    todo = [i for i in range(s.n) if s.head[i] == i]
    taken = [False] * s.n
    while todo:
        i = todo.pop(0)
        if s.pos[i] in ("NOUN", "PROPN", "PRON") and s.dep[i] not in ("compound", "poss") and not taken[i]:
            lo = hi = i
            for side in (sorted((k for k in s.kids[i] if k < i), reverse=True), sorted(k for k in s.kids[i] if k > i)):
                for k in side:
                    sub = sorted(s.below(k))
                    text = " ".join(s.text[x] for x in sub)
                    touches = sub[-1] + 1 == lo if k < i else sub[0] == hi + 1
                    if not touches or sub[-1] - sub[0] + 1 != len(sub) or s.dep[k] in ("punct", "cc", "conj", "appos", "relcl", "acl", "advcl", "prep", "dep") or any(text.count(a) != text.count(b) for a, b in ("()", "[]", "{}", "“”")):
                        break
                    lo, hi = min(lo, sub[0]), max(hi, sub[-1])
            for x in range(lo, hi + 1):
                taken[x] = True
            out.append((i, lo, hi))
        todo += s.kids[i]
    return sorted(out)


ROWS = "policy_id string, kind string, a bigint, b bigint, s_from bigint, s_to bigint, rel string, phrase string, lemma string, stem string, flag boolean"


def split(words: list[str]) -> Iterator[list[int]]:
    """The word numbers of each sentence: it ends with . ! ? or before a line end."""
    cur: list[int] = []
    for k, w in enumerate(words):
        if w.strip():
            cur.append(k)
        if cur and (w in (".", "!", "?") or "\n" in w):
            yield cur
            cur = []
    if cur:
        yield cur


def annotate_document(policy: str, words: list[str], place: list[int | None], item: int | None, disable: frozenset[str]) -> list[tuple]:
    """The rows of one contextual document; see ``annotate_documents``."""
    spans = list(split(words))
    return rows_of(policy, [Sentence(parse_sentence([words[k] for k in sp])) for sp in spans], spans, words, place, item, disable)


def rows_of(policy: str, sents: list[Sentence], spans: list[list[int]], words: list[str], place: list[int | None], item: int | None, disable: frozenset[str]) -> list[tuple]:
    """The rows of parsed sentences; spans: the word numbers of each."""
    node = lambda k, i: place[spans[k][i]]
    ends = [([p for p in (place[x] for x in sp) if p is not None] or [None]) for sp in spans]
    out: list[tuple] = []
    used: set[tuple[int, int]] = set()

    def link(k: int, i: int, m: int, j: int, rel: str, rule: str | None = None) -> None:
        a, b = node(k, i), node(m, j)
        if a is not None and b is not None and a != b:
            used.update(((k, i), (m, j)))
            out.append((policy, "link", a, b, ends[k][0], ends[k][-1], rel, rule, None, None, None))

    for k, s in enumerate(sents):
        for a, d, key, rule in statements(s):
            link(k, a, k, d, key, rule)
        if "subsumption" not in disable:
            for u, low, name in subsumption(s):
                link(k, u, k, low, "SUBSUM", name)
        if "first_party" not in disable:
            for u, low in first_party(s):
                link(k, u, k, low, "SUBSUM", "first_party")
        if "purpose" not in disable and not (words[spans[k][-1]] == ":"):
            for d, v in purposes(s):
                at = sorted(x for x in s.below(v) if node(k, x) is not None and node(k, v) is not None and node(k, x) >> 32 == node(k, v) >> 32)
                if at and node(k, d) is not None:
                    used.add((k, d))
                    out.append((policy, "purpose", node(k, d), node(k, v), ends[k][0], ends[k][-1], None, " ".join(s.text[x] for x in at), None, None, None))
        if "subject" not in disable:
            for d in of_children(s):
                if node(k, d) is not None:
                    out.append((policy, "subject", node(k, d), None, None, None, None, "children", None, None, None))
    if "coreference" not in disable:
        for k, i, m, j in coreference(sents):
            link(k, i, m, j, "COREF")
    if item is not None and "list" not in disable:
        own = [k for k, e in enumerate(ends) if e[0] is not None and e[-1] >> 32 == item]
        for k in own[:1]:  # the first noun of the item that hangs on nothing in it
            s = sents[k]
            mine = [x for x in range(s.n) if node(k, x) is not None and node(k, x) >> 32 == item]
            i = next((x for x in mine if s.pos[x] in ("NOUN", "PROPN") and s.dep[x] not in INNER and (s.head[x] == x or s.head[x] not in mine)), None)
            if i is not None:
                used.add((k, i))
                out.append((policy, "item", node(k, i), item, None, None, None, None, None, None, len(own) == 1))
        for k, s in enumerate(sents):  # the head over a list: "the following ...", or a lone noun phrase
            if ends[k][0] is None or ends[k][0] >> 32 == item:
                continue
            for x in range(s.n):
                if s.lemma[x] in ("follow", "following", "below") and s.dep[x] in ("amod", "advmod", "compound") and s.pos[s.head[x]] in ("NOUN", "PROPN") and (node(k, s.head[x]) or item << 32) >> 32 != item:
                    used.add((k, s.head[x]))
                    out.append((policy, "head", node(k, s.head[x]), item, ends[k][0], ends[k][-1], "following", None, None, None, None))
            root = next(x for x in range(s.n) if s.head[x] == x)
            if ends[k][-1] >> 32 != item and s.pos[root] in ("NOUN", "PROPN") and s.ent[root] in ("DATA", "ACTOR") and node(k, root) is not None:
                used.add((k, root))
                out.append((policy, "head", node(k, root), item, ends[k][0], ends[k][-1], "heading", None, None, None, None))
    for k, i in sorted(used):
        s = sents[k]
        full, short = phrase(s, i)
        flag = any(s.pos[x] == "PROPN" for x in full)
        rel = s.kind(i) or "NN"
        pronoun = s.pos[i] == "PRON" and s.lemma[i].lower() not in ("i", "we", "you")
        out.append((policy, "node", node(k, i), None, ends[k][0], ends[k][-1], rel, "\0" if pronoun else " ".join(s.text[x] for x in full), " ".join(s.lemma[x] for x in full), " ".join(s.lemma[x] for x in short), flag))
    seen = {k for k, _ in used}
    for k in sorted(seen):
        out.append((policy, "sentence", None, None, ends[k][0], ends[k][-1], None, " ".join(words[x] for x in spans[k]), None, None, None))
    return out


def annotate_documents(docs: DataFrame, disable: tuple[str, ...] = ()) -> DataFrame:
    """The phrase graph of contextual documents (``segments.annotation_documents``), in one pass (ANN-29, ANN-30, UDX-02, UDX-03).

    A token's node is its segment times 2^32 plus its place there, so what several contexts repeat is
    the same row. kinds: 'link' (a, b, rel; the sentence from s_from to s_to), 'node' (a; rel: type by
    entity; phrase, with \\0 for a pronoun; lemma; stem; flag: holds a proper noun), 'purpose' (data a, purpose
    b, phrase), 'subject' (a), 'item' (root phrase a of list item b; flag: a single sentence), 'head'
    (phrase a over list item b) and 'sentence' (phrase: its text). ``disable`` leaves annotators out.
    """
    off = frozenset(disable)
    unknown = off - set(A.ANNOTATORS) - {"list"}
    if unknown:
        raise ValueError(f"no such annotators: {sorted(unknown)}")
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for p, words, place, item in zip(b["policy_id"], b["words"], b["places"], b["item"], strict=True):
                out += annotate_document(p, list(words), [None if x < 0 else int(x) for x in place], None if pd.isna(item) else int(item), off)
            df = pd.DataFrame(out, columns=names)
            yield df.astype({"a": "Int64", "b": "Int64", "s_from": "Int64", "s_to": "Int64"})

    return docs.mapInPandas(run, ROWS)


def annotate_tokens(tokens: DataFrame, disable: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``annotate_documents`` from a token table of any parser; doc is policy#segment.

    A document is one segment here; its tokens are brought together, and it is one segment's length.
    """
    names = [x.split()[0] for x in ROWS.split(", ")]
    off = frozenset(disable)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["sent", "i"])
        policy, _, seg = g["doc"].iloc[0].partition("#")
        g = g.astype(object).where(g.notna(), None)
        sents, spans, k = [], [], 0
        for _, t in g.groupby("sent", sort=True):
            sents.append(Sentence([(int(i), *r[:4], int(h), *r[4:]) for i, h, *r in t[["i", "head", "text", "lemma", "pos", "dep", "ent_type", "ent_iob"]].itertuples(index=False, name=None)]))
            spans.append(list(range(k, k + len(t))))
            k += len(t)
        out = rows_of(policy, sents, spans, g["text"].tolist(), [((int(seg or 0)) << 32) + x for x in range(k)], None, off)
        return pd.DataFrame(out, columns=names).astype({"a": "Int64", "b": "Int64", "s_from": "Int64", "s_to": "Int64"})

    return tokens.groupBy("doc").applyInPandas(run, ROWS)


def noun_phrase_rows(docs: DataFrame) -> DataFrame:
    """(doc, sent, head, first, last, phrase) of the noun phrases of documents (doc, tokens) (TOK-02). Map-side only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, words in zip(b["doc"], b["tokens"], strict=True):
                words = list(words)
                for k, span in enumerate(split(words)):
                    s = Sentence(parse_sentence([words[x] for x in span]))
                    out += [(d, k, h, lo, hi, " ".join(s.text[lo : hi + 1])) for h, lo, hi in noun_phrases(s)]
            yield pd.DataFrame(out, columns=["doc", "sent", "head", "first", "last", "phrase"])

    return docs.mapInPandas(run, "doc string, sent int, head int, first int, last int, phrase string")


def sentence_rows(docs: DataFrame, tell: Callable[[Sentence], Iterable[tuple]], columns: str) -> DataFrame:
    """(doc, sent, columns): what ``tell`` tells of each sentence of documents (doc, tokens), which are cut and parsed as by ``provider.parse``. Map-side only."""
    schema = "doc string, sent int, " + columns
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, words in zip(b["doc"], b["tokens"], strict=True):
                for k, span in enumerate(sentences(words)):
                    out += [(d, k, *r) for r in tell(Sentence(parse_sentence(span)))]
            yield pd.DataFrame(out, columns=names)

    return docs.mapInPandas(run, schema)


def subsumption_rows(docs: DataFrame) -> DataFrame:
    """``annotate.Subsumption`` of documents (doc, tokens)."""
    return sentence_rows(docs, lambda s: ((*r, "SUBSUM") for r in subsumption(s)), "src int, dst int, pattern string, rel string")


def purpose_rows(docs: DataFrame) -> DataFrame:
    """``annotate.Purposes`` of documents (doc, tokens)."""
    return sentence_rows(docs, lambda s: ((*r, "PURPOSE") for r in purposes(s)), "src int, dst int, rel string")


def stem_rows(docs: DataFrame) -> DataFrame:
    """``tokens.phrase_stems`` of documents (doc, tokens)."""
    return sentence_rows(docs, lambda s: ((i, " ".join(s.lemma[x] for x in stem(s, i))) for i in range(s.n) if s.pos[i] in ("NOUN", "PROPN") and s.dep[i] not in ("compound", "nmod")), "i int, stem string")
