"""Patterns and rules over all graphs: each edge is put into a sentence for each pattern or rule, and must come out again."""

import pandas as pd

from clauseweave.operators import graph as G, policies as P, sentences as Z
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import table
from clauseweave.queries.pattern_tokens import PATTERN_SENTENCES, RULE_SENTENCES, rows
from clauseweave.queries.sqlparts import KG

q = CORE.add


def templates(told):
    """(template, its tokens) with a full stop, so that no term at the end makes a question of a sentence."""
    by = {}
    for doc, _, *t in rows(told):
        by.setdefault(doc, []).append(tuple(t))
    return [(doc, [*ts, (len(ts), ".", ".", "PUNCT", "punct", next(t[0] for t in ts if t[4] == "ROOT"), None, "O")]) for doc, ts in by.items()]


def readings(told, wide, src, dst):
    """(template, sentence): src and dst in each of the templates; the tokens ``wide`` show src, "names", or "data" in templates that begin with it, dst."""
    for name, tokens in told:
        narrow = "data" if name.startswith("data ") else "names"
        yield name, Z.Sentence([(i, src if text in wide else dst if text == narrow else text, *rest) for i, text, *rest in tokens])


def through(spark, folder, key, tell, columns):
    """(policy_id, columns): what ``tell`` gives for (src, dst) of each edge with ``key``, once for each policy."""

    def joined(kg):
        def run(batches):
            for b in batches:
                out = [(p, *r) for p, s, d in zip(b["policy_id"], b["src"], b["dst"], strict=True) for r in tell(s, d)]
                yield pd.DataFrame(out, columns=["policy_id", *(c.split()[0] for c in columns.split(", "))])

        e = G.edges_of(kg).where(f"key = '{key}' and src <> dst").select("policy_id", "src", "dst")
        return e.mapInPandas(run, "policy_id string, " + columns).distinct()

    return P.answers(table(spark, folder, "kg_edges"), lambda g: {r for s, d, k in g.labels if k == key and s != d for r in tell(s, d)}, columns, joined)


NAMES = ", ".join(f"('{k}')" for k in PATTERN_SENTENCES if k != "some_of")


@q("pattern_links", f"WITH {KG}, p(template) AS (VALUES {NAMES}) SELECT policy_id, template, src, dst FROM sub CROSS JOIN p WHERE src <> dst UNION SELECT policy_id, 'some_of', src, 'some' FROM sub WHERE src <> dst")
def pattern_links(spark, folder):
    """ANN-01..15, ANN-28, TOK-10: every hypernymy pattern over every SUBSUM edge."""
    told = templates(PATTERN_SENTENCES)

    def tell(src, dst):
        return ((name, s.text[u], s.text[x]) for name, s in readings(told, ("data",), src, dst) for u, x, _ in Z.subsumption(s))

    return through(spark, folder, "SUBSUM", tell, "template string, src string, dst string")


# What each rule must tell of the edge (SRC, DST): the actor and the key.
TOLD = [
    ("share with", "SRC", "COLLECT"), ("share with", "partners", "BE_SHARED"), ("collect from", "SRC", "COLLECT"), ("provide with", "SRC", "COLLECT"), ("provide with", "partners", "BE_SHARED"),
    ("provide to", "SRC", "COLLECT"), ("provide to", "partners", "BE_SHARED"), ("sell to", "SRC", "COLLECT"), ("sell to", "partners", "BE_SOLD"), ("use", "SRC", "USE"), ("store", "SRC", "STORE"),
    ("have access to", "SRC", "USE"), ("make use of", "SRC", "USE"), ("require to share", "users", "COLLECT"), ("require to share", "partners", "BE_SHARED"), ("require to provide with", "users", "COLLECT"),
    ("require to provide with", "us", "BE_SHARED"), ("require to provide to", "users", "COLLECT"), ("require to provide to", "us", "BE_SHARED"), ("allow to collect", "partners", "COLLECT"),
    ("allow to share", "partners", "COLLECT"), ("allow to share", "advertisers", "BE_SHARED"), ("allow to use", "partners", "USE"), ("allow to store", "partners", "STORE"), ("have to collect", "SRC", "COLLECT"),
    ("have to use", "SRC", "USE"), ("have to store", "SRC", "STORE"), ("data collected include", "SRC", "COLLECT"), ("data used include", "SRC", "USE"), ("data stored include", "SRC", "STORE"), ("use to collect", "SRC", "COLLECT"),
]
TOLD_SQL = ", ".join(f"('{r}', '{a}', '{k}')" for r, a, k in TOLD)


@q("rule_statements", f"WITH {KG}, e AS (SELECT DISTINCT policy_id, src, dst FROM kg WHERE key = 'COLLECT' AND src <> dst), t(template, actor, key) AS (VALUES {TOLD_SQL}) SELECT DISTINCT policy_id, template, CASE WHEN actor = 'SRC' THEN src ELSE actor END AS src, dst, t.key FROM e CROSS JOIN t")
def rule_statements(spark, folder):
    """COL-01..17: every statement rule over every COLLECT edge."""
    told = templates(RULE_SENTENCES)

    def tell(src, dst):
        return ((name, s.text[a], dst, key) for name, s in readings(told, ("We", "we"), src, dst) for a, d, key, _ in Z.statements(s) if s.text[d] == dst)

    return through(spark, folder, "COLLECT", tell, "template string, src string, dst string, key string")
