"""p5: the term forests of the policies."""

from pyspark.sql import functions as F

from clauseweave.operators.hierarchy import SEPARATOR, descendants, resolve_hierarchy, subsumption_edges
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import table

from clauseweave.queries.sqlparts import CLEAN

EDGES = f"""
    links AS (SELECT policy_id, min({CLEAN.format('source')}) AS p, {CLEAN.format('target')} AS c FROM kg_edges
        WHERE policy_id IS NOT NULL AND {CLEAN.format('key')} = 'subsum' AND {CLEAN.format('source')} <> '' AND {CLEAN.format('target')} <> '' GROUP BY ALL),
    nodes AS (SELECT policy_id, c AS node FROM links UNION SELECT policy_id, p FROM links),
    tree AS (SELECT n.policy_id, node, node AS root, 0 AS depth, node AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.policy_id = n.policy_id AND l.c = n.node)
        UNION ALL SELECT t.policy_id, l.c, t.root, t.depth + 1, t.path || ' > ' || l.c FROM tree t JOIN links l ON l.policy_id = t.policy_id AND l.p = t.node)"""


@CORE.add(
    "p5_found",
    f"""WITH RECURSIVE {EDGES}
    SELECT policy_id, node, root, depth::INT AS depth, path FROM tree
    UNION ALL SELECT policy_id, node, '', -1, '' FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.policy_id = n.policy_id AND t.node = n.node)""",
)
def p5_found(spark, folder):
    r = resolve_hierarchy(subsumption_edges(table(spark, folder, "kg_edges")), ["policy_id"])
    return r.select("policy_id", "node", "root", "depth", F.array_join("path_nodes", SEPARATOR).alias("path"))


@CORE.add(
    "p5_descendants",
    f"""WITH RECURSIVE {EDGES},
    down AS (SELECT policy_id, node AS ancestor, node AS descendant, 0 AS distance FROM tree
        UNION ALL SELECT d.policy_id, d.ancestor, l.c, d.distance + 1 FROM down d JOIN links l ON l.policy_id = d.policy_id AND l.p = d.descendant)
    SELECT policy_id, ancestor, descendant, distance::INT AS distance FROM down WHERE distance > 0""",
)
def p5_descendants(spark, folder):
    r = resolve_hierarchy(subsumption_edges(table(spark, folder, "kg_edges")), ["policy_id"])
    return descendants(r, ["policy_id"])
