"""Exchange formats and streams as queries."""

from pyspark.sql import functions as F

from clauseweave.plans.registry import CORE
from clauseweave.plans.session import table
from clauseweave.queries.graphs import edges
from clauseweave.queries.sqlparts import KG
from clauseweave.sources import graphs as X

q = CORE.add
POS = "ord AS (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY key, src <> 'we', src, dst) - 1 AS pos FROM kg)"


@q("ordered_links", f"WITH {KG}, {POS} SELECT policy_id, src, dst, key, pos::INT AS pos FROM ord")
def ordered_links(spark, folder):
    """SNK-02, SRT-01."""
    return X.ordered_links(edges(spark, folder))


@q("yaml_links", f"WITH {KG}, {POS} SELECT policy_id, 'links:' || chr(10) || string_agg('- {{source: \"' || src || '\", target: \"' || dst || '\", key: ' || key || '}}', chr(10) ORDER BY pos) AS yaml FROM ord GROUP BY policy_id")
def yaml_links(spark, folder):
    """SNK-02, SNK-06, GRA-10."""
    return X.yaml_links(edges(spark, folder))


@q("graphml_edges", f"WITH {KG}, {POS} SELECT policy_id, 'e' || pos AS edge_id, '<edge id=\"e' || pos || '\" source=\"' || src || '\" target=\"' || dst || '\"><data key=\"label\">' || key || '</data></edge>' AS xml FROM ord")
def graphml_edges(spark, folder):
    """SNK-03."""
    return X.graphml_edges(edges(spark, folder))


@q("url_routes", r"SELECT DISTINCT permalink, CASE WHEN starts_with(u, 'file:') OR starts_with(u, '/') THEN 'file' WHEN regexp_matches(u, '^https?://docs\.google\.com/document/') THEN 'google_doc' WHEN regexp_matches(u, '^(https?://)?[^/\s]+\.[a-z]{2,}') THEN 'web' ELSE 'invalid' END AS kind FROM (SELECT permalink, lower(trim(homepage_url)) AS u FROM companies WHERE homepage_url IS NOT NULL)")
def url_routes(spark, folder):
    """SRC-14."""
    return table(spark, folder, "companies").where("homepage_url is not null").select("permalink", X.route_url(F.col("homepage_url")).alias("kind")).distinct()


@q("kg_nodes_json", f"WITH {KG} SELECT policy_id, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM kg GROUP BY policy_id")
def kg_nodes_json(spark, folder):
    """SNK-01: per-policy sizes of the stored graphs."""
    return edges(spark, folder).groupBy("policy_id").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
