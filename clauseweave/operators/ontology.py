"""The data ontology: terms, which of them are precise, and the extension of policy graphs with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Parent -> children of the data ontology.
DATA_TREE = {
    "personal information": ["personal identifier", "geolocation", "personal characteristic", "internet activity"],
    "identifier": ["device identifier", "personal identifier"],
    "device information": ["internet activity", "device identifier", "geolocation"],
    "device identifier": ["hardware identifier", "software identifier"],
    "hardware identifier": ["imei", "mac address", "serial number", "sim serial number"],
    "software identifier": ["advertising id", "android id", "router ssid", "gsf id", "cookie / pixel tag", "ip address"],
    "personal identifier": ["contact information", "ip address", "government identifier", "credit / debit card number"],
    "contact information": ["phone number", "email address", "postal address", "person name"],
    "government identifier": ["ssn", "passport number", "driver's license number"],
    "personal characteristic": ["biometric information", "protected classification"],
    "biometric information": ["fingerprint", "voiceprint"],
    "protected classification": ["gender", "race / ethnicity", "date of birth", "age"],
    "internet activity": ["browsing / search history", "package dump"],
    "geolocation": ["coarse geolocation", "precise geolocation"],
}
# Terms without links.
ISOLATED = ["non-personal information", "aggregate / deidentified / pseudonymized information", "anonymous identifier"]


def data_ontology(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(edges (parent, child), nodes (node, is_precise)): leaves with links are precise (GQ-24, SRC-04)."""
    edges = [(p, c) for p, cs in DATA_TREE.items() for c in cs]
    nodes = [(n, n not in DATA_TREE and n not in ISOLATED) for n in sorted({x for e in edges for x in e} | set(ISOLATED))]
    return spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame(nodes, "node string, is_precise boolean")


def extend_graph(edges: DataFrame, ont_edges: DataFrame, ont_nodes: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Edges with those of an ontology (GQ-17, GQ-18, OPT-05).

    Every policy gets the links between imprecise terms; a precise term is linked only where the policy
    has it, or where a probe (policy_id, node) asks for it and the policy has its parent. The ontology
    is small and constant, so it is broadcast against the policies.
    """
    e = edges.select("policy_id", "src", "dst", "key")
    have = e.select("policy_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    policies = e.select("policy_id").distinct()
    o = ont_edges.join(ont_nodes.select(F.col("node").alias("child"), "is_precise"), "child")
    wide = policies.crossJoin(F.broadcast(o.where("not is_precise").select(F.col("parent").alias("src"), F.col("child").alias("dst"))))
    fine = have.join(F.broadcast(o.where("is_precise").select(F.col("parent").alias("src"), F.col("child").alias("node"))), "node").select("policy_id", "src", F.col("node").alias("dst"))
    out = wide.unionByName(fine)
    if probes is not None:
        asked = probes.join(F.broadcast(ont_edges.select(F.col("parent").alias("src"), F.col("child").alias("node"))), "node")
        known = have.unionByName(policies.crossJoin(F.broadcast(ont_nodes.where("not is_precise").select("node")))).distinct()
        out = out.unionByName(asked.join(known.withColumnRenamed("node", "src"), ["policy_id", "src"], "left_semi").select("policy_id", "src", F.col("node").alias("dst")))
    return e.unionByName(out.withColumn("key", F.lit("SUBSUM"))).distinct()


def accept_unspecific(collects: DataFrame, datatypes: DataFrame, term: str = "UNSPECIFIED_DATA") -> DataFrame:
    """Collect edges to an unspecific term also count for every data type of the policy (GQ-19, GQ-20)."""
    wide = collects.where(F.col("dst") == term).drop("dst").join(datatypes.select("policy_id", F.col("node").alias("dst")), "policy_id")
    return collects.unionByName(wide.select(*collects.columns)).distinct()
