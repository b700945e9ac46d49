"""Readers and writers of policy graphs, ontologies and entity lists in their exchange formats."""

from __future__ import annotations

import io
import json
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

EDGES = "policy_id string, src string, dst string, key string, text array<string>, purposes array<struct<label:string,phrase:string>>"
FLOWS = "package_name string, app_name string, version_name string, version_code string, data_type string, dest_domain string, dest_ip string, arb_number string, privacy_policy string"
ENTITY = "aliases array<string>, domains array<string>, prevalence double, categories array<string>, ngrams map<string,boolean>"


def policy_of_path(path: Column) -> Column:
    """The folder that holds a file: the key of everything in it (D1, SRC-12); policy_id=x, as partitioned writers name it, is x."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -2)), "^policy_id=", "")


def read_yaml_graphs(spark: SparkSession, glob: str) -> DataFrame:
    """Edges of node-link YAML graphs, one file per policy folder (SRC-03). Unreadable files give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            out = []
            for p, content in zip(b["policy_id"], b["content"], strict=True):
                try:
                    g = yaml.safe_load(bytes(content)) or {}
                except yaml.YAMLError:
                    continue
                for e in g.get("links") or []:
                    said = [{"label": k, "phrase": x} for k, v in (e.get("purposes") or {}).items() for x in v]
                    out.append((p, e.get("source"), e.get("target"), e.get("key"), list(e.get("text") or []), said))
            yield pd.DataFrame(out, columns=["policy_id", "src", "dst", "key", "text", "purposes"])

    files = spark.read.format("binaryFile").load(glob).select(policy_of_path(F.col("path")).alias("policy_id"), "content")
    return files.mapInPandas(run, EDGES)


def ordered_links(edges: DataFrame) -> DataFrame:
    """Edges with their place in the written graph: by key, statements of "we" first, then by ends (SNK-02, SRT-01)."""
    w = Window.partitionBy("policy_id").orderBy("key", F.col("src") != "we", "src", "dst")
    return edges.withColumn("pos", F.row_number().over(w) - 1)


def yaml_links(edges: DataFrame) -> DataFrame:
    """(policy_id, yaml): each policy's links as a YAML list, one document per policy (SNK-02)."""
    quote = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    line = F.concat(F.lit("- {source: "), quote(F.col("src")), F.lit(", target: "), quote(F.col("dst")), F.lit(", key: "), F.col("key"), F.lit("}"))
    e = ordered_links(edges).withColumn("line", line)
    return e.groupBy("policy_id").agg(F.concat(F.lit("links:\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("yaml"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    """(policy_id, edge_id, xml): numbered GraphML edge elements (SNK-03)."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    e = ordered_links(edges).withColumn("edge_id", F.concat(F.lit("e"), F.col("pos")))
    xml = F.concat(F.lit('<edge id="'), F.col("edge_id"), F.lit('" source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"><data key="label">'), F.col("key"), F.lit("</data></edge>"))
    return e.select("policy_id", "edge_id", xml.alias("xml"))


def read_graphml_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges (parent, child), nodes (node, is_precise)) of a GraphML ontology, keyed by label (SRC-04).

    An ontology is a hand-made file of some dozen terms, so the driver reads it.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    root = ET.fromstring(text)
    tag = lambda e: e.tag.rpartition("}")[2]
    keys = {k.get("id"): k.get("attr.name") for k in root.iter() if tag(k) == "key"}
    label, precise = {}, {}
    for n in (x for x in root.iter() if tag(x) == "node"):
        data = {keys.get(d.get("key"), d.get("key")): "".join(d.itertext()).strip() for d in n if tag(d) == "data"}
        label[n.get("id")] = data.get("label") or n.get("id")
        precise[n.get("id")] = data.get("is_precise", "false").lower() == "true"
    edges = [(label[e.get("source")], label[e.get("target")]) for e in root.iter() if tag(e) == "edge"]
    return spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([(label[i], precise[i]) for i in label], "node string, is_precise boolean")


def read_entity_info(spark: SparkSession, path: str) -> DataFrame:
    """(entity, aliases, domains, prevalence, categories, ngrams) of a JSON map from entity to record (SRC-06, D15)."""
    raw = spark.read.text(path, wholetext=True).where("value <> ''").select(F.from_json("value", f"map<string,struct<{ENTITY.replace(' array', ':array').replace(' double', ':double').replace(' map', ':map')}>>").alias("m"))
    return raw.select(F.explode("m").alias("entity", "r")).select("entity", "r.*")


def write_entity_info(entities: DataFrame, path: str, per_file: int = 1000) -> None:
    """JSON maps from entity to record, about ``per_file`` entities to a file (SNK-06). Each entity must be there once."""
    n = max(1, -(-entities.count() // per_file))
    rest = [c for c in entities.columns if c != "entity"]
    g = entities.groupBy(F.pmod(F.xxhash64("entity"), F.lit(n)).alias("bucket")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("entity", F.struct(*rest))))).alias("value"))
    g.repartition(n, "bucket").write.partitionBy("bucket").text(path)


def write_graphml_ontology(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """An ontology as one GraphML file (SNK-03); it is some dozen terms, so the driver writes it."""
    spark = edges.sparkSession
    ids = {r.node: f"n{i}" for i, r in enumerate(nodes.orderBy("node").collect())}
    root = ET.Element("graphml")
    for k, name in (("d0", "label"), ("d1", "is_precise")):
        ET.SubElement(root, "key", {"id": k, "for": "node", "attr.name": name, "attr.type": "string"})
    graph = ET.SubElement(root, "graph", {"edgedefault": "directed"})
    for r in nodes.collect():
        n = ET.SubElement(graph, "node", {"id": ids[r.node]})
        ET.SubElement(n, "data", {"key": "d0"}).text = r.node
        ET.SubElement(n, "data", {"key": "d1"}).text = str(r.is_precise).lower()
    for r in edges.collect():
        ET.SubElement(graph, "edge", {"source": ids[r.parent], "target": ids[r.child]})
    spark.createDataFrame([(ET.tostring(root, encoding="unicode"),)], "value string").coalesce(1).write.text(path)


def write_rules(spark: SparkSession, rules: dict, path: str) -> None:
    """A rule file in YAML."""
    import yaml

    spark.createDataFrame([(yaml.safe_dump(rules, allow_unicode=True),)], "value string").coalesce(1).write.text(path)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow records of a CSV file without header (SRC-08, D16)."""
    return spark.read.schema(FLOWS).options(header=False, escape='"').csv(path)


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header and a declared schema (SRC-07)."""
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema (SRC-09, D20)."""
    return spark.read.schema(schema).json(path)


def read_zipped_jsonl(spark: SparkSession, glob: str, suffix: str = ".jsonl") -> DataFrame:
    """(archive, member, line) of the JSON lines inside zip archives (SRC-11)."""
    return unzip_jsonl(spark.read.format("binaryFile").load(glob).select(F.col("path").alias("archive"), "content"), suffix)


def zip_jsonl(lines: DataFrame, member: str = "lines.jsonl") -> DataFrame:
    """(archive, content): the lines (archive, line) of each archive as a zip file; an archive is one task's memory, so keep archives small."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(member, "\n".join(g["line"]) + "\n")
        return pd.DataFrame([(key[0], out.getvalue())], columns=["archive", "content"])

    return lines.groupBy("archive").applyInPandas(run, "archive string, content binary")


def unzip_jsonl(files: DataFrame, suffix: str = ".jsonl") -> DataFrame:
    """(archive, member, line) of the JSON lines inside zip files (archive, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    out += [(p, n, x.decode("utf-8").rstrip("\r\n")) for n in sorted(z.namelist()) if n.endswith(suffix) for x in z.open(n) if x.strip()]
            yield pd.DataFrame(out, columns=["archive", "member", "line"])

    return files.select(F.col("archive").alias("path"), "content").mapInPandas(run, "archive string, member string, line string")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """The rows of a query on a SQLite file that all workers can read (SRC-10)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with sqlite3.connect(f"file:{p}?mode=ro", uri=True) as c:
                    yield pd.read_sql_query(query, c)

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list without blanks and comments (SRC-16)."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and line not like '#%'")


def read_rules(spark: SparkSession, path: str) -> dict:
    """A YAML rule file, read on the driver (SRC-17, UDX-04, UDX-05)."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])


def write_partitioned(df: DataFrame, path: str, key: str = "policy_id", files: int = 200) -> None:
    """Parquet with the rows of a policy together (SNK-01, PHY-04)."""
    df.repartition(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV (SNK-04, SNK-05); quotes are doubled, spaces and line ends kept."""
    df.write.mode("overwrite").options(header=header, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines (SNK-06)."""
    df.write.mode("overwrite").json(path)


def route_url(url: Column) -> Column:
    """What kind of source a URL is: 'file', 'google_doc', 'web' or 'invalid' (SRC-14)."""
    u = F.lower(F.trim(url))
    return F.when(u.startswith("file:") | u.startswith("/"), "file").when(u.rlike(r"^https?://docs\.google\.com/document/"), "google_doc").when(u.rlike(r"^(https?://)?[^/\s]+\.[a-z]{2,}"), "web").otherwise("invalid")


def original_url(link_header: Column) -> Column:
    """The URL that a stored response names as its original (SRC-19)."""
    return F.regexp_extract(link_header, r'<([^>]+)>;\s*rel="original"', 1)


def to_json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON line."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def dumps(x) -> str:
    return json.dumps(x, ensure_ascii=False)
