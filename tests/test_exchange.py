import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from clauseweave.sources import graphs as X
from clauseweave.streaming import ingest as I


def test_formats(spark, tmp_path):
    d = tmp_path / "acme"
    d.mkdir()
    (d / "graph.yml").write_text("links:\n- {source: we, target: email address, key: COLLECT, text: [We collect.], purposes: {legal: [to comply]}}\n")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "graph.yml").write_text("links: [")
    g = X.read_yaml_graphs(spark, f"{tmp_path}/*/graph.yml").collect()
    assert [(r.policy_id, r.src, r.dst, r.key, r.text, r.purposes[0].label) for r in g] == [("acme", "we", "email address", "COLLECT", ["We collect."], "legal")]
    (tmp_path / "o.graphml").write_text('<graphml><key id="k" attr.name="label"/><key id="p" attr.name="is_precise"/><graph><node id="1"><data key="k">a</data></node><node id="2"><data key="k">b</data><data key="p">true</data></node><edge source="1" target="2"/></graph></graphml>')
    e, n = X.read_graphml_ontology(spark, str(tmp_path / "o.graphml"))
    assert [tuple(r) for r in e.collect()] == [("a", "b")] and {tuple(r) for r in n.collect()} == {("a", False), ("b", True)}
    (tmp_path / "entities.json").write_text(json.dumps({"acme": {"aliases": ["Acme"], "domains": ["acme.example"], "prevalence": 0.1, "categories": [], "ngrams": {"acme": True}}}))
    assert X.read_entity_info(spark, str(tmp_path / "entities.json")).first().aliases == ["Acme"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("u.jsonl", '{"a": 1}\n{"a": 2}\n')
    assert [r.line for r in X.read_zipped_jsonl(spark, f"{tmp_path}/z.zip").collect()] == ['{"a": 1}', '{"a": 2}']
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("CREATE TABLE t (a INT, b TEXT)")
        c.execute("INSERT INTO t VALUES (1, 'x')")
    assert tuple(X.read_sqlite(spark, str(tmp_path / "x.db"), "SELECT a, b FROM t", "a bigint, b string").first()) == (1, "x")
    (tmp_path / "list.txt").write_text("# no\n\n a \nb\n")
    assert [r.line for r in X.read_lines(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    (tmp_path / "flows.csv").write_text("com.x,X,1,2,imei,a.example,1.2.3.4,0,http://p.example\n")
    assert X.read_flows(spark, str(tmp_path / "flows.csv")).first().data_type == "imei"
    df = spark.createDataFrame([("p", "we", "a & b", "USE")], "policy_id string, src string, dst string, key string")
    assert "a &amp; b" in X.graphml_edges(df).first().xml and "we" in X.yaml_links(df).first().yaml
    for write, read in ((X.write_csv, lambda p: X.read_table_csv(spark, p, "policy_id string, src string, dst string, key string")), (X.write_jsonl, lambda p: X.read_jsonl(spark, p, "policy_id string, src string, dst string, key string")), (X.write_partitioned, spark.read.parquet)):
        write(df, str(tmp_path / write.__name__))
        assert {tuple(r[c] for c in df.columns) for r in read(str(tmp_path / write.__name__)).collect()} == {tuple(df.first())}
    u = spark.createDataFrame([("file:///x",), ("https://docs.google.com/document/d/1",), ("acme.example/p",), ("??",)], "u string")
    assert [r[0] for r in u.select(X.route_url(F.col("u"))).collect()] == ["file", "google_doc", "web", "invalid"]


def test_streams(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    s = I.read_stream(spark, str(tmp_path / "in"), src.schema, 1)
    q = I.ingest(s, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == src.count()
    t = I.tumbling_counts(I.read_stream(spark, str(tmp_path / "in"), src.schema), late="60 days")
    w = t.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == src.count()
    assert I.sessions(s).isStreaming and I.deduplicate(s, "event_id", "ts", "1 hour").isStreaming
