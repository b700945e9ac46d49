"""Trees, segments and contextual documents."""

from pyspark.sql import functions as F

from clauseweave.operators import segments as S
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import table

q = CORE.add
SEG = "seg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, segment_id ORDER BY loaded_at DESC, seg_uid DESC) AS rn FROM segments) WHERE rn = 1)"
CHAIN = "chain AS (SELECT policy_id, segment_id, segment_id AS ancestor_id, 0 AS ctx FROM seg UNION ALL SELECT c.policy_id, c.segment_id, s.parent_id, c.ctx + 1 FROM chain c JOIN seg s ON s.policy_id = c.policy_id AND s.segment_id = c.ancestor_id WHERE s.parent_id IS NOT NULL AND c.ctx < 64)"


def seg(spark, folder):
    return S.latest_segments(table(spark, folder, "segments"))


@q("tree_flatten", "SELECT DISTINCT page_id, node_id, parent_id, ordinal, role, name, level FROM a11y_nodes")
def tree_flatten(spark, folder):
    """SRC-01, D2: the JSON trees give the node table."""
    t = table(spark, folder, "a11y_tree").select("policy_id", "page_id", "tree").dropDuplicates(["page_id"])
    return S.flatten_trees(t).select("page_id", "node_id", "parent_id", "ordinal", "role", "name", "level")


@q("tree_debug_lines", "SELECT DISTINCT page_id, node_id, repeat('  ', len(path)) || role || coalesce(' ' || name, '') AS line FROM a11y_nodes")
def tree_debug_lines(spark, folder):
    """SNK-07."""
    return table(spark, folder, "a11y_nodes").select("page_id", "node_id", F.concat(F.expr("repeat('  ', size(path))"), "role", F.coalesce(F.concat(F.lit(" "), "name"), F.lit(""))).alias("line")).distinct()


@q("child_text_concat", """WITH n AS (SELECT DISTINCT page_id, node_id, parent_id, name FROM a11y_nodes), leaf AS (SELECT * FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.page_id = a.page_id AND b.parent_id = a.node_id) AND trim(coalesce(name, '')) <> '')
    SELECT page_id, parent_id, string_agg(trim(name), ' ' ORDER BY node_id) AS text FROM leaf WHERE parent_id IS NOT NULL GROUP BY ALL""")
def child_text_concat(spark, folder):
    """TXT-04, AGG-03."""
    n = table(spark, folder, "a11y_nodes").select("page_id", "node_id", "parent_id", "name").distinct()
    inner = n.where("parent_id is not null").select("page_id", F.col("parent_id").alias("node_id")).distinct()
    leaf = n.join(inner, ["page_id", "node_id"], "left_anti").where("trim(name) <> '' and parent_id is not null")
    return leaf.groupBy("page_id", "parent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", F.trim("name").alias("t")))), lambda x: x["t"]), " ").alias("text"))


@q("tree_segments")
def tree_segments(spark, folder):
    """SEG-01..08, SEG-15..17: the order-dependent walk; tested on hand-made trees."""
    return S.extract_segments(table(spark, folder, "a11y_nodes"))


@q("heading_parent", """WITH h AS (SELECT DISTINCT page_id, node_id, level FROM a11y_nodes WHERE role = 'heading' AND level IS NOT NULL)
    SELECT page_id, node_id, level, (SELECT max(b.node_id) FROM h b WHERE b.page_id = a.page_id AND b.node_id < a.node_id AND b.level < a.level) AS parent_node FROM h a""")
def heading_parent(spark, folder):
    """SEG-02."""
    return S.heading_parents(table(spark, folder, "a11y_nodes"))


@q("segment_context", f"WITH RECURSIVE {SEG}, {CHAIN} SELECT policy_id, segment_id, ancestor_id, ctx FROM chain")
def segment_context(spark, folder):
    """SEG-09."""
    return S.context_chain(seg(spark, folder))


@q("section_id", f"WITH RECURSIVE {SEG}, {CHAIN} SELECT c.policy_id, c.segment_id, coalesce(arg_min(c.ancestor_id, c.ctx) FILTER (WHERE s.segment_type = 'HEADING'), 0) AS section_id FROM chain c JOIN seg s ON s.policy_id = c.policy_id AND s.segment_id = c.ancestor_id GROUP BY ALL")
def section_id(spark, folder):
    """SEG-14."""
    s = seg(spark, folder)
    heads = s.select("policy_id", F.col("segment_id").alias("ancestor_id"), "segment_type")
    c = S.context_chain(s).join(heads, ["policy_id", "ancestor_id"])
    near = F.min(F.when(F.col("segment_type") == "HEADING", F.struct("ctx", "ancestor_id")))
    return c.groupBy("policy_id", "segment_id").agg(F.coalesce(near["ancestor_id"], F.lit(0)).alias("section_id"))


@q("widest_context", f"WITH RECURSIVE {SEG}, {CHAIN} SELECT c.policy_id, c.segment_id, max(c.ctx) AS ctx FROM chain c JOIN seg s ON s.policy_id = c.policy_id AND s.segment_id = c.ancestor_id AND s.segment_type <> 'LISTITEM' JOIN seg o ON o.policy_id = c.policy_id AND o.segment_id = c.segment_id AND o.segment_type <> 'LISTITEM' GROUP BY ALL")
def widest_context(spark, folder):
    """SEG-11..13."""
    s = seg(spark, folder)
    c = S.context_chain(s).join(s.where("segment_type <> 'LISTITEM'").select("policy_id", F.col("segment_id").alias("ancestor_id")), ["policy_id", "ancestor_id"], "left_semi")
    return c.join(s.where("segment_type <> 'LISTITEM'"), ["policy_id", "segment_id"], "left_semi").groupBy("policy_id", "segment_id").agg(F.max("ctx").alias("ctx"))


@q("context_docs", f"""WITH RECURSIVE {SEG}, {CHAIN}, full_ AS (SELECT c.policy_id, c.segment_id, c.ctx, s.segment_type AS t, s.tokens FROM chain c JOIN seg o ON o.policy_id = c.policy_id AND o.segment_id = c.segment_id AND o.segment_type <> 'LISTITEM' JOIN seg s ON s.policy_id = c.policy_id AND s.segment_id = c.ancestor_id),
    part AS (SELECT a.policy_id, a.segment_id, a.ctx AS top, b.ctx, b.t, b.tokens FROM full_ a JOIN full_ b ON b.policy_id = a.policy_id AND b.segment_id = a.segment_id AND b.ctx <= a.ctx WHERE a.t <> 'LISTITEM'),
    x AS (SELECT *, lag(t) OVER w AS prev, sum(len(tokens)) OVER (PARTITION BY policy_id, segment_id, top ORDER BY ctx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM part WINDOW w AS (PARTITION BY policy_id, segment_id, top ORDER BY ctx DESC))
    SELECT policy_id, segment_id, top AS ctx, sum(len(tokens))::BIGINT AS n_tokens, sum(CASE WHEN before > 0 AND prev = 'HEADING' THEN 2 ELSE 0 END)::BIGINT AS n_breaks FROM x GROUP BY ALL""")
def context_docs(spark, folder):
    """SEG-10, D5: the contextual documents, summed up by their tokens and line breaks."""
    d = S.context_documents(seg(spark, folder))
    breaks = F.size(F.filter("words", lambda w: w == "\n"))
    colons = F.col("n_glue") - breaks
    return d.select("policy_id", "segment_id", "ctx", (F.size("words") - breaks - colons).cast("bigint").alias("n_tokens"), breaks.cast("bigint").alias("n_breaks"))


@q("bullet_runs", r"""WITH b AS (SELECT policy_id, segment_id, CAST(regexp_extract(text, '^\W*(\d+)\W', 1) AS INT) AS n FROM (SELECT DISTINCT policy_id, segment_id, text FROM segments) WHERE regexp_matches(text, '^\W*\d+\W')),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY policy_id ORDER BY segment_id, n) AS island FROM b) SELECT policy_id, island::BIGINT AS island, min(segment_id) AS first_segment, count(*) AS run FROM g GROUP BY ALL""")
def bullet_runs(spark, folder):
    """SEG-07, SEG-08: runs of numbered texts as gaps and islands."""
    from pyspark.sql import Window

    b = table(spark, folder, "segments").select("policy_id", "segment_id", "text").distinct().where(F.col("text").rlike(r"^\W*\d+\W"))
    b = b.withColumn("n", F.regexp_extract("text", r"^\W*(\d+)\W", 1).cast("int"))
    g = b.withColumn("island", (F.col("n") - F.row_number().over(Window.partitionBy("policy_id").orderBy("segment_id", "n"))).cast("bigint"))
    return g.groupBy("policy_id", "island").agg(F.min("segment_id").alias("first_segment"), F.count("*").alias("run"))
