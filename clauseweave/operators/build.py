"""Policy graphs from annotated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clauseweave.operators import graph as G, normalize as N, segments as S
from clauseweave.operators.sentences import annotate_documents, annotate_tokens
from clauseweave.plans.session import cut, stash

VARIANTS = ("original", "extended", "per_sentence", "per_section")
KEY = ["policy_id", "src", "dst"]


def main_mentions(coref: DataFrame, rounds: int = 40) -> DataFrame:
    """(src, main): mentions with one antecedent, followed to the end of their chain by pointer jumping (BLD-06).

    Columns beside src and dst name what mentions are told apart by, such as their policy.
    """
    by = [c for c in coref.columns if c not in ("src", "dst")]
    cur = coref.select(*by, "src", F.col("dst").alias("main"))
    for _ in range(min(rounds, coref.count().bit_length() + 1)):
        up = cur.select(*by, F.col("src").alias("main"), F.col("main").alias("next"))
        new = cut(cur.join(up, [*by, "main"], "left").select(*by, "src", F.coalesce("next", "main").alias("main"), F.col("next").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            break
        cur = new.drop("moved")
    return cur.select(*by, "src", "main")


def spread(links: DataFrame, items: DataFrame, heads: DataFrame) -> DataFrame:
    """``links`` (policy_id, src, dst, rel, s_from, s_to) with what lists add (ANN-21..23).

    A link between an item of a list and something else holds for all its items; a head such as "the
    following data" stands above all items; a lone noun phrase over a list does so if nothing else links
    the list's items. items: policy_id, list_id, node; heads: policy_id, list_id, node, rel, s_from, s_to.
    """
    a = items.select("policy_id", "list_id", F.col("node").alias("src"))
    b = items.select("policy_id", "list_id", F.col("node").alias("dst"))
    own = links.join(a.withColumnRenamed("list_id", "l1"), ["policy_id", "src"], "left").join(b.withColumnRenamed("list_id", "l2"), ["policy_id", "dst"], "left")
    own = own.where("(l1 is null) <> (l2 is null)")
    cols = ["policy_id", "src", "dst", "rel", "s_from", "s_to"]
    at_src = own.where("l1 is not null").select("policy_id", F.col("l1").alias("list_id"), "dst", "rel", "s_from", "s_to").distinct().join(a, ["policy_id", "list_id"]).select(*cols)
    at_dst = own.where("l2 is not null").select("policy_id", F.col("l2").alias("list_id"), "src", "rel", "s_from", "s_to").distinct().join(b, ["policy_id", "list_id"]).select(*cols)
    linked = own.select("policy_id", F.coalesce("l1", "l2").alias("list_id")).distinct()
    over = heads.where("rel = 'following'").unionByName(heads.where("rel = 'heading'").join(linked, ["policy_id", "list_id"], "left_anti"))
    over = over.select("policy_id", "list_id", F.col("node").alias("src"), F.lit("SUBSUM").alias("rel"), "s_from", "s_to").distinct().join(b, ["policy_id", "list_id"]).select(*cols)
    return links.select(*cols).unionByName(at_src).unionByName(at_dst).unionByName(over).where("src <> dst").distinct()


def node_kinds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(policy_id, node, type): ACTOR or DATA by entity, else by the first statement, else by what SUBSUM and COREF tie to it (BLD-01, BLD-02, BLD-04).

    Types spread link by link; where two meet, the nearer one counts, ACTOR before DATA at equal distance.
    """
    known = nodes.where("type in ('ACTOR', 'DATA')").select("policy_id", "node", "type")
    said = links.where("rel not in ('SUBSUM', 'COREF')")
    ends = said.select("policy_id", F.col("src").alias("node"), F.struct("src", "dst", F.lit("ACTOR").alias("type")).alias("r")).unionByName(said.select("policy_id", F.col("dst").alias("node"), F.struct("src", "dst", F.lit("DATA").alias("type")).alias("r")))
    first = ends.groupBy("policy_id", "node").agg(F.min("r").alias("r")).select("policy_id", "node", F.col("r.type").alias("type"))
    known = cut(known.unionByName(first.join(known, ["policy_id", "node"], "left_anti")))
    ties = links.where("rel in ('SUBSUM', 'COREF')")
    ties = cut(ties.select("policy_id", "src", "dst").unionByName(ties.select("policy_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    edge = known
    while True:
        near = ties.join(edge.select("policy_id", F.col("node").alias("src"), "type"), ["policy_id", "src"]).groupBy("policy_id", F.col("dst").alias("node")).agg(F.min("type").alias("type"))
        edge = cut(near.join(known, ["policy_id", "node"], "left_anti"))
        if not edge.limit(1).count():
            return known
        known = cut(known.unionByName(edge))


def terms_of(nodes: DataFrame, entities: DataFrame | None) -> DataFrame:
    """(policy_id, node, terms ARRAY): the terms of each typed node by rules and entity names (BLD-10, NRM-06). Phrases are looked up once each.

    nodes: policy_id, node, type, ent (its type by entity), phrase, lemma, stem, proper.
    """
    what = ["type", "phrase", "lemma", "stem", "falls", "proper"]
    n = nodes.withColumn("falls", F.coalesce(F.col("type") == F.col("ent"), F.lit(False)))
    p = n.select(*what).distinct()
    if entities is not None:
        names = p.where("type = 'ACTOR' and proper").select(F.col("phrase").alias("name"))
        firm = N.match_entities(names, entities).groupBy(F.col("name").alias("phrase")).agg(F.collect_set("entity").alias("firms"))
        p = p.join(firm, "phrase", "left")
        p = p.withColumn("firms", F.when(F.col("proper") & (F.col("type") == "ACTOR"), F.col("firms")))
    else:
        p = p.withColumn("firms", F.lit(None).cast("array<string>"))
    c = F.col
    rules = F.when(c("type") == "DATA", N.phrase_terms(c("phrase"), c("lemma"), c("stem"), "DATA", c("falls"))).otherwise(N.phrase_terms(c("phrase"), c("lemma"), c("stem"), "ACTOR", c("falls") & c("firms").isNull()))
    p = cut(p.select(*what, F.array_distinct(F.concat(F.coalesce("firms", F.array().cast("array<string>")), rules)).alias("terms")))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"p.{k}")) for k in what]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return n.alias("n").join(p.alias("p"), on).select("n.policy_id", "n.node", "p.terms")


def bridge(edges: DataFrame, nameless: DataFrame) -> DataFrame:
    """``edges`` (policy_id, src, dst) without the ``nameless`` nodes (policy_id, node), what stands above each tied to what stands below (BLD-12).

    Chains of nameless nodes are followed by their closure, so they go at once.
    """
    inner = lambda c: nameless.select("policy_id", F.col("node").alias(c))
    both = edges.join(inner("src"), ["policy_id", "src"], "left_semi").join(inner("dst"), ["policy_id", "dst"], "left_semi")
    way = G.closure(both).select(*KEY).unionByName(nameless.select("policy_id", F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()
    into = edges.join(inner("src"), ["policy_id", "src"], "left_anti").join(inner("dst"), ["policy_id", "dst"], "left_semi")
    out = edges.join(inner("src"), ["policy_id", "src"], "left_semi").join(inner("dst"), ["policy_id", "dst"], "left_anti")
    over = into.withColumnRenamed("dst", "m").join(way.select("policy_id", F.col("src").alias("m"), F.col("dst").alias("n")), ["policy_id", "m"]).join(out.withColumnRenamed("src", "n"), ["policy_id", "n"]).select(*KEY)
    kept = edges.join(inner("src"), ["policy_id", "src"], "left_anti").join(inner("dst"), ["policy_id", "dst"], "left_anti")
    return kept.select(*KEY).unionByName(over).where("src <> dst").distinct()


def graph_of(rows: DataFrame, variant: str = "original", entities: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """(policy_id, src, dst, key, text, purposes) of all policies from the rows of ``annotate_documents`` (BLD-01..17).

    Mentions are typed, anaphors contracted into their main mention, SUBSUM edges kept free of loops and
    reduced, collect edges that a wider one implies pruned, phrases normalised, nameless phrases bridged, and
    what has the same terms merged with its evidence and purposes. Variants: 'original' keeps positive edges,
    all as COLLECT; 'extended' keeps every key and marks data of children; 'per_sentence' and 'per_section'
    add the place to each term, so that statements of different places don't merge.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    nodes = rows.where("kind = 'node'").groupBy("policy_id", F.col("a").alias("node")).agg(F.min(F.struct(F.when(F.col("rel") == "NN", 1).otherwise(0).alias("o"), "rel", "phrase", "lemma", "stem", "flag")).alias("r"))
    nodes = cut(nodes.select("policy_id", "node", F.col("r.rel").alias("type"), "r.phrase", "r.lemma", "r.stem", F.col("r.flag").alias("proper")))
    links = rows.where("kind = 'link'").select("policy_id", F.col("a").alias("src"), F.col("b").alias("dst"), "rel", "s_from", "s_to").distinct()
    items = rows.where("kind = 'item' and flag").select("policy_id", F.col("b").alias("item"), F.col("a").alias("node")).distinct()
    lists = sections.select("policy_id", F.col("segment_id").alias("item"), F.col("parent_id").alias("list_id")).where("list_id is not null").distinct() if sections is not None else items.select("policy_id", "item", F.col("item").alias("list_id"))
    heads = rows.where("kind = 'head'").select("policy_id", F.col("b").alias("item"), F.col("a").alias("node"), "rel", "s_from", "s_to").join(lists, ["policy_id", "item"]).drop("item").distinct()
    links = cut(spread(links, items.join(lists, ["policy_id", "item"]).drop("item"), heads))
    types = cut(node_kinds(nodes, links))
    t1, t2 = (types.select("policy_id", F.col("node").alias(c), F.col("type").alias(f"{c}_type")) for c in ("src", "dst"))
    typed = links.join(t1, ["policy_id", "src"]).join(t2, ["policy_id", "dst"])
    stated = typed.where("rel not in ('SUBSUM', 'COREF') and src_type = 'ACTOR' and dst_type = 'DATA'").drop("src_type", "dst_type")
    if variant != "extended":
        stated = stated.where(~F.col("rel").startswith("NOT_")).withColumn("rel", F.lit("COLLECT"))
    tied = typed.where("rel in ('SUBSUM', 'COREF') and src_type = dst_type").drop("src_type", "dst_type")

    # anaphors go into their main mention; those with several antecedents stand above them
    coref = tied.where("rel = 'COREF' and src > dst").select(*KEY).distinct()  # anaphors look back, so there are no loops
    if variant == "per_sentence":
        one, several = coref.limit(0), coref.limit(0)
    else:
        w = Window.partitionBy("policy_id", "src")
        counted = coref.withColumn("n", F.count("*").over(w))
        one, several = counted.where("n = 1").drop("n"), counted.where("n > 1").drop("n")
    main = cut(main_mentions(one.select("policy_id", "src", "dst")))

    def contracted(e: DataFrame) -> DataFrame:
        for c in ("src", "dst"):
            e = e.join(main.select("policy_id", F.col("src").alias(c), F.col("main").alias("_m")), ["policy_id", c], "left").withColumn(c, F.coalesce("_m", c)).drop("_m")
        return e.where("src <> dst")

    proof = tied.where("rel = 'SUBSUM'").select(*KEY, "s_from", "s_to").unionByName(several.join(tied, KEY).select(*KEY, "s_from", "s_to"))
    proof = cut(contracted(proof).distinct())
    stated = cut(contracted(stated).distinct())
    sub, reach = G.dag_with_reach(proof)
    sub = cut(G.transitive_reduction(sub, reach))

    # purposes, and collect edges that a wider one implies
    told = rows.where("kind = 'purpose'").select("policy_id", F.col("a").alias("dst"), "phrase").distinct()
    labels = told.select("phrase").distinct().withColumn("label", F.explode(N.classify_purpose(F.col("phrase"))))
    told = told.join(labels, "phrase").join(main.select("policy_id", F.col("src").alias("dst"), "main"), ["policy_id", "dst"], "left").select("policy_id", F.coalesce("main", "dst").alias("dst"), F.concat_ws("=", "label", "phrase").alias("p")).distinct()
    aims = cut(told.groupBy("policy_id", "dst").agg(F.array_sort(F.collect_set("p")).alias("aims")))
    none = F.array().cast("array<string>")
    flat = cut(stated.select(*KEY, "rel").distinct().join(aims, ["policy_id", "dst"], "left").select(*KEY, "rel", F.coalesce("aims", none).alias("aims")))
    wide = reach.select("policy_id", F.col("src").alias("w"), F.col("dst").alias("d"))
    a = flat.select("policy_id", "src", "rel", F.col("dst").alias("w"), F.col("aims").alias("more"))
    data = flat.withColumnRenamed("dst", "d").join(wide, ["policy_id", "d"]).join(a, ["policy_id", "src", "rel", "w"]).where("size(array_except(aims, more)) = 0").select("policy_id", "src", F.col("d").alias("dst"), "rel")
    b = flat.select("policy_id", "dst", "rel", F.col("src").alias("w"), F.col("aims").alias("more"))
    actor = flat.withColumnRenamed("src", "d").join(wide, ["policy_id", "d"]).join(b, ["policy_id", "dst", "rel", "w"]).where("size(array_except(aims, more)) = 0").select("policy_id", F.col("d").alias("src"), "dst", "rel")
    flat = flat.join(data.unionByName(actor).distinct(), [*KEY, "rel"], "left_anti")

    # terms
    subject = rows.where("kind = 'subject'").select("policy_id", F.col("a").alias("node"), "phrase").groupBy("policy_id", "node").agg(F.min("phrase").alias("subject"))
    n = nodes.withColumnRenamed("type", "ent").join(types, ["policy_id", "node"])
    degree = G.degrees(sub)
    n = n.join(terms_of(n, entities), ["policy_id", "node"]).join(degree, ["policy_id", "node"], "left").join(subject, ["policy_id", "node"], "left").fillna(0, ["in_degree", "out_degree"])
    lone = (F.size("terms") == 1) & (F.col("terms")[0] == "UNSPECIFIED") & (F.col("in_degree") + F.col("out_degree") == 0)
    n = n.withColumn("terms", F.when(lone, F.array(F.concat(F.lit("UNSPECIFIED_"), "type"))).otherwise(F.array_remove("terms", "UNSPECIFIED")))
    segment = F.shiftright("node", 32)
    if variant == "per_section" and sections is not None:
        n = n.withColumn("_seg", segment).join(sections.select("policy_id", F.col("segment_id").alias("_seg"), F.when(F.col("segment_type") == "HEADING", F.col("segment_id")).otherwise(F.coalesce("parent_id", F.lit(0))).alias("_sec")), ["policy_id", "_seg"], "left")
    mark = {"extended": F.when((F.col("type") == "DATA") & F.col("subject").isNotNull(), F.concat(F.lit(" @"), "subject")), "per_sentence": F.concat(F.lit(" ("), segment, F.lit(", "), F.col("node") - F.shiftleft(segment, 32), F.lit(")")), "per_section": F.concat(F.lit(" ("), F.coalesce(F.col("_sec").cast("string") if variant == "per_section" and sections is not None else segment.cast("string"), F.lit("0")), F.lit(", 0)"))}.get(variant)
    if mark is not None:
        n = n.withColumn("_mark", F.coalesce(mark, F.lit(""))).withColumn("terms", F.transform("terms", lambda x: F.concat(x, F.col("_mark"))))
    n = cut(n.select("policy_id", "node", "type", "terms", "out_degree"))
    nameless = cut(n.where("size(terms) = 0 and out_degree > 0").select("policy_id", "node"))
    if nameless.limit(1).count():
        down = sub.join(nameless.withColumnRenamed("node", "src"), ["policy_id", "src"], "left_semi")
        low = G.closure(down).join(nameless.withColumnRenamed("node", "dst"), ["policy_id", "dst"], "left_anti").select(*KEY)
        by_data = flat.withColumnRenamed("dst", "m").join(low.withColumnRenamed("src", "m"), ["policy_id", "m"]).select(*KEY, "rel", "aims")
        by_actor = flat.withColumnRenamed("src", "m").join(low.withColumnsRenamed({"src": "m", "dst": "src"}), ["policy_id", "m"]).select(*KEY, "rel", "aims")
        flat = flat.unionByName(by_data).unionByName(by_actor)
        sub = G.without_closing_edges(bridge(sub, nameless))
    names = n.select("policy_id", "node", "type", F.explode("terms").alias("term"))

    def named(e: DataFrame) -> DataFrame:
        for c in ("src", "dst"):
            e = e.join(names.select("policy_id", F.col("node").alias(c), F.col("type").alias(f"{c}_type"), F.col("term").alias(f"{c}_t")), ["policy_id", c])
        return e.withColumnsRenamed({"src": "a", "dst": "b", "src_t": "src", "dst_t": "dst"}).where("src <> dst")

    sub = named(sub).where("src_type = dst_type and dst <> 'we'")
    order = sub.groupBy(*KEY).agg(F.min(F.struct("a", "b")).alias("at"))
    sub = sub.join(G.without_closing_edges(order, ["at", "src", "dst"]), KEY, "left_semi").select(*KEY, F.lit("SUBSUM").alias("key"), "a", "b", F.lit(None).cast("array<string>").alias("aims"))
    flat = named(flat).where("src_type = 'ACTOR' and dst_type = 'DATA'").select(*KEY, F.col("rel").alias("key"), "a", "b", "aims")
    edges = cut(sub.unionByName(flat))

    # evidence: the sentences of the mentions that an edge stands for
    spans = proof.select("policy_id", F.col("src").alias("a"), F.col("dst").alias("b"), "s_from", "s_to").unionByName(stated.select("policy_id", F.col("src").alias("a"), F.col("dst").alias("b"), "s_from", "s_to")).distinct()
    own = rows.where("kind = 'node'").select("policy_id", F.col("a").alias("m"), "s_from", "s_to").groupBy("policy_id", "m").agg(F.min(F.struct("s_from", "s_to")).alias("s")).select("policy_id", "m", "s.*")
    ref = edges.select("policy_id", "src", "dst", "key", "a", "b").join(spans, ["policy_id", "a", "b"], "left")
    lost = ref.where("s_from is null").select("policy_id", "src", "dst", "key", F.explode(F.array("a", "b")).alias("m")).join(own, ["policy_id", "m"]).select("policy_id", "src", "dst", "key", "s_from", "s_to")
    ref = ref.where("s_from is not null").select("policy_id", "src", "dst", "key", "s_from", "s_to").unionByName(lost).distinct()
    said = rows.where("kind = 'sentence'").groupBy("policy_id", "s_from", "s_to").agg(F.min("phrase").alias("sentence"))
    text = ref.join(said, ["policy_id", "s_from", "s_to"]).groupBy(*KEY, "key").agg(F.array_sort(F.collect_set("sentence")).alias("text"))
    aim = edges.where("aims is not null").select(*KEY, "key", F.explode("aims").alias("p")).groupBy(*KEY, "key").agg(F.array_join(F.array_sort(F.collect_set("p")), ";").alias("purposes"))
    out = edges.select(*KEY, "key").distinct().join(text, [*KEY, "key"], "left").join(aim, [*KEY, "key"], "left")
    return out.select(*KEY, "key", F.array_join(G.keep_longest_sentences(F.coalesce("text", none)), "|").alias("text"), F.coalesce("purposes", F.lit("")).alias("purposes"))


def build_graph(tokens: DataFrame, variant: str = "original", disable: tuple[str, ...] = (), entities: DataFrame | None = None) -> DataFrame:
    """The policy graphs of a token table of any parser; see ``graph_of``."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    return graph_of(stash(annotate_tokens(tokens, disable)), variant, entities)


def build_from_segments(segments: DataFrame, variant: str = "original", disable: tuple[str, ...] = (), entities: DataFrame | None = None) -> DataFrame:
    """The policy graphs of segments: contextual documents, one annotation pass, graphs (BLD-01..19)."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    rows = stash(annotate_documents(S.annotation_documents(segments), disable))
    return graph_of(rows, variant, entities, segments)
