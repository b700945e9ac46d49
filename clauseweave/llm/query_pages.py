"""Queries over pages: p1 (main text and boilerplate) and p3 (residue)."""

from pyspark.sql import functions as F

from clauseweave.llm.leaves import is_text, leaves_of
from clauseweave.llm.queries import LLM
from clauseweave.llm.residue import mark_residue
from clauseweave.llm.site_tree import judge_pages
from clauseweave.plans.session import table


def residue_leaves(nodes):
    """(page_id, node_id, residue) of the leaves that are residue.

    The automaton runs over the texts where they lie; only its few hits are shuffled, to drop
    repeated rows and nodes that have children.
    """
    hits = mark_residue(nodes.where(is_text(F.col("name"))).select("page_id", "node_id", "name")).where(F.col("residue").isNotNull())
    hits = hits.groupBy("page_id", "node_id").agg(F.min("residue").alias("residue"))
    parents = nodes.where(F.col("parent_id").isNotNull()).select("page_id", F.col("parent_id").alias("node_id"))
    return hits.join(parents, ["page_id", "node_id"], "left_anti")


@LLM.add("p3_found")
def p3_found(spark, folder):
    return residue_leaves(table(spark, folder, "a11y_nodes")).select("page_id", "node_id")


@LLM.add("p3_clean_leaves")
def p3_clean_leaves(spark, folder):
    """The leaves that remain: residue kept out."""
    leaves = mark_residue(leaves_of(table(spark, folder, "a11y_nodes")))
    return leaves.where(F.col("residue").isNull()).drop("residue")


@LLM.add("p1_found")
def p1_found(spark, folder):
    return judge_pages(table(spark, folder, "a11y_nodes"), residue_of="noise").where("noise and not residue").select("page_id", "node_id")


@LLM.add("p1_main_leaves")
def p1_main_leaves(spark, folder):
    """The text that remains of each page."""
    return judge_pages(table(spark, folder, "a11y_nodes"), residue_of="main").where("not noise and not residue").select("page_id", "node_id", "name", F.round("importance", 4).alias("importance"))
