"""Accessibility trees to segments, and segments to contextual documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from clauseweave.functions.text import OTHER_SCRIPTS, fold_ascii, tokenizer_fixups
from clauseweave.operators.graph import closure

# Roles whose content is no text of the page.
IGNORED = """img, figure, image map, separator, whitespace, form, radio, list item marker, insertion, diagram, dialog, tab, checkbox, menu, menubar, menuitem, parent menuitem, toolbar, tooltip,
internal frame, listbox, progressbar, spinbutton, switch, details, summary, alert, status, mark, note, button, buttonmenu, slider, textbox, deletion, combobox, combobox list, combobox option,
gridcell, option, application, canvas, caption, toggle button, password text, definition, definitionlist, term, tree, treeitem, treegrid"""
# Roles that hold further blocks.
SECTIONS = "document, article, landmark, section, blockquote, group, tablist, tabpanel, region, table, row, rowgroup"
# Roles whose text is one block.
CONTAINERS = "paragraph, text, link, statictext, label, text container, text leaf, superscript, subscript, cell, columnheader, rowheader"
ROLE_CLASS = {r.strip(): k for k, names in (("skip", IGNORED), ("section", SECTIONS), ("block", CONTAINERS)) for r in names.split(",")} | {"heading": "heading", "list": "list", "listitem": "item"}

NODES = "policy_id string, page_id bigint, node_id int, parent_id int, ordinal int, path array<int>, role string, name string, level int"
SEGMENTS = "policy_id string, page_id bigint, segment_id int, segment_type string, parent_id int, text string"


def flatten_tree(tree: str | None) -> list[tuple]:
    """(node_id, parent_id, ordinal, path, role, name, level) of a JSON tree in pre-order; [] for null or broken JSON."""
    try:
        root = json.loads(tree) if tree else None
    except ValueError:
        return []
    out, todo = [], [(root, None, 0, [])] if isinstance(root, dict) else []
    while todo:
        node, parent, ordinal, path = todo.pop()
        me = len(out)
        out.append((me, parent, ordinal, path, node.get("role"), node.get("name"), node.get("level")))
        todo += [(c, me, i, [*path, i]) for i, c in reversed(list(enumerate(node.get("children") or []))) if isinstance(c, dict)]
    return out


def flatten_trees(pages: DataFrame) -> DataFrame:
    """One row per node of each page's tree (SRC-01, D2). pages: policy_id, page_id, tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, g, *n) for p, g, t in zip(b["policy_id"], b["page_id"], b["tree"], strict=True) for n in flatten_tree(t)]
            d = pd.DataFrame(rows, columns=["policy_id", "page_id", "node_id", "parent_id", "ordinal", "path", "role", "name", "level"])
            yield d.astype({"parent_id": "Int32", "level": "Int32"})

    return pages.select("policy_id", "page_id", "tree").mapInPandas(run, NODES)


class Page:
    """One tree as arrays in pre-order, with what the walk over it has found so far."""

    def __init__(self, roles: list[str], names: list[str | None], levels: list[int | None], parents: list[int], strict: bool = True) -> None:
        self.strict = strict
        self.roles = [r or "" for r in roles]
        self.kind = [ROLE_CLASS.get(r, "unknown") for r in self.roles]
        self.names, self.levels = names, levels
        self.kids: list[list[int]] = [[] for _ in roles]
        self.up = parents
        for i, p in enumerate(parents):
            if p >= 0:
                self.kids[p].append(i)
        self.found: list[list] = []  # type, parent, text, the block that holds it
        self.open: list[tuple[int, int]] = []  # segment, level of the headings in force

    def words(self, *nodes: int) -> str:
        """Texts of the leaves below nodes, in order, without ignored ones (TXT-04)."""
        out, todo = [], list(reversed(nodes))
        while todo:
            i = todo.pop()
            if self.kind[i] == "skip":
                continue
            if self.kids[i]:
                todo += reversed(self.kids[i])
            else:
                out.append((self.names[i] or "").strip())
        return " ".join(x for x in out if x)

    def add(self, sort: str, text: str, parent: int | None, home: int) -> int:
        self.found.append([sort, parent, text, home])
        return len(self.found) - 1

    @property
    def heading(self) -> int | None:
        return self.open[-1][0] if self.open else None

    def items(self, lst: int) -> list[list[int]]:
        """Contents of the items of a list; stray children are items of their own, nested items are lifted (SEG-04)."""
        out, todo = [], list(reversed(self.kids[lst]))
        while todo:
            c = todo.pop()
            if self.kind[c] == "item" or not self.kids[c]:
                out.append(self.kids[c] or [c])
            else:
                todo += reversed(self.kids[c])
        return out

    def walk(self, i: int) -> None:
        """Visits the tree below ``i``; steps wait on a stack of their own, so depth is no limit."""
        steps = [self.visit(i)]
        while steps:
            below = next(steps[-1], None)
            if below is None:
                steps.pop()
            else:
                steps.append(below)

    def visit(self, i: int) -> Iterator[Iterator]:
        """Handles a node and yields the steps for what lies below it."""
        k = self.kind[i]
        if k == "unknown" and not self.strict:
            k = "section" if self.kids[i] else "block"
        if k == "section" or k == "item":
            for c in self.kids[i]:
                yield self.visit(c)
        elif k == "heading":
            level = self.levels[i] or 1
            while self.open and self.open[-1][1] >= level:
                self.open.pop()
            self.open.append((self.add("HEADING", self.words(i), self.heading, self.up[i]), level))
        elif k == "list":
            beside = bool(self.found) and self.found[-1][3] == self.up[i]
            parent = len(self.found) - 1 if beside else self.heading
            for content in self.items(i):
                yield self.item(content, parent, i)
        elif k == "block" and (text := self.words(i)):
            self.add("TEXT", text, self.heading, self.up[i])
        elif k == "unknown":
            raise ValueError(f"unknown role {self.roles[i]!r}")

    def item(self, content: list[int], parent: int | None, home: int) -> Iterator[Iterator]:
        """Inline runs of an item become TEXT below one LISTITEM, made when the first text comes (SEG-05)."""
        item, run = None, []
        for c in [*content, None]:
            block = c is None or self.kind[c] in ("section", "list")
            if not block:
                run.append(c)
                continue
            if text := self.words(*run):
                item = self.add("LISTITEM", "", parent, home) if item is None else item
                self.add("TEXT", text, item, home)
                run = []
            if c is not None:
                yield self.visit(c)


BULLET = re.compile(r"^([*>#-])|^(\W*)(\d+)(\W)|^(\W*)([a-z])(\W)|^(\W*)([A-Z])(\W)")


def bullet(text: str) -> tuple[str, int, str] | None:
    """(style, number, the bullet itself) of a text that begins with one (SEG-08)."""
    m = BULLET.match(text)
    if not m:
        return None
    if m[1]:
        return f"mark {m[1]}", 0, m[1]
    if m[3]:
        return f"digit {m[2]}|{m[4]}", int(m[3]), m[0]
    if m[6]:
        return f"lower {m[5]}|{m[7]}", ord(m[6]) - 96, m[0]
    return f"upper {m[8]}|{m[10]}", ord(m[9]) - 64, m[0]


def typed_lists(found: list[list]) -> list[list]:
    """Runs of bulleted TEXT after a text that ends with a colon become list items (SEG-07).

    found: rows (type, parent, text). A run has one parent and counts on from 1; of one text only it
    stays as it is, as does the first row.
    """
    out: list[list] = []
    where: dict[int, int] = {}
    i = 0
    while i < len(found):
        b = bullet(found[i][2]) if i and found[i][0] == "TEXT" else None
        n = 0
        if b and b[1] in (0, 1) and found[i - 1][0] in ("TEXT", "HEADING") and found[i - 1][2].endswith(":"):
            while i + n < len(found) and found[i + n][0] == "TEXT" and found[i + n][1] == found[i][1]:
                c = bullet(found[i + n][2])
                if not c or c[0] != b[0] or (c[1] and c[1] != n + 1):
                    break
                n += 1
        if n > 1:
            anchor = where[i - 1]
            for j in range(i, i + n):
                text = found[j][2]
                out.append(["LISTITEM", anchor, ""])
                where[j] = len(out)
                out.append(["TEXT", len(out) - 1, text[len(bullet(text)[2]) :].strip() or text])
            i += n
        else:
            where[i] = len(out)
            p = found[i][1]
            out.append([found[i][0], where[p] if p is not None else None, found[i][2]])
            i += 1
    return out


def segments_of(roles, names, levels, parents, strict: bool = True) -> list[list]:
    """(type, parent, text) of the segments of one tree in order.

    A role of no class is an error; if not ``strict``, it is a section if it has children, else a block.
    """
    page = Page(roles, names, levels, parents, strict)
    if page.roles:
        page.walk(0)
    return typed_lists([f[:3] for f in page.found])


def extract_segments(nodes: DataFrame) -> DataFrame:
    """Segments of each page (SEG-01..08, SEG-15, SEG-16). nodes: policy_id, page_id, node_id, parent_id, role, name, level.

    Text is folded to ASCII and its spelling fixed beforehand, and a leaf in another script is blank,
    all in the JVM; the order-dependent walk runs per page, from partitions sorted by node.
    Repeated node rows count once. A node with a role of no class is a section, or a block if it has no children.
    """
    text = F.when(F.col("name").rlike(OTHER_SCRIPTS), "").otherwise(tokenizer_fixups(fold_ascii(F.col("name"))))
    n = nodes.select("policy_id", "page_id", "node_id", "parent_id", "role", text.alias("name"), "level").repartition("page_id").sortWithinPartitions("page_id", "node_id")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b["page_id"] == b["page_id"].iloc[-1]
            rest = b[last]
            yield b[~last]
        if rest is not None:
            yield rest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pages(batches):
            out = []
            for page, g in b.drop_duplicates(["page_id", "node_id"]).groupby("page_id", sort=False):
                at = {int(i): k for k, i in enumerate(g["node_id"])}
                parents = [at.get(int(p), -1) if pd.notna(p) else -1 for p in g["parent_id"]]
                found = segments_of(g["role"].tolist(), [x if isinstance(x, str) else None for x in g["name"]], [int(x) if pd.notna(x) else None for x in g["level"]], parents, strict=False)
                out += [(g["policy_id"].iloc[0], page, k, s, p, t) for k, (s, p, t) in enumerate(found)]
            yield pd.DataFrame(out, columns=["policy_id", "page_id", "segment_id", "segment_type", "parent_id", "text"]).astype({"parent_id": "Int32"})

    return n.mapInPandas(run, SEGMENTS)


def latest_segments(segments: DataFrame) -> DataFrame:
    """One row per (policy_id, segment_id): of repeated rows the one loaded last."""
    rest = [c for c in segments.columns if c not in ("policy_id", "segment_id", "loaded_at")]
    g = segments.groupBy("policy_id", "segment_id").agg(F.max_by(F.struct(*rest), F.struct("loaded_at", "seg_uid")).alias("r"))
    return g.select("policy_id", "segment_id", *[F.col(f"r.{c}") for c in rest])


def context_chain(segments: DataFrame) -> DataFrame:
    """(policy_id, segment_id, ancestor_id, ctx): each segment with itself (ctx 0) and all above it (SEG-09).

    Distance doubling over the parent links: a round joins the pairs found so far with themselves, so
    log(depth) rounds suffice for any depth and each starts from a checkpoint. Segments on a loop of
    parents reach each other once, at the shortest distance.
    """
    own = segments.select("policy_id", "segment_id", F.col("segment_id").alias("ancestor_id"), F.lit(0).alias("ctx"))
    up = segments.where("parent_id is not null").select("policy_id", F.col("segment_id").cast("int").alias("src"), F.col("parent_id").cast("int").alias("dst"))
    far = closure(up).where("src <> dst").select("policy_id", F.col("src").alias("segment_id"), F.col("dst").alias("ancestor_id"), F.col("dist").cast("int").alias("ctx"))
    return own.unionByName(far)


def context_documents(segments: DataFrame) -> DataFrame:
    """(policy_id, segment_id, ctx, words, n_glue): a segment's tokens after those of what it stands under (SEG-10).

    For each segment that isn't a LISTITEM and each of its ancestors that isn't one, the tokens from
    that ancestor down to the segment. Two line ends follow a heading, a colon follows a list item
    whose predecessor ends in a letter or digit.
    """
    s = segments.select("policy_id", "segment_id", "segment_type", "tokens")
    chain = context_chain(segments)
    heads = chain.join(s.select("policy_id", F.col("segment_id"), F.col("segment_type").alias("t0")), ["policy_id", "segment_id"]).where("t0 <> 'LISTITEM'")
    anc = s.select("policy_id", F.col("segment_id").alias("ancestor_id"), F.col("segment_type").alias("t"), "tokens")
    full = heads.join(anc, ["policy_id", "ancestor_id"])
    top = full.where("t <> 'LISTITEM'").select("policy_id", "segment_id", F.col("ctx").alias("top"))
    parts = top.join(full.select("policy_id", "segment_id", "ctx", "t", "tokens"), ["policy_id", "segment_id"]).where("ctx <= top")
    g = parts.groupBy("policy_id", "segment_id", F.col("top").alias("ctx")).agg(F.sort_array(F.collect_list(F.struct((-F.col("ctx")).alias("o"), "t", "tokens"))).alias("p"))
    empty = F.struct(F.array().cast("array<string>").alias("w"), F.lit("").alias("prev"), F.lit(0).alias("glue"))

    def step(acc, x):
        has = F.size(acc["w"]) > 0
        after_head = has & (acc["prev"] == "HEADING")
        colon = has & (acc["prev"] == "LISTITEM") & F.element_at(acc["w"], -1).rlike(r"^[\p{L}\p{N}]+$")
        glue = F.when(after_head, F.array(F.lit("\n"), F.lit("\n"))).when(colon, F.array(F.lit(":"))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(acc["w"], glue, x["tokens"]).alias("w"), x["t"].alias("prev"), (acc["glue"] + F.size(glue)).alias("glue"))

    done = F.aggregate("p", empty, step)
    return g.select("policy_id", "segment_id", "ctx", done.alias("d")).select("policy_id", "segment_id", "ctx", F.col("d.w").alias("words"), F.col("d.glue").alias("n_glue"))


def annotation_documents(segments: DataFrame) -> DataFrame:
    """(policy_id, segment_id, words, places, item): for each segment with tokens, except headings that others stand under, its tokens after those of all it stands under.

    The widest contextual document of each segment; list items are documents of their own here, each
    after what introduces its list, so that a statement over an introduction and an item is one text.
    places: a word's segment times 2^32 plus its place there, -1 for glue: a line end after a heading, a
    colon after a list item that ends in a letter or digit. item: the segment itself, if it is a list item.
    """
    s = segments.select("policy_id", "segment_id", "segment_type", "tokens").where("policy_id is not null and segment_id is not null")
    chain = context_chain(segments.where("policy_id is not null and segment_id is not null"))
    above = segments.where("parent_id is not null").select("policy_id", F.col("parent_id").cast("int").alias("segment_id")).distinct()
    ends = s.where("size(tokens) > 0").select("policy_id", "segment_id", "segment_type")
    ends = ends.join(above, ["policy_id", "segment_id"], "left_anti").unionByName(ends.where("segment_type <> 'HEADING'").join(above, ["policy_id", "segment_id"], "left_semi"))
    anc = s.select("policy_id", F.col("segment_id").alias("ancestor_id"), F.col("segment_type").alias("t"), "tokens")
    parts = chain.join(ends.select("policy_id", "segment_id", F.col("segment_type").alias("own")), ["policy_id", "segment_id"]).join(anc, ["policy_id", "ancestor_id"])
    g = parts.groupBy("policy_id", "segment_id", "own").agg(F.sort_array(F.collect_list(F.struct((-F.col("ctx")).alias("o"), "ancestor_id", "t", "tokens"))).alias("p"))
    empty = F.struct(F.array().cast("array<string>").alias("w"), F.array().cast("array<bigint>").alias("at"), F.lit("").alias("prev"))

    def step(acc, x):
        has = (F.size(acc["w"]) > 0) & (F.size(x["tokens"]) > 0)
        colon = has & (acc["prev"] == "LISTITEM") & F.element_at(acc["w"], -1).rlike(r"^[\p{L}\p{N}]+$")
        glue = F.when(has & (acc["prev"] == "HEADING"), F.array(F.lit("\n"))).when(colon, F.array(F.lit(":"))).otherwise(F.array().cast("array<string>"))
        places = F.transform(x["tokens"], lambda _, k: x["ancestor_id"].cast("bigint") * (1 << 32) + k)
        kept = F.when(F.size(x["tokens"]) > 0, x["t"]).otherwise(acc["prev"])
        return F.struct(F.concat(acc["w"], glue, x["tokens"]).alias("w"), F.concat(acc["at"], F.transform(glue, lambda _: F.lit(-1).cast("bigint")), places).alias("at"), kept.alias("prev"))

    d = g.select("policy_id", "segment_id", "own", F.aggregate("p", empty, step).alias("d"))
    return d.select("policy_id", "segment_id", F.col("d.w").alias("words"), F.col("d.at").alias("places"), F.when(F.col("own") == "LISTITEM", F.col("segment_id")).alias("item"))


def heading_parents(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, level, parent_node): the last heading before with a smaller level (SEG-02).

    A running maximum per smaller level: levels are few, so the window carries one value for each.
    """
    h = nodes.where("role = 'heading' and level is not null").select("page_id", "node_id", "level").distinct()
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") <= k, F.col("node_id"))).over(w) for k in range(1, 6)]
    expr = F.lit(None).cast("int")
    for k in range(1, 6):
        expr = F.when(F.col("level") == k + 1, last[k - 1]).otherwise(expr)
    return h.select("page_id", "node_id", "level", expr.alias("parent_node"))
