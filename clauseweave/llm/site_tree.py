"""Page boilerplate apart from main content by site style trees (problem 1).

The trees of one host are merged into a style tree: a style node is the chain of roles from the
root. The content importance of a text at a style node is 1 - H, where H is the entropy of its
occurrences over the host's policies, to the base of their number: 0 for what all policies share, 1
for what one alone holds. The presentation importance of a branch is the entropy of the role
sequences that it shows over the host. A branch's composite importance is the mean of its contents'
importances by length, plus a share of its presentation importance; branches below ``LEAST`` are
removed. All of this is exact, over all pages.

A host with one policy says nothing about itself, and teasers differ from page to page. So what the
trees tell is carried over to the branches that they leave in: a logistic model over words learns,
from a bounded sample of the pages on which the tree removed something, what stands in the branch
with the largest mass of importance and what beside it. Where no tree removes anything, no model is
fitted and nothing but contents lists and page controls is noise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clauseweave.llm.residue import kind_of
from clauseweave.plans.session import stash

# Roles that open a branch of their own; a data cell without children doesn't.
SECTIONS = {"section", "region", "landmark", "article", "group", "dialog", "alert", "alertdialog", "navigation", "main", "complementary", "contentinfo", "banner", "search", "form", "aside", "cell", "gridcell"}
# Wording of page controls, which stand inside the text as well as around it.
CONTROLS = re.compile(
    r"(?:[↑▲«»<>|\W]*(?:"
    r"back to (?:the )?(?:top|contents)|return to (?:the )?(?:top|contents|overview)|go to (?:the )?top|to (?:the )?top|top|top of (?:the )?page|jump to(?: section)?|skip to [\w ]+|contents|table of contents|on this page|in this article|in this section|in this notice"
    r"|(?:was|is) this (?:page|section|article|answer) (?:helpful|useful)|(?:listen to|share|print|edit|save|bookmark|report|rate|translate) this (?:page|section|article|post|site)|listen|copy (?:the )?link|copy link to (?:this )?section|expand all|collapse all|show more|show less|read more|close|search"
    r"|advertisement|advertisements|sponsored(?: by .{1,40}|: .{1,60}| content| link)?|anzeige|werbung|publicité|publicidad|pubblicità|advertentie|publicidade|reklama|реклама"
    r"|nach oben|zum seitenanfang|inhalt|inhaltsverzeichnis|auf dieser seite|seite drucken|haut de page|retour en haut|sommaire|sur cette page|imprimer cette page|volver arriba|en esta página|índice|torna su|in questa pagina|indice|terug naar boven|op deze pagina|inhoud|voltar ao topo|nesta página|do góry|spis treści|na tej stronie|наверх|содержание|на этой странице"
    r")[\W]*)\Z",
    re.I,
)
BITS = 18
CONTENT = 0.8  # share of content importance in a branch's composite importance; the rest is presentation
LEAST = 0.5  # composite importance below which a branch is removed
WORDS = re.compile(r"[^\W_]+|[^\w\s]")
DIGITS = re.compile(r"\d+")
NUMBERED = re.compile(r"^[\W\d]+(?=\w)")
LEAF_SCHEMA = "page_id bigint, node_id int, branch int, role string, name string, toc boolean, heading boolean, size int, host bigint, policy bigint, node bigint, top bigint, shape bigint"


def normal(text: str) -> str:
    """The text for comparison: lower case, each number 0, no marks at the ends."""
    return DIGITS.sub("0", " ".join(text.lower().split())).strip(" .;:·|*-–")


def title(text: str) -> str:
    """The normal text of a heading or of an entry that points to it, without its number."""
    return text if text[:1].isalpha() else NUMBERED.sub("", text)


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole pages from batches sorted by page; a page may lie across batches."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        last = b["page_id"].to_numpy() == b["page_id"].iloc[-1]
        rest = b[last]
        if not last.all():
            yield b[~last]
    if rest is not None and len(rest):
        yield rest


ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of hashes; the order matters."""
    x = (a * ODD) ^ (b + np.uint64(0x7F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(values) -> np.ndarray:
    return pd.util.hash_array(np.asarray(values, object), categorize=True)


def leaf_rows(b: pd.DataFrame, norms: dict[str, str]) -> pd.DataFrame:
    """The leaf rows of whole pages (sorted by page and node, each node once), all pages at a time.

    Role chains, branches and headings come down from parent to child, one level of all trees in
    each step. A node whose parent is missing, or whose chain of parents never ends, is a root.
    """
    pid, nid = b["page_id"].to_numpy(), b["node_id"].to_numpy().astype(np.int64)
    n = len(b)
    page = np.cumsum(np.r_[False, pid[1:] != pid[:-1]])
    key = (page.astype(np.int64) << 33) + nid
    par = b["parent_id"].to_numpy(float)
    has = ~np.isnan(par)
    want = (page.astype(np.int64) << 33) + np.where(has, par, 0).astype(np.int64)
    up = np.searchsorted(key, want)
    up = np.where(has & (up < n) & (key[np.minimum(up, n - 1)] == want), np.minimum(up, n - 1), -1)
    up[up == np.arange(n)] = -1
    kids = np.zeros(n, bool)
    kids[np.unique(np.searchsorted(key, want[has & np.isin(want, key)]))] = True
    role = b["role"].fillna("").to_numpy(object)
    codes, names = pd.factorize(role)
    role_hash = _hashes(names)[codes]
    opens = np.isin(names, list(SECTIONS))[codes] & kids
    head = (np.asarray(names, object) == "heading")[codes]
    style, branch, under = role_hash.copy(), np.arange(n), np.zeros(n, bool)
    level = np.flatnonzero(up < 0)
    done = np.zeros(n, bool)
    done[level] = True
    first = np.zeros(n, bool)
    first[np.searchsorted(page, np.unique(page))] = True
    waiting = np.flatnonzero(~done)
    while len(waiting):
        ready = waiting[done[up[waiting]]]
        if not len(ready):
            break
        u = up[ready]
        style[ready] = _mix(style[u], role_hash[ready])
        branch[ready] = np.where(first[u] | opens[ready], ready, branch[u])
        under[ready] = under[u] | head[u]
        done[ready] = True
        waiting = waiting[~done[waiting]]
    text = b["name"].to_numpy(object)
    full = np.fromiter((isinstance(t, str) and not t.isspace() and t != "" for t in text), bool, n)
    named = np.flatnonzero(full & (~kids | head))
    norm = []
    for t in text[named]:
        x = norms.get(t)
        if x is None:
            x = norms[t] = normal(t)
        norm.append(x)
    heads = {(page[i], title(x)): i for i, x in zip(named, norm, strict=True) if head[i]}
    keep = ~kids[named]
    at = named[keep]
    norm = [x for x, k in zip(norm, keep, strict=True) if k]
    m = len(at)
    headed = under[at] | head[at]
    toc = np.fromiter((not h and heads.get((p, title(x)), -1) > i for h, p, x, i in zip(headed, page[at], norm, at, strict=True)), bool, m)
    ends = np.flatnonzero(toc[1:] & ~toc[:-1] & ~headed[:-1] & (branch[at][1:] == branch[at][:-1])) if m else []
    for i in ends:  # the caption of an in-page contents list
        if len(norm[i].split()) <= 4 and not text[at[i]].rstrip().endswith((".", "!", "?")):
            toc[i] = True
    order = np.argsort(branch[at], kind="stable")
    own = branch[at][order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if m else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, m])
    position = np.arange(m) - np.repeat(starts, sizes)
    part = _mix(style[at][order], position.astype(np.uint64))
    shape = np.zeros(m, np.uint64)
    if m:
        shape[order] = np.repeat(np.add.reduceat(part, starts), sizes)
    host = _hashes(b["site"].fillna("").to_numpy(object)[at])
    policy = b["policy_id"].to_numpy(object)[at]
    policy = _hashes([p if isinstance(p, str) else f"#{k}" for p, k in zip(policy, pid[at], strict=True)])
    signed = lambda x: x.view(np.int64)
    return pd.DataFrame(
        {
            "page_id": pid[at], "node_id": nid[at].astype(np.int32), "branch": nid[branch[at]].astype(np.int32), "role": role[at], "name": text[at], "toc": toc, "heading": headed,
            "size": np.fromiter(map(len, text[at]), np.int32, m), "host": signed(host), "policy": signed(policy),
            "node": signed(_mix(_mix(host, style[at]), _hashes(norm) if m else np.zeros(0, np.uint64))), "top": signed(_mix(host, style[branch[at]])), "shape": signed(shape),
        }
    )


def page_leaves(nodes: DataFrame) -> DataFrame:
    """One row per leaf with its style node, branch and marks; repeated node rows count once.

    Rows without page or node id are left out. One shuffle by page; pages are read in order from
    sorted partitions, so no page list is ever collected as a group beyond one page's own tree.
    """
    cols = ["site", "page_id", "policy_id", "node_id", "parent_id", "role", "name"]
    rows = nodes.select(*cols).where("page_id is not null and node_id is not null")
    rows = rows.repartition("page_id").sortWithinPartitions("page_id", "node_id", F.col("name").isNull(), "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms: dict[str, str] = {}
        for b in _pages(batches):
            pid, nid = b["page_id"].to_numpy(), b["node_id"].to_numpy()
            keep = np.ones(len(b), bool)
            keep[1:] = (pid[1:] != pid[:-1]) | (nid[1:] != nid[:-1])
            if len(norms) > 300_000:
                norms.clear()
            yield leaf_rows(b[keep].reset_index(drop=True), norms)

    return rows.mapInPandas(run, LEAF_SCHEMA)


ENTROPY = "1 - least(1.0, greatest(0.0, (ln(n) - nlogn / n) / ln(pages)))"


def importances(leaves: DataFrame) -> DataFrame:
    """(page_id, node_id, tag, value, pages): what the style tree of its host says about each page.

    tag 1: the content importance of a leaf, where more than one policy shares its text at its style
    node (it is 1 for all others); tag 2: the presentation importance of the branch ``node_id``, with
    the number of policies of the host (several crawls of one policy are one). Occurrences are
    counted in two steps, partial sums first, so a host with a third of all rows is spread by (style
    node, text). Only hashes are shuffled.
    """
    m = leaves.select("host", "policy").distinct().groupBy("host").agg(F.count("*").cast("int").alias("pages"))
    each = leaves.groupBy("host", "node", "policy").agg(F.count("*").alias("c"))
    text = each.groupBy("host", "node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("nlogn"), F.count("*").alias("k")).where("k > 1")
    text = text.join(m, "host").select("node", F.expr(ENTROPY).cast("float").alias("value"))
    content = leaves.select("page_id", "node_id", "node").join(text, "node").select("page_id", "node_id", F.lit(1).cast("tinyint").alias("tag"), "value", F.lit(None).cast("int").alias("pages"))
    tops = leaves.groupBy("page_id", "branch").agg(F.first("top").alias("top"), F.first("shape").alias("shape"), F.first("host").alias("host"))
    seq = tops.groupBy("top", "shape").agg(F.count("*").alias("c"))
    ent = seq.groupBy("top").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("nlogn"))
    ent = ent.select("top", F.expr("if(n > 1, (ln(n) - nlogn / n) / ln(n), 1.0)").cast("float").alias("value"))
    branch = tops.join(ent, "top").join(m, "host").select("page_id", F.col("branch").alias("node_id"), F.lit(2).cast("tinyint").alias("tag"), "value", "pages")
    return content.unionByName(branch)


TREE_SCHEMA = "page_id bigint, node_id int, branch int, role string, name string, toc boolean, heading boolean, size int, pages int, content float, presentation float"


def tree_rows(leaves: DataFrame, marks: DataFrame) -> DataFrame:
    """Leaf and importance rows together, sorted by page; see ``with_tree``. One shuffle of the names."""
    cols = ["page_id", "node_id", "branch", "role", "name", "toc", "heading", "size"]
    rows = leaves.select(*cols, F.lit(0).cast("tinyint").alias("tag")).unionByName(marks, allowMissingColumns=True)
    return rows.repartition("page_id").sortWithinPartitions("page_id", "tag", "node_id")


def with_tree(b: pd.DataFrame) -> pd.DataFrame:
    """The leaves of whole pages with pages, content and presentation importance from ``tree_rows``."""
    tag = b["tag"].to_numpy()
    page = np.cumsum(np.r_[False, np.diff(b["page_id"].to_numpy()) != 0]).astype(np.int64) << 33
    key = page + b["node_id"].to_numpy()
    leaf, c, p = (np.flatnonzero(tag == k) for k in (0, 1, 2))
    df = b.iloc[leaf].drop(columns=["tag", "value", "pages"]).reset_index(drop=True)
    df = df.astype({"branch": "int32", "size": "int32", "toc": bool, "heading": bool})
    content = np.ones(len(leaf), np.float32)
    content[np.searchsorted(key[leaf], key[c])] = b["value"].to_numpy(np.float32)[c]
    at = p[np.searchsorted(key[p], page[leaf] + df["branch"].to_numpy())]
    return df.assign(pages=b["pages"].to_numpy()[at].astype(np.int32), content=content, presentation=b["value"].to_numpy(np.float32)[at])


def style_tree(leaves: DataFrame) -> DataFrame:
    """The leaves (``page_leaves``) with the importances of the style tree of their host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pages(batches):
            yield with_tree(b)

    return tree_rows(leaves, importances(leaves)).mapInPandas(run, TREE_SCHEMA)


class Controls(dict):
    """Text -> is it the wording of a page control; filled as texts come."""

    def __missing__(self, text: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        c = self[text] = bool(CONTROLS.match(normal(text)))
        return c


IS_CONTROL = Controls()


def decided(df: pd.DataFrame) -> pd.DataFrame:
    """Leaves of whole pages with skip (a contents list or a control), composite and low (their branch is removed)."""
    text, first = pd.factorize(df["name"])
    short = np.fromiter((len(t) <= 120 and IS_CONTROL[t] for t in first), bool, len(first))
    skip = df["toc"].to_numpy(bool) | (short[text] & ~df["heading"].to_numpy(bool))
    group = pd.factorize((pd.factorize(df["page_id"])[0].astype(np.int64) << 33) + df["branch"].to_numpy())[0]
    size = np.maximum(1, df["size"].to_numpy())
    mean = np.bincount(group, size * df["content"].to_numpy()) / np.bincount(group, size)
    comp = CONTENT * mean[group] + (1 - CONTENT) * df["presentation"].to_numpy()
    return df.assign(skip=skip, group=group, composite=comp, low=(df["pages"].to_numpy() > 1) & (comp < LEAST))


MASK = (1 << BITS) - 1


class WordHashes(dict):
    """Word -> hash, filled as words come."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode())
        return h


HASHES = WordHashes()


class Sparse:
    """Hashed features of leaves: words, pairs of words, whole text, role, number of words, last sign."""

    def __init__(self, roles: list[str], names: list[str]) -> None:
        self.n = n = len(names)
        text = [normal(x) for x in names]
        words = [WORDS.findall(t) for t in text]
        count = np.fromiter(map(len, words), np.int64, n)
        flat = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(words)), np.uint64, int(count.sum()))
        owner = np.repeat(np.arange(n), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        pairs = (flat[inner] * np.uint64(1000003)) ^ (flat[inner + 1] >> np.uint64(3))
        ends = ["a" if x[-1:].isalnum() else x[-1:] for x in (y.rstrip() for y in names)]
        extra = [HASHES["r:" + r] for r in roles] + [HASHES["e:" + e] for e in ends] + [HASHES[f"n:{min(12, c)}"] for c in count]
        extra = np.r_[np.array(extra, np.uint64), _hashes(text) if n else np.zeros(0, np.uint64)]
        both = (np.r_[owner, owner[inner], np.tile(np.arange(n), 4)].astype(np.int64) << BITS) | (np.r_[flat, pairs, extra] & np.uint64(MASK)).astype(np.int64)
        both.sort()
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        self.row, self.idx = both >> BITS, both & MASK
        self.len = np.bincount(self.row, minlength=n)
        self.ptr = np.r_[0, np.cumsum(self.len)]
        self.scale = 1 / np.sqrt(np.maximum(1, self.len))

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.clip(np.bincount(self.row, w[self.idx], self.n) * self.scale + w[-1], -6, 6)


class Batches:
    """The rows of a ``Sparse`` in fixed random batches, prepared once for all fits."""

    def __init__(self, x: Sparse, size: int = 2048) -> None:
        order = np.random.default_rng(0).permutation(x.n)
        self.parts = []
        for s in range(0, x.n, size):
            b = order[s : s + size]
            ii = np.concatenate([x.idx[x.ptr[j] : x.ptr[j + 1]] for j in b])
            u, inv = np.unique(ii, return_inverse=True)
            self.parts.append((b, ii, np.repeat(np.arange(len(b)), x.len[b]), x.scale[b], u, inv))

    def fit(self, y: np.ndarray, epochs: int = 4, rate: float = 0.3, l2: float = 1e-6) -> np.ndarray:
        """Logistic weights (and, last, the bias) by Adagrad over the batches."""
        w, g2 = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            for k in rng.permutation(len(self.parts)):
                b, ii, rows, scale, u, inv = self.parts[k]
                err = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[ii], len(b)) * scale + w[-1], -30, 30))) - y[b]
                gu = np.bincount(inv, (err * scale)[rows], len(u)) + l2 * w[u]
                g2[u] += gu**2
                w[u] -= rate * gu / np.sqrt(g2[u])
                g2[-1] += err.sum() ** 2
                w[-1] -= rate * err.sum() / np.sqrt(g2[-1])
        return w


def branch_means(df: pd.DataFrame, s: np.ndarray) -> np.ndarray:
    """Mean score of the branch of each leaf; entries of contents lists and controls don't count."""
    real = ~df["skip"].to_numpy()
    n = np.bincount(df["group"], real)
    return np.where(n > 0, np.bincount(df["group"], np.where(real, s, 0.0)) / np.maximum(1, n), -3.0)[df["group"]]


def fit_model(sample: pd.DataFrame, rounds: int = 3) -> np.ndarray | None:
    """Weights of the text model, from whole pages with their importances; None if no tree removed anything.

    Only pages on which the tree removed a branch teach. First labels: content is what stands in
    the branch with the largest mass of importance among those that the tree leaves in. Then each of
    these is labelled anew by its mean score, so that main text split into several branches is found.
    """
    df = decided(sample.reset_index(drop=True))
    df = decided(df[df.groupby("page_id")["low"].transform("any")].reset_index(drop=True))
    if not len(df):
        return None
    x = Sparse(df["role"].tolist(), df["name"].tolist())
    batches = Batches(x)
    low, skip = df["low"].to_numpy(), df["skip"].to_numpy()
    mass = np.bincount(df["group"], np.where(skip, 0, df["size"] * df["composite"]))[df["group"]]
    y = ((mass >= pd.Series(np.where(low, -1.0, mass)).groupby(df["page_id"].to_numpy()).transform("max").to_numpy()) & ~low & ~skip).astype(float)
    for _ in range(rounds):
        w = batches.fit(y)
        s = x.score(w)
        y = ((branch_means(df, s) > 0) & ~low & ~skip & (s > -2.5)).astype(float)
    return w


def judge_pages(nodes: DataFrame, fit_leaves: int = 60_000, residue_of: str = "all", prose: bool = False) -> DataFrame:
    """(page_id, node_id, role, heading, name, importance, noise, residue, decided_by) of each leaf.

    importance: 0 to 1, high for the page's own text; noise: it is a contents-list entry or a page
    control ('control'), the tree of its host removes its branch ('tree'), or, in a branch that the
    tree leaves in, its own and its branch's score by the text model together are low ('model');
    residue: it is what ``kind_of`` calls residue, asked of ``residue_of`` 'all', 'noise' or 'main' leaves.
    With ``prose`` only main leaves come that are neither headings, cells nor residue.

    ``fit_leaves`` bounds the leaves on which the text model is fitted (whole pages, chosen by a
    hash of page_id); the style tree and the judgement cover all pages. Null sites are one host,
    a null policy is the page's own. Pages without leaves give no rows, nor does an empty table.
    """
    leaves = stash(page_leaves(nodes))
    n = leaves.count()
    out = "page_id bigint, node_id int, role string, heading boolean, name string, importance double, noise boolean, residue boolean, decided_by string"
    if not n:
        return leaves.sparkSession.createDataFrame([], out)
    marks = stash(importances(leaves))
    few = F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(min(1.0, fit_leaves / n) * 1_000_000) + 1
    chosen = tree_rows(leaves.where(few), marks.where(few)).toPandas().sort_values(["page_id", "tag", "node_id"])
    w = fit_model(with_tree(chosen.reset_index(drop=True)))
    shared = leaves.sparkSession.sparkContext.broadcast(None if w is None else w.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores: dict[tuple[str, str], float] = {}
        kinds: dict[str, bool] = {}
        for b in _pages(batches):
            df = decided(with_tree(b.reset_index(drop=True)))
            low, skip = df["low"].to_numpy(), df["skip"].to_numpy()
            z = np.where(low, -3.0, 3.0)
            if shared.value is not None:
                left = df[~low]
                keys = list(zip(left["role"], left["name"], strict=True))
                if len(scores) > 300_000:
                    scores.clear()
                new = list({k for k in keys if k not in scores})
                if new:
                    scores |= zip(new, Sparse([r for r, _ in new], [t for _, t in new]).score(shared.value).tolist(), strict=True)
                s = np.fromiter((scores[k] for k in keys), float, len(keys))
                z[~low] = 0.5 * s + 0.5 * branch_means(left.assign(group=pd.factorize(left["group"])[0]), s)
            noise = low | (z < 0) | skip
            if len(kinds) > 200_000:
                kinds.clear()
            names = df["name"].to_numpy(object)
            asked = noise if residue_of == "noise" else ~noise if residue_of == "main" else np.ones(len(df), bool)
            if prose:
                asked = ~noise & ~df["heading"].to_numpy(bool) & ~df["role"].isin(["heading", "cell"]).to_numpy()
            kinds |= {t: kind_of(t) is not None for t in set(names[asked]) if t not in kinds}
            residue = [kinds[t] if a else None for t, a in zip(names, asked, strict=True)]
            by = np.where(low, "tree", np.where(skip, "control", "model"))
            rows = pd.DataFrame({"page_id": df["page_id"], "node_id": df["node_id"], "role": df["role"], "heading": df["heading"], "name": names, "importance": 1 / (1 + np.exp(-np.where(skip, np.minimum(z, -2), z))), "noise": noise, "residue": residue, "decided_by": by})
            yield rows[rows["residue"].eq(False)] if prose else rows

    return tree_rows(leaves, marks).mapInPandas(run, out)
