"""Main text of web pages by wrapper induction over the pages of a host.

Every page is read into a tree of block elements; elements of one label below one element are one node,
so a page of a thousand paragraphs has a small tree. The trees of a host are aligned by simple tree
matching with the host's most frequent tree. A node may so hold many blocks of a page; each is judged by
itself: a block whose text most of the host's differing pages with text in that node share is template, all
others are slots. Slots below the article's element are content. Elements that by their nature are no article (menus, forms,
asides, adverts, notices, comments ...) are no content even where their text varies, as it does in
menus that are made for every page; neither are blocks that consist of links.

Nothing gathers a host's pages: tasks send counts for each node of each distinct tree, aggregated
before and after the shuffle; the wrapper of a host is decided from one row for each node of one tree. A host
with a third of all pages is as many rows as it has distinct trees. Texts of blocks are compared by hash, once for
each differing page, and only hashes shared by most pages reach a host's row. The finished wrappers meet the pages
in a join on (host, tree), which Spark broadcasts only if they are small; pages are read three times and never
shuffled, only hashes of their blocks are.

Defined results: null and empty pages have empty text. A null URL belongs to the empty host. A host with
fewer than ``LEAST_PAGES`` differing pages has no template, and its pages are judged by
their elements alone. Broken mark-up is read as browsers do: unclosed elements end with their
parents, an unfinished tag or comment at the end is dropped, unknown references stay text. Repeated rows
each get their row; other columns pass through.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gleanframe.llm.common import unused, written
from gleanframe.llm.dom import Node, align, children_of, parse
from gleanframe.llm.url_filter import url_host

LEAST_PAGES = 5
#: Template blocks below the article are dropped only if so much of the article's text is left.
LEAST_LEFT = 0.5
#: A block of links holds so much of its text in links.
LINK_SHARE = 0.7

# Elements that hold no article.
NO_CONTENT = frozenset(
    "nav footer aside form noscript template svg button select option object canvas dialog menu head "
    "fieldset audio video map".split()
)
# Words of class, id and role that mark what is no article.
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription signup login comment comments respond "
    "disqus reply replies sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer widget widgets popup modal overlay social share sharing toolbar skip copyright legal "
    "related recommended trending contentinfo complementary search alert hidden".split()
)
# The same for what stands outside of the article only.
OUTER_WORDS = frozenset("header masthead banner topbar".split())
ARTICLE_WORDS = frozenset(["article", "main"])
# Marks of what readers wrote, which may well be longer than the article.
READER_WORDS = frozenset("comment comments respond disqus reply replies".split())
# Words before which a mark keeps its sense, as in share-buttons or comment-list.
HOLDERS = frozenset(
    "area bar block blocks box button buttons container field form group holder icon icons inner item items "
    "link links list outer panel section slot unit wrap wrapper zone".split()
)
# The same after a mark of what leads elsewhere, as in related-posts.
ELSEWHERE = frozenset("related recommended trending sponsored promo promotion".split())
TEASERS = frozenset("article articles news post posts stories story".split())
# Words that tell of a page what it has or lacks, as in no-sidebar.
STATES = frozenset("has have hide hides no not show shows with without".split())
#: Elements that hold so much of the unlinked text are not judged by their words ...
MOST = 0.5
#: ... and so much if they are comments or stand in an article.
NEARLY_ALL = 0.9


def _parts(label: str) -> tuple[str, list[str]]:
    tag, *words = label.split(" ")
    return tag, words


def is_article(label: str) -> bool:
    tag, marked = _parts(label)
    return tag in ARTICLE_WORDS or not {"@main", "@article", "$articlebody"}.isdisjoint(marked)


def marks(token: str, words: frozenset[str]) -> str | None:
    """The word of ``words`` that a class, id or role token names.

    The word is the token or ends it, but for holders: ``right-sidebar`` and ``share-buttons`` are marks,
    ``no-sidebar``, ``comments-open`` and ``legal-news`` are none.
    """
    parts = token.lstrip(".@$").split("-")
    if not STATES.isdisjoint(parts):
        return None
    while len(parts) > 1 and parts[-1] not in words and (
        parts[-1] in HOLDERS or (parts[-1] in TEASERS and parts[-2] in ELSEWHERE)
    ):
        parts.pop()
    return parts[-1] if parts[-1] in words else None


def subtotals(nodes: list[Node], amounts: list[int]) -> list[int]:
    """Amounts of nodes with all below them."""
    total = list(amounts)
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    return total


def boilerplate(nodes: list[Node], content: list[int], spared: frozenset[int] = frozenset()) -> tuple[list[bool], list[int]]:
    """Whether a node, by its label or that of one above it, holds no article; and what was spared.

    ``content`` are the characters of every node without links. Words do not count against ``html`` and ``body``,
    the largest article and what holds most of the text, nor against the nodes ``spared``.
    """
    total = subtotals(nodes, [max(0, c) for c in content])
    inside, by_tag, found, readers = [], [], [], []
    for node in nodes:
        tag, tokens = _parts(node.label)
        above = node.parent
        inside.append(is_article(node.label) or (above >= 0 and inside[above]))
        marked = {m for t in tokens if (m := marks(t, NO_CONTENT_WORDS))}
        outer = not inside[-1] and any(marks(t, OUTER_WORDS) for t in tokens)
        found.append("hidden" if "hidden" in tokens else bool(marked) or outer)
        readers.append(bool(marked & READER_WORDS) or (above >= 0 and readers[above]))
        by_tag.append(tag in NO_CONTENT or (tag == "header" and not inside[-1]) or (above >= 0 and by_tag[above]))
    articles = [i for i, n in enumerate(nodes) if is_article(n.label) and total[i] and not by_tag[i] and not readers[i]]
    largest = max(articles, key=lambda i: (total[i], i), default=-1)
    rival = total[largest] if largest >= 0 else 0
    holds_article = {largest}
    at = largest
    while at >= 0:
        holds_article.add(at := nodes[at].parent)
    result, kept = [], []
    for i, node in enumerate(nodes):
        own = by_tag[i]
        if found[i] and not own and node.label.split(" ")[0] not in ("html", "body"):
            needed = NEARLY_ALL if readers[i] or inside[i] else MOST
            # An article elsewhere is the better one, unless it is a mere teaser.
            better = i not in holds_article and rival > (0 if readers[i] else total[i] / 4)
            most = total[i] > 0 and total[i] >= needed * total[0] and not better
            spare = found[i] != "hidden" and (i == largest or most or i in spared)
            own = not spare
            if spare:
                kept.append(i)
        result.append(own or (node.parent >= 0 and result[node.parent]))
    return result, kept


def _skeleton(nodes: list[Node]) -> str:
    return json.dumps(nodes, ensure_ascii=False, separators=(",", ":"))


def _nodes(skeleton: str) -> list[Node]:
    return [Node(*x) for x in json.loads(skeleton)]


def _tree_id(skeleton: str) -> str:
    return hashlib.md5(skeleton.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


PROFILE = "host string, tree string, node int, skeleton string, pages long, chars long, link_chars long"
SHARED = "host string, tree string, page long, nodes array<int>, hashes array<long>, sizes array<long>"


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _profiled(batches):
    """Counts for each (host, tree, node) of a task."""
    trees: dict[tuple[str, str], list] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            nodes, blocks = parse(page.as_py())
            skeleton = _skeleton(nodes)
            entry = trees.setdefault((host, skeleton), [0, [[0, 0] for _ in nodes]])
            entry[0] += 1
            for block in blocks:
                entry[1][block.node][0] += len(block.text)
                entry[1][block.node][1] += block.link_chars
    rows = [
        (host, _tree_id(skeleton), i, skeleton if i == 0 else None, pages, *cell)
        for (host, skeleton), (pages, cells) in trees.items()
        for i, cell in enumerate(cells)
    ]
    yield _batch(rows, PROFILE)


def _hashed(batches):
    """Every page with the hashes of its blocks, each (node, text) once with all its characters."""
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            nodes, blocks = parse(page.as_py())
            sizes: dict[tuple[int, int], int] = {}
            keys = [(block.node, _hash(block.text)) for block in blocks]
            for key, block in zip(keys, blocks):
                sizes[key] = sizes.get(key, 0) + len(block.text)
            rows.append(
                (host, _tree_id(_skeleton(nodes)), _hash(str(keys)), [n for n, _ in sizes], [h for _, h in sizes], [*sizes.values()])
            )
        yield _batch(rows, SHARED)


KINDS = {
    "string": pa.string(),
    "int": pa.int32(),
    "long": pa.int64(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.strip().split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def _row_by_row(function, schema: str):
    def run(batches):
        for batch in batches:
            yield _batch([function(**row) for row in batch.to_pylist()], schema)

    return run


def _aligned(host, tree, skeleton, content, reference):
    """The partner of every node in the host's tree, -1 for none."""
    nodes, partners = _nodes(skeleton), align(_nodes(skeleton), _nodes(reference))
    return host, tree, skeleton, content, [partners.get(i, -1) for i in range(len(nodes))]


def _article_node(nodes: list[Node], drop: list[bool], content: list[int]) -> int:
    """The node below which the article lies. ``content``: characters of a node without links."""
    below = children_of(nodes)
    total = [0 if d else max(0, c) for c, d in zip(content, drop)]
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += 0 if drop[i] else total[i]
    marked = [i for i, n in enumerate(nodes) if is_article(n.label) and not drop[i] and total[i]]
    if marked:
        best = max(total[i] for i in marked)
        # The innermost of those that hold most of it.
        return max(i for i in marked if 2 * total[i] >= best)
    at = 0
    while True:
        heavy = [c for c in below[at] if not drop[c] and total[c] >= 0.9 * total[at] and total[c] > 0]
        if not heavy:
            return at
        at = heavy[0]


def _wrapper(host, reference, stats, template):
    """Nodes of the host's tree that hold content, ``article`` and the kept nodes below it, and the template blocks in them."""
    nodes = _nodes(reference)
    chars, links = [0] * len(nodes), [0] * len(nodes)
    for s in stats:
        chars[s["ref"]], links[s["ref"]] = s["chars"], s["link_chars"]
    content = [c - k for c, k in zip(chars, links)]
    drop, spared = boilerplate(nodes, content)
    article = _article_node(nodes, drop, content)
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside[i] = i == article or (node.parent >= 0 and inside[node.parent])
    kept = [inside[i] and not drop[i] and not links[i] > LINK_SHARE * chars[i] for i in range(len(nodes))]
    judged = [t for t in template or [] if kept[t["ref"]]]
    every = sum(t["all_chars"] for t in judged)
    same = [(t["ref"], h) for t in judged for h in t["hashes"] or []]
    if every - sum(t["chars"] for t in judged) < LEAST_LEFT * every:
        same = []
    return host, article, [i for i, k in enumerate(kept) if k], spared, [r for r, _ in same], [h for _, h in same]


def _plan(host, tree, skeleton, partners, content, article, kept, spared, same_refs, same_hashes):
    """Nodes of one tree that hold content, and the template blocks in them. Nodes without a partner follow the one above them."""
    nodes, keeps = _nodes(skeleton), set(kept)
    shared: dict[int, list[int]] = {}
    for ref, found in zip(same_refs, same_hashes):
        shared.setdefault(ref, []).append(found)
    drop, _ = boilerplate(nodes, content, frozenset(i for i, p in enumerate(partners) if p in set(spared)))
    inside = []
    for i, node in enumerate(nodes):
        inside.append(partners[i] == article or (node.parent >= 0 and inside[node.parent]))
    if not any(inside):
        # The page lacks the host's article: it is judged by its own elements.
        own = _article_node(nodes, drop, [1] * len(nodes))
        inside = []
        for i, node in enumerate(nodes):
            inside.append(i == own or (node.parent >= 0 and inside[node.parent]))
        return host, tree, [i for i in range(len(nodes)) if inside[i] and not drop[i]], [], []
    wanted = [
        i
        for i in range(len(nodes))
        if inside[i] and not drop[i] and (partners[i] in keeps or partners[i] < 0)
    ]
    same = [(i, found) for i in wanted for found in shared.get(partners[i], [])]
    return host, tree, wanted, [i for i, _ in same], [found for _, found in same]


def _template(read: DataFrame, partners: DataFrame) -> DataFrame:
    """``host, template``: of every node of the host's tree the hashes of its template blocks and the characters
    of these and of all blocks, counted once for each differing page."""
    differing = (
        read.mapInArrow(_hashed, SHARED)
        .groupBy("host", "tree", "page")
        .agg(*[F.first(c).alias(c) for c in ("nodes", "hashes", "sizes")])
    )
    blocks = differing.select("host", "tree", "page", F.inline(F.arrays_zip("nodes", "hashes", "sizes")))
    shares = (
        blocks.groupBy("host", "tree", F.col("nodes").alias("node"), F.col("hashes").alias("hash"))
        .agg(F.count("*").alias("pages"), F.sum("sizes").alias("chars"))
        .join(partners, ["host", "tree", "node"])
        .groupBy("host", "ref", "hash")
        .agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    )
    shares = written(shares, "wrappers")
    # Differing pages with text in a node.
    wide = (
        differing.select("host", "tree", F.explode(F.array_distinct("nodes")).alias("node"))
        .groupBy("host", "tree", "node")
        .agg(F.count("*").alias("node_pages"))
        .join(partners, ["host", "tree", "node"])
        .groupBy("host", "ref")
        .agg(F.sum("node_pages").alias("node_pages"))
    )
    # A text shared by most pages of a node is one of few there.
    frequent = (
        shares.where(F.col("pages") >= LEAST_PAGES)
        .join(wide, ["host", "ref"])
        .where(2 * F.col("pages") > F.col("node_pages"))
        .groupBy("host", "ref")
        .agg(F.collect_list("hash").alias("hashes"), F.sum("chars").alias("chars"))
    )
    return (
        shares.groupBy("host", "ref")
        .agg(F.sum("chars").alias("all_chars"))
        .join(frequent, ["host", "ref"], "left")
        .groupBy("host")
        .agg(
            F.collect_list(
                F.struct("ref", "hashes", F.coalesce("chars", F.lit(0)).alias("chars"), "all_chars")
            ).alias("template")
        )
    )


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, tree, nodes, same_nodes, same_hashes``: of every distinct tree of every host the content nodes
    and, by node and hash of the text, the template blocks in them."""
    read = pages.select(url_host(F.col("url")).alias("host"), "html")
    counts = written(
        read.mapInArrow(_profiled, PROFILE)
        .groupBy("host", "tree", "node")
        .agg(
            F.min("skeleton").alias("skeleton"),
            *[F.sum(c).alias(c) for c in ("pages", "chars", "link_chars")],
        ),
        "wrappers",
    )
    trees = counts.where("node = 0").select("host", "tree", "skeleton", "pages")
    reference = trees.groupBy("host").agg(
        F.max(F.struct("pages", "tree", "skeleton"))["skeleton"].alias("reference")
    )
    # Unlinked characters of a tree's nodes, in order.
    content = F.sort_array(F.collect_list(F.struct("node", (F.col("chars") - F.col("link_chars")).alias("own"))))
    contents = counts.groupBy("host", "tree").agg(F.transform(content, lambda c: c["own"]).alias("content"))
    aligned = written(
        trees.select("host", "tree", "skeleton")
        .join(contents, ["host", "tree"])
        .join(reference.select("host", "reference"), "host")
        .mapInArrow(
            _row_by_row(
                _aligned,
                s := "host string, tree string, skeleton string, content array<long>, partners array<int>",
            ),
            s,
        ),
        "wrappers",
    )
    # Counts by node of the host's tree; at most the nodes of one tree for a host.
    partners = aligned.select("host", "tree", F.posexplode("partners").alias("node", "ref")).where("ref >= 0")
    by_node = (
        partners.join(counts.select("host", "tree", "node", "chars", "link_chars"), ["host", "tree", "node"])
        .groupBy("host", "ref")
        .agg(
            F.sum("chars").alias("chars"),
            F.sum("link_chars").alias("link_chars"),
        )
        .groupBy("host")
        .agg(F.collect_list(F.struct("ref", "chars", "link_chars")).alias("stats"))
    )
    decided = (
        reference.join(by_node, "host")
        .join(_template(read, partners), "host", "left")
        .select("host", "reference", "stats", "template")
    )
    lists = "same_{} array<int>, same_hashes array<long>"
    decided = decided.mapInArrow(
        _row_by_row(
            _wrapper, s := "host string, article int, kept array<int>, spared array<int>, " + lists.format("refs")
        ),
        s,
    )
    return written(
        aligned.join(decided, "host").mapInArrow(
            _row_by_row(_plan, s := "host string, tree string, nodes array<int>, " + lists.format("nodes")), s
        ),
        "wrappers",
    )


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html but with ``text`` and ``n_chars``; the page needs ``url`` and ``html``."""
    plans = wrappers(pages)
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    host, tree, held, *plan_names, plan_same = unused(
        rest, "wrapper_host", "wrapper_tree", "wrapper_blocks", "plan_host", "plan_tree", "plan_nodes", "plan_same"
    )
    plan_host, plan_tree, plan_nodes = plan_names
    block = pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("text", pa.string())])

    def blocks_of(batches):
        for batch in batches:
            trees, blocks = [], []
            for page in batch.column(batch.num_columns - 1):
                nodes, found = parse(page.as_py())
                trees.append(_tree_id(_skeleton(nodes)))
                blocks.append([{"node": b.node, "hash": _hash(b.text), "text": b.text} for b in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(trees, pa.string()), pa.array(blocks, pa.list_(block))],
                names=[*batch.schema.names[:-1], tree, held],
            )

    keyed = pages.select(*rest, url_host(F.col("url")).alias(host), "html")
    schema = keyed.drop("html").schema.add(tree, "string")
    kind = T.StructType().add("node", "integer").add("hash", "long").add("text", "string")
    schema = schema.add(held, T.ArrayType(kind))
    read = keyed.mapInArrow(blocks_of, schema)
    same = F.arrays_zip(F.col("same_nodes").alias("node"), F.col("same_hashes").alias("hash"))
    plans = plans.select(
        *[F.col(c).alias(n) for c, n in zip(("host", "tree", "nodes"), plan_names)], same.alias(plan_same)
    )
    kept = F.filter(
        held,
        lambda b: F.array_contains(plans[plan_nodes], b["node"])
        & ~F.exists(plans[plan_same], lambda x: (x["node"] == b["node"]) & (x["hash"] == b["hash"])),
    )
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return (
        read.join(
            plans,
            (read[host] == plans[plan_host]) & (read[tree] == plans[plan_tree]),
            "left",
        )
        .select(*[read[c] for c in rest], F.coalesce(text, F.lit("")).alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
