"""Main text of web pages with a site style tree.

Every page is read into a tree of elements. The trees of one host are merged by the styles (tag and
class) on the way from the root: per place in the merged tree, how pages arrange the styles below it
and what text they have there. Both give an entropy over the pages of the host, 0 where all pages
agree and 1 where all differ, and a branch's importance combines them from the leaves up. Branches
of low importance on a host with enough pages are presentation, and are cut from each of its pages.
Pages count once per host however often they are repeated, and long running text that is not common
on the host stays where its branch is cut. Elements that hold menus, forms, scripts and the like by
their tag or class are cut on every host; inside an article, and for parts of an id, such a name only
raises the limit under which the branch goes. The same holds for a form or a named element outside of
which a page has no running text: it needs the consent of the tree. The story is looked for in the
page's articles only if they hold most of the running text that the tree has left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.joins import attach_lookup
from folioscope.session import scratch_path

# Weight that a level of the tree keeps against the ones below it, and the limit under which a branch goes.
DECAY, LIMIT = 0.9, 0.3
# The limit for a branch with a name of noise that may as well be part of the article.
HINT_LIMIT = 0.6
# Characters of running text that stay unless they are common: on a share of the pages that show the place.
LONG, COMMON = 120, 0.05
# Pages that must show a branch before their agreement counts.
MIN_PAGES = 8

# Elements by what HTML says about them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template head iframe object svg canvas audio video map".split())
NOISE = frozenset("nav header footer aside form menu button select textarea input label dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header "
    "masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related respond share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget widgets".split())
# What readers add differs on every page, so a host can't confirm it.
ADDED = frozenset("comment comments disqus respond".split())
RAW = frozenset("script style textarea title noscript iframe".split())
ENDS_P = BLOCKS - frozenset("html body caption tbody tfoot thead tr td th option title".split())
SAME = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr", "td": "td th", "th": "td th", "option": "option", "p": "p"}
SCOPE = frozenset("ul ol dl table article section div main body aside nav header footer form blockquote fieldset".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[^A-Za-z]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    __slots__ = ("tag", "style", "parent", "items", "noise", "hint", "inside", "path")

    def __init__(self, tag: str, style: str, parent: "Node | None", noise: bool, hint: bool = False):
        self.tag, self.style, self.parent, self.noise, self.hint, self.items = tag, style, parent, noise, hint, []
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.name_path()

    def name_path(self) -> None:
        parent, style, hint = self.parent, self.style, self.hint
        self.path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else ''}>{style}{'?' * hint}") >> 1


def opened(tag: str, attributes: str, parent: Node) -> Node:
    name, own, role = "", "", ""
    if attributes and "=" in attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id"):
                name += " " + (a or b or c)
                own += " " + (a or b or c) if key == "class" else ""
            elif key == "role":
                role = (a or b or c).strip().lower()
    words = {w for w in WORDS.split(name.lower()) if w} if name else set()
    tokens = set(own.lower().split())
    if parent.inside:
        named = tokens & ADDED
    else:
        named = {*WORDS.split(own.lower()), *name.lower().split()} & NOISE_NAMES
    noise = tag in NOISE or tag in HIDDEN or role in NOISE_ROLES or bool(named)
    hint = not noise and bool((tokens if parent.inside else words) & NOISE_NAMES)
    return Node(tag, f"{tag}.{'.'.join(sorted(words))}", parent, noise, hint)


def parse(html: str) -> Node:
    """Tree of a page; unclosed and misplaced tags are closed as browsers do for the usual cases."""
    root = Node("#root", "#root", None, False)
    here, at, n = root, 0, len(html)
    while at < n:
        found = TOKEN.search(html, at)
        if found is None:
            here.items.append(html[at:])
            break
        if found.start() > at:
            here.items.append(html[at: found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        closes = SAME.get(tag, "").split() + (["p"] if tag in ENDS_P else [])
        node = here
        while closes and node is not root and (node.tag in closes or node.tag not in SCOPE):
            if node.tag in closes:
                here = node.parent
                break
            node = node.parent
        child = opened(tag, found.group(3), here)
        here.items.append(child)
        if tag in RAW and not found.group(3).endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            stop = close.start() if close else n
            child.items.append(html[at:stop])
            at = close.end() if close else n
        elif tag not in VOID and not found.group(3).endswith("/"):
            here = child
    return with_doubtful_noise(root)


def running(nodes: list[Node], removed: frozenset[int] = frozenset(), common: frozenset[int] = frozenset(), root: Node | None = None, noise=None) -> int:
    """Characters in the long blocks of these branches."""
    return sum(len(b) for b in blocks(nodes, removed, common, root, noise) if len(b) >= LONG)


def outermost(root: Node, wanted) -> list[Node]:
    """The highest nodes that ``wanted`` takes, in page order; what lies below other noise is not looked at."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if wanted(node):
            found.append(node)
        elif not node.noise:
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return found


def doubtful(node: Node) -> bool:
    """Whether an element is noise only as a form or by its name, and not as something that readers add."""
    return node.noise and (node.tag == "form" or node.tag not in NOISE | HIDDEN) and not set(WORDS.split(node.style)) & ADDED


def with_doubtful_noise(root: Node) -> Node:
    """The page, where doubtful noise that holds its story is a hint only.

    It does where the page outside of noise has no article with text, and less than a fifth of the running
    text of that branch; then what the branch holds is looked at in turn.
    """
    held = outermost(root, doubtful)
    while held:
        if blocks(outermost(root, lambda node: not node.noise and node.tag in ("article", "main")), frozenset()):
            break
        outside = sum(map(len, blocks([root], frozenset())))
        sizes = [running([node], noise=lambda x: x.noise and not doubtful(x)) for node in held]
        if max(sizes) <= 5 * outside:
            break
        node = held[sizes.index(max(sizes))]
        node.noise, node.hint = False, True
        stack = [node]
        while stack:
            node = stack.pop()
            node.name_path()
            stack.extend(x for x in node.items if isinstance(x, Node))
        held = outermost(root, doubtful)
    return root


def main_nodes(root: Node, removed: frozenset[int] = frozenset(), common: frozenset[int] = frozenset()) -> list[Node]:
    """The articles (or main elements) outside noise, if they hold most of the page's running text; else the page.

    One article without running text counts with all its text. Several are cards, and are left out of
    a page that has its story elsewhere.
    """
    cards: list[Node] = []
    for wanted in ("article", "main"):
        found = outermost(root, lambda node: not node.noise and node.tag == wanted)
        if not found:
            continue
        own = running(found, removed, common, root)
        held = own or (sum(map(len, blocks(found, removed, common, root))) if len(found) == 1 else 0)
        if 2 * held >= held + running([root], removed, common, root) - own:
            return found
        if wanted == "article":
            cards = [node for node in found if not running([node], removed, common, root)]
    for node in cards:
        node.noise = True
    return [root]


def place_texts(node: Node) -> dict[int, str]:
    """Own text of every place of a branch outside noise, as the style tree compares it."""
    texts: dict[int, list[str]] = {}
    stack = [node]
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        texts.setdefault(node.path, []).extend(x.strip() for x in node.items if isinstance(x, str))
        stack.extend(x for x in node.items if isinstance(x, Node))
    return {path: "".join(parts) for path, parts in texts.items()}


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1 if text else 0


def blocks(nodes: list[Node], removed: frozenset[int], common: frozenset[int] = frozenset(), root: Node | None = None, noise=None) -> list[str]:
    """Texts of the blocks in page order, without noise (what ``noise`` takes, if given) and removed branches.

    Of a removed branch the places stay whose text on the page ``root`` is long and not ``common`` on its host.
    """
    stay: set[int] = set()
    if removed and root is not None:
        stay = {path for path, text in place_texts(root).items() if len(text) >= LONG and text_hash(text) not in common}
    out, held = [], []

    def close() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(text)

    # Branches with a place that stays, up to the root.
    kept: set[int] = set()
    stack = [root] if stay else []
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        stack.extend(x for x in node.items if isinstance(x, Node))
        if node.path in stay:
            while node is not None and id(node) not in kept:
                kept.add(id(node))
                node = node.parent

    stack = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            held.append(item)
        elif (noise(item) if noise else item.noise) or item.path in removed and id(item) not in kept:
            continue
        elif item.tag == "br":
            held.append("\n")
        else:
            if item.tag in BLOCKS:
                close()
                stack.append(None)
            stack.extend(reversed(item.items))
    close()
    return out


def page_text(root: Node, removed: frozenset[int] = frozenset(), common: frozenset[int] = frozenset()) -> str:
    return "\n\n".join(blocks(main_nodes(root, removed, common), removed, common, root))


def observations(root: Node) -> Iterator[tuple[int, int, int, bool, int, int]]:
    """Per place of the page outside noise: path, parent's path, depth, whether its name hints at noise, hashes of the styles and of the text below."""
    styles, texts, about = {}, {}, {}
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node.noise:
            continue
        about[node.path] = node.parent.path if node.parent else 0, depth, node.hint
        styles.setdefault(node.path, []).append("|".join(x.style for x in node.items if isinstance(x, Node)))
        texts.setdefault(node.path, []).extend(x.strip() for x in node.items if isinstance(x, str))
        stack.extend((x, depth + 1) for x in node.items if isinstance(x, Node))
    for path, (parent, depth, hint) in about.items():
        text = "".join(texts[path])
        yield path, parent, depth, hint, xxhash.xxh3_64_intdigest("/".join(styles[path])) >> 1, text_hash(text)


def site_trees(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, path, parent, depth, hint, pages, shape, content``: the merged trees with both entropies.

    And ``host, common``: hashes of the texts that are on a twentieth of the pages of a place of low entropy
    (at most 20 each). Pages are counted once each, whatever the number of their copies on a host.

    Observations are counted before they meet, so a host of any number of pages is as many rows as
    its merged tree has places and variants.
    """

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                out = [(host, share, *seen) for host, html, share in zip(*(rows.column(c).to_pylist() for c in range(3))) for seen in observations(parse(html or ""))]
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
                names = ["host", "share", "path", "parent", "depth", "hint", "styles", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    # Each of n copies counts as 1 / n.
    hashed = pages.select("host", "html", F.xxhash64("html").alias("page"))
    copies = hashed.groupBy("host", "page").agg(F.count("*").alias("copies")).where("copies > 1")
    shared = attach_lookup(hashed, copies, ["host", "page"]).select("host", "html", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    seen = shared.mapInArrow(observe, "host string, share double, path long, parent long, depth int, hint boolean, styles long, text long")
    place = ["host", "path", "parent", "depth", "hint"]
    both = seen.select(*place, "share", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("styles").alias("variant")), F.struct(F.lit(1).alias("kind"), F.col("text").alias("variant")))).alias("v"))
    # Sums of shares are whole but for rounding.
    counts = both.groupBy(*place, F.col("v.kind").alias("kind"), F.col("v.variant").alias("variant")).agg(F.greatest(F.lit(1.0), F.round(F.sum("share"))).alias("n"))
    path = scratch_path(pages.sparkSession, "variants")
    counts.write.option("compression", "zstd").parquet(path)
    counted = pages.sparkSession.read.schema(counts.schema).parquet(path)
    # Entropy to the base of the number of pages, from sums alone: log m - sum(n log n) / m.
    sums = counted.groupBy(*place, "kind").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max((F.col("variant") != 0) | (F.col("kind") == 0)).alias("any"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    trees = sums.groupBy(*place).agg(
        F.max("m").alias("pages"), F.max(F.when(F.col("kind") == 0, entropy)).alias("shape"),
        F.max(F.when((F.col("kind") == 1) & F.col("any"), entropy)).alias("content"))
    low = trees.where(F.col("content") < HINT_LIMIT).select("host", "path", "pages")
    texts = counted.where("kind = 1 AND variant <> 0 AND n > 1").join(low, ["host", "path"]).where(F.col("n") >= COMMON * F.col("pages"))
    return trees, texts.groupBy("host").agg(F.collect_set("variant").alias("common"))


def low_branches(trees: DataFrame) -> DataFrame:
    """``host, removed``: paths of the branches of low importance, highest places only.

    One group is the merged tree of a host, whose size is that of its templates.
    """

    def judge(tree: pa.Table) -> pa.Table:
        rows = sorted(tree.to_pylist(), key=lambda r: -r["depth"])
        below: dict[int, list[tuple[float, int]]] = {}
        importance = {}
        for r in rows:
            own = below.get(r["path"], [])
            shape, content = r["shape"] or 0.0, r["content"]
            if own:
                inner = sum(v * n for v, n in own) / sum(n for _, n in own)
                value = (1 - DECAY) * shape + DECAY * max(inner, content or 0.0)
            else:
                value = content if content is not None else 1.0
            importance[r["path"]] = value
            below.setdefault(r["parent"], []).append((value, r["pages"]))
        parents = {r["path"]: r["parent"] for r in rows}
        low = {r["path"] for r in rows if importance[r["path"]] < (HINT_LIMIT if r["hint"] else LIMIT) and r["pages"] >= MIN_PAGES and r["parent"]}
        top = [p for p in low if parents[p] not in low]
        host = rows[0]["host"]
        return pa.table({"host": pa.array([host], pa.string()), "removed": pa.array([top], pa.list_(pa.int64()))})

    found = trees.groupBy("host").applyInArrow(judge, "host string, removed array<bigint>")
    return found.where(F.size("removed") > 0)


def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per page: ``row`` (all its columns), ``text, n_chars``.

    Inside a block white space becomes one space; blocks are joined by two line feeds in page order;
    character references are decoded. Null or empty html gives an empty text; a page whose url has
    no host is judged by tags and classes together with its like; repeated pages count once among their like;
    an empty table gives no rows; other columns stay inside ``row``. Pages are read whole.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), HOST, 1)), F.lit(""))
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), host.alias("host"), F.col(html).cast("string").alias("html"))
    trees, common = site_trees(rows)
    low = low_branches(trees).join(common, "host", "left")
    known = attach_lookup(rows, low, ["host"]).select("row", "html", "removed", "common")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = []
                for page, removed, common in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                    root = parse(page or "")
                    texts.append(page_text(root, frozenset(removed or ()), frozenset(common or ())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    inner = rows.schema["row"].dataType.simpleString()
    return known.mapInArrow(extract, f"row {inner}, text string, n_chars long")
