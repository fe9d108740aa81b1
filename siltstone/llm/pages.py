"""HTML extraction by site style trees."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.stored import stored

#: A quote opens a value only behind an equals sign; one that nothing closes is a character like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<[!?/a-zA-Z][^>]*+>""", re.S)
#: The same without quotes, from where a tag's quotes reach to the end of the page: each page is read in time in proportion to its length.
BARE_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""")
TOKENS = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select".split())
#: Elements and name parts that never hold the article.
APART = frozenset("nav footer aside form script style noscript iframe svg template button select textarea dialog menu head title".split())
APART_NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal newsletter subscribe subscription share sharing social comment comments disqus respond reply replies related recommended widget toolbar pagination pager login signup search form alert contentinfo complementary dialog copyright skip".split())
#: Parts that say where or how an element stands and not what it holds: side-nav, share-buttons, global-footer-wrap.
LAYOUT_NAMES = frozenset("site page main global local top bottom left right upper lower side center inner outer primary secondary sub mini mobile desktop fixed sticky floating bar box block panel pane area zone slot unit section region wrap wrapper container holder inline row col column grid list lists item items link links button buttons btn icon icons label text title heading widget module group set card cards tabs tab content body post posts article articles entry story stories news reader readers user users blog media the and of to by in on our your more all js ui".split())
MAIN_NAMES = frozenset("article articlebody post entry content story main".split())
#: First parts of class names that tell of something else than the element: no-sidebar, has-comments, category-social.
MODIFIERS = frozenset("no not has have with without category cat tag topic".split())
KNOWN_NAMES = APART_NAMES | LAYOUT_NAMES | {"header"}
ARTICLE, MAIN, NAMED = 1, 2, 4
#: What a row of the tree holds: a page of a node, a row of children, a text, a branch that a leaf belongs to.
PAGE, STYLE, TEXT, BRANCH = range(4)
#: A host with more than one part in so many of the pages is dealt over tasks.
SHARES = 1000
#: How a block is apart: by the names of its elements, which the tree can overrule, or by the elements themselves.
BY_NAME, BY_ELEMENT = 1, 2
CLOSES_P = frozenset("p div section article main ul ol dl table form h1 h2 h3 h4 h5 h6 header footer nav aside pre blockquote hr figure address fieldset details".split())

MIN_PAGES = 2
#: A block counts for so many branches above it.
LEVELS = 64


class _Stack:
    """The open elements: (tag, node, kinds of main element around, apart, branch of nodes from the root)."""

    def __init__(self):
        self.items: list[tuple[str, int, int, int, tuple[int, ...]]] = [("", 0, 0, 0, ())]
        self.open: Counter[str] = Counter()

    @property
    def top(self):
        return self.items[-1]

    def push(self, tag: str, label: str, main: int, apart: int) -> None:
        node = _hash(f"{self.top[1]}/{label}")
        above = () if self.top[0] in ("", "html", "body") else self.top[4]  # what holds a whole page is no branch of it
        self.items.append((tag, node, main, apart, (*above[1 - LEVELS :], node)))
        self.open[tag] += 1

    def close(self, tag: str, stop: frozenset) -> None:
        """Closes the innermost element of this tag, with all in it, unless one of `stop` stands before it."""
        if not self.open[tag]:
            return
        for i in range(len(self.items) - 1, 0, -1):
            if self.items[i][0] == tag:
                for gone in self.items[i:]:
                    self.open[gone[0]] -= 1
                del self.items[i:]
                return
            if self.items[i][0] in stop:
                return


def blocks_of(html: str) -> list[tuple[tuple[int, ...], int, int, str]]:
    """(branch, kinds of main element around, apart, text) of every block with text, in page order.

    A branch is the nodes from below the body to the block's element. A node is a hash of the block elements
    above with their classes, digits left out: pages of a site that are built alike have equal nodes.
    """
    stack = _Stack()
    out: list[tuple[tuple[int, ...], int, int, str]] = []
    parts: list[str] = []

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                _, _, main, apart, branch = stack.top
                out.append((branch, main, apart, text))
            parts.clear()

    at, last, token = 0, html.rfind(">"), TOKEN
    while at <= last and (m := token.search(html, at)):
        if m.start() > at:
            parts.append(html[at : m.start()])
        if m[2] is None and token is TOKEN and html[m.start() + 1].isalpha():
            token, at = BARE_TOKEN, m.start()
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if m[3] and not m[1] and (kind := _kind(tag, m[3], stack.top))[2] > stack.top[3]:
                flush()
                stack.push(tag, *kind)
            elif m[1] and stack.top[0] == tag:
                flush()
                stack.close(tag, frozenset())
            continue
        flush()
        if m[1]:
            stack.close(tag, frozenset() if tag in ("article", "main", "body", "html") else frozenset(("article", "main", "body")))
            continue
        if tag in CLOSES_P:
            stack.close("p", frozenset(("article", "main", "body", "div", "td", "li", "section", "blockquote")))
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            stack.close(tag, frozenset(("ul", "ol", "dl", "table", "tr", "article", "main", "body")) - {tag})
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.push(tag, *_kind(tag, m[3], stack.top))
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def _kind(tag: str, attributes: str, above: tuple) -> tuple[str, int, int]:
    """Label, main kinds and apartness of an element below another.

    A name sets an element apart as a whole: share-buttons does, as its other part is one of layout; market-share,
    related-work and notice-period don't, as they tell of something else.
    """
    main, apart = above[2:4]
    names: set[str] = set()
    said: set[str] = set()
    hidden = False
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            name = name.lower()
            if bare or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
            elif name in ("class", "id", "role", "itemprop"):
                for one in value.split():
                    parts = TOKENS.findall(one)
                    names.update(parts)
                    if parts and (len(parts) == 1 or parts[0] not in MODIFIERS) and KNOWN_NAMES.issuperset(parts):
                        said.update(parts)
    page_level = tag in ("html", "body")
    here = 0 if page_level else (ARTICLE if tag == "article" or "articlebody" in names else 0) | (MAIN if tag == "main" else 0) | (NAMED if names & MAIN_NAMES else 0)
    if hidden or tag in APART or (not main and tag == "header"):
        apart = BY_ELEMENT
    elif not page_level and (said & APART_NAMES or (not main and "header" in said and not here)):
        apart = max(apart, BY_NAME)
    return tag + "".join(f".{n}" for n in sorted(names)), main | here, apart


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _page_rows(blocks) -> tuple[list[int], list[int], list[int]]:
    """nodes, kinds and features of one page's style tree."""
    texts: dict[int, set[int]] = {}
    children: dict[int, list[int]] = {}
    above: dict[int, tuple[int, ...]] = {}
    for branch, _, _, text in blocks:
        if branch:
            texts.setdefault(branch[-1], set()).add(_hash(f"{branch[-1]}\n{text}"))
            above[branch[-1]] = branch
            for node, child in zip(branch, (*branch[1:], 0), strict=True):
                row = children.setdefault(node, [])
                if not row or row[-1] != child:
                    row.append(child)
    rows = [(node, PAGE, 0) for node in children] + [(node, STYLE, _hash(str(row))) for node, row in children.items()]
    rows += [(node, TEXT, text) for node, found in texts.items() for text in found] + [(leaf, BRANCH, node) for leaf, branch in above.items() for node in branch]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The branches of every site's style tree, (host, node, pages, importance), and the texts that stand on more than one
    page of a node, (host, node, text, c, pages, importance); pages(host, html).

    A node is an element with all above it, which pages of one host share. With m different pages that
    hold it, the importance of a text that c of them hold is 1 - log c / log m: 0 for what every page
    repeats, 1 for what one page has alone. The content importance of a branch is the mean over all
    texts below it, however deep; its presentation importance is the entropy of the rows of children
    that its pages show, to the base m. The composite weighs content nine to one. Pages with equal texts
    count as one page.
    """

    def run(batches):
        for batch in batches:
            hosts, nodes, kinds, features, digests = [], [], [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = blocks_of(html)
                n, k, f = _page_rows(blocks)
                nodes += n
                kinds += k
                features += f
                hosts += [host] * len(n)
                digests += [_hash("\n".join(b[3] for b in blocks))] * len(n)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(features, pa.int64()), pa.array(digests, pa.int64())], names=["host", "node", "kind", "feature", "page"])

    seen = pages.select("host", "html").mapInArrow(run, "host long, node long, kind int, feature long, page long")
    seen = stored(seen.groupBy("host", "node", "kind", "feature").agg(F.count_distinct("page").alias("c")), "tree")
    of = lambda kind: seen.filter(F.col("kind") == kind)
    held = of(PAGE).select("host", "node", F.col("c").alias("pages"))
    # sums of c and c log c before anything meets by node, so that a common node is one row a task
    spread = lambda kind: of(kind).groupBy("host", "node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("l")).join(held, ["host", "node"])
    s = F.when(F.col("pages") > 1, F.col("n") - F.col("l") / F.ln("pages")).otherwise(F.col("n"))
    leaves = spread(TEXT).select("host", "node", s.alias("s"), "n")
    content = of(BRANCH).select("host", "node", F.col("feature").alias("branch")).join(leaves, ["host", "node"]).groupBy("host", F.col("branch").alias("node")).agg((F.sum("s") / F.sum("n")).alias("content"))
    shown = spread(STYLE).select("host", "node", (s / F.col("n")).alias("style"))
    repeated = of(TEXT).filter("c > 1").join(held, ["host", "node"])
    texts = repeated.select("host", "node", F.col("feature").alias("text"), "c", "pages", F.greatest(F.lit(0.0), 1 - F.ln("c") / F.ln("pages")).alias("importance"))
    branches = content.join(shown, ["host", "node"]).join(held, ["host", "node"]).select("host", "node", "pages", (0.9 * F.col("content") + 0.1 * F.col("style")).alias("importance"))
    return branches, texts


def _salted(rows: DataFrame) -> DataFrame:
    """(host, salts) of the hosts that hold over one part in SHARES of the pages, at most SHARES of them: their pages are dealt over so many tasks."""
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.col("n") * SHARES > F.col("total")).select("host", F.ceil(F.col("n") * SHARES / F.col("total")).cast("int").alias("salts"))


def _inside(found: list) -> list:
    """The blocks in article elements, else in main, else in an element named as content, else all.

    A later kind goes first where it holds more text outside the earlier one than that has in all: a teaser in an
    article element beside the story isn't the article.
    """
    kinds = [k for k in (ARTICLE, MAIN, NAMED) if any(b[1] & k for b in found)]
    size = lambda kind, no=0: sum(len(b[3]) for b in found if b[1] & kind and not b[1] & no)
    while len(kinds) > 1:
        bigger = next((k for k in kinds[1:] if size(k, kinds[0]) > size(kinds[0])), 0)
        if not bigger:
            break
        kinds = kinds[kinds.index(bigger) :]
    return [b for b in found if b[1] & kinds[0]] if kinds else found


def article(blocks: list, low: set[int]) -> tuple[list[str], int]:
    """The texts of a page's article, and how many blocks the tree took away; low: its site's nodes and texts of low importance."""
    said = [bool(low and b[0]) and _hash(f"{b[0][-1]}\n{b[3]}") in low for b in blocks]
    weak = [x or not low.isdisjoint(b[0]) for x, b in zip(said, blocks, strict=True)]
    place = {id(b): i for i, b in enumerate(blocks)}
    strong = lambda found: [b for b in found if not weak[place[id(b)]]]
    main = _inside([b for b in blocks if not b[2]])
    kept, size = strong(main), lambda found: sum(len(b[3]) for b in found)
    if main and main[0][1] and 2 * size(kept) < size(main):
        kept = main  # over half of an article repeats: a copy, and no notice
    if not kept:
        kept = _inside([b for x, b in zip(said, blocks, strict=True) if b[2] == BY_NAME and not x]) or main
    held = {id(b) for b in kept}
    return [b[3] for b in kept], sum(w and id(b) not in held for w, b in zip(weak, blocks, strict=True))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.1, least_branch: float = 0.5, min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, url, text, n_chars, n_noise) of every page: the blocks of the article, one a line.

    All pages of a host are merged in a style tree, menus and all. A block is noise if a branch above
    it has an importance below least_branch, or its text one below `least` and three quarters of the
    node's pages; nodes on fewer than min_pages different pages have no evidence against them. The
    priors on elements and names decide on what the tree leaves, as menus whose words differ on every
    page: the article is, of the blocks not apart (in nav, footer, aside, form and such elements or
    names, in comments of readers, in a header outside the article, hidden), those in article elements,
    else in main, else in an element named as content, else all, without noise; a later one of these kinds goes first
    where it holds more text outside the earlier one than that has in all. A name counts as a whole: each of its parts
    must be one of APART_NAMES or of layout. The tree weighs the innermost LEVELS branches of a block. Where over half of
    such an element is noise, it is the copy of an article and stays whole. Where nothing is left, the tree overrules
    the names: the blocks that only a name sets apart are taken in the same way, if their own texts are no noise. A
    page of nothing but repeated blocks keeps those not apart. n_noise counts the blocks that the tree
    took away.

    Pages are dealt by host behind the noise of their host, which a task holds once and no page carries; a host with
    more than one part in SHARES of all pages is dealt over tasks in proportion.

    Null and empty html give empty text. Pages without a host form one site. Repeated rows and rows
    with null ids each get theirs. Extra columns are ignored. An empty table gives an empty one.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.xxhash64(_host(F.col(url_col))).alias("host"))
    weak = lambda bound: (F.col("pages") >= min_pages) & (F.col("importance") < bound)
    branches, texts = style_tree(rows)
    noise = branches.filter(weak(least_branch)).select("host", "node").unionByName(texts.filter(weak(least) & (4 * F.col("c") >= 3 * F.col("pages"))).select("host", F.col("text").alias("node")))
    hot = F.broadcast(_salted(rows.select("host")))
    salts = F.coalesce("salts", F.lit(1))
    noise = noise.join(hot, "host", "left").select("host", "node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rows = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("html"), salts).cast("int"))

    def run(batches):
        here, low = None, set()  # a part's noise comes before its pages, and is held once for all of them
        for batch in batches:
            at, texts, dropped = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("host", "salt", "node", "html"))
            for i, (host, salt, node, html) in enumerate(zip(*columns, strict=True)):
                if here != (host, salt):
                    here, low = (host, salt), set()
                if node is not None:
                    low.add(node)
                    continue
                kept, taken = article(blocks_of(html), low)
                at.append(i), texts.append("\n".join(kept)), dropped.append(taken)
            own = batch.select(["id", "url"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], names=["id", "url", "text", "n_noise"])

    kind = rows.schema["id"].dataType.simpleString()
    parts = rows.select("host", "salt", "id", "url", "html").unionByName(noise.select("host", "salt", "node"), allowMissingColumns=True)
    out = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("node").isNull()).mapInArrow(run, f"id {kind}, url string, text string, n_noise long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"), "n_noise")
