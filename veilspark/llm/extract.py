"""Main text of web pages by wrapper induction over the pages of a host.

A page is parsed to a tree; a node's label is its tag with its class, id and role, and runs of alike siblings (paragraphs,
list items, containers built of the same parts) fold into one repeated node. Pages of a host are aligned by simple tree matching (the largest set of node pairs
that keeps labels, order and parents), which lays a page over the host's wrapper: a matched node counts one page more; nodes
without a partner are added. Once the wrapper is whole, all pages are laid over it again, and two things are counted for each
node over all of them: the digests of its texts, and how much text it holds outside links. Nodes whose text is the same on
nearly all of the host's pages are template; the others are varying slots.

The wrapper decides which slots are the article. From the root, the child that holds the most varying text is followed while
no other container beside it holds a tenth as much (MINOR) and it is made of blocks itself; where that ends is the core, and all
of it is content. On the way down, containers beside the path are left out (menus, adverts, boxes, footers, however they are
named), and blocks of text beside it (headings, paragraphs, lists) stay. Inside, constant nodes are left out.

What alignment can't tell is taken from the page: tags that never hold an article's text (scripts, forms, ``nav``, ``footer``
and the like), and class, id or role words for what readers or advertisers add, as comments may vary and be as long as an
article. ``article`` and ``main`` end the way down, and where one is inside, content outside it is left out. A host with fewer
than MIN_PAGES different pages has no wrapper, and a page that doesn't hold its host's core isn't aligned: there, these marks
decide alone.

Every page counts: each task lays its pages over its own wrapper of their host; the tasks' wrappers of a host are merged in
rounds of MERGED at a time, so that a hot host never meets in one task. A wrapper of more than MAX_NODES nodes loses those on
at most one of WIDTH pages laid so far, by lossy counting: a node keeps how many pages it may have been missed on (at most
that share), so that a node on more pages is never cut, however many there are. Pages meet their host's wrapper by a join, which is a broadcast only while all wrappers
together have at most BROADCAST_BYTES.

Trees are DEPTH deep at most, as browsers' are: what is nested deeper is read in place as text and breaks of the node at that
depth, and none is lost.

Defined results: null or empty html gives the empty text; pages whose url is null or has no host share the host ""; repeated
pages are answered each, and count once a host; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, released
from .decontaminate import _arrow

MIN_PAGES, CONSTANT, MAX_NODES, MERGED = 5, 0.8, 400, 16
#: A wrapper of more than MAX_NODES nodes loses those on at most one of so many pages.
WIDTH = 50
BROADCAST_BYTES = 8 << 20
DEPTH, MINOR = 200, 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
#: Tags whose text is never an article's.
DROP = RAW | frozenset("head nav footer aside form button select option label fieldset menu dialog canvas object audio video map datalist input".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open paragraphs end where one of these begins.
ENDS_P = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id or role that mark what is not an article's text.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|topbar|foot\w*|side-?bar|aside|widget\w*|cookies?|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|"
    r"subscri\w*|sign-?up|login|comments?|commentlist|disqus|respond|replies|reply|discussion|share|sharing|social|related|recommend\w*|more-from|pagination|pager|tags?|search\w*|form|toolbar|skip\w*|copyright|legal|disclaimer|hidden|"
    r"complementary|contentinfo|navigation|alertdialog|teaser\w*|paywall)(?:$|[\s_-])",
    re.I,
)
MAIN = frozenset(("article", "main"))
#: Blocks of text, which stay where they stand beside the way to the core.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol dl li dt dd figure figcaption table caption br hr details summary".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """A tag or, with label "#", a stretch of text with its place in the page."""

    __slots__ = ("label", "tag", "children", "noise", "text", "place", "shape")

    def __init__(self, label: str, tag: str, noise: bool = False, text: str = "", place: int = 0):
        self.label, self.tag, self.noise, self.text, self.place, self.children, self.shape = label, tag, noise, text, place, [], None


def parse(source: str) -> Node:
    """The tree of a page; tags that are left open or close nothing are put right as browsers do."""
    root = Node("html", "html")
    stack, at, n = [root], 0, 0

    def add(node: Node) -> None:
        """Below the deepest level, elements leave only a break where they are blocks."""
        if len(stack) <= DEPTH:
            stack[-1].children.append(node)
            return
        node.noise |= len(stack) > DEPTH + 1 and stack[-1].noise
        if node.tag in BLOCK or node.tag == "br":
            stack[DEPTH - 1].children.append(Node("br", "br"))

    def close(i: int) -> None:
        """Closes the elements from the i-th on."""
        if any(x.tag in BLOCK for x in stack[max(i, DEPTH) :]):
            stack[DEPTH - 1].children.append(Node("br", "br"))
        del stack[i:]

    def text(raw: str) -> None:
        nonlocal n
        to = stack[min(len(stack), DEPTH) - 1]
        if raw and (raw.strip() or to.children) and not (len(stack) > DEPTH and stack[-1].noise):
            to.children.append(Node("#", "#", False, raw, n))
            n += 1

    while m := TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if tag := m[1]:
            tag = tag.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in BLOCK and tag not in BLOCK:
                    break
        elif tag := m[2]:
            tag = tag.lower()
            if tag in ("html", "body") and any(x.tag == tag for x in stack[1:]):
                continue
            inner = {"p"} if tag in ENDS_P else set()
            inner |= CLOSES.get(tag, set())
            if inner:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in inner:
                        close(i)
                        break
                    if stack[i].tag in BLOCK and stack[i].tag not in inner and stack[i].tag != "p":
                        break
            if tag == "body" and any(x.tag == "head" for x in stack):
                close(next(i for i, x in enumerate(stack) if x.tag == "head"))
            marks, hidden = [], False
            for a in ATTRIBUTE.finditer(m[3] or ""):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name in ("hidden", "aria-hidden"):
                    hidden |= name == "hidden" or value.lower() == "true"
                else:
                    marks.append(re.sub(r"\d+", "0", value))
            if hidden:
                marks.append("hidden")
            label = " ".join([tag, *marks])
            node = Node(label, tag, is_noise(label, stack[-1].tag))
            add(node)
            if tag in RAW and not (m[3] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(source, at)
                stop, at = (end.start(), end.end()) if end else (len(source), len(source))
                if tag == "title":
                    node.children.append(Node("#", "#", False, source[at:stop], n))
            elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
                stack.append(node)
    text(source[at:])
    return root


def is_noise(label: str, parent: str) -> bool:
    """Whether a tag, or the words of its class, id or role, say that it holds no article's text."""
    tag, _, marks = label.partition(" ")
    return tag in DROP or tag == "header" and parent == "body" or tag not in ("html", "body", "main") and bool(NOISE.search(marks))


def own_text(node: Node) -> str:
    """The whole text directly in a node, white space made one space."""
    return " ".join(" ".join(c.text for c in node.children if c.tag == "#").split())


def digest_of(text: str) -> str:
    """To compare texts between pages; "" if there is none."""
    return text and hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


#: A node is a list: label, pages, further pages that it may have been on uncounted, digest of its text (a page's: None if it
#: varies within the page; a finished wrapper's: the constant one), children, and characters of its own text on a page (a
#: finished wrapper's: those of all pages, if they vary). In a finished wrapper, MISSED is the node's ROLE.
LABEL, PAGES, MISSED, TEXT, CHILDREN, CHARS = range(6)
ROLE = MISSED
OUTSIDE, PATH, CONTENT = range(3)


def shape(node: Node) -> int:
    """A hash of what a node is built of: containers with their own shapes, blocks of text, links, and text, runs of alike parts once."""
    if node.shape is None:
        parts: list = []
        for c in node.children:
            if c.tag == "#" and not c.text.strip() or c.tag in RAW:
                continue
            part = "a" if c.tag == "a" else "#" if c.tag not in BLOCK else c.label if c.tag in TEXTUAL else (c.label, shape(c))
            if not parts or parts[-1] != part:
                parts.append(part)
        node.shape = hash(tuple(parts))
    return node.shape


def runs_of(node: Node) -> list[list[Node]]:
    """A node's elements; neighbours of one label make a run if they are blocks of text or of one shape."""
    out: list[list[Node]] = []
    for c in node.children:
        if c.tag == "#" or c.tag in RAW:
            continue
        last = out[-1][0] if out else None
        if last and last.label == c.label and (c.tag in TEXTUAL or shape(last) == shape(c)):
            out[-1].append(c)
        else:
            out.append([c])
    return out


def folded(node: Node) -> list:
    """A page's tree as a wrapper of one page."""
    children = []
    for first, *more in runs_of(node):
        one = folded(first)
        for c in more:
            one = laid(one, folded(c), repeated=True)
        children.append(one)
    text = own_text(node)
    return [node.label, 1, 0, digest_of(text), children, len(text)]


def match(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the pairs of the heaviest alignment.

    Only pairs of one label are looked at, in order; a Fenwick tree holds the heaviest alignment that ends before each place.
    """
    if [x[LABEL] for x in a] == [x[LABEL] for x in b]:
        return [(i, i) for i in range(len(a))]
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x[LABEL], []).append(j)
    heaviest: list[tuple | None] = [None] * (len(b) + 1)  # (weight, i, j, what stands before)
    for i, x in enumerate(a):
        for j in reversed(where.get(x[LABEL], ())):
            before, at = None, j
            while at:
                if heaviest[at] and (not before or heaviest[at][0] > before[0]):
                    before = heaviest[at]
                at -= at & -at
            one = (weight(x, b[j]) + (before[0] if before else 0), i, j, before)
            at = j + 1
            while at <= len(b):
                if not heaviest[at] or heaviest[at][0] < one[0]:
                    heaviest[at] = one
                at += at & -at
    last = max((x for x in heaviest if x), key=lambda x: (x[0], -x[1], -x[2]), default=None)
    pairs = []
    while last:
        pairs.append(last[1:3])
        last = last[3]
    return pairs[::-1]


def weight(a: list, b: list) -> int:
    """The number of nodes in the best matching of two trees whose roots match."""
    return 1 + sum(weight(a[CHILDREN][i], b[CHILDREN][j]) for i, j in match(a[CHILDREN], b[CHILDREN]))


def laid(a: list, b: list, repeated: bool = False) -> list:
    """Two wrappers as one. repeated: b is a further sibling on the same page, which makes its text a varying one."""
    return _laid(a, b, repeated, 0 if repeated else a[PAGES] // WIDTH, 0 if repeated else b[PAGES] // WIDTH)


def _laid(a: list, b: list, repeated: bool, lost_a: int, lost_b: int) -> list:
    """lost_a, lost_b: the most pages on which a node that the wrapper a or b doesn't hold can have been."""
    pairs = match(a[CHILDREN], b[CHILDREN])
    children, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[CHILDREN]), len(b[CHILDREN]))]:
        children += [missed(c, lost_b) for c in a[CHILDREN][i:x]] + [missed(c, lost_a) for c in b[CHILDREN][j:y]]
        if x < len(a[CHILDREN]):
            children.append(_laid(a[CHILDREN][x], b[CHILDREN][y], repeated, lost_a, lost_b))
        i, j = x + 1, y + 1
    if repeated:
        return [a[LABEL], a[PAGES], 0, a[TEXT] if a[TEXT] == b[TEXT] else None, children, a[CHARS] + b[CHARS]]
    return [a[LABEL], a[PAGES] + b[PAGES], a[MISSED] + b[MISSED], None, children, 0]


def missed(w: list, lost: int) -> list:
    return [w[LABEL], w[PAGES], w[MISSED] + lost, w[TEXT], [missed(c, lost) for c in w[CHILDREN]], w[CHARS]] if lost else w


def pruned(wrapper: list) -> list:
    """Without the nodes that are on at most one of WIDTH pages for certain, if there are more than MAX_NODES."""
    least = wrapper[PAGES] // WIDTH

    def size(w: list) -> int:
        return 1 + sum(map(size, w[CHILDREN]))

    def cut(w: list) -> list:
        return [*w[:CHILDREN], [cut(c) for c in w[CHILDREN] if c[PAGES] + c[MISSED] > least], w[CHARS]]

    return cut(wrapper) if least and size(wrapper) > MAX_NODES else wrapper


def nodes_of(wrapper: list):
    """The wrapper's nodes in a fixed order; a node's number is its place in it."""
    yield wrapper
    for c in wrapper[CHILDREN]:
        yield from nodes_of(c)


def numbered(raw: str) -> list:
    wrapper = json.loads(raw)
    for i, w in enumerate(nodes_of(wrapper)):
        w[PAGES] = i
    return wrapper


def finished(raw: str, counted: str) -> list:
    """A wrapper with its constant texts, varying characters and roles, from JSON."""
    wrapper, nodes = json.loads(raw), {x["node"]: x for x in json.loads(counted)}
    for i, w in enumerate(nodes_of(wrapper)):
        x = nodes.get(i, {})
        w[TEXT], w[CHARS], w[ROLE] = x.get("digest"), x.get("chars", 0), OUTSIDE
    decide(wrapper)
    return wrapper


def tag_of(w: list) -> str:
    return w[LABEL].partition(" ")[0]


def mass(w: list, parent: str = "") -> int:
    """The varying text of a wrapper's subtree outside links and noise."""
    tag = tag_of(w)
    return 0 if tag == "a" or is_noise(w[LABEL], parent) else w[CHARS] + sum(mass(c, tag) for c in w[CHILDREN])


def decide(wrapper: list) -> None:
    """Gives the nodes their roles: the way from the root to the core, and what is content."""
    now = wrapper
    while True:
        own = tag_of(now)
        heavy = [(mass(c, own), c) for c in now[CHILDREN]]
        most, best = max(heavy, key=lambda x: x[0], default=(0, None))
        of_blocks = best is not None and tag_of(best) not in TEXTUAL and (tag_of(best) in MAIN or any(tag_of(c) in BLOCK for c in best[CHILDREN]))
        rival = max([now[CHARS], *(m for m, c in heavy if c is not best and tag_of(c) not in TEXTUAL)], default=0)
        if own in MAIN or not most or not of_blocks or rival >= MINOR * most:
            now[ROLE] = CONTENT
            return
        now[ROLE] = PATH
        for _, c in heavy:
            if tag_of(c) in TEXTUAL:
                c[ROLE] = CONTENT
        now = best


def texts_at(page: list, wrapper: list):
    """(node number, digest, characters) of a page's nodes that match a numbered wrapper's."""
    yield wrapper[PAGES], page[TEXT], page[CHARS]
    for i, j in match(page[CHILDREN], wrapper[CHILDREN]):
        yield from texts_at(page[CHILDREN][i], wrapper[CHILDREN][j])


def template(node: Node, wrapper: list, constant: set[int], outside: set[int], role: int = PATH) -> bool:
    """Marks (by identity) the page's nodes whose own text the wrapper holds constant, and those outside its content; says whether the core is there."""
    if wrapper[TEXT] and digest_of(own_text(node)) == wrapper[TEXT]:
        constant.add(id(node))
    kids = runs_of(node)
    if [k[0].label for k in kids] == [w[LABEL] for w in wrapper[CHILDREN]]:
        pairs = [(i, i) for i in range(len(kids))]
    else:
        pairs = match([folded(k[0]) for k in kids], wrapper[CHILDREN])
    role = wrapper[ROLE] if role == PATH else role
    core, matched = role == CONTENT, set()
    for i, j in pairs:
        matched.add(i)
        w = wrapper[CHILDREN][j]
        for c in kids[i]:
            if role == PATH and w[ROLE] == OUTSIDE:
                outside.add(id(c))
            if role == CONTENT or w[ROLE] != OUTSIDE:
                found = template(c, w, constant, outside, CONTENT if role == CONTENT else PATH)
                core |= found and tag_of(w) not in TEXTUAL
    if role == PATH:
        outside.update(id(c) for i, k in enumerate(kids) if i not in matched and k[0].tag not in TEXTUAL for c in k)
    return core


def main_text(root: Node, constant: set[int], outside: set[int]) -> str:
    """The content's blocks in page order."""
    has_main: list[Node] = []

    def mains(node: Node) -> None:
        for c in node.children:
            if c.noise or id(c) in outside:
                continue
            if c.tag in MAIN:
                has_main.append(c)
            else:
                mains(c)

    mains(root)
    blocks: list[list[str]] = [[]]

    def walk(node: Node) -> None:
        for c in node.children:
            if c.tag == "#":
                if id(node) not in constant:
                    blocks[-1].append(c.text)
            elif c.noise or id(c) in outside:
                if c.tag in BLOCK:
                    blocks.append([])
            elif c.tag in BLOCK or c.tag == "br":
                blocks.append([])
                walk(c)
                blocks.append([])
            else:
                walk(c)

    for node in has_main or [root]:
        blocks.append([])
        walk(node)
        blocks.append([])
    done = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return " ".join(x for x in done if x)


def extract_page(source: str | None, wrapper: list | None) -> str:
    if not source:
        return ""
    root = parse(source)
    constant: set[int] = set()
    outside: set[int] = set()
    if wrapper is not None and not template(root, wrapper, constant, outside):
        outside = set()
    return main_text(root, constant, outside)


def deep() -> None:
    """Lets recursive walks reach DEPTH; a level takes a few frames."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper as JSON, its nodes' constant texts and varying characters as JSON) of hosts with enough pages, from rows (host, html)."""
    schema = "host string, turn long, wrapper string"

    def trees(batches):
        deep()
        seen: set[tuple] = set()
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source and (row := (host, hashlib.blake2b(source.encode(), digest_size=16).digest())) not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(row)
                    rows.append((*row, json.dumps(folded(parse(source)))))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.string()))], names=["host", "mark", "tree"])

    def induce(batches):
        deep()
        own: dict[str, list] = {}
        turn = TaskContext.get().partitionId() << 32
        for batch in batches:
            for host, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = json.loads(tree)
                own[host] = laid(own[host], one) if host in own else one
                if own[host][PAGES] % WIDTH == 0:
                    own[host] = pruned(own[host])
            if len(own) > 20_000:  # bounded memory where hosts are many
                yield out(own, turn)
                own, turn = {}, turn + 1
        if own:
            yield out(own, turn)

    def out(own: dict[str, list], turn: int):
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([turn] * len(own), pa.int64()), pa.array([json.dumps(w) for w in own.values()], pa.string())], names=["host", "turn", "wrapper"])

    def merge(key, table):
        deep()
        all_, merged = sorted(table.column("wrapper").to_pylist()), None
        for raw in all_:
            one = json.loads(raw)
            merged = one if merged is None else pruned(laid(merged, one))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "turn": pa.array([min(table.column("turn").to_pylist())], pa.int64()), "wrapper": pa.array([json.dumps(merged)], pa.string())})

    # Copies of a page don't make it template: each different page of a host counts once, wherever its copies lie.
    once = pages.mapInArrow(released(trees), "host string, mark binary, tree string").groupBy("host", "mark").agg(F.first("tree").alias("tree"))
    pages = scratch.keep(once.select("host", "tree"), "trees")
    now = scratch.keep(pages.mapInArrow(released(induce), schema), "wrappers")
    while (most := now.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        salt = F.pmod(F.xxhash64("turn"), F.lit(max(1, -(-most // MERGED))))
        now = scratch.keep(now.withColumn("salt", salt).groupBy("host", "salt").applyInArrow(merge, schema), "wrappers")
    now = now.select("host", "wrapper").where(F.get_json_object("wrapper", f"$[{PAGES}]").cast("long") >= MIN_PAGES)

    def count(batches):
        deep()
        known: dict[str, list] = {}
        counts: Counter = Counter()
        chars: Counter = Counter()
        for batch in batches:
            for host, tree, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = numbered(raw)
                for node, digest, size in texts_at(json.loads(tree), known[host]):
                    counts[host, node, digest] += 1
                    chars[host, node, digest] += size
            if len(counts) > 200_000:
                yield found(counts, chars)
                counts.clear()
                chars.clear()
        if counts:
            yield found(counts, chars)

    def found(counts: Counter, chars: Counter):
        columns = [*zip(*counts), tuple(counts.values()), tuple(chars[x] for x in counts)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["host", "node", "digest", "n", "chars"])

    both = pages.join(F.broadcast(now) if total(now) <= BROADCAST_BYTES else now, "host").select("host", "tree", "wrapper")
    texts = both.mapInArrow(released(count), "host string, node long, digest string, n long, chars long").groupBy("host", "node", "digest").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    nodes = texts.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "digest")).alias("top"), F.sum("chars").alias("chars"))
    same = (F.col("pages") >= MIN_PAGES) & (F.col("top.digest") != "") & (F.col("top.n") >= CONSTANT * F.col("pages"))
    counted = nodes.select("host", F.struct("node", F.when(same, F.col("top.digest")).alias("digest"), F.when(same, 0).otherwise(F.col("chars")).alias("chars")).alias("x"))
    counted = counted.where("x.digest is not null or x.chars > 0").groupBy("host").agg(F.to_json(F.array_sort(F.collect_list("x"))).alias("counted"))
    return scratch.keep(now.join(counted, "host").select("host", "wrapper", "counted"), "finished")


def total(made: DataFrame) -> int:
    return made.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]


def extract(pages: DataFrame, page_html: str = "html", url: str = "url", scratch: Scratch | None = None) -> DataFrame:
    """pages' columns but the html under ``doc``, and text."""
    scratch = scratch or Scratch(pages.sparkSession)
    names = [c for c in pages.columns if c != page_html]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page_html}`").alias("html"))
    made = wrappers(rows.select("host", "html"), scratch)
    both = rows.join(F.broadcast(made) if total(made) <= BROADCAST_BYTES else made, "host", "left").select("doc", "host", "html", "wrapper", "counted")
    schema = T.StructType([both.schema["doc"], T.StructField("text", T.StringType())])
    arrow = _arrow(schema)

    def run(batches):
        deep()
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for host, source, raw, counted in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if len(known) > 10_000:
                    known.clear()
                if raw is not None and host not in known:
                    known[host] = finished(raw, counted)
                texts.append(extract_page(source, known.get(host)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field("doc").type), pa.array(texts, pa.string())], schema=arrow)

    return both.mapInArrow(released(run), schema)
