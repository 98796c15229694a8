"""Main text of pages by wrapper induction.

Pages of a host share a template.  Up to ``PIVOTS`` different ones, the pivots,
are taken by hash; every different page of the host is aligned with each of them
by simple tree matching of DOM trees.  What the alignments say of each node of a
pivot is summed over all pages: on how many pages it stands, on how many with
equal text, how often it is marked, how much of its text is links.  From these
sums each node is judged once for the whole host:

* template: equal text on ``CONSTANT`` of the pages, outside marked articles;
* other parts: a slot whose nodes are mostly marked as something else (see below),
  or a slot outside articles that is nearly all links on every page: a menu;
* content: every other slot, whatever its text.

The pivot whose nodes stand on most pages gives the wrapper.  A page is aligned
with its host's wrapper, template and other parts are taken out, and all that is
left is its text.  So an unmarked advert goes where the host marks that slot on
most pages, and an article may be spread over siblings.

Marks.  Tree matching alone takes menus and adverts that differ from page to page
for content, so a slot's nodes say what they are: by their tag (nav, aside,
footer, forms, scripts; header outside articles), role, hidden state, or by the
names in class and id.  A name counts only if all its parts are known words
("cookie-notice", but not "social-history").  Within an article (article, main or
their roles) names other than those of comments count only where the wrapper shows the same
slot on half of the host's pages; text that all pages share there is still the
article's.  No mark takes out a node that holds an article.  Pages without a
wrapper, and nodes that align with none of its nodes, are judged by marks alone.

Defined results: null html is empty and gives an empty text; hosts with fewer than
two different pages have no wrapper; if a page has no text but the template's, it
keeps that; elements nested deeper than ``DEPTH`` are attached at that depth with
their text; of two trees the first ``CELLS`` cells of the matching tables are
computed exactly, and larger lists of children are paired in order; a tag that
does not end before the page does is text; repeated rows give equal texts and
count once; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import html as html_module
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import BROADCAST_ROWS, HEAVY_KEYS, join_one, map_batches, materialise, numbered, without_rows

PIVOTS, DEPTH, RUN, CELLS = 4, 256, 8, 1 << 18
#: Part of a host's different pages that a template's node is found in: a few odd pages do not undo it.
CONSTANT = (9, 10)
#: Links of a menu: at least so many, with this part of its characters.
MENU = (3, 8, 10)
#: Wrappers (or pivots) of all hosts together up to this many characters are broadcast; beyond, they are joined by shuffle.
BROADCAST_CHARS = 8 << 20

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+|\"[^\"]*+\"|'[^']*+'|.", re.DOTALL)
_QUOTE = re.compile(r"=\s*+([\"'])")
_PARTS = re.compile(r"[a-z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr dd dt li".split()) | frozenset(("dd", "dt", "li"))
#: Elements that hold no text of a page, and elements that say that they are no article.
NEVER = frozenset("script style noscript template head title button select option textarea iframe svg canvas object audio video input".split())
OTHER = frozenset("nav header aside footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements of running text: neighbours alike are one node for matching, whatever their number.
ITEMS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 a abbr b br code em font hr i img label mark q s small span strong sub sup time u".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
NAMES = COMMENTS | frozenset(
    "header masthead nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices newsletter subscribe popup modal share sharing social related recommended pagination pager toolbar login signup search widget skip".split()
)
BESIDE = frozenset("area bar block bottom box buttons container content form global inner left link links list main message outer page policy primary right secondary section site slot text thread top unit wrap wrapper".split())


class Node:
    __slots__ = ("tag", "names", "kids", "never", "sure", "named", "header", "comments", "main", "holds", "hash", "chars", "linked", "links")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.kids, self.names = tag, [], ""
        self.never, self.main = tag in NEVER, tag in ("article", "main")
        self.header = tag == "header"
        self.sure, self.named, self.comments = tag in OTHER, False, False
        if attributes and not attributes.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1]}
            role = found.get("role", "").lower().strip()
            self.main |= role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
            self.names = f"{found.get('class', '')} {found.get('id', '')}".lower().strip()
            if tag not in ("html", "body", "#root"):
                hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*+:\s*+none", found.get("style", "").lower())
                self.sure |= bool(hidden) or role in ROLES
                for name in self.names.split():
                    parts = set(_PARTS.findall(name))
                    known = {p for p in parts if not p.isdigit()}
                    if known & NAMES and known <= NAMES | BESIDE:
                        self.named = True
                        self.header |= not known.isdisjoint(("header", "masthead"))
                        self.comments |= bool(known & COMMENTS)


class _Tags:
    """The places where tags end, each found in time in proportion to its length."""

    def __init__(self, html: str) -> None:
        self.html, self.quotes, self.ended = html, True, False

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``, or -1."""
        if self.ended:
            return -1
        stop = self.html.find(">", at)
        if stop < 0:
            self.ended = True
            return -1
        low = at
        while self.quotes:
            quote = _QUOTE.search(self.html, low, stop)
            if not quote:
                return stop
            low = self.html.find(quote[1], quote.end()) + 1
            if not low:
                break
            if low > stop:
                stop = self.html.find(">", low)
                if stop < 0:
                    break
        # a quote without a partner, here or before the page's end: from now on quotes are like other characters
        self.quotes = False
        return self.html.find(">", at)


def parse(html: str | None) -> Node:
    """The page's tree, with the end tags that HTML leaves out put in."""
    html, root = html or "", Node("#root")
    stack, tags, held, at = [root], _Tags(html), 0, 0

    def close(tag: str, barrier: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in barrier:
                return

    while True:
        start = html.find("<", at)
        if start < 0:
            break
        follow = html[start + 1 : start + 2]
        if follow in ("!", "?"):
            comment, section = html.startswith("<!--", start), html.startswith("<![CDATA[", start)
            mark = "-->" if comment else "]]>" if section else ">"
            stop = html.find(mark, start + (4 if comment else 9 if section else 2))
            stop = len(html) if stop < 0 else stop
            if start > held:
                stack[-1].kids.append(html[held:start])
            if section:
                stack[-1].kids.append(html_module.escape(html[start + 9 : stop]))
            held = at = min(len(html), stop + len(mark))
            continue
        closing = follow == "/"
        name = None if tags.ended else _NAME.match(html, start + 1 + closing)
        stop = tags.end(name.end()) if name else -1
        if stop < 0:
            at = start + 1
            continue
        if start > held:
            stack[-1].kids.append(html[held:start])
        held = at = stop + 1
        tag, attributes = name[0].lower(), html[name.end() : stop]
        if closing:
            close(tag, frozenset(("table",)) if tag in BLOCK and tag != "table" else frozenset() if tag in BLOCK else BLOCK)
            continue
        if tag in CLOSES_P:
            close("p", BLOCK - {"p"})
        if tag == "li":
            close("li", frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            close("dt", frozenset(("dl",)))
            close("dd", frozenset(("dl",)))
        elif tag in ("td", "th"):
            close("td", frozenset(("tr", "table")))
            close("th", frozenset(("tr", "table")))
        elif tag in ("tr", "tbody", "thead", "tfoot"):
            close("tr", frozenset(("table",)))
        elif tag == "option":
            close("option", frozenset(("select",)))
        node = Node(tag, attributes)
        stack[-1].kids.append(node)
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(html, at)
            stop = ends.start() if ends else len(html)
            if stop > at:
                node.kids.append(html[at:stop])
            held = at = stop
            if ends:
                held = at = html.find(">", stop) + 1 or len(html)
        elif tag not in VOID and not attributes.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    if len(html) > held:
        stack[-1].kids.append(html[held:])
    return _measured(root)


def _measured(root: Node) -> Node:
    """Adds to every node: checksum of its text, if it holds an article, characters, those in links, and links."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in node.kids if isinstance(k, Node))
    for node in reversed(order):
        value, node.chars, node.linked, node.links, node.holds = 0, 0, 0, 0, node.main or node.tag == "h1"
        for kid in () if node.never else node.kids:
            if isinstance(kid, str):
                text = " ".join(kid.split())
                if text:
                    value = zlib.crc32(text.encode("utf-8", "replace"), value)
                    node.chars += len(text)
            else:
                value = zlib.crc32(kid.hash.to_bytes(4, "little"), value) if kid.hash else value
                node.chars, node.linked, node.links = node.chars + kid.chars, node.linked + kid.linked, node.links + kid.links
                node.holds |= kid.holds
        node.hash = value
        if node.tag == "a":
            node.linked, node.links = node.chars, node.links + 1
    return root


def marked(node: Node, within: bool) -> bool:
    """If a node says that it is no article, by its own marks; ``within`` an article a header belongs to it."""
    return (node.sure or node.named) and not (within and node.header)


def excused(node: Node) -> bool:
    """If marks cannot take the node out: it holds an article or its heading, as forms around whole pages do."""
    return node.holds and node.tag not in ("nav", "aside", "footer", "menu", "header") and not node.comments


class Part:
    """A node for matching: one element, or a run of elements alike."""

    __slots__ = ("tag", "names", "nodes", "kids", "hash", "within", "number", "verdict", "members", "says")

    def __init__(self, nodes: list[Node], within: bool) -> None:
        self.tag, self.names, self.nodes, self.kids, self.within = nodes[0].tag, nodes[0].names, nodes, [], within
        self.says: tuple[int, ...] | None = None
        self.hash = nodes[0].hash if len(nodes) == 1 else zlib.crc32(b"".join(n.hash.to_bytes(4, "little") for n in nodes))


def fold(root: Node) -> Part:
    """A page's tree for matching."""
    top = Part([root], False)
    todo = [top]
    while todo:
        part = todo.pop()
        within = part.within or part.nodes[0].main
        runs: list[list[Node]] = []
        for node in part.nodes:
            for kid in node.kids:
                if isinstance(kid, str) or kid.never:
                    continue
                if runs and runs[-1][0].tag == kid.tag and runs[-1][0].names == kid.names:
                    runs[-1].append(kid)
                else:
                    runs.append([kid])
        for run in runs:
            whole = run[0].tag in ITEMS or len(run) > RUN
            for nodes in [run] if whole else [[n] for n in run]:
                made = Part(nodes, within)
                part.kids.append(made)
                if not whole or any(isinstance(k, Node) and k.tag not in ITEMS and not k.never for n in nodes for k in n.kids):
                    todo.append(made)
    return top


def match_trees(a: Part, b: Part, budget: list[int] | None = None) -> tuple[int, list[tuple[Part, Part]]]:
    """Simple tree matching: the weight of the heaviest top-down, order-keeping match, and its pairs.

    A pair of one tag weighs 1, and 2 if the names agree too.
    """
    if a.tag != b.tag:
        return 0, []
    budget = [CELLS] if budget is None else budget
    own = 1 + (a.names == b.names)
    left, right = a.kids, b.kids
    if len(left) * len(right) > budget[0]:
        total, pairs = own, [(a, b)]
        for x, y in _in_order(left, right):
            weight, found = match_trees(x, y, budget)
            total, pairs = total + weight, pairs + found
        return total, pairs
    budget[0] -= len(left) * len(right)
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(left):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(right):
            value = above[j + 1] if above[j + 1] > row[j] else row[j]
            if x.tag == y.tag:
                found[i, j] = match_trees(x, y, budget)
                value = max(value, above[j] + found[i, j][0])
            row[j + 1] = value
    pairs, i, j = [(a, b)], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += found[i, j][1]
    return best[-1][-1] + own, pairs


def _in_order(left: list[Part], right: list[Part]) -> Iterator[tuple[Part, Part]]:
    """The k-th child of a tag and name with the k-th such child on the other side."""
    waiting: dict[tuple[str, str], list[Part]] = {}
    for y in reversed(right):
        waiting.setdefault((y.tag, y.names), []).append(y)
    for x in left:
        same = waiting.get((x.tag, x.names))
        if same:
            yield x, same.pop()


def _parts(tree: Part) -> list[Part]:
    """All parts of a tree, in one order for equal trees."""
    out, todo = [], [tree]
    while todo:
        part = todo.pop()
        out.append(part)
        todo.extend(part.kids)
    return out


#: What is summed of each part of a pivot, over the pages aligned with it.
SUMS = ("pages", "same", "marked", "inside", "chars", "linked", "links")


@lru_cache(maxsize=256)
def _pivot(html: str) -> tuple[Part, list[int]]:
    """A pivot's tree with numbered parts, and where the numbers of each part's members begin."""
    tree = fold(parse(html))
    parts = _parts(tree)
    starts, number = [], len(parts)
    for k, part in enumerate(parts):
        part.number = k
        starts.append(number)
        number += len(part.nodes) if len(part.nodes) > 1 else 0
    return tree, starts


def observe(pivot: str, page: Part, sums: dict[int, list[int]]) -> None:
    """Add what one page says of the parts of a pivot; members of a run count only how often they stand there equal."""
    tree, starts = _pivot(pivot)
    for known, found in match_trees(tree, page)[1]:
        held = sums.setdefault(known.number, [0] * len(SUMS))
        if found.says is None:  # the same for every pivot
            nodes, within = found.nodes, found.within
            says = all([marked(n, within) and not excused(n) for n in nodes])
            found.says = says, within or any([n.holds for n in nodes]), sum([n.chars for n in nodes]), sum([n.linked for n in nodes]), sum([n.links for n in nodes])
        held[0] += 1
        held[1] += known.hash == found.hash
        for k, value in enumerate(found.says, 2):
            held[k] += value
        if len(known.nodes) > 1:
            here = {n.hash for n in found.nodes}
            for k, node in enumerate(known.nodes):
                if node.hash in here:
                    sums.setdefault(starts[known.number] + k, [0] * len(SUMS))[1] += 1


def induced(pivot: str, sums: dict[int, list[int]]) -> tuple[int, str]:
    """(parts that stand on most pages, wrapper as JSON) of one pivot."""
    tree, starts = _pivot(pivot)
    parts, every = _parts(tree), sums[0][0]
    many, of = CONSTANT
    constant = lambda n: n * of >= every * many
    most = max((sums[p.number][4] for p in parts if p.number in sums and not p.kids), default=0)
    for part in parts:
        pages, same, says, inside, chars, linked, links = sums.get(part.number, [0] * len(SUMS))
        outside, part.verdict, part.members = 2 * inside <= pages, "content", []
        if 2 * says > pages and 2 * pages >= every and (outside or pages > 2):
            part.verdict = "other"
        elif outside and part.tag not in ("#root", "html", "body"):
            if constant(same):
                part.verdict = "template"
            elif links >= MENU[0] * pages > 0 and linked * MENU[2] >= chars * MENU[1] and chars < most:
                part.verdict = "other"
            elif len(part.nodes) > 1:
                base = starts[part.number]
                part.members = sorted({n.hash for k, n in enumerate(part.nodes) if constant(sums.get(base + k, [0, 0])[1])})
    plain = lambda p: [p.tag, p.names, p.verdict, p.hash, p.members, [plain(k) for k in p.kids]]
    return sum(2 * sums[p.number][0] >= every for p in parts if p.number in sums), json.dumps(plain(tree), separators=(",", ":"))


def induce(pages: list[str]) -> str | None:
    """The wrapper of one host's pages, or None for fewer than two different ones."""
    distinct = list(dict.fromkeys(pages))
    if len(distinct) < 2:
        return None
    made = []
    for pivot in distinct[:PIVOTS]:
        sums: dict[int, list[int]] = {}
        for page in distinct:
            observe(pivot, fold(parse(page)), sums)
        made.append(induced(pivot, sums))
    return max(made, key=lambda m: m[0])[1]


@lru_cache(maxsize=256)
def _wrapper(text: str) -> Part:
    def built(plain: list) -> Part:
        part = Part.__new__(Part)
        part.tag, part.names, part.verdict, part.hash, part.members, kids = plain
        part.kids = [built(k) for k in kids]
        return part

    return built(json.loads(text))


def judged(html: str | None, wrapper: str | None = None) -> tuple[str, int]:
    """(main text, number of elements that the wrapper took out) of one page."""
    root = parse(html)
    other: set[int] = set()
    template: set[int] = set()
    if wrapper:
        for known, found in match_trees(_wrapper(wrapper), fold(root))[1]:
            if known.verdict == "other":
                other.update(id(n) for n in found.nodes if not n.main and not n.holds)
            elif not found.within and not any(n.holds for n in found.nodes):
                if known.verdict == "template" and known.hash == found.hash:
                    template.update(map(id, found.nodes))
                elif known.members:
                    template.update(id(n) for n in found.nodes if n.hash in known.members)
    text = _text(root, other | template)
    if not text and template:
        text, template = _text(root, other), set()
    return text, len(other) + len(template)


def extract(html: str | None, wrapper: str | None = None) -> str:
    """The main text of one page."""
    return judged(html, wrapper)[0]


def _text(root: Node, out: set[int]) -> str:
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html_module.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(text)

    todo: list = [(root, True, False)]
    while todo:
        node, enters, within = todo.pop()
        if isinstance(node, str):
            held.append(node)
        elif not enters:
            flush()
        elif node.never or id(node) in out or (node.comments or (node.sure if within else marked(node, within)) and not (within and node.header)) and not excused(node):
            if node.tag in BLOCK:
                flush()
        elif node.tag == "br":
            held.append(" ")
        else:
            if node.tag in BLOCK:
                flush()
                todo.append((node, False, within))
            inner = within or node.main
            todo.extend((k, True, inner) for k in reversed(node.kids))
    flush()
    return "\n".join(blocks)


def _dealt(rows: DataFrame, one: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with the row of ``one`` of their host (or none); hosts of many pages are dealt to several tasks.

    ``sizes`` (host, pages): only hosts above a limit that at most ``HEAVY_KEYS``
    hosts exceed are dealt, so their list may be broadcast.
    """
    total = sizes.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    limit = max(4096, -(-total // HEAVY_KEYS))
    heavy = materialise(sizes.where(F.col("pages") > limit).select("host", F.ceil(F.col("pages") / limit).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(F.broadcast(heavy), "host", "left").withColumn("salt", F.pmod(F.xxhash64("html"), salts).cast("int")).drop("salts")
    right = one.join(F.broadcast(heavy), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, ["host", "salt"], "left").drop("salt")


def induce_wrappers(named: DataFrame, file: str, place: str) -> DataFrame:
    """(host, wrapper) from ``numbered`` rows with host and html, for hosts that have one.

    Copies of a page are found by their hash, and only pivots move.
    """
    rows = named.where("html IS NOT NULL AND host <> ''").select("host", "html", F.col(file).alias("file"), F.col(place).alias("place"))
    keys = rows.select("host", F.xxhash64("html", F.lit(11)).alias("draw"), "file", "place")
    groups = materialise(keys.groupBy("host", "draw").agg(F.min(F.struct("file", "place")).alias("first"), F.count(F.lit(1)).alias("copies")))
    again = join_one(keys, groups.where("copies > 1"), ["host", "draw"], "copies", keys.count()).where("file <> first.file OR place <> first.place").select("file", "place")
    different = without_rows(rows, "file", "place", materialise(again))
    order = Window.partitionBy("host").orderBy("draw")
    # the limit on row_number is applied in each task before anything is shuffled
    drawn = materialise(groups.withColumn("pivot", F.row_number().over(order)).where(F.col("pivot") <= PIVOTS).select("first.file", "first.place", "pivot"))
    chosen = rows.join(F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn, ["file", "place"])
    pivots = materialise(chosen.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pivot", "html"))).alias("pivots")).where(F.size("pivots") > 1))
    size = pivots.agg(F.sum(F.aggregate("pivots", F.lit(0).cast("long"), lambda s, p: s + F.length(p["html"])))).first()[0] or 0
    spark = named.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], dict[int, list[int]]] = {}
            hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given = [shared.value.get(h) for h in hosts] if shared else [p and [x["html"] for x in p] for p in batch.column(2).to_pylist()]
            for host, html, known in zip(hosts, pages, given, strict=True):
                if known:
                    page = fold(parse(html))
                    for k, pivot in enumerate(known):
                        observe(pivot, page, sums.setdefault((host, k), {}))
            made = [(host, k, number, *held) for (host, k), parts in sums.items() for number, held in parts.items()]
            types = [pa.string(), pa.int32(), pa.int64(), *[pa.int64()] * len(SUMS)]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], ["host", "pivot", "part", *SUMS])

    schema = "host string, pivot int, part long, " + ", ".join(f"{s} long" for s in SUMS)
    if size <= BROADCAST_CHARS:
        shared = spark.sparkContext.broadcast({r["host"]: [p["html"] for p in r["pivots"]] for r in pivots.collect()})
        counted = map_batches(different.select("host", "html"), count, schema)
    else:
        shared = None
        counted = map_batches(_dealt(different.select("host", "html"), pivots, groups.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))).select("host", "html", "pivots"), count, schema)
    # sums are added in each task first, so a host of any size gives a few rows a task
    sums = counted.groupBy("host", "pivot", "part").agg(*[F.sum(s).alias(s) for s in SUMS])

    # a few numbers for each part of four pages: no more than these pages' size bounds
    bounded = sums.groupBy("host").agg(F.collect_list(F.struct("pivot", "part", *SUMS)).alias("sums")).join(pivots, "host")

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for sums, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found: dict[int, dict[int, list[int]]] = {}
                for held in sums:
                    found.setdefault(held["pivot"], {})[held["part"]] = [held[s] for s in SUMS]
                made.append(max((induced(known[k]["html"], found[k]) for k in sorted(found)), key=lambda m: m[0])[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "wrapper"])

    return map_batches(bounded.select("host", "sums", "pivots"), wrap, "host string, wrapper string")


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and wrapped (elements that the wrapper took out) for every page."""
    named, file, place = numbered(pages, "pages")
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    rows = named.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"),
        F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).alias("host"), F.col(file).alias("file"), F.col(place).alias("place"),
    )
    wrappers = materialise(induce_wrappers(rows, "file", "place"))
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    shared = pages.sparkSession.sparkContext.broadcast(dict(map(tuple, wrappers.collect()))) if size <= BROADCAST_CHARS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = (shared.value.get(h) for h in batch.column(3).to_pylist()) if shared else batch.column(3).to_pylist()
            found = [judged(h.as_py(), w) for h, w in zip(batch.column(2), known, strict=True)]
            texts = [f[0] for f in found]
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_chars", "wrapped"])

    if shared is None:
        rows = _dealt(rows, wrappers, rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    return map_batches(rows.select("page_id", "url", "html", "host" if shared else "wrapper"), run, "page_id long, url string, text string, n_chars long, wrapped long")
