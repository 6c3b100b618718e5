"""Main text of web pages by consensus host paths.

Every page scores its containers and votes for the generalised path of the best one; the votes of a
host choose a path, and all its pages are extracted again by that path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, read_table
from .urls import host_of

#: A quote holds `>` where it follows `=` and is closed; in other places it is a character like others.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: For pages with a tag that never ends: there a quote holds no `<` either, so each look ends at the next one.
_TAG_BROKEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=<]++|=\s*+(?:"[^"<]*+"|'[^'<]*+')?+)*+)>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: A path with this share of a host's votes is one of its templates; there are 1 / TEMPLATE_SHARE at most.
TEMPLATE_SHARE = 0.25
#: A page takes a template of its host only if that has this share of the running text by which its own best
#: container exceeds BOX_CHARS: a longer one is hardly a box beside a short article.
COMPARABLE, BOX_CHARS = 0.25, 500
#: Loosely named elements of an article (`related-work`) stay from this share of the page's running text on.
LOOSE_SHARE = 0.125
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup: all up to the end tag belongs to them.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center details div dd fieldset figure hgroup html li main ol section table tbody td tr ul dl".split())
#: Elements that are never part of an article.
DROP_TAGS = frozenset("head script style noscript nav footer aside form button select option textarea input iframe object embed svg canvas template dialog menu search title noembed noframes xmp audio video map".split())
DROP_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus dropdown "
    "footer footnav gdpr header hidden login masthead menu modal nav navbar navigation navi newsletter notice notices overlay pager pagination paywall popup promo promoted "
    "promotion recommended related replies reply respond rss search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar "
    "widget widgets".split()
)
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
#: Of these, a wrapper round the article may be named too (`with-sidebar`): an article element in it is kept.
LAYOUT_WORDS = frozenset("ad ads banner footer header menu modal nav navbar sidebar widget widgets".split())
#: Words before which another word of a class says what the page has, or has not, not what the element is.
OTHERS_WORDS = frozenset("has have hide hides no non not show shows with without".split())
#: Text of these is dropped for a class only if all its words speak of it: `notice-box`, not `notice-board`.
PARAGRAPH = frozenset("blockquote caption cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 li p pre q span strong td th".split())
SIDE_WORDS = frozenset("area bar block body bottom box button buttons center content container form group inner item items left line link links list main outer page panel right row section site slot small text title top wrap wrapper".split())
#: Words that are said of other things too, when another noun follows: `share-price`, `related-work`.
ORDINARY_WORDS = frozenset("ad banner footer header hidden menu notice notices promotion recommended related replies reply respond search share sharing skip social sponsor sponsored subscription".split())
#: Nouns that follow them in lists of links and in tools: `related-posts`, `share-icons`.
FEED_WORDS = frozenset("article articles bars content contents form icon icons image images logo news option options page pages post posts product products reading results stories story tags tool tools topic topics video videos".split())
#: A start tag of the key ends an open element of these, up to one of the fence.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


KEPT, LAYOUT, SOFT, HARD = range(4)


class Node:
    """An element. step: its tag and classes without digits; own: why it is no part of an article itself
    (LAYOUT: words that a wrapper may have too; SOFT: other words, or a form; HARD: anything else);
    state: the same with what is round it; cause: the outermost element that is dropped for itself; loose: dropped
    for a word that may mean something else, in an article; story: whether it is an article or main element, or in
    one; home: the nearest block or dropped element, box: the nearest container, itself included."""

    __slots__ = ("box", "cause", "good", "hash", "home", "home_at", "lifted", "liftable", "loose", "own", "parent", "score", "state", "step", "story", "tag")

    def __init__(self, tag: str, parent: Node | None, own: int = KEPT, step: str = "", good: bool = False, liftable: bool = False, loose: bool = False) -> None:
        self.tag, self.parent, self.own, self.step, self.good, self.liftable, self.loose = tag, parent, own, step, good, liftable, loose
        self.story = tag in ("article", "main") or (parent is not None and parent.story)
        self.score, self.lifted, self.state = 0.0, False, KEPT
        self.home: Node = self
        self.box: Node = self if parent is None or tag in CONTAINER else parent.box
        self.cause: Node | None = None
        self.home_at = 0
        # Of the path's text; html and body are often left out, and mean nothing.
        self.hash = parent.hash if parent else xxhash.xxh64()
        if parent and tag not in ("html", "body"):
            self.hash = self.hash.copy()
            self.hash.update(f">{step}".encode("utf-8", "surrogatepass"))

    @property
    def drop(self) -> bool:
        return self.state != KEPT

    def settle(self) -> None:
        """`state`, of the parent's."""
        above = self.parent.state if self.parent else KEPT
        own = KEPT if self.lifted else self.own
        if own == KEPT and above == LAYOUT and self.tag in ("article", "main"):
            above = KEPT
        self.state = max(above, own)
        before = self.parent.cause if self.parent and above != KEPT else None
        self.cause = before or (self if own != KEPT else None)

    @property
    def path(self) -> str:
        steps, node = [], self
        while node is not None and node.parent is not None:
            if node.tag not in ("html", "body"):
                steps.append(f">{node.step}")
            node = node.parent
        return "".join(reversed(steps))


@dataclass
class Block:
    node: Node
    text: str
    link_chars: int


def _attributes(said: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(said)}


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w]


@lru_cache(maxsize=2048)
def _drop_words(value: str, strict: bool) -> frozenset[str]:
    """The words of DROP_WORDS that classes or an id say an element is."""
    out: set[str] = set()
    for one in value.split():
        words = _words(one)
        if strict and not all(w in DROP_WORDS or w in SIDE_WORDS or w in OTHERS_WORDS for w in words):
            continue
        out.update(w for i, w in enumerate(words) if w in DROP_WORDS and not OTHERS_WORDS.intersection(words[:i]))
    return frozenset(out)


@lru_cache(maxsize=2048)
def _ordinary(value: str) -> bool:
    """Whether each class or id with a word of DROP_WORDS has only ordinary ones, and another noun last."""
    for one in value.split():
        words = _words(one)
        if DROP_WORDS.intersection(words) and not (ORDINARY_WORDS.issuperset(DROP_WORDS.intersection(words)) and words[-1] not in DROP_WORDS | SIDE_WORDS | FEED_WORDS):
            return False
    return True


def _node(tag: str, said: str, parent: Node) -> Node:
    found = _attributes(said) if said.strip(" /\n\t\r") else {}
    if tag in ("html", "body"):
        return Node(tag, parent, step=tag)
    names, role = found.get("class", ""), found.get("role", "").lower()
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in names.split()})
    inside = parent.story or parent.good
    named = _drop_words(names, tag in PARAGRAPH) | _drop_words(found.get("id", ""), tag in PARAGRAPH)
    if inside:
        named = named - {"header"}  # the article's own heading
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    own = KEPT
    if hidden or (tag in DROP_TAGS and tag != "form") or (tag == "header" and not inside) or role in DROP_ROLES - {"form"}:
        own = HARD
    elif named - LAYOUT_WORDS or tag == "form" or role == "form":
        own = SOFT
    elif named:
        own = LAYOUT
    good = tag in ("article", "main") or bool(GOOD_WORDS.intersection(_words(names) + _words(found.get("id", ""))))
    # A form, or a name that says more than that it is to be dropped, may be the page's own wrapper.
    only = _drop_words(names, True) | _drop_words(found.get("id", ""), True)
    liftable = own in (SOFT, LAYOUT) and (not named or (named <= LAYOUT_WORDS - {"ad", "ads"} and not only))
    loose = bool(named) and inside and own in (SOFT, LAYOUT) and tag != "form" and role != "form" and _ordinary(names) and _ordinary(found.get("id", ""))
    return Node(tag, parent, own, ".".join([tag, *classes]), good, liftable, loose)


def parse(page: str) -> list[Block]:
    """The blocks of text of a page in order, those to be dropped included. Unclosed, crossed and
    stray tags are taken as browsers take them, more or less; inline tags leave no trace. The time is
    in proportion to the page's length, however deep it nests and whatever it leaves open."""
    root = Node("", None)
    stack = [root]
    nodes = [root]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    walls: list[int] = []  # of the open blocks
    blocks: list[Block] = []
    held: list[str] = []
    links: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append(Block(stack[-1].home, text, len("".join(links))))
            held.clear()
            links.clear()

    def add(text: str) -> None:
        held.append(text)
        if any(n.tag == "a" for n in stack[-4:]):
            links.append(text)

    def cut(index: int) -> None:
        for node in stack[index:]:
            places[node.tag].pop()
        del stack[index:]
        while walls and walls[-1] >= index:
            walls.pop()

    def last(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, end, whole = 0, len(page), _TAG
    last_close = page.rfind(">")
    while at < end:
        start = page.find("<", at)
        if start < 0 or start > last_close:
            if page.startswith("<!--", start) and start >= 0:
                add(page[at:start])
            else:
                add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        name = _NAME.match(page, start)
        if name is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
            else:
                add("<")
                at = start + 1
            continue
        m = whole.match(page, start)
        if m is None and whole is _TAG:
            whole = _TAG_BROKEN
            m = whole.match(page, start)
        at = m.end() if m else page.find(">", start) + 1
        tag = name[1].lower()
        if page[start + 1] == "/":
            index = last({tag})
            if index and (tag in BLOCK or not walls or walls[-1] < index):
                if stack[-1].home_at >= index:
                    flush()
                cut(index)
            continue
        said = m[3] if m else page[name.end() : at - 1]
        if tag in BLOCK:
            flush()
            if (index := last({"p"})) and walls[-1] == index:  # a block ends an open paragraph
                cut(index)
            if tag in _ENDS:
                ended, fence = _ENDS[tag]
                if (index := last(ended)) > last(fence):
                    cut(index)
        if tag in VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        node = _node(tag, said, stack[-1])
        node.settle()
        if node.drop and not stack[-1].drop:
            flush()
        if tag in BLOCK or node.drop:
            node.home_at = len(stack)
        else:
            node.home, node.home_at = stack[-1].home, stack[-1].home_at
        if tag in BLOCK:
            walls.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        nodes.append(node)
    flush()
    _keep_loose(nodes, blocks)
    _lift(nodes, blocks)
    return blocks


def _running(block: Block) -> int:
    """Characters that count as running text: those outside links, less as many as are in links."""
    return max(0, len(block.text) - 2 * block.link_chars)


def _keep_loose(nodes: list[Node], blocks: list[Block]) -> None:
    """Loosely named elements of an article that hold a good part of the page's text are taken for parts of
    it: `related-work`, `share-price`. What is hardly running text, or little, stays dropped."""
    for _ in range(8):
        kept, of, links = 0, {}, {}
        for b in blocks:
            cause = b.node.cause
            if not b.node.drop:
                kept += _running(b)
            elif cause is not None and cause.loose:
                of[cause] = of.get(cause, 0) + _running(b)
                links[cause] = links.get(cause, 0) + b.link_chars
        least = LOOSE_SHARE * (kept + sum(of.values()))
        found = [n for n, chars in of.items() if chars >= least and chars > 3 * links[n]]
        if not found:
            return
        for node in found:
            node.lifted = True
        for node in nodes:
            node.settle()


def _lift(nodes: list[Node], blocks: list[Block]) -> None:
    """A form, or an element like `sidebar-layout`, round all that a page says is no part to be dropped: where
    next to nothing is kept, the one that holds the most is taken for the page's own wrapper."""
    for _ in range(8):
        kept, of = 0, {}
        for b in blocks:
            chars = _running(b)
            if not b.node.drop:
                kept += chars
                continue
            cause = b.node.cause
            if cause is not None and cause.liftable:
                of[cause] = of.get(cause, 0) + chars
        if not of:
            return
        wrapper = max(of, key=lambda n: of[n])
        if of[wrapper] <= 20 * kept:
            return
        wrapper.lifted = True
        for node in nodes:
            node.settle()


def best_container(blocks: list[Block]) -> Node | None:
    """The container with the most text of its own kind: each kept block counts its characters
    outside links for its container, half for the one above, and so on. The article or main element
    round the winner is taken instead, if there is one. None if there is no kept text."""
    scored: dict[int, Node] = {}
    for b in blocks:
        if b.node.drop:
            continue
        worth = _running(b) + 1
        node: Node | None = b.node.box
        while node is not None and worth > 1e-9:  # beyond, halves of halves tell nothing
            node.score += worth * (1.5 if node.good else 1.0)
            scored[id(node)] = node
            worth *= 0.5
            node = _container_above(node)
    if not scored:
        return None
    best = max(scored.values(), key=lambda n: n.score)
    node, above = best, None
    while node is not None:
        if node.tag in ("article", "main"):
            above = node
            if node.tag == "article":
                break
        node = node.parent
    return above if above is not None else _with_rest(best, blocks)


def _container_above(node: Node) -> Node | None:
    return node.parent.box if node.parent is not None else None


def _with_rest(best: Node, blocks: list[Block]) -> Node:
    """`best`, or the container above while that adds running text: a sixth of what is there or more, of
    paragraphs and headings that are hardly links. Of what is not of the page's own containers, right under
    the body, it must be a third: other text than an article's is likelier there."""
    for _ in range(8):
        above = _container_above(best)
        if above is None:
            return best
        outmost = above.parent is None or above.tag in ("html", "body")
        here, more, seen = 0, 0, {}
        for b in blocks:
            if not b.node.drop and b.link_chars * 4 < len(b.text) and _below(b.node, above, seen):
                if _below(b.node, best, seen):
                    here += len(b.text)
                elif b.node.tag in PARAGRAPH:
                    more += len(b.text)
        if more * (3 if outmost else 6) < here or not more:
            return best
        best = above
        if outmost:
            return best
    return best


def _below(node: Node, top: Node, seen: dict[tuple[int, int], bool]) -> bool:
    """Whether `node` is `top` or in it; each element is asked once."""
    passed, now, found = [], node, False
    while now is not None:
        if now is top:
            found = True
            break
        if (known := seen.get((id(now), id(top)))) is not None:
            found = known
            break
        passed.append(now)
        now = now.parent
    for n in passed:
        seen[id(n), id(top)] = found
    return found


#: The hash of the path of body.
_WHOLE = xxhash.xxh64().intdigest()


def _blocks_in(blocks: list[Block], path: int) -> list[Block]:
    """Kept blocks in containers whose path has the hash `path`. Where that is the whole page, elements other
    than paragraphs and headings that are hardly more than links are left out."""
    inside: dict[int, bool] = {}
    out = []
    whole = path == _WHOLE
    for b in blocks:
        if b.node.drop or (whole and b.node.tag in CONTAINER - PARAGRAPH - {"body", "html"} and b.link_chars * 4 > len(b.text) * 3):
            continue
        passed, node, found = [], b.node, False
        while node is not None:
            if id(node) in inside:
                found = inside[id(node)]
                break
            if node.hash.intdigest() == path and (node.tag in CONTAINER or node.parent is None):
                found = inside[id(node)] = True
                break
            passed.append(node)
            node = node.parent
        inside.update((id(n), found) for n in passed)
        if found:
            out.append(b)
    return out


def extract(page: str | None, paths: str | Sequence[str] | None = None) -> str:
    """The main text of a page: its kept blocks, joined by empty lines, inside containers of one of the
    generalised `paths`: that of the page's own best container if it is among them, else the first that has
    a COMPARABLE amount of running text there. Without such (a template that few pages of the host have),
    inside containers of the page's own best path."""
    blocks = parse(page or "")
    best = best_container(blocks)
    if best is None:
        return ""
    own = best.hash.intdigest()
    found = _blocks_in(blocks, own)
    hashes = [xxhash.xxh64(p.encode("utf-8", "surrogatepass")).intdigest() for p in ([paths] if isinstance(paths, str) else paths or ())]
    if own not in hashes:
        least = COMPARABLE * (sum(_running(b) for b in found) - BOX_CHARS)
        theirs = (_blocks_in(blocks, path) for path in hashes)
        found = next((f for f in theirs if f and sum(_running(b) for b in f) >= least), found)
    return "\n\n".join(b.text for b in found)


def vote(page: str | None) -> tuple[str | None, float]:
    """The generalised path of a page's best container, and its score."""
    best = best_container(parse(page or ""))
    return (None, 0.0) if best is None else (best.path, best.score)


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """`host` and its `paths`: those that at least a TEMPLATE_SHARE of its pages vote for (as many as its
    templates), and always that of the most votes; more votes first, of equal votes the higher score, then
    the later path. Pages without text do not vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64())], names=["host", "path", "score"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page"))
    votes = rows.mapInArrow(run, "host string, path string, score double").filter("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))
    counted = materialize(counted, "html-votes")
    of_host = counted.groupBy("host").agg(F.sum("n").alias("all"), F.max(F.struct("n", "score", "path"))["path"].alias("most"))
    chosen = counted.join(of_host, "host").filter((F.col("n") >= TEMPLATE_SHARE * F.col("all")) | (F.col("path") == F.col("most")))
    ranked = F.sort_array(F.collect_list(F.struct("n", "score", "path")), asc=False)
    return chosen.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract_text(pages: DataFrame, keep: list[str], url: str = "url", page: str = "html") -> DataFrame:
    """`keep` columns of every row of `pages`, with its main `text` and the number of its code
    points, `n_chars`.

    Null and empty pages give an empty text; null urls and urls without a host vote together.
    Repeated rows each give theirs; an empty table gives an empty result. `keep` may not hold
    `text` or `n_chars`. Host paths are broadcast if their counted number allows; else joined by a
    shuffle, whose skewed hosts adaptive execution splits.
    """
    if {c.lower() for c in keep} & {"text", "n_chars"}:
        raise ValueError("keep may not hold text or n_chars")
    paths = host_paths(pages, url, page)
    held = F.struct(*[F.col(c).alias(c) for c in keep]).alias("keep")
    rows = pages.select(held, F.col(page).alias("page"), host_of(F.col(url)).alias("host"))
    rows = rows.join(broadcast_if_small(materialize(paths, "html-paths")), "host", "left").select("keep", "page", "paths")
    kind = "struct<" + ",".join(f"`{c}`:{t}" for c, t in pages.select(*keep).dtypes) + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), p.as_py()) for x, p in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["keep", "text", "n_chars"])

    return rows.mapInArrow(run, f"keep {kind}, text string, n_chars long").select("keep.*", "text", "n_chars")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_text(read_table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
