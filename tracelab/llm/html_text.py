"""Main text of web pages by consensus paths of their host (operator 6).

First every page's containers are scored by the text of their own paragraphs,
and the best ones vote for their generalised path of tags and classes. Spark
adds up the votes per host. The winner is lifted to the article around it, or to
an ancestor that adds headings or paragraphs. Then each page is read again and its text is taken
from the elements on its host's winning path; a page without such an element,
or without text in it, falls back to its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import appended, batch_of, small_batches, stored, table

VOTES = 3  #: containers of a page that vote
BROADCAST_BYTES = 64 << 20  #: of hosts and their paths that are broadcast
VOTE = "host string, path string, share double, lifted string"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
SKIPPED = frozenset("head nav aside footer form button select object canvas audio video".split()) | RAW
OUTSIDE = frozenset("menu dialog".split())  #: skipped where they aren't part of an article
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
#: Tags whose open element ends where another of the group begins.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSED_BY = {tag: tuple(t for t, by in CLOSES.items() if tag in by) for tag in set().union(*CLOSES.values())}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_WHOLE = re.compile(r"(?:[^\"']|\"[^\"]*\"|'[^']*')*")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NOISE = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|captcha|cookies?|consent|comments?|disqus|footer|gdpr|masthead|menus?|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widgets?)(?:$|[-_\s\d])", re.I)
_HEADER = re.compile(r"(?:^|[-_\s])(?:header|site-?head|topbar)(?:$|[-_\s\d])", re.I)
#: Words that also name wrappers of a whole page; the others name its parts.
_LAYOUT = re.compile(r"(?:^|[-_])(?:banner|masthead|menus?|nav\w*|notices?|promo\w*|sidebar|social|toolbar|widgets?)(?:$|[-_\d])", re.I)
#: What readers write can be far longer than a short article, so all text of a page has to be in it.
_TALK = re.compile(r"(?:^|[-_])(?:comments?|disqus|repl(?:y|ies))(?:$|[-_\d])", re.I)
#: Names that tell what a page has or how it is laid out, and a page builder's own prefix.
_FLAG = re.compile(r"(?:^|[-_])(?:has|no|with|without|layout)(?:[-_]|$)|[-_](?:open|closed|enabled|disabled)$", re.I)
_BUILDER = re.compile(r"^elementor(?:-widget)?(?:-|$)", re.I)
PARAGRAPHS = frozenset("p pre blockquote li dd td figcaption h1 h2 h3 h4 h5 h6".split())
LEAST_PARAGRAPH, LINKS = 25, 0.25  #: characters of paragraphs that lift a path, and the largest share of links beside them
LIFTED = 0.1  #: share of a path's votes from pages where it is lifted as far, which lifts it for the host
LEAST_TEXT = 250  #: characters that make an element with a noise word the main text, where it isn't an article
_SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class Node:
    tag: str
    step: str  # the tag with its classes, numbers in them generalised
    parent: Node | None
    noise: bool
    header: bool = False
    article: bool = False  # an article or main, or inside one
    score: float = 0.0
    word: str = ""  # the noise word's name; without it noise comes from the tag or from being hidden
    text: int = 0  # characters outside links and noise that isn't by word
    longest: int = 0  # those of the longest article or main inside
    articles: int = 0
    main: bool = False
    parts: list = field(default_factory=list)  # text, None for a break, or a node

    @property
    def path(self) -> str:
        """The steps from the root to here."""
        out, x = [], self
        while x is not None and x.parent is not None:
            out.append(x.step)
            x = x.parent
        return "".join(f">{step}" for step in reversed(out))


def _walk(root: Node, into: Callable[[Node], bool]) -> Iterator[tuple[Node, object, bool]]:
    """The parts below ``root`` in page order as (element, part, False), and (element, it, True) where one ends.

    ``into`` says of each element whether its own parts are gone through. Pages
    nest elements as deep as they like, so this doesn't call itself.
    """
    stack = [(root, iter(root.parts))]
    while stack:
        node, parts = stack[-1]
        for part in parts:
            yield node, part, False
            if isinstance(part, Node) and into(part):
                stack.append((part, iter(part.parts)))
                break
        else:
            stack.pop()
            yield node, node, True


def _attributes(raw: str) -> tuple[str, str, bool]:
    classes, names, hidden = "", "", False
    for m in _NAMED.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            classes = value
        if name in ("class", "id", "role"):
            names += " " + value
        hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
    return classes, names, hidden


def _first(pattern: re.Pattern, names: str) -> str:
    """The first of some names that holds a word of ``pattern`` and is no layout flag."""
    for name in names.split():
        if not _FLAG.search(name) and pattern.search(own := _BUILDER.sub("", name)):
            return own
    return ""


def _weigh(root: Node) -> None:
    for x, part, over in _walk(root, lambda p: (p.word or not p.noise) and p.tag != "a"):
        if over:
            if x.tag in ("article", "main") and not x.word and x.text:
                x.longest, x.articles, x.main = max(x.longest, x.text), x.articles + 1, x.main or x.tag == "main"
            if x is not root:
                up = x.parent
                up.text += x.text
                up.longest, up.articles, up.main = max(up.longest, x.longest), up.articles + x.articles, up.main or x.main
        elif isinstance(part, str):
            x.text += len(part.strip())


def _restore(root: Node) -> None:
    """Takes back noise words of elements that hold the main text: a main, the article, or most of the text."""
    around = {root: 0}  # articles around the parts of an element

    def into(part: Node) -> bool:
        if part.tag == "a":
            return False
        outside = around[part.parent]
        if part.noise and part.word or part.header and part.tag != "header":
            alone = root.articles == outside + part.articles and part.text >= LEAST_TEXT
            share = 0.5 if part.header or _LAYOUT.search(part.word) else 0.999 if _TALK.search(part.word) else 0.9
            if part.main or 2 * part.longest > root.text or alone and part.text > share * root.text:
                part.noise = part.header = False
        around[part] = outside + (part.tag in ("article", "main") and not part.word and part.text > 0)
        return not part.noise

    for _ in _walk(root, into):
        pass


def parse(page: str) -> Node:
    """The elements of a page with their texts; end tags may be left out, and odd ones are passed over."""
    root, doubt = Node("", "", None, False), False
    at, here, pos, size, opened = 0, root, 0, page.rfind(">") + 1, Counter()

    def end(x: Node) -> Node:
        """Closes ``x`` and all that is open inside it."""
        up = here
        while up is not x.parent:
            opened[up.tag] -= 1
            up = up.parent
        return up

    while True:
        m = _MARKUP.search(page, pos, size)
        if m is None:
            here.parts.append(page[at:].partition("<!--")[0])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = pos = m.end()
        if m[2] is None:
            continue
        tag, inside = m[2].lower(), m[3]
        for _ in range(4):  # a > inside quotes doesn't end the tag
            if _WHOLE.fullmatch(inside) or (close := page.find(">", at)) < 0:
                break
            inside, at = page[m.end(2) : close], close + 1
        if not _WHOLE.fullmatch(inside):
            inside, at = m[3], m.end()
        pos = at
        if m[1]:
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = end(up)
            continue
        if any(opened[t] for t in CLOSED_BY.get(tag, ())):
            up = here
            while up is not None and up.tag not in ("table", "ul", "ol", "dl", "article", "section", "div", "body"):
                if tag in CLOSES.get(up.tag, ()):
                    here = end(up)
                    break
                up = up.parent
        if tag == "br":
            here.parts.append(" ")
        if tag in VOID:
            if tag in BLOCKS:
                here.parts.append(None)
            continue
        classes, names, hidden = _attributes(inside) if inside else ("", "", False)
        step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes.split()})])
        header = tag == "header" or bool(names and _first(_HEADER, names))
        fixed = hidden or tag in SKIPPED or tag in OUTSIDE and not here.article
        word = _first(_NOISE, names) if names and not fixed and tag not in ("html", "body") else ""
        node = Node(tag, step, here, fixed or bool(word and tag not in ("article", "main")), header, here.article or tag in ("article", "main"), word=word)
        doubt |= node.noise and not fixed or header and tag != "header"
        here.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s>/])[^>]*>?", re.I).search(page, at)
            at = pos = close.end() if close else len(page)
            continue
        if not inside.endswith("/"):
            here = node
            opened[tag] += 1
    if doubt:
        _weigh(root)
        _restore(root)
    return root


def _shown(x: Node, article: bool = False) -> bool:
    """Whether an element is part of the text around it; a header is so inside an article alone."""
    return not x.noise and not (x.header and not (article or x.parent.article))


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in order, noise left out."""
    out, run = [], []

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    for x, part, over in _walk(node, lambda p: _shown(p, True)):
        if over:
            if x.tag in BLOCKS or x is node:
                end()
        elif isinstance(part, str):
            run.append(part)
        elif part is None:
            end()
        elif _shown(part, True):
            if part.tag in BLOCKS:
                end()
            elif part.tag in ("td", "th"):
                run.append(" ")
    return out


def _score(root: Node) -> list[Node]:
    """Containers by falling score: text outside links of their own blocks, half of it for the one around."""
    found, own, around = [root], {root: 0}, {root: [root]}
    blocks = [root]  # the open blocks

    def into(part: Node) -> bool:
        return part.tag != "a" and _shown(part)

    for x, part, over in _walk(root, into):
        if over:
            if x is blocks[-1]:
                blocks.pop()
                if (n := own[x]) > 1:
                    for k, up in enumerate(around[x]):
                        up.score += n / 2**k
        elif isinstance(part, str):
            own[blocks[-1]] += len(part)
        elif isinstance(part, Node) and into(part) and part.tag in BLOCKS:
            outer = around[blocks[-1]]
            own[part] = 0
            around[part] = [part, *outer][:3] if part.tag in CONTAINERS else outer
            found += [part] * (part.tag in CONTAINERS)
            blocks.append(part)
    return sorted((x for x in found if x.score > 0), key=lambda x: -x.score)


def _lifted(node: Node) -> Node:
    """The article around ``node``, else its furthest ancestor below the body that adds article text.

    That is a headline, or paragraphs, and few links beside them.
    """
    best = below = node
    plain = links = good = 0
    while below.tag not in ("article", "body", "html", "") and (up := below.parent) is not None and up.tag not in ("body", "html", ""):
        block, linked = [up], []  # the open blocks and links
        for x, part, over in _walk(up, lambda p, own=below: p is not own and _shown(p)):
            if over:
                if x is block[-1]:
                    block.pop()
                if linked and x is linked[-1]:
                    linked.pop()
            elif isinstance(part, str):
                n = len(part.strip())
                if linked:
                    links += n
                else:
                    plain += n
                    if block[-1].tag in PARAGRAPHS:
                        good += n if block[-1].tag not in ("h1", "h2") else n and LEAST_PARAGRAPH
            elif isinstance(part, Node) and part is not below and _shown(part):
                block += [part] * (part.tag in BLOCKS)
                linked += [part] * (part.tag == "a")
        if up.tag == "article":
            return up
        if good >= LEAST_PARAGRAPH and links <= LINKS * (plain + links):
            best, plain, links, good = up, 0, 0, 0
        below = up
    return best


def vote(page: str) -> list[tuple[str, float, str]]:
    """Paths that a page votes for, with shares that add up to 1, and where each is lifted to."""
    best = _score(parse(page))[:VOTES]
    total = sum(x.score for x in best)
    return [(x.path, x.score / total, _lifted(x).path) for x in best]


def extract(page: str, path: str | None) -> str:
    """The text on ``path``, else that of the page's own best container, else nothing."""
    root, blocks = parse(page), []
    along = {root: 0}  # characters of the path up to the elements that lie on it

    def on_path(x: Node) -> bool:
        """Whether an element lies before the path's end; the one at its end gives its blocks."""
        at = along[x.parent]
        if not path.startswith(f">{x.step}", at):
            return False
        at += len(x.step) + 1
        if at == len(path):
            blocks.extend(_blocks(x))
        along[x] = at
        return at < len(path) and path[at] == ">"

    if path:
        for _ in _walk(root, on_path):
            pass
    if not blocks:
        best = _score(root)
        blocks = _blocks(_lifted(best[0])) if best else []
    return "\n\n".join(blocks)


def host_of(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", html_: str = "html") -> DataFrame:
    """host, path: the path with most votes of each host, lifted; ties go to the shorter, then the first path."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *v) for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) for v in vote(page)]
            if rows:
                yield batch_of(VOTE, list(zip(*rows, strict=True)))

    voted = pages.select(host_of(url).alias("host"), F.coalesce(F.col(html_), F.lit("")).alias("html")).mapInArrow(score, VOTE)
    # Sums of rounded shares don't depend on the order in which tasks end.
    each = voted.groupBy("host", "path", "lifted").agg(F.sum(F.round(F.col("share") * 1e6).cast("long")).alias("n"))
    each = each.withColumn("votes", F.sum("n").over(Window.partitionBy("host", "path")))
    far = F.min(F.when(F.col("n") >= LIFTED * F.col("votes"), F.struct(F.length("lifted"), "lifted")))["lifted"]
    counted = each.groupBy("host", "path", "votes").agg(F.coalesce(far, F.col("path")).alias("lifted"))
    # the least of (most votes, shortest, first) by aggregation, as a host can have very many paths
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.length("path").alias("n"), "path", "lifted")).alias("b")).select("host", F.col("b.lifted").alias("path"))


def main_text(pages: DataFrame, url: str = "url", html_: str = "html") -> DataFrame:
    """``pages`` with ``text`` added, the blocks of the main text joined by two line feeds.

    Null or empty html, and pages of boilerplate alone, give an empty text. A
    null URL is a host of its own. Pages are read whole, however long or deeply
    nested; repeated rows get equal texts. A column named text is replaced; all
    others pass through, whatever their names. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != "text"]
    paths = stored(host_paths(pages, url, html_), "host-paths")
    size = paths.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0))).first()[0]
    # Beyond that size pages are joined by host; AQE splits the partitions of hosts with very many pages.
    few = F.broadcast(paths) if size <= BROADCAST_BYTES else paths
    rows = pages.select(F.struct(F.lit(0), *(c for c in kept if c != html_)).alias("row"), host_of(url).alias("host"), F.col(html_).alias("html"))
    joined = rows.join(few, "host", "left").select("row", "html", "path")

    def read(page: pa.Array, path: pa.Array) -> list:
        return [[extract(p or "", at) for p, at in zip(page.to_pylist(), path.to_pylist(), strict=True)]]

    made = appended(joined, "text string", read, ["html", "path"], ("path",))
    return made.select(*(F.col("html").alias(c) if c == html_ else F.col("row").getField(c).alias(c) for c in kept), "text")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
