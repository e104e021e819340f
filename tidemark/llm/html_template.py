"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Tokens are the elements of a page, by path, and its text blocks. Tokens of a host that occur equally often in each
of its pages form an equivalence class; a class in which an element holds a text nests, and that text is
part of the template. What varies between its tokens are slots; those that carry the article are extracted.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches, slices
from tidemark.session import materialise

#: Pages of a host that a template needs; share of link text from which a slot counts as a list of links.
TEMPLATE_PAGES = 4
LINK_SHARE = 0.5
#: Kinds of tokens: elements, the paths of texts, texts.
ELEMENT, PATH, TEXT = 0, 1, 2
#: Tokens a task gathers before it hands them on.
TOKENS_AT_ONCE = 400_000

# fixed values: HTML elements by role
RAW = frozenset("script style noscript template textarea title iframe svg object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
FURNITURE = frozenset("head nav footer aside button select menu dialog fieldset".split())
#: Elements that hold the page as a whole; a form straight below one may, too.
PAGE = frozenset(("html", "body"))
MAIN = frozenset(("article", "main"))
#: Words of which a class, id or role consists that marks page furniture.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation navi menu footer sidebar aside ad ads advert adverts advertisement advertising banner cookie cookies consent notice notices "
    "comment comments disqus promo sponsor sponsored share sharing social related recommended breadcrumb breadcrumbs popup modal newsletter subscribe "
    "login signup search widget toolbar masthead pagination pager skip copyright respond replies commentlist commentform adsbygoogle".split()
)
#: Those of them that mark a name of several words by standing first or last in it.
FURNITURE_ENDS = frozenset(
    "nav navbar navigation menu footer sidebar ad ads advert adverts advertisement banner cookie cookies consent comment comments disqus promo "
    "sponsored breadcrumb breadcrumbs popup modal newsletter pagination pager widget".split()
)
#: Words of a name that speaks of the whole, or of furniture that is elsewhere or missing: such an element is left to the template.
WHOLE_WORDS = frozenset("content main post article entry story page site body layout wrapper wrap with without has have no not open closed off".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)(?!\s*=\s*[\"']?until-found)|(?:^|\s)style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _number(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - 2**63


class Block:
    """A stretch of text between block borders: its element path, its text, how much of it is link text."""

    __slots__ = ("path", "parts", "linked", "main", "furniture", "article", "lifted")

    def __init__(self, path: str, main: bool, furniture: bool, article: bool = False, lifted: bool = False) -> None:
        self.path, self.main, self.furniture, self.article, self.lifted = path, main, furniture, article, lifted
        self.parts: list[str] = []
        self.linked = 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def blocks_of(source: str | None, opened: list[str] | None = None) -> list[Block]:
    """The text blocks of a page in order. Unclosed elements, comments and scripts are tolerated.

    The path of every block element outside furniture is added to `opened`.
    """
    source = source or ""
    # tag, label, within main, an article, a main or article that furniture by name holds, furniture by element, furniture by name
    stack: list[tuple[str, str, bool, bool, bool, bool, bool]] = []
    blocks: list[Block] = []
    links = link_depth = 0
    fresh = True

    def put(text: str) -> None:
        nonlocal fresh
        if not text:
            return
        if fresh:
            if text.isspace():
                return
            main, article, lifted, hard, named = stack[-1][2:] if stack else (False,) * 5
            blocks.append(Block("/".join(s[1] for s in stack), main, hard or named, article, lifted))
            fresh = False
        blocks[-1].parts.append(text)
        if links:
            blocks[-1].linked += len(text)

    at = 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        if found is None:
            put(source[at:])
            break
        put(source[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            if found["cdata"]:
                put(found["cdata"])
            continue
        tag, closing, rest = tag.lower(), bool(found["close"]), found["rest"] or ""
        if tag == "br":
            put(" ")
        elif tag in INLINE:
            if not closing and (_furniture_words(rest) or _HIDDEN.search(rest)):
                at = _past(source, at, tag)
            elif tag == "a":
                links, link_depth = (0, 0) if closing else (1, len(stack))
        elif tag in RAW:
            if not closing and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            fresh = True
        elif tag in VOID:
            fresh = fresh or tag == "hr"
        else:
            fresh = True
            if closing:
                open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if open_at is not None:
                    del stack[open_at:]
                if len(stack) < link_depth:  # a link that is never closed ends with the element around it
                    links = link_depth = 0
                continue
            _close_implied(stack, tag)
            main, article, lifted, hard, named = stack[-1][2:] if stack else (False,) * 5
            names = _names(rest)
            hard = hard or tag in FURNITURE or (tag == "header" and not main) or (tag not in PAGE and _HIDDEN.search(rest) is not None)
            if tag in MAIN and not hard:  # what holds an article is no furniture, whatever it is called
                main, lifted, named = True, lifted or named, False
                article = article or (tag == "article" and not lifted)
            elif tag == "form":
                named = named or bool(stack and stack[-1][0] not in PAGE) or _furniture_words(rest)
            elif tag not in PAGE:
                named = named or _furniture_words(rest)
            stack.append((tag, ".".join([tag, *sorted(names)]), main, article, lifted, hard, named))
            if opened is not None and not (hard or named):
                opened.append("/".join(s[1] for s in stack))
    return blocks


def _past(source: str, at: int, tag: str) -> int:
    """The end of an inline element marked as furniture."""
    depth = 1
    for found in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(source, at):
        depth += -1 if found[1] else 1
        if depth == 0:
            return found.end()
    return at


def _names(rest: str) -> set[str]:
    if "=" not in rest:
        return set()
    return {w for m in _ATTRIBUTE.finditer(rest) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w}


def _furniture_words(rest: str) -> bool:
    """True if a class, id or role consists of furniture words, or begins or ends with a sure one.

    One that merely contains such a word, or speaks of the whole, is left to the template.
    """
    if "=" not in rest:
        return False
    for m in _ATTRIBUTE.finditer(rest):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if len(w) > 1]
            if words and FURNITURE_WORDS.issuperset(words):
                return True
            if words and WHOLE_WORDS.isdisjoint(words) and not FURNITURE_ENDS.isdisjoint((words[0], words[-1])):
                return True
    return False


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the article or main elements; an article that furniture by name holds (a comment, say) only where no other is."""
    kept = [b for b in blocks if b.main]
    return [b for b in kept if not b.lifted] if any(b.article for b in kept) else kept


def _close_implied(stack: list, tag: str) -> None:
    """A block element ends an open paragraph; list items, cells and rows end their like."""
    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
    like = ends.get(tag, ())
    limit = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr",), "th": ("tr",), "dt": ("dl",), "dd": ("dl",)}.get(tag, ())
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in limit:
            break
        if stack[i][0] == "p" or stack[i][0] in like:
            del stack[i:]
            break
        if tag not in ends and stack[i][0] != "p":
            break


def _above(path: str) -> list[int]:
    """Numbers of the page and of the elements that hold a text of this path."""
    labels = path.split("/") if path else []
    return [_number("/".join(labels[:i])) for i in range(len(labels) + 1)]


TOKENS = "host string, kind int, role long, content long, one long, two long, pages long, chars long, linked long, main boolean, above array<long>"


def _tokens(batches) -> Iterator[pa.RecordBatch]:
    """Per task, host and token: weighted sums that stand for the occurrence vector, pages, occurrences, text and link sizes."""
    held: dict[tuple, list] = {}

    def told():
        keys, rows = list(held), list(held.values())
        held.clear()
        columns = [[k[i] for k in keys] for i in range(4)] + [[r[i] for r in rows] for i in range(7)]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64())]
        names = ["host", "kind", "role", "content", "one", "two", "pages", "chars", "linked", "main", "above"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    above: dict[str, list[int]] = {}
    for batch in slices(batches):
        if len(above) > TOKENS_AT_ONCE:
            above.clear()
        for host, url, page, source in zip(*(batch.column(i).to_pylist() for i in range(4))):
            draw = xxhash.xxh64_intdigest(f"{page}\x00{url}".encode("utf-8", "surrogatepass"))
            one, two = draw & 0x7FFFFFFF, draw >> 33
            seen: set[tuple] = set()

            def count(key: tuple, main: bool, path: str | None, chars: int, linked: int) -> None:
                row = held.get(key)
                if row is None:
                    if path is not None and path not in above:
                        above[path] = _above(path)
                    row = held[key] = [0, 0, 0, 0, 0, main, None if path is None else above[path]]
                row[0] += one
                row[1] += two
                row[2] += key not in seen
                row[3] += chars
                row[4] += linked
                seen.add(key)

            opened = [""]  # the page itself
            blocks = blocks_of(source, opened)
            for path in opened:
                count((host, ELEMENT, _number(path), None), False, None, 0, 0)
            for block in blocks:
                if block.furniture:
                    continue
                text = block.text()
                linked = min(block.linked, len(text))
                count((host, PATH, _number(block.path), None), block.main, None, len(text), linked)
                count((host, TEXT, _number(block.path), _number(block.path, text)), block.main, block.path, len(text), linked)
        if len(held) > TOKENS_AT_ONCE:
            yield from told()
    yield from told()


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, drops): the text blocks of each host that its template holds, and the paths that are lists of links.

    Elements and texts whose occurrence vectors over the host's pages are equal are one class. It nests where an element
    of the class holds the text: the text then stands once in each of those elements and belongs to the template. The vectors
    are compared through two sums of page draws, so a host of any size costs one row per token and task. Within an article
    or main element a text must also be on half of the host's pages, so that copies of one article are not taken
    for a template. Of the slots outside those, the ones that are mostly link text are lists of links.
    """
    tokens = (
        pages.mapInArrow(_tokens, TOKENS)
        .groupBy("host", "kind", "role", "content")
        .agg(*[F.sum(c).alias(c) for c in ("one", "two", "pages", "chars", "linked")], F.max("main").alias("main"), F.max("above").alias("above"))
        .where(F.col("pages") >= TEMPLATE_PAGES)
    )
    tokens = materialise(tokens)
    elements = tokens.where(F.col("kind") == ELEMENT)
    whole = elements.where(F.col("role") == _number("")).select("host", F.col("pages").alias("of"))
    classes = elements.groupBy("host", "one", "two").agg(F.collect_set("role").alias("elements"))
    texts = (
        tokens.where(F.col("kind") == TEXT).join(classes, ["host", "one", "two"]).where(F.arrays_overlap("above", "elements"))
        .join(whole, "host").where(~F.col("main") | (2 * F.col("pages") >= F.col("of")))
    )
    listed = (F.col("kind") == PATH) & ~F.col("main") & (F.col("linked") >= LINK_SHARE * F.col("chars"))
    drops = texts.select("host", F.col("content").alias("drop")).union(tokens.where(listed).select("host", "role"))
    return drops.groupBy("host").agg(F.collect_set("drop").alias("drops"))


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = []
        for source, drops in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            blocks = [b for b in blocks_of(source) if not b.furniture]
            main, known = main_blocks(blocks), set(drops or ())
            if main:  # a template without a slot in the article is none
                kept = [b for b in main if _number(b.path, b.text()) not in known] if known else main
                kept = kept if any(b.text() for b in kept) else main
            else:
                kept = [b for b in blocks if _number(b.path) not in known and _number(b.path, b.text()) not in known]
            texts.append(" ".join(t for t in (b.text() for b in kept) if t))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    The article of a page is what stands in its article or main element, outside furniture (menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, comments by element or by a class, id or role of such words alone; never html,
    body, main, article or what holds the only article, nor a form that holds the page). Texts of the
    host's template are left out there too, unless nothing else is in it. A page without such an element gives the
    slots of its host's template that are neither fixed text nor lists of links; a host of fewer than TEMPLATE_PAGES
    pages has no template, and only furniture is left out. Character references are decoded, white space
    within a block becomes one space, and blocks are joined by one space.

    A null html or url is empty text or an unnamed host. Repeated rows are all returned; an empty table gives an
    empty table. Other columns are not read. The lookup of templates is joined; Spark sees its size.
    """
    short_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))).alias("host"),
    )
    templates = materialise(host_templates(rows.select("host", "url", "page_id", "html")))
    return rows.join(templates, "host", "left").select("page_id", "url", "html", "drops").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
