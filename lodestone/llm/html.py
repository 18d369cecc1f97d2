"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass
    de la le et les des en un du une que est pour qui dans par pas au sur se plus ce avec il sont
    el los las del y por con para una su al lo como más pero sus ya o este sí porque esta entre
    """.split()
)
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    """
    address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section
    summary table tbody td tfoot th thead title tr ul
    """.split()
)
#: Elements whose content is no text of the page.
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button title".split())
#: Elements of which a page's article has no part.
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
#: Elements that hold the article.
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that name furniture wherever they stand in a class or id.
NEVER = frozenset("ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent popup modal newsletter subscribe breadcrumb breadcrumbs comment comments disqus respond replies share sharing social related recommended pagination pager login signup".split())
#: Words that name furniture, but not as part of an article, as in ``article-header``.
AROUND = frozenset("banner notice nav navbar navigation menu sidebar header footer masthead widget toolbar search".split())
OF_ARTICLE = frozenset("article post entry story content main text body".split())
#: First words of classes that say what a container has.
STATE = frozenset("has with no without is".split())
FURNITURE_ROLE = re.compile(r"(?i)^(?:navigation|banner|contentinfo|complementary|search|form|menu|menubar|dialog|alertdialog|alert)$")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in ("script", "style", "textarea", "title", "iframe", "noscript")}
#: An attribute with its value; matched one after another, so that nothing within a value is taken for a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s\"'>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
LETTERS = re.compile(r"[^\W\d_]")
#: Letters of scripts other than Latin.
OTHER = re.compile(r"[^\W\d_\u0000-\u024F]")
EDGE = re.compile(r"^\W+|\W+$")


@dataclass
class Rules:
    """Thresholds of the first pass."""

    short: int = 70  #: characters under which a block is left to its neighbours
    long: int = 200  #: characters from which a dense block is decided
    stop_low: float = 0.15
    stop_high: float = 0.3
    links: float = 0.5  #: share of characters in links from which a block is furniture
    foreign: float = 0.15  #: share of stop words under which they do not cover a page's language


@dataclass
class Block:
    """Text of a block with what the rules look at."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    furniture: bool = False
    article: int = 0  #: which article element it stands in, 0 for none

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a tag by whole names in lower case; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        if name:
            out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def names_furniture(value: str) -> bool:
    """Whether one of the names in a class or id, each judged as a whole, is furniture's."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if words and words[0] not in STATE and (not NEVER.isdisjoint(words) or words[0] not in OF_ARTICLE and not AROUND.isdisjoint(words)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out.

    Tags that are never closed are closed by the end of an element around them. A block that
    lies in hidden content is left out; one in furniture is marked.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, hidden, furniture, article
    held: Counter[str] = Counter()  # open elements by name, so that stray end tags cost no search
    hidden = furniture = False
    article = articles = links = 0
    now = Block()

    def close() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(furniture=furniture, article=article)

    def add(text: str) -> None:
        if text and not hidden:
            now.parts.append(text)
            if links:
                now.linked += len("".join(text.split()))

    def state() -> None:
        nonlocal hidden, furniture, article
        hidden, furniture, article = stack[-1][1:] if stack else (False, False, 0)

    def leave(name: str) -> None:
        """Close the innermost open element of that name, if there is one, with all that is open in it."""
        if held[name]:
            while True:
                gone = stack.pop()[0]
                held[gone] -= 1
                if gone == name:
                    return

    at = 0
    while found := TOKEN.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["end"] or found["end2"]:
            if name in BLOCKS:
                close()
            if name == "a":
                links = max(0, links - 1)
            elif held[name]:
                leave(name)
                state()
            if name in BLOCKS:
                now.furniture, now.article = furniture, article
            continue
        rest = found["rest"] or found["rest2"] or ""
        if name in BLOCKS:
            close()
            links = 0
        if name == "a":
            links += 1
        elif name not in VOID:
            if name == "p":  # paragraphs don't nest
                leave(name)
                state()
            named = attributes(rest) if rest.strip() else {}
            inside = article
            if name in ARTICLE and not article:
                articles += 1
                inside = articles
            odd = name in FURNITURE or names_furniture(named.get("class", "")) or names_furniture(named.get("id", "")) or bool(FURNITURE_ROLE.search(named.get("role", "").strip()))
            odd = odd and name not in ARTICLE and name not in ("html", "body")
            gone = name in HIDDEN or "hidden" in named or named.get("aria-hidden", "").lower() == "true"
            if not rest.rstrip().endswith("/"):
                stack.append((name, hidden or gone, furniture or odd, inside))
                held[name] += 1
                state()
        if name in BLOCKS:
            now.furniture, now.article = furniture, article
        if name in RAW and not rest.rstrip().endswith("/"):
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            if stack and stack[-1][0] == name:
                leave(name)
                state()
            now.furniture, now.article = furniture, article
    add(page[at:])
    close()
    return out


def _stops(text: str) -> tuple[int, int]:
    """How many words a text has, and how many of them are stop words."""
    words = text.lower().split()
    return len(words), sum(w in STOP_WORDS or not w.isalpha() and EDGE.sub("", w) in STOP_WORDS for w in words)


def foreign(found: list[tuple[Block, str]], rules: Rules) -> bool:
    """Whether the stop words do not cover a page's language: few of the words outside of furniture and lists of links are any."""
    words = stops = 0
    for block, text in found:
        if not block.furniture and not _of_links(block, text, rules):
            n, s = _stops(text)
            words, stops = words + n, stops + s
    return stops < rules.foreign * words


def _of_links(block: Block, text: str, rules: Rules) -> bool:
    return block.linked > rules.links * max(1, len(text.replace(" ", "")))


def decide(block: Block, text: str, rules: Rules, uncovered: bool = False) -> bool | None:
    """First pass: true for main text, false for furniture, None if it can't be told from the block.

    A block in another script than the stop words' or, where the page's language is not theirs
    (``uncovered``), any block is told by links and length alone.
    """
    if block.furniture:
        return False
    size = len(text)
    if _of_links(block, text, rules):
        return False
    if OTHER.search(text):
        letters = len(LETTERS.findall(text))
        if 2 * len(OTHER.findall(text)) > letters:
            # Scripts without spaces say as much in a third of the characters.
            return True if 3 * letters >= rules.long else None
    if size < rules.short:
        return None
    if uncovered:
        return True if size >= rules.long else None
    n, stops = _stops(text)
    density = stops / n
    if density >= rules.stop_high or density >= rules.stop_low and size >= rules.long:
        return True
    return None if density >= rules.stop_low or block.article else False


def _tells(block: Block, label: bool | None) -> bool:
    """Whether a block speaks for its neighbours: it is decided, and no furniture; lists of links in an article don't count."""
    return label is not None and not block.furniture and (label or not block.article)


def main_text(page: str | None, rules: Rules | None = None) -> str:
    """Main text of a page, its blocks joined by line feeds; empty where there is none.

    Second pass: an undecided block takes the label of the nearest decided block on either side,
    within its article element or, outside of such, among the blocks outside; on two different
    labels it is main text if it stands in an article. Without a decided neighbour a block is main
    text just if it stands in an article. If the page has articles with main text, blocks outside
    of them are dropped.
    """
    rules = rules or Rules()
    found = [(b, t) for b in blocks(page or "") if (t := b.text())]
    uncovered = foreign(found, rules)
    labels = [decide(b, t, rules, uncovered) for b, t in found]
    final: list[bool] = []
    before: dict[int, bool] = {}
    after: list[bool | None] = [None] * len(found)
    seen: dict[int, bool] = {}
    for i in range(len(found) - 1, -1, -1):
        after[i] = seen.get(found[i][0].article)
        if _tells(found[i][0], labels[i]):
            seen[found[i][0].article] = bool(labels[i])
    for i, ((block, _), label) in enumerate(zip(found, labels, strict=True)):
        if label is None:
            near = {x for x in (before.get(block.article), after[i]) if x is not None}
            final.append(near == {True} or block.article > 0 and near != {False} or not near and block.article > 0)
        else:
            final.append(label)
            if _tells(block, label):
                before[block.article] = label
    inside = any(ok and b.article for (b, _), ok in zip(found, final, strict=True))
    return "\n".join(t for (b, t), ok in zip(found, final, strict=True) if ok and (b.article or not inside))


def extract(page: Column) -> Column:
    """main_text() as a column expression; null pages give empty texts."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(pages.map(main_text) for pages in batches)

    return of(F.coalesce(page, F.lit("")))


def op7_html(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over all of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
