"""Main-text extraction from raw HTML.

Events of the standard library's streaming parser give one line for each block of text, with its characters, its tags and its
element. The logarithms of the lines' text-to-tag ratios, in page order, are smoothed by a Gaussian, and a threshold between two
clusters of them marks content lines. The marked lines select the content regions:

- the page's articles (or else its main) that hold marked lines, if these hold most of the marked text;
- else the smallest element that holds all marked lines, and the headings directly above it;
- else, if only the whole body does, the run from the first marked line to the last, with the lines that share a container with
  one, and the headings directly above.

Regions are given whole, so that headings and short paragraphs in them aren't lost.

Page furniture is left out: menus, footers, asides, adverts, notices, scripts, styles and reader comments, by element and by the
words of class, id and role. In an article or main, a class or id names furniture only if all of its words do (share-buttons), since a
section of the article can be about anything (search-algorithms); where some do, the section goes if links are most of its text. Buttons
and labels go, but for those within a paragraph's prose. Two more cases are decided here: a header is furniture unless it lies in an article or main, whose title it
then holds; a form is furniture unless it holds the article, as a form around the whole page does, and then only its fields go.

A page is parsed within its row, in Arrow batches; pages need nothing of one another. Memory and time grow with the page's length,
however deep its elements are nested.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 2
#: Times the lower cluster's (geometric) mean ratio that the upper one's is at least; else the page has one cluster.
APART = 2
#: Share of the marked text that articles have to hold to be the regions.
SHARE = 0.5
#: Words of a line that counts as prose when a form is judged.
PROSE_WORDS = 8
#: Share of links in the text of a section of an article, with a name like furniture's, from which on it is furniture.
LINKS = 0.5
# Element names of HTML, and the words by which pages name their furniture.
LEFT_OUT = frozenset("head title nav footer aside script style noscript template iframe object embed svg canvas button select textarea input label legend datalist output menu dialog audio video".split())
HEAD = frozenset("head title meta link base script style noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr inline-button inline-label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ITEMS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th table tbody thead tfoot caption blockquote pre figure figcaption details summary header hgroup address center".split())
#: Words of class and id that name what doesn't belong to an article, in the languages of the corpus.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus respond share sharing social related recommended widget toolbar pagination pager login signup search "
    "werbung anzeige anzeigen kommentar kommentare fusszeile kopfzeile seitenleiste hinweis publicidad anuncio anuncios comentario comentarios aviso avisos publicite commentaire commentaires opiniones leserkommentare".split()
)
#: Words that stand beside these in names of furniture, and name nothing themselves.
CARRIERS = frozenset("area article articles bar block body bottom box boxes button buttons col column container content entry feed form group head heading icon icons inner item items lectores left link links list main message outer page panel post posts right root row section site slot stories story tools top unit user users wrap wrapper zone".split())
#: Elements that are part of the prose where they stand in a paragraph.
CONTROLS = frozenset(("button", "label"))
TITLES = frozenset(("header", "masthead", "kopfzeile"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LANDMARKS = frozenset(("article", "main"))
_TEXT_CONTENT = frozenset(("script", "style"))
_ENDS = {"li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_QUALIFIED = re.compile(r"\b(?:has|with|no|without)-\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none")


class Lines(HTMLParser):
    """The lines of a page, in page order: text, tags and element. Elements are numbers; each knows its name, its landmark's name and its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names, self.kinds, self.parents = [""], [""], [-1]
        # Open elements: number, left out, in an article or main, nearest block, and the place of the paragraph that a block would end (0: none).
        self.open: list[tuple[int, bool, bool, int, int]] = [(0, False, False, 0, 0)]
        self.there: Counter[str] = Counter()  # open elements by name
        self.lines: list[tuple[str, int, int]] = []
        self.links: list[int] = []  # characters of a line that lie in links
        self.doubtful: set[int] = set()  # elements in articles, with a name of which some words are furniture's
        self.text: list[str] = []
        self.tags = self.linked = self.prose = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and self.prose:  # a line of controls alone isn't prose
            self.lines.append((text, self.tags, self.open[-1][3]))
            self.links.append(self.linked)
        self.text.clear()
        self.tags = self.linked = self.prose = 0

    def shut(self, at: int) -> None:
        """Closes the open element at a place, and those in it."""
        names = [self.names[number] for number, *_ in self.open[at:]]
        if not INLINE.issuperset(names):
            self.flush()
        self.there.subtract(names)
        del self.open[at:]

    def furniture(self, tag: str, given: dict[str, str | None], inside: bool) -> bool:
        if tag in LEFT_OUT or (tag == "header" and not inside):
            return True
        if not given:
            return False
        if (given.get("role") or "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or _UNSEEN.search((given.get("style") or "").lower()):
            return True
        if tag in ("html", "body", "main", "form"):
            return False
        names = [name for key in ("class", "id") for name in _HUMP.sub("-", given.get(key) or "").lower().split()]
        if tag == "article":  # by a whole name only: one with comments-open isn't a comment
            return not FURNITURE.isdisjoint(set(names) - TITLES if inside else names)
        for name in names:
            words = set(_LETTERS.findall(_QUALIFIED.sub("", name)))
            if inside:
                words -= TITLES
            if FURNITURE.isdisjoint(words):
                continue
            if not inside or words <= FURNITURE | CARRIERS:
                return True
            self.doubtful.add(len(self.names) - 1)
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.there["head"] and tag not in HEAD:  # the end tag of a head may be missing
            self.handle_endtag("head")
        self.tags += 1
        if self.open[-1][4]:
            if tag in CONTROLS:
                tag = f"inline-{tag}"
            elif tag == "input":
                return
        if tag == "br":
            self.text.append(" ")
        if tag in INLINE and tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
            # A block start ends an open paragraph; an item ends the item before it in the same list or row.
            if tag not in _ENDS:
                if self.open[-1][4]:
                    self.shut(self.open[-1][4])
            else:
                for at in range(len(self.open) - 1, 0, -1):
                    name = self.names[self.open[at][0]]
                    if name in _ENDS[tag]:
                        self.shut(at)
                        break
                    if name not in INLINE and name != "p":
                        break
        if tag in VOID:
            return
        given = dict(attrs)
        parent, out, inside, block, paragraph = self.open[-1]
        role, number = (given.get("role") or "").lower(), len(self.names)
        self.names.append(tag)
        self.kinds.append(tag if tag in LANDMARKS else role if role in LANDMARKS else "")
        self.parents.append(parent)
        self.there[tag] += 1
        out = out or self.furniture(tag, given, inside)
        inline = tag in INLINE
        self.open.append((number, out, inside or self.kinds[-1] != "", block if inline else number, len(self.open) if tag == "p" else paragraph if inline else 0))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in _TEXT_CONTENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in CONTROLS and self.there[f"inline-{tag}"]:
            tag = f"inline-{tag}"
        if self.there[tag]:  # else there is nothing to look for
            for at in range(len(self.open) - 1, 0, -1):
                if self.names[self.open[at][0]] == tag:
                    self.shut(at)
                    return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Skips any <![...]>; the parser's own gives up on unknown ones."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data: str) -> None:
        if self.names[self.open[-1][0]] == "head" and not data.isspace():
            self.handle_endtag("head")
        if not self.open[-1][1]:
            self.text.append(data)
            seen = len(data) - data.count(" ")
            self.linked += seen * (self.there["a"] > 0)
            self.prose += seen * (not (self.there["inline-button"] or self.there["inline-label"])) * (not data.isspace())


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian-weighted mean over neighbouring lines; at an end, over those that exist."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel)[RADIUS : RADIUS + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Halfway between the means of two clusters, found by moving it there until it stays."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if math.isclose(new, cut):
            break
        cut = new
    return cut


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: the upper cluster of the smoothed logarithms of the ratios, or all lines if the two are hardly apart."""
    values = smooth(np.log1p(ratios))
    upper = values >= threshold(values)
    if upper.all() or not upper.any() or values[upper].mean() - values[~upper].mean() < math.log(APART):
        return np.ones(len(values), bool)
    return upper


def _outermost(page: Lines, wanted: list[bool]) -> list[int]:
    """For each element, the outermost wanted element that it is or lies in; 0: none."""
    found = [0]
    for number in range(1, len(wanted)):  # parents come first
        found.append(found[page.parents[number]] or number * wanted[number])
    return found


def _without_links(page: Lines) -> None:
    """Takes out the lines of doubtful elements whose text is links for the most part."""
    if not page.doubtful:
        return
    doubtful = _outermost(page, [number in page.doubtful for number in range(len(page.names))])
    size, linked = Counter(), Counter()
    for (text, _, element), n in zip(page.lines, page.links, strict=True):
        size[doubtful[element]] += len(text) - text.count(" ")
        linked[doubtful[element]] += n
    gone = {number for number in size if number and linked[number] >= LINKS * size[number]}
    page.lines = [line for line in page.lines if doubtful[line[2]] not in gone]


def _without_forms(page: Lines) -> list[tuple[str, int, int]]:
    """The lines, without those of forms that don't hold the article: an article, main or h1, or half of the page's prose."""
    if "form" not in page.names:
        return page.lines
    form = _outermost(page, [name == "form" for name in page.names])
    stays = {form[number] for number, name in enumerate(page.names) if page.kinds[number] or name == "h1"}
    prose: Counter[int] = Counter()
    for text, _, element in page.lines:
        prose[form[element]] += (n := len(text.split())) * (n >= PROSE_WORDS)
    stays |= {number for number, words in prose.items() if words and 2 * words >= prose.total()}
    return [line for line in page.lines if not form[line[2]] or form[line[2]] in stays]


def _common(page: Lines, elements: set[int]) -> int:
    """The smallest element that holds all of them. A parent's number is smaller, so the largest can be raised until one is left."""
    heap, held = [-number for number in elements], set(elements)
    heapq.heapify(heap)
    while len(held) > 1:
        number = -heapq.heappop(heap)
        held.discard(number)
        above = page.parents[number]
        if above not in held:
            held.add(above)
            heapq.heappush(heap, -above)
    return held.pop()


def _container(page: Lines, element: int) -> int:
    """What holds a line's own element beside other paragraphs, lists and tables."""
    element = page.parents[element] if element else 0
    while page.names[element] in ITEMS:
        element = page.parents[element]
    return element


def content_blocks(html: str | None) -> list[str]:
    """Blocks of the main text in page order; [] for a null, empty or textless page."""
    if not html:
        return []
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    _without_links(page)
    lines = _without_forms(page)
    if not lines:
        return []
    marked = content_lines(np.array([len(text) / max(1, tags) for text, tags, _ in lines]))
    elements = [element for _, _, element in lines]

    landmark = _outermost(page, [kind == "article" for kind in page.kinds])
    if not any(landmark[element] for element in elements):
        landmark = _outermost(page, [kind == "main" for kind in page.kinds])
    mass: Counter[int] = Counter()
    for (text, _, element), content in zip(lines, marked, strict=True):
        mass[landmark[element]] += len(text) * bool(content)
    if mass.total() - mass[0] >= SHARE * mass.total():
        return [text for text, _, element in lines if landmark[element] and mass[landmark[element]]]

    of_content = {element for element, content in zip(elements, marked, strict=True) if content}
    region = _common(page, of_content)
    if region in of_content or page.names[region] in ITEMS:
        region = _container(page, region)
    if page.names[region] in ("", "html", "body"):
        beside = {_container(page, element) for element in of_content}
        at = np.flatnonzero(marked)
        chosen = [at[0] <= i <= at[-1] or _container(page, element) in beside for i, element in enumerate(elements)]
    else:
        inside = _outermost(page, [number == region for number in range(len(page.names))])
        chosen = [inside[element] > 0 for element in elements]
    heading = _outermost(page, [name in HEADINGS for name in page.names])
    for i in range(len(lines) - 2, -1, -1):
        chosen[i] = chosen[i] or (heading[elements[i]] > 0 and chosen[i + 1])
    return [text for (text, _, _), taken in zip(lines, chosen, strict=True) if taken]


def extract(html: Column) -> Column:
    """The main text: blocks joined by two line feeds; empty if there is none."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(["\n\n".join(content_blocks(page.as_py())) for page in batch], pa.string())

    return texts(html)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page has an empty text. Rows are extracted each by itself, repeated ones too; a null page_id or
    url is passed on; other columns play no part. An empty table gives no rows.
    """
    found = pages.select("page_id", "url", extract(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
