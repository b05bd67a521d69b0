"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Containers only exclude: menus, headers, footers, sidebars,
notices, adverts, forms and comments are no text and have no say. An article or main element inside a form or a
container known by its name alone is not excluded, but for an article among comments or related pages.
First pass: link density, the density of stop words and length call the other blocks good, bad or undecided.
Pages whose text shares too few words with every list of stop words (counted apart for Latin and other scripts)
are judged by length and sentence ends. Second pass: blocks too short or too plain to decide inherit the label of
their nearest decided neighbours, on their side of an article's border; a heading follows the block after it.
In an article mere lists of links are bad, a link-heavy paragraph is undecided, and what has no decided
neighbour is text.

NULL html counts as empty. A page without text blocks has the text ''. Broken markup never fails: tags
that are cut off at the end are dropped, stray end tags are ignored. Equal rows give equal rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import ship

# Names of HTML elements and attributes, and common words of nine languages.
_RAW = frozenset("script style title textarea noscript template iframe svg math object canvas xmp noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OFF_TAGS = frozenset("nav footer aside form button select menu dialog head search".split())
_OFF_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
_OFF_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer footers cookie cookies consent notice notices popup modal overlay comment comments disqus "
    "respond replies reply related recommended share sharing social subscribe newsletter signup login search pagination pager widget "
    "widgets toolbar disclaimer copyright masthead skip toc".split()
)
#: Parts that say where or what an element of these names is. Other parts (has-, no-) give a class another meaning.
_PLAIN_NAMES = frozenset(
    "site page main global left right primary secondary top bottom upper lower first second inner outer box list block container wrapper wrap "
    "section area item items link links button buttons bar post entry article content text form google id".split()
)
_LISTED = frozenset("comment comments disqus respond replies reply related recommended".split())
_TOP_NAMES = frozenset("header headers topbar".split())
_STOP = frozenset(
    "the of and to in is it that for was on are with as be this by from or an at which a i not have has had were but they his her he she "
    "le la les de des du et en un une que qui dans pour par sur est au aux ce il elle pas plus avec son sa ses ne se ou "
    "der die das und den von zu mit sich dem des ein eine ist im nicht es auch auf für als an aus bei nach wird sind "
    "el los las y del que una se con por para su al lo como más o pero sus le no es en".split()
)
_OTHER_STOPS = tuple(
    frozenset(words.split())
    for words in (
        "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от так о для ты же все год как его было были был при до или их бы если",
        "i w nie na z do to że się o a jak za co po jest od przez przy dla tak tym był ale czy być oraz które który przed jego ich są tego",
        "di e che il la un a per in una sono mi si lo ha le con i da ma non del della dei al alla nel più come anche questo gli era",
        "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou são",
        "de het een en van in is dat op te zijn voor met die niet aan er om ook als dan maar bij of uit nog naar heeft ze door werd",
    )
)
#: Each stop word with the lists that hold it, one bit a list.
_LISTS = {w: sum(1 << i for i, stop in enumerate((_STOP, *_OTHER_STOPS)) if w in stop) for w in _STOP.union(*_OTHER_STOPS)}
_LATIN = re.compile(r"[a-zA-Z\u00c0-\u024f\u1e00-\u1eff]")
#: Letters of scripts without blanks; one stands for about three of an alphabet.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4]")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?P<key>[^\s=>/\"']+)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")

_SHORT, _LONG = 70, 200
_LINKS = 0.5
_FEW, _MANY = 0.2, 0.3
_FOREIGN = 0.1


@dataclass
class Block:
    inside: int  # 1 in an article, -1 in a container of other things, 0 neither
    heading: bool
    paragraph: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


def _known(token: str, names: frozenset[str]) -> set[str]:
    """The names in a class or id, if it says nothing else."""
    parts = {part for part in re.split(r"[_-]+", token) if part and not part.isdigit()}
    return parts & names if parts <= names | _PLAIN_NAMES else set()


def _names(rest: str) -> tuple[set[str], str, bool]:
    """Classes and ids, the role, and whether the element is hidden."""
    names, role, hidden = set(), "", False
    for m in _ATTRIBUTE.finditer(rest):
        key = m["key"].lower()
        value = html.unescape(m["a"] or m["b"] or m["c"] or "").lower()
        if key in ("class", "id"):
            names.update(value.split())
        elif key == "role":
            role = value.strip()
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, role, hidden


def _inside(tag: str, rest: str, outer: int, off_by: str) -> tuple[int, str]:
    """What the element's container says, given its parent's; and what switched text off: a tag, "name" or "listed"."""
    tokens, role, hidden = _names(rest) if rest.strip() else (set(), "", False)
    off = {name for token in tokens for name in _known(token, _OFF_NAMES)}
    main, whole = tag in ("article", "main") or role in ("main", "article"), tag == "main" or role == "main"
    shut = hidden or tag in _OFF_TAGS or role in _OFF_ROLES
    if outer < 0:
        if main and not shut and not off and (off_by in ("form", "name") or off_by == "listed" and whole):
            return 1, ""
        # What a tag shuts inside a named container stays shut for articles, too.
        if off_by in ("form", "name", "listed") and shut and tag != "form":
            return -1, tag
        return outer, "listed" if off_by in ("form", "name") and off & _LISTED else off_by
    if tag in ("body", "html"):
        return outer, ""
    if shut:
        return -1, tag if tag in _OFF_TAGS and not hidden else "shut"
    if off:
        return -1, "listed" if off & _LISTED else "name"
    if outer == 0 and tag == "header":
        return -1, tag
    if outer == 0 and any(_known(token, _TOP_NAMES) for token in tokens):
        return -1, "name"
    return (1 if main else outer), ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    out: list[Block] = []
    open_: list[tuple[str, int, str]] = []  # tag, inside, off_by
    opened: dict[str, int] = {}  # how often each tag is open, so that stray end tags cost no search
    inside, off_by, anchors = 0, "", 0
    block = Block(0, False)

    def shut() -> str:
        tag = open_.pop()[0]
        opened[tag] -= 1
        return tag

    def close() -> None:
        nonlocal block
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            out.append(block)
        heading = any(tag in _HEADINGS for tag, *_ in open_[-2:])
        block = Block(inside, heading, any(tag == "p" for tag, *_ in open_[-2:]))

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            block.parts.append(text)
            if anchors:
                block.linked += len("".join(text.split()))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m["name"] or m["name2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if opened.get(tag):
                while shut() != tag:
                    pass
                inside, off_by = (open_[-1][1], open_[-1][2]) if open_ else (0, "")
            if tag in _BLOCKS:
                close()
                anchors = 0
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag in _BLOCKS and tag not in _VOID:
            # A new block ends an open paragraph; an item, row or cell ends the one before.
            ends = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "option": ("option",)}.get(tag, ("p",))
            while open_ and (open_[-1][0] in ends or open_[-1][0] not in _BLOCKS and any(t in ends for t, *_ in open_[-4:])):
                shut()
            inside, off_by = (open_[-1][1], open_[-1][2]) if open_ else (0, "")
        if tag not in _VOID and not m.group(0).endswith("/>"):
            inside, off_by = _inside(tag, m["rest"] or "", inside, off_by)
            open_.append((tag, inside, off_by))
            opened[tag] = opened.get(tag, 0) + 1
        if tag in _BLOCKS:
            close()
            anchors = 0
        elif tag == "a":
            anchors += 1
        elif block.parts and inside != block.inside:  # an inline container of its own
            close()
    close()
    return out


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _latin(text: str) -> bool:
    return text.isascii() or 2 * len(_LATIN.findall(text)) >= sum(map(str.isalpha, text))


def _density(words: list[str]) -> float:
    if not words:
        return 0.0
    held = Counter(map(_LISTS.get, words))
    held.pop(None, None)
    return max(sum(n for lists, n in held.items() if lists >> i & 1) for i in range(1 + len(_OTHER_STOPS))) / len(words)


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def foreign(blocks: list[Block]) -> set[bool]:
    """Of Latin (True) and other scripts (False) those of which the page's texts are in no listed language."""
    words: dict[bool, list[str]] = {}
    if not any(block.inside == 0 and _size(block.text) >= _SHORT for block in blocks):
        return set()  # nothing is judged by words
    for block in blocks:
        if block.inside >= 0 and not block.linked and _size(block.text) >= _SHORT:
            words.setdefault(_latin(block.text), []).extend(_words(block.text))
    return {latin for latin, all_ in words.items() if _density(all_) < _FOREIGN}


def _first(block: Block, unlisted: set[bool]) -> str:
    """off, good, bad, or for the second pass near and short."""
    size = len("".join(block.text.split()))
    if block.inside < 0:
        return "off"
    if block.inside > 0 and block.linked > _LINKS * size:
        return "short" if block.linked < size or block.paragraph or block.heading else "bad"
    if block.linked > _LINKS * size or block.inside == 0 and "©" in block.text:
        return "bad"
    if _size(block.text) < _SHORT:
        return "bad" if block.linked and block.inside == 0 else "short"
    if unlisted and _latin(block.text) in unlisted:
        if _END.search(block.text) is None and not _DENSE.search(block.text):
            return "short" if block.inside > 0 else "bad"
        return "good" if _size(block.text) > _LONG else "near"
    density = _density(_words(block.text))
    if density >= _MANY:
        return "good" if _size(block.text) > _LONG else "near"
    return "near" if density >= _FEW else "short"


def _nearest(labels: list[str]) -> list[str]:
    """The last label before each place that is good or bad; empty if there is none."""
    out, last = [], ""
    for label in labels:
        out.append(last)
        last = label if label in ("good", "bad") else last
    return out


def _inherit(blocks: list[Block], kind: str) -> None:
    labels = [b.label for b in blocks]
    sides = zip(_nearest(labels), reversed(_nearest(labels[::-1])))
    for block, (before, after) in zip(blocks, sides):
        if block.label != kind:
            continue
        edge = "" if block.inside > 0 or block.paragraph else "bad"  # what stands first or last is often a bar without a name
        known = ({after or before} if block.heading else {before or edge, after or edge}) - {""}
        if len(known) == 1 and not (block.inside > 0 and block.paragraph):
            block.label = known.pop()
        else:  # neighbours that disagree, or none
            block.label = "good" if block.inside > 0 or kind == "near" else "bad"


def _second(blocks: list[Block]) -> None:
    """Undecided blocks inherit from their nearest decided neighbours: first the long ones, then the short ones."""
    voting = [b for b in blocks if b.label != "off"]
    for _, run in groupby(voting, key=lambda b: b.inside):
        side = list(run)
        for kind in ("near", "short"):
            _inherit(side, kind)


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    unlisted = foreign(blocks)
    for block in blocks:
        block.label = _first(block, unlisted)
    _second(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page; row by row, without a shuffle."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
