"""Operator 1: main text of web pages, by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by length, link density and
stop-word density, with where it stands as a prior: elements and class or id names that always mean boilerplate
make it bad; a page's mark of its article (article, main, their roles, articleBody: strong; names that end in
content, post and the like: weak) turns verdicts that density would give against it into undecided ones. Long blocks
of prose are good, blocks of links or without stop words bad, short and mixed ones undecided. In the second pass
undecided blocks inherit the label of the nearest decided neighbours in their region, then on the page. Blocks outside
of marks go if a strong mark holds a good block, or any marks hold most of what is kept.

Stop words are those of four languages; where no block of a page has enough of them, its language is taken as
another, and density is not used against long blocks.

Character references are decoded; white space inside a block becomes one space; good blocks are joined
by a newline in page order. Nothing is capped.

Defined results: a null or empty page gives an empty text and n_chars 0; broken markup (unclosed tags,
comments or quotes, stray end tags) is read as far as it goes; of two neighbours at the same distance with different
labels the good one wins; very long pages are read in time linear in their length; repeated rows get a row each; an
empty table gives no rows. Columns beside the page's are only passed on if `keep` names them; one that clashes with
text or n_chars is passed on under its name with `_in` at its end.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from . import textbytes as tb
from .common import by_texts, table

LONG_BLOCK, SHORT_BLOCK = 200, 70
STOP_HIGH, STOP_LOW, MAX_LINKS = 0.30, 0.20, 0.5

# Frequent function words of four languages (fixed values).
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with his they at be this have from or had by but not what all were we when your can said there
    le la les de des du et un une en que qui dans pour pas sur au aux avec ce il est son se plus par ne ou je elle nous vous mais sont
    der die das und den von zu mit sich ist im dem nicht ein eine als auch es an auf für werden aus er hat dass sie nach wird bei
    el los las y o un una del al se por con no su para como más lo pero sus le ya este porque cuando muy sin sobre también""".split()
)
# Elements (fixed values).
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
# no text of the article in them; those of the first row end with their end tag, or where a block begins if they have none near
_CLOSED_BY_BLOCK = frozenset("svg select button datalist".split())
_SILENT = _CLOSED_BY_BLOCK | frozenset("noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
_CONTAINERS = frozenset("body div section article main aside nav header footer form td th table ul ol dl blockquote fieldset details dialog figure".split())
_BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset head".split())
_GOOD_TAGS = frozenset(("article", "main"))
# Words that are also subjects: as the first part of a name they tell boilerplate only before a word for a part of a page.
_SUBJECTS = frozenset("ad ads adv menu menus notice notices cookie cookies consent search share sharing copyright comment comments reply replies respond login header footer banner promotion subscribe navigation".split())
_PARTS = frozenset("area bar block bottom box button buttons container content count field form holder icon icons input inner item items label left links list menu module outer panel right row section slot tools top unit widget wrap wrapper".split())
#: How far the end of an element without text is looked for.
NEAR = 1 << 16
_HOLDS_ARTICLE = re.compile(r"<(?:article|main|h1)[\s>/]|role\s*=\s*[\"']?(?:main|article)|articlebody", re.I)
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
# First or last parts of class and id names (fixed values): always boilerplate; boilerplate outside of marks; marks if last.
_BAD_NAMES = frozenset(
    """nav navbar navigation menu menus breadcrumb breadcrumbs masthead header footer sidebar sidebars ad ads adv advert adverts advertisement advertising banner sponsor
    sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social
    comment comments disqus replies reply respond widget widgets toolbar pagination pager search copyright""".split()
)
_WEAK_BAD_NAMES = frozenset("aside promoted related recommended discussion skip legal form teaser".split())
_GOOD_NAMES = frozenset("article content story post entry main maincontent bodytext articlebody".split())
_WITH = frozenset("with has no without open is".split())

_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    __slots__ = ("chars", "heading", "links", "region", "text", "zone")

    def __init__(self, text: str, links: int, zone: int, region: int, heading: bool) -> None:
        self.text, self.chars, self.links, self.zone, self.region, self.heading = text, len(text), links, zone, region, heading


def zone_of(tag: str, attributes: str, inside: int) -> int:
    """-1 for boilerplate, 2 for a strong mark of the article, 1 for a weak one, 0 if the element says neither.
    `inside`: the zone around it."""
    if tag in _BAD_TAGS or (tag == "header" and inside < 1):
        return -1
    zone = 2 if tag in _GOOD_TAGS else 0
    if not attributes or attributes.isspace():
        return zone
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return -1
        if name == "role":
            if value in _BAD_ROLES:
                return -1
            zone = 2 if value in ("main", "article") else zone
        elif name in ("class", "id") and tag not in ("html", "body"):
            for token in value.split():
                parts = [p for p in re.split(r"[-_]+", token) if p]
                subject = len(parts) > 1 and parts[0] in _SUBJECTS and not any(p in _PARTS or p.isdigit() for p in parts[1:]) or parts[-1:] == ["copyright"] and tag[0] == "h" and tag[1:].isdigit()
                ends = {parts[-1] if subject and len(parts) > 1 else "" if subject else parts[0], parts[-1] if not subject or len(parts) > 1 else ""} if parts else set()
                good = bool(parts) and any(p in _GOOD_NAMES for p in parts)
                if tag not in _GOOD_TAGS and parts and parts[0] not in _WITH and not (good and parts[-1] == "header"):
                    if ends & _BAD_NAMES or (inside < 1 and ends & _WEAK_BAD_NAMES):
                        return -1
                if parts and parts[-1] in _GOOD_NAMES and tag in ("div", "section", "td"):
                    zone = max(zone, 1)
        elif name == "itemprop" and value == "articlebody":
            zone = 2
    return zone


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # element, its zone, its region
    opened: dict[str, int] = {}
    parts: list[str] = []
    state = {"links": 0, "regions": 0, "breaks": 0, "heading": False, "silent": 0, "ends": False}
    ends_at: dict[str, tuple[int, int]] = {}  # of each element: how far its end tag was looked for, and where it is (-1: not there)

    def end_of(name: str, start: int, most: int) -> int:
        """Where the element's next end tag is, -1 if there is none up to `most`; every part of the page is searched once."""
        to, found = ends_at.get(name, (start, -1))
        if found < start and to < most:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, max(start, to - len(name) - 3), most)
            to, found = (m.end(), m.start()) if m else (most, -1)
            ends_at[name] = to, found
        return found if start <= found < most else -1

    def here() -> tuple[int, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (0, 0)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, state["links"], *here(), state["heading"]))
            parts.clear()
        state["links"], state["breaks"] = 0, 0

    def add(raw: str) -> None:
        if raw and not state["silent"]:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                state["breaks"] = 0
                if opened.get("a"):
                    state["links"] += len(" ".join(text.split()))

    def cut(n: int) -> None:
        while len(stack) > n:
            name = stack.pop()[0]
            opened[name] -= 1
        if 0 < n < state["silent"] or not n:
            state["silent"] = 0

    def close_open(name: str) -> None:
        """Closes an open element of this name, unless a container stands between."""
        if opened.get(name):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    cut(i)
                    return
                if stack[i][0] in _CONTAINERS:
                    return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            m = _COMMENT_END.search(page, lt + 4)
            at = m.end() if m else n
            continue
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?") or (after == "/" and not page[lt + 2 : lt + 3].isalpha()):
            gt = page.find(">", lt)
            at = gt + 1 if gt >= 0 else n
            continue
        m = _TAG.match(page, lt)
        if not m:
            if after.isalpha() or after == "/":  # a tag that does not end properly
                gt = page.find(">", lt)
                at = gt + 1 if gt >= 0 else n
            else:
                add("<")
                at = lt + 1
            continue
        at = m.end()
        end, tag, attributes = m[1] == "/", m[2].lower(), m[3]
        if end:
            at_most = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1) if opened.get(tag) else -1
            if tag in _BLOCK and (not state["silent"] or 0 <= at_most < state["silent"]):
                flush()
                if tag[0] == "h" and tag[1:].isdigit():
                    state["heading"] = False
            if at_most >= 0:
                cut(at_most)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            gt = page.find(">", close.end()) if close else -1
            at = gt + 1 if gt >= 0 else n
            if tag not in ("script", "style"):
                parts.append(" ")
            continue
        if tag == "br":
            state["breaks"] += 1
            parts.append(" ")
            if state["breaks"] > 1:
                flush()
            continue
        if tag in _BLOCK and state["silent"] and not state["ends"] and stack[state["silent"] - 1][0] in _CLOSED_BY_BLOCK:
            cut(state["silent"] - 1)
        if tag in _BLOCK and not state["silent"]:
            flush()
            close_open("p")
            if tag in ("li", "td", "th", "tr", "dd", "dt"):
                close_open(tag)
            state["heading"] = tag[0] == "h" and tag[1:].isdigit()
        if tag in _VOID or attributes.endswith("/"):
            continue
        zone, region = here()
        own = zone_of(tag, attributes, zone)
        if tag == "form" and own == -1 and (close := end_of(tag, at, n)) >= 0 and _HOLDS_ARTICLE.search(page, at, close):
            own = 0  # it stands around the article
        silent = tag in _SILENT or (own == -1 and tag not in _BLOCK)
        if tag in _BLOCK and zone != -1 and own and own != zone and (own == -1 or own > zone):
            state["regions"] += 1
            zone, region = own, state["regions"]
        stack.append((tag, zone, region))
        opened[tag] = opened.get(tag, 0) + 1
        if silent and not state["silent"]:
            state["silent"] = len(stack)  # text is dropped until this element ends
            state["ends"] = tag in _CLOSED_BY_BLOCK and end_of(tag, at, min(n, at + NEAR)) >= 0
    flush()
    return out


def density(text: str) -> float:
    """The share of stop words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(found: list[Block]) -> list[str]:
    """good, bad, near (mixed) or short for each block."""
    dense = [density(b.text) if b.zone >= 0 and b.chars >= SHORT_BLOCK else 0.0 for b in found]
    known = any(d >= STOP_LOW for d in dense)
    return [_label(b, d, known) for b, d in zip(found, dense, strict=True)]


def _label(b: Block, dense: float, known: bool) -> str:
    marked = b.zone > 0
    if b.zone < 0:
        return "bad"
    if b.links > MAX_LINKS * b.chars:
        return "short" if marked else "bad"
    if b.heading or b.chars < SHORT_BLOCK:
        return "bad" if "©" in b.text and not marked else "short"
    if dense >= STOP_HIGH and (marked or b.chars >= LONG_BLOCK):
        return "good"
    if dense >= STOP_LOW or not known:
        return "near"
    return "short" if marked else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is kept: undecided ones follow the nearest decided ones of their region, else of the page's
    blocks that do not stand in boilerplate, else their place (and not a link)."""
    n = len(found)
    kept = [label == "good" for label in labels]

    def nearest(same_region: bool) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(n)]
        for order in (range(n), range(n - 1, -1, -1)):
            last: dict[int, int] = {}
            for i in order:
                b = found[i]
                place = b.region if same_region else 0
                if place in last:
                    out[i].append(last[place])
                if labels[i] in ("good", "bad") and (same_region or b.zone >= 0):
                    last[place] = i
        return out

    inside, anywhere = nearest(True), nearest(False)
    for i, b in enumerate(found):
        if labels[i] in ("good", "bad"):
            continue
        near = inside[i] or ([] if b.zone > 0 else anywhere[i])
        if not near:
            kept[i] = b.links <= MAX_LINKS * b.chars or b.zone > 0
        elif labels[i] == "near":
            kept[i] = any(labels[j] == "good" for j in near)
        else:
            kept[i] = labels[min(near, key=lambda j: (abs(j - i), labels[j] != "good"))] == "good"
    return kept


def decide(found: list[Block]) -> list[bool]:
    """Whether each block is part of the main text."""
    labels = first_pass(found)
    kept = second_pass(found, labels)
    size = lambda marked: sum(b.chars for b, k in zip(found, kept, strict=True) if k and (b.zone > 0) == marked)
    if any(b.zone == 2 and label == "good" for b, label in zip(found, labels, strict=True)) or size(True) >= max(size(False), 1):
        kept = [k and b.zone > 0 for k, b in zip(kept, found, strict=True)]
    return kept


def extract(page: str) -> str:
    """The main text of a page."""
    found = blocks(page)
    return "\n".join(b.text for b, k in zip(found, decide(found), strict=True) if k)


def main_text(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """The `keep` columns of pages with text and n_chars."""

    def work():
        def of(texts: tb.Texts, n: int) -> dict:
            out = [extract(texts.text(i)) for i in range(n)]
            return {"text": out, "n_chars": [len(t) for t in out]}

        return of

    return by_texts(pages, keep, column, "text string, n_chars bigint", work)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
