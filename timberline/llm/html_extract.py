"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by link density, length and stop-word density:
link lists are boilerplate, long runs of ordinary sentences are text, short or middling blocks stay undecided. In the second
pass an undecided block takes the label of its nearest decided neighbours, so a headline or a one-word paragraph goes with
the text, or the link list, it belongs to.

Where a block stands is a prior. Menus, footers, sidebars, forms, adverts and comments that say so by tag, role or name are
boilerplate whatever they hold. In an article or main part half the length and density is asked, undecided blocks look for
neighbours in their own article, and stay when there are none. On a page that has such a part, blocks elsewhere need twice
the length and more stop words. Everywhere else density alone decides, and stop words are asked for in proportion to how
many of them the page's unlinked text holds.

Defined results: null or empty html gives an empty text; unclosed tags end where their container ends; an unclosed comment,
script or style runs to the end of the page; a tag whose quotes do not end ends at the next angle bracket; markup without text
gives an empty text; repeated rows give repeated results. Extra columns are ignored. Time is linear in the length of a page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import chunks

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his how
    i if in into is it its just me more most my no not of on one only or other our out over she so some such than that the
    their them then there these they this to too up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus
    pour qu que qui sa sans se ses son sont sur un une vous y été être
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im
    in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    al como con del el ella en era es esta este fue ha han hay la las lo los más me mi muy no nos o para pero por que se ser si
    sin sobre son su sus también un una uno ya
    """.split()
)
#: Parts of class and id names that mark boilerplate.
BOILERPLATE_NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies copyright disclaimer disqus feedback footer gdpr hidden login masthead menu modal nav navbar
    navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related reply
    replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget
    """.split()
)
#: Those of them whose containers hold articles that are not the page's, and that make an article itself one of these.
LISTED_NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense comment comments commentlist disqus promo promotion recommended
    related reply replies respond sponsor sponsored widget
    """.split()
)
#: First parts of names that tell of a page or post (has-sidebar, tag-social), not of what the container is.
MODIFIERS = frozenset("has with without no not is tag category layout template format".split())
CONTENT_NAMES = frozenset("articlebody article-body article-content article-text entry-content post-content post-body story-body main-content".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
SILENT_TAGS = frozenset("head script style noscript template svg math iframe object select button textarea canvas video audio map datalist title".split())
CONTAINERS = frozenset("article main nav footer aside form menu dialog header section div ul ol dl table blockquote figure details fieldset".split()) | SILENT_TAGS
BLOCKS = CONTAINERS | frozenset("html body p h1 h2 h3 h4 h5 h6 li dt dd tr caption figcaption pre address hr legend summary tbody thead tfoot hgroup center option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r">|=\s*[\"']")
_ANGLE = re.compile(r"[<>]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_EDGES = re.compile(r"^\W+|\W+$")

SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.15, 0.30
#: Stop-word density beyond which a page is judged by the full thresholds; that of plain prose lies somewhat below.
PROSE_STOPS = 0.6
LINKED, LINKED_INSIDE = 0.5, 0.8
GOOD, BAD, NEAR, BRIEF = "good", "bad", "near", "brief"


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    tag: str
    region: int  # 0: none, -1: boilerplate, else the number of its article
    label: str = ""


def _suspicion(names: set[str]) -> tuple[set[str], set[str]]:
    """Boilerplate words that are whole class or id names, and those that are the first or last part of one. Words in the
    middle, and last parts after a modifier, say nothing."""
    parts: set[str] = set()
    for name in names:
        first, *rest = _NAME_PARTS.split(name)
        parts.add(first)
        if rest and first not in MODIFIERS:
            parts.add(rest[-1])
    return names & BOILERPLATE_NAMES, parts & BOILERPLATE_NAMES


def _kind(tag: str, attributes: str, inside: str) -> str:
    """What a container makes of the text in it: silent, boilerplate, content, form or what surrounds it. By its names alone it
    is suspected, and an article or main part in it is content again, or listed, and only a main part is."""
    if tag in SILENT_TAGS:
        return "silent"
    names: set[str] = set()
    role = ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                names.update(value.split())
            elif name == "role":
                role = value
            elif name == "itemprop" and value == "articlebody":
                names.add("articlebody")
            elif name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return "silent"
    if inside in ("silent", "boilerplate"):
        return inside
    if tag in BOILERPLATE_TAGS and tag != "form" or role in BOILERPLATE_ROLES:
        return "boilerplate"
    if tag == "main" or role == "main":
        return "content"
    whole, parts = _suspicion(names) if names else (names, names)
    named_content = any(not CONTENT_NAMES.isdisjoint((n, *_NAME_PARTS.split(n))) for n in names)
    if tag == "article" or role == "article":
        if inside == "listed" or not named_content and (whole | parts) & LISTED_NAMES:
            return "listed"
        return "content"
    if named_content:
        return "listed" if inside == "listed" else "content"
    if whole or parts:
        return "listed" if inside == "listed" or whole or parts & LISTED_NAMES else "suspected"
    if tag == "header" and inside != "content" or any("header" in _NAME_PARTS.split(n) for n in names) and tag in ("div", "section") and inside != "content":
        return "boilerplate"
    if tag == "form" and inside != "listed":
        return "form"
    return inside


def _tag_end(page: str, at: int, quoted: bool) -> tuple[int, int, bool]:
    """Where a tag's attributes and the tag itself end, and whether quotes are still to be trusted: they are not once a tag's
    quotes have not ended, so a page is looked through to its end at most once."""
    pos = at
    while quoted:
        m = _STOP.search(page, pos)
        if not m:
            break
        if m[0] == ">":
            return m.start(), m.end(), True
        pos = page.find(m[0][-1], m.end()) + 1
        if not pos:
            break
    m = _ANGLE.search(page, at)
    if not m:
        return len(page), len(page), False
    return m.start(), m.end() if m[0] == ">" else m.start(), False


def _markup(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Tags, comments and declarations: where each begins and ends, whether it is an end tag, its name and its attributes
    (empty for what is no tag). A script, style or other part without text of the page is one piece with its content."""
    at, quoted = 0, True
    while (start := page.find("<", at)) >= 0:
        m = _NAME.match(page, start)
        if m:
            tag = m[2].lower()
            inner, at, quoted = _tag_end(page, m.end(), quoted)
            if tag in _RAW_END and not m[1]:
                ending = _RAW_END[tag].search(page, at)
                at = _tag_end(page, ending.end(), False)[1] if ending else len(page)
                yield start, at, False, "", ""
            else:
                yield start, at, bool(m[1]), tag, page[m.end() : inner]
        elif page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            at = at if at > 2 else len(page)
            yield start, at, False, "", ""
        elif page[start + 1 : start + 2] in ("!", "?", "/"):
            at = page.find(">", start) + 1 or len(page)
            yield start, at, False, "", ""
        else:
            at = start + 1


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = [("", "plain", 0)]
    parts: list[str] = []
    state = {"linked": 0, "link": 0, "tag": "", "breaks": 0, "regions": 0}

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                kind, region = stack[-1][1], stack[-1][2]
                out.append(Block(text, state["linked"], state["tag"], -1 if kind in ("boilerplate", "suspected", "listed", "form") else region if kind == "content" else 0))
            parts.clear()
        state["linked"] = state["breaks"] = 0

    def put(text: str) -> None:
        if stack[-1][1] == "silent" or not text:
            return
        parts.append(text)
        if not text.isspace():
            state["breaks"] = 0
            if state["link"]:
                state["linked"] += len(text)

    at = 0
    open_tags: Counter[str] = Counter()
    for begins, ends, ending, tag, attributes in _markup(page):
        put(page[at:begins])
        at = ends
        if not tag:
            continue
        if tag == "br":
            state["breaks"] += 1
            if state["breaks"] > 1:
                close()
            else:
                put(" ")
        elif tag == "a":
            state["link"] = 0 if ending else 1
        elif tag in ("td", "th"):
            put(" ")
        elif tag in BLOCKS:
            close()
            state["tag"] = "" if ending else tag
            state["link"] = 0
            if tag == "body" and not ending:
                while len(stack) > 1 and stack[-1][0] == "head":
                    open_tags[stack.pop()[0]] -= 1
            if tag in CONTAINERS:
                if ending:
                    while open_tags[tag]:
                        closed = stack.pop()[0]
                        open_tags[closed] -= 1
                        if closed == tag:
                            break
                elif not attributes.endswith("/"):
                    kind = _kind(tag, attributes, stack[-1][1])
                    region = stack[-1][2]
                    if kind == "content" and stack[-1][1] != "content":
                        state["regions"] += 1
                        region = state["regions"]
                    stack.append((tag, kind, region))
                    open_tags[tag] += 1
    put(page[at:])
    close()
    return out


def _stop_density(text: str) -> float:
    words = [_EDGES.sub("", w) for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def _usual(blocks: list[Block]) -> float:
    """How much of the stop words of ordinary prose the page's unlinked text holds, one at most: a page in a language or of words
    that the list does not know is not judged by them."""
    words = stops = 0.0
    for b in blocks:
        if b.region >= 0 and 2 * b.linked <= len(b.text):
            n = len(b.text.split())
            words += n
            stops += n * _stop_density(b.text)
    return min(1.0, stops / words / PROSE_STOPS) if words else 1.0


def _first_pass(blocks: list[Block]) -> bool:
    """Decide blocks by links, length and stop words; where they stand scales what is asked of them. Tells whether the page
    says where its article is."""
    inside = sum(len(b.text) for b in blocks if b.region > 0)
    elsewhere = sum(len(b.text) for b in blocks if b.region == 0)
    marked = inside > 0 and 3 * inside >= elsewhere
    usual = 1.0 if marked else _usual(blocks)
    for b in blocks:
        n = len(b.text)
        links = min(1.0, b.linked / n)
        strict = 0.5 if b.region > 0 else 2.0 if marked else 1.0
        heading = b.region > 0 and b.tag in HEADINGS
        if b.region < 0:
            b.label = BAD
        elif links > (LINKED_INSIDE if b.region else LINKED) and not heading:
            b.label = BAD
        elif not b.region and n < LONG and ("©" in b.text or "all rights reserved" in b.text.lower()):
            b.label = BAD
        elif n < SHORT:
            b.label = BAD if not b.region and (links > 0.2 or marked) else BRIEF
        else:
            stops = _stop_density(b.text)
            if n > LONG * strict and stops >= usual * (FEW_STOPS * strict if b.region else min(MANY_STOPS, MANY_STOPS * strict)):
                b.label = GOOD
            elif stops >= usual * FEW_STOPS * strict:
                b.label = NEAR
            else:
                b.label = BRIEF if b.region else BAD
    return marked


def _decided(blocks: list[Block], order: range, marked: bool) -> list[tuple[str, int]]:
    """Label and distance of the nearest decided block before each in this order: within an article for its blocks, and on a
    page that marks its article, within the stretch around it for all others."""
    out = [("", len(blocks))] * len(blocks)
    anywhere = own = None
    region = 0
    for i in order:
        b = blocks[i]
        if b.region != region:
            own, region = None, b.region
        last = own if b.region > 0 or marked else anywhere
        if last is not None:
            out[i] = (blocks[last].label, abs(i - last))
        if b.label in (GOOD, BAD):
            anywhere = own = i
    return out


def _second_pass(blocks: list[Block], marked: bool) -> list[bool]:
    """Undecided blocks inherit from their nearest decided neighbours."""
    out = []
    forward, back = _decided(blocks, range(len(blocks)), marked), _decided(blocks, range(len(blocks) - 1, -1, -1), marked)
    for b, (before, far_before), (after, far_after) in zip(blocks, forward, back, strict=True):
        if b.label in (GOOD, BAD):
            out.append(b.label == GOOD)
        elif b.region:  # in an article only its own link lists are boilerplate
            out.append(not (before or after) or GOOD in (before if far_before <= far_after else "", after if far_after <= far_before else ""))
        elif b.label == NEAR:
            out.append(GOOD in (before, after) or not (before or after or marked))
        elif b.tag in HEADINGS:
            out.append(after == GOOD)
        elif before == after:
            out.append(before == GOOD)
        elif far_before == far_after or not before or not after:
            out.append(b.tag in ("p", "pre", "blockquote") and GOOD in (before, after))
        else:
            out.append((before if far_before < far_after else after) == GOOD)
    return out


def main_text(page: str | None) -> str:
    """The text of a page's article, one block a line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    marked = _first_pass(blocks)
    return "\n".join(b.text for b, good in zip(blocks, _second_pass(blocks, marked), strict=True) if good)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. No shuffle: each page is handled where it is read."""
    types = dict(pages.dtypes)

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, 200):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return read.mapInArrow(extract, f"page_id {types[id_col]}, url {types[url_col]}, text string, n_chars long")
