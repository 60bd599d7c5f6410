"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks of text at block-level tags, and at two line breaks in a row;
comments and what scripts, styles and other invisible elements hold are left out. The
first pass classifies each block by itself: link density, length, and the density of
stop words (the best of the lists in ``STOP_WORDS``) make it good, bad, short or near
good. The second pass settles the ambiguous ones from their neighbours: a near-good or
short block between two good blocks is good and between two bad ones bad; where they
differ, a short block takes the label of the nearer decided block, by blocks between
(the bad one on ties) unless a near-good block stands beside it, and a near-good block is
good. Headings that lead good text within ``HEADING_REACH`` characters are kept.

A page is in a language without a list where no list reaches ``STOP_HIGH`` in any block of
``LENGTH_LOW`` characters that is not links, nor ``STOP_LOW`` over all of them. There sentences take the place of stop words: a long
block that has the mark of a sentence's end is good, a middling one near good, and one
without bad. A character of a script without spaces (kana, Han, Hangul) counts as three.

A block with a copyright sign is bad unless it is longer than ``LENGTH_HIGH``.

Defined cases: a null page has null text and no blocks; an empty page, or one without
text, has the empty text; a block of no word is bad; unclosed and stray tags are
tolerated: a ``<`` that no ``>`` follows is text, and from the first tag on with a quote that
is never closed, tags end at the next ``>``; a script, style, textarea, iframe or noscript
that is never closed hides the rest of the page, other invisible elements without an end
hide nothing; the time is linear in the page, however malformed; rows are handled one
by one, so repeated rows repeat their result; a null page_id is passed on. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.18
LINKS_HIGH = 0.25
HEADING_REACH = 200

STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can do for from had has have he her his i if in into is it its more my no not of on one or our out she so some than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn werden wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et été il ils je la le les leur lui mais même ne nous on ont ou où par pas plus pour qu que qui sa se ses si son sont sur tout un une vous",
    "es": "a al como con cuando de del desde donde el ella en entre era es esta este está fue ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también un una y ya",
    "it": "a ai al alla alle anche c che chi ci come con così da dal dalla dei del della delle di e ed è era fra gli ha hanno i il in io la le lo loro ma mi nel nella non o per perché più quando questa questo se si sono su sua sul sulla suo tra un una uno",
    "pt": "a ao aos as até com como da das de do dos e é ela ele em entre era essa esse esta está este eu foi há isso já mais mas não na nas no nos o os ou para pela pelo por quando que quem se sem ser seu são sua também um uma",
    "nl": "aan al als bij dan dat de der deze die dit door een en er geen had hebben heeft het hij hun ik in is je kan maar met naar niet nog nu of om ook op over te tot uit van veel voor was wat we werd wel zich zij zijn zo",
    "ru": "а без более бы был была были было быть в вот все всё вы где да для до его её если есть еще ещё же за и из или их к как когда кто ли мы на над не него нет но о об он она они от по под при с со так также то только у уже что чтобы эта эти это я",
}
LISTS = len(STOP_WORDS)
#: Which lists a word is in, as bits.
_LISTED: dict[str, int] = {}
for _k, _words in enumerate(STOP_WORDS.values()):
    for _w in _words.split():
        _LISTED[_w] = _LISTED.get(_w, 0) | 1 << _k
_BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_HIDDEN = frozenset("head iframe noscript object script style svg template textarea".split())
_RAW = frozenset("iframe noscript script style textarea".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_CLOSE = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])", re.I) for name in _HIDDEN}
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")
_GIANT = re.compile(r"&#[0-9]{9,}")
_DENSE = re.compile(r"[\u3040-\u9fff\uac00-\ud7af]")
_SENTENCE = re.compile(r"[.!?…。！？؟।]")

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near-good"


@dataclass
class Block:
    text: str
    links: int
    heading: bool
    label: str = ""


class _Tags:
    """The tags of a page one after another, in time linear in the page.

    What was once looked for in vain is not looked for again: the end of a tag, of a quote, of
    an invisible element.
    """

    def __init__(self, page: str):
        self.page = page
        self.quotes = True
        self.unclosed: set[str] = set()

    def end_of_tag(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if no ``>`` follows."""
        page, i = self.page, at
        while self.quotes:
            stop = _STOP.search(page, i)
            if stop is None:
                return -1
            if stop.group() == ">":
                return stop.end()
            i = page.find(stop.group(), stop.end()) + 1
            if not i:
                self.quotes = False
        return page.find(">", at) + 1 or -1

    def skip(self, name: str, at: int) -> int:
        """Where the invisible element ends whose content begins at ``at``."""
        if name not in self.unclosed:
            close = _CLOSE[name].search(self.page, at)
            end = self.page.find(">", close.end()) + 1 if close else 0
            if end:
                return end
            self.unclosed.add(name)
        return len(self.page) if name in _RAW else at

    def __iter__(self) -> Iterator[tuple[str, str, bool]]:
        """(text before it, name, closing) of each tag; the name is empty for comments and at the end."""
        page, at, begin = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3
                yield page[begin:at], "", False
                at = begin = end if end > 2 else len(page)
                continue
            mark = page[at + 1 : at + 2]
            if mark in ("!", "?"):
                end = page.find(">", at) + 1
                if not end:
                    break
                yield page[begin:at], "", False
                at = begin = end
                continue
            name = _NAME.match(page, at + 1)
            if name is None:
                at += 1
                continue
            end = self.end_of_tag(name.end())
            if end < 0:
                break
            tag, closing = name.group(1).lower(), mark == "/"
            yield page[begin:at], tag, closing
            if tag in _HIDDEN and not closing and page[end - 2] != "/":
                end = self.skip(tag, end)
            at = begin = end
        yield page[begin:], "", False


def _unescape(raw: str) -> str:
    """Character references resolved; numbers no character can have are the replacement character."""
    return html.unescape(_GIANT.sub("&#1114112", raw) if "&#" in raw else raw)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    links = anchor = breaks = 0
    heading = False

    def close() -> None:
        nonlocal links, breaks
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, min(links, len(text)), heading))
        parts.clear()
        links = breaks = 0

    for raw, name, closing in _Tags(page):
        if raw:
            plain = _unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if not plain.isspace():
                breaks = 0
                if anchor:
                    links += len(_SPACE.sub(" ", plain).strip())
        if not name:
            continue
        if name in _HIDDEN and not closing:
            close()
        elif name == "a":
            anchor = 0 if closing else 1
        elif name == "br":
            breaks += 1
            parts.append("\n")
            if breaks == 2:
                close()
        elif name in _BLOCKS:
            close()
            anchor = 0
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
    close()
    return out


def _stop_counts(words: list[str]) -> list[int]:
    """How many of the words each list has."""
    out = [0] * LISTS
    for bits, n in Counter(filter(None, map(_LISTED.get, words))).items():
        for k in range(LISTS):
            if bits >> k & 1:
                out[k] += n
    return out


def is_listed(found: list[Block]) -> bool:
    """Whether a page is in a language that has a list of stop words."""
    total, hits = 0, [0] * LISTS
    for b in found:
        words = _WORD.findall(b.text.lower())
        if not words or b.links / len(b.text) > LINKS_HIGH:
            continue
        counts = _stop_counts(words)
        if len(b.text) >= LENGTH_LOW and max(counts) >= STOP_HIGH * len(words):
            return True
        total += len(words)
        hits = [a + c for a, c in zip(hits, counts)]
    return max(hits) >= STOP_LOW * total


def first_pass(block: Block, listed: bool = True) -> str:
    words = _WORD.findall(block.text.lower())
    size = len(block.text) + 2 * len(_DENSE.findall(block.text))
    if not words or block.links / len(block.text) > LINKS_HIGH or ("©" in block.text and size <= LENGTH_HIGH):
        return BAD
    if size < LENGTH_LOW:
        return BAD if block.links else SHORT
    if not listed:
        return BAD if not _SENTENCE.search(block.text) else GOOD if size > LENGTH_HIGH else NEAR
    density = max(_stop_counts(words)) / len(words)
    if density >= STOP_HIGH:
        return GOOD if size > LENGTH_HIGH else NEAR
    return NEAR if density >= STOP_LOW else BAD


def second_pass(labels: list[str]) -> list[str]:
    """Final labels, good or bad; the edges of a page count as bad blocks."""
    n = len(labels)
    before: list[tuple[str, int, bool]] = []
    state: tuple[str, int, bool] = (BAD, -1, False)
    for i, label in enumerate(labels):
        before.append(state)
        state = (label, i, False) if label in (GOOD, BAD) else (state[0], state[1], state[2] or label == NEAR)
    after: list[tuple[str, int, bool]] = [(BAD, n, False)] * n
    state = (BAD, n, False)
    for i in range(n - 1, -1, -1):
        after[i] = state
        label = labels[i]
        state = (label, i, False) if label in (GOOD, BAD) else (state[0], state[1], state[2] or label == NEAR)
    out = []
    for i, label in enumerate(labels):
        (left, l, near_l), (right, r, near_r) = before[i], after[i]
        if label in (GOOD, BAD):
            out.append(label)
        elif left == right:
            out.append(left)
        elif label == NEAR:
            out.append(GOOD)
        elif (left == BAD and near_l) or (right == BAD and near_r):
            out.append(GOOD)
        else:
            nearest = left if i - l < r - i else right if r - i < i - l else BAD
            out.append(nearest)
    return out


def classify(page: str) -> list[Block]:
    """Blocks with their final labels."""
    found = blocks(page)
    listed = is_listed(found)
    first = [first_pass(b, listed) for b in found]
    for b, label in zip(found, second_pass(first)):
        b.label = label
    ahead = None
    for b, before in zip(reversed(found), reversed(first)):
        if b.label == GOOD:
            ahead = 0
        elif ahead is not None:
            if b.heading and ahead <= HEADING_REACH and before == SHORT:
                b.label = GOOD
            ahead += len(b.text)
    return found


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks, n_good) of every page; good blocks are joined by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, goods = [], [], []
            for page in batch.column(1).to_pylist():
                found = classify(page) if page is not None else []
                good = [b.text for b in found if b.label == GOOD]
                texts.append("\n".join(good) if page is not None else None)
                counts.append(len(found))
                goods.append(len(good))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(goods, pa.int64())], names=["page_id", "text", "n_blocks", "n_good"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_blocks long, n_good long")
