"""Main text of web pages by two-pass block rules.

The first pass labels blocks by stop-word density, length and link density; names of
classes, ids and roles, and an article around a block, shift what it takes. In the second,
blocks that stayed open take the label of the nearest decided block before or behind them,
those of an article from the article's own blocks. The page's edges say nothing, and
what was set aside for its element or name says less than text at the same distance.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be by for from has have he her his i in is it its not of on or that the their they this to was were which will with you
    aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht
    noch oder sich sie sind so über um und von vor war wie wird wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se
    ses son sont sur un une vous
    al como con del el ella ellos es esta este ha hay las lo los más muy no o para pero por se ser si sin sobre su sus también una y ya""".split()
)
#: Elements whose content is no text of the page: those whose content is raw up to their
#: end tag, and others, which end with what holds them if they have none.
RAW = frozenset("script style noscript iframe textarea title".split())
HIDDEN = frozenset("template svg math object canvas audio video select button".split())
#: Elements that end a block where they begin and end.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Of these, the ones that hold others and are followed from start to end.
HOLDERS = frozenset("article aside blockquote body dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
#: Holders of what isn't main text; a header counts unless it is an article's.
ASIDE = frozenset("aside dialog footer form menu nav".split())
#: Names of classes, ids and roles of such holders. A token of a class counts if its parts
#: are such names and parts that say nothing; an id, often the slug of a title, as a whole,
#: and not on a heading. Of the second and third list an article or main within is no
#: part. What has a name of the third list may still be text if it is long.
ASIDE_NAME = re.compile(
    r"breadcrumbs?|comment|comments|commentlist|consent|contentinfo|cookies?|discussions?|disqus|footer|masthead|navbar|navigation|newsletter|notices?|nav|pagination|related|"
    r"replies|reply|responses?|sidebar"
)
ADVERT_NAME = re.compile(r"ad|ads|advert\w*|adsense|promo\w*|sponsor\w*")
WEAK_NAME = re.compile(r"alert|banner|dialog|menu|modal|popup|search|share|sharing|social|subscribe|toolbar|widget")
#: Names of the first list that an id doesn't have, being headings of articles as well.
HEADING_NAME = frozenset("discussion discussions response responses".split())
_NO_NAME = re.compile(
    r"all|area|articles?|bar|block|body|bottom|box|buttons?|col|column|container|content|entry|form|header|icons?|inner|item|latest|left|line|links?|list|media|outer|page|panel|"
    r"policy|posts?|readers?|recent|right|row|section|signup|site|slot|stories|text|thread|top|unit|users?|visitors?|wrap|wrapper|\d+"
)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'">]++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_HIDDEN_END = re.compile("</(" + "|".join(sorted(HIDDEN)) + r")\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")

#: Code points from which a block is long; from which it is decided by its words; share
#: of link text above which a block is links; share of stop words of running text.
LONG, SHORT, LINKS, STOPS = 200, 70, 0.33, 0.2
#: For blocks under names of the third list, the factors of the length and of the share of stop words
#: that running text needs; for those in an article, of the share of stop words.
NAMED_LONG, NAMED_STOPS, ARTICLE_STOPS = 2, 1.5, 0.5
#: How far a name goes: not at all, up to an article or main within or a long text, up to an article or main within, to the end.
NONE, WEAK, ADVERT, NAMED = 0, 1, 2, 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD, BAD, OPEN = 1, -1, 0


def name_weight(tag: str, attributes: str) -> int:
    """How far an element's names say that it isn't main text."""
    if tag in ("html", "body", "main", "article"):
        return NONE
    weight = NONE
    for kind, a, b, c in _NAMES.findall(attributes):
        value = (a or b or c).lower().strip()
        if kind.lower() == "id":
            parts = [] if tag in HEADINGS or value in HEADING_NAME else [[value]]
        else:
            parts = [re.split(r"[-_]+", token) for token in value.split()]
        for of in parts:
            known = [NAMED if ASIDE_NAME.fullmatch(x) else ADVERT if ADVERT_NAME.fullmatch(x) else WEAK if WEAK_NAME.fullmatch(x) else NONE for x in of]
            if any(known) and all(k or _NO_NAME.fullmatch(x) for k, x in zip(known, of)):
                weight = max(weight, *known)
    return weight


def blocks(page: str) -> list[tuple[str, float, bool, bool, int]]:
    """(text, link density, in a holder of other things, in an article, how far a name of other things goes) of each block, in page order."""
    found: list[tuple[str, float, bool, bool, int]] = []
    holders: list[tuple[str, bool, bool, int]] = []
    held: Counter[str] = Counter()  # the holders' names
    pieces: list[str] = []
    linked = at = 0
    in_link = hidden = False
    spare, inside, dropped = NONE, "", None  # dropped: (hidden element, holders and block around it)
    ends = {m[1].lower(): m.start() for m in _HIDDEN_END.finditer(page)}

    def unseen(name: str, attributes: str) -> bool:
        return name not in ("html", "body", "main", "article") and bool(_UNSEEN.search(attributes))

    def end_block():
        nonlocal linked, hidden, spare
        text = " ".join("".join(pieces).split())
        if text:
            _, aside, article, other = holders[-1] if holders else ("", False, False, NONE)
            found.append((text, min(1.0, linked / len(text)), aside or hidden, article, max(other, spare)))
        pieces.clear()
        linked, hidden, spare = 0, False, NONE

    def take(raw: str):
        nonlocal linked
        if raw and not dropped:
            text = html.unescape(raw)
            pieces.append(text)
            if in_link:
                linked += len(" ".join(text.split()))

    while at < len(page):
        tag = _TAG.search(page, at)
        if not tag:
            take(page[at:])
            break
        take(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        closing = bool(tag[1] or tag[4])
        attributes = tag[3] or tag[6] or ""
        if not name:
            continue
        if dropped:
            over = name in BLOCKS and (ends.get(dropped[0], -1) < tag.start() or (closing and (name == dropped[2] or (held[name] and any(h[0] == name for h in holders[: dropped[1]])))))
            if closing and name == dropped[0]:
                dropped = None
                continue
            if over:
                dropped = None
            elif name not in RAW:
                continue
        if name in RAW and not closing:
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            if name == "title" and not dropped:
                end_block()
            continue
        if name in HIDDEN:
            if not closing and not (name in ("svg", "math") and attributes.endswith("/")):
                dropped = (name, len(holders), inside)
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCKS:
            end_block()
            if name not in HOLDERS:
                inside = "" if closing else name
                hidden, spare = not closing and unseen(name, attributes), NONE if closing else name_weight(name, attributes)
                continue
            inside = ""
            if closing:
                while held[name]:
                    last = holders.pop()[0]
                    held[last] -= 1
                    if last == name:
                        break
            else:
                _, aside, article, other = holders[-1] if holders else ("", False, False, NONE)
                aside = aside or name in ASIDE or (name == "header" and not article) or unseen(name, attributes)
                if name in ("article", "main"):
                    article, other = True, NONE if other < NAMED else other
                holders.append((name, aside, article, max(other, name_weight(name, attributes))))
                held[name] += 1
    end_block()
    return found


def stop_share(text: str) -> float:
    words = [w.lower() for w in _WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: tuple[str, float, bool, bool, int]) -> int:
    text, links, aside, article, other = block
    if aside or other > WEAK:
        return BAD
    if len(text) < SHORT:
        return BAD if links > LINKS or other or "©" in text else OPEN
    stops = stop_share(text)
    if links > LINKS:  # a sentence that is a link may be part of an article
        return OPEN if article and not other and stops >= STOPS else BAD
    if other:
        return GOOD if len(text) >= NAMED_LONG * LONG and stops >= NAMED_STOPS * STOPS else BAD
    return GOOD if stops >= (ARTICLE_STOPS if article or len(text) >= LONG else 1) * STOPS else OPEN


def second_pass(labels: list[int], yields: list[bool] | None = None, ends: int = OPEN) -> list[int]:
    """Open labels decided by the nearest decided one.

    At equal distance both must be good, but a bad one that yields leaves it to the other.
    ends: what stands beyond both ends, by default nothing. With nothing decided all are good.
    """
    n = len(labels)
    yields = yields or [False] * n
    nothing = (n + 1, OPEN, False)  # farther than all
    at = lambda i: (i, labels[i], yields[i])
    before, behind = [nothing] * n, [nothing] * n
    last = (-1, ends, False) if ends else None
    for i in range(n):
        last = at(i) if labels[i] != OPEN else last
        before[i] = (i - last[0], *last[1:]) if last else nothing
    last = (n, ends, False) if ends else None
    for i in range(n - 1, -1, -1):
        last = at(i) if labels[i] != OPEN else last
        behind[i] = (last[0] - i, *last[1:]) if last else nothing
    out = []
    for label, (a, x, weak_x), (b, y, weak_y) in zip(labels, before, behind):
        if label == OPEN:
            if a != b:
                label = x if a < b else y
            elif x != y and (weak_x if x == BAD else weak_y):
                label = GOOD
            else:
                label = min(x, y) or GOOD
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by newlines."""
    found = blocks(page or "")
    first = [first_pass(b) for b in found]
    if GOOD not in first:  # of a language without the stop words: length alone decides
        first = [GOOD if label == OPEN and len(b[0]) >= LONG else label for b, label in zip(found, first)]
    if GOOD not in first:  # a page of short blocks alone
        first = [GOOD if label == OPEN else label for label in first]
    labels = second_pass(first, [aside or other > NONE for _, _, aside, _, other in found])
    # what was set aside within an article says nothing of the text beside it
    inside = [i for i, (_, _, aside, article, other) in enumerate(found) if article and not aside and not other]
    for i, label in zip(inside, second_pass([first[i] for i in inside], ends=GOOD)):
        labels[i] = label
    return "\n".join(b[0] for b, label in zip(found, labels) if label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page.

    A null or empty page has an empty text; very long pages are read whole, in time that
    grows with their length; an open block as far from a good as from a bad one is bad,
    unless the bad one was set aside for its element or name; null ids and urls stay null; equal rows each give a row; markup that never closes ends
    with the page; other columns are left aside; an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    got = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"id {kind}, url string, text string, n_chars long"
    )
    return got.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
