"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of a page. A line weighs its text
outside links. Weights are summed over sliding windows of ``WINDOW`` lines; where the
sum ahead of a line passes ``SURGE`` is a surge point, and the stretch from there lasts
until the dive point after which a window holds no text of its own (links do not count).
On pages whose text is short, half of their highest sum takes the place of ``SURGE``.

Tags cut, they do not choose: containers of boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, comments: by element, or by a class, id or role
all of whose parts are such words) are left out and leave a gap, and blocks are told
apart by the container they stand in. From the body inward, the container with most
text is entered as long as what lies outside it has no surge point and no heading; an
article or main element is entered even if that has some, as long as it is less than a
quarter of the element's own. Of the container where this ends, an article is kept as
it is, and of another one its own stretches and its containers with a surge point.

Within an article, too, names decide and not density: a ``<div class="toc">`` is a menu there, a ``<p class="alert">`` a notice.
Fallback text of an ``object`` is text. A head without an end tag ends by itself, as nothing in it but elements without text may stand there.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by an empty line. ``<br>`` is white space. A null or
empty page gives an empty text. Nothing is capped, and time is linear in the page;
repeated rows stay, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import table, trimmed

WINDOW, SURGE = 3, 80
#: Share of an article's text below which what surrounds it does not keep it from being entered.
AROUND = 0.25

#: Elements whose content is never text: without an end tag the first kind lasts to the end of the page, of the second the tag alone goes.
RAW, EMBEDDED = "script style title noscript iframe", "template svg math canvas audio video"
#: Elements that hold boilerplate wherever they are.
ASIDE = frozenset("nav footer aside form menu button select textarea dialog fieldset datalist".split())
#: Words of class, id or role that mark boilerplate, and words that may stand beside them in one name.
MARKS = frozenset("""
    ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager
    header masthead footer sidebar aside complementary contentinfo widget widgets related recommended
    notice notices cookie cookies consent gdpr popup modal overlay alert dialog
    comment comments respond reply replies disqus
    form search login signup subscribe newsletter share sharing social
""".split())
BESIDE = frozenset("""
    site page main global top bottom left right upper lower primary secondary sub
    list box bar block area section container wrapper wrap inner outer item items group row panel slot unit holder
    post posts article articles story stories link links icon icons button buttons text content body title thread count
    js fixed sticky mobile desktop google dfp policy privacy banner region module component view user reader
""".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body div section article main td center".split())
HEADINGS = frozenset("h1 h2 h3".split())

START = re.compile(rf"<!--|<(?P<name>{'|'.join(f'{RAW} {EMBEDDED}'.split())})(?=[\s/>])[^>]*>?|<[!?][^>]*>?", re.I)
END = {name: re.compile(rf"</{name}\s*>", re.I) for name in f"{RAW} {EMBEDDED}".split()}
#: A quote opens a value only after "="; within a value without quotes it is a character.
TAG = re.compile(r"""<(/?)([a-zA-Z][\w:-]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>][^\s>]*)?|[^<>=])*)>?""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def marked(value: str, within: bool) -> bool:
    """Whether a name in a class, id or role says boilerplate: "cookie-notice" and "post-comments" do, "related-work" does not."""
    for name in value.split():
        parts = {w.lower() for w in PARTS.findall(name)}
        if parts & MARKS and parts <= MARKS | BESIDE and not (within and parts & MARKS == {"header"}):
            return True
    return False


@lru_cache(4096)
def boilerplate(name: str, text: str, within: bool) -> bool:
    if name in ASIDE or name == "header" and not within:
        return True
    if not text or name in ("html", "body", "main"):
        return False
    own = attributes(text)
    if "hidden" in own and own["hidden"].lower() != "false" or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return True
    return any(marked(own.get(k, ""), within) for k in ("class", "id", "role"))


@dataclass
class Page:
    """Lines with weight, container and whether they are headings; containers with parent and whether they are an article. A gap is a line without text."""

    text: list[str] = field(default_factory=list)
    weight: list[int] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])
    article: list[bool] = field(default_factory=lambda: [False])

    def add(self, text: str, weight: int, of: int, heading: bool = False) -> None:
        self.text.append(text)
        self.weight.append(weight)
        self.of.append(of)
        self.heading.append(heading)


def stripped(html: str) -> str:
    """Without comments, declarations and elements whose content is never text."""
    out, at, unclosed = [], 0, set()
    while m := START.search(html, at):
        out += (html[at : m.start()], " ")
        at, name = m.end(), (m["name"] or "").lower()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = end + 3 if end >= 0 else len(html)
        elif name and name not in unclosed and not (name in ("svg", "math") and m[0].endswith("/>")):
            if end := END[name].search(html, at):
                at = end.end()
            elif name in RAW.split():
                at = len(html)
            else:
                unclosed.add(name)
    return "".join(out) + html[at:]


def page_of(html: str) -> Page:
    parts = TAG.split(stripped(html))
    page = Page()
    last_end: dict[str, int] = {}
    for i in range(1, len(parts), 4):
        if parts[i]:
            last_end[parts[i + 1].lower()] = i
    got: list[str] = [parts[0]]
    linked, skip, skipped, in_link, heading, articles = 0, "", 0, False, False, 0
    stack: list[tuple[str, int]] = [("", 0)]
    open_: dict[str, int] = {}

    def close():
        nonlocal linked
        if got:
            text = " ".join(unescape("".join(got)).split())
            if text:
                page.add(text, max(0, len(text) - linked), stack[-1][1], heading)
            got.clear()
        linked = 0

    for i in range(1, len(parts), 4):
        shut, name, attrs, text = parts[i], parts[i + 1].lower(), parts[i + 2], parts[i + 3]
        if skip:
            if name == skip:
                skipped += -1 if shut else 1
            # Elements with an optional end tag end at the next block.
            if skipped and not (skip in ("p", "li") and name not in INLINE):
                continue
            ended = skip == name
            skip, skipped = "", 0
            if ended:
                got.append(text)
                continue
        if not shut and name not in VOID and not attrs.endswith("/") and boilerplate(name, attrs, articles > 0):
            if name not in INLINE:
                close()
                page.add("", 0, stack[-1][1])
            if name in ("p", "li") or last_end.get(name, 0) > i:
                skip, skipped = name, 1
                continue
        if name in INLINE:
            if name == "a":
                in_link = not shut
            if name == "br":
                got.append(" ")
        else:
            close()
            heading = name in HEADINGS and not shut
            if name in CONTAINERS and not shut:
                page.parent.append(stack[-1][1])
                page.article.append(name in ("article", "main"))
                stack.append((name, len(page.parent) - 1))
                open_[name] = open_.get(name, 0) + 1
                articles += page.article[-1]
            elif name in CONTAINERS and open_.get(name):
                while True:
                    was, number = stack.pop()
                    open_[was] -= 1
                    articles -= page.article[number]
                    if was == name:
                        break
        got.append(text)
        if in_link:
            linked += len(text)
    close()
    return page


def windows(weight: np.ndarray) -> np.ndarray:
    """Sum of each line's weight and those of the ``WINDOW`` - 1 after it."""
    total = np.concatenate([[0], np.cumsum(weight)])
    return total[np.minimum(np.arange(len(weight)) + WINDOW, len(weight))] - total[:-1]


def surges(weight: np.ndarray, gap: np.ndarray, least: float) -> bool:
    """Whether a window without a gap in it reaches ``least``."""
    cuts = np.flatnonzero(gap)
    return any(len(part) and windows(part).max() >= least for part in np.split(weight, cuts))


def runs(mark: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def stretches(weight: np.ndarray, gap: np.ndarray, least: float) -> np.ndarray:
    """Which lines lie in stretches that have a surge point; gaps and windows without weight end a stretch, links at its ends are none of it."""
    end = gap.copy()
    for a, b in runs(weight == 0):
        end[a:b] |= b - a >= WINDOW
    keep = np.zeros(len(weight), bool)
    for a, b in runs(~end):
        own = np.flatnonzero(weight[a:b]) + a
        if len(own) and windows(weight[a:b]).max() >= least:
            keep[own[0] : own[-1] + 1] = True
    return keep


def extract(html: str | None) -> str:
    page = page_of(html or "")
    n, size = len(page.parent), len(page.text)
    weight, of, gap = np.array(page.weight, np.int64), np.array(page.of, np.int64), np.array([not t for t in page.text], bool)
    parent, article = page.parent, page.article

    # A container of one line, other than an article, is that line. Parents have smaller numbers than their children.
    lines, kids, to = np.bincount(of, minlength=n).tolist(), [0] * n, list(range(n))
    for c in range(1, n):
        kids[parent[c]] += 1
    for c in range(n - 1, 0, -1):
        if not kids[c] and lines[c] <= 1 and not article[c]:
            to[c] = parent[c]
            kids[parent[c]] -= 1
            lines[parent[c]] += lines[c]
    for c in range(1, n):
        to[c] = to[to[c]]
    of = np.array(to)[of] if size else of
    # Weight and run of lines of each container with all that is in it; the child with most weight.
    sums = np.bincount(of, weight, n).tolist()
    first, last = np.full(n, size), np.zeros(n, np.int64)
    np.minimum.at(first, of, np.arange(size))
    np.maximum.at(last, of, np.arange(size) + 1)
    first, last, biggest = first.tolist(), last.tolist(), [-1] * n
    for c in range(n - 1, 0, -1):
        if to[c] == c:
            p = parent[c]
            sums[p], first[p], last[p] = sums[p] + sums[c], min(first[p], first[c]), max(last[p], last[c])
            if biggest[p] < 0 or sums[c] >= sums[biggest[p]]:
                biggest[p] = c

    least = min(SURGE, windows(weight).max() / 2) if size else 0
    here = 0
    while not article[here] and biggest[here] >= 0:
        child = biggest[here]
        a, b, x, y = first[child], last[child], first[here], last[here]
        out, cut = np.concatenate([weight[x:a], [0], weight[b:y]]), np.concatenate([gap[x:a], [True], gap[b:y]])
        named = any(page.heading[x:a]) or any(page.heading[b:y])
        light = article[child] and out.sum() < AROUND * sums[child]
        if not sums[child] or not light and (named or surges(out, cut, least)):
            break
        here = child
    keep = np.zeros(size, bool)
    if article[here]:
        keep[first[here] : last[here]] = True
    else:
        # Its own lines, cut where its containers stand, and each of its containers.
        at, own, cuts = first[here], [], []
        while at < last[here]:
            child = int(of[at])
            if child == here:
                own.append(at)
                cuts.append(bool(gap[at]))
                at += 1
                continue
            while to[parent[child]] != here:
                child = parent[child]
            a, b = first[child], last[child]
            keep[a:b] = surges(weight[a:b], gap[a:b], least) if article[child] else stretches(weight[a:b], gap[a:b], least)
            own.append(-1)
            cuts.append(True)
            at = b
        good = stretches(np.array([weight[i] if i >= 0 else 0 for i in own], np.int64), np.array(cuts, bool), least)
        for i, k in zip(own, good):
            if i >= 0:
                keep[i] = k
    return "\n\n".join(t for t, k in zip(page.text, keep) if k and t)


def extractor(batches):
    for batch in batches:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: ``page_id``, ``url`` and ``text``."""
    return df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(trimmed(extractor), "page_id bigint, url string, text string")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: For pages whose article is an article element of headings and paragraphs with plain references, as in the driver's table.
SQL = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g'), '</?(?:p|h[1-6]|article)>') AS parts FROM pages
), t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(?:39|x27);', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM a
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
