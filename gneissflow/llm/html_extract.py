"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser sends events; no tree is built.  A *line* is the text between two
block-level tags, with the number of tags that stand in and around it.

1. Menus, footers, sidebars, forms, notices, adverts and comments are known by their element, role,
   or the words of their class and id; their lines keep their tags but count as no text.
2. The ratio of characters to tags of each line is smoothed by a Gaussian over its neighbours.  The
   smoothed ratios fall into two clusters at the threshold that parts them best; lines in the upper
   cluster are *content lines*.
3. The region: the ``article`` (or else ``main``) with most text in content lines; without either,
   the way down from the root goes on as long as one element holds ``HOLD`` of the content lines'
   text.  Every line of the region that step 1 left is kept, however short, so headings and short
   paragraphs of an article stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 2
HOLD = 0.7
#: Elements by their role (fixed values).
HIDDEN = set("script style noscript template head title svg math iframe object audio video canvas map".split())
BOILER = set("nav footer aside form menu dialog button select option textarea datalist".split())
BLOCK = set("""
html body main article section div header footer nav aside form fieldset menu dialog address blockquote center details summary
figure figcaption hgroup h1 h2 h3 h4 h5 h6 p pre ul ol li dl dt dd table caption thead tbody tfoot tr td th hr
""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
REGION = set("html body main article section div header center details td blockquote figure fieldset".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILER_WORDS = set("""
ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promotions nav navbar navigation menu
menus submenu breadcrumb breadcrumbs sidebar sidebars footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert
popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies share sharing social
related recommended recommendations widget widgets pagination pager search
""".split())
OWN_HEADER = set("article entry post story content main".split())
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: A start tag that ends an open element of these names, up to the given holders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def is_boiler(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is none of the page's main text, by its name and attributes."""
    if tag in BOILER or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    words: set[str] = set()
    for name, value in attrs:
        if name == "role" and value in BOILER_ROLES or name == "hidden":
            return True
        if name in ("class", "id") and value:
            words |= {w.lower() for w in _SPLIT.split(value)}
    return bool(words & BOILER_WORDS) or ("header" in words and not words & OWN_HEADER and not in_article)


class Lines(HTMLParser):
    """The lines of one page: text, tags, region and whether boilerplate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, int, bool]] = []
        self.region: list[tuple[int, str]] = [(-1, "")]  # parent, name; 0 is the page
        self.open: list[tuple[str, int, bool, bool]] = []  # name, region, boilerplate, hidden
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.tags = 0

    @property
    def top(self) -> tuple[str, int, bool, bool]:
        return self.open[-1] if self.open else ("", 0, False, False)

    def flush(self) -> None:
        told = " ".join("".join(self.text).split())
        if told or self.tags:
            _, region, boiler, _ = self.top
            self.rows.append((told, self.tags, region, boiler))
        self.text, self.tags = [], 0

    def close_to(self, index: int) -> None:
        while len(self.open) > index:
            name = self.open.pop()[0]
            self.count[name] -= 1

    def close_within(self, names: set[str], holders: set[str]) -> None:
        """Close the innermost open element of ``names``, if no holder lies in between."""
        if any(self.count.get(n) for n in names):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in names:
                    return self.close_to(i)
                if self.open[i][0] in holders:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if block:
            self.flush()
            if tag == "body":
                self.close_within({"head"}, {"body"})
            self.close_within({"p"}, REGION)
            if tag in CLOSES:
                self.close_within(*CLOSES[tag])
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, region, boiler, hidden = self.top
        if tag in REGION:
            self.region.append((region, tag))
            region = len(self.region) - 1
        boiler = boiler or is_boiler(tag, attrs, bool(self.count.get("article") or self.count.get("main")))
        self.open.append((tag, region, boiler, hidden or tag in HIDDEN))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if self.count.get(tag):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    return self.close_to(i)
        return None

    def handle_data(self, data: str) -> None:
        if not self.top[3]:
            self.text.append(data)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    return np.convolve(np.pad(ratio, RADIUS, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """The cut of the values into two clusters with the least squared distances within them."""
    v = np.sort(values)
    n, s, q = np.arange(1, len(v)), np.cumsum(v)[:-1], np.cumsum(v * v)[:-1]
    if not len(n) or v[0] == v[-1]:
        return -1.0
    total, squares = v.sum(), (v * v).sum()
    within = (q - s * s / n) + (squares - q - (total - s) ** 2 / (len(v) - n))
    cut = int(np.argmin(within))
    return float((v[cut] + v[cut + 1]) / 2)


def main_text(html: str | None) -> str:
    """The blocks of the page's main text, joined by an empty line; '' if there is none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    rows = page.rows
    if not rows:
        return ""
    size = np.array([0 if boiler else len(text) for text, _, _, boiler in rows])
    ratio = smoothed(size / np.maximum([tags for _, tags, _, _ in rows], 1))
    weight = np.where(ratio > threshold(ratio), size, 0)
    if not weight.any():
        weight = size
    if not weight.any():
        return ""
    held = [0] * len(page.region)  # text of content lines in each region
    whole = [0] * len(page.region)
    for (_, _, region, _), w, n in zip(rows, weight.tolist(), size.tolist(), strict=True):
        held[region] += w
        whole[region] += n
    heavy: dict[int, int] = {}  # the child of a region that holds most
    for i in range(len(page.region) - 1, 0, -1):
        up = page.region[i][0]
        held[up] += held[i]
        whole[up] += whole[i]
        if up not in heavy or held[i] >= held[heavy[up]]:
            heavy[up] = i
    chosen = 0
    for name in ("article", "main"):
        named = [i for i, (_, tag) in enumerate(page.region) if tag == name and whole[i]]
        if named:
            chosen = max(named, key=lambda i: (held[i], whole[i], -i))
            break
    else:
        while chosen in heavy and held[heavy[chosen]] >= HOLD * held[0] and held[0]:
            chosen = heavy[chosen]
    inside = [False] * len(page.region)
    for i, (up, _) in enumerate(page.region):
        inside[i] = i == chosen or (up >= 0 and inside[up])
    return "\n\n".join(text for text, _, region, boiler in rows if text and not boiler and inside[region])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, math.ceil(rows * (8 << 20) / max(batch.nbytes, 1))))  # some 8 MB of pages at a time
        for a in range(0, rows, step):
            part = batch.slice(a, step)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row for each row of pages(page_id, url, html).

    Null and empty pages, and pages without main text, have an empty text.  Character references are
    decoded, white space in a block becomes one space, blocks are joined by an empty line.  Nothing is
    shuffled; repeated rows give repeated rows; other columns are not read.
    """
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


#: DuckDB SQL for pages whose main text is one ``article`` of headings and paragraphs with the references below.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS bs FROM a),
c AS (SELECT page_id, url, list_transform(bs, lambda x: replace(replace(replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#x27;', '''')) AS bs FROM b),
d AS (SELECT page_id, url, list_filter(list_transform(bs, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS bs FROM c)
SELECT page_id, url, array_to_string(bs, chr(10) || chr(10)) AS text, CAST(length(array_to_string(bs, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM d"""
