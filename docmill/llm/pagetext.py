"""Main text of HTML pages by site template removal.

Each page is read once, in linear time, into blocks of text and element subtrees. A subtree's
hash covers its tag, class, id and text with digits masked. Spark counts, per host, in how many
different pages a hash occurs; subtrees that recur on many pages of their host are its template
and go with all blocks in them. "Many" depends on what recurs: a container beside an <article> or
<main> needs max(``min_pages``, ``beside_share`` of the host's pages), one on a page that has
neither ``bare_share`` of them, and prose or anything inside an article, which may quote, needs
max(``min_prose_pages``, ``prose_share`` of them).
Pages that share their content's first and last block by hash count once, so copies and near
copies of an article do not make it a template.

Then come two plainer checks. Elements that are not content by their kind (scripts, menus,
footers, forms, asides, and adverts, notices or comments by role, class or id) go where the
template left them: their words may differ on each page, and a host may have a single page.
Class names are taken as a whole: ``share-buttons`` is such a name, ``share-price`` is not. Neither
drops what holds the page itself: an element with the page's <main> in it, and a form, an aside or an
element named for its layout (``has-sidebar``) that holds the page's first <article> or, on a page with
neither, four fifths of its text. Comments stay out, headings are judged by no name, and inside an
article nothing goes for being a header.
Last, where <article> and <main> hold most of the text that is left, the rest goes.

Edge cases: null or empty html gives an empty text; a null or odd url is a host of its own;
unclosed tags end with their parent, a tag that the page's end cuts off is markup; repeated rows
are extracted each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import cut, table

# Element kinds of HTML.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form button select option textarea input dialog menu title".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr table tbody thead dl figcaption figure caption".split())
ROOTS = frozenset(("article", "main"))
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words that name what is not content, and words that only say which or where.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent notice gdpr newsletter subscribe popup modal share sharing social related recommended comment comments "
    "disqus replies respond widget toolbar pager pagination".split()
)
PLACES = frozenset(
    "site page main top bottom left right global primary secondary wrapper container box bar block slot list section area inner outer item items link links "
    "button buttons icon icons form unit group panel row col content posts thread skip to side sticky fixed mobile desktop".split()
)
_TAG_END = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE, _DIGIT, _PART = re.compile(r"\s+"), re.compile(r"\d+"), re.compile(r"[-_\d]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


def names_no_content(names: str) -> frozenset[str]:
    """The words that name no content in the first name that is made only of known words; empty if there is none."""
    for name in names.split():
        parts = [p.lower() for p in _PART.split(name) if p]
        if any(p in NAMES for p in parts) and all(p in NAMES or p in PLACES for p in parts):
            return NAMES.intersection(parts)
    return frozenset()


def tags(html: str):
    """(text before, tag, whether it closes, attributes' text) of each tag, in linear time; the
    content of raw elements comes with a closing tag of theirs. The last tag is empty."""
    at, start, size, quoted = 0, 0, len(html), True
    while True:
        i = html.find("<", at)
        if i < 0 or i + 1 >= size:
            break
        mark = html[i + 1]
        if mark == "!" or mark == "?":
            end = html.find("-->", i + 4) if html.startswith("<!--", i) else html.find(">", i)
            yield html[start:i], "!", False, ""
            if end < 0:
                return
            at = start = end + (3 if html.startswith("<!--", i) else 1)
            continue
        closes = mark == "/"
        name = _NAME.match(html, i + 1 + closes)
        if not name:
            if closes:  # a bogus comment
                yield html[start:i], "!", False, ""
                end = html.find(">", i)
                if end < 0:
                    return
                at = start = end + 1
            else:
                at = i + 1
            continue
        end = _TAG_END.match(html, name.end()) if quoted else None
        if not end:  # quotes are not balanced from here on
            quoted = False
            stop = html.find(">", name.end()) + 1
        else:
            stop = end.end()
        if not stop:
            yield html[start:i], "", False, ""
            return
        tag = name[0].lower()
        yield html[start:i], tag, closes, html[name.end() : stop - 1]
        at = start = stop
        if tag in RAW and not closes:
            end = _RAW_END[tag].search(html, at)
            yield html[at : end.start() if end else size], tag, True, ""
            if not end:
                return
            at = start = (html.find(">", end.start()) + 1) or size
    yield html[start:], "", False, ""


BESIDE, BARE, PROSE_LIKE = 0, 1, 2
#: Why an element is no content: for good, for a name, hidden, or for its kind or a name of the page's layout.
ALWAYS, NAMED, HIDDEN, LAYOUT = 1, 2, 3, 4
LAYOUT_NAMES = frozenset("sidebar nav navbar header masthead banner menu footer".split())
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def cause(tag: str, attrs: dict[str, str], names: str, in_article: bool) -> int:
    """Why an element is no content by itself; 0 if it isn't so."""
    if tag in DROPPED and tag not in ("form", "aside"):
        return ALWAYS
    if "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return HIDDEN
    if tag in ("form", "aside") or attrs.get("role", "").lower() in ROLES or (tag == "header" and not in_article):
        return LAYOUT
    if tag in ("html", "body") or tag in HEADINGS or names == " " or not (words := names_no_content(names)):
        return 0
    if words & COMMENT_NAMES:
        return ALWAYS
    if in_article and words <= {"header", "masthead"}:
        return 0
    return LAYOUT if words <= LAYOUT_NAMES else NAMED


class _Element:
    __slots__ = ("tag", "digest", "cause", "always", "in_root", "strict", "first", "holds_main", "holds_article")

    def __init__(self, tag, attrs, parent, n_blocks):
        self.tag, self.first = tag, n_blocks
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        self.in_root = bool(parent and (parent.in_root or parent.tag in ROOTS))
        self.strict = self.in_root or tag in PROSE or tag in ROOTS
        self.cause = cause(tag, attrs, names, self.in_root)
        self.always = bool(parent and parent.always) or self.cause == ALWAYS
        self.holds_main = self.holds_article = False
        self.digest = xxhash.xxh64(f"<{tag} {names}>")


def no_content(causes: list[tuple[int, int, int, bool, bool]], sizes: list[int], has_root: bool) -> np.ndarray:
    """Which blocks lie in an element that is no content. ``causes``: first block, end block, cause, whether it
    holds <main>, whether the first <article>; ``sizes``: the blocks' lengths, 0 for what is never content."""
    edge, ahead = np.zeros(len(sizes) + 1, np.int64), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    for first, end, why, main, article in causes:
        holds = why != ALWAYS and (main or (article and why != NAMED))
        if why == LAYOUT and not has_root and 5 * (ahead[end] - ahead[first]) >= 4 * ahead[-1]:
            holds = True
        if not holds:
            edge[first] += 1
            edge[end] -= 1
    return np.cumsum(edge)[: len(sizes)] > 0


def page_blocks(html: str | None, kinds: bool = True) -> tuple[list[str | None], list[bool], list[int], list[int], list[int]]:
    """The blocks' texts (None: no content by its kind), whether each lies in <article> or
    <main>, and the subtrees that hold blocks: hash (its lowest two bits tell BESIDE, BARE or
    PROSE_LIKE), first block, end block."""
    blocks: list[str | None] = []
    rooted: list[bool] = []
    sizes: list[int] = []
    causes: list[tuple[int, int, int, bool, bool]] = []
    trees: tuple[list[int], list[int], list[int]] = ([], [], [])
    stack: list[_Element] = []
    open_: Counter[str] = Counter()
    text: list[str] = []
    articles = 0

    def flush():
        joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if joined:
            top = stack[-1] if stack else None
            blocks.append(joined)
            sizes.append(0 if top and top.always else len(joined))
            rooted.append(bool(top and (top.in_root or top.tag in ROOTS)))
            if top:
                top.digest.update(_DIGIT.sub("0", joined).encode("utf-8", "surrogatepass"))

    def close():
        e = stack.pop()
        open_[e.tag] -= 1
        if e.first < len(blocks):
            if e.cause:
                causes.append((e.first, len(blocks), e.cause, e.holds_main, e.holds_article))
            if e.tag not in ("html", "body", "main"):
                for kept, value in zip(trees, (e.digest.intdigest() & ~3 | PROSE_LIKE * e.strict, e.first, len(blocks)), strict=True):
                    kept.append(value)
        if stack:
            stack[-1].digest.update(e.digest.digest())

    for before, tag, closes, rest in tags(html or ""):
        if before and not (closes and tag in RAW):
            text.append(before)
        if tag == "!":
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        if text:
            flush()
        if closes:
            if open_[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        while stack and (stack[-1].tag in ENDS.get(tag, ()) or (stack[-1].tag == "p" and tag in CLOSES_P)):
            close()
        if tag in VOID or not tag:
            continue
        attrs: dict[str, str] = {}
        for k, a, b, c in _ATTR.findall(rest) if rest else ():
            attrs.setdefault(k.lower(), a or b or c)
        stack.append(_Element(tag, attrs, stack[-1] if stack else None, len(blocks)))
        open_[tag] += 1
        if tag in ROOTS and not stack[-1].always:
            articles += tag == "article"
            if tag == "main" or articles == 1:
                for e in stack[:-1]:
                    e.holds_main |= tag == "main"
                    e.holds_article |= tag == "article"
    while stack:
        close()
    if True not in rooted:
        trees[0][:] = [h if h & PROSE_LIKE else h | BARE for h in trees[0]]
    if kinds and causes:
        for i in np.flatnonzero(no_content(causes, sizes, True in rooted)):
            blocks[i] = None
    return blocks, rooted, *trees


def page_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 3,
    min_prose_pages: int = 10,
    beside_share: float = 0.002,
    bare_share: float = 0.1,
    prose_share: float = 0.5,
    kinds: bool = True,
    roots: bool = True,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(id, url, text, n_chars, n_template, n_kind, n_outside) of every page: the numbers of
    blocks that the template, their kind, and their place outside <article> took out. ``kinds``
    and ``roots`` turn the checks after the template off."""
    kind = pages.schema[id_col].dataType.simpleString()
    digest = lambda s: int(np.uint64(xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))).view(np.int64))

    def run(batches):
        for b in batches:
            out = []
            for h in b["_html"]:
                blocks, rooted, hashes, starts, ends = page_blocks(h, kinds)
                kept = [t for t, r in zip(blocks, rooted, strict=True) if t is not None and (r or True not in rooted)]
                each = [digest(t) for t in kept] or [0]
                ints = [np.array(x, np.int32).tobytes() for x in (starts, ends)]
                out.append((blocks, np.array(rooted, bool).tobytes(), np.array(hashes, np.uint64).view(np.int64), *ints, digest("\n".join(kept)), min(each) ^ max(each) << 1 & (1 << 63) - 1))
            made = pd.DataFrame(out, columns=["blocks", "rooted", "hashes", "starts", "ends", "page", "like"])
            yield pd.concat([b[["_id", "url", "host"]].reset_index(drop=True), made], axis=1)

    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.xxhash64(host).alias("host"), F.col(html_col).alias("_html"))
    shape = f"_id {kind}, url string, host long, blocks array<string>, rooted binary, hashes array<long>, starts binary, ends binary, page long, like long"
    parsed = cut(rows.mapInPandas(run, shape), "pages")
    trees = parsed.select("host", "like", F.explode(F.array_distinct("hashes")).alias("hash"))
    seen = trees.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sizes = parsed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    place = F.col("hash").bitwiseAND(3)
    share = F.when(place == BESIDE, beside_share).when(place == BARE, bare_share).otherwise(prose_share)
    most = F.greatest(F.when(place == PROSE_LIKE, min_prose_pages).otherwise(min_pages), share * F.col("pages"))
    template = cut(seen.join(sizes, "host").where(F.col("n") >= most).select("host", "hash"), "template")
    # the rows of a host's template are few; its pages may be a third of all, so those stay where they are
    gone = template.groupBy("host").agg(F.collect_list("hash").alias("gone"))
    if template.count() <= broadcast_rows:
        gone = F.broadcast(gone)

    def finish(batches):
        none = np.zeros(0, np.int64)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                n = len(r.blocks)
                rooted = np.frombuffer(r.rooted, bool)
                hit = np.isin(r.hashes, none if r.gone is None else r.gone)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.frombuffer(r.starts, np.int32)[hit], 1)
                np.add.at(edge, np.frombuffer(r.ends, np.int32)[hit], -1)
                template = np.cumsum(edge)[:n] > 0
                unkind = np.fromiter((t is None for t in r.blocks), bool, n) & ~template
                keep = ~template & ~unkind
                size = np.fromiter((len(t or "") for t in r.blocks), np.int64, n)
                outside = keep & ~rooted
                if not roots or 2 * size[keep & rooted].sum() < max(1, size[keep].sum()):
                    outside[:] = False
                keep &= ~outside
                text = "\n".join(t for t, k in zip(r.blocks, keep, strict=True) if k)
                out.append((text, len(text), *(int(x.sum()) for x in (template, unkind, outside))))
            made = pd.DataFrame(out, columns=["text", "n_chars", "n_template", "n_kind", "n_outside"])
            yield pd.concat([b[["_id", "url"]].reset_index(drop=True), made], axis=1)

    own = F.array_intersect("hashes", "gone").alias("gone")
    held = parsed.join(gone, "host", "left").select("_id", "url", "blocks", "rooted", "hashes", "starts", "ends", own)
    shape = f"_id {kind}, url string, text string, n_chars long, n_template long, n_kind long, n_outside long"
    out = held.mapInPandas(finish, shape)
    return out.select(F.col("_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_template", "n_kind", "n_outside")


def op2_page_text(spark, sf_dir):
    return page_text(table(spark, sf_dir, "pages"))
