"""Main text of HTML pages: blocks by markup, boilerplate by long runs of tokens that a host's pages repeat.

The pages of a host are one stream of tokens. Suffixes of it that agree in their
first LONG tokens are neighbours in its suffix array, so at this depth the array is
its groups of suffixes with equal first LONG tokens, and the tokens that a group
covers are its maximal repeats of at least LONG tokens. Boilerplate is what SEVERAL
distinct pages of a host hold of such repeats and of whole blocks, and, at a depth of
RUN tokens, what half of its distinct pages hold. Copies of a page count as one.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from opswell.llm.shingles import mix64, word_hashes
from opswell.session import settle

#: Tokens of a block or run that half of the pages hold, and of a run that is long enough with fewer.
RUN, LONG = 6, 24
#: Distinct pages that hold a run or block at least, and those that hold a block of an article (half of the host's as well).
SEVERAL, MANY = 3, 5
#: Bytes of blocks that are hashed together.
SLAB = 4 << 20
#: Numbers that are sent to all pages at most.
FEW = 1 << 20

# Kinds of elements.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "option", "button", "head", "title"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "address"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An element of these kinds ends an open one of the same row.
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
#: Elements past which an end tag or an implied end does not reach.
FENCES = {"article", "main", "section", "div", "ul", "ol", "dl", "table", "td", "th", "body", "nav", "footer", "aside", "form", "header", "blockquote"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|masthead|site-?header|page-?header|footer|side-?bar|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|newsletter|subscri\w+|sign-?up|login|comments?|comment-?list|disqus|respond|reply|share|sharing|social|related|recommend\w*|widget|skip-?link|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
#: What an article element is called that is not the page's own.
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|respond|advert\w*|sponsor\w*|promo\w*|related|teaser)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {n: re.compile(rf"</{n}\s*(?:>|\Z)", re.I) for n in ("script", "style", "textarea", "title", "template", "noscript", "iframe")}


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in FURNITURE and not (inside and name in ("header", "address")):
        return True
    if not attributes.strip(" /"):
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    named = COMMENT if name == "article" else NAMED
    return name not in ("html", "body", "main") and (found.get("role", "").lower() in ROLES or any(named.search(found.get(k, "")) for k in ("class", "id")))


def blocks(page: str) -> tuple[bool, list[tuple[bool, bool, str]]]:
    """Whether the page marks an article, and (inside it, in furniture, text) of each block in the page's order.

    Character references are decoded and white space is one space. A tag, comment or
    script that the page's end cuts off has no text.
    """
    out: list[tuple[bool, bool, str]] = []
    parts: dict[bool, list[str]] = {False: [], True: []}  # by furniture, so that an inline advert is not its block's text
    stack: list[tuple[str, bool, bool]] = []  # name, article, furniture: as they hold inside
    article = furniture = marked = False
    at, end = 0, len(page)

    def close():
        for bad, own in parts.items():
            text = " ".join(html.unescape("".join(own)).split())
            own.clear()
            if text:
                out.append((article, bad, text))

    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            parts[furniture].append(page[at:])
            break
        parts[furniture].append(page[at : tag.start()])
        at = tag.end()
        name = tag[2].lower() if tag[2] else ""
        if not name:
            continue
        if tag[1]:
            if name in BLOCKS:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in FENCES and name not in FENCES:
                    break
        else:
            if name in _RAW or name in HIDDEN and name not in ("head",):
                stop = (_RAW.get(name) or re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I)).search(page, at)
                if not tag[3].rstrip().endswith("/") or name in _RAW:
                    at = stop.end() if stop else end if name in _RAW else at
                continue
            if name in BLOCKS:
                close()
            elif name == "br":
                parts[furniture].append(" ")
            if name in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ENDS[name]:
                        del stack[i:]
                        break
                    if stack[i][0] in FENCES:
                        break
            if name not in VOID and not tag[3].endswith("/"):
                inside, bad = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                main = name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main", tag[3], re.I))
                marked |= main
                stack.append((name, inside or main, bad or _is_furniture(name, tag[3], inside)))
        article, furniture = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    close()
    return marked, out


def _parse(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                inside, outside, loose, own = [], [], [], []
                for page in part.column("html").to_pylist():
                    has_article, found = blocks(page or "")
                    inside.append([t for a, f, t in found if a and not f] if has_article else None)
                    rest = [(f, t) for a, f, t in found if not a]
                    outside.append([t for _, t in rest])
                    loose.append([not f and not has_article for f, _ in rest])
                    own.append("\n".join(inside[-1] if has_article else [t for f, t in rest if not f]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in keep),
                        part.column("host"),
                        pa.array(inside, pa.list_(pa.string())),
                        pa.array(outside, pa.list_(pa.string())),
                        pa.array(loose, pa.list_(pa.bool_())),
                        pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in own], pa.string()),
                    ],
                    [*keep, "host", "inside", "outside", "loose", "copy"],
                )

    return run


def _windows(h: np.ndarray, width: int, kind: int) -> np.ndarray:
    """Hash of the `width` tokens from each place on; none where fewer are left."""
    n = max(len(h) - width + 1, 0)
    g = np.full(n, kind, np.uint64)
    for k in range(width if n else 0):
        g = mix64(g ^ h[k : k + n]) + np.uint64(k)
    return g.view(np.int64)


def _whole(h: np.ndarray, counts: np.ndarray, kind: int) -> np.ndarray:
    """Hash of each block of RUN tokens or more, 0 for shorter. h: hashes of all tokens; counts: tokens of each block."""
    out, held = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    if len(held):
        starts = np.cumsum(counts) - counts
        place = np.arange(1, len(h) + 1, dtype=np.int64) - np.repeat(starts, counts)
        out[held] = mix64(np.bitwise_xor.reduceat(mix64(h + mix64(place.astype(np.uint64))), starts[held]) + np.uint64(kind))
    out[counts < RUN] = 0
    return out.view(np.int64)


#: Kinds of grams: runs of RUN and LONG tokens and whole blocks outside of articles, blocks inside.
SHORT_RUN, LONG_RUN, BLOCK, ARTICLE = 1, 2, 3, 4


def _tokens(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of some pages' blocks, tokens of each block, and the page of each block."""
    h, counts = word_hashes(lists.flatten())
    return h, counts, np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _grams(inside: pa.ListArray, outside: pa.ListArray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """By kind, the page of each gram and its hash (0: none), in order of place; and the tokens of each block outside."""
    h, counts, page = _tokens(outside)
    found, of = {BLOCK: (page, _whole(h, counts, BLOCK))}, np.repeat(page, counts)
    for kind, width in ((SHORT_RUN, RUN), (LONG_RUN, LONG)):
        g = _windows(h, width, kind)
        # A run that goes on into the next page is none.
        found[kind] = of[: len(g)], np.where(of[: len(g)] == of[len(of) - len(g) :], g, 0)
    own, sizes, page = _tokens(inside)
    return found | {ARTICLE: (page, _whole(own, sizes, ARTICLE))}, counts


def _slabs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some SLAB bytes of blocks, a page at least."""
    sizes = np.zeros(len(batch), np.int64)
    for c in ("inside", "outside"):
        lists = batch.column(c)
        size = pc.binary_length(lists.flatten()).fill_null(0).to_numpy(zero_copy_only=False)
        np.add.at(sizes, np.repeat(np.arange(len(batch)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), size)
    slab = (np.cumsum(sizes) - sizes) // SLAB
    starts = [0, *(np.flatnonzero(np.diff(slab)) + 1).tolist(), len(batch)]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of some pages and how many of these pages hold each."""
    for batch in batches:
        for part in _slabs(batch):
            found, _ = _grams(part.column("inside"), part.column("outside"))
            hosts = part.column("host").dictionary_encode()
            codes = hosts.indices.to_numpy()
            for kind, (page, g) in found.items():
                page, g = page[g != 0], g[g != 0]
                order = np.lexsort((page, g, codes[page]))
                page, g, host = page[order], g[order], codes[page][order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (host[1:] != host[:-1])
                once = new.copy()
                once[1:] |= page[1:] != page[:-1]
                n = np.add.reduceat(once.astype(np.int64), np.flatnonzero(new)) if len(g) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [hosts.dictionary.take(pa.array(host[new])), pa.array(np.full(len(n), kind, np.int32)), pa.array(g[new]), pa.array(n)], ["host", "kind", "gram", "n"]
                )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams that can take something from a page, each once: an article's blocks, or else all outside."""
    for batch in batches:
        for part in _slabs(batch):
            inside, outside = part.column("inside"), part.column("outside")
            found, _ = _grams(inside, pc.if_else(pc.is_null(inside), outside, pa.scalar(None, outside.type)))
            for kind, (page, g) in found.items():
                page, g = page[g != 0], g[g != 0]
                order = np.lexsort((g, page))
                page, g = page[order], g[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (page[1:] != page[:-1])
                at = pa.array(page[new])
                yield pa.RecordBatch.from_arrays([part.column("row").take(at), part.column("host").take(at), pa.array(np.full(len(at), kind, np.int32)), pa.array(g[new])], ["row", "host", "kind", "gram"])


def _unique_blocks(keep: list[str]):
    """The blocks without what the repeated grams of the page's host cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (inside, outside, loose, repeated) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("inside", "outside", "loose", "repeated")))):
                if not repeated:
                    out.append("\n".join(inside if inside is not None else [t for t, free in zip(outside, loose) if free]))
                    continue
                found, counts = _grams(batch.column("inside").slice(i, 1), batch.column("outside").slice(i, 1))
                again = {kind: np.isin(g, np.array(repeated, np.int64)) & (g != 0) for kind, (_, g) in found.items()}
                if inside is not None:
                    out.append("\n".join(t for t, cut in zip(inside, again[ARTICLE]) if not cut))
                    continue
                covered = np.repeat(again[BLOCK], counts)
                for kind, width in ((SHORT_RUN, RUN), (LONG_RUN, LONG)):
                    for p in np.flatnonzero(again[kind]):
                        covered[p : p + width] = True
                kept, at = [], 0
                for text, free, n in zip(outside, loose, counts):
                    cut, at = covered[at : at + n], at + n
                    if free and not cut.all():
                        kept.append(" ".join(w for w, c in zip(text.split(), cut) if not c) if cut.any() else text)
                out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    return run


def _side(rows: DataFrame, numbers) -> DataFrame:
    """Settled rows as one side of a join with the pages: sent to them if these are few numbers, else both sides are moved."""
    return F.broadcast(rows) if (rows.agg(F.sum(numbers)).first()[0] or 0) <= FEW else rows


def main_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` with `text`, the main text of each page.

    pages: url, html and whatever `keep` names. Where a page marks its article (an
    article or main element), its text is the article's blocks without furniture in
    it: navigation, forms, asides, comments, adverts, notices and what is hidden. A
    block of RUN tokens or more that MANY distinct articles of the host hold, and half
    of its distinct pages, is left out of them as well. Of a page without an article,
    the blocks that are no furniture are its text, without blocks of RUN tokens or more
    and runs of LONG that SEVERAL distinct pages hold, and without runs of RUN that
    half of the host's distinct pages hold as well.

    Pages of a host with the same text before that are copies and count as one page,
    so a copied page or article keeps its text. Null and empty pages have an empty
    text. Null urls and urls without a host are a host together. Repeated rows are
    pages each. Without rows the result is empty.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(*keep, "html", host.alias("host"))
    schema = rows.select(*keep, "host")._jdf.schema().toDDL() + ", inside array<string>, outside array<string>, loose array<boolean>, copy string"
    parsed = settle(rows.mapInArrow(_parse(keep), schema).withColumn("row", F.monotonically_increasing_id()))
    firsts = parsed.groupBy("host", "copy").agg(F.min("row").alias("row"))
    half = firsts.groupBy("host").agg((F.count(F.lit(1)) / 2).alias("half"))
    # Texts stay where they are as long as few pages are copies and few hold what is to be cut.
    copies = settle(parsed.select("row").join(firsts.select("row"), "row", "left_anti"))
    distinct = parsed.select("row", "host", "inside", "outside").join(_side(copies, F.lit(1)), "row", "left_anti")
    held = distinct.select("host", "inside", "outside").mapInArrow(_distinct, "host string, kind int, gram long, n long").groupBy("host", "kind", "gram").agg(F.sum("n").alias("n"))
    least = F.when(F.col("kind") == ARTICLE, MANY).otherwise(SEVERAL)
    shared = F.col("kind").isin(LONG_RUN, BLOCK) | (F.col("n") >= F.col("half"))
    repeated = settle(held.filter(F.col("n") >= least).join(half, "host").filter(shared).select("host", "kind", "gram"))
    mine = parsed.select("row", "host", "inside", "outside").mapInArrow(_placed, "row long, host string, kind int, gram long")
    # Outside of articles, runs tell only about pages without one.
    found = settle(mine.join(repeated, ["host", "kind", "gram"]).groupBy("row").agg(F.collect_list("gram").alias("repeated")))
    columns = ["inside", "outside", "loose", "repeated"]
    text_schema = rows.select(*keep)._jdf.schema().toDDL() + ", text string"
    return parsed.join(_side(found, F.size("repeated")), "row", "left").select(*keep, *columns).mapInArrow(_unique_blocks(keep), text_schema)
