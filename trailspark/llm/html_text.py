"""Operator 2: main text of pages, with the runs of words that pages of a host repeat.

A page is cut into blocks with a zone: *main* (inside an article or main element or what is named like
one), *outside* (menus, headers, footers, sidebars, notices, adverts, forms, comments; never text) or
*open* (neither).  A page with a main zone yields its main blocks, any other its open ones; of both, what
the host's pages repeat is removed and unique runs stay.  Zones only say how much a run must be repeated:
outside main zones ``run_tokens`` tokens on two distinct pages are boilerplate, inside them
``main_tokens`` tokens on three and on ``least_share`` of the host's pages, which spares a sentence that
two articles quote.

A suffix array of the host's token stream puts suffixes with equal first tokens side by side; only its
groups at these two depths matter.  ``main_texts`` sorts it for a list of pages in memory.  Over a table
the same groups are made by hashes of host and first tokens of each suffix: each distinct page deals its runs by
these, so no host is too large for a task.  Inside main zones only pages that share a seed
(the least of any ``main_tokens - run_tokens + 1`` runs of ``run_tokens``, which equal ``main_tokens``
share) are looked at in full.

Edge cases: null, empty or markup-free html is read as it stands (null: empty text); a null url is a
host of its own; broken markup never fails; copies of a page don't make each other boilerplate (pages of
equal other text, and in main zones of equal main text, count as one); a null page_id stays null; repeated
rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, materialize, mix, settled, signed, windows

MAIN, OPEN, OUTSIDE = 0, 1, 2
#: Elements of HTML by their part in a page.
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "select", "math", "audio", "video", "title")
_OUT = frozenset(("nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "figcaption", "label", "input"))
_MAIN = frozenset(("article", "main"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset(("address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
_P_ENDS = _BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_OUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumbs?|header|masthead|footer|foot|sidebar|side-bar|aside|cookies?|consent|gdpr|banner|notice|notices|alert|popup|modal|overlay|ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|signup|sign-up|login|search|pagination|pager|widget|copyright|legal|skip|toolbar|tags?)(?:$|[\s_-]|\d)",
    re.I,
)
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"))
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(" + "|".join(_RAW) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MAIN_WORDS = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)|article|story|content|main)(?:$|\s)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_outside(name: str, attributes: str) -> bool:
    if name in _OUT:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _OUT_WORDS.search(value) or key == "role" and value.strip().lower() in _ROLES:
            return True
        if key == "hidden" and value.lower() != "until-found" or key == "style" and _HIDDEN.search(value) or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def _is_main(name: str, attributes: str) -> bool:
    if name in _MAIN:
        return True
    if name not in ("div", "section", "td") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _MAIN_WORDS.search(value) or key == "role" and value.strip().lower() == "main" or key == "itemprop" and value == "articleBody":
            return True
    return False


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in page order, references decoded and white space joined."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    # one entry for each open element: name, zone inside it
    stack: list[tuple[str, int]] = [("", OPEN)]
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][1], text))
            parts.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    flush() if stack[k][1] != stack[k - 1][1] else None
                    del stack[k:]
                    break
                # the end of an inline element doesn't close the block that holds it
                if name not in _BLOCK and stack[k][0] in _BLOCK:
                    break
            continue
        outside = _is_outside(name, m[4])
        if name in _BLOCK or outside:
            flush()
        if name in _P_ENDS:  # an open paragraph ends where a block begins, with what is open inside it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == name:
            stack.pop()
        if name in _VOID or m[4].endswith("/") and name not in _BLOCK:
            continue
        zone = stack[-1][1]
        if zone != OUTSIDE and _is_main(name, m[4]):
            zone = MAIN
        # a header inside an article holds its title
        if outside and not (name == "header" and stack[-1][1] == MAIN and not m[4].strip()) and not (name == "figcaption" and zone == MAIN):
            zone = OUTSIDE
        stack.append((name, zone))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def suffix_ranks(tokens: np.ndarray, stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of a suffix array over concatenated streams, sorted to ``depth`` tokens by prefix doubling.

    Suffixes that agree in ``depth`` tokens have one rank; the second array says which have so many
    tokens before their stream ends.
    """
    n = len(tokens)
    last = np.append(np.flatnonzero(stream[1:] != stream[:-1]), n - 1)
    room = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(n) + 1
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.full(n, -1, np.int64)
        at = np.flatnonzero(room > step)
        after[at] = rank[at + step]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank, room >= depth


def boilerplate_tokens(tokens: np.ndarray, stream: np.ndarray, page: np.ndarray, pages: int, depth: int, least: int) -> np.ndarray:
    """Tokens covered by runs of ``depth`` tokens that ``least`` distinct pages have."""
    if not len(tokens):
        return np.zeros(0, bool)
    rank, whole = suffix_ranks(tokens, stream, depth)
    seen = np.unique(rank[whole] * np.int64(pages) + page[whole]) // pages
    often = np.bincount(seen, minlength=int(rank.max()) + 1) >= least
    starts = np.flatnonzero(whole & often[rank])
    edge = np.zeros(len(tokens) + depth + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + depth, -1)
    return np.cumsum(edge)[: len(tokens)] > 0


def main_texts(pages: list[list[tuple[int, str]]], run_tokens: int = 8, main_tokens: int = 16, least_share: float = 0.2) -> list[str]:
    """Main texts of pages of one host, given their blocks."""
    hashes = WordHashes()
    marks: list[list[np.ndarray]] = [[np.zeros(0, bool)] * len(blocks) for blocks in pages]
    for main, depth in ((False, run_tokens), (True, main_tokens)):
        number: dict[tuple, int] = {}
        h, stream, page, where = [], [], [], []
        for k, blocks in enumerate(pages):
            mine = [(j, t) for j, (z, t) in enumerate(blocks) if (z == MAIN) == main]
            # copies of a page are one page
            who = number.setdefault(tuple(t if main else blocks[j] for j, t in mine), len(number))
            for j, text in mine:
                h.append(hashes.of([w.encode() for w in text.split(" ")]))
                stream.append(np.full(len(h[-1]), len(where), np.int64))
                page.append(np.full(len(h[-1]), who, np.int64))
                where.append((k, j))
        if where:
            least = max(3, int(np.ceil(least_share * len(number)))) if main else 2
            covered = boilerplate_tokens(np.concatenate(h), np.concatenate(stream), np.concatenate(page), len(number), depth, least)
            for (k, j), m in zip(where, np.split(covered, np.cumsum([len(x) for x in h])[:-1]), strict=True):
                marks[k][j] = m
    return [_kept(blocks, m) for blocks, m in zip(pages, marks, strict=True)]


def _kept(blocks: list[tuple[int, str]], marks: list[np.ndarray]) -> str:
    """The text of a page; ``marks``: which tokens of each block are boilerplate."""
    zone = MAIN if any(z == MAIN for z, _ in blocks) else OPEN
    keep = []
    for (z, text), m in zip(blocks, marks, strict=True):
        if z != zone:
            continue
        rest = " ".join(w for w, x in zip(text.split(" "), m, strict=True) if not x) if m.any() else text
        if rest:
            keep.append(rest)
    return "\n".join(keep)


def block_runs(blocks: list[tuple[int, str]], hashes: WordHashes, main: bool, tokens: int) -> list[np.ndarray]:
    """Hashes of the runs of the blocks inside or outside main zones; none in a block that is too short."""
    each = [hashes.of(text.encode().split(b" ")) for z, text in blocks if (z == MAIN) == main]
    return [windows(h, tokens) if len(h) >= tokens else h[:0] for h in each]


def seeds(runs: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` runs that begin one after the other."""
    if len(runs) < width:
        return runs[:0]
    return np.unique(np.lib.stride_tricks.sliding_window_view(runs, width).min(axis=1))


def _covered(runs: np.ndarray, length: int, repeated: np.ndarray, tokens: int) -> np.ndarray:
    starts = np.flatnonzero(np.isin(runs, repeated))
    edge = np.zeros(length + tokens + 1, np.int64)
    edge[starts] += 1
    edge[starts + tokens] -= 1
    return np.cumsum(edge)[:length] > 0


def _identity(blocks: list[tuple[int, str]], main: bool, h: int) -> int:
    # copies of a page are one page of host h
    return xxhash.xxh64_intdigest("\n".join(t if main else f"{z}{t}" for z, t in blocks if (z == MAIN) == main).encode(), seed=h & (2**64 - 1)) - (1 << 63)


def _of_host(hashes: np.ndarray, h: int) -> np.ndarray:
    """Hashes that hold for host h alone, so a run needs no column for its host."""
    return mix(hashes ^ np.uint64(h & (2**64 - 1)))


def _counts(rows: DataFrame, who: str, runs: str, least: int) -> DataFrame:
    """run, n, h: runs that so many distinct pages of their host have; written.

    Each page comes once, so rows are counted, and what is counted goes over the network as the hash alone.
    """
    once = rows.select("h", who, runs).dropDuplicates([who])
    return materialize(once.select("h", F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h")).filter(F.col("n") >= least))


def repeated_runs(pages: DataFrame, run_tokens: int, main_tokens: int, least_share: float) -> DataFrame:
    """h, th, repeated: the runs of host h's boilerplate that are in the text of the html hashed th."""

    def start():
        hashes = WordHashes()

        def step(hosts, texts, htmls):
            out: list[list] = [[] for _ in range(7)]
            for h, th, page in zip(hosts, texts, htmls, strict=True):
                blocks = blocks_of(page)
                beside = block_runs(blocks, hashes, False, run_tokens)
                inside = [seeds(r, main_tokens - run_tokens + 1) for r in block_runs(blocks, hashes, True, run_tokens)]
                row = (h, th, _identity(blocks, False, h), _identity(blocks, True, h), all(z != MAIN for z, _ in blocks), *(signed(_of_host(np.unique(np.concatenate(r)), h)) if r else [] for r in (beside, inside)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return step

    cut = materialize(arrow_map(pages.select("h", "th", "html"), "h long, th long, who long, main long, open boolean, runs array<long>, seeds array<long>", start))
    beside = _counts(cut, "who", "runs", 2).select("run")
    here = cut.filter("open").select("h", "th", "runs").dropDuplicates(["h", "th"]).select("h", "th", F.explode("runs").alias("run")).join(beside, "run").select("h", "th", "run")

    shared = _counts(cut, "main", "seeds", 3).select("run")
    alike = cut.select("main", "seeds").dropDuplicates(["main"]).select("main", F.explode("seeds").alias("run")).join(shared, "run").select("main").distinct()
    near = materialize(cut.select("h", "th", "main").distinct().join(alike, "main").select("h", "th", "main"))

    def look():
        hashes = WordHashes()

        def step(hosts, texts, mains, htmls):
            found = [block_runs(blocks_of(page), hashes, True, main_tokens) for page in htmls]
            return [hosts, texts, mains, [signed(_of_host(np.unique(np.concatenate(r)), h)) if r else [] for h, r in zip(hosts, found, strict=True)]]

        return step

    looked = materialize(arrow_map(pages.join(near, ["h", "th"]).dropDuplicates(["h", "th"]).select("h", "th", "main", "html"), "h long, th long, main long, runs array<long>", look))
    sizes = cut.filter(~F.col("open")).select("h", "main").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("pages"))
    inside = materialize(_counts(looked, "main", "runs", 3).join(sizes, "h").filter(F.col("n") >= F.ceil(F.lit(least_share) * F.col("pages"))).select("run"))
    there = looked.select("h", "th", F.explode("runs").alias("run")).join(inside, "run").select("h", "th", "run")
    return here.unionByName(there).groupBy("h", "th").agg(F.collect_set("run").alias("repeated"))


def extract_main_text(pages: DataFrame, run_tokens: int = 8, main_tokens: int = 16, least_share: float = 0.2, partitions: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html), and n_removed: the tokens of boilerplate cut from it."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host).alias("h"), F.xxhash64("html").alias("th"))
    if partitions:
        rows = rows.repartition(partitions)
    repeated = settled(pages.sparkSession, lambda: repeated_runs(rows, run_tokens, main_tokens, least_share))
    joined = rows.join(repeated, ["h", "th"], "left").select("page_id", "url", "html", "h", "repeated")

    def start():
        hashes = WordHashes()

        def step(ids, urls, htmls, hosts, repeated):
            texts, gone = [], []
            for page, h, found in zip(htmls, hosts, repeated, strict=True):
                blocks = blocks_of(page)
                main = any(z == MAIN for z, _ in blocks)
                zone, tokens = (MAIN, main_tokens) if main else (OPEN, run_tokens)
                marks = [np.zeros(text.count(" ") + 1, bool) for _, text in blocks]
                if found:
                    known = np.array(found, np.int64).view(np.uint64)
                    at = [j for j, (z, _) in enumerate(blocks) if (z == MAIN) == main]
                    for j, r in zip(at, block_runs(blocks, hashes, main, tokens), strict=True):
                        marks[j] = _covered(_of_host(r, h), len(marks[j]), known, tokens)
                texts.append(_kept(blocks, marks))
                gone.append(sum(int(m.sum()) for (z, _), m in zip(blocks, marks, strict=True) if z == zone))
            return [ids, urls, texts, [len(t) for t in texts], gone]

        return step

    return arrow_map(joined, "page_id long, url string, text string, n_chars long, n_removed long", start)
