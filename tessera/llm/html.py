"""Main-text extraction from raw web pages by host suffix arrays.

A page becomes a stream of tokens: block-level tags and text blocks. The streams of
a host, concatenated, have a suffix array; it is sparse, with the suffixes that begin
with a text block which markup doesn't exclude. Suffixes with a common start are
neighbours in it, and neighbours from distinct pages that share ``depth`` tokens
reveal a repeated substring. Names of substrings are made by prefix doubling down to
that depth, which suffices: a longer repeat is a chain of overlapping ones.
Neighbours are found by grouping on (host, name) with partial aggregation, so no
host, however large, is sorted in one task.

Which text stays
----------------
* Never: text inside menus, headers, footers, sidebars, notices, adverts, forms,
  scripts, styles and reader comments, told by element, role and class; and on pages
  with ``<article>`` or ``<main>``, text outside of these.
* Of the rest, what the array does not find to be the host's template: a stretch of
  blocks of at least LONG words, each in a substring that repeats on so many of the
  host's pages. More than half suffices where no element marks the article; inside a
  marked article it takes SURE of at least MANY pages, as articles do quote what
  other articles have.
* Pages with the same text count as one: a repeat that spans a whole page's text is
  a copy of an article, no template, and copied articles stay.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
OUT = frozenset("nav header footer aside form menu dialog button select label input search head script style noscript template iframe svg math object canvas textarea title xmp".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words of class and id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar sidebars rail menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended teaser "
    "comment comments commentlist disqus reply replies respond footer masthead topbar copyright legal disclaimer toolbar widget widgets pager pagination skip login".split()
)
# Those words that also hold for a paragraph or another piece of text inside an article.
TEXT_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription comment comments commentlist disqus reply replies footer".split()
)
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figure figcaption span b i em strong a small mark q cite code".split())
_CLASS = re.compile(r"""(?:\s|^)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}

#: Tokens of a repeated substring: a text block and the tag that ends it.
DEPTH = 2
#: Words of a stretch of template; pages of a host, and share of them, from which on a repeat inside marked articles is template.
LONG, MANY, SURE = 5, 10, 0.9
EXCLUDED, OUTSIDE, INSIDE = 0, 1, 2


def _excluded(name: str, attrs: str, in_main: bool) -> bool:
    if name in OUT:
        return True
    if not attrs:
        return False
    for kind, *values in _CLASS.findall(attrs):
        value = "".join(values).lower()
        if kind.lower() == "role":
            if value in ROLES:
                return True
        elif name not in ("html", "body") and name not in MAIN and (found := set(_WORD.findall(value))) and (found & (TEXT_MARKS if in_main and name in PIECES else MARKS) or not in_main and "header" in found):
            return True
        elif name in MAIN and set(_WORD.findall(value)) & {"comment", "comments", "reply", "related", "teaser"}:
            return True
    return False


def page_tokens(page: str | None) -> list[tuple[str, str | None, int]]:
    """Token stream of a page: (name, None, zone) of a block-level tag, (text, text, zone) of a text block.

    Zones: EXCLUDED, OUTSIDE (of article and main) and INSIDE. Character references
    are decoded, white space inside a block becomes one space. Unclosed and stray
    tags are tolerated; an end tag closes what is open inside its element.
    """
    page = page or ""
    out: list[tuple[str, str | None, int]] = []
    stack: list[tuple[str, int]] = []
    # Places in the stack by name: an end tag finds its element without a search.
    places: dict[str, list[int]] = {}
    zone, held, at = OUTSIDE, [], 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, text, zone))

    while at < len(page):
        m = _PART.search(page, at)
        if m is None:
            held.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, end, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] if m[2] else m[6]
        if name == "br" or name == "wbr":
            held.append(" " if name == "br" else "")
            continue
        if not end and name in RAW:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if end:
            depth = places[name][-1] if places.get(name) else None
            if name in BLOCK or depth is not None and stack[depth][1] != zone:
                flush()
            if name in BLOCK:
                out.append((f"</{name}>", None, zone))
            if depth is not None:
                zone = stack[depth][1]
                for other, _ in stack[depth:]:
                    places[other].pop()
                del stack[depth:]
            continue
        inner = EXCLUDED if zone == EXCLUDED or _excluded(name, attrs, zone == INSIDE) else INSIDE if zone == INSIDE or name in MAIN else OUTSIDE
        if name in BLOCK or inner != zone:
            flush()
            out.append((f"<{name}{'!' * (inner == EXCLUDED)}>", None, inner))
        if name not in VOID and not attrs.endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append((name, zone))
            zone = inner
    flush()
    return out


def _names(tokens: list[tuple[str, str | None, int]], depth: int) -> np.ndarray:
    """Names of the substrings of ``depth`` tokens (a power of two) from each token on, by doubling; nothing follows the last token."""
    names = np.empty(len(tokens), dtype=object)
    names[:] = [t[0] for t in tokens]
    name = pd.util.hash_array(names, categorize=False) if len(tokens) else np.empty(0, dtype=np.uint64)
    h = 1
    with np.errstate(over="ignore"):
        while h < depth:
            after = np.append(name[h:], np.zeros(min(h, len(name)), dtype=np.uint64))
            name = (name * np.uint64(0x9E3779B97F4A7C15) ^ (after >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F) + after
            h *= 2
    return name.view(np.int64)


def _page(page: str | None, depth: int) -> tuple[list[str], np.ndarray, int, bool, int]:
    """The blocks that markup doesn't exclude, the names of their suffixes, a hash of their text, whether an element marks the article, and the number of tokens."""
    tokens = page_tokens(page)
    marked = any(z == INSIDE for _, _, z in tokens)
    at = [k for k, (_, t, z) in enumerate(tokens) if t is not None and z == (INSIDE if marked else OUTSIDE)]
    blocks = [tokens[k][0] for k in at]
    text = "\n".join(blocks).encode("utf-8", "surrogatepass")
    content = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)
    return blocks, _names(tokens, depth)[np.array(at, dtype=np.int64)], content, marked, len(tokens)


def without_template(blocks: list[str], repeated: set[int]) -> tuple[list[str], int]:
    """The blocks without stretches of repeated ones (by place) that have at least LONG words, and how many those were."""
    kept, run, words = [], [], 0
    for k, block in enumerate([*blocks, None]):
        if block is not None and k in repeated:
            run.append(block)
            words += len(block.split())
            continue
        if words < LONG:
            kept += run
        run, words = [], 0
        if block is not None:
            kept.append(block)
    return kept, len(blocks) - len(kept)


def _pack(blocks: list[str]) -> bytes:
    return zlib.compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "surrogatepass"), 3)


def _unpack(packed: bytes) -> list[str]:
    return json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))


STREAMS = "page_id long, url string, uid long, host long, content long, marked boolean, tokens long, names array<long>, packed binary"


def extract_main_text(pages: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html).

    Returns page_id, url, text (blocks in page order, joined by two newlines; empty
    if none), n_chars (code points of text), n_tokens (of the page's stream) and
    n_covered (blocks that go as the host's template). Null html is an empty page;
    pages with a null or odd url share the empty host; null page_ids pass through.
    Repeated rows count as one page and each give a row. Other columns are not read;
    an empty table gives an empty table. ``depth`` is a power of two.

    Pages are parsed once, and their blocks kept in a stored table; only suffix
    names are shuffled, and the blocks only if there is too much template to send
    to all tasks.
    """
    if depth & (depth - 1) or depth < 1:
        raise ValueError("depth must be a power of two")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("uid"), F.xxhash64(host).alias("host"), "html")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                got = [_page(h, depth) for h in part["html"]]
                yield pd.DataFrame({
                    "page_id": part["page_id"].astype("Int64").array, "url": part["url"].array, "uid": part["uid"].array, "host": part["host"].array, "content": [g[2] for g in got],
                    "marked": [g[3] for g in got], "tokens": [g[4] for g in got], "names": [g[1] for g in got], "packed": [_pack(g[0]) for g in got],
                })

    streams = stored(pages.mapInPandas(parse, STREAMS), "html-streams")
    array = streams.select("host", "uid", "content", "marked", F.posexplode("names").alias("pos", "name")).withColumn("suffix", F.xxhash64("host", "name"))
    # Pages with distinct texts that have a suffix; the first key keeps a common suffix from landing in one task.
    counts = array.groupBy("suffix", "content").agg(F.first("host").alias("host")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.first("host").alias("host")).where("n > 1")
    every = streams.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("every"))
    template = counts.join(every, "host").where("2 * n > every").select("suffix", (F.col("n") >= F.greatest(F.lit(float(MANY)), F.lit(SURE) * F.col("every"))).alias("sure"))
    template = stored(template, "html-template")
    cut = stored(array.join(template, "suffix").where("sure OR NOT marked").groupBy("uid").agg(F.collect_set("pos").alias("cut")), "html-cut")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [without_template(_unpack(p), set() if c is None else set(map(int, c))) for p, c in zip(batch["packed"], batch["cut"], strict=True)]
            text = ["\n\n".join(kept) for kept, _ in got]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text], "n_tokens": batch["tokens"], "n_covered": [n for _, n in got]})

    return streams.select("page_id", "url", "uid", "tokens", "packed").join(cut, "uid", "left").select("page_id", "url", "tokens", "packed", "cut").mapInPandas(texts, "page_id long, url string, text string, n_chars long, n_tokens long, n_covered long")
