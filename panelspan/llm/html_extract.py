"""HTML main-text extraction with a suffix array per host.

A tokenizer turns each page into text blocks with what is known of their place: inside
an article, inside something that markup names as furniture (menus, headers, footers,
sidebars, notices, adverts, forms, comments), or neither. The blocks of a host's pages
are token streams, sorted as suffix arrays to the depth REPEAT tokens; a token is covered
if a run of REPEAT tokens through it occurs on enough distinct pages of the host.

A page with an article keeps the article's blocks that markup doesn't name as furniture.
In a page without one, covered blocks go and the rest are the main text. Inside an
article coverage decides only where markup leaves doubt: blocks whose text is mostly
links. Repetition alone removes nothing from an article, because articles quote.

A host's distinct pages are dealt over shards, each a suffix array that gives every run's
number of pages there. Those numbers add up over the host's shards, run by run, and the
threshold is held against the sum, so how many shards there are changes no result. Only
hosts that have blocks in doubt are sorted, and only the runs of such blocks are added up.

Defined results: a null or empty html gives an empty text; a null url is the host '';
unclosed tags end with what contains them, and a tag or quote that never closes takes
the rest of the page; the time is linear in a page, however long or broken; rows that
repeat are each extracted, and count as one page for repetition, as all pages with equal
blocks do; columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm.common import cut, ship
from panelspan.llm.url_filter import host_of

REPEAT = 6
MIN_PAGES, PAGE_SHARE = 3, 0.01
#: Distinct pages and bytes of text that one suffix array takes, about.
SHARD_PAGES, SHARD_BYTES = 1000, 16 << 20
#: Share of a block's tokens that must be covered for it to count as repeated.
COVERED = 0.8

# fixed values: HTML element names by role
SILENT = frozenset("script style noscript template head title textarea select option button svg math iframe object canvas audio video datalist".split())
FURNITURE = frozenset("nav footer aside form header dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(["article", "main"])
# a chosen list: words in class, id or role that name furniture
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies disqus dialog "
    "copyright disclaimer feedback footer gdpr links login masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination popup promo promos promoted promotion "
    "recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
MAIN_NAMES = frozenset("article articlebody article-body article-content content entry entry-content main main-content post post-body post-content story story-body".split())
#: Names that mean furniture outside an article, and its headline inside.
HEADERS = frozenset(["header"])

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r">|=[ \t\n\f\r]*([\"'])")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[\s_]+")
_SPACE = re.compile(r"\s+")


def _marks(attributes: str, article: bool) -> tuple[bool, bool]:
    """(furniture, main) as class, id, role and the like say."""
    furniture = main = False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            furniture = True
        elif name in ("class", "id", "role", "itemprop"):
            words = _SPLIT.split(value)
            main |= name == "role" and value in ("main", "article") or any(w in MAIN_NAMES for w in words)
            names = {p for w in words for p in (w, *w.split("-"))}
            furniture |= bool(names & NAMES or not article and names & HEADERS)
    return furniture, main


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of a page's tags and, without a name, of its comments and the like.

    Quotes count where a value begins, as browsers have it, and what never closes reaches
    to the page's end, so nothing is looked at twice: the time is linear in the page. After
    a tag that holds raw text the consumer sends where that ends.
    """
    at, end = 0, len(page)
    while (at := page.find("<", at)) >= 0:
        begin = at
        if page.startswith("<!--", at):
            at = page.find("-->", at + 4)
            at = end if at < 0 else at + 3
            yield begin, at, False, "", ""
        elif page.startswith("<![CDATA[", at):
            at = page.find("]]>", at)
            at = end if at < 0 else at + 3
            yield begin, at, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            at = page.find(">", at)
            at = end if at < 0 else at + 1
            yield begin, at, False, "", ""
        elif m := _NAME.match(page, at + 1):
            at = m.end()
            while stop := _TAG_END.search(page, at):
                at = stop.end()
                if not stop[1]:
                    break
                at = page.find(stop[1], at) + 1 or end
            else:
                at = end
            sent = yield begin, at, bool(m[1]), m[2].lower(), page[m.end() : at - 1]
            if sent is not None:
                at = sent
                yield at, at, False, "", ""
        else:
            at += 1


def blocks(page: str) -> tuple[list[str], list[int]]:
    """(texts, places) of a page's blocks: place 2 in an article, 1 elsewhere, 0 furniture; plus 4 if mostly links.

    Furniture blocks are kept with their place, since they feed the repetition count.
    """
    texts: list[str] = []
    places: list[int] = []
    held: list[str] = []
    linked = links = 0
    # name, silent, furniture, article, where the nearest block element is
    stack: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, 0)]
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                _, _, furniture, article, _ = stack[-1]
                texts.append(text)
                places.append((0 if furniture else 2 if article else 1) + (4 if linked * 2 > len(text) else 0))
            held.clear()
        linked = 0

    def pop(k: int) -> None:
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][1]:
            raw = entities.unescape(raw) if "&" in raw else raw
            held.append(raw)
            linked += len(raw) if links else 0

    at = 0
    found = tags(page)
    for begin, end, closing, name, attributes in found:
        say(page[at:begin])
        at = end
        if not name:
            continue
        if closing:
            if name in BLOCKS or name == "br":
                flush()
            if name == "a":
                links = max(0, links - 1)
            if opened[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            continue
        if name in ("p", "li") and stack[stack[-1][4]][0] == name:
            # these end an open one of their kind, if that is the nearest container
            flush()
            pop(stack[-1][4])
        if name in BLOCKS:
            flush()
        elif name == "br":
            held.append(" ")
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in ("script", "style", "textarea", "noscript", "template") and not stack[-1][1]:
            # raw text: nothing in it is a tag but its own end
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            found.send(at)
            held.append(" ")
            continue
        if name == "a":
            links += 1
        _, silent, furniture, article, block = stack[-1]
        marked, main = _marks(attributes, article) if attributes and ("=" in attributes or "hidden" in attributes) else (False, False)
        inner = name == "header" and article  # an article's own header holds its headline
        stack.append((name, silent or name in SILENT, furniture or marked or name in FURNITURE and not inner, article or (main and not marked) or name in ARTICLE, len(stack) if name in BLOCKS else block))
        opened[name] += 1
    say(page[at:])
    flush()
    return texts, places


def suffix_ranks(tokens: np.ndarray, depth: int = REPEAT) -> np.ndarray:
    """Rank of every suffix by its first depth tokens, by prefix doubling; the suffix array is their argsort."""
    _, rank = np.unique(tokens, return_inverse=True)
    done = 1
    while done < depth:
        step = min(done, depth - done)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 1) + ahead, return_inverse=True)
        done += step
    return rank


def token_stream(pages: list[list[str]], depth: int = REPEAT) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, tokens, page, block, starts): token t is words[t - 1], 0 an end mark; starts are the places where a run of depth tokens lies in one block.

    Blocks shorter than depth are taken as one run with end marks, so they repeat as wholes.
    """
    number: dict[str, int] = {}
    tokens: list[int] = []
    page_of, block_of, ends = [], [], []
    for p, texts in enumerate(pages):
        for text in texts:
            found = [number.setdefault(w, len(number) + 1) for w in text.split(" ")]
            found += [0] * (depth - len(found))
            tokens += found
            page_of += [p] * len(found)
            block_of += [len(ends)] * len(found)
            ends.append(len(tokens))
    page, block = np.array(page_of, np.int64), np.array(block_of, np.int64)
    starts = np.flatnonzero(np.arange(len(page)) + depth <= np.array(ends, np.int64)[block])
    return list(number), np.array(tokens, np.int64), page, block, starts


def run_pages(tokens: np.ndarray, page: np.ndarray, starts: np.ndarray, depth: int = REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, run, pages): the starts as the suffix array has them, the run of each, and on how many pages each run is."""
    rank = suffix_ranks(tokens, depth)
    order = np.lexsort((page, rank))
    inside = np.zeros(len(tokens), bool)
    inside[starts] = True
    order = order[inside[order]]
    r, p = rank[order], page[order]
    new_run = np.concatenate([[True], r[1:] != r[:-1]])
    new_page = new_run | np.concatenate([[True], p[1:] != p[:-1]])
    run = np.cumsum(new_run) - 1
    return order, run, np.bincount(run, new_page).astype(np.int64)


def block_shares(block: np.ndarray, hits: np.ndarray, depth: int = REPEAT) -> np.ndarray:
    """For each block the share of its tokens inside runs that begin at hits."""
    cover = np.zeros(len(block) + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + depth, -1)
    return np.bincount(block, np.cumsum(cover[:-1]) > 0) / np.bincount(block)


def covered_share(pages: list[list[str]], least: int, depth: int = REPEAT) -> list[np.ndarray]:
    """For each page's blocks, the share of tokens inside runs of depth tokens found on at least `least` distinct pages."""
    _, tokens, page, block, starts = token_stream(pages, depth)
    if not len(tokens):
        return [np.zeros(0) for _ in pages]
    order, run, n = run_pages(tokens, page, starts, depth)
    share = block_shares(block, order[n[run] >= least], depth)
    bounds = np.cumsum([0, *map(len, pages)])
    return [share[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


#: Odd factors of a run's places, for two sums modulo 2 ** 64.
_FACTORS = np.array([[pow(k, i + 1, 1 << 64) for i in range(REPEAT)] for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)], np.uint64)


def run_keys(words: list[str], tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits for each run of REPEAT tokens, the same on any machine: (2, starts) of int64."""
    digests = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words)
    lanes = np.concatenate([np.zeros((1, 2), np.uint64), np.frombuffer(digests, "<u8").reshape(-1, 2)])
    out = np.zeros((2, len(starts)), np.uint64)
    for i in range(REPEAT):
        out += lanes[tokens[starts + i]].T * _FACTORS[:, i : i + 1]
    return out.view(np.int64)


def main_text(texts: list[str], places: list[int], share: np.ndarray) -> str:
    has_article = any(p & 3 == 2 for p in places)
    kept = []
    for text, place, s in zip(texts, places, share, strict=True):
        where, mostly_links = place & 3, place >= 4
        if where == 0 or has_article and where == 1:
            continue
        if s >= COVERED and (not has_article or mostly_links):
            continue
        kept.append(text)
    return "\n\n".join(kept)


def in_doubt(places: list[int]) -> list[bool]:
    """Which blocks coverage decides: all that main_text may keep where no article is marked, else an article's that are mostly links."""
    has_article = any(p & 3 == 2 for p in places)
    return [p & 3 == 2 and p >= 4 if has_article else p & 3 == 1 for p in places]


_PARSED = "url string, host string, page binary, texts array<string>, places array<int>, bytes long, doubt boolean"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each page; page tells those with other blocks apart."""
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            batch = whole.slice(i, 500)
            parsed = [blocks(h or "") for h in batch.column("html").to_pylist()]
            texts, places = [t for t, _ in parsed], [p for _, p in parsed]
            joined = ["\n".join(t).encode("utf-8", "surrogatepass") for t in texts]
            keys = [hashlib.blake2b(j, digest_size=16).digest() for j in joined]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(keys, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())),
                 pa.array([len(j) for j in joined], pa.int64()), pa.array([any(in_doubt(p)) for p in places], pa.bool_())],
                names=["page_id", "url", "host", "page", "texts", "places", "bytes", "doubt"],
            )


def _keys(texts: list[str], asked: list[bool]) -> np.ndarray:
    words, tokens, _, block, starts = token_stream([texts])
    return run_keys(words, tokens, starts[np.array(asked, bool)[block[starts]]])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, k1, k2): the distinct runs of a page's blocks in doubt."""
    for batch in batches:
        for host, page, texts, places in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "texts", "places")), strict=True):
            k = np.unique(_keys(texts, in_doubt(places)), axis=1)
            n = k.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([page] * n, pa.binary()), pa.array(k[0]), pa.array(k[1])], names=["host", "page", "k1", "k2"])


def _count_group(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(rows)
    words, tokens, page, _, starts = token_stream(table.column("texts").to_pylist())
    if not len(tokens):
        k, n = np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    else:
        order, run, n = run_pages(tokens, page, starts)
        k = run_keys(words, tokens, order[np.flatnonzero(np.diff(run, prepend=-1))])
    return pa.RecordBatch.from_arrays([pa.array([table.column("host")[0].as_py()] * len(n), pa.string()), pa.array(k[0]), pa.array(k[1]), pa.array(n)], names=["host", "k1", "k2", "pages"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, k1, k2, pages) of each run, for groups of consecutive rows of one (host, shard)."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch.column("host").to_pylist(), batch.column("shard").to_pylist(), strict=True))
        i = 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if held and keys[i] != key:
                yield _count_group(held)
                held = []
            key = keys[i]
            held.append(batch.slice(i, j - i))
            i = j
    if held:
        yield _count_group(held)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main texts of pages, with the runs (k1, k2) that are on enough pages of their host."""
    for batch in batches:
        out = []
        for texts, places, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("texts", "places", "k1", "k2")), strict=True):
            share = np.zeros(len(texts))
            if k1:
                words, tokens, _, block, starts = token_stream([texts])
                often = set(zip(k1, k2, strict=True))
                hit = [k in often for k in zip(*run_keys(words, tokens, starts).tolist(), strict=True)]
                share = block_shares(block, starts[np.array(hit, bool)])
            out.append(main_text(texts, places, share))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    kind = dict(base.dtypes)["page_id"]
    # stored: pages are parsed once, and most are read again only to be put together
    parsed = cut(base.mapInArrow(_parse, f"page_id {kind}, {_PARSED}"), "page-blocks")
    # one row for each of a host's distinct pages, by what is known of it without its texts
    distinct = parsed.groupBy("host", "page").agg(F.max("bytes").alias("bytes"), F.max("doubt").alias("doubt"))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("bytes").alias("n_bytes"), F.max("doubt").alias("doubt")).filter("doubt")
    # stored, so that the planner knows its size
    hosts = cut(hosts.select("host", F.ceil(F.greatest(F.col("n_pages") / shard_pages, F.col("n_bytes") / SHARD_BYTES, F.lit(1))).cast("int").alias("n_shards"), F.greatest(F.lit(MIN_PAGES), F.ceil(F.lit(PAGE_SHARE) * F.col("n_pages"))).alias("least")), "page-hosts")
    asked = parsed.filter("doubt").select("host", "page", "texts", "places").mapInArrow(_asked, "host string, page binary, k1 long, k2 long").distinct()
    dealt = parsed.join(hosts, "host").select("host", "page", "texts", F.pmod(F.xxhash64("page"), F.col("n_shards")).cast("int").alias("shard"))
    # equal pages meet in a shard, where the first stands for them
    dealt = dealt.repartition("host", "shard").dropDuplicates(["host", "shard", "page"]).sortWithinPartitions("host", "shard")
    counts = dealt.select("host", "shard", "texts").mapInArrow(_count, "host string, k1 long, k2 long, pages long")
    counts = counts.join(asked.select("host", "k1", "k2").distinct(), ["host", "k1", "k2"], "left_semi").groupBy("host", "k1", "k2").agg(F.sum("pages").alias("pages"))
    often = counts.join(hosts, "host").filter(F.col("pages") >= F.col("least")).select("host", "k1", "k2")
    found = asked.join(often, ["host", "k1", "k2"]).groupBy("host", "page").agg(F.collect_list("k1").alias("k1"), F.collect_list("k2").alias("k2"))
    none = F.array().cast("array<bigint>")
    clear = parsed.filter("NOT doubt").select("page_id", "url", "texts", "places", none.alias("k1"), none.alias("k2"))
    doubtful = parsed.filter("doubt").join(found, ["host", "page"], "left").select("page_id", "url", "texts", "places", "k1", "k2")
    return clear.unionByName(doubtful).mapInArrow(_assemble, f"page_id {kind}, url string, text string, n_chars long")
