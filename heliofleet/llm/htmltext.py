"""Main text of web pages, with boilerplate found by suffixes sorted over each host's pages.

A page is taken apart into blocks, each with its words and what the markup says of it: article,
marked (menus, headers, footers, sidebars, notices, adverts, forms, comments) or open. An article
that pages share must stay on all of them, so what lies in the article element is protected; the
words of all other blocks are the page's token stream, all of it on a page without an article.

A repeat is a passage of at least ``RUN`` words that stands word for word on at least ``MANY`` pages
of the host and ``SHARE`` of them; pages with one id or one text (marked blocks aside) count once.
An open block goes if it lies in a repeat as a whole; else it stays as a whole. Marked blocks go.

A block shorter than ``RUN`` words lies in a repeat if some run of ``RUN`` words around it is one, so
runs are counted per (host, run) first. A longer block is a repeat if its own words are, so the
streams' suffixes that begin with such a block's first run are sorted, bucket by (host, first run),
with their common lengths. Equal suffixes travel once, with the number of their pages; a page with
several suffixes in a bucket is counted once at each length. So a host with a third of all pages is
spread like any other, and a repeat on all of them is one row.
"""

from __future__ import annotations

import html as entities
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from heliofleet.llm.tables import staged
from heliofleet.llm.words import grams, mix

RUN, MANY, SHARE = 6, 3, 0.05
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|title)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(svg)\b[^>]*(?<!/)>.*?</svg\s*>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|(id)|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
# the words of class names that mark a part as no article
_MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie "
    "cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promoted "
    "related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_TITLES = frozenset(("header", "masthead", "banner"))     # inside an article these hold its title
_OF_ARTICLES = frozenset("article content entry main page post section story title".split())
_CONTRARY = frozenset("has no not with without".split())  # a class that names a part and says that it has or lacks it
_MARKED_TAGS = frozenset("nav footer aside form menu button select dialog header".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
# open tags that another one closes when it starts
_CLOSES = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
           "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}
_SWALLOWED = frozenset("script style noscript template iframe svg textarea title".split())
ARTICLE, MARKED, OPEN = 0, 1, 2


def _marks(value: str, tag: str, is_id: bool, inside: bool) -> bool:
    """Whether a class, id or role names a part that is no article.

    An id counts by its first or last word only (``how-search-works`` names no search box). Ids of headings,
    and ids of sections with three words or more, are slugs of titles. A header of an article is its title.
    """
    for name in value.strip("\"'").lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not words or _CONTRARY & set(words) or (is_id and (tag in _HEADINGS or (tag == "section" and len(words) > 2))):
            continue
        found = ({words[0], words[-1]} if is_id else set(words)) & _MARKS
        if found and not (found <= _TITLES and (inside or _OF_ARTICLES & set(words))):
            return True
    return False


def _role(stack: list) -> int:
    """What the open elements say of a text in them, the innermost first.

    A main element is the page's article whatever is around it; an article element is one unless it stands in
    a part that is none (a comment, a teaser), where a form around it does not count.
    """
    found = OPEN
    for tag, brings in reversed(stack):
        if brings == MARKED and not (found == ARTICLE and tag == "form"):
            return MARKED
        if brings == ARTICLE:
            if tag == "main":
                return ARTICLE
            found = ARTICLE
    return found


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(role, text) of each block in page order: references decoded, white space one space, trimmed."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int | None]] = []  # open elements and the role each brings
    parts: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((_role(stack), text))

    for match in _TOKEN.finditer(page):
        raw = match.group(1) or match.group(2)
        tag = (match.group(4) or "").lower()
        if raw or tag in _SWALLOWED:  # the latter closes itself, or is never closed
            continue
        if not tag:
            token = match.group(0)
            if not token.startswith(("<!", "<?")):
                parts.append(token)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if match.group(3):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    if any(r is not None for _, r in stack[at:]):
                        flush()
                    del stack[at:]
                    break
        else:
            for closed in _CLOSES.get(tag, ()):
                if stack and stack[-1][0] == closed:
                    stack.pop()
            if tag in _VOID or match.group(0).endswith("/>"):
                continue
            brings = ARTICLE if tag in _ARTICLE_TAGS else None
            inside = any(r == ARTICLE for _, r in stack)
            if brings is None and ((tag in _MARKED_TAGS and not (tag == "header" and inside)) or tag not in ("html", "body") and any(
                    _marks(value, tag, bool(is_id), inside) for is_id, value in _ATTRIBUTE.findall(match.group(5) or ""))):
                brings = MARKED
            if brings is not None and parts:
                flush()
            stack.append((tag, brings))
            # an unclosed inline element never outlives its block
            if tag not in _INLINE:
                stack[:] = [s for s in stack if s[0] not in _INLINE]
    flush()
    return out


def host_of(url: str | None) -> str:
    match = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", url or "", re.I)
    return match.group(1).lower() if match else ""


def _stream(blocks_: list[tuple[int, str]]):
    """Words outside the article, with the block of each."""
    words, owner = [], []
    for at, (role, text) in enumerate(blocks_):
        if role != ARTICLE:
            own = text.split(" ")
            words += own
            owner += [at] * len(own)
    return words, np.array(owner, np.int64)


def _numbers(words: list[str]) -> np.ndarray:
    import pandas as pd
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def common(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(left), len(right))
    apart = np.flatnonzero(left[:n] != right[:n])
    return int(apart[0]) if len(apart) else n


def suffix_array(suffixes: list[np.ndarray]):
    """(order, common): the suffixes sorted by their tokens, and the length each shares with the one before."""
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i].astype(">u8").tobytes())
    return order, [0] + [common(suffixes[i], suffixes[j]) for i, j in zip(order, order[1:])]


def repeated_length(suffixes: list[np.ndarray], weights: list[int], many: int) -> list[int]:
    """Of each suffix, the length of its longest beginning that ``many`` pages have (0: none).

    An interval of the suffix array whose common lengths are at least d holds all suffixes that begin
    with the same d tokens; its weights add up to the pages that have them.
    """
    order, shared = suffix_array(suffixes)
    out = [0] * len(order)
    open_: list[tuple[int, int]] = []  # (length, first place) of the intervals not yet closed
    sums = np.concatenate([[0], np.cumsum([weights[i] for i in order])])
    found = []
    for at in range(len(order) + 1):
        depth = shared[at] if 0 < at < len(order) else 0
        first = at
        while open_ and open_[-1][0] > depth:
            length, first = open_.pop()
            if sums[at] - sums[first] >= many:
                found.append((length, first, at))
        if at < len(order):
            if depth and (not open_ or open_[-1][0] < depth):
                open_.append((depth, first))
            if len(suffixes[order[at]]) > depth:
                open_.append((len(suffixes[order[at]]), at))
    for length, first, last in sorted(found):  # longer ones last
        for place in range(first, last):
            out[order[place]] = max(out[order[place]], length)
    return out


def _host_key(host: str) -> np.uint64:
    return mix(_numbers([host or " "]))[0]


def _key(tokens: np.ndarray, host: np.uint64) -> np.uint64:
    """64 bits of a passage on a host."""
    return mix(np.bitwise_xor.reduce(mix(tokens + mix(np.arange(1, len(tokens) + 1, dtype=np.uint64)))).reshape(1) ^ host)[0]


def _streams(batches):
    """Each page's stream: token fingerprints, its blocks, and 64 bits of the text that is not marked."""
    for batch in batches:
        out = {n: [] for n in ("row", "page", "host", "content", "tokens", "first", "open")}
        for row, page, url, html in zip(*(batch.column(c).to_pylist() for c in ("row", "page", "url", "html"))):
            blocks_ = blocks_of(html or "")
            words, owner = _stream(blocks_)
            text = "\n".join(t for role, t in blocks_ if role != MARKED)
            if not words:
                continue
            at, first = np.unique(owner, return_index=True)
            for name, value in zip(out, (row, page, _host_key(host_of(url)).view(np.int64), _numbers([text])[0].view(np.int64) if text else row,
                                         _numbers(words).tobytes(), first, np.array([blocks_[i][0] == OPEN for i in at]))):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(out[n], pa.int64()) for n in ("row", "page", "host", "content")), pa.array(out["tokens"], pa.binary()),
             pa.array(out["first"], pa.list_(pa.int64())), pa.array(out["open"], pa.list_(pa.bool_()))], names=list(out))


def _runs(batches):
    """The distinct runs of each stream."""
    for batch in batches:
        for one in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
            rows, hosts, counted, keys = [], [], [], []
            for row, host, once, tokens in zip(*(one.column(c).to_pylist() for c in ("row", "host", "counted", "tokens"))):
                own = np.unique(grams(np.frombuffer(tokens, np.uint64), RUN) ^ np.int64(host).view(np.uint64))
                keys.append(own)
                for values, value in ((rows, row), (hosts, host), (counted, once)):
                    values.append(np.full(len(own), value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.concatenate(hosts).astype(np.int64)), pa.array(np.concatenate(counted).astype(bool)),
                 pa.array(np.concatenate(keys).view(np.int64))], names=["row", "host", "counted", "run"])


def _known(batch: pa.RecordBatch):
    """(row, host, counted, many, tokens, run of each position, whether it is repeated, blocks, repeated runs) of each page."""
    for row, host, once, many, tokens, first, open_, runs in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "counted", "many", "tokens", "first", "open", "runs"))):
        tokens, host = np.frombuffer(tokens, np.uint64), np.int64(host).view(np.uint64)
        keys = grams(tokens, RUN) ^ host
        ends = first[1:] + [len(tokens)]
        yield row, host, once, many, tokens, keys, np.isin(keys, np.array(runs, np.int64).view(np.uint64)), list(zip(first, ends, open_))


def _ask(batches):
    """Open blocks of at least ``RUN`` words all of whose runs are repeated: only these can be repeats."""
    for batch in batches:
        out = {n: [] for n in ("row", "run", "many", "key", "tokens", "n")}
        for row, host, _, many, tokens, keys, hit, blocks_ in _known(batch):
            for lo, hi, open_ in blocks_:
                if open_ and hi - lo >= RUN and hit[lo:hi - RUN + 1].all():
                    for name, value in zip(out, (row, keys[lo].view(np.int64), many, _key(tokens[lo:hi], host).view(np.int64), tokens[lo:hi].tobytes(), hi - lo)):
                        out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if n == "tokens" else pa.int64()) for n, v in out.items()], names=list(out))


def _suffixes(batches):
    """Suffixes of the counted streams that begin with an asked run, as long as anything asked of it and as their runs are repeated.

    The weights of a page's suffixes in one bucket add up to 1 at each length: what two neighbours share is taken off.
    """
    for batch in batches:
        out = {n: [] for n in ("run", "tokens", "weight")}
        asked = batch.column("asked").to_pylist()
        for (_, _, _, _, tokens, keys, hit, _), wanted in zip(_known(batch), asked):
            reach = {np.int64(a["run"]).view(np.uint64): a["reach"] for a in wanted}
            stop = np.append(np.flatnonzero(~hit), len(hit))
            buckets: dict = {}
            for at in np.flatnonzero(np.isin(keys, np.array(list(reach), np.uint64))).tolist():
                end = min(at + reach[keys[at]], int(stop[np.searchsorted(stop, at)]) + RUN - 1)
                buckets.setdefault(keys[at], []).append(tokens[at:end])
            for run, own in buckets.items():
                order, shared = suffix_array(own)
                for i, n in zip(order, shared):
                    for part, weight in ((own[i], 1), (own[i][:n], -1)):
                        if len(part):
                            out["run"].append(run.view(np.int64)), out["tokens"].append(part.tobytes()), out["weight"].append(weight)
        yield pa.RecordBatch.from_arrays([pa.array(out["run"], pa.int64()), pa.array(out["tokens"], pa.binary()), pa.array(out["weight"], pa.int64())], names=list(out))


def _rank(table: pa.Table) -> pa.Table:
    """The asked blocks of a bucket that are repeats."""
    suffixes = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    many = max(m for m in table.column("many").to_pylist() if m is not None)
    lengths = repeated_length(suffixes, table.column("weight").to_pylist(), many)
    return pa.table({"key": pa.array([k for k, n, s in zip(table.column("key").to_pylist(), lengths, suffixes) if k is not None and n >= len(s)], pa.int64())})


def _take_apart(batches):
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [zip_.compress(json.dumps(blocks_of(h or ""), ensure_ascii=False).encode("utf-8", "surrogatepass"))
                for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("page_id"), batch.column("url"), pa.array(data, pa.binary())],
            names=["row", "page_id", "url", "parts"])


def main_text(blocks_: list[tuple[int, str]], runs: np.ndarray, gone: np.ndarray, host: str) -> tuple[str, int]:
    """The text that stays, and how many words repeats covered; ``runs`` and ``gone`` are repeated runs and blocks."""
    words, owner = _stream(blocks_)
    covered = np.zeros(len(words), bool)
    tokens, key = _numbers(words), _host_key(host)
    hit = np.isin(grams(tokens, RUN) ^ key, runs)
    for j in range(RUN):
        covered[j:j + len(hit)] |= hit
    kept = []
    for at, (role, text) in enumerate(blocks_):
        if role == OPEN:
            lo, hi = np.searchsorted(owner, [at, at + 1])
            if hi - lo >= RUN:
                stays = not len(gone) or _key(tokens[lo:hi], key) not in gone
            else:
                stays = not hit[max(0, hi - RUN):lo + 1].any()
        if role == ARTICLE or (role == OPEN and stays):
            kept.append(text)
    return "\n".join(kept), int(covered.sum())


def _assemble(batches):
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, counts = [], []
        for url, parts, runs, gone in zip(*(batch.column(c).to_pylist() for c in ("url", "parts", "runs", "gone"))):
            runs, gone = (np.array(x or [], np.int64).view(np.uint64) for x in (runs, gone))
            text, n = main_text(json.loads(unzip.decompress(parts)), runs, gone, host_of(url))
            texts.append(text.encode("utf-8", "replace").decode())
            counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_repeated"])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated`` for every page.

    Blocks are joined by one line break. ``n_repeated`` counts the words, marked ones included, that
    repeats of the host cover. Null or empty pages give an empty text; pages without a host share one;
    rows that repeat a page id or a text are one page when pages are counted, and each keep their row.
    Rows without an id are pages of their own. Markup cut off at the end of a page is read as far as it goes.
    A very long page is read to its end. Further columns are not read, whatever their names. An empty table
    gives no rows.
    """
    content = F.xxhash64(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    rows = pages.select(
        content.alias("row"), F.coalesce(F.col(page_id).cast("long"), content).alias("page"), F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    streams = staged(rows.select("row", "page", "url", "html").mapInArrow(
        _streams, "row long, page long, host long, content long, tokens binary, first array<long>, open array<boolean>").dropDuplicates(["row"]), "page-streams")
    # one row of each page is counted
    counted = streams.groupBy("host", "page").agg(F.min_by(F.struct("row", "content"), "row").alias("r")).groupBy("host", "r.content").agg(F.min("r.row").alias("row"))
    counted = staged(counted.select("row", "host"), "pages-counted")
    least = counted.groupBy("host").agg(F.greatest(F.lit(MANY), F.ceil(F.count("*") * SHARE)).cast("long").alias("many"))
    marked = streams.join(counted.select("row", F.lit(True).alias("counted")), "row", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
    runs = staged(marked.select("row", "host", "counted", "tokens").mapInArrow(_runs, "row long, host long, counted boolean, run long"), "page-runs")
    repeated = staged(runs.where("counted").groupBy("run").agg(F.count("*").alias("n"), F.any_value("host").alias("host")).where(F.col("n") >= MANY)
                      .join(least, "host").where("n >= many").select("run", "many"), "repeated-runs")
    covered = staged(runs.select("row", "run").join(repeated, "run").groupBy("row").agg(
        F.collect_set("run").alias("runs"), F.max("many").alias("many")), "page-repeats")  # at most a page's own runs
    known = marked.join(covered, "row")
    asked = staged(known.mapInArrow(_ask, "row long, run long, many long, key long, tokens binary, n long"), "asked-blocks")
    reach = asked.groupBy("run").agg(F.max("n").alias("reach"))
    wanted = (covered.select("row", F.explode("runs").alias("run")).join(reach, "run")
              .groupBy("row").agg(F.collect_list(F.struct("run", "reach")).alias("asked")))  # at most a page's own runs
    suffixes = known.where("counted").join(wanted, "row").mapInArrow(_suffixes, "run long, tokens binary, weight long")
    ranked = (suffixes.select("run", "tokens", "weight", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("many"))
              .unionByName(asked.select("run", "tokens", F.lit(0).cast("long").alias("weight"), "key", "many"))
              .groupBy("run", "tokens").agg(F.sum("weight").alias("weight"), F.max("key").alias("key"), F.max("many").alias("many")))
    gone = ranked.groupBy("run").applyInArrow(_rank, "key long").distinct()
    gone = asked.select("row", "key").join(gone, "key").groupBy("row").agg(F.collect_set("key").alias("gone"))  # at most a page's own blocks
    parts = rows.select("row", "page_id", "url", "html").mapInArrow(_take_apart, "row long, page_id long, url string, parts binary")
    found = staged(covered.select("row", "runs").join(gone, "row", "left"), "page-cuts")
    return parts.join(found, "row", "left").select("page_id", "url", "parts", "runs", "gone").mapInArrow(
        _assemble, "page_id long, url string, text string, n_chars long, n_repeated long")
