"""HTML extraction (4): structure first, then a suffix array per host.

A page is parsed into blocks of text. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments go by their elements and by their class, id or role. What is left is judged by
its host: the token streams of the host's pages are concatenated, a suffix array finds the substrings of
``LONG`` tokens that distinct pages repeat, the words that these cover are removed, and unique runs stay. A repeat
may run on from a menu into the first words of the text after it, so a block that is covered by less than
half stays whole. What structure drops is evidence of repeats.

An article that a page marks (``article``, ``main`` or that role) is evidence too: if it holds most of what
is left, a substring that reaches into it must be on at least ``MANY`` pages and a share of ``MOST`` of the
host's, so that passages which articles share stay and notices in all of them go. Everywhere else, and on
pages whose mark holds less, it takes ``FEW`` pages and a share of ``SOME``. Pages of a host with equal words
left count as one, which stands for all of them.

A host is cut into shards of bounded pages and bytes, each with an array of its own; one row per repeated or
single prefix leaves a shard, and prefixes meet across shards by their hash. So no host is in one task.

Defined cases: a null or empty html has an empty text; a null url belongs to the host ""; pages with equal
ids are pages of their own; unclosed and unknown elements are tolerated; other columns pass through.
"""

from __future__ import annotations

import hashlib
import html as _html
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize
from tessera.llm.words import blocks, ngram_hashes

#: A shard holds about so many pages, or so many bytes of packed text, if these are reached first.
LONG, SHARD, SHARD_BYTES = 8, 2000, 4 << 20
FEW, SOME = 2, 0.05
MANY, MOST = 4, 0.5
#: A shard may leave out prefixes that are on under a quarter of the pages it can expect to hold them, if it
#: expects so many: the deal is at random, and less than one in ten million needed ones falls so far short.
EXPECTED = 40
#: Fixed element names.
_DROPPED = frozenset("head nav footer aside form script style noscript template iframe object button select textarea svg canvas menu dialog audio video map".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole class or role tokens, and ids, of what is not main text; "_" counts as "-".
_HINTS = frozenset((
    "ad ads advert adverts advertisement advertisements adbox adslot ad-slot ad-box ad-banner ad-container ad-unit ad-wrapper advertising banner banners cookie cookies cookie-banner cookie-notice cookie-bar cookie-consent cookie-policy consent gdpr gdpr-banner "
    "notice notices alert alerts promo promos promotion promotions sponsor sponsors sponsored sidebar sidebars sidebar-left sidebar-right left-sidebar right-sidebar side-bar nav navs navbar navigation main-nav main-navigation site-nav site-navigation nav-bar nav-menu nav-links post-navigation "
    "menu menus main-menu menubar breadcrumb breadcrumbs footer footers site-footer page-footer footer-nav footer-links comment comments comment-list commentlist comment-form comments-area comment-respond disqus disqus-thread reply replies share sharing share-buttons share-links social social-links social-share social-media "
    "related related-posts related-articles related-content related-links recommended recommended-posts recommendations newsletter newsletters newsletter-signup subscribe signup sign-up login popup popups modal modals widget widgets widget-area masthead complementary contentinfo search search-form searchbox search-box"
).split())
#: Those that an article element of its own may be: not the story.
_BESIDES = frozenset("ad ads advert advertisement comment comments reply replies related related-posts recommended promo promos sponsor sponsored newsletter widget sidebar".split())
_HEADERS = frozenset("header headers site-header page-header top-header topbar top-bar site-title".split())
#: Elements whose ids are often made from their headings and say what the text is about.
_NAMED = frozenset("h1 h2 h3 h4 h5 h6 section p li dt dd td th tr".split())
#: Elements that are often left open: the start tags that end them, and the open elements beyond which these
#: don't reach.
_OPEN_ENDED = {
    **dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6"), (frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), frozenset("table caption td th".split()))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset("td th tr tbody tfoot".split()), frozenset(("table",)))),
    "tr": (frozenset("tr tbody tfoot".split()), frozenset(("table",))),
    "option": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", regex.S)
_ATTRIBUTE = regex.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ZSTD = pa.Codec("zstd", compression_level=9)
_SPACE = regex.compile(r"\s+")


def _attributes(source: str) -> dict[str, str]:
    """Lower-case names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "").lower())
    return out


def _unseen(said: dict[str, str]) -> bool:
    style = (d.partition(":") for d in said.get("style", "").split(";"))
    return "hidden" in said or said.get("aria-hidden", "").strip() == "true" or any(k.strip() == "display" and v.split("!")[0].strip() == "none" for k, _, v in style)


def _kind(name: str, attributes: str, inside: bool) -> str:
    """ "drop", "main" or "" for an element's content."""
    if name in _DROPPED or (name == "header" and not inside):
        return "drop"
    if attributes and not attributes.isspace() and name not in ("html", "body"):  # pages hide their body till they are loaded
        said = _attributes(attributes)
        if _unseen(said):
            return "drop"
        classes, roles = ({*said.get(k, "").replace("_", "-").split()} for k in ("class", "role"))
        if name == "article" and (classes | roles) & (_HINTS if inside else _BESIDES):
            return "drop"
        if name not in ("article", "main"):
            if "main" in roles:
                return "main"
            names = classes | roles
            if name not in _NAMED and "section" not in classes:
                names.add(said.get("id", "").replace("_", "-").strip())
            if names & _HINTS or (not inside and names & _HEADERS):
                return "drop"
    return "main" if name in ("article", "main") else ""


def read_page(source: str) -> tuple[list[tuple[str, str]], bool]:
    """The page's blocks in order, each with its zone ("main", "" or "drop"), and whether there is a marked
    article."""
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open containers and what they are
    held: list[str] = []
    drops = mains = 0
    marked = False
    at = 0

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", _html.unescape("".join(held))).strip()
            held.clear()
            if text:
                found.append(("drop" if drops else "main" if mains else "", text))

    def close(k: int) -> None:
        """End the open container at ``k`` and all in it."""
        nonlocal drops, mains
        for _, kind in stack[k:]:
            drops -= kind == "drop"
            mains -= kind == "main"
        del stack[k:]

    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:  # comment or declaration
            continue
        if m[1]:
            if name in _INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in _INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        if name in _RAW:  # skipped to its end, in any zone
            end = regex.compile(rf"</{regex.escape(name)}\s*>", regex.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        beyond: set[str] = set()
        for k in range(len(stack) - 1, -1, -1):
            ends, limits = _OPEN_ENDED.get(stack[k][0], ((), ()))
            if name in ends and not beyond & limits:
                close(k)
                break
            beyond.add(stack[k][0])
        if name in _VOID or m[3].endswith("/"):
            continue
        if name == "body" and stack and stack[-1][0] == "head":  # never closed
            close(len(stack) - 1)
        kind = _kind(name, m[3], mains > 0)
        if name in _OPEN_ENDED and not kind:
            continue  # blocks, but not containers
        stack.append((name, kind))
        drops += kind == "drop"
        mains += kind == "main"
        marked |= kind == "main" and not drops
    flush()
    return found, marked


def split_page(source: str) -> tuple[list[str], list[str], list[str], bool]:
    """Blocks of the marked article, other blocks that structure keeps, blocks that it drops, and whether there
    is a marked article."""
    found, marked = read_page(source)
    article, loose, dropped = ([text for z, text in found if z == zone] for zone in ("main", "", "drop"))
    return article, loose, dropped, marked


def kept_blocks(source: str) -> tuple[list[str], list[int], str]:
    """The blocks that structure keeps, the words of each (negative outside an article that holds most of
    them), and the text that structure drops."""
    found, _ = read_page(source)
    kept = [(text, text.count(" ") + 1, zone) for zone, text in found if zone != "drop"]
    trusted = 2 * sum(n for _, n, zone in kept if zone) > sum(n for _, n, _ in kept)
    return [text for text, _, _ in kept], [n if zone and trusted else -n for _, n, zone in kept], " ".join(text for zone, text in found if zone == "drop")


def _pack(kept: str, dropped: str) -> bytes:
    """Both texts in one compressed value, as they are stored and shuffled; a form feed (no block has one) parts them."""
    data = f"{kept}\f{dropped}".encode()
    return len(data).to_bytes(4, "little") + _ZSTD.compress(data, asbytes=True) if len(data) > 1 else b""


def _unpack(data: bytes) -> str:
    return _ZSTD.decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True).decode() if data else ""


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *passed, source = batch.columns
        packed, words, keys = [], [], []
        for page in source:
            own, spans, dropped = kept_blocks(page.as_py() or "")
            packed.append(_pack("\n".join(own), dropped))
            words.append(spans)
            keys.append(hashlib.blake2b(" ".join(own).encode(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([*passed, pa.array(packed, pa.binary()), pa.array(words, pa.list_(pa.int32())), pa.array(keys, pa.binary())], names=[*batch.schema.names[:-1], "__packed", "__words", "__key"])


def suffix_order(tokens: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``long`` tokens (a power of two), by prefix doubling, and each
    suffix's rank; suffixes equal that far share a rank. The text's end sorts first."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while step < long:
        after = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), np.int64)))
        _, rank = np.unique(rank * (rank.max(initial=0) + 2) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def _shard_prefixes(pages: pd.DataFrame) -> pd.DataFrame:
    """One row for each distinct prefix of ``LONG`` tokens in a shard that may be on enough of the host's pages:
    its hash, how many pages of the shard hold it, and its places (page, word) in what structure keeps."""
    host, n_host, shards = (pages[c].iloc[0] for c in ("__host", "__pages", "__shards"))
    needs = max(FEW, int(np.ceil(SOME * n_host))), max(MANY, int(np.ceil(MOST * n_host)))
    least = [need if shards == 1 else need / shards / 4 if need / shards >= EXPECTED else 1 for need in needs]
    words, row, word, inside, kept = [], [], [], [], []
    spans = pages["__words"].tolist()
    for b in blocks(pa.array([_unpack(x) for x in pages["__packed"]], pa.string())):
        words.append(b.word_hashes())
        own = b.row_of_word()
        row.append(b.first + own)
        word.append(np.arange(len(own)) - b.word_at[own])
        for r, n in enumerate(np.diff(b.word_at).tolist()):
            own = np.asarray(spans[b.first + r], np.int64)
            of = np.zeros((2, n), bool)
            known = np.repeat(own > 0, np.abs(own))
            of[0, : len(known)] = known
            of[1, : len(known)] = True
            inside.append(of[0])
            kept.append(of[1])
    empty = pd.DataFrame(columns=["__host", "prefix", "n", "few", "many", "pages", "at", "inside"], dtype=object)
    if not words:
        return empty
    stream, row, word, inside, kept = (np.concatenate(x) for x in (words, row, word, inside, kept))
    n = len(stream) - LONG + 1
    if n <= 0:
        return empty
    order, rank = suffix_order(stream, LONG)
    whole = np.zeros(len(stream), bool)
    whole[:n] = row[:n] == row[LONG - 1 :]
    order = order[whole[order]]
    if not len(order):
        return empty
    prefix = ngram_hashes(stream, LONG, 0xD6E8FEB86659FD93).view(np.int64)
    first = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    heads = np.flatnonzero(first)
    held = np.add.reduceat(first | np.concatenate(([True], row[order][1:] != row[order][:-1])), heads, dtype=np.int64)  # places are in the order of pages
    sums = np.concatenate(([0], np.cumsum(inside)))
    reaches = sums[LONG:] > sums[:-LONG]  # into a trusted article
    ends, keys = np.append(heads[1:], len(order)), pages["__page"].to_numpy()
    out = []
    for k in np.flatnonzero(held >= least[0]).tolist():
        at = order[heads[k] : ends[k]]
        at = at[kept[at] & (~reaches[at] | (held[k] >= least[1]))]
        out.append((host, prefix[order[heads[k]]], held[k], *needs, keys[row[at]], word[at].astype(np.int32), reaches[at]))
    return pd.DataFrame(out, columns=empty.columns) if out else empty


def _unique_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that repeated substrings cover."""
    for batch in batches:
        *passed, packed, starts = batch.columns
        texts = []
        for data, at in zip(packed.to_pylist(), starts.to_pylist()):
            own = _unpack(data).partition("\f")[0]
            if not at:
                texts.append(own)
                continue
            covered = {k for s in at for k in range(s, s + LONG)}
            place, kept = 0, []
            for block in own.split("\n"):
                words = block.split(" ")
                left = [w for k, w in enumerate(words, place) if k not in covered]
                place += len(words)
                if 2 * len(left) > len(words):
                    left = words
                if left:
                    kept.append(" ".join(left))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([*passed, pa.array(texts, pa.string())], names=[*batch.schema.names[:-2], "text"])


def extract_main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The columns of ``pages`` but ``html``, and the main text as ``text`` and its code points as ``n_chars``."""
    names = {c: f"__c{k}" for k, c in enumerate(pages.columns) if c not in (html, "text", "n_chars")}
    passed = list(names.values())
    host = F.coalesce(F.regexp_extract(F.lower(F.col(f"`{url}`").cast("string")), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))
    own = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    chosen = pages.select(*own, F.monotonically_increasing_id().alias("__page"), host.alias("__host"), F.col(f"`{html}`").cast("string").alias("__html"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema[:-1])
    split = materialize(chosen.mapInArrow(_split_batches, fields + "__packed binary, __words array<int>, __key binary"), "pages")
    covered = materialize(_covered(split), "covered")
    judged = split.select(*passed, "__page", "__packed").join(covered, "__page", "left").select(*passed, "__packed", "__starts")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in judged.schema[:-2])
    out = judged.mapInArrow(_unique_batches, fields + "text string")
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "text", F.length("text").cast("bigint").alias("n_chars"))


def _covered(split: DataFrame) -> DataFrame:
    """(__page, __starts): the words at which repeated substrings start."""
    loose = F.exists("__words", lambda n: n < 0)
    some = split.where(F.size("__words") > 0).select("__page", "__host", "__key", loose.alias("__open"), F.length("__packed").alias("__bytes"))
    # copies may differ in their marks: one whose article is trusted stands for the others
    contents = materialize(some.groupBy("__host", "__key").agg(F.min_by("__page", F.struct("__open", "__page")).alias("__first"), F.count("*").alias("__rows"), F.bool_or("__open").alias("__open"), F.max("__bytes").alias("__bytes")), "contents")
    several = contents.where("__rows > 1").select("__host", "__key", "__first")
    copies = materialize(some.join(several, ["__host", "__key"]).where("__page <> __first").select("__page", "__first"), "copies")
    hosts = contents.groupBy("__host").agg(F.count("*").alias("__pages"), F.bool_or("__open").alias("__open"), F.sum("__bytes").alias("__bytes"))
    hosts = materialize(hosts.select("__host", "__pages", "__open", F.ceil(F.greatest(F.col("__pages") / SHARD, F.col("__bytes") / SHARD_BYTES)).alias("__shards")), "hosts")
    # one page repeats nothing, and fewer than MANY nothing in articles
    hosts = hosts.where((F.col("__open") & (F.col("__pages") > 1)) | (F.col("__pages") >= MANY)).drop("__open")
    streams = split.select("__host", "__page", "__words", "__packed").where(F.length("__packed") > 0)
    streams = streams.join(copies.select("__page"), "__page", "left_anti")
    dealt = streams.join(hosts, "__host").withColumn("__shard", F.pmod(F.xxhash64("__page"), F.col("__shards")))
    # partitioned by host alone, as the join may leave it, all shards of a host would lie in one task
    prefixes = dealt.repartition("__host", "__shard").groupBy("__host", "__shard").applyInPandas(_shard_prefixes, "__host string, prefix bigint, n bigint, few bigint, many bigint, pages array<bigint>, at array<int>, inside array<boolean>")
    prefixes = materialize(prefixes, "prefixes")
    repeated = prefixes.groupBy("__host", "prefix").agg(F.sum("n").alias("on"), F.max("few").alias("few"), F.max("many").alias("many")).where("on >= few")
    places = prefixes.select("__host", "prefix", "pages", "at", "inside").join(repeated, ["__host", "prefix"]).select("on", "many", F.explode(F.arrays_zip("pages", "at", "inside")).alias("x"))
    places = places.where(~F.col("x.inside") | (F.col("on") >= F.col("many")))
    firsts = materialize(places.groupBy(F.col("x.pages").alias("__page")).agg(F.collect_list("x.at").alias("__starts")), "firsts")
    return firsts.unionByName(copies.join(firsts.withColumnRenamed("__page", "__first"), "__first").select("__page", "__starts"))
