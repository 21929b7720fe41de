"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is read as a sequence of blocks, each with the path of open elements and its text. Its
tokens are the paths and the (path, text) pairs. Over the pages of a host, every token has an
occurrence vector (its count in each page); tokens with equal vectors form an equivalence class.
Pages of a host with the same content count once, so copies of an article don't make it a template.
The vectors are never gathered: an order-free sum of hashes of (content, count) stands for each, so
a host with a third of all pages costs one partial aggregate a token and task.

A class is valid if enough contents hold it. The class of tokens that every one holds is the outer
template; a class of fewer ones nests in it where a path and its text share one vector, that is
where the path always brings the same text. Texts in valid classes belong to the template, what
remains are its slots. A page's main text is in the slots, without the elements that carry menus,
notices, adverts, forms and the like, and inside the article if the page marks one.

Pages are read in one pass, whose steps don't depend on how deep elements nest or how broken tags are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import prepare, read_table, sifted, tidied, written

#: A template token is in so many contents at least, and in this share of its host's contents; nested ones in NESTED of them.
PAGES, SHARE, NESTED = 5, 0.9, 0.1
#: So many blocks in a row that are links only are a menu, outside of a marked article.
MENU = 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg object canvas textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio".split()
)
#: Elements that never hold main text.
OUTSIDE = frozenset("head nav footer aside form button select option menu dialog fieldset label input audio video".split())
#: Elements that end an open <p>, and what ends a sibling of its own kind.
ENDS_P = BLOCK - {"br"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body div section article main".split())
HINT = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|comments?|disqus|replies|respond|sidebar|side-?bar|widget\w*|"
    r"menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|popup|modal|overlay|pagination|pager|tags|toolbar|skip\w*)(?:$|[-_ \d])",
    re.I,
)
MAIN = re.compile(r"(?:^|[-_ ])(?:article|post|entry|story|main|content|body)(?:[-_ ]?(?:body|content|text|main))?(?:$|[-_ \d])", re.I)
#: A tag up to its end: quotes count behind an equals sign. Possessive, so a page is read once. CARELESS: to the next >.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
CARELESS = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
UNFINISHED = re.compile(r"<[A-Za-z/!?]")
ATTR = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++)))?+""")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


def _hash(*parts: str) -> int:
    return (xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "replace")) ^ (1 << 63)) - (1 << 63)


class Open:
    """The open elements, with the places of each name, so that no step searches the stack."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []

    def last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else 0

    def push(self, name: str, path: int, outside: bool, inside: int) -> None:
        k = len(self.stack)
        self.places.setdefault(name, []).append(k)
        if name in SCOPES:
            self.scopes.append(k)
        if name in BLOCK:
            self.blocks.append(k)
        self.stack.append((name, path, outside, inside))

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()
            if name in BLOCK:
                self.blocks.pop()

    def above(self, some: list[int], spot: int) -> bool:
        return bool(some) and some[-1] > spot


def _kind(name: str, attrs: str, inside: int) -> tuple[str, bool, int]:
    """Key of an element in paths, whether it never holds main text, and 2 for an article, 1 for a container named like one."""
    main, key, outside, named = name in ("article", "main"), name, name in OUTSIDE, ""
    if attrs and not attrs.isspace():
        found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
        named = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        main = main or role in ("main", "article")
        if named:
            key += "." + " ".join(named.split())
        if name not in ("html", "body"):
            own = bool(named) and MAIN.search(named) and not re.search("comment|side|nav|menu|foot", named, re.I)
            outside = outside or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(named and not main and not own and HINT.search(named))
            inside = max(inside, 1 if own and name in ("div", "section", "td") else 0)
    if name in ("header", "noscript"):
        outside = outside or inside < 2
    return key, outside, 2 if main else inside


def blocks(page: str) -> list[tuple[int, str, bool, int, int]]:
    """(hash of the path, text, outside, 2 inside the article, characters in links) of each block, in page order."""
    out: list[tuple[int, str, bool, int, int]] = []
    parts: list[str] = []
    opened = Open()
    at = linked = 0
    last_end, careless, endless = page.rfind(">"), False, set()

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        parts.clear()
        if text:
            _, path, outside, inside = opened.stack[-1]
            out.append((path, text, outside, inside, min(linked, len(text))))
        linked = 0

    def close(spot: int):
        flush()
        opened.pop(spot)

    def push(piece: str):
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if opened.places.get("a"):
                linked += len(piece)

    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last_end:
            # Behind the last > a tag or comment never ends; it is no text.
            cut = UNFINISHED.search(page, at)
            push(page[at : cut.start()] if cut else page[at:])
            break
        push(page[at:lt])
        kind = page[lt + 1]
        first = page[lt + 2 : lt + 3] if kind == "/" else kind
        if kind in "!?" or (kind == "/" and not ("a" <= first.lower() <= "z")):
            end = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            stop = page.find(end, lt + 2)
            at = stop + len(end) if stop >= 0 else len(page)
            continue
        m = None
        if "a" <= first.lower() <= "z":
            m = (CARELESS if careless else TAG).match(page, lt)
            if m is None and not careless:
                careless, m = True, CARELESS.match(page, lt)
        if m is None:
            push("<")
            at = lt + 1
            continue
        at = m.end()
        name = m.group(2).lower()
        if m.group(1):
            spot = opened.last(name)
            if name in BLOCK:
                close(spot) if spot else flush()
            elif spot and not opened.above(opened.blocks, spot):
                opened.pop(spot)
            continue
        attrs = m.group(3)
        if name in RAW and not attrs.rstrip().endswith("/"):
            stop = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if stop is not None:
                stop = page.find(">", stop.end())
                at = stop + 1 if stop >= 0 else len(page)
            elif name in ("script", "style"):
                at = len(page)
            endless |= {name} if stop is None else set()
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if name in BLOCK and name in ENDS_P and (spot := opened.last("p")) and not opened.above(opened.scopes, spot):
            close(spot)
        if name in SIBLINGS:
            spots = [k for x in SIBLINGS[name] if (k := opened.last(x)) and not opened.above(opened.scopes, k)]
            if spots:
                close(min(spots))
        _, path, outside, inside = opened.stack[-1]
        key, own, inside = _kind(name, attrs, inside)
        opened.push(name, _hash(str(path), key), outside or own, inside)
    flush()
    return out


def token(path: int, text: str) -> int:
    return _hash(str(path), text)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_key, host, html) to page_key, host, hash of the content, and paths, tokens and counts of the blocks that may hold main text.

    The content is what the article holds, or all blocks if none is marked. Token 0 of a path stands for the path itself.
    """
    longs = pa.list_(pa.int64())
    for batch in batches:
        contents, paths, tokens, counts = [], [], [], []
        for text in batch.column(2).to_pylist():
            found = [b for b in blocks(text or "") if not b[2]]
            main = [b for b in found if b[3] == 2] or found
            seen: dict[tuple[int, int], int] = {}
            for path, words, _, _, _ in found:
                for key in ((path, 0), (path, token(path, words))):
                    seen[key] = seen.get(key, 0) + 1
            contents.append(_hash(*(b[1] for b in main)))
            paths.append([k[0] for k in seen])
            tokens.append([k[1] for k in seen])
            counts.append(list(seen.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(contents, pa.int64()), pa.array(paths, longs), pa.array(tokens, longs), pa.array(counts, longs)],
            ["page_key", "host", "content", "paths", "tokens", "counts"],
        )


def template_tokens(parsed: DataFrame) -> DataFrame:
    """(host, token): the (path, text) tokens of each host's valid equivalence classes, from the rows of _tokens."""
    own = parsed.groupBy("host", "content").agg(F.min(F.struct("page_key", "paths", "tokens", "counts")).alias("x"))
    rows = own.select("host", "content", F.explode(F.arrays_zip("x.paths", "x.tokens", "x.counts")).alias("x"))
    part = F.shiftright(F.xxhash64("content", "x.counts"), 16)
    vectors = written(
        rows.groupBy("host", F.col("x.paths").alias("path"), F.col("x.tokens").alias("token")).agg(F.count("*").alias("pages"), F.sum(part.cast("decimal(38,0)")).alias("vector")).filter(F.col("pages") >= PAGES)
    )
    whole = own.groupBy("host").agg(F.count("*").alias("all")).filter(F.col("all") >= PAGES)
    places = vectors.filter("token = 0").select("host", "path", F.col("vector").alias("of_path"))
    texts = vectors.filter("token <> 0").join(whole, "host").join(places, ["host", "path"])
    return texts.filter(
        (F.col("pages") >= SHARE * F.col("all")) | ((F.col("vector") == F.col("of_path")) & (F.col("pages") >= NESTED * F.col("all")))
    ).select("host", "token").distinct()


def main_text(page: str, template: frozenset) -> str:
    """The slots that hold the article: inside a marked one, else inside a container named like one, else all but menus."""
    kept = [b for b in blocks(page) if not b[2] and not (template and token(b[0], b[1]) in template)]
    for level in (2, 1):
        if any(b[3] >= level for b in kept):
            kept = [b for b in kept if b[3] >= level]
            break
    if not kept or kept[0][3] == 2:
        return "\n".join(b[1] for b in kept)
    out, k = [], 0
    while k < len(kept):
        stop = k
        while stop < len(kept) and 10 * kept[stop][4] >= 9 * len(kept[stop][1]):
            stop += 1
        if stop - k < MENU:
            stop = max(stop, k + 1)
            out += [b[1] for b in kept[k:stop]]
        k = stop
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, tokens) to the main text."""
    for batch in batches:
        texts = [main_text(page or "", frozenset(tokens or ())) for page, tokens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_chars) of each page.

    Null html is an empty page with an empty text; pages with a null url share one nameless host.
    Hosts of fewer than PAGES contents have no template. Text outside of any element counts like
    any other. Repeated pages repeat; an empty table gives an empty result; other columns are not
    read. Pages that hold template tokens are shuffled with those; the others are not.
    """
    prepare(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host")).withColumn("page_key", F.xxhash64("page_id", "host"))
    gone = tokens_to_remove(rows)
    may, rest = sifted(rows, "page_key", gone.select("page_key"))
    schema = "page_id long, url string, text string, n_chars long"
    some = may.join(gone, ["page_key", "host"], "left").select("page_id", "url", "html", "tokens")
    return rest.select("page_id", "url", "html", F.lit(None).cast("array<bigint>").alias("tokens")).union(some).mapInArrow(_extract, schema)


@tidied
def tokens_to_remove(rows: DataFrame) -> DataFrame:
    """(page_key, host, html) to (page_key, host, tokens): the template tokens that pages hold. A written table."""
    parsed = written(
        rows.select("page_key", "host", "html").mapInArrow(_tokens, "page_key long, host string, content long, paths array<bigint>, tokens array<bigint>, counts array<bigint>")
    )
    valid = written(template_tokens(parsed))
    held = parsed.select("page_key", "host", F.explode("tokens").alias("token")).filter("token <> 0").join(valid, ["host", "token"])
    return held.groupBy("page_key", "host").agg(F.collect_set("token").alias("tokens"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
