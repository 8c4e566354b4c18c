"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its element starts and its blocks of text, told apart by
the elements they stand in. Per host, elements that occur equally often on each
page (the same occurrence vector, kept as a count of pages and a sum of hashes)
form an equivalence class, split by the class they stand in. A class is valid if
it is found on enough pages, and has two elements or more, or one that comes
equally often on all its pages; valid classes nest into the host's template, and
their elements are its slots. Elements that come now
once and now thrice, each like no other, are what authors write: the template
says nothing of them. A slot is dropped if its text is mostly links, or the same
on most pages; the links of a class that repeats are judged as one, so that a
list of links stays with the text that always comes with it. A block of text is
dropped if it is itself on most pages, also inside an element that names itself
main. Names decide about the rest, but drop no element that holds most of a
page's own text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from salesledger.llm.common import freeze, small_batches

#: Pages of a host from which it gets a template of its own; the pages of
#: smaller hosts share one.
MIN_PAGES = 3
#: Part of a host's pages on which a class of template tokens must occur.
SUPPORT = 0.5
MAX_LINKS = 0.5
MAX_SAME = 0.5
# fixed values: elements by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas select xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br_ caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
STRUCTURE = BLOCK - {"p", "br_", "hr"}
FURNITURE = frozenset("nav footer aside form head menu dialog button".split())
MAIN = frozenset("article main".split())
FURNITURE_NAMES = frozenset(
    "ad ads adbox advert advertisement alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup popular promo promoted recommended related replies reply rss search share sharing sidebar social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
#: Of these, words that also say what a text is about: they name furniture only
#: as the last word of a name, or before a word for the things in a list.
TOPICS = frozenset("alert banner notice popular related recommended reply search share sharing social tags subscription".split())
THINGS = frozenset("articles bar block box buttons content icons items links list news pages panel posts products reading results section stories topics videos".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_NAMES = frozenset("article content entry main post story".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Element:
    tag: str
    key: int
    #: 1: main by name, -1: furniture by name, 0: neither, of its own.
    role: int = 0


@dataclass
class Block:
    key: int
    roles: tuple[tuple[int, int], ...]
    text: str
    links: int
    heading: bool = False


@dataclass
class Page:
    """Blocks of text in page order, and how often each element key occurs."""

    blocks: list[Block] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)
    parents: dict[int, int] = field(default_factory=dict)
    #: The elements around all content: the page, html and body.
    outer: set[int] = field(default_factory=lambda: {0})


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _is_furniture(name: str) -> bool:
    """Whether a class or id names furniture."""
    words = [w.lower() for w in SPLIT.split(name) if w]
    sure = any(w in FURNITURE_NAMES and w not in TOPICS for w in words)
    return sure or any(w in TOPICS and (not words[k + 1 :] or words[k + 1] in THINGS) for k, w in enumerate(words))


def _label(tag: str, attributes: str, inside_main: bool) -> tuple[str, int]:
    names = [(k.lower(), a or b or c or "") for k, a, b, c in NAMED.findall(attributes)] if attributes else []
    words = {w.lower() for _, v in names for w in SPLIT.split(v) if w}
    role = 0
    if tag in FURNITURE or (tag == "header" and not inside_main) or any(_is_furniture(n) for _, v in names for n in v.split()):
        role = -1
    elif tag in MAIN or words & MAIN_NAMES:
        role = 1
    if tag in ("body", "html"):
        role = 0
    return tag + "".join(f".{w}" for k, v in names if k != "role" for w in sorted(SPLIT.split(v)) if w), role


def read_page(text: str) -> Page:
    page, stack = Page(), [Element("", 0)]
    parts: list[str] = []
    links = link_depth = 0

    def flush():
        nonlocal links
        if parts:
            joined = " ".join(html.unescape("".join(parts)).split())
            if joined:
                page.blocks.append(Block(stack[-1].key, tuple((e.key, e.role) for e in stack), joined, min(links, len(joined)), stack[-1].tag in HEADING))
            parts.clear()
        links = 0

    def add(piece: str):
        nonlocal links
        parts.append(piece)
        if link_depth:
            links += len(piece)

    at = 0
    while m := TOKEN.search(text, at):
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if m[3].endswith("/") and tag in ("svg", "object"):
                continue
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>|</{re.escape(tag)}>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in ("br", "hr") or tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag == "a":
            link_depth = 0 if m[1] else 1
        if tag not in BLOCK and tag not in FURNITURE:
            continue
        flush()
        if stack[-1].tag == "p" and not m[1]:
            stack.pop()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].tag in ({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}):
            stack.pop()
        label, role = _label(tag, m[3], any(e.role == 1 for e in stack))
        key = _hash(f"{stack[-1].key}/{label}")
        page.counts[key] += 1
        page.parents[key] = stack[-1].key
        stack.append(Element(tag, key, role))
        if tag in ("html", "body"):
            page.outer.add(key)
    if at < len(text):
        add(text[at:])
    flush()
    return page


#: What a template says of a slot.
DROP, KEEP, PLAIN = -1, 1, 0


def main_blocks(page: Page, slots: dict[int, int]) -> list[str]:
    """Blocks in the main slots. Of what the template leaves, an element named
    as furniture is dropped unless it holds most of the page's own text and none
    outside names itself main; and where elements name themselves main, only
    what stands in such counts, unless an element apart from them holds most."""
    judged = [(b, slots.get(text_token(b)) != DROP, [k for k, _ in b.roles if slots.get(k) == DROP]) for b in page.blocks]
    own = sum(len(b.text) - b.links for b, varies, gone in judged if varies and not gone)

    def holding(blocks: list[Block], but: set[int]) -> set[int]:
        """Elements, other than ``but``, that hold most of the page's own text."""
        held: Counter = Counter()
        for b in blocks:
            for key in {k for k, _ in b.roles} - but:
                held[key] += len(b.text) - b.links
        return {k for k, n in held.items() if 2 * n > own}

    def named(b: Block, role: int, but: set[int] = frozenset()) -> set[int]:
        return {k for k, r in b.roles if r == role and k not in but}

    # a heading belongs to the slot that it stands in: in the main one it stays, also
    # if many pages have the same
    own_blocks = [b for b, varies, gone in judged if varies and not gone]
    inside = holding(own_blocks, page.outer)
    deepest = max(((k, d) for b in own_blocks for d, (k, _) in enumerate(b.roles) if k in inside), key=lambda x: x[1], default=(0, 0))[0]
    main_slots = {k for b in own_blocks for k, r in b.roles if k in inside and (r == 1 or k == deepest)}
    left = []
    for b, varies, gone in judged:
        head = b.heading and any(k in main_slots for k, _ in b.roles[:-1])
        if not set(gone) - {b.key} if head else varies and not gone:
            left.append(b)
    most = holding(left, {0})
    mains = [b for b in left if named(b, 1) and not named(b, -1, most)]
    spared = {k for k in most if all(k in {e for e, _ in b.roles} for b in mains)}
    kept = [b for b in left if not named(b, -1, spared)]
    mains = [b for b in kept if named(b, 1)]
    if mains and not holding(kept, {k for b in mains for k, _ in b.roles}):
        kept = mains
    return [b.text for b in kept]


def text_token(block: Block) -> int:
    """Stands for this text in this element."""
    return _hash(f"{block.key}#{block.text}")


TEXTS = "host string, token long, body long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = read_page(text)
            body = 0
            for b in page.blocks:
                body = _hash(f"{body}/{b.text}")
            rows += [(host, k, body) for k in {text_token(b) for b in page.blocks}]
        columns = zip(*rows, strict=True) if rows else ([],) * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()], strict=True)], ["host", "token", "body"])


def _repeated(pages: DataFrame, hosts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, token) of the texts that stand on ``SUPPORT`` of a host's pages.

    Copies of one page do not make its texts a template's: the pages' texts as
    a whole must differ. They are counted in 64 bits, so a long per text."""
    texts = pages.mapInArrow(_texts, TEXTS).groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.bit_or(F.expr("shiftleft(1L, cast(pmod(body, 64) as int))")).alias("bits"))
    pooled = texts.join(hosts, texts["host"] == hosts["of"]).groupBy(F.col("to").alias("host"), "token").agg(F.sum("pages").alias("pages"), F.bit_or("bits").alias("bits"))
    differing = F.bit_count("bits") >= 0.75 * 64 * (1 - F.exp(-(1 - MAX_SAME) * F.col("pages") / 64))
    often = pooled.join(sizes, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= SUPPORT * F.col("of_pages")))
    return often.where((F.bit_count("bits") >= MIN_PAGES - 1) & differing).select("host", "token")


TOKENS = "host string, page long, token long, parent long, n long, chars long, links long, role int, body long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TOKENS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for host, number, text in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = read_page(text)
            chars: Counter = Counter()
            links: Counter = Counter()
            body: dict[int, int] = {}
            roles: dict[int, int] = {}
            for b in page.blocks:
                furniture = any(r == -1 for _, r in b.roles)
                for key, _ in b.roles:
                    chars[key] += len(b.text)
                    links[key] += b.links
                    body[key] = _hash(f"{body.get(key, 0)}/{b.text}")
                    roles[key] = -1 if furniture else 0
            rows.append((host, number, 0, 0, 1, chars[0], links[0], 0, body.get(0, 0)))
            rows += [(host, number, k, page.parents[k], n, chars[k], links[k], roles.get(k, 0), body.get(k, 0)) for k, n in page.counts.items()]
        columns = zip(*rows, strict=True) if rows else ([],) * len(names)
        types = [pa.string(), *[pa.int64()] * 6, pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots): for each host with enough pages, and for '' that stands
    for all others, the slots of its template and what to do with them.

    ``pages``: host, page (a hash of the row), html. Occurrence vectors are
    compared by the number of pages and the sum over pages of a hash of page
    and count, which tasks pre-aggregate, so no task holds a host.
    """
    wide = "decimal(38,0)"
    per = pages.mapInArrow(_tokens, TOKENS).groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.count(F.lit(1)).alias("pages"), F.sum(F.xxhash64("page", "n").cast(wide)).alias("vector"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("role").alias("role"), F.approx_count_distinct("body").alias("bodies"),
        F.min("n").alias("least"), F.max("n").alias("most"),
    )
    per = freeze(per)
    hosts = freeze(per.where("token = 0").select(F.col("host").alias("of"), F.when(F.col("pages") >= MIN_PAGES, F.col("host")).otherwise("").alias("to")))
    pooled = per.join(hosts, per["host"] == hosts["of"]).groupBy(F.col("to").alias("host"), "token").agg(
        F.min("parent").alias("parent"), F.sum("pages").alias("pages"), F.sum("vector").alias("vector"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.min("role").alias("role"), F.sum("bodies").alias("bodies"), F.min("least").alias("least"), F.max("most").alias("most"),
    )
    pooled = freeze(pooled)
    sizes = pooled.where("token = 0").select("host", F.col("pages").alias("of_pages"))
    frequent = pooled.join(sizes, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= SUPPORT * F.col("of_pages")))
    # at most 1 / SUPPORT times a page's own elements are frequent, so a host's row is bounded by its pages' size
    kind = F.struct("pages", "vector").alias("class")
    entry = F.struct("token", "parent", kind, "chars", "links", "bodies", "of_pages", "pages", (F.col("least") == F.col("most")).alias("fixed"))
    nested = frequent.groupBy("host").agg(F.collect_list(entry).alias("tokens"))
    texts = _repeated(pages, hosts, sizes).groupBy("host").agg(F.collect_list("token").alias("texts"))
    both = nested.join(texts, "host", "left").select("host", "tokens", F.coalesce("texts", F.array().cast("array<long>")).alias("texts"))
    return both.mapInArrow(_nest, "host string, slots array<struct<token:long,what:int>>")


def _template(by: dict[int, dict]) -> dict[int, int]:
    """{element: class} for the valid classes of frequent elements.

    An element is of its parent's class if both occur equally often on each
    page, else of a class nested in that one, with the others there that share
    its occurrence vector. What stands in an infrequent element has no class."""
    if 0 not in by:
        return {}
    children: dict[int, list[int]] = {}
    for k, t in by.items():
        if k:
            children.setdefault(t["parent"], []).append(k)
    of, numbers, left = {0: 0}, {}, [0]
    while left:
        parent = left.pop()
        for k in children.get(parent, ()):
            if by[k]["class"] == by[parent]["class"]:
                of[k] = of[parent]
            else:
                vector = (by[k]["class"]["pages"], by[k]["class"]["vector"])
                of[k] = numbers.setdefault((of[parent], *vector), len(numbers) + 1)
            left.append(k)
    sizes = Counter(of.values())
    return {k: c for k, c in of.items() if sizes[c] > 1 or by[k]["fixed"]}


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge the slots of each host's template."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("what", pa.int32())]))
    for batch in batches:
        out = []
        for tokens, texts in zip(batch.column("tokens").to_pylist(), batch.column("texts").to_pylist(), strict=True):
            by = {t["token"]: t for t in tokens}
            valid = _template(by)
            chars, links = Counter(), Counter()
            for k, c in valid.items():
                own = k if by[k]["fixed"] else -c  # what repeats is judged as a class
                chars[own] += by[k]["chars"]
                links[own] += by[k]["links"]
            slots = []
            for k in sorted(valid):
                t = by[k]
                own = k if t["fixed"] else -valid[k]
                link_list = chars[own] > 0 and links[own] > MAX_LINKS * chars[own]
                same = t["pages"] >= MIN_PAGES and t["bodies"] < (1 - MAX_SAME) * t["pages"] and by.get(0, t)["bodies"] >= (1 - MAX_SAME) * t["of_pages"]
                slots.append({"token": k, "what": DROP if k and (link_list or same) else PLAIN})
            out.append(slots + [{"token": k, "what": DROP} for k in sorted(texts)])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, kind)], ["host", "slots"])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, any others) with ``text``, the main text
    of each page, and ``n_chars``; columns of these names are replaced.

    Blocks keep page order and are joined by two line feeds; white space inside
    a block becomes one space. A null or empty html, or a page without main
    text, gives an empty string. The host comes from the url; null urls, and
    those without a host, share one. Rows that repeat a page count each.
    """
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep if c != "html")).alias("own"), host.alias("host"), F.xxhash64("page_id", page).alias("page"), page.alias("html"))
    found = freeze(templates(rows.select("host", "page", "html")))
    pool = [r["slots"] for r in found.where("host = ''").collect()]  # one row, bounded as each host's
    common = {s["token"]: s["what"] for s in pool[0]} if pool else {}
    joined = rows.drop("page").join(found.where("host <> ''"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, slots in zip(batch.column("html").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                known = common if slots is None else {s["token"]: s["what"] for s in slots}
                texts.append("\n\n".join(main_blocks(read_page(text), known)))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(texts, pa.string())], ["own", "text"])

    schema = StructType([rows.schema["own"], StructField("text", StringType())])
    out = joined.mapInArrow(run, schema)
    return out.select(*(F.col(f"own.`{c}`") for c in keep if c != "html"), "text", F.length("text").cast("long").alias("n_chars"))
