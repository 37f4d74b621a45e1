"""Main text of web pages by site style trees (query ``op10_html_extract``)."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusweave.llm.common import Scratch, map_rows, table
from corpusweave.llm.url_cascade import host_and_path

#: Weight of the layout's entropy against the content's; on SEEN different pages or more a branch below LOW goes, one from HIGH on stays.
LAYOUT_WEIGHT, LOW, HIGH, SEEN = 0.1, 0.25, 0.75, 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open element of its own group unless one of the group's holders lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("article aside body blockquote div dl footer form header main nav ol section table tbody td th ul".split())
#: Elements and names (of classes, ids, roles) that say menu, header, footer, sidebar, notice, advert, form or comments.
CHROME_TAGS = frozenset("nav footer aside form button select label fieldset legend datalist optgroup option dialog menu search head".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo "
    "promoted related replies search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
MAIN_NAMES = frozenset("article main".split())
#: A name of several words speaks by its last one, and never of these elements.
OPEN_TAGS = frozenset("html body article main".split())
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"'<]*+(?:\"[^\"<]*+\"[^>\"'<]*+|'[^'<]*+'[^>\"'<]*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Named:
    """An element whose name says chrome; ``around`` is the next such element around it."""

    __slots__ = ("around", "branch", "plain", "main", "title", "stays")

    def __init__(self, around: Named | None, branch: int, plain: bool):
        self.around, self.branch, self.plain = around, branch, plain
        self.main, self.title, self.stays = 0, False, True


class Element:
    """An open or closed element: its branch of the style tree and what it and its surroundings say.

    ``low`` and ``chrome`` are inherited, so no element has to know all of those around it. It covers the pieces of text from
    ``start`` up to ``end``. An inline element that says nothing has no branch of its own: its text is its holder's. ``within`` an
    inline element for chrome, such as a list of choices, no block ends or begins.
    """

    __slots__ = ("tag", "branch", "holder", "chrome", "main", "named", "title", "low", "within", "start", "end")

    def __init__(self, tag, branch, holder, chrome, main, named, title, low, within, start):
        self.tag, self.branch, self.holder = tag, branch, holder or self
        self.chrome, self.main, self.named, self.title, self.low, self.within = chrome, main, named, title, low, within
        self.start, self.end = start, start


class Piece(NamedTuple):
    """Text of one holder within one block, in page order; a block may have several pieces, such as those around a button."""

    block: int
    holder: Element
    parts: list[str]

    def text(self) -> str:
        return "".join(references.unescape(p) for p in self.parts)


def parse(page: str, low: frozenset[int] = frozenset()) -> tuple[list[Piece], list[Element], list[Named]]:
    """The page's pieces of text, its elements with branches and the elements with chrome's names, each in page order.

    Elements left open end with what holds them, a stray end tag is ignored, and markup cut off at the page's
    end is dropped. A branch is named by tags and classes, so like branches of a host's pages merge. Nesting may have any depth.
    """
    root = Element("", 0, None, False, False, None, False, False, False, 0)
    pieces: list[Piece] = []
    stack, elements, names, open_tags = [root], [root], [], Counter()
    block = at = 0

    def add(text: str) -> None:
        holder = stack[-1].holder
        if pieces and pieces[-1].block == block and pieces[-1].holder is holder:
            pieces[-1].parts.append(text)
        elif text:
            pieces.append(Piece(block, holder, [text]))

    def leave(depth: int) -> None:
        for element in stack[depth:]:
            element.end = len(pieces)
            open_tags[element.tag] -= 1
        del stack[depth:]

    while found_tag := MARKUP.search(page, at):
        if found_tag.start() > at:
            add(page[at : found_tag.start()])
        at = found_tag.end()
        closing, tag, attributes = found_tag[1] or found_tag[4], found_tag[2] or found_tag[5], found_tag[3] or found_tag[6] or ""
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK and not stack[-1].within:
            block += 1
        if closing:
            if open_tags[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                leave(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            closes = CLOSES.get(tag, ("p",))
            if any(open_tags[t] > 0 for t in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in closes:
                        leave(depth)
                        break
                    if stack[depth].tag in HOLDERS:
                        break
        element = child(stack[-1], tag, attributes, low, len(pieces))
        if element.holder is element:
            elements.append(element)
            if element.named is not stack[-1].named:
                names.append(element.named)
        stack.append(element)
        open_tags[tag] += 1
    add(page[at:])
    leave(0)
    return pieces, elements, names


def child(parent: Element, tag: str, attributes: str, low: frozenset[int], start: int) -> Element:
    inline = tag not in BLOCK
    if inline and tag not in CHROME_TAGS and not NAMES.search(attributes) and not HIDDEN.search(attributes):
        return Element(tag, parent.branch, parent.holder, parent.chrome, parent.main, parent.named, parent.title, parent.low, parent.within, start)
    whole = {n for m in NAMES.finditer(attributes) for n in next(g for g in m.groups() if g is not None).lower().split()}
    cut = [re.split(r"[^a-z0-9]+", n) for n in whole]
    names = {n for parts in cut for n in parts}
    header = tag == "header" and not parent.main
    own_chrome = tag in CHROME_TAGS or header or bool(HIDDEN.search(attributes))
    main = parent.main or tag in MAIN_NAMES or "main" in names
    style = f"{tag}.{'.'.join(sorted(n for n in names if n and not n.isdigit()))}"
    branch, named = signed(f"{parent.branch} {style}"), parent.named
    plain = bool(whole & CHROME_NAMES) and tag not in ("html", "body", "main")
    if plain or tag not in OPEN_TAGS and any(parts[-1] in CHROME_NAMES for parts in cut):
        named = Named(parent.named, branch, plain)
    if inline and not own_chrome and named is parent.named:  # a name that says nothing
        return Element(tag, parent.branch, parent.holder, parent.chrome, main, parent.named, parent.title, parent.low, parent.within, start)
    within = parent.within or inline and own_chrome
    return Element(tag, branch, None, parent.chrome or own_chrome, main, named, parent.title or tag == "h1", parent.low or branch in low, within, start)


def signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(page: str | None, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset()) -> str:
    """Blocks worth keeping, one to a line; of a block, the pieces worth keeping, as they follow each other.

    A piece goes if its element is one for chrome, if the host repeats a branch it is under (``low``, of low importance), or if
    a name around it says chrome. A name is overruled where it surrounds all of the page's article or a heading of the
    first rank, and one of several words where its branch is of ``high`` importance. Where a page has an article, what stands
    outside stays if its branch is of ``high`` importance. A button, an advert or hidden words inside a paragraph leave it whole.
    """
    pieces, _, names = parse(page or "", low)
    own = [p for p in pieces if not p.holder.chrome and not p.text().isspace()]
    mains = 0
    for holder in (p.holder for p in own):
        if holder.main:
            mains += 1
        if holder.named is not None:
            holder.named.main += holder.main
            holder.named.title |= holder.title
    for name in reversed(names):  # what stands inside comes later
        if name.around is not None:
            name.around.main += name.main
            name.around.title |= name.title
    for name in names:
        wraps = mains > 0 and name.main == mains or name.title and not name.plain
        name.stays = (name.around is None or name.around.stays) and (wraps or not name.plain and name.branch in high)
    own = [p for p in own if p.holder.named is None or p.holder.named.stays]
    has_main = any(p.holder.main for p in own)
    kept: dict[int, list[str]] = {}
    for p in own:
        if not p.holder.low and (p.holder.main or not has_main or p.holder.branch in high):
            kept.setdefault(p.block, []).append(p.text())
    return "\n".join(text for parts in kept.values() if (text := " ".join("".join(parts).split())))


#: Modulus and base of hashes that are put together from those of neighbouring stretches.
PRIME, BASE = (1 << 61) - 1, 1_000_003_000_017


class Ranges:
    """Hashes of stretches of a sequence from those of its beginnings."""

    def __init__(self, values: list[int]):
        self.sums, self.powers = [0], [1]
        for v in values:
            self.sums.append((self.sums[-1] * BASE + v % PRIME + 1) % PRIME)
            self.powers.append(self.powers[-1] * BASE % PRIME)

    def joined(self, before: int, start: int, end: int) -> int:
        """The hash of ``before``'s sequence followed by the values from ``start`` up to ``end``."""
        own = self.sums[end] - self.sums[start] * self.powers[end - start]
        return (before * self.powers[end - start] + own) % PRIME


def branches(page: str | None) -> tuple[int, dict[int, tuple[int, int]]]:
    """(hash of the whole content, hashes of content and layout by branch): texts and deepest branches of its pieces, in order.

    A branch may have several elements on a page; an element's pieces are a stretch of the page's.
    """
    pieces, elements, _ = parse(page or "")
    texts = [" ".join(p.text().split()) for p in pieces]
    filled = [bool(t) for t in texts]
    before = [0]
    for full in filled:
        before.append(before[-1] + full)
    texts = [t for t in texts if t]
    content = Ranges([signed(t) for t in texts])
    layout = Ranges([p.holder.branch for p, full in zip(pieces, filled) if full])
    found: dict[int, tuple[int, int]] = {}
    for element in elements[1:]:
        start, end = before[element.start], before[element.end]
        if start < end:
            c, s = found.get(element.branch, (0, 0))
            found[element.branch] = content.joined(c, start, end), layout.joined(s, start, end)
    return content.joined(0, 0, len(texts)), found


def branch_importance(pages: DataFrame) -> DataFrame:
    """``host, branch, seen, importance`` of the style trees of ``pages`` (``host``, ``html``).

    Pages of a host with the same content count once. A branch that looks different on every page has
    importance 1, one that always is the same 0: the entropy of its contents, and with a small weight that of its
    layouts, over the most they could have. Counts are summed before they are shuffled, so a host with a
    third of all pages is no single task's.
    """

    def make(batch: pa.RecordBatch) -> dict:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole, found = branches(page.as_py())
            rows += [(host, whole, branch, kind, value) for branch, both in found.items() for kind, value in enumerate(both)]
        return dict(zip(("host", "whole", "branch", "kind", "value"), map(list, zip(*rows)) if rows else [[]] * 5))

    seen = map_rows(pages.select("host", "html"), make, "host string, whole long, branch long, kind int, value long").distinct()
    values = seen.groupBy("host", "branch", "kind", "value").agg(F.count("*").alias("n"))
    entropy = (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.log(F.sum("n"))
    kinds = values.groupBy("host", "branch", "kind").agg(F.sum("n").alias("seen"), F.when(F.sum("n") > 1, entropy).otherwise(1.0).alias("entropy"))
    weight = F.when(F.col("kind") == 0, 1 - LAYOUT_WEIGHT).otherwise(LAYOUT_WEIGHT)
    return kinds.groupBy("host", "branch").agg(F.max("seen").alias("seen"), F.sum(weight * F.col("entropy")).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (``page_id``, ``url``, ``html``).

    Null and empty pages, and pages of chrome alone, give an empty text. A URL without host makes a host of its own, the empty
    one. Repeated rows are pages of their own that count once in their host's tree.
    """
    scratch = Scratch(pages.sparkSession, "style-tree")
    host, _ = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    known = branch_importance(rows).where((F.col("seen") >= SEEN) & ((F.col("importance") < LOW) | (F.col("importance") >= HIGH)))
    low = F.collect_set(F.when(F.col("importance") < LOW, F.col("branch"))).alias("low")
    known = scratch.write(known.groupBy("host").agg(low, F.collect_set(F.when(F.col("importance") >= HIGH, F.col("branch"))).alias("high")), "known")
    both = rows.join(known, "host", "left").select("page_id", "url", "html", "low", "high")

    def make(batch: pa.RecordBatch) -> dict:
        texts = [main_text(page.as_py(), *(frozenset(b.as_py() or ()) for b in sets)) for page, *sets in zip(*batch.columns[2:])]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts}

    return map_rows(both, make, "page_id long, url string, text string")


def html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
