"""Op 2: main text of pages by wrapper induction.

A page is read in one pass, without recursion, into blocks of text that hang on slots: the chain of
block elements above, like siblings merged, which are the pairs that simple tree matching of two pages aligns.
Slots are described over all pages of a host (text under them, share of links, sentences, how often a text
recurs) and the description decides: the host's container is the innermost slot that holds nearly all its
text, places whose text hardly varies are template, places of links are menus. Names in markup are one
more feature: what they call menu, advert, comments and the like is out, and where they name an article
inside the container, only that counts.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.plans.session import stash

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template svg math iframe object".split())
BLOCK = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = set("form button select option input label menu dialog head".split()) | RAW
NOISY = set("nav footer aside".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role attributes by which markup names what is not article text.
NOISE = set(
    "ad ads adbox advert adverts advertisement advertisements banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside "
    "complementary notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies "
    "share sharing social related recommended footer header masthead topbar toolbar contentinfo search pagination pager copyright legal disclaimer widget form".split()
)
#: Those that the name of an article's part may hold as well, as in "article-header".
EXCUSED = set("header banner side form legal alert copyright related social promotion masthead widget label".split())
MAIN = set("article articlebody main content maincontent post postcontent postbody entry entrycontent story storybody".split())

#: Share of a host's text that its container holds, and what it holds besides; the length from which on a
#: block counts more than half. A text is constant on a place if it is on the share
#: ``SAME`` of the distinct pages that have the place, and on so many more than one (``BEYOND`` times
#: them). A place is a menu if links hold the share ``LINKED`` of its text and few blocks are sentences.
HOLDS, BESIDES, HALF, SAME, BEYOND, LINKED, SENTENCES = 0.8, 50, 60, 0.9, 0.7, 0.8, 0.3

_name = re.compile(r"[a-zA-Z][^\s/>]*")
_value = re.compile(r"""=\s*(["'])""")
_attr = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_split = re.compile(r"[^a-z0-9]+")
_sentence = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")
_ends = {k: set(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
_holds = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_FAMILY = set(_ends) | set().union(*_holds.values())
_raw_end = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


def _key(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _bytes(x: str | int) -> bytes:
    return x.to_bytes(8, "little", signed=True) if isinstance(x, int) else x.encode("utf-8", "surrogatepass")


ROOT = _key(b"root")


def weight(n: int) -> float:
    """What a block of ``n`` characters counts: a line of boilerplate little, a paragraph nearly its length."""
    return n * n / (n + HALF)


class Names:
    """Hashes of slots and what names say, kept for the slots that a task meets again."""

    def __init__(self, named: bool = True, most: int = 50_000):
        self.named, self.most, self.slots, self.marks = named, most, {}, {}

    def slot(self, parent: int, name: str) -> int:
        got = self.slots.get((parent, name))
        if got is None:
            if len(self.slots) >= self.most:
                self.slots.clear()
            got = _key(_bytes(parent), _bytes(name))
            if len(name) < 200:
                self.slots[parent, name] = got
        return got

    def of(self, tag: str, attributes: str) -> tuple[str, bool, bool]:
        """(name for the slot, does it name noise, does it name the article)."""
        if not attributes:
            return tag, self.named and tag in NOISY, self.named and tag in ("article", "main")
        got = self.marks.get((tag, attributes))
        if got is None:
            got = self._read(tag, attributes)
            if len(self.marks) >= self.most:
                self.marks.clear()
            if len(attributes) < 200:
                self.marks[tag, attributes] = got
        return got

    def _read(self, tag: str, attributes: str) -> tuple[str, bool, bool]:
        mark, noise, main = tag, self.named and tag in NOISY, tag in ("article", "main")
        for name, value in _attr.findall(attributes):
            value = value.strip("\"'").lower()
            mark += f".{value}" if name.lower() != "id" else ""
            if tag not in ("html", "body", "article", "main"):
                joined = {_split.sub("", v) for v in value.split()}
                words = {w.rstrip("0123456789") for w in _split.split(value)} | joined
                bad = words & NOISE
                noise = noise or self.named and bool(bad - EXCUSED if words & MAIN else bad)
                main = main or bool(joined & MAIN)
        return mark, noise, self.named and main and not noise


@dataclass(slots=True)
class Block:
    slot: int
    text: str
    links: int  # characters inside links, before white space is tidied
    size: int
    inside: bool  # of a named article
    noisy: bool  # named as what no article has
    heading: bool
    top: bool  # an h1


@dataclass(slots=True)
class Page:
    """Blocks in page order, the slot above each slot, and per slot that is not named noise (depth,
    weight of the text below it that is not links, elements, elements with block elements in them)."""

    blocks: list = field(default_factory=list)
    above: dict = field(default_factory=dict)
    holders: dict = field(default_factory=dict)

    def content(self) -> list[Block]:
        """Blocks of the named article, or, without one, all; in both cases without named noise."""
        named = any(b.inside and not b.noisy for b in self.blocks)
        return [b for b in self.blocks if not b.noisy and (b.inside or not named)]

    def under(self, slot: int) -> set[int]:
        """Slots of the page at or below ``slot``."""
        known = {slot: True, ROOT: slot == ROOT}
        for s in {b.slot for b in self.blocks}:
            chain = []
            while s not in known:
                chain.append(s)
                s = self.above[s]
            known.update(dict.fromkeys(chain, known[s]))
        return {s for s, yes in known.items() if yes}


class Reader:
    """One pass over a page; every character is looked at a bounded number of times.

    Unclosed and misnested elements end where they must. A quoted value of a tag ends at its closing
    quote; once a tag does not end that way, tags of the rest of the page end at their first ``>``.
    """

    def __init__(self, source: str, names: Names):
        self.source, self.names, self.page = source, names, Page()
        self.stack = [("#", ROOT, False, 0, True)]  # tag, slot, inside, 1 if noisy and 2 if unseen, is it a block
        self.holding = [[ROOT, 0, False]]  # slot, characters, has block elements
        self.open, self.family, self.block_at = Counter(), [], []  # open tags; stack places of those of ``_FAMILY`` and of blocks
        self.buffer, self.linked, self.links, self.loose, self.spent = [], 0, 0, False, set()

    def read(self) -> Page:
        source, at, n = self.source, 0, len(self.source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                break
            if lt > at:
                self._text(source[at:lt])
            at = self._markup(lt)
        while len(self.stack) > 1:
            self._pop()
        self._flush()
        self._hold(self.holding[0])
        return self.page

    def _text(self, text: str) -> None:
        if self.stack[-1][3] < 2:
            self.buffer.append(text)
            if self.linked:
                self.links += len(text)

    def _flush(self) -> None:
        if not self.buffer:
            return
        raw = "".join(self.buffer)
        text = " ".join(html.unescape(raw).split())
        if text:
            tag, slot, inside, noisy, _ = self.stack[self.block_at[-1] if self.block_at else 0]
            self.page.blocks.append(Block(slot, text, self.links, len(raw), inside, noisy > 0, tag in HEADINGS, tag == "h1"))
            if not noisy:
                self.holding[-1][1] += weight(len(text)) * (len(raw) - self.links) / len(raw)
        self.buffer, self.links = [], 0

    def _hold(self, entry: list) -> None:
        slot, size, kids = entry
        depth, held, elements, with_kids = self.page.holders.get(slot, (len(self.holding) - 1, 0, 0, 0))
        self.page.holders[slot] = (depth, held + size, elements + 1, with_kids + kids)

    def _pop(self) -> None:
        tag, _, _, noisy, block = self.stack[-1]
        if block:
            self._flush()
            self.block_at.pop()
            if not noisy:
                self._hold(self.holding[-1])
                size = self.holding.pop()[1]
                self.holding[-1][1] += size
        self.stack.pop()
        self.open[tag] -= 1
        if tag == "a":
            self.linked -= 1
        if self.family and self.family[-1] == len(self.stack):
            self.family.pop()

    def _cut(self, height: int) -> None:
        while len(self.stack) > height:
            self._pop()

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``; -1 for none."""
        source = self.source
        first = end = source.find(">", at)
        while end >= 0 and not self.loose:
            m = _value.search(source, at, end)
            if not m or m[1] in self.spent:
                return end
            close = source.find(m[1], m.end())
            if close < 0:
                self.spent.add(m[1])
                return end
            at = close + 1
            if close > end:
                end = source.find(">", at)
        if end < 0 <= first:
            self.loose = True
        return first if end < 0 else end

    def _markup(self, lt: int) -> int:
        source, n = self.source, len(self.source)
        two = source[lt + 1 : lt + 2]
        if two in ("!", "?"):
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                return end + 3 if end >= 0 else n
            end = source.find(">", lt)
            return end + 1 if end >= 0 else n
        closing = two == "/"
        m = _name.match(source, lt + 1 + closing)
        if not m:
            self._text("<")
            return lt + 1
        end = self._tag_end(m.end())
        if end < 0:  # no tag ends any more
            self._text(source[lt:])
            return n
        tag = m[0].lower()
        if closing:
            if self.open[tag]:
                while self.stack[-1][0] != tag:
                    self._pop()
                self._pop()
        else:
            self._open(tag, source[m.end() : end])
            if tag in RAW:
                found = _raw_end[tag].search(source, end + 1)
                gt = source.find(">", found.end() - 1) if found else -1
                return gt + 1 if gt >= 0 else n
        return end + 1

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and self.open["p"]:
            while self.stack[-1][0] != "p":
                self._pop()
            self._pop()
        if tag in _ends:
            for k in reversed(self.family):
                if self.stack[k][0] in _holds[tag]:
                    break
                if self.stack[k][0] in _ends[tag]:
                    self._cut(k)
                    break
        if tag == "br":
            self._text(" ")
            return
        name, noise, main = self.names.of(tag, attributes if "=" in attributes else "")
        _, slot, inside, noisy, _ = self.stack[-1]
        block = tag in BLOCK or noise or main or tag in UNSEEN
        if block:
            self._flush()
            noisy = 2 if tag in UNSEEN else max(noisy, noise or (self.names.named and tag == "header" and not inside))
            inside = inside or main
        if tag in VOID or tag in RAW or attributes.endswith("/"):
            return
        if block:
            above, slot = slot, self.names.slot(slot, name)
            self.page.above.setdefault(slot, above)
            if not noisy:
                self.holding[-1][2] = True
                self.holding.append([slot, 0, False])
            self.block_at.append(len(self.stack))
        if tag in _FAMILY:
            self.family.append(len(self.stack))
        self.stack.append((tag, slot, inside, noisy, block))
        self.open[tag] += 1
        if tag == "a":
            self.linked += 1


def parse(text: str | None, names: Names | None = None) -> Page:
    """The blocks and slots of a page; a null text is an empty page."""
    return Reader(text or "", names or Names()).read()


@dataclass(frozen=True)
class Template:
    """What a host's pages have in common: the container (None: none), slots of menus, and keys of
    constant texts."""

    container: int | None = None
    menus: frozenset = frozenset()
    constants: frozenset = frozenset()


def place(slot: int, text: str) -> int:
    return _key(_bytes(slot), _bytes(text))


def identity(page: Page) -> int:
    """Key of a page's content: pages that share it count once."""
    return _key(*(_bytes(_key(_bytes(b.text))) for b in page.content()))


def describe(page: Page) -> tuple[list[dict], list[dict]]:
    """(places, holders) of a page: each distinct text of a slot, the slot's sums on its first."""
    slots: dict[int, list] = {}
    for b in page.blocks:
        s = slots.setdefault(b.slot, [0, 0, 0, 0, b.heading, {}])
        s[0] += 1
        s[1] += b.size
        s[2] += b.links
        s[3] += bool(_sentence.search(b.text[-8:]))
        s[5][place(b.slot, b.text)] = None
    places = []
    for slot, (blocks, size, links, sentences, heading, texts) in slots.items():
        for k, at in enumerate(texts):
            first = not k
            places.append({"slot": slot, "place": at, "first": int(first), "blocks": blocks * first, "size": size * first, "links": links * first, "sentences": sentences * first, "heading": heading})
    holders = [{"slot": s, "depth": d, "held": float(h), "elements": e, "kids": k} for s, (d, h, e, k) in page.holders.items() if k or s == ROOT]
    return places, holders


def container_of(holders: Iterable[dict], pages: dict[int, int]) -> int | None:
    """The innermost slot that holds nearly all text, once a page, and has blocks in it."""
    holders = list(holders)
    total = next((h["held"] for h in holders if h["slot"] == ROOT), 0)
    fits = [(h["depth"], h["slot"]) for h in holders if h["held"] - BESIDES >= HOLDS * total and h["elements"] <= 1.2 * pages[h["slot"]] and 2 * h["kids"] >= pages[h["slot"]]]
    return max(fits)[1] if fits else None


def induce(pages: list[Page]) -> Template:
    """The template of the pages of one host, in one piece; ``extract`` finds the same with Spark's sums."""
    distinct = {identity(p): p for p in pages}
    held: dict[int, dict] = {}
    on: Counter = Counter()
    slots: dict[int, Counter] = {}
    times: dict[int, Counter] = {}
    for p in distinct.values():
        places, holders = describe(p)
        for h in holders:
            if h["slot"] in held:
                for c in ("held", "elements", "kids"):
                    held[h["slot"]][c] += h[c]
                held[h["slot"]]["depth"] = min(held[h["slot"]]["depth"], h["depth"])
            else:
                held[h["slot"]] = dict(h)
            on[h["slot"]] += 1
        for x in places:
            slots.setdefault(x["slot"], Counter()).update({c: x[c] for c in ("first", "blocks", "size", "links", "sentences", "heading")})
            times.setdefault(x["slot"], Counter())[x["place"]] += 1
    menus = {s for s, c in slots.items() if c["first"] > 1 and not c["heading"] and c["links"] >= LINKED * c["size"] and c["sentences"] <= SENTENCES * c["blocks"]}
    constants = {x for s, t in times.items() for x, n in t.items() if n >= SAME * slots[s]["first"] and n - 1 >= BEYOND * slots[s]["first"]}
    return Template(container_of(held.values(), on), frozenset(menus), frozenset(constants))


def kept_blocks(page: Page, template: Template | None = None) -> tuple[list[Block], bool]:
    """Blocks that are content, and whether the template left any out.

    Content lies in the container, but for an h1 before it where there is none inside. A page without
    the host's container is judged by its own. Of what is left, named noise goes, and where names
    mark an article, only that counts.
    """
    template = template or induce([page])
    container = template.container
    if container is None or (container != ROOT and container not in page.above):
        container = container_of(describe(page)[1], Counter(page.holders.keys())) if page.blocks else None
    blocks = page.blocks
    if container not in (None, ROOT):
        within = page.under(container)
        inside = [b for b in blocks if b.slot in within]
        if not any(b.top and not b.noisy for b in inside):
            first = next((k for k, b in enumerate(blocks) if b.slot in within), 0)
            inside = [b for b in blocks[:first] if b.top and not b.noisy] + inside
        blocks = inside if any(not b.noisy for b in inside) else blocks
    blocks = [b for b in blocks if b.slot not in template.menus and place(b.slot, b.text) not in template.constants]
    decided = len(blocks) < len(page.blocks)
    named = any(b.inside and not b.noisy for b in blocks)
    return [b for b in blocks if not b.noisy and (b.inside or not named)], decided


def main_text(page: Page, template: Template | None = None) -> str:
    """Blocks of the page's content, joined by one space."""
    return " ".join(b.text for b in kept_blocks(page, template)[0])


#: Parts into which a host's pages are dealt where its template is joined to them.
SALTS = 32


def templates(rows: DataFrame, named: bool = True, batch: int = 48) -> DataFrame:
    """(host, container, menus, constants) of each host of ``rows`` (host long, html).

    Pages of equal content count once. Descriptions are summed by slot and text, then by slot, so
    neither html nor a host's pages meet in one task; what a host keeps is a number for each place
    of its template.
    """
    slot = pa.struct([(c, pa.int64()) for c in ("slot", "place", "first", "blocks", "size", "links", "sentences")] + [("heading", pa.bool_())])
    holder = pa.struct([("slot", pa.int64()), ("depth", pa.int64()), ("held", pa.float64()), ("elements", pa.int64()), ("kids", pa.int64())])
    found = pa.schema([("host", pa.int64()), ("same", pa.int64()), ("places", pa.list_(slot)), ("holders", pa.list_(holder))])

    def evidence(got):
        names = Names(named)
        for b in got:
            for at in range(0, b.num_rows, batch):
                part, out = b.slice(at, batch), []
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    page = parse(source, names)
                    places, holders = describe(page)
                    out.append({"host": host, "same": identity(page), "places": places, "holders": holders})
                yield pa.RecordBatch.from_pylist(out, found)

    shape = "host long, same long, places array<struct<slot: long, place: long, first: long, blocks: long, size: long, links: long, sentences: long, heading: boolean>>, holders array<struct<slot: long, depth: long, held: double, elements: long, kids: long>>"
    seen = stash(rows.select("host", "html").mapInArrow(evidence, shape).groupBy("host", "same").agg(F.max(F.struct("places", "holders")).alias("x")).select("host", "x.*"), "page_slots")
    held = seen.select("host", F.inline("holders")).groupBy("host", "slot").agg(F.min("depth").alias("depth"), F.sum("held").alias("held"), F.sum("elements").alias("elements"), F.sum("kids").alias("kids"), F.count("*").alias("n"))
    held = held.where((F.col("elements") <= 1.2 * F.col("n")) & (2 * F.col("kids") >= F.col("n")) | (F.col("slot") == ROOT))
    total = F.max(F.when(F.col("slot") == ROOT, F.col("held")))
    totals = held.groupBy("host").agg(total.alias("total"))
    fits = held.join(totals, "host").where((F.col("held") - BESIDES >= HOLDS * F.col("total")) & (2 * F.col("kids") >= F.col("n")) & (F.col("elements") <= 1.2 * F.col("n")))
    containers = fits.groupBy("host").agg(F.max(F.struct("depth", "slot"))["slot"].alias("container"))
    sums = [F.sum(c).alias(c) for c in ("first", "blocks", "size", "links", "sentences")]
    places = seen.select("host", F.inline("places"))
    slots = places.groupBy("host", "slot").agg(F.max("heading").alias("heading"), *sums).where("first > 1")
    menu = ~F.col("heading") & (F.col("links") >= LINKED * F.col("size")) & (F.col("sentences") <= SENTENCES * F.col("blocks"))
    menus = slots.where(menu).select("host", F.col("slot").alias("menu"), F.lit(None).cast("long").alias("constant"))
    # every text of a slot that qualifies, as a slot may have many; none does that one page alone has
    texts = places.groupBy("host", "slot", "place").agg(F.count("*").alias("times")).where("times > 1")
    constant = (F.col("times") >= SAME * F.col("first")) & (F.col("times") - 1 >= BEYOND * F.col("first"))
    constants = texts.join(slots.select("host", "slot", "first"), ["host", "slot"]).where(constant).select("host", F.lit(None).cast("long").alias("menu"), F.col("place").alias("constant"))
    slots = menus.union(constants)
    dropped = slots.groupBy("host").agg(F.collect_list("menu").alias("menus"), F.collect_list("constant").alias("constants"))
    return stash(containers.join(dropped, "host", "full").select("host", "container", "menus", "constants"), "templates")


def extract(pages: DataFrame, batch: int = 48, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", named: bool = True) -> DataFrame:
    """(id, url, text, n_chars, by_template) of every page.

    A null html is an empty page and gives an empty text; pages without a host (null or odd url) are a
    host of their kind. Pages of a host with equal html give equal texts, and repeated rows and null
    ids stay. Pages of any depth and size are read whole, in one pass. ``by_template`` tells whether the host's template
    left out any text; without ``named``, names of any kind mean nothing, but for elements that never show text.
    Python handles ``batch`` pages at a time. Other columns are not read; an empty table gives an
    empty one.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))))
    found = templates(rows, named, batch).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def texts(got):
        names = Names(named)
        known: dict = {}
        for b in got:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                c = {n: part.column(n).to_pylist() for n in ("html", "host", "container")}
                out, by = [], []
                for k, source in enumerate(c["html"]):
                    if c["host"][k] not in known:
                        if len(known) >= 1000:
                            known.clear()
                        known[c["host"][k]] = Template(c["container"][k], *(frozenset(part.column(n)[k].as_py() or ()) for n in ("menus", "constants")))
                    kept, decided = kept_blocks(parse(source, names), known[c["host"][k]])
                    out.append(" ".join(x.text for x in kept))
                    by.append(decided)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(by, pa.bool_())], ["page_id", "url", "text", "n_chars", "by_template"])

    out = rows.join(found, ["host", "salt"], "left").select("page_id", "url", "html", "host", "container", "menus", "constants")
    return out.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long, by_template boolean").withColumnRenamed("page_id", id_col)
