"""Main text of web pages by wrappers that are inferred per host.

A page becomes a stream of block tags and text tokens. The wrapper of a host is a union-free regular expression: tags,
text slots, optional groups and repeated groups. Each page's own stream is folded first (equal neighbours become a repeated
group); then wrappers are aligned pairwise. Where they disagree, a repeated group on one side takes in what matches its body on
the other; otherwise the shortest stretch that brings both in step again becomes an optional group on its side. A text token
facing another is a text slot.

A page is then matched against the merged expression of its host: each of its texts belongs to one slot of the expression. A slot keeps on
how many pages it occurs, whether its text varies, how much there is and how much of it is links. Variation counts over
distinct pages, so copies of one page are no sign of furniture.

Which texts are main is decided per page, by slots. Slots that vary and are not mostly links hold content. Of the content in article or main elements and
the content beside and under the largest slot elsewhere, the larger one is main, where an article counts ``ARTICLE`` times: a teaser loses to a
long story. From what is chosen, texts go whose slot says the same on most pages of the host, unless they are headings. A name that marks furniture counts for an element inside
the main part and never for one around it.

Wrappers of a host are inferred where its pages are read, and these partial wrappers are merged in two steps, so a host with a third
of all pages sends a small row per batch; so do the figures of the slots.
"""

from __future__ import annotations

import html
import json
import re
import sys
import zlib
from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardwatch.llm.tables import stored

#: Partial wrappers of one host are merged in this many parts before the last merge.
PARTS = 16
#: A slot whose text never varies is furniture if so many distinct pages show it.
DISTINCT = 3
#: How much more content outside of an article outweighs the one inside.
ARTICLE = 4
#: Elements nest deeper on some pages than the interpreter's usual limit lets functions call themselves.
DEEPEST = 100_000
# Elements that never hold main text, and words in class, id or role that mark furniture.
SILENT = {"head", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "button", "title"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MARKS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside "
    "header masthead footer foot copyright notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login "
    "form search share sharing social related recommended comment comments reply replies respond disqus widget toolbar pagination pager tags hidden".split()
)
#: Words that say nothing beside one of these: a name marks furniture if each of its words is of either kind.
NEUTRAL = set(
    "site page main top bottom left right box block wrap wrapper container inner outer content section area bar list item items link links button buttons icon "
    "text title label unit slot group row col column panel primary secondary global local sub mobile desktop small large post posts article articles user js".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of these ends an open paragraph; one of a list item, cell or row ends its own kind.
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|textarea|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")


def _marks(attrs: str) -> tuple[str, bool, bool]:
    """Class, id and role of a tag as part of its name, whether they hide it or give it a role of furniture, and whether a name marks furniture."""
    found, hard, soft = [], False, False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("hidden", "aria-hidden"):
            hard = hard or (name == "hidden" and value != "until-found") or value == "true"
            continue
        hard = hard or (name == "role" and value in ("complementary", "contentinfo", "banner", "navigation", "search"))
        for one in value.split():
            words = set(WORDS.findall(one))
            soft = soft or (bool(words & MARKS) and words <= MARKS | NEUTRAL)
        # Numbers in a name count pages, not kinds of elements.
        found.append(re.sub(r"\d+", "0", value))
    return "." + ".".join(found) if found else "", hard, soft


class Block(NamedTuple):
    """A text of a page: the tags around it, whether an element leaves it out, which of the tags have a name of furniture."""

    path: tuple[str, ...]
    hard: bool
    soft: tuple[int, ...]
    text: str
    links: int

    def inside(self, depth: int) -> bool:
        """Whether nothing from the tag number ``depth`` on leaves it out."""
        return not self.hard and not any(k >= depth for k in self.soft)


def blocks_of(page: str) -> tuple[list[str], list[Block]]:
    """Token stream of a page, and its text blocks."""
    stream: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, token, left out from here on, has a name of furniture
    parts: list[str] = []
    links, in_link = 0, 0

    def close_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                soft = tuple(k for k, x in enumerate(stack) if x[3])
                blocks.append(Block(tuple(x[1] for x in stack), bool(stack and stack[-1][2]), soft, text, links))
                stream.append("#")
            parts.clear()
        links = 0

    def pop() -> None:
        stream.append("/" + stack.pop()[1])

    hidden_inline: list[str] = []
    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not hidden_inline:
                parts.append(text)
                if in_link:
                    links += len(text)
            continue
        if m["name"] is None:
            # Comments and elements whose content is no markup part nothing: their text is left out.
            continue
        name = m["name"].lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = 0 if m["end"] else 1
            if hidden_inline:
                if name == hidden_inline[-1] and m["end"]:
                    hidden_inline.pop()
                elif name == hidden_inline[-1] and name not in VOID:
                    hidden_inline.append(name)
            elif not m["end"] and name not in VOID and any(_marks(m["attrs"])[1:]):
                hidden_inline.append(name)
            continue
        hidden_inline.clear()
        in_link = 0
        close_block()
        if m["end"]:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in ENDS_PARAGRAPH and any(x[0] == "p" for x in stack):
            while stack[-1][0] in ("p",):
                pop()
        if name in ENDS_OWN:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ENDS_OWN[name]:
                    break
                if stack[depth][0] == name or (name in ("dt", "dd") and stack[depth][0] in ("dt", "dd")) or (name == "tr" and stack[depth][0] in ("td", "th")):
                    while len(stack) > depth:
                        pop()
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop()
        label, hard, soft = _marks(m["attrs"])
        token = name + label
        stream.append(token)
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            whole = name in ("html", "body")
            above = bool(stack and stack[-1][2])
            stack.append((name, token, above or (hard and not whole) or name in SILENT or name in FURNITURE, soft and not whole))
    close_block()
    while stack:
        pop()
    return stream, blocks


# A wrapper is a list of items: "tag", "/tag", "#" (text slot), ["?", items] (optional) or ["+", items] (repeated).


def folded(stream: list) -> list:
    """Neighbouring equal elements of a stream become one repeated group, from the inside out."""
    out: list = []
    opened: list[int] = []
    for token in stream:
        if not token.startswith("/"):
            if token != "#":
                opened.append(len(out))
            out.append(token)
            continue
        while opened and out[opened[-1]] != token[1:]:
            opened.pop()  # an element without an end, such as a line
        if not opened:
            out.append(token)
            continue
        at = opened.pop()
        element = [*out[at:], token]
        del out[at:]
        if out and isinstance(out[-1], list) and out[-1][0] == "+" and out[-1][1][0] == element[0]:
            out[-1] = ["+", merged(out[-1][1], element)]
        elif len(out) >= len(element) and out[-len(element) :] == element:
            out[-len(element) :] = [["+", element]]
        else:
            out += element
    return out


def _key(item) -> str:
    return item if isinstance(item, str) else _key(item[1][0]) if item[1] else ""


def _step(items: list, at: int) -> int:
    """Index after the element, group or slot that begins at ``at``."""
    item = items[at]
    if isinstance(item, list) or item == "#" or item.startswith("/"):
        return at + 1
    depth = 0
    for k in range(at, len(items)):
        if items[k] == item:
            depth += 1
        elif items[k] == "/" + item:
            depth -= 1
            if not depth:
                return k + 1
    return at + 1


def _units(items: list) -> list[list]:
    """Items cut into elements, groups and slots."""
    found, at = [], 0
    while at < len(items):
        end = _step(items, at)
        found.append(items[at:end])
        at = end
    return found


def _opened(unit: list) -> tuple[bool, bool, list]:
    """Whether a unit is optional, whether it is repeated, and its element or slot."""
    marks = ""
    while isinstance(unit[0], list):
        marks += unit[0][0]
        unit = unit[0][1]
    return "?" in marks, "+" in marks, unit


def _joined(x: list, y: list) -> list:
    """Two units that begin alike as one."""
    (maybe_x, many_x, a), (maybe_y, many_y, b) = _opened(x), _opened(y)
    if a == b:
        body = a
    else:
        longer = a if len(a) >= len(b) else b
        body = [longer[0], *merged(a[1:-1], b[1:-1]), longer[-1]]
    if many_x or many_y:
        body = [["+", body]]
    return [["?", body]] if maybe_x or maybe_y else body


def merged(x: list, y: list) -> list:
    """The wrapper of everything that either wrapper describes."""
    if x == y:
        return x
    a, b = _units(x), _units(y)
    keys_a, keys_b = [_key(u[0]) for u in a], [_key(u[0]) for u in b]
    places: dict[str, list[int]] = {}
    for k, key in enumerate(keys_b):
        places.setdefault(key, []).append(k)
    out: list[list] = []
    i = j = 0

    def optional(units: list[list]) -> None:
        out.extend(unit if _opened(unit)[0] else [["?", unit]] for unit in units)

    while i < len(a) and j < len(b):
        if keys_a[i] == keys_b[j]:
            key = keys_a[i]
            out.append(_joined(a[i], b[j]))
            i, j = i + 1, j + 1
            # A repeated group takes in the elements of its kind that follow on the other side.
            if _opened(out[-1])[1]:
                while i < len(a) and keys_a[i] == key and not (j < len(b) and keys_b[j] == key):
                    out[-1] = _joined(out[-1], a[i])
                    i += 1
                while j < len(b) and keys_b[j] == key and not (i < len(a) and keys_a[i] == key):
                    out[-1] = _joined(out[-1], b[j])
                    j += 1
            continue
        # The shortest stretch after which both sides are in step; only that far is searched.
        best = None
        for p in range(len(a) - i):
            if best is not None and p >= best[0]:
                break
            found = places.get(keys_a[i + p], [])
            at = bisect_left(found, j)
            if at < len(found) and (best is None or p + found[at] - j < best[0]):
                best = (p + found[at] - j, p, found[at] - j)
        if best is None:
            break
        optional(a[i : i + best[1]])
        optional(b[j : j + best[2]])
        i, j = i + best[1], j + best[2]
    optional(a[i:])
    optional(b[j:])
    return [item for unit in out for item in unit]


def expression(items: list) -> str:
    """The wrapper as a regular expression over tags, with ``#`` for a text."""
    return "".join(
        ("#" if x == "#" else f"<{x}>") if isinstance(x, str) else f"({expression(x[1])}){x[0]}" for x in items
    )


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def page_wrapper(page: str) -> dict:
    """The wrapper of one page."""
    return {"pages": 1, "items": folded(blocks_of(page)[0])}


def merged_wrappers(x: dict, y: dict) -> dict:
    return {"pages": x["pages"] + y["pages"], "items": merged(x["items"], y["items"])}


def _tree(stream: list) -> list[list]:
    """A stream or wrapper as nested nodes [token, children, optional, repeated]."""
    out: list[list] = []
    opened: list[int] = []
    for item in stream:
        if isinstance(item, list):
            maybe, many, body = _opened([item])
            for token, children, *_ in _tree(body):
                out.append([token, children, maybe, many])
        elif item.startswith("/"):
            while opened and out[opened[-1]][0] != item[1:]:
                opened.pop()
            if opened:
                at = opened.pop()
                out[at][1] = out[at + 1 :]
                del out[at + 1 :]
        else:
            if item != "#":
                opened.append(len(out))
            out.append([item, [], False, False])
    return out


class Expression:
    """A wrapper that pages are matched against. Slots are numbered in the order in which they are written."""

    def __init__(self, items: list):
        self.paths: list[str] = []
        self.top = self._level(_tree(items), ())

    def _level(self, nodes: list[list], above: tuple[str, ...]) -> tuple[list[tuple], dict[str, list[int]]]:
        level, places = [], {}
        for token, children, _, many in nodes:
            places.setdefault(token, []).append(len(level))
            if token == "#":
                level.append((len(self.paths), many))
                self.paths.append(" ".join(above))
            else:
                level.append((self._level(children, (*above, token)), many))
        return level, places

    def slots_of(self, stream: list[str]) -> list[int | None]:
        """The slot of each text of a page; None for a text that no slot of the expression takes."""
        found: list[int | None] = []

        def skip(nodes: list[list]) -> None:
            for token, children, *_ in nodes:
                if token == "#":
                    found.append(None)
                else:
                    skip(children)

        def match(nodes: list[list], level: list[tuple], places: dict[str, list[int]]) -> None:
            free, last = 0, ("", False)  # the first element not taken yet; kind of the last one taken, and whether it repeats
            for node in nodes:
                token = node[0]
                if last == (token, True):
                    chosen = free - 1
                else:
                    mine = places.get(token, [])
                    at = bisect_left(mine, free)
                    if at == len(mine):
                        skip([node])
                        continue
                    chosen = mine[at]
                free, last = chosen + 1, (token, level[chosen][1])
                if token == "#":
                    found.append(level[chosen][0])
                else:
                    match(node[1], *level[chosen][0])

        match(_tree(stream), *self.top)
        return found


def _main_of(path: str) -> str | None:
    """The innermost article or main element on a path, as the path down to it."""
    tags = path.split(" ") if path else []
    for wanted in ("article", "main"):
        for k, tag in enumerate(tags):
            if tag.split(".")[0] == wanted or (wanted == "main" and ".main" in tag + "."):
                return " ".join(tags[: k + 1])
    return None


def page_slots(page: str, expression_: Expression) -> dict[int, list]:
    """Figures of the slots of a page, by slot: [pages, texts, first text, varies, characters, link characters, distinct pages]."""
    stream, blocks = blocks_of(page)
    whole = hash_of("\n".join(b.text for b in blocks if not b.hard))
    slots: dict[int, list] = {}
    for b, at in zip(blocks, expression_.slots_of(stream)):
        if at is None or b.hard:
            continue
        named = hash_of(b.text)
        slot = slots.setdefault(at, [1, 0, named, False, 0, 0, [whole]])
        slot[1] += 1
        slot[3] = slot[3] or slot[2] != named
        slot[4] += len(b.text)
        slot[5] += b.links
    return slots


def merged_slots(x: dict, y: dict) -> dict:
    slots = dict(x)
    for key, s in y.items():
        t = slots.get(key)
        if t is not None:
            s = [t[0] + s[0], t[1] + s[1], t[2], t[3] or s[3] or t[2] != s[2], t[4] + s[4], t[5] + s[5], sorted({*t[6], *s[6]})[:DISTINCT]]
        slots[key] = s
    return slots


def _varies(slot: list) -> bool:
    return len(slot[6]) < DISTINCT or slot[3] or slot[1] > 2 * slot[0]


def main_slots(wrapper: dict) -> dict[int, int]:
    """Slots that hold content, with their characters."""
    text = {int(k): s for k, s in wrapper["slots"].items() if 2 * s[5] <= s[4]}
    body = {k: s[4] for k, s in text.items() if _varies(s)}
    # Where nothing varies at all, the pages differ in links only and are copies.
    return body or {k: s[4] for k, s in text.items()}


def same_slots(wrapper: dict) -> list[int]:
    """Slots that say the same on most pages of the host."""
    return sorted(int(k) for k, s in wrapper["slots"].items() if not _varies(s) and 2 * s[0] >= wrapper["pages"])


class Chooser:
    """The expression of a host, its slots with content, and those that are the same everywhere."""

    def __init__(self, items: list, body: dict[int, int], same: list[int]):
        self.expression, self.body, self.same = Expression(items), body, set(same)
        self.paths: dict[str, int] = {}
        for k, n in body.items():
            self.paths[self.expression.paths[k]] = max(n, self.paths.get(self.expression.paths[k], 0))

    def slots(self, stream: list[str], keys: list[str]) -> tuple[list[int], list[bool]]:
        """For each text of a page how much its slot holds on the host, 0 if that is no content, and whether it is the same everywhere.

        A text without a slot counts by its path.
        """
        slots = self.expression.slots_of(stream)
        sizes = [self.paths.get(key, 0) if at is None else self.body.get(at, 0) for at, key in zip(slots, keys)]
        return sizes, [at in self.same for at in slots]


def main_text(page: str, chosen: Chooser | None) -> str:
    """Main blocks of a page joined by newlines; without a wrapper, only those in articles."""
    stream, blocks = blocks_of(page)
    keys = [" ".join(b.path) for b in blocks]
    around = [_main_of(key) for key in keys]
    # Names of furniture count below the article and not for what is around it.
    article = [k for k, (b, top) in enumerate(zip(blocks, around)) if top is not None and b.inside(len(top.split(" ")))]
    if chosen is None:
        return "\n".join(blocks[k].text for k in article)
    sizes, same = chosen.slots(stream, keys)
    open_ = [k for k, b in enumerate(blocks) if sizes[k] and around[k] is None and not b.hard]
    largest = max((k for k in open_ if blocks[k].inside(0)), default=None, key=lambda k: (sizes[k], -k))
    if largest is None:
        # All content is under some name of furniture, which then is a name of the page.
        largest = max(open_, default=None, key=lambda k: (sizes[k], -k))
    other: list[int] = []
    if largest is not None:
        # Texts that no tag encloses have no parent.
        parent = keys[largest].rpartition(" ")[0]
        depth = len(blocks[largest].path) - 1
        other = [k for k in open_ if blocks[k].inside(depth) and (not parent or (keys[k] + " ").startswith(parent + " "))]
        other = other or [largest]

    def weight(those: list[int]) -> int:
        return sum(len(blocks[k].text) for k in those if not same[k])

    if not article or weight(other) > ARTICLE * weight(article):
        kept = other
    else:
        kept = article
    told = [k for k in kept if not same[k] or (blocks[k].path and blocks[k].path[-1].split(".")[0] in HEADINGS)]
    return "\n".join(blocks[k].text for k in (told if any(not same[k] for k in told) else kept))


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.withColumn("host", host).withColumn("html", F.coalesce(F.col("html").cast("string"), F.lit("")))


def _fold_rows(found: dict) -> pa.RecordBatch:
    hosts = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([json.dumps(found[h]) for h in hosts], pa.string())], names=["host", "wrapper"])


def _by_host(rows: DataFrame, join) -> DataFrame:
    """Partial results (host, wrapper) joined in two steps."""

    def merge(key, table):
        sys.setrecursionlimit(DEEPEST)
        whole = None
        for raw in sorted(table.column("wrapper").to_pylist()):
            one = json.loads(raw)
            whole = one if whole is None else join(whole, one)
        return pa.table([[key[0].as_py()], [json.dumps(whole)]], schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    parts = rows.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    return parts.groupBy("host", "part").applyInArrow(merge, _DDL).groupBy("host").applyInArrow(merge, _DDL)


_DDL = "host string, wrapper string"


def _packed(wrappers: DataFrame, pack) -> DataFrame:
    """(host, packed): ``pack`` of each wrapper, small enough to travel with the pages."""

    def run(batches):
        for batch in batches:
            packed = [zlib.compress(json.dumps(pack(json.loads(x))).encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["host", "packed"])

    return wrappers.select("host", "wrapper").mapInArrow(run, "host string, packed binary")


class _Opened:
    """Unpacked wrappers of a task, the last ones used."""

    def __init__(self, make, most: int = 256):
        self.make, self.most, self.held = make, most, {}

    def __getitem__(self, packed: bytes):
        one = self.held.pop(packed, None)
        if one is None:
            one = self.make(json.loads(zlib.decompress(packed)))
            if len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
        self.held[packed] = one
        return one


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) with the wrapper as JSON, from all pages; pages without a host have the host ``""``."""

    def partial(batches):
        sys.setrecursionlimit(DEEPEST)
        for batch in batches:
            found: dict[str, dict] = {}
            seen = set()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = page_wrapper(page)
                shape = (host, json.dumps(one["items"]))
                if shape in seen:
                    found[host]["pages"] += 1
                    continue
                seen.add(shape)
                found[host] = merged_wrappers(found[host], one) if host in found else one
            yield _fold_rows(found)

    def figures(batches):
        sys.setrecursionlimit(DEEPEST)
        opened = _Opened(Expression)
        for batch in batches:
            found: dict[str, dict] = {}
            for host, page, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found[host] = merged_slots(found.get(host, {}), {str(k): s for k, s in page_slots(page, opened[packed]).items()})
            yield _fold_rows(found)

    narrow = with_host(pages).select("host", "html")
    shapes = stored(_by_host(narrow.mapInArrow(partial, _DDL), merged_wrappers), "wrappers")
    rows = narrow.join(_packed(shapes, lambda w: w["items"]), "host").select("host", "html", "packed").mapInArrow(figures, _DDL)
    slots = _by_host(rows, merged_slots).withColumnRenamed("wrapper", "slots")

    def whole(batches):
        for batch in batches:
            joined = [json.dumps(json.loads(x) | {"slots": json.loads(y)}) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.string())], names=["host", "wrapper"])

    return shapes.join(slots, "host").select("host", "wrapper", "slots").mapInArrow(whole, _DDL)


def extracted(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block is one space, blocks are joined by one newline. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out: by element, by the words of
    their class, id or role inside the main part, or as slots of the host's wrapper without content. A null or empty html gives an empty text; a null url belongs to the host ``""``. Rows that repeat come
    back as often. A page of a host that ``wrappers`` does not have gives the text of its articles.
    """
    if wrappers is None:
        wrappers = infer(pages)
    packed = stored(_packed(wrappers, lambda w: [w["items"], sorted(main_slots(w).items()), same_slots(w)]), "main-slots")
    rows = with_host(pages).select("page_id", "url", "html", "host").join(packed, "host", "left").select("page_id", "url", "html", "packed")
    kinds = dict(rows.dtypes)

    def run(batches):
        sys.setrecursionlimit(DEEPEST)
        opened = _Opened(lambda x: Chooser(x[0], dict(x[1]), x[2]))
        for batch in batches:
            found = [main_text(page, None if one is None else opened[one]) for page, one in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
