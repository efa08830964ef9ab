"""Main text of web pages, by wrappers inferred from the pages of each host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast.operators.joins import lookup_join
from salescast.sources.staging import stage

# fixed values: what HTML says about tags, and names of parts that are not the article
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section
    summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset(
    """head nav header footer aside form script style textarea title noscript template iframe button select
    option svg canvas object dialog menu xmp noembed noframes search""".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
HOLDS = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
    "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",),
}
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner
    sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments
    disqus reply replies respond discussion cookie cookies consent gdpr notice notices notification alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social related recommended
    widget toolbar pagination pager skip copyright legal""".split()
)

# parts that are none of the article in whatever place of it, also with a word of place or shape
APART = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsors sponsored promo sidebar breadcrumb
    breadcrumbs comment comments disqus reply replies cookie cookies consent gdpr newsletter subscribe popup
    navbar pagination""".split()
)
SHAPE = frozenset(
    """area bar block bottom box center column container count feed form group holder inner inline item items
    label large left link links list middle outer page panel post reader readers right row section site slot
    small space strip text thread title top unit user users wrap wrapper zone""".split()
)

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S
)
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# numbers of a grid tell columns apart; other digits, such as those of ids, are left out
PART = re.compile(r"(?:col|cols|column|columns|span|grid|width|size|xs|sm|md|lg|xl|small|medium|large|w)[-_]?\d{1,2}(?!\d)|[a-z]+")
TALK = frozenset("comment comments disqus reply replies respond discussion".split())
GROUP = 4
DEPTH = 200  # levels of blocks; deeper ones are blocks of the last level
LAYOUT = frozenset("body center div main section table tbody td tr".split())


class Node:
    """A block of a page, or a part that is dropped: label, children (nodes and texts).

    ``named`` says that it is dropped by a class or id alone.
    """

    __slots__ = ("tag", "label", "children", "dropped", "block", "named")

    def __init__(self, tag: str, label: str, dropped: bool, block: bool, named: bool = False):
        self.tag, self.label, self.dropped, self.block, self.named = tag, label, dropped, block, named
        self.children: list = []


def noisy(name: str) -> bool:
    """Whether a class or id, such as ``sidebar``, ``cookie-notice`` or ``user-comments``, names no article; ``no-sidebar`` may.

    All its words must be names of such parts; or one of them a name of a part that is never the article's,
    and the others words of place and shape.
    """
    parts = set(PART.findall(name))
    return bool(parts) and (parts <= NOISE or bool(parts & APART) and parts <= NOISE | APART | SHAPE)


def describe(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Label of a tag (name and classes, without digits but for columns), whether it is no part of the article, and if only by its names."""
    dropped = tag in DROPPED
    if "=" not in attributes:
        return tag, dropped, False
    names, named = [], False
    for m in NAMED.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "role":
            dropped = dropped or value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog")
            continue
        parts = PART.findall(value)
        names += parts
        if tag == "article":
            dropped = dropped or not NOISE.isdisjoint(parts) and "comment" in value
        elif tag not in ("body", "html", "main"):
            named = named or any(map(noisy, value.split()))
    return ".".join([tag, *dict.fromkeys(names)]), dropped or named, named and not dropped


def spare(root: Node) -> None:
    """Take back a drop by name around the article: the largest ``article`` and ``main``, or else most of the text.

    Comments may be longer than what they are about, so these stay dropped in the second case.
    """
    sizes: dict[int, int] = {}
    found: dict[str, tuple[int, list[Node]]] = {}

    def walk(node: Node, above: list[Node]) -> int:
        size = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        for child in node.children:
            if isinstance(child, Node) and (child.named or not child.dropped):
                size += walk(child, [*above, node])
        sizes[id(node)] = size
        if node.tag in ("article", "main") and size > found.get(node.tag, (0, []))[0]:
            found[node.tag] = size, above
        return size

    def most(node: Node) -> None:
        for child in node.children:
            if isinstance(child, Node) and 2 * sizes.get(id(child), 0) > sizes[id(root)]:
                if child.named and TALK.isdisjoint(child.label.split(".")[1:]):
                    child.dropped = child.named = False
                if not child.dropped:
                    most(child)

    walk(root, [])
    for _, above in found.values():
        for node in above:
            if node.named:
                node.dropped = node.named = False
    if not found:
        most(root)


def end_blocks(stack: list[Node], at: int) -> None:
    """End the open blocks from ``at`` on; one beyond ``DEPTH`` (without label) ends a block of the last level."""
    if not stack[at].label:
        stack[at].children.append(Node("hr", "hr", False, True))
    del stack[at:]


def parse(page: str) -> Node:
    """The page as a tree of blocks. Inline tags are looked through; open ends are closed.

    A tree has ``DEPTH`` levels: what is nested deeper stays in its order, as blocks of the last one.
    """
    root = Node("", "", False, True)
    stack, at, n, doubtful = [root], 0, len(page), False
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].children.append(html.unescape(page[at:start]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    end_blocks(stack, i)
                    break
            continue
        if tag == "br":
            stack[-1].children.append(" ")
            continue
        block = tag in BLOCKS
        label, dropped, named = describe(tag, m[3])
        doubtful = doubtful or named
        if not block and not dropped and tag not in RAW:
            continue
        if block:
            if stack[-1].tag == "p":
                end_blocks(stack, len(stack) - 1)
            if closes := CLOSES.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in HOLDS[tag]:
                        break
                    if stack[i].tag in closes:
                        end_blocks(stack, i)
                        break
        if len(stack) > DEPTH and block and tag not in VOID and (stack[-1].dropped or not dropped):
            deeper = Node(tag, "", stack[-1].dropped, True)
            deeper.children = stack[-1].children
            deeper.children.append(Node("hr", "hr", False, True))
            stack.append(deeper)
            continue
        node = Node(tag, label, dropped, block, named)
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and not block:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = page.find(">", close.start()) + 1 or n if close else n
            continue
        stack.append(node)
    if doubtful:
        spare(root)
    return root


def keep_titles(node: Node, inside: bool = False) -> None:
    """A header within the article that has a heading is the article's own."""
    for child in node.children:
        if isinstance(child, Node):
            within = inside or child.tag in ("article", "main")
            if inside and child.tag == "header" and any(isinstance(c, Node) and re.fullmatch("h[1-6]", c.tag) for c in child.children):
                child.dropped = False
            if not child.dropped:
                keep_titles(child, within)


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space made one space."""
    found: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            found.append(text)
        buffer.clear()

    def walk(one: Node) -> None:
        for child in one.children:
            if isinstance(child, str):
                buffer.append(child)
            elif child.dropped:
                if child.block:
                    flush()
            else:
                if child.block:
                    flush()
                walk(child)
                if child.block:
                    flush()

    walk(node)
    flush()
    return found


# A wrapper is a list of units [optional, repeated, items]; an item is "#" for a text slot,
# or [label, units] for an element.


def units_of(node: Node) -> list:
    units, text = [], False
    for child in node.children:
        if isinstance(child, str):
            if not text and child.strip():
                units.append([0, 0, ["#"]])
                text = True
        else:
            units.append([0, 0, [[("-" if child.dropped else "") + child.label, units_of(child)]]])
            text = False
    return fold(units)


def key(unit: list) -> tuple:
    return tuple(i if i == "#" else i[0] for i in unit[2])


def join_units(a: list, b: list, repeated: int = 0) -> list:
    items = [x if x == "#" else [x[0], align(x[1], y[1])] for x, y in zip(a[2], b[2])]
    return [a[0] | b[0], a[1] | b[1] | repeated, items]


def fold(units: list) -> list:
    """Runs of the same group, of one to four units, become one repeated group."""
    for size in range(1, GROUP + 1):
        out: list = []
        for unit in units:
            out.append(unit)
            while len(out) >= 2 * size:
                first, second = out[-2 * size : -size], out[-size:]
                if [key(u) for u in first] != [key(u) for u in second]:
                    break
                if size > 1 and any(u[0] or u[1] for u in first + second):
                    break
                if size == 1:
                    out[-2:] = [join_units(first[0], second[0], 1)]
                else:
                    whole = [[0, 0, [i for u in group for i in u[2]]] for group in (first, second)]
                    out[-2 * size :] = [join_units(*whole, 1)]
        units = out
        if size > 1:
            units = absorbed(units)
    return units


def absorbed(units: list) -> list:
    """Further rounds of a repeated group behind it are part of it."""
    out: list = []
    for unit in units:
        out.append(unit)
        for size in range(2, GROUP + 1):
            if len(out) > size and out[-size - 1][1] and not any(u[0] or u[1] for u in out[-size:]):
                group = [0, 0, [i for u in out[-size:] for i in u[2]]]
                if key(out[-size - 1]) == key(group):
                    out[-size - 1 :] = [join_units(out[-size - 1], group, 1)]
                    break
    return out


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers: what both have stays, other units become optional.

    Units are matched by a longest common subsequence of their labels, and matched
    elements are aligned inside. Runs that come together are folded.
    """
    if a == b:
        return a
    ka, kb = [key(u) for u in a], [key(u) for u in b]
    if ka == kb:
        return [join_units(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(join_units(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([1, a[i][1], a[i][2]])
            i += 1
        else:
            out.append([1, b[j][1], b[j][2]])
            j += 1
    return fold(out)


def shown(units: list) -> str:
    """A wrapper as an expression: ``#`` a text slot, ``?`` optional, ``+`` repeated; ``-`` dropped."""
    out = []
    for optional, repeated, items in units:
        body = " ".join(i if i == "#" else f"{i[0]}({shown(i[1])})" for i in items)
        if len(items) > 1 and (optional or repeated):
            body = f"({body})"
        out.append(body + "+" * bool(repeated) + "?" * bool(optional))
    return " ".join(out)


def masses(root: Node) -> Counter:
    """Characters of text below each path of labels that is not dropped."""
    found: Counter = Counter()

    def walk(node: Node, path: str) -> int:
        total = sum(len(c) for c in node.children if isinstance(c, str))
        for child in node.children:
            if isinstance(child, Node) and not child.dropped:
                total += walk(child, f"{path}/{child.label}")
        found[path] += total
        return total

    walk(root, "")
    return found


def main_path(mass: Counter) -> str:
    """Path of the article: the largest ``article`` or ``main``, or else the part that holds most.

    Without such a tag, it is searched from the root, going down while one child has nine
    tenths of the text.
    """
    named = [p for p in mass if re.fullmatch(r"(article|main)(\..*)?", p.rpartition("/")[2]) and mass[p]]
    if named:
        inner = [p for p in named if p.rpartition("/")[2].startswith("article")] or named
        top = [p for p in inner if not any(p.startswith(q + "/") for q in inner)]
        return min(top, key=lambda p: (-mass[p], p))
    at = ""
    while True:
        below = [p for p in mass if p.rpartition("/")[0] == at and p != at]
        best = min(below, key=lambda p: (-mass[p], p), default=None)
        if best is None or not mass[at] or mass[best] < 0.9 * mass[at] or re.fullmatch(r"(p|h\d|li|td|pre|blockquote)(\..*)?", best.rpartition("/")[2]):
            return at
        at = best


def at_path(root: Node, path: str) -> list[Node]:
    nodes = [root]
    for label in path.split("/")[1:]:
        nodes = [c for n in nodes for c in n.children if isinstance(c, Node) and c.label == label and not c.dropped]
    return nodes


def read_page(page: str) -> Node:
    root = parse(page)
    keep_titles(root)
    return root


def template_of(root: Node) -> int:
    """Number of the template a page is made by: a hash of its paths of layout parts that hold text, above any article."""
    found: set[str] = set()

    def walk(node: Node, path: str) -> bool:
        text = False
        for child in node.children:
            if isinstance(child, str):
                text = text or bool(child.strip())
            elif not child.dropped:
                text = walk(child, f"{path}/{child.label}" if child.tag in LAYOUT and path is not None else None) or text
        if text and path:
            found.add(path)
        return text

    walk(root, "")
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=8).digest(), "big", signed=True)


def slots_of(root: Node) -> dict[str, dict[str, int]]:
    """Of every path of labels that is not dropped, its own distinct texts as hashes, with their characters."""
    found: dict[str, dict[str, int]] = {}

    def walk(node: Node, path: str) -> None:
        own = found.setdefault(path, {})
        for child in node.children:
            if isinstance(child, str):
                if text := child.strip():
                    name = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()
                    own[name] = own.get(name, 0) + len(child)
            elif not child.dropped:
                walk(child, f"{path}/{child.label}")

    walk(root, "")
    return found


def main_text(page: str | None, path: str | None) -> str:
    """The article's text by the wrapper's path, or by the page's own if it has no such part."""
    if not page:
        return ""
    root = read_page(page)
    nodes = at_path(root, path) if path is not None else []
    found = [t for n in nodes for t in blocks_of(n)]
    if not found:
        found = [t for n in at_path(root, main_path(masses(root))) for t in blocks_of(n)]
    return "\n".join(found)


class Wrapper:
    """What is known of the pages of a host that are made by one template.

    ``slots`` has, of each path, the number of pages with it and the texts that all of
    them have there: these are the template's own, the others vary.
    """

    def __init__(self, pages: int = 0, units: list | None = None, mass: Counter | None = None, slots: dict | None = None):
        self.pages, self.units, self.mass = pages, units, mass or Counter()
        self.slots: dict[str, list] = slots or {}
        self.seen: set[str] = set()

    def add(self, page: str, root: Node | None = None) -> None:
        root = read_page(page) if root is None else root
        self.mass.update(masses(root))
        self.pages += 1
        self._fix({path: [1, own] for path, own in slots_of(root).items()})
        units = units_of(root)
        form = json.dumps(units)
        if form not in self.seen:
            self.seen.add(form)
            self.units = units if self.units is None else align(self.units, units)

    def _fix(self, slots: dict[str, list]) -> None:
        for path, (pages, own) in slots.items():
            if path in self.slots:
                n, kept = self.slots[path]
                self.slots[path] = [n + pages, {t: min(c, own[t]) for t, c in kept.items() if t in own}]
            else:
                self.slots[path] = [pages, own]

    def merge(self, other: Wrapper) -> None:
        self.pages += other.pages
        self.mass.update(other.mass)
        self._fix(other.slots)
        self.units = other.units if self.units is None else align(self.units, other.units)

    def main(self) -> str:
        """Path of the article: an ``article`` or ``main``, or else by the characters of varying slots.

        Two pages, or pages that differ in less than a twentieth, may be copies of one
        article; then all characters count.
        """
        varying = Counter(self.mass)
        for path, (pages, own) in self.slots.items():
            fixed = pages * sum(own.values()) if pages > 2 else 0
            while fixed:
                varying[path] -= fixed
                if not path:
                    break
                path = path.rpartition("/")[0]
        tagged = any(n and re.match(r"(article|main)(\.|$)", p.rpartition("/")[2]) for p, n in self.mass.items())
        return main_path(self.mass if tagged or 20 * varying[""] < self.mass[""] else varying)


WRAPPERS = T.StructType(
    [
        T.StructField("host", T.StringType()), T.StructField("template", T.LongType()), T.StructField("pages", T.LongType()),
        T.StructField("units", T.StringType()), T.StructField("mass", T.StringType()), T.StructField("slots", T.StringType()),
    ]
)
HOSTS = 2000


def host_of(url: str | Column) -> Column:
    """Host of a URL in lower case; NULL if there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html", salts: int = 32) -> DataFrame:
    """One wrapper per host and template, from all of its pages: ``host``, ``template``, ``pages``, ``wrapper``, ``main``.

    Every task aligns the pages it reads, template by template; then what the tasks found
    of one is aligned in up to ``salts`` groups, and these at last, so a host may have any
    share of the pages. ``wrapper`` is a union-free expression over tags and text slots,
    ``main`` the path of the article: the part with most characters in slots that vary.
    NULL pages are left out; a NULL host is one.
    """
    fields = WRAPPERS.names
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def row_of(host: str, template: int, w: Wrapper) -> tuple:
        return host, template, w.pages, json.dumps(w.units), json.dumps(w.mass), json.dumps(w.slots)

    def batch_of(found: dict[tuple, Wrapper]) -> pa.RecordBatch:
        columns = list(zip(*[row_of(*at, w) for at, w in found.items()])) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Wrapper] = {}
        for batch in batches:
            for host, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = read_page(value.as_py())
                found.setdefault((host, template_of(root)), Wrapper()).add("", root)
                if len(found) > HOSTS:
                    yield batch_of(found)
                    found = {}
        yield batch_of(found)

    def merge(name: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = Wrapper()
        for row in group.sort_values(["units", "mass", "slots", "pages"]).itertuples():
            whole.merge(Wrapper(int(row.pages), json.loads(row.units), Counter(json.loads(row.mass)), json.loads(row.slots)))
        return pd.DataFrame([row_of(name[0], name[1], whole)], columns=fields)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            forms = [shown(json.loads(units)) for *_, units, _, _ in rows]
            paths = [Wrapper(n, None, Counter(json.loads(mass)), json.loads(slots)).main() for _, _, n, _, mass, slots in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(forms, pa.string()), pa.array(paths, pa.string())],
                names=["host", "template", "pages", "wrapper", "main"],
            )

    sound = pages.filter(F.col(page).isNotNull()).select(host_of(url).alias("host"), F.col(page).alias("html"))
    first = sound.mapInArrow(read, WRAPPERS)
    salted = first.withColumn("salt", F.pmod(F.xxhash64("units", "mass"), F.lit(salts)))
    some = salted.groupBy("host", "template", "salt").applyInPandas(merge, WRAPPERS)
    whole = some.groupBy("host", "template").applyInPandas(merge, WRAPPERS)
    return stage(whole.mapInArrow(finish, "host string, template long, pages long, wrapper string, main string"))


def extract(pages: DataFrame, keep: list[str], url: str = "url", page: str = "html", wrappers: DataFrame | None = None) -> DataFrame:
    """The main text of every page, beside the columns ``keep``: ``text``.

    A page's article is found by the wrapper of its host and template; a page without that
    part is its own wrapper. Parts named as menus, adverts, comments and the like are left
    out of it. Character references are decoded, white space inside a block is one space,
    and blocks are joined by a line break in page order. NULL and empty pages have an empty
    text. Rows are independent: repeated ones stay. An empty table gives no rows.
    """
    wrappers = infer_wrappers(pages, url, page) if wrappers is None else wrappers
    rows = pages.select(*keep, host_of(url).alias("_host"), F.col(page).alias("_html"))

    def types(frame: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [template_of(read_page(h.as_py() or "")) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, "_template"])

    rows = rows.mapInArrow(templates, types(rows) + ", `_template` long")
    paths = wrappers.select(
        F.col("host").alias("_host"), F.col("template").alias("_template"), F.col("main").alias("_main"), F.col("pages").alias("_pages")
    )
    known = lookup_join(rows, paths, ["_host", "_template"], weight="_pages", row_id=keep)
    kept = known.select(*keep)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html_at, path_at = batch.num_columns - 2, batch.num_columns - 1
            made = [main_text(h.as_py(), p) for h, p in zip(batch.column(html_at), batch.column(path_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(made, pa.string())], names=[*batch.schema.names[:-2], "text"])

    return known.select(*keep, "_html", "_main").mapInArrow(texts, types(kept) + ", text string")
