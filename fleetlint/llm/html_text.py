"""Main text of web pages by wrappers that are induced per host.

``SAMPLE`` different pages of each host (by hash) give only the shape of a template: they are aligned
one after another by simple tree matching. The first page gives the template; neighbours of
one kind become a repeating slot; blocks of later pages that match nothing are added where
they stand. Then every page of the host is aligned with that shape, and the texts of all blocks are
counted per slot over the whole host; a block that the shape lacks has a slot of its own, named by its
path below the nearest aligned block. So layouts and blocks that no sample page shows are counted too.

A block whose text is the same in nearly all pages of the host that have its slot is template;
a slot whose text varies is content. Among the slots the one with the most
text outside links, menus, adverts and the like is the main slot.

Each page is aligned with its host's wrapper and the main slot's blocks are read in page order,
without constant blocks, boilerplate elements, and blocks whose class or id names such. A page
without the main slot has its main element chosen by the same measure
from the page without its constant blocks. Constancy is judged only with at least ``LEAST_SAME`` different pages.

Defined results: null html is empty and has the empty text; null and unreadable urls share one
host; repeated rows have equal results and copies of a page count once; cut, unclosed, misnested and
very deep markup is repaired or read; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.llm.dom import BLOCK, RAW, Node, block_texts, match, parse, squeeze, text_of
from fleetlint.llm.tables import map_arrow, map_groups, whole_text
from fleetlint.plans.skew import top_k
from fleetlint.plans.storage import materialise

#: Pages of a host that give the shape; share and number of all its pages in which a constant block must be the same.
SAMPLE, SAME_SHARE, LEAST_SAME = 8, 0.8, 3
#: Wrappers are broadcast up to this many bytes in all, else joined by a shuffle.
BROADCAST_BYTES = 32 * 2**20

DROPPED = RAW | frozenset("nav footer aside form menu button select option input dialog svg canvas object embed head label fieldset".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert|advertisement|adverts|banner|cookies?|consent|notices?|alert|sidebar|comments?|replies|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|masthead|share|sharing|social|related|promo|promoted|sponsor|sponsored|newsletter|subscribe|"
    r"popup|modal|overlay|widget|login|signup|search|pagination|pager|disqus|gdpr|toolbar|skip)(?:$|[\s_-])")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def is_boilerplate(node: Node) -> bool:
    """Whether an element by itself is no article text."""
    a = node.attributes
    return (node.tag in DROPPED or a.get("role") in _ROLES or "hidden" in a or a.get("aria-hidden") == "true"
            or "display:none" in a.get("style", "").replace(" ", "")
            or bool(_NAMES.search(a.get("class", "")) or _NAMES.search(a.get("id", ""))))


def _sizes(root: Node, constant: frozenset[int] | set[int] = frozenset()) -> dict[int, int]:
    """Characters of article text outside links below each node, by the node's identity."""
    order = [root]
    for node in order:  # grows
        order += node.nodes()
    sizes: dict[int, int] = {}
    for node in reversed(order):
        sizes[id(node)] = sum(
            len(child) if isinstance(child, str) else
            0 if child.tag == "a" or id(child) in constant or is_boilerplate(child) else sizes[id(child)] for child in node.children)
    return sizes


def blocks_of(node: Node, constant: set[int]) -> list[str]:
    """Text blocks of an element in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = squeeze("".join(line))
        line.clear()
        if text:
            out.append(text)

    stack = [(iter(node.children), False, False)]  # what is left of an element, headings only, whether it is a block
    while stack:
        rest, headings_only, is_block = stack[-1]
        for child in rest:
            if isinstance(child, str):
                if not headings_only:
                    line.append(child)
            elif is_boilerplate(child) or id(child) in constant:
                continue
            elif child.tag == "br":
                line.append(" ")
            elif child.tag in BLOCK:
                flush()
                stack.append((iter(child.children), child.tag == "header" or headings_only and child.tag not in _HEADINGS, True))
                break
            else:
                stack.append((iter(child.children), headings_only, False))
                break
        else:
            stack.pop()
            if is_block:
                flush()
    flush()
    return out


def new_template(node: Node) -> dict:
    """A template node of a page's block; equal neighbours become one repeating node."""
    order = [(node, -1)]
    for place, (n, _) in enumerate(order):  # grows
        order += [(child, place) for child in n.blocks()]
    made = [{"key": n.key, "repeat": False, "drop": is_boilerplate(n), "children": []} for n, _ in order]
    inner: list[list[dict]] = [[] for _ in order]
    for place in range(len(order) - 1, -1, -1):
        for child in reversed(inner[place]):
            _add(made[place]["children"], len(made[place]["children"]), child)
        if place:
            inner[order[place][1]].append(made[place])
    return made[0]


def _add(children: list[dict], at: int, node: dict) -> None:
    for neighbour in children[max(0, at - 1):at + 1]:
        if neighbour["key"] == node["key"]:
            neighbour["repeat"] = True
            for k, grandchild in enumerate(node["children"]):
                if grandchild["key"] not in [c["key"] for c in neighbour["children"]]:
                    neighbour["children"].insert(min(k, len(neighbour["children"])), grandchild)
            return
    children.insert(at, node)


def _learn(template: dict, page: Node) -> None:
    """Align a page and add blocks that match nothing."""
    pairs: list = []
    match(template, page, pairs)
    of = {id(node): t for t, node in pairs}
    for t, node in pairs:
        place = 0
        for child in node.blocks():
            known = of.get(id(child))
            at = next((k for k, c in enumerate(t["children"]) if c is known), None)
            if at is None:
                before = len(t["children"])
                _add(t["children"], place, new_template(child))
                place += len(t["children"]) - before
            else:
                place = at + 1


def in_order(template: dict) -> list[dict]:
    """A template's nodes, parents first. A node's place is the name of its slot."""
    order = [template]
    for t in order:  # grows
        order += t["children"]
    return order


def shape_of(pages: list[str]) -> dict:
    """The shape of a host's template from some of its pages; a root alone where none of them has blocks."""
    trees = [body for body in map(parse, sorted(set(pages))) if body.blocks()]
    template = new_template(trees[0] if trees else Node("#root"))
    for tree in trees:
        _learn(template, tree)
    return template


def as_json(template: dict, extra: dict[int, int] | None = None) -> str:
    """A template as a flat list, so that its depth is not bounded by that of a JSON reader."""
    order = in_order(template)
    place = {id(t): k for k, t in enumerate(order)}
    parent = {id(c): place[id(t)] for t in order for c in t["children"]}
    return json.dumps([[[*t["key"], int(t["repeat"]), int(t["drop"]), parent.get(id(t), -1), t.get("constant"), int(t.get("main", False))]
                        for t in order], list((extra or {}).items())])


def from_json(text: str) -> tuple[dict, dict[int, int]]:
    """A template, whose nodes know their ``slot``, and the constant texts of slots that it lacks."""
    rows, extra = json.loads(text)
    order: list[dict] = []
    for slot, (tag, name, repeat, drop, parent, constant, main) in enumerate(rows):
        order.append({"key": (tag, name), "repeat": bool(repeat), "drop": bool(drop), "constant": constant, "main": bool(main),
                      "slot": slot, "children": []})
        if parent >= 0:
            order[parent]["children"].append(order[-1])
    return order[0], {int(k): v for k, v in extra}


def digest_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slots_of(template: dict, root: Node) -> dict[int, tuple[int, dict | None]]:
    """The slot of each block of a page, and its template node. A block that matches nothing has a negative number of its path."""
    pairs: list = []
    match(template, root, pairs)
    known = {id(node): (t["slot"], t) for t, node in pairs}
    todo = [root]
    while todo:
        node = todo.pop()
        above = known.get(id(node), (-1, None))[0]
        for child in node.blocks():
            if id(child) not in known:
                path = digest_of("\0".join((str(above), *child.key)))
                known[id(child)] = (min(path, ~path), None)
            todo.append(child)
    return known


def page_counts(template: dict, source: str) -> list[tuple[int, int, int, int, int]]:
    """``slot, digest, n, first, size`` of a page's blocks; ``first`` is 1 once per slot."""
    root = parse(source)
    slots = slots_of(template, root)
    sizes = _sizes(root)
    found: dict[tuple[int, int], list[int]] = {}
    seen: set[int] = set()
    for node, text in block_texts(root):
        if id(node) not in slots:
            continue
        slot, t = slots[id(node)]
        row = found.setdefault((slot, digest_of(text)), [0, 0, 0])
        row[0] += 1
        if slot not in seen:
            seen.add(slot)
            row[1] = 1
        if t is not None and not t["drop"]:
            row[2] += sizes[id(node)]
    return [(*key, *row) for key, row in found.items()]


def finish(template: dict, counts: list[dict]) -> str:
    """The wrapper of a host (JSON): its shape with constant blocks and the main slot by the counts of all its pages."""
    of = {c["slot"]: c for c in counts}
    order = in_order(template)
    for slot, t in enumerate(order):
        c = of.get(slot)
        t["size"] = c["size"] if c else 0
        t["constant"] = c["digest"] if c and c["most"] >= LEAST_SAME and c["most"] >= SAME_SHARE * c["pages"] and (
            not t["repeat"] or c["most"] >= SAME_SHARE * c["total"]) else None
    main = template
    while True:  # go down while one slot has nearly all of the text and its siblings hold none that varies
        inner = [c for c in main["children"] if not c["drop"] and c["constant"] is None and not c["repeat"]]
        best = max(inner, key=lambda c: c["size"], default=None)
        if best is None or best["key"][0] in ("p", "pre", *_HEADINGS) or (
                best["key"][0] not in ("article", "main") and best["size"] < 0.8 * main["size"]):
            break
        main = best
    main["main"] = bool(template["children"])
    return as_json(template, {c["slot"]: c["digest"] for c in counts if c["slot"] < 0})


def main_of_page(root: Node, constant: set[int]) -> Node:
    """The main element of a page without a main slot."""
    main = root
    sizes = _sizes(root, constant)
    while True:
        inner = [c for c in main.blocks() if not is_boilerplate(c) and id(c) not in constant]
        best = max(inner, key=lambda c: sizes[id(c)], default=None)
        if best is None or best.tag in ("p", "pre", *_HEADINGS) or (
                best.tag not in ("article", "main") and sizes[id(best)] < 0.8 * sizes[id(main)]):
            return main
        main = best


def main_text(source: str, wrapper: tuple[dict, dict[int, int]] | None = None) -> str:
    """The main text of a page, blocks joined by line breaks."""
    root = parse(source)
    main, constant = None, set()
    if wrapper:
        template, extra = wrapper
        slots = slots_of(template, root)
        todo = [root]
        while todo:  # in page order
            node = todo.pop()
            slot, t = slots[id(node)]
            same = extra.get(slot) if t is None else t["constant"]
            if t is not None and t["main"]:
                main = node if main is None else main
            elif same is not None and node.tag != "body" and node is not root and same == digest_of(text_of(node)):
                constant.add(id(node))
            todo += node.blocks()[::-1]
    return "\n".join(blocks_of(main_of_page(root, constant) if main is None else main, constant))


def with_host(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    url = pages[url_column].cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(pages[id_column].cast("long").alias("page_id"), url.alias("url"), host.alias("host"),
                        whole_text(pages, html_column).alias("html"))


def shapes(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``host, shape`` (JSON) of each host. ``pages`` is a result of ``with_host``."""
    keyed = pages.select("host", "page_id", F.xxhash64("html").alias("key"))
    # copies of a page say nothing about a template: one of each is ranked
    keyed = keyed.groupBy("host", "key").agg(F.min("page_id").alias("page_id"))
    chosen = materialise(top_k(keyed, ["host"], [F.xxhash64("key"), F.col("key")], sample, ["key"]).select("host", "key"), "sample-pages")
    sampled = pages.withColumn("key", F.xxhash64("html")).join(chosen, ["host", "key"]).dropDuplicates(["host", "key"]).select("host", "html")

    def run(table: pa.Table) -> pa.Table:
        shape = as_json(shape_of(table.column("html").to_pylist()))
        return pa.table({"host": [table.column("host")[0].as_py()], "shape": [shape]})

    return materialise(map_groups(sampled, ["host"], run, "host string, shape string"), "shapes")


def _with_text(rows: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return rows.join(F.broadcast(texts) if size <= BROADCAST_BYTES else texts, "host", "left")


def _remembered():
    """A reader of shapes and wrappers that keeps the last ones."""
    known: dict[str, tuple] = {}

    def read(text: str | None):
        if text is None:
            return None
        if text not in known:
            if len(known) > 1000:
                known.clear()
            known[text] = from_json(text)
        return known[text]

    return read


_COUNTS = "slot bigint, digest bigint, n bigint, first bigint, size bigint"


def slot_counts(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """``host, slot, digest, most, total, pages, size`` over all different pages of each host: the most frequent text of each slot.

    A page leaves its task as digests; equal pages are counted once. Texts of a slot are counted per digest
    before the slots are, both with partial sums, so a large host is shared by all tasks.
    """
    keyed = pages.select("host", F.xxhash64("html").alias("key"), "html")

    def run(batches):
        read = _remembered()
        names = [x.split()[0] for x in _COUNTS.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            ends = [0]
            for source, shape in zip(batch.column("html").to_pylist(), batch.column("shape").to_pylist(), strict=True):
                rows += page_counts(read(shape)[0], source)
                ends.append(len(rows))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[] for _ in names])]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), found], ["host", "key", "counts"])

    counted = map_arrow(_with_text(keyed, learned, "shape").select("host", "key", "html", "shape"), run,
                        f"host string, key bigint, counts array<struct<{_COUNTS.replace(' ', ':').replace(',:', ',')}>>")
    once = counted.dropDuplicates(["host", "key"]).select("host", F.inline("counts"))
    texts = once.groupBy("host", "slot", "digest").agg(*[F.sum(c).alias(c) for c in ("n", "first", "size")])
    slots = texts.groupBy("host", "slot").agg(
        F.max(F.struct("n", "digest")).alias("top"), F.sum("n").alias("total"), F.sum("first").alias("pages"), F.sum("size").alias("size"))
    slots = slots.select("host", "slot", F.col("top.digest").alias("digest"), F.col("top.n").alias("most"), "total", "pages", "size")
    # slots that the shape lacks are kept where they are constant
    return slots.where((F.col("slot") >= 0) | (F.col("most") >= LEAST_SAME) & (F.col("most") >= SAME_SHARE * F.col("total")))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``host, wrapper`` (JSON) of each host. ``pages`` is a result of ``with_host``."""
    learned = shapes(pages, sample)
    slots = slot_counts(pages, learned).groupBy("host").agg(
        F.collect_list(F.struct("slot", "digest", "most", "total", "pages", "size")).alias("counts"))

    def run(batches):
        for batch in batches:
            texts = [finish(from_json(shape)[0], counts or []) for shape, counts in zip(
                batch.column("shape").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(texts, pa.string())], ["host", "wrapper"])

    return materialise(map_arrow(learned.join(slots, "host", "left"), run, "host string, wrapper string"), "wrappers")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
               sample: int = SAMPLE) -> DataFrame:
    """``page_id, url, text`` of each page."""
    rows = with_host(pages, id_column, url_column, html_column)
    joined = _with_text(rows, wrappers(rows, sample), "wrapper")

    def run(batches):
        read = _remembered()
        for batch in batches:
            texts = [main_text(source, read(wrapper)) for source, wrapper in zip(
                batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return map_arrow(joined.select("page_id", "url", "html", "wrapper"), run, "page_id long, url string, text string")
