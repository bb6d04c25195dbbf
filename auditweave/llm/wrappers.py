"""Main text of web pages by wrapper induction.

Pages of one host and one layout (the set of their structural tags) are aligned with a reference page by simple tree
matching: two trees match if their roots do, and the best ordered matching of their children is found by dynamic
programming, recursively. The trees hold block elements only, and neighbours of one kind are one repeated node, so a list
or a run of paragraphs is one slot whatever its length. Over all pages of the group, slots with the same text everywhere
become template; slots whose text varies become content.

Elements that never hold an article (menus, footers, forms, scripts, ...), by tag, or by class, id or role, are left out
while parsing, and if a page marks its article or main part, only that counts; else blocks that are mostly links are left
out as well. Inside a marked part only names that say nothing else count (``ad-slot``, ``comments``, but not
``related-work`` or ``notice-of-law``); an article so named is a comment or advert, not the article. Slots of a group count as template from LEAST different pages on, and only if some other slot differs between
pages: copies of one page (equal html) count once, and the text of a slot on a page is that of all its blocks there.

Of copies the first by a hash of the html counts, in partial aggregates; then counts are made by partial aggregation over
(host, layout, slot), so a host with very many pages sends one row per slot and task. Reference trees hold tags only and go to the pages by a join whose kind Spark chooses by size.

Defined results: a null or empty page has an empty text; a null or unparsable url is the host ""; null page_ids are
extracted like others and lead no group; repeated rows are extracted each; markup that does not end or nest is read as
far as it goes; elements more than DEEPEST deep are read as children of the one at that depth, as browsers do. Other columns are not read.
"""

import html as entities
import json
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import cut, map_batches, query, table, text_or_empty

#: Pages of a group from which a constant slot is template.
LEAST = 8
#: Most elements on the way from the root to a block.
DEEPEST = 512

#: HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("head script style noscript template svg math iframe object embed nav aside footer form button select textarea input dialog menu title xmp noembed noframes audio video canvas map datalist fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening one closes an open sibling of these kinds, up to the element that holds the list.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
            "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
            "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",))}
#: Words in class, id or role of elements beside the article.
BESIDE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside widget widgets complementary contentinfo cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended recommendations comment comments disqus respond replies reply pagination pager copyright skip toolbar".split())

#: Parts of names that say nothing of their own.
FILLERS = frozenset("box slot block unit section list thread wrap wrapper container area item items bar top bottom left right inner outer button buttons link links form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "label", "children", "beside", "main", "slot")

    def __init__(self, tag: str, label: str, beside: bool, main: bool):
        self.tag, self.label, self.children, self.beside, self.main, self.slot = tag, label, [], beside, main, -1


@lru_cache(maxsize=100_000)
def _element(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label of an element; whether it lies beside an article, if it stands outside one and if inside; whether it marks one."""
    names = {k.lower(): v.strip("\"' ").lower() for k, v in _NAMES.findall(attributes)} if attributes else {}
    gone = tag in DROPPED or bool(attributes and _HIDDEN.search(attributes))
    words = [{p for p in _PART.split(w) if p} for v in names.values() for w in v.split()]
    named = tag not in ("html", "body") and any(not BESIDE.isdisjoint(w) for w in words)
    only = named and any(not BESIDE.isdisjoint(w) and w <= BESIDE | FILLERS for w in words)
    main = (tag in ("article", "main") or names.get("role") in ("main", "article")) and not only
    shape = re.sub(r"\d+", "", names.get("class", ""))
    return f"{tag}.{shape}" if shape else tag, gone or named and not main, gone or only, main


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """Tree of block elements, and the blocks of text in page order: (node, text, characters inside links)."""
    root = Node("", "", False, False)
    stack, blocks, buffer, links = [root], [], [], 0
    in_link = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((stack[-1], text, links))
            buffer.clear()
        links = 0

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]

    def say(text: str) -> None:
        nonlocal links
        if not stack[-1].beside:
            text = entities.unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                links += len(text.strip())

    at, n = 0, len(page)
    last = page.rfind(">")  # no tag ends behind it
    while at < n:
        found = _TOKEN.search(page, at) if at <= last or "<!" in page[at:] or "<?" in page[at:] else None
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at:found.start()])
        at = found.end()
        ends, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            if found.group().startswith("<![CDATA["):
                say(found.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                in_link = 0 if ends else 1
            elif not ends and attributes and tag not in VOID and _element(tag, attributes)[2 if stack[-1].main else 1] and len(stack) < DEEPEST:
                # An inline element beside the article is kept apart like a block.
                close_to(len(stack))
                child = Node(tag, tag, True, False)
                stack[-1].children.append(child)
                stack.append(child)
            if ends and stack[-1].tag == tag:
                close_to(len(stack) - 1)
            continue
        if ends:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            else:
                flush()
            continue
        flush()
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in ("table", "td", "th", "button", "object"):
                    break
        elif tag in SIBLINGS:
            kinds, holders = SIBLINGS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in holders:
                    break
                if stack[depth].tag in kinds:
                    close_to(depth)
        if tag == "head" and any(s.tag == "body" for s in stack):
            continue
        if tag == "body" and stack[-1].tag == "head":
            close_to(len(stack) - 1)
        parent = stack[-1]
        label, outside, inside, main = _element(tag, attributes)
        beside = inside if parent.main else outside
        if tag == "header":
            beside = beside or not parent.main
        node = Node(tag, label, parent.beside or beside, parent.main or main)
        parent.children.append(node)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
            if tag not in DROPPED:
                say(page[at:end.start() if end else n])
            at = end.end() if end else n
            close_to(len(stack) - 1)
    flush()
    return root, blocks


def repeated(children: list) -> list[list]:
    """Neighbours of one label as one group."""
    out: list[list] = []
    for c in children:
        if out and out[-1][0].label == c.label:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def _run(task):
    """Result of a recursive generator that yields the calls it needs, without deep recursion."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def skeleton(node: Node) -> list[list]:
    """[label, place of the parent] of all elements in page order, repeated neighbours joined; an element's place is its slot."""
    out, work = [], [(node, -1)]
    while work:
        own, parent = work.pop()
        out.append([own.label, parent])
        work += [(g[0], len(out) - 1) for g in reversed(repeated(own.children))]
    return out


def tree_of(flat: list[list]) -> list:
    """[label, slot, children] of a skeleton."""
    nodes = [[label, slot, []] for slot, (label, _) in enumerate(flat)]
    for node, (_, parent) in zip(nodes, flat):
        if parent >= 0:
            nodes[parent][2].append(node)
    return nodes[0]


def match(a, b, kin) -> tuple[int, list]:
    """Simple tree matching of two trees: size of the best matching, and its pairs. ``kin``: label and child groups."""
    return _run(_match(a, b, kin))


def _match(a, b, kin):
    label, left = kin(a)
    if label != b[0]:
        return 0, []
    right = b[2]
    if not left or not right:
        return 1, [(a, b)]
    table_ = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    below = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if kin(x)[0] == y[0]:
                below[i, j] = yield _match(x, y, kin)
            gain = table_[i][j] + (below[i, j][0] if (i, j) in below else 0)
            table_[i + 1][j + 1] = max(table_[i][j + 1], table_[i + 1][j], gain)
    pairs, i, j = [(a, b)], len(left), len(right)
    while i and j:
        if table_[i][j] == table_[i - 1][j]:
            i -= 1
        elif table_[i][j] == table_[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += below[i, j][1]
    return 1 + table_[-1][-1], pairs


def give_slots(root: Node, reference: list) -> None:
    """Align a page with a reference skeleton: matched nodes get their slots; members of a repeated node share them."""
    kin = lambda group: (group[0].label, repeated(group[0].children))
    work = [([root], reference)]
    while work:
        group, tree = work.pop()
        for own, ref in match(group, tree, kin)[1]:
            for k, node in enumerate(own):
                node.slot = ref[1]
                if k and node.children and ref[2]:
                    work.append(([node], [node.label, ref[1], ref[2]]))


def blocks_of(page: str, reference: list | None) -> list[tuple[int, str]]:
    """(slot, text) of the blocks that may be content; slot -1 if nothing in the reference matches."""
    root, blocks = parse(page)
    blocks = [b for b in blocks if not b[0].beside]
    if any(node.main for node, _, _ in blocks):
        blocks = [b for b in blocks if b[0].main]
    else:
        blocks = [(node, text, links) for node, text, links in blocks if 10 * links <= 6 * len(text)]
    if reference:
        give_slots(root, reference)
    return [(node.slot, text) for node, text, _ in blocks]


def said_of(blocks: list[tuple[int, str]]) -> list[dict]:
    """Slots of one page, each with a hash of all its texts in page order."""
    texts: dict[int, list[str]] = {}
    for slot, text in blocks:
        if slot >= 0:
            texts.setdefault(slot, []).append(text)
    digest = lambda t: blake2b("\n".join(t).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return [{"slot": s, "h": int.from_bytes(digest(t), "little", signed=True)} for s, t in texts.items()]


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _layout(page: Column) -> Column:
    """The structural tags of a page, without numbers."""
    tags = F.regexp_extract_all(page, F.lit(r"<(?:nav|header|main|article|aside|footer|section|form|table|div)\b[^<>]*+>"), F.lit(0))
    return F.xxhash64(F.regexp_replace(F.array_join(F.array_sort(F.array_distinct(tags)), ""), r"[0-9]+", ""))


def candidate_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host, layout, page (hash of the html), blocks (slot, text): what may be content, aligned with the
    group's reference; said (slot, h): hashes of the slots' texts."""
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    rows = rows.select("*", _host(F.col("url")).alias("host"), _layout(F.col("html")).alias("layout"))

    def trees(batch: pa.RecordBatch) -> dict:
        return {"host": batch["host"], "layout": batch["layout"], "tree": [json.dumps(skeleton(parse(p)[0])) for p in batch["html"].to_pylist()]}

    leads = cut(rows.groupBy("host", "layout").agg(F.min("page_id").alias("page_id")).where("page_id IS NOT NULL"), "leads")
    found = map_batches(rows.join(leads, ["host", "layout", "page_id"]).select("host", "layout", "html"), trees, "host string, layout long, tree string")
    references = cut(found.groupBy("host", "layout").agg(F.min("tree").alias("tree")), "references")

    def align(batch: pa.RecordBatch) -> dict:
        reference = lru_cache(maxsize=64)(lambda t: tree_of(json.loads(t)))
        trees_ = batch["tree"].to_pylist()
        found = [blocks_of(p, reference(t) if t else None) for p, t in zip(batch["html"].to_pylist(), trees_)]
        return {c: batch[c] for c in ("page_id", "url", "host", "layout", "page")} | {
            "blocks": [[{"slot": s, "text": t} for s, t in f] for f in found], "said": [said_of(f) for f in found]}

    return map_batches(rows.join(references, ["host", "layout"], "left").select(
        "page_id", "url", "host", "layout", F.xxhash64("html").alias("page"), "html", "tree"), align,
                       "page_id long, url string, host string, layout long, page long, blocks array<struct<slot: int, text: string>>, said array<struct<slot: int, h: long>>")


def template_slots(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """(host, layout, template): slots of a group whose text is the same on all of at least ``least`` different pages."""
    page = blocks.select("host", "layout", "page", F.explode("said").alias("s"))
    # Numbers and the host only; copies of a page have equal hashes, so each page counts once.
    said = page.groupBy("host", "layout", "page", "s.slot").agg(F.min("s.h").alias("h"))
    slots = said.groupBy("host", "layout", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    constant = F.col("low") == F.col("high")
    return slots.groupBy("host", "layout").agg(
        F.collect_set(F.when(constant & (F.col("n") >= least), F.col("slot"))).alias("template"),
        F.max((~constant).cast("int")).alias("varies"),
    ).where("varies = 1 AND size(template) > 0").select("host", "layout", "template")


def main_text(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html)."""
    blocks = cut(candidate_blocks(pages), "blocks")
    template = cut(template_slots(blocks, least), "template")
    content = F.filter("blocks", lambda b: F.col("template").isNull() | ~F.array_contains("template", b["slot"]))
    text = F.array_join(F.transform(content, lambda b: b["text"]), " ")
    return blocks.join(template, ["host", "layout"], "left").select("page_id", "url", text.alias("text"))


@query("op3_wrapper_text")
def op3_wrapper_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
