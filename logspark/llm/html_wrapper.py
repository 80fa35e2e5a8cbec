"""Main text of web pages by wrapper induction over pages of the same host.

1. Every page is parsed to a tree of its block elements; neighbouring siblings of the same kind without blocks inside are one
   repeated node. Pages of a host whose trees have the same outline two levels below the body form a group; the least page of a group
   (by a hash of its texts) is its reference.
2. Each page is aligned with its reference by simple tree matching (equal labels, order of siblings kept, most nodes matched). For every
   node of the reference, the texts that pages have there are counted over all distinct pages of the group.
3. A node that has the same text on nearly all pages is template; nodes with varying text are content. Of the content, menus, headers, footers,
   sidebars, notices, adverts, forms and reader comments are left out by element, role and class. Where a page marks an article or main element, what lies
   outside it is left out, and text inside it stays though other pages have it too.

Groups' references and template nodes are sent to all tasks if they are few (``BROADCAST_GROUPS``), and joined by group beyond that.

Defined results: null and empty html give the empty text. A null url is a host of its own. Pages without enough distinct companions have no
template nodes. Exact copies of a page count once as evidence of a template. Repeated rows are extracted one by one. An empty table
gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import map_batches, save_and_read

BROADCAST_GROUPS = 20_000
#: A node is template if that share of at least so many distinct pages has the same text there.
CONSTANT, COMPANIONS = 0.8, 5
#: Elements nested deeper are taken as inline.
DEPTH = 150

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option button object math canvas video audio".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open paragraph, or an open element of its own kind.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPES = frozenset("ul ol dl table body html article section div".split())
APART = frozenset("nav footer aside form menu dialog search".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
APART_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "banner cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay share sharing social related recommended "
    "comment comments respond reply replies disqus login signup toolbar pagination pager masthead copyright skip".split()
)
MAIN_WORDS = ("article", "main")

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "name", "role", "hidden", "parts", "texts")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.name, self.role, self.hidden = tag, "", "", False
        self.parts: list = []  # nodes and texts in order
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key in ("class", "id"):
                    self.name += " " + value
                elif key == "role":
                    self.role = value
                elif key == "hidden" or "display:none" in value.replace(" ", ""):
                    self.hidden = True

    def label(self) -> str:
        return self.tag + re.sub(r"[\d\s]+", " ", self.name).rstrip()

    def apart(self, in_main: bool) -> bool:
        if self.hidden or self.tag in APART or self.role in APART_ROLES or (self.tag == "header" and not in_main):
            return True
        if not self.name or self.tag in ("body", "html"):
            return False
        found = set(re.split(r"[^a-z]+", self.name))
        return bool(found & APART_WORDS) or ("header" in found and not in_main)


def parse(page: str) -> Node:
    """The tree of a page; inline elements leave only their text."""
    root = Node("html")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            if tag in BLOCKS and tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].parts.append(Node("p"))
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else (end if tag in ("script", "style") else at)
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag != "hr" else Node("hr"))
            continue
        if tag not in BLOCKS or len(stack) >= DEPTH:
            continue  # inline: its text belongs to the block around it
        if tag in ("html", "body"):
            if tag == "body" and not any(x.tag == "body" for x in stack):
                body = Node("body", attributes)
                root.parts.append(body)
                stack = [root, body]
            continue
        ended = ENDS.get(tag, {"p"} if tag in BLOCKS else set())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ended:
                del stack[k:]
                break
            if stack[k].tag in SCOPES:
                break
        node = Node(tag, attributes)
        stack[-1].parts.append(node)
        stack.append(node)
    return root


def clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def children(node: Node) -> list[list[Node]]:
    """Child elements; neighbours of one label without blocks inside are taken together."""
    out: list[list[Node]] = []
    for x in node.parts:
        if isinstance(x, Node):
            leaf = not any(isinstance(y, Node) for y in x.parts)
            if out and leaf and out[-1][0].label() == x.label() and not any(isinstance(y, Node) for y in out[-1][0].parts):
                out[-1].append(x)
            else:
                out.append([x])
    return out


def outline(group: list[Node], where: dict[int, int] | None = None, count: list[int] | None = None) -> list:
    """``[label, digest of own texts, children]``; ``where`` gets the preorder number of each element by its identity."""
    count = count if count is not None else [0]
    number = count[0]
    count[0] += 1
    for x in group:
        if where is not None:
            where[id(x)] = number
    own = "\n".join(clean([y if isinstance(y, str) else " " for y in x.parts]) for x in group)
    return [group[0].label(), xxhash.xxh64_intdigest(own) >> 12 if own.strip() else 0, [outline(g, where, count) for g in children(group[0])]]


def same_shape(a: list, b: list) -> bool:
    return a[0] == b[0] and len(a[2]) == len(b[2]) and all(same_shape(x, y) for x, y in zip(a[2], b[2], strict=True))


def size(tree: list) -> int:
    return 1 + sum(size(c) for c in tree[2])


def match(a: list, b: list, i: int = 0, j: int = 0) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most nodes of two trees that can be matched, and their preorder numbers."""
    if a[0] != b[0]:
        return 0, []
    rows, columns = [i + 1], [j + 1]
    for c in a[2]:
        rows.append(rows[-1] + size(c))
    for c in b[2]:
        columns.append(columns[-1] + size(c))
    # Children of one shape at both beginnings, and at both ends, match each other in some best matching; only those between are compared.
    head, m, n = 0, len(a[2]), len(b[2])
    while head < min(m, n) and same_shape(a[2][head], b[2][head]):
        head += 1
    while min(m, n) > head and same_shape(a[2][m - 1], b[2][n - 1]):
        m, n = m - 1, n - 1
    found = [(i, j)]
    equal = [(k, k) for k in range(head)] + [(m + k, n + k) for k in range(len(a[2]) - m)]
    for x, y in equal:
        found += [(rows[x] + k, columns[y] + k) for k in range(rows[x + 1] - rows[x])]
    best = [[0] * (n - head + 1) for _ in range(m - head + 1)]
    pairs: dict[tuple[int, int], list] = {}
    for x in range(m - head):
        for y in range(n - head):
            count, inner = match(a[2][head + x], b[2][head + y], rows[head + x], columns[head + y])
            if count:
                pairs[x, y] = inner
            best[x + 1][y + 1] = max(best[x][y + 1], best[x + 1][y], best[x][y] + count)
    total, x, y = len(found) + best[m - head][n - head], m - head, n - head
    while x and y:
        if best[x][y] == best[x - 1][y]:
            x -= 1
        elif best[x][y] == best[x][y - 1]:
            y -= 1
        else:
            x, y = x - 1, y - 1
            found += pairs[x, y]
    return total, found


def aligned(tree: list, reference: list) -> dict[int, int]:
    """Preorder numbers of the reference for those of a tree."""
    if same_shape(tree, reference):
        return {k: k for k in range(size(tree))}
    return dict(match(tree, reference)[1])


def digests(tree: list) -> Iterator[int]:
    yield tree[1]
    for c in tree[2]:
        yield from digests(c)


def extract(root: Node, template: set[int], where: dict[int, int]) -> str:
    """The main text: content blocks in page order."""
    mains: list[Node] = []

    def find(node: Node, tag: str) -> None:
        for x in node.parts:
            if isinstance(x, Node) and not x.apart(False):
                if x.tag == tag or (tag == "main" and x.role == "main"):
                    mains.append(x)
                else:
                    find(x, tag)

    for tag in MAIN_WORDS:
        find(root, tag)
        if mains:
            break
    blocks: list[str] = []

    def walk(node: Node, in_main: bool) -> None:
        own: list[str] = []
        constant = not in_main and where.get(id(node)) in template  # a marked article keeps all its text

        def flush() -> None:
            text = clean(own)
            own.clear()
            if text and not constant:
                blocks.append(text)

        for x in node.parts:
            if isinstance(x, str):
                own.append(x)
            else:
                flush()
                if not x.apart(in_main):
                    walk(x, in_main)
        flush()

    for x in mains or [root]:
        walk(x, bool(mains))
    return "\n\n".join(blocks)


def host(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def group_of(url: str | None, tree: list) -> int:
    shape = [tree[0], [[c[0], [g[0] for g in c[2]]] for c in tree[2]]]
    return xxhash.xxh64_intdigest(json.dumps([host(url), shape])) >> 1


def outlines(pages: DataFrame) -> DataFrame:
    """``grp, page, tree`` of every row of ``pages`` (``url, html``): its group, a hash of its texts, and its outline as JSON."""

    def run(batch: pa.RecordBatch):
        groups, marks, trees = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree = outline([parse(page or "")])
            groups.append(group_of(url, tree))
            marks.append(xxhash.xxh64_intdigest(json.dumps(list(digests(tree)))) >> 1)
            trees.append(json.dumps(tree, ensure_ascii=False))
        yield {"grp": groups, "page": marks, "tree": trees}

    return map_batches(pages.select("url", "html"), "grp long, page long, tree string", run)


def wrappers(pages: DataFrame, constant: float = CONSTANT, companions: int = COMPANIONS) -> DataFrame:
    """``grp, reference, template``: the reference outline of each group that has template nodes, and their numbers."""
    seen = save_and_read(outlines(pages).dropDuplicates(["grp", "page"]), "html-outlines")
    reference = seen.groupBy("grp").agg(F.min_by("tree", "page").alias("reference"), F.count("*").alias("pages")).where(F.col("pages") >= companions)
    both = seen.join(reference, "grp").select("grp", "tree", "reference")

    def slots(batch: pa.RecordBatch):
        out: tuple[list, list, list] = ([], [], [])
        for grp, tree, ref in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            tree = json.loads(tree)
            at = aligned(tree, json.loads(ref))
            for number, digest in enumerate(digests(tree)):
                if digest and number in at:
                    for values, x in zip(out, (grp, at[number], digest), strict=True):
                        values.append(x)
        yield {"grp": out[0], "slot": out[1], "digest": out[2]}

    texts = map_batches(both, "grp long, slot int, digest long", slots).groupBy("grp", "slot", "digest").agg(F.count("*").alias("n"))
    slot = texts.groupBy("grp", "slot").agg(F.max("n").alias("most"))
    fixed = slot.join(reference.select("grp", "pages"), "grp").where(F.col("most") >= constant * F.col("pages"))
    return fixed.groupBy("grp").agg(F.sort_array(F.collect_list("slot")).alias("template")).join(reference, "grp").select("grp", "reference", "template")


def main_texts(pages: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``page_id, url, text, n_chars, n_template`` for every row of ``pages`` (``page_id, url, html``)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    induced = save_and_read(wrappers(rows), "html-wrappers")
    few = induced.count() <= broadcast_groups
    known = {r["grp"]: (json.loads(r["reference"]), set(r["template"])) for r in induced.collect()} if few else {}
    sent = pages.sparkSession.sparkContext.broadcast(known)
    schema = "page_id long, url string, text string, n_chars long, n_template int"

    def one(url: str | None, page: str | None, wrapper) -> tuple[str, int]:
        if not page:
            return "", 0
        root, where = parse(page), {}
        tree = outline([root], where)
        found = wrapper(url, tree)
        if not found:
            return extract(root, set(), where), 0
        at = aligned(tree, found[0])
        template = {number for number, ref in at.items() if ref in found[1]}
        return extract(root, template, where), len(template)

    def run(batch: pa.RecordBatch):
        given = list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names[1:]), strict=True))
        if few:
            out = [one(url, page, lambda u, t: sent.value.get(group_of(u, t))) for url, page in given]
        else:
            out = [one(url, page, lambda u, t, r=r, s=s: (json.loads(r), set(s)) if r else None) for url, page, r, s in given]
        text = [t for t, _ in out]
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": text, "n_chars": list(map(len, text)), "n_template": [n for _, n in out]}

    if few:
        return map_batches(rows, schema, run)

    def locate(batch: pa.RecordBatch):
        urls, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        groups = [group_of(u, outline([parse(p or "")])) for u, p in zip(urls, texts, strict=True)]
        yield {"page_id": batch.column(0), "url": batch.column(1), "html": batch.column(2), "grp": groups}

    placed = map_batches(rows, "page_id long, url string, html string, grp long", locate)
    return map_batches(placed.join(induced, "grp", "left").select("page_id", "url", "html", "reference", "template"), schema, run)
