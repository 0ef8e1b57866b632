"""Main text of web pages through inferred wrappers.

Method: union-free regular-expression inference. A page is a tree of groups:
boxes (``div``, ``nav``, ``article`` and the like), runs of prose blocks, lists of
links, bare texts. The pages of a host are aligned, iteratively, by the most
similar sequence of groups: neighbours of one kind become repeated groups, what
only some pages have becomes optional, and a text is a slot unless all pages of
the host agree on it. Wrappers of one outline are then pooled over hosts, so
that a host of one page is judged by the evidence of its likes.

The pooled wrapper decides. The article is the innermost box that holds most of
the variable, unlinked prose, without leaving prose or a headline beside it.
Everything outside goes; inside, link lists that belong to the template, boxes
of links and texts fixed on all pages go. Tag and class names only weigh a box
up or down. A page is read by aligning it with its wrapper, so a rule holds for
one place, not for all elements of a path.

Wrappers are merged within a task, within salted groups, then by host, and the
same way again by outline; merging keeps a wrapper small. A level with more
than ``WIDEST`` groups gives up the order of its groups (equal kinds become one
repeated group); pages are still read whole. A rule is a short string; hosts
with the commonest rule are not sent at all, the rest meet their pages in a join
whose side Spark broadcasts only below its size threshold.

Defined results: null or empty html gives an empty text; an unclosed tag ends
with its parent, an unclosed comment, script or style with the page; a page
that has no counterpart of its wrapper's article is read by its own groups
alone; a null url is a host of its own; repeated rows are read one by one;
nesting has no limit.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import Scratch, table

WIDEST = 64
WRAPPERS_HELD = 2000
SALTS = 32
LINKED = 0.7

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption br option".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button object canvas audio video".split())
LISTS = frozenset("ul ol dl table".split())
PROSE = LISTS | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure address".split())
PARTS = frozenset("li dt dd tr td th tbody thead tfoot caption figcaption summary hr br".split())
# Evidence only: these weigh a box down or up.
WEIGHED_DOWN = frozenset("nav aside form footer header menu dialog head fieldset".split())
WEIGHED_UP = frozenset("article main".split())
DOWN_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus share sharing social related newsletter subscribe subscription popup modal widget toolbar pagination pager skip login signup".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS_OPEN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TAG = re.compile(r"<(?:!--|[!?][^>]*>|/([a-zA-Z][^\s/>]*)[^>]*>|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>)")
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "names", "children", "boxed")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        self.tag, self.names, self.children, self.boxed = tag, names, [], False


def names_in(attributes: str) -> tuple[str, ...]:
    found = {w for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall((m[2] or m[3] or m[4] or "").lower())} if attributes else ()
    return tuple(sorted(found, key=lambda w: (w not in DOWN_NAMES, w))[:3])


def parse(text: str) -> Node:
    """A tree of block elements; texts are children as (text, in a link), a break of lines as None."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(text) + 10_000))
    root = Node("")
    stack, made, links, at = [root], [root], 0, 0
    open_tags: dict[str, int] = {}
    while True:
        m = TAG.search(text, at)
        if m is None:
            if at < len(text):
                stack[-1].children.append((text[at:], links > 0))
            break
        if m.start() > at:
            stack[-1].children.append((text[at : m.start()], links > 0))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS and open_tags.get(tag):
                while True:
                    gone = stack.pop()
                    open_tags[gone.tag] -= 1
                    if gone.tag == tag:
                        break
                links = 0
        elif m[2]:
            tag = m[2].lower()
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(text, at)
                    at = end.end() if end else len(text)
            elif tag == "br" or tag == "hr":
                stack[-1].children.append(None)
            elif tag == "a":
                links = 1
            elif tag in BLOCKS:
                if tag in CLOSES:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in KEEPS_OPEN[tag]:
                            break
                        if stack[k].tag in CLOSES[tag]:
                            for gone in stack[k:]:
                                open_tags[gone.tag] -= 1
                            del stack[k:]
                            break
                elif stack[-1].tag == "p":
                    stack.pop()
                    open_tags["p"] -= 1
                node = Node(tag, names_in(m[3]))
                stack[-1].children.append(node)
                stack.append(node)
                made.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        elif m[0] == "<!--":
            end = text.find("-->", at)
            at = end + 3 if end >= 0 else len(text)
    for node in reversed(made):
        only = node.children[0] if len(node.children) == 1 else None
        if isinstance(only, Node) and only.tag == node.tag and not (only.names and node.names):
            node.names, node.children = node.names or only.names, only.children  # a box around nothing but its like
        node.boxed = (node.tag not in PROSE and node.tag not in PARTS) or any(isinstance(c, Node) and (c.boxed or c.tag == "table") for c in node.children)
    return root


def blocks_of(items: list) -> list[tuple[str, int]]:
    """Texts between block boundaries, in page order, each with its characters inside links."""
    out: list[tuple[str, int]] = []
    run: list[tuple[str, bool]] = []
    stack = [iter(items)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, tuple):
                run.append(child)
                continue
            end_block(run, out)
            if child is not None:
                stack.append(iter(child.children))
                break
        else:
            end_block(run, out)
            stack.pop()
    return out


def end_block(run: list[tuple[str, bool]], out: list[tuple[str, int]]) -> None:
    if run:
        said = " ".join(entities.unescape("".join([t for t, _ in run])).split())
        if said:
            out.append((said, min(len(said), sum(len(t.strip()) for t, link in run if link))))
        run.clear()


# ---- groups


class Group:
    """Of pages: ``n`` with this group, ``count`` items, ``t`` characters, ``l`` of them in links, ``k`` the text they
    agree on, ``fixed`` and ``varied`` pages of hosts that agree or don't, ``h`` characters in h1, and the children of boxes."""

    __slots__ = ("kind", "tag", "names", "n", "count", "t", "l", "k", "fixed", "varied", "h", "children", "items", "label")

    def __init__(self, kind: str, tag: str = "", names: tuple[str, ...] = (), t: int = 0, l: int = 0, k: str | None = None, h: int = 0):  # noqa: E741
        self.kind, self.tag, self.names, self.t, self.l, self.k, self.h = kind, tag, names, t, l, k, h
        self.n = self.count = 1
        self.fixed = self.varied = 0
        self.children: list[Group] = []
        self.items: list = []
        self.label = ""

    def key(self) -> tuple:
        return (self.kind, self.tag, frozenset(c.kind + c.tag for c in self.children))


def hash_of(text: str) -> str:
    from xxhash import xxh64_hexdigest

    return xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def leaf(kind: str, items: list) -> Group | None:
    said = blocks_of(items)
    if not said:
        return None
    h = sum(len(b) for i in items if isinstance(i, Node) and i.tag == "h1" for b, _ in blocks_of([i]))
    g = Group(kind, t=sum(len(b) for b, _ in said), l=sum(n for _, n in said), k=hash_of("\n".join(b for b, _ in said)), h=h)
    g.items = [said]
    return g


def linked_pieces(node: Node) -> int:
    found, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                stack.append(c)
            elif c is not None and c[1] and c[0].strip():
                found += 1
    return found


def groups_of(node: Node) -> Group:
    box = Group("box", node.tag, node.names)
    out: list[Group] = []
    run: list = []

    def end_run() -> None:
        if run:
            g = leaf("flow" if any(isinstance(i, Node) for i in run) else "#", run)
            if g:
                out.append(g)
            run.clear()

    for child in node.children:
        if not isinstance(child, Node):
            run.append(child)
        elif child.boxed:
            end_run()
            g = groups_of(child)
            if g.children:
                out.append(g)
        else:
            links = child.tag in LISTS and linked_pieces(child) > 1 and leaf("links", [child])
            if links and links.l > LINKED * links.t:
                end_run()
                out.append(links)
            else:
                run.append(child)
    end_run()
    box.children = folded(out)
    box.t, box.l, box.h = (sum(getattr(c, f) for c in box.children) for f in "tlh")
    return box


def alike(a: Group, b: Group) -> float:
    """0 where two groups can't be one."""
    if a.kind != b.kind:
        return 0.5 if {a.kind, b.kind} == {"flow", "#"} else 0.0
    if a.kind != "box":
        return 1.0
    if a.tag != b.tag:
        return 0.0
    x, y = a.key()[2], b.key()[2]
    both = len(x & y) / len(x | y) if x or y else 1.0
    return 0.0 if not both else 1.0 + both + (0.5 if a.names == b.names and a.names else 0.0)


def folded(groups: list[Group]) -> list[Group]:
    """Neighbours of one kind become one repeated group. Two plain boxes of bare text without a name don't."""
    out: list[Group] = []
    for g in groups:
        last = out[-1] if out else None
        if last is not None and (last.kind == g.kind == "links" or (g.kind == "box" and last.names == g.names and alike(last, g) >= 1.5 and (g.names or [c.kind for c in g.children] != ["#"]))):
            out[-1] = merged(last, g, one_page=True)
        else:
            out.append(g)
    return out


def narrowed(groups: list[Group]) -> list[Group]:
    """Beyond ``WIDEST`` groups those of one kind become one, wherever they stand."""
    if len(groups) <= WIDEST:
        return groups
    by: dict[tuple, Group] = {}
    for g in groups:
        key = (g.kind, g.tag)
        by[key] = merged(by[key], g, one_page=True) if key in by else g
    return list(by.values())


def aligned(x: list[Group], y: list[Group]) -> list[tuple[Group | None, Group | None]]:
    """The most similar pairing that keeps the order of both."""
    if [g.key() for g in x] == [g.key() for g in y]:
        return list(zip(x, y))
    head = 0
    while head < min(len(x), len(y)) and x[head].key() == y[head].key():
        head += 1
    pairs, x, y = list(zip(x[:head], y[:head])), x[head:], y[head:]
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    score = [[alike(a, b) for b in y] for a in x]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + score[i][j] if score[i][j] else 0.0)
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and score[i][j] and best[i][j] == best[i + 1][j + 1] + score[i][j]:
            pairs.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            pairs.append((x[i], None))
            i += 1
        else:
            pairs.append((None, y[j]))
            j += 1
    return pairs


def merged(a: Group, b: Group, one_page: bool = False) -> Group:
    """The group of what both describe. A child that one of them lacks stays and is optional: it has fewer pages."""
    g = Group("flow" if a.kind != b.kind else a.kind, a.tag, a.names if a.names == b.names else tuple(w for w in a.names if w in b.names))
    g.n = max(a.n, b.n) if one_page else a.n + b.n
    g.count, g.t, g.l, g.h, g.fixed, g.varied = a.count + b.count, a.t + b.t, a.l + b.l, a.h + b.h, a.fixed + b.fixed, a.varied + b.varied
    g.k = a.k if a.k == b.k and not one_page else None
    if a.kind == "box":
        children = [p if q is None else q if p is None else merged(p, q, one_page) for p, q in aligned(a.children, b.children)]
        g.children = narrowed(children)
    if one_page:
        g.items = a.items + b.items if a.kind != "box" else (a.items or [a]) + (b.items or [b])
    return g


def settled(host: Group) -> None:
    """What a host says of each text, once all its pages are in: all alike, or not. One page says nothing."""
    stack = [host]
    while stack:
        g = stack.pop()
        if g.kind != "box" and g.n > 1:
            g.fixed, g.varied = (g.n, 0) if g.k is not None else (0, g.n)
        g.k = None
        stack += g.children


def packed(root: Group) -> str:
    """Flat, in order, with depths: nesting has no limit."""
    rows, stack = [], [(0, root)]
    while stack:
        depth, g = stack.pop()
        rows.append([depth, g.kind, g.tag, list(g.names), g.n, g.count, g.t, g.l, g.k, g.fixed, g.varied, g.h, g.label])
        stack += [(depth + 1, c) for c in reversed(g.children)]
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))


def unpacked(text: str) -> Group:
    path: list[Group] = []
    for depth, kind, tag, names, n, count, t, l, k, fixed, varied, h, label in json.loads(text):  # noqa: E741
        g = Group(kind, tag, tuple(names), t, l, k, h)
        g.n, g.count, g.fixed, g.varied, g.label = n, count, fixed, varied, label
        del path[depth:]
        if path:
            path[-1].children.append(g)
        path.append(g)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(text) + 10_000))
    return path[0]


def outline(g: Group) -> str:
    """The groups that at least half the pages have."""
    inner = [outline(c) for c in g.children if 2 * c.n >= g.n]
    return f"{g.kind[0]}{g.tag}({','.join(inner)})" if g.kind == "box" else g.kind[0]


# ---- which groups are the article


def is_fixed(g: Group) -> bool:
    if g.kind == "box":
        return bool(g.children) and all(is_fixed(c) for c in g.children)
    return g.fixed > 4 * g.varied


def weight(g: Group) -> float:
    if g.tag in WEIGHED_DOWN or any(n in DOWN_NAMES for n in g.names):
        return 0.25
    return 2.0 if g.tag in WEIGHED_UP else 1.0


def repeated_weight(g: Group) -> float:
    return weight(g) * (0.5 if g.count > g.n else 1.0)


def prose(g: Group, known: dict[int, float]) -> float:
    """Characters that may belong to an article; ``known`` has those of the groups seen before, by identity."""
    found = known.get(id(g))
    if found is None:
        if g.kind == "box":
            found = repeated_weight(g) * sum([prose(c, known) for c in g.children])
        else:
            found = 0.0 if g.kind == "links" or is_fixed(g) else max(0, g.t - g.l) * (1.0 if g.kind == "flow" else 0.5)
        known[id(g)] = found
    return found


def headline(g: Group) -> bool:
    if g.kind == "box":
        return weight(g) >= 1 and any(headline(c) for c in g.children)
    return g.h > 0 and not is_fixed(g)


def judged(root: Group) -> Group:
    """Sets the labels: ``into`` down to the article, which is ``here``, and keep or drop inside it."""
    w, known, outer = root, {}, 1.0
    least = 0.5 * sum(prose(c, known) for c in root.children)
    while True:
        boxes = [(prose(c, known), -i, c) for i, c in enumerate(w.children) if c.kind == "box"]
        value, _, best = max(boxes, default=(0, 0, None), key=lambda b: b[:2])
        if best is None or value <= 0 or w.tag in WEIGHED_UP or best.count > 1.5 * best.n:
            break
        if outer * value < least:
            break
        if any(c.kind == "flow" and not is_fixed(c) and c.l < LINKED * c.t and 2 * c.n >= w.n for c in w.children):
            break
        if any(c is not best and headline(c) for c in w.children):
            break
        w.label = "into"
        w = best
        outer *= repeated_weight(w)
    w.label = "here"
    label_inside(w, known)
    return root


def label_inside(w: Group, known: dict[int, float]) -> None:
    whole = sum(prose(c, known) for c in w.children)
    for c in w.children:
        if c.kind == "links":
            c.label = "drop" if 2 * c.n >= w.n else "keep"
        elif is_fixed(c) and not (c.h and c.kind == "flow"):
            c.label = "drop"
        elif c.kind != "box":
            c.label = "keep"
        elif c.l > LINKED * c.t or (weight(c) < 1 and not (c.tag == "header" and c.h) and prose(c, known) < 0.5 * whole):
            c.label = "drop"
        else:
            c.label = "keep"
            label_inside(c, known)


def rule_of(wrapper: Group) -> str:
    """The judged wrapper, without sizes and without the insides of what is not read."""
    judged(wrapper)
    stack = [wrapper]
    while stack:
        g = stack.pop()
        g.n, g.count, g.t, g.l, g.h, g.fixed, g.varied, g.k = 1, 1, 0, 0, 0, 0, 0, None
        if g.label in ("", "drop"):
            for c in g.children:
                c.children = []
        stack += g.children
    return packed(wrapper)


def written(page: Group, template: Group, out: list[str]) -> None:
    """The texts of the groups of ``page`` that ``template`` keeps, in order. A group without counterpart takes the
    label of the group most like it, or is judged by itself."""
    for p, t in aligned(page.children, template.children):
        if p is None:
            continue
        if t is None:
            t = max((c for c in template.children if alike(p, c) >= 1), key=lambda c: alike(p, c), default=None)
        if t is not None:
            if t.label != "drop" and p.kind == t.kind == "box":
                for one in p.items or [p]:
                    written(one, t, out)
            elif t.label != "drop":
                written_whole(p, out)
        elif p.kind != "links" and p.l <= LINKED * p.t and weight(p) >= 1:
            written_whole(p, out)


def written_whole(g: Group, out: list[str]) -> None:
    if g.kind != "box":
        out += [b for said in g.items for b, _ in said]
    else:
        for c in g.items or g.children:
            written_whole(c, out)


def main_text(page: str | None, rule: Group | str | None) -> str:
    """The article of a page by ``rule``; without one, or where the page has no counterpart, by the page's own groups."""
    if not page:
        return ""
    tree = groups_of(parse(page))
    out: list[str] = []
    if rule:
        p, w = tree, unpacked(rule) if isinstance(rule, str) else rule
        while p is not None and w.label == "into":
            to = next(c for c in w.children if c.label in ("into", "here"))
            p, w = next((a for a, b in aligned(p.children, w.children) if b is to), None), to
            if p is not None and p.items:
                p = None
        if p is not None:
            written(p, w, out)
    if not out:
        w = judged(tree)
        while w.label == "into":
            w = next(c for c in w.children if c.label in ("into", "here"))
        written(w, w, out)
    return " ".join(out)


# ---- Spark


def host_column(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def pooled(parts: DataFrame, key: str) -> DataFrame:
    """One wrapper per value of ``key`` from ``parts`` (key, wrapper): merged by salted groups, then by key."""

    def all_of(group: pd.DataFrame) -> pd.DataFrame:
        found = None
        for text in sorted(group["wrapper"]):
            g = unpacked(text)
            found = g if found is None else merged(found, g)
        return pd.DataFrame({key: [group[key].iloc[0]], "wrapper": [packed(found)]})

    schema = f"{key} string, wrapper string"
    parts = parts.groupBy(key, F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).applyInPandas(all_of, schema)
    return parts.groupBy(key).applyInPandas(all_of, schema)


def held_by(key: str, wrappers: Iterator[tuple[str, Group]]) -> Iterator[pd.DataFrame]:
    """Merges what one task sees of each key."""
    held: dict[str, Group] = {}
    out = lambda: pd.DataFrame({key: list(held), "wrapper": [packed(g) for g in held.values()]})
    for name, g in wrappers:
        held[name] = merged(held[name], g) if name in held else g
        if len(held) > WRAPPERS_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, outline, wrapper) from all pages (host, html)."""

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages_of = ((host, groups_of(parse(page))) for batch in batches for host, page in zip(batch["host"], batch["html"]) if page)
        yield from held_by("host", ((host, bare(g)) for host, g in pages_of))

    def outlined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, text in zip(batch["host"], batch["wrapper"]):
                g = unpacked(text)
                settled(g)
                rows.append((host, hash_of(outline(g)), packed(g)))
            yield pd.DataFrame(rows, columns=["host", "outline", "wrapper"])

    parts = pages.select("host", "html").mapInPandas(per_task, "host string, wrapper string")
    return pooled(parts, "host").mapInPandas(outlined, "host string, outline string, wrapper string")


def bare(root: Group) -> Group:
    """Without the texts, which only reading needs."""
    stack = [root]
    while stack:
        g = stack.pop()
        g.items = []
        g.children = narrowed(g.children)
        stack += g.children
    return root


def outline_rules(hosts: DataFrame) -> DataFrame:
    """(outline, rule) from the wrappers of all hosts."""

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from held_by("outline", ((o, unpacked(w)) for batch in batches for o, w in zip(batch["outline"], batch["wrapper"])))

    def ruled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"outline": batch["outline"], "rule": [rule_of(unpacked(w)) for w in batch["wrapper"]]})

    parts = hosts.select("outline", "wrapper").mapInPandas(per_task, "outline string, wrapper string")
    return pooled(parts, "outline").mapInPandas(ruled, "outline string, rule string")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html)."""
    scratch = Scratch(spark, "html")
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_column().alias("host"))
    hosts = scratch.keep(host_wrappers(hosted), "wrappers")
    rules = outline_rules(hosts)
    rules = scratch.keep(hosts.select("host", "outline").join(rules, "outline").select("host", "rule"), "rules")
    common = rules.groupBy("rule").count().orderBy(F.desc("count"), "rule").limit(1).collect()
    usual = common[0]["rule"] if common else None
    others = scratch.keep(rules.where(F.col("rule") != usual) if usual else rules, "other-rules")

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Group] = {}
        for html, rule in batches:
            out = []
            for h, r in zip(html, rule):
                if r and r not in known:
                    if len(known) > WRAPPERS_HELD:
                        known.clear()
                    known[r] = unpacked(r)
                out.append(main_text(h, known[r] if r else None))
            yield pd.Series(out, dtype=object)

    read = hosted.join(others, "host", "left")
    return read.select("page_id", "url", text_of("html", F.coalesce("rule", F.lit(usual))).alias("text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark, table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
