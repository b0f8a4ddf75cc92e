"""Main text of web pages by union-free regular expressions that are inferred for each host.

A page becomes a stream of block tags and texts, read as a tree. Tandem repeats of siblings fold into repeated groups. The trees of
one host are aligned one after another: what only some have becomes optional, what one has once and another many times
becomes a repeated group, texts become slots. The result is the host's wrapper: tags, text slots, (...)+ and (...)?. A slot
remembers on how many pages it stands, how much text it holds, how much of that in links, and whether its text is the same everywhere.

The wrapper decides what is main text. A slot with one and the same text on ``SAME`` pages or more is template. Elements that
their tag or name tells to be menus, headers, footers, sidebars, notices, adverts, forms or comments are left out, unless hardly
any other prose that varies is left, as with a body in class "related-work": then the heaviest of them counts as plain. Of the rest the
wrapper's content is the element, sought from the top, that holds most of the varying text, with headings of the first level before it. Inside it,
the slots decide on a single element whose name is a compound of a word such as menu, share or widget: it stays if at least half of its characters are prose that varies. Every
page is then matched against its host's wrapper, and the texts in content slots are its main text, in page order.

Pages of a host are aligned where they are read, and the wrappers of a host's parts are aligned in groups of at most about ``FAN``, level
by level, so that no task gets a host as a whole. Equal texts are one text; the order of alignment can move optional parts, not texts.

Null html, and html without text, gives empty text. A null or odd URL belongs to the host "". A page that its host's wrapper finds no content in
is treated as a host of its own. Repeated rows stay, ties go to the earlier element, an empty table gives an empty one. Very long pages are read
whole, in time that grows with their length; elements nested deeper than ``DEPTH`` count as part of the one there, their text stays. Only key, url and
html are read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import keyed, written

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table", "tbody", "thead", "div", "section", "article", "main", "body", "blockquote")
OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "fieldset", "datalist", "label"} | RAW
OUTSIDE_NAME = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|advertisement|banner|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widgets?|cookies?|notices?|consent|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|commentlist|replies|disqus|form|login|toolbar)(?:[-_\s\d]|$)", re.I)
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "address", "summary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Characters a page from which a slot counts as prose.
PROSE = 80
#: Depth of trees.
DEPTH = 100
#: Pages on which a slot has the same text, for it to be template.
SAME = 4
#: Wrappers that are aligned in one group.
FAN = 64
#: Words of ``OUTSIDE_NAME`` for elements that do something: a compound of one of them ("menu-ideas") may also name a part of the text.
FUNCTION = re.compile(r"nav|navbar|navigation|menu\w*|toolbar|widgets?|share|sharing|social|form|login|side", re.I)


def label(tag: str, attributes: str) -> str:
    """The tag with its class, id and role, digits left out."""
    named = " ".join(m[2].strip("\"'") for m in NAMED.finditer(attributes)) if attributes and "=" in attributes else ""
    return f"{tag}.{re.sub(r'[0-9]+', 'N', ' '.join(named.split()))}" if named else tag


def outside(name: str) -> bool:
    tag, _, named = name.partition(".")
    return tag in OUTSIDE or bool(named and OUTSIDE_NAME.search(named))


def compound(name: str) -> bool:
    """Whether an element is to be left out only for compounds of ``FUNCTION`` words with words that tell nothing."""
    tag, _, named = name.partition(".")
    told = [re.split("[-_]", w) for w in named.split() if OUTSIDE_NAME.search(w)]
    plain = lambda part: FUNCTION.fullmatch(part) or not OUTSIDE_NAME.search(part)
    return tag not in OUTSIDE and all(all(map(plain, parts)) and not all(map(FUNCTION.fullmatch, parts)) for parts in told)


# A node is [name, children, many, optional, texts]; the name is an element's label, "#" for text, "()" for a group of siblings. In a page, the
# texts of a slot are a tuple of (place, hash, characters, characters in links); in a wrapper, a list: pages, the text's hash (0 if it
# varies), characters, characters in links.


def parse(html: str) -> tuple[list[list], list[str]]:
    """The page's folded tree, and its text blocks in page order."""
    top: list = ["", [], 0, 0, ()]
    stack: list[tuple[str, list]] = [("", top)]
    open_tags: Counter = Counter()
    texts: list[str] = []
    parts: list[str] = []
    at, linked, in_link, last = 0, 0, False, html.rfind(">")

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            stack[min(len(stack), DEPTH) - 1][1][1].append(["#", [], 0, 0, ((len(texts), xxhash.xxh64_intdigest(text) | 1, len(text), min(linked, len(text))),)])
            texts.append(text)
        linked = 0

    def close(k: int) -> None:
        flush()
        while len(stack) > k:
            tag, node = stack.pop()
            open_tags[tag] -= 1
            node[1] = fold(node[1])

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        linked += len(text) if in_link else 0

    while True:
        m = TOKEN.search(html, at) if at <= last else None
        if not m:
            cut = html.find("<!--", at)
            add(html[at : cut if cut >= 0 else len(html)])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            in_link = not ending if tag == "a" else in_link
            continue
        if tag in VOID:
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if ending:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            else:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if tag in ("textarea", "iframe", "noscript"):
                parts.append(" ")
            continue
        flush()
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        if any(open_tags[x] for x in CLOSES.get(tag, ())):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                elif stack[k][0] in SCOPES:
                    break
        node: list = [label(tag, attributes), [], 0, 0, ()]
        if len(stack) < DEPTH:
            stack[-1][1][1].append(node)
        stack.append((tag, node))
        open_tags[tag] += 1
        if attributes.endswith("/"):
            close(len(stack) - 1)
    close(1)
    return fold(top[1]), texts


def merge(a: list, b: list) -> list:
    """One node for two of the same name."""
    if isinstance(a[4], tuple):
        texts: tuple | list = a[4] + b[4]
    else:
        texts = [a[4][0] + b[4][0], a[4][1] if a[4][1] == b[4][1] else 0, a[4][2] + b[4][2], a[4][3] + b[4][3]]
    return [a[0], align(a[1], b[1]), a[2] | b[2], a[3] | b[3], texts]


def tandem(names: list[str], size: int) -> list[tuple[int, int]]:
    """(start, times) of runs in which ``size`` names come again at once, from the left."""
    same = np.array([x == y for x, y in zip(names, names[size:])], bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return [(int(i), int(j - i) // size + 1) for i, j in zip(edges[::2], edges[1::2]) if j - i >= size]


def fold(nodes: list[list]) -> list[list]:
    """Neighbours of one name become a repeated node, tandem repeats of several a repeated group."""
    out: list[list] = []
    for n in nodes:
        if out and out[-1][0] == n[0]:
            out[-1] = merge(out[-1], n)
            out[-1][2] = int(n[0] != "#")
        else:
            out.append(n)
    done = 1
    while True:  # group sizes at which some name comes again, the smallest first
        names, seen, sizes = [n[0] for n in out], {}, set()
        for i, n in enumerate(names):
            if n in seen and i - seen[n] > done:
                sizes.add(i - seen[n])
            seen[n] = i
        size = min(sizes, default=0)
        if not size:
            return out
        folded, at = [], 0
        for i, times in tandem(names, size):
            if i < at:
                continue
            unit = out[i : i + size]
            for r in range(1, times):
                unit = align(unit, out[i + r * size : i + (r + 1) * size])
            folded += [*out[at:i], ["()", unit, 1, 0, ()]]
            at = i + times * size
        out, done = folded + out[at:], size


def regroup(nodes: list[list], other: list[list]) -> list[list]:
    """Where a group of the other side stands once here, make it a group."""
    for unit in (n[1] for n in other if n[0] == "()"):
        want, out, i = [n[0] for n in unit], [], 0
        while i < len(nodes):
            if nodes[i][0] == want[0] and [n[0] for n in nodes[i : i + len(want)]] == want:
                out.append(["()", nodes[i : i + len(want)], 0, 0, ()])
                i += len(want)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def common_rows(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every prefix of ``b``; one bit of a whole number a place of ``b``."""
    at: dict[str, int] = {}
    for j, name in enumerate(b):
        at[name] = at.get(name, 0) | 1 << j
    v = every_place = (1 << len(b)) - 1
    for name in a:
        u = v & at.get(name, 0)
        v = (v + u | v - u) & every_place
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits, dtype=np.int64)])


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, found by halving ``a``: memory grows with the lists, not with their product."""
    out, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        i, j, k, m = parts.pop()
        if i == j or k == m:
            continue
        if j == i + 1 or m == k + 1:
            one = next(((x, y) for x in range(i, j) for y in range(k, m) if a[x] == b[y]), None)
            out += [one] if one else []
            continue
        mid = (i + j) // 2
        cut = k + int((common_rows(a[i:mid], b[k:m]) + common_rows(a[mid:j][::-1], b[k:m][::-1])[::-1]).argmax())
        parts += [(i, mid, k, cut), (mid, j, cut, m)]
    return sorted(out)


def matched(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Places of equal names in two lists, as many as both can have in order, and between them the places that only one has."""
    if a == b:
        yield from zip(range(len(a)), range(len(b)))
        return
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - head) if a[-1 - i] != b[-1 - i]), most - head)
    names = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x, y = ([i for i in range(head, len(n) - tail) if n[i] in names] for n in (a, b))
    between = [(x[i], y[j]) for i, j in common([a[i] for i in x], [b[j] for j in y])] if names else []
    k = m = 0
    for i, j in [*zip(range(head), range(head)), *between, *((len(a) - t, len(b) - t) for t in range(tail, -1, -1))]:
        yield from ((q, None) for q in range(k, i))
        yield from ((None, q) for q in range(m, j))
        if i < len(a):
            yield i, j
        k, m = i + 1, j + 1


def align(a: list[list], b: list[list]) -> list[list]:
    """Two lists of siblings become one: nodes that only one of them has are optional."""
    a, b = regroup(a, b), regroup(b, a)
    optional = lambda n: [n[0], n[1], n[2], 1, n[4]]
    return [optional(a[i]) if j is None else optional(b[j]) if i is None else merge(a[i], b[j]) for i, j in matched([n[0] for n in a], [n[0] for n in b])]


def as_wrapper(nodes: list[list]) -> list[list]:
    """A page's tree as the wrapper of that page alone."""
    stats = lambda t: [1, t[0][1] if len(t) == 1 else 0, sum(x[2] for x in t), sum(x[3] for x in t)] if t else [0, 0, 0, 0]
    return [[name, as_wrapper(kids), many, optional, stats(texts)] for name, kids, many, optional, texts in nodes]


def printed(nodes: list[list]) -> str:
    """The wrapper as a regular expression over tags and text slots (#)."""
    out = []
    for name, kids, many, optional, _ in nodes:
        text = "#" if name == "#" else printed(kids) if name == "()" else f"<{name}>{printed(kids)}</{name}>"
        text = f"({text})+" if many else text
        out.append((text[:-1] + "*" if many else f"({text})?") if optional else text)
    return "".join(out)


def weight(node: list, plain: set[int] | None = None) -> int:
    """Characters outside links in a node's slots that are no template; with ``plain``, without elements that are to be left out, but for those."""
    name, kids, _, _, (pages, same, chars, links) = node
    if name == "#":
        return 0 if same and pages >= SAME else max(chars - links, 0)
    if plain is not None and id(node) not in plain and outside(name):
        return 0
    return sum(weight(k, plain) for k in kids)


def prose(node: list, plain: set[int] | None = None) -> int:
    """As ``weight``, of slots alone that hold ``PROSE`` characters a page or more and are no headings."""
    name, kids, _, _, (pages, _, chars, _) = node
    if name == "#":
        return weight(node) if chars >= PROSE * pages else 0
    if name.split(".")[0] in HEADINGS or plain is not None and id(node) not in plain and outside(name):
        return 0
    return sum(prose(k, plain) for k in kids)


def held(node: list) -> int:
    """Characters in a node's slots."""
    return node[4][2] + sum(map(held, node[1]))


def every(nodes: list[list]) -> Iterator[list]:
    for n in nodes:
        yield n
        yield from every(n[1])


def content(wrapper: list[list]) -> None:
    """Mark the content in a wrapper: an element's ``optional`` becomes 2 where its texts are content, and so does a content slot's."""
    total, plain = sum(map(prose, wrapper)), set()
    while total and sum(prose(n, plain) for n in wrapper) < 0.05 * total:
        # Nearly all that varies stands under names that are to be left out: the heaviest of them, from the top, counts as plain.
        covered = [n for n in reached(wrapper, plain) if outside(n[0]) and id(n) not in plain and prose(n)]
        if not covered:
            break
        plain.add(id(max(covered, key=prose)))
    here, heads = wrapper, []
    while True:
        inside = [(weight(n, plain), n) for n in here]
        most = sum(w for w, _ in inside)
        heavy = next((n for w, n in inside if most and w >= 0.6 * most), None)
        if heavy is None or heavy[2] or heavy[0] == "#" or heavy[0].split(".")[0] in LEAF:
            break
        heads += [n for n in here[: here.index(heavy)] if n[0].split(".")[0] == "h1"]
        here = heavy[1]
        if heavy[0].split(".")[0] in ("article", "main") and not any(n[0].split(".")[0] == "article" for n in every(here)):
            break

    def mark(nodes: list[list]) -> None:
        for n in nodes:
            if n[0] == "#":
                n[3] = n[3] if n[4][1] and n[4][0] >= SAME else 2
            elif id(n) in plain or not outside(n[0]) or compound(n[0]) and not n[2] and 2 * prose(n) >= held(n) > 0:
                n[3] = 2
                mark(n[1])

    mark(heads)
    mark(here)


def reached(nodes: list[list], plain: set[int]) -> Iterator[list]:
    """Nodes under which nothing above is left out."""
    for n in nodes:
        yield n
        if id(n) in plain or not outside(n[0]):
            yield from reached(n[1], plain)


def all_texts(nodes: list[list]) -> Iterator[int]:
    return (t[0] for n in every(nodes) for t in n[4])


def chosen(page: list[list], wrapper: list[list], inside: bool = False) -> Iterator[int]:
    """Places of a page's texts that lie in content slots of the wrapper that it is matched against."""
    page = regroup(page, wrapper)
    rest, unmatched = [], set()
    for i, j in matched([n[0] for n in page], [n[0] for n in wrapper]):
        if j is None:
            rest.append(i)
        elif i is None:
            unmatched.add(j)
        else:
            yield from taken(page[i], wrapper[j])
    for i in rest:  # out of the wrapper's order, or only on this page
        j = next((j for j in sorted(unmatched) if wrapper[j][0] == page[i][0]), None)
        if j is not None:
            yield from taken(page[i], wrapper[j])
        elif inside:
            yield from (t for n in reached([page[i]], set()) for t in (x[0] for x in n[4]))


def taken(node: list, other: list) -> Iterator[int]:
    if node[0] == "#":
        yield from (t[0] for t in node[4]) if other[3] == 2 else ()
    else:
        yield from chosen(node[1], other[1], other[3] == 2)


def main_text(html: str, wrapper: list[list] | None) -> str:
    page, texts = parse(html)
    found = sorted(chosen(page, wrapper)) if wrapper else []
    if not found:
        own = as_wrapper(page)
        content(own)
        found = sorted(chosen(page, own))
    return "\n".join(texts[i] for i in found)


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper as JSON with its content marked, regex): one row a host."""

    def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wrappers: dict[str, list] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tree = as_wrapper(parse(page or "")[0])
                wrappers[host] = align(wrappers[host], tree) if host in wrappers else tree
            yield pa.RecordBatch.from_pydict({"host": list(wrappers), "wrapper": [json.dumps(w) for w in wrappers.values()]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    def aligned(group: pd.DataFrame) -> list:
        out: list | None = None
        for text in group["wrapper"].sort_values():
            tree = json.loads(text)
            out = tree if out is None else align(out, tree)
        return out or []

    def join_parts(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(aligned(group))]})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = aligned(group)
        regex = printed(wrapper)
        content(wrapper)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "regex": [regex]})

    schema = "host string, wrapper string"
    parts = written(pages.select(host_of(url).alias("host"), F.col(html)).mapInArrow(read_pages, schema), "parts")
    while True:
        counts = parts.groupBy("host").agg(F.count("*").alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= FAN:
            return parts.groupBy("host").applyInPandas(finish, "host string, wrapper string, regex string")
        group = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN))
        parts = written(parts.join(counts, "host").groupBy("host", group.alias("g")).applyInPandas(join_parts, schema), "parts")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = 8_000_000) -> DataFrame:
    """(key, url, text, n_chars): the main text of each page, its blocks joined by line ends.

    The wrappers go to all tasks only while their measured size is below ``broadcast_bytes``; else they are joined by host.
    """
    pages = keyed(pages, key, url, html)
    found = written(infer_wrappers(pages, url, html), "wrappers").select(F.col("host").alias("of"), "wrapper")
    size = found.agg(F.coalesce(F.sum(F.octet_length("of") + F.octet_length("wrapper") + 32), F.lit(0))).first()[0]
    found = F.broadcast(found) if size <= broadcast_bytes else found.hint("merge")
    joined = pages.withColumn("host", host_of(url)).join(found, F.col("host") == F.col("of"), "left").select(key, url, html, "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, list] = {}
        for b in batches:
            texts = []
            for page, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if w and w not in wrappers:
                    if len(wrappers) >= 200:
                        wrappers.clear()
                    wrappers[w] = json.loads(w)
                texts.append(main_text(page, wrappers.get(w)) if page else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
