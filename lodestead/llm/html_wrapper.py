"""Main text of web pages by wrappers inferred for each host (operator 2).

A wrapper is a union-free regular expression over a page's tokens, written as a tree: an element holds a sequence of
items, each once, optional (?), or repeated (+), each an element, a repeated group of items, or a text slot.  It is
inferred from a bounded sample of a host's pages (``SAMPLES``, drawn by hash): a page's own repetitions are folded
first, then the wrapper is aligned with one page after the other; a mismatch becomes a repetition where it repeats its
neighbour and an optional group otherwise; text becomes a slot, and strings that stand in a slot on every sampled page (of
two or more) are template there.  The wrapper decides where the host's main text
lies: its article or main element, else the element that holds most of the sampled text.  Tags that never hold an
article's text are left out, and so are blocks that a class, id or role marks as boilerplate, unless they lie on the way
to the main text; marks on paragraphs, headings, list items and inline markup mean nothing.

Every page is then aligned with its host's wrapper and gives the slots of the main region, without the template.  What a page has and the
wrapper lacks is resolved on the spot as an optional group of the region around it, so no page is left out.

Defined results: null or empty html gives an empty text; a null or malformed url belongs to the host ''; unclosed and
stray tags are repaired (a p, li, dt, dd, option, tr, td or th ends where the next begins, the rest at its parent's end);
a tag cut off at the end of the page is dropped; very long and deep pages are handled in time linear in their length (a
wrapper describes them to DEPTH levels, below which all text counts as the page's own); repeated
rows get equal rows; an empty table gives none; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import BROADCAST_BYTES, attach, stage
from lodestead.session import ship

SAMPLES = 8
PERIOD = 4
#: Levels that a wrapper describes.
DEPTH = 100
ROOT = "#page"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form frame head iframe input link menu meta nav noscript option script select style svg template textarea title video".split())
#: Elements whose marks mean nothing: they hold text rather than blocks.
PLAIN = INLINE | frozenset("address blockquote body caption dd details dt figcaption h1 h2 h3 h4 h5 h6 hr html img li p pre summary tbody td tfoot th thead tr".split())
RAW = frozenset("script style textarea title iframe noembed xmp".split())
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment commentlist comments consent contentinfo cookie cookies dialog disqus "
    "foot footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination "
    "popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split())
#: Beside one of these a mark speaks of the page around it: has-sidebar, no-comments, share-enabled.
ABOUT = frozenset("disabled enabled free has hide hidden is layout no non not off on page show with without".split())
COMMENTS = frozenset("comment commentlist comments disqus replies reply respond".split())
#: An element that ends where one of these begins.
ENDS = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
        "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|</?[a-zA-Z][^>]*\Z|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


@dataclass
class Node:
    """An element of a page (kids: nodes and strings), or of a wrapper (items)."""

    sig: str
    kids: list = field(default_factory=list)

    @property
    def tag(self) -> str:
        return self.sig.partition(".")[0]


def signature(name: str, attrs: str) -> str:
    """Tag name and, after a dot, the words of class, id and role that mark boilerplate or content."""
    words: set[str] = set()
    if attrs and name not in PLAIN:
        for m in _ATTR.finditer(attrs):
            for part in (m[2] or m[3] or m[4] or "").split():
                found = _WORDS.findall(_HUMP.sub(r"\1-\2", part).lower())
                if not ABOUT.intersection(found):
                    words.update(w for w in found if w in MARKS or w in ("main", "article"))
    return ".".join([name, *sorted(words)])


def dropped(sig: str, inside_main: bool, on_way: bool = False) -> bool:
    """Whether an element is no part of the main text; on the way to it marks do not count."""
    tag, *words = sig.split(".")
    if tag in ("html", "body"):
        return False
    if tag in ("article", "main"):
        return any(w in COMMENTS for w in words)
    if tag == "header":
        return not inside_main and not on_way
    return tag in DROPPED or not on_way and any(w in MARKS for w in words)


def parse(html: str) -> Node:
    """The page as a tree of block elements and text; inline markup melts into the text."""
    root = Node(ROOT)
    stack, text, at, end = [root], [], 0, len(html)
    opened: Counter[str] = Counter()

    def flush() -> None:
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                stack[-1].kids.append(said)
            text.clear()

    def close() -> str:
        name = stack.pop().tag
        opened[name] -= 1
        return name

    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            text.append(m["text"])
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            if opened[name]:
                flush()
                while close() != name:
                    pass
            elif name == "p":
                flush()
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            continue
        flush()
        while len(stack) > 1 and name in ENDS.get(stack[-1].tag, ()):
            close()
        node = Node(signature(name, m["attrs"] or m["attrs2"] or ""))
        stack[-1].kids.append(node)
        if name in RAW:
            stop = _RAW_END[name].search(html, at)
            at = stop.end() if stop else end
        elif name not in VOID:
            stack.append(node)
            opened[name] += 1
    flush()
    return root


# A wrapper's item: [quantifier, what]; quantifier "", "?", "+" or "*"; what: "#" (a text slot), ["t", strings] (a text slot
# in which these strings are template), ["e", sig, items] or ["g", items] (a repeated group).  While a wrapper is inferred,
# strings is a dict from each text met there to the set of pages, as bits, that have it.


def _name(item: list):
    what = item[1]
    return "#" if _text(what) else what[1] if what[0] == "e" else tuple(_name(x) for x in what[1])


def _text(what) -> bool:
    return what == "#" or what[0] == "t"


def _joined(a: str, b: str, again: bool = False) -> str:
    many = again or "+" in (a, b) or "*" in (a, b)
    some = a in "?*" and a != "" or b in "?*" and b != ""
    return "*" if many and some else "+" if many else "?" if some else ""


def _merge(a, b):
    if a == "#" or b == "#":
        return "#"
    if a[0] == "t":
        a, b = (b, a) if len(a[1]) < len(b[1]) else (a, b)
        for said, pages in b[1].items():
            a[1][said] = a[1].get(said, 0) | pages
        return a
    return ["e", a[1], align(a[2], b[2])] if a[0] == "e" else ["g", align(a[1], b[1])]


def fold(items: list) -> list:
    """Repetitions of one to PERIOD neighbouring items become one repeated item or group."""
    for width in range(1, PERIOD + 1):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * width and [_name(x) for x in out[-width:]] == [_name(x) for x in out[-2 * width : -width]]:
                last, before = out[-width:], out[-2 * width : -width]
                both = [[_joined(x[0], y[0], width == 1), _merge(x[1], y[1])] for x, y in zip(before, last)]
                if width == 1:
                    # x? x+ still needs one x; only two optional ones may both be absent
                    both[0][0] = "*" if before[0][0] in ("?", "*") and last[0][0] in ("?", "*") else "+"
                    out[-2:] = both
                else:
                    out[-2 * width :] = [["+", ["g", both]]]
            if width > 1 and len(out) > width and out[-width - 1][1] != "#" and out[-width - 1][1][0] == "g" and tuple(_name(x) for x in out[-width:]) == _name(out[-width - 1]):
                group = out[-width - 1]
                group[1] = ["g", [[_joined(x[0], y[0]), _merge(x[1], y[1])] for x, y in zip(group[1][1], out[-width:])]]
                del out[-width:]
        items = out
    return items


def generalise(node: Node, page: int = 0, depth: int = DEPTH) -> list:
    """A page's own expression, ``depth`` levels of it; ``page`` is its bit."""
    if not depth:
        return []
    items = [["", ["t", {k: page}] if page else "#"] if isinstance(k, str) else ["", ["e", k.sig, generalise(k, page, depth - 1)]] for k in node.kids]
    return fold(items)


def align(a: list, b: list) -> list:
    """The least expression of this kind that covers both: common items merge, others become optional."""
    if a == b:
        return a
    x, y = [_name(i) for i in a], [_name(i) for i in b]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append([_joined(a[i][0], b[j][0]), _merge(a[i][1], b[j][1])])
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append([_joined("?", a[i][0]), a[i][1]])
            i += 1
        else:
            out.append([_joined("?", b[j][0]), b[j][1]])
            j += 1
    return fold(out)


def expression(items: list) -> str:
    """The wrapper as readable text."""
    out = []
    for quantifier, what in items:
        if _text(what):
            out.append("#TEXT" + quantifier)
        elif what[0] == "g":
            out.append(f"({expression(what[1])}){quantifier}")
        else:
            body = f"<{what[1]}>{expression(what[2])}</{what[1].partition('.')[0]}>"
            out.append(f"({body}){quantifier}" if quantifier else body)
    return "".join(out)


def volumes(pages: list[Node]) -> tuple[dict[tuple[str, ...], int], dict[tuple[str, ...], bool]]:
    """Characters of text under each path of signatures, to DEPTH levels and without what is dropped by its tag or as
    comments; and whether the path passes a mark."""
    known: dict[tuple[int, str], int] = {}
    paths, parent, total, marked = [()], [0], [0], [False]
    for page in pages:
        todo = [(page, 0, 0, False)]
        while todo:
            node, at, depth, inside = todo.pop()
            for kid in node.kids:
                if isinstance(kid, str):
                    total[at] += len(kid)
                elif not dropped(kid.sig, inside, True) and not COMMENTS.intersection(kid.sig.split(".")[1:]):
                    below = at
                    if depth < DEPTH:
                        below = known.setdefault((at, kid.sig), len(paths))
                        if below == len(paths):
                            paths.append((*paths[at], kid.sig))
                            parent.append(at)
                            total.append(0)
                            marked.append(marked[at] or dropped(kid.sig, inside))
                    todo.append((kid, below, depth + 1, inside or kid.tag in ("article", "main")))
    for i in range(len(paths) - 1, 0, -1):  # a path stands behind its parent
        if not marked[i] or marked[parent[i]]:
            total[parent[i]] += total[i]
    return dict(zip(paths, total)), dict(zip(paths, marked))


def main_path(pages: list[Node]) -> tuple[str, ...]:
    """Signatures from the root to the element that holds the main text of these pages."""
    volume, marked = volumes(pages)
    for wanted in ("article", "main"):
        paths = [p for p in volume if p and volume[p] and (p[-1].partition(".")[0] == wanted or wanted in p[-1].split(".")[1:])]
        if paths:
            return max(paths, key=lambda p: (volume[p], -len(p), p))
    under: dict[tuple, list[tuple]] = {}
    for p in volume:
        if p and not marked[p]:
            under.setdefault(p[:-1], []).append(p)
    at: tuple = ()
    while True:  # downwards as long as one child holds most of the text and is no mere paragraph
        heavy = max(under.get(at, []), key=lambda p: (volume[p], p), default=None)
        if heavy is None or volume[heavy] * 10 < volume[at] * 7 or heavy[-1].partition(".")[0] in ("p", "pre", "blockquote", "td", "li"):
            return at
        at = heavy


def _settled(items: list, every: int) -> list:
    """The wrapper with only those strings as template that stand in their slot on all pages, if there are two at least."""
    out = []
    for quantifier, what in items:
        if _text(what):
            fixed = [said for said, pages in what[1].items() if pages == every] if what != "#" and every > 1 else []
            out.append([quantifier, ["t", sorted(fixed)] if fixed else "#"])
        else:
            out.append([quantifier, [*what[:-1], _settled(what[-1], every)]])
    return out


def infer(pages: list[str]) -> dict:
    """The wrapper of pages of one host: {"items", "main"}."""
    trees = [parse(p) for p in pages if p]
    items: list | None = None
    for _ in range(2):  # a second pass settles what early pages could not know
        for at, tree in enumerate(trees):
            own = generalise(tree, 1 << at)
            items = own if items is None else align(items, own)
    return {"items": _settled(items or [], (1 << len(trees)) - 1), "main": list(main_path(trees))}


def _match(items: list, name, at: int) -> tuple[int, list | None]:
    """The next item of that name at or after ``at``, else before it (a repetition of a group), with its inner items or,
    for a text, its template strings."""
    for i in [*range(at, len(items)), *range(min(at, len(items)))]:
        what = items[i][1]
        if _text(what):
            if name == "#":
                return i, [] if what == "#" else what[1]
        elif what[0] == "g":
            inner = _match(what[1], name, 0)[1]
            if inner is not None:
                return i, inner
        elif what[1] == name:
            return i, what[2]
    return at, None


def extract(html: str | None, wrapper: dict) -> tuple[str, int]:
    """(main text, mismatches): the page aligned with the wrapper, slots of the main region joined by one space."""
    if not html:
        return "", 0
    tree, main, out, missed = parse(html), tuple(wrapper["main"]), [], 0
    # a page may lack the host's main element; then its own decides
    if main and not _holds(tree, main):
        main = main_path([tree])
    article = bool(main) and (main[-1].partition(".")[0] in ("article", "main") or bool({"article", "main"} & set(main[-1].split(".")[1:])))
    # way: how many signatures of the path to the main element lie behind, None where the page has left it
    todo: list[tuple] = [(tree, wrapper["items"], 0, not main, False)]
    # depth first without recursion: kids are pushed in reverse
    while todo:
        node, items, way, inside, lost = todo.pop()
        if isinstance(node, str):
            if inside:
                out.append(node)
            continue
        at, kids = 0, []
        for kid in node.kids:
            name = "#" if isinstance(kid, str) else kid.sig
            found, inner = (at, None) if lost else _match(items, name, at)
            if inner is None:
                missed += not lost
            else:
                at = found
            if isinstance(kid, str):
                if not inner or kid not in inner:
                    kids.append((kid, [], way, inside, False))
                continue
            on = not inside and way is not None and way < len(main) and main[way] == kid.sig
            if not dropped(kid.sig, inside or article and kid.tag in ("article", "main"), on):
                kids.append((kid, inner or [], way + 1 if on else None, inside or on and way + 1 == len(main), lost or inner is None))
        todo.extend(reversed(kids))
    return " ".join(out), missed


def _holds(tree: Node, path: tuple) -> bool:
    level = [tree]
    for sig in path:
        level = [k for n in level for k in n.kids if not isinstance(k, str) and k.sig == sig]
    return bool(level)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(host, wrapper as JSON, n_samples): ``samples`` pages a host, the first by hash in as many hash classes."""
    ship(pages.sparkSession)
    rows = pages.select(host(F.col("url")).alias("host"), "html").where("html is not null and html <> ''").withColumn("draw", F.xxhash64("html"))
    picked = rows.select("host", "draw").groupBy("host", F.pmod("draw", F.lit(samples)).alias("class")).agg(F.min("draw").alias("draw")).select("host", "draw")
    picked, _ = stage(picked, "picked")
    few = picked.count() * 64 <= BROADCAST_BYTES
    drawn = rows.join(F.broadcast(picked) if few else picked, ["host", "draw"]).groupBy("host", "draw").agg(F.first("html").alias("html"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("draw")
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(infer(frame["html"].tolist()))], "n_samples": [len(frame)]})

    return drawn.groupBy("host").applyInPandas(one, "host string, wrapper string, n_samples int")


def main_text(pages: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """page_id, url, text, n_chars, host, mismatches."""
    table, _ = stage(wrappers(pages, samples), "wrappers")
    n, size = table.agg(F.count("*"), F.sum(F.length("wrapper"))).first()
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html", host(F.col("url")).alias("host"))
    if (size or 0) + 64 * n <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(table), "host", "left")
    else:  # pages go to their host's wrapper, those of the largest hosts stay where they lie
        held, _ = stage(rows.groupBy("host").agg(F.count("*").alias("held")), "hosts")
        table, _ = stage(held.join(table, "host", "left"), "wrappers")
        rows = attach(rows, table, "host", "held", held.agg(F.sum("held")).first()[0])
    rows = rows.select("page_id", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str | None, dict] = OrderedDict()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts, missed = [], []
                for page, of in zip(batch.column(2), batch.column(4)):
                    key = of.as_py()
                    if key not in known:
                        known[key] = json.loads(key) if key else {"items": [], "main": []}
                        if len(known) > 512:
                            known.popitem(last=False)
                    text, n = extract(page.as_py(), known[key])
                    texts.append(text)
                    missed.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3), pa.array(missed, pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "host", "mismatches"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, host string, mismatches bigint")
