"""Main text of web pages with a site style tree.

1. Each page is read into blocks of text, each with its style path (tags with
   their classes and ids from the root down) and what its markup says: menus,
   headers, footers, sidebars, notices, adverts, forms and comments by tag, role
   or name; text outside the article or main part where one stands out.
2. The pages of a host are merged into a tree.  An element is a presentation node:
   which child styles follow in how many pages; its own text is a content node
   below it: which texts stand there in how many pages.
3. Importance by entropy: a presentation node matters as far as its pages differ
   in what follows; a content node as far as its texts are not spread over its
   pages; a node's importance mixes its own with that of its children.  Few pages
   say little: an importance moves from 1 with m / (m + ``DOUBT``) for m pages.
   What markup says of the texts below a node weakens its importance.
4. A page loses the branches of low importance.  If nothing is left, only those
   count that are low without regard to names.

Pages of a host whose text is equal after markup alone count as one page
together, so copies of one article don't empty each other however much of the
host they are.  A branch that holds most of its host's varying text is never
taken for a template (parts of it may be), and inside a marked article only
branches that hardly vary go.

A name counts as a whole class or id, or if every word of it is a name or tells of
a part of a page (ad-slot, but not related-work or has-sidebar); it never counts
against an article or main part that bears it.

Results for odd input: null or empty html has no text; unclosed and misnested
tags are closed by the enclosing end; a very long page is read whole, as a row of
its own; a null url is a host of its own; repeated rows are pages each; blocks of
equal text stay as often as they stand; columns that aren't carried are ignored,
and a carried one that is called ``text`` is given as ``text_in``; an empty table
gives an empty table.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.workspace import Workspace, carried, column, given_back

#: Pages' worth of doubt in what few pages say.
DOUBT = 0.9
#: Importance under which a branch goes: anywhere, and inside a marked article.
LOW, LOW_INSIDE = 0.2, 0.03
#: What remains of the importance of text that a name or, by its place, a marked article sets apart; a tag or role leaves none.
NAMED, OUTSIDE = 0.02, 0.15
#: Share of a page's text from which its article or main part stands out.
STANDS_OUT = 0.25
#: Weight of the children in a node's importance.
INHERITED = 0.9
MOST_VARIED = 0.5
#: Depth from which a host's tree is weighed subtree by subtree.
CUT = 8
SENT_ROWS = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul caption".split())
#: An opening tag closes these, up to the listed barrier.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
_ENDS_P = _BLOCK - {"option", "legend", "caption", "head", "html", "body", "title"}
_OTHER_TAGS = frozenset("nav footer aside form button select option textarea head title menu dialog noscript template iframe object svg canvas script style audio video noembed noframes xmp".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_OTHER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies respond cookie cookies consent gdpr notice notification popup modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login widget toolbar pagination pager masthead".split())
#: Words that tell of a part of a page, whatever it holds.
_PARTS = frozenset("list box item items wrapper wrap container slot slots block section area zone left right top bottom inner outer main site page post posts link links bar unit panel column col row grid text title content group set region primary secondary sub small large mobile desktop fixed sticky inline footer articles stories".split())
_OTHER_NAMES_ALONE = frozenset("header footer side banner alert top bottom tools meta hidden".split())


@dataclass
class Block:
    path: str
    text: str
    #: a name, of it or above, says that it is something else
    named: bool
    #: inside an article or main part
    inside: bool
    #: its tag or role, or one above, says that it is something else
    tagged: bool


class _Node:
    __slots__ = ("tag", "path", "tagged", "named", "inside", "children")

    def __init__(self, tag: str, path: str, tagged: bool, named: int, inside: int):
        self.tag, self.path, self.tagged, self.named, self.inside, self.children = tag, path, tagged, named, inside, []


def _tagged_other(tag: str, attributes: dict[str, str], inside: int) -> bool:
    return tag in _OTHER_TAGS or attributes.get("role", "").lower() in _OTHER_ROLES or (tag == "header" and not inside)


def _named_other(tag: str, attributes: dict[str, str]) -> int:
    """2 if a whole class or id is one of the names, 1 if one is made of names and parts (ad-slot, left-sidebar)."""
    if tag in ("html", "body", "article", "main") or attributes.get("role", "").lower() == "main":
        return 0
    found = 0
    for token in (x for k in ("class", "id") for x in attributes.get(k, "").split()):
        if token.lower() in _OTHER_NAMES or token.lower() in _OTHER_NAMES_ALONE:
            return 2
        words = {x.lower() for x in _NAME.findall(token)}
        if words <= _OTHER_NAMES | _PARTS and words & (_OTHER_NAMES | {"footer"}):
            found = 1
    return found


def read_page(source: str) -> tuple[list[Block], dict[str, list[str]]]:
    """Blocks of text in page order, and of each style path the child styles that follow."""
    blocks: list[Block] = []
    styles: dict[str, list[str]] = {}
    stack = [_Node("", "", False, 0, 0)]
    said: list[str] = []

    def flush() -> None:
        if said:
            text = _SPACE.sub(" ", "".join(said)).strip()
            said.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(top.path, text, top.named > 0, top.inside > 0, top.tagged))

    def pop() -> None:
        node = stack.pop()
        styles.setdefault(node.path, []).append("|".join(dict.fromkeys(node.children)))

    def close_to(n: int) -> None:
        while len(stack) > n:
            if stack[-1].tag in _BLOCK:
                flush()
            pop()

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            said.append(_html.unescape(source[at:]))
            break
        if m.start() > at:
            said.append(_html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                said.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
            if tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            said.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSES:
            closed, barrier = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in barrier:
                    break
                if stack[k].tag in closed:
                    close_to(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        style = tag + "".join("." + _DIGITS.sub("0", x) for x in sorted(attributes.get("class", "").split())) + ("#" + _DIGITS.sub("0", attributes["id"]) if attributes.get("id") else "")
        top = stack[-1]
        top.children.append(style)
        if tag in _VOID:
            continue
        inside = max(top.inside, 2 if tag == "article" else 1 if tag == "main" or attributes.get("role", "").lower() == "main" else 0)
        # a compound name above an article or main part doesn't hold for it
        above = 0 if inside > top.inside and top.named < 2 else top.named
        node = _Node(tag, f"{top.path}/{style}", top.tagged or _tagged_other(tag, attributes, top.inside), max(above, _named_other(tag, attributes)), inside)
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            raw = source[at : close.start() if close else end]
            at = close.end() if close else end
            if tag in ("title", "textarea") and raw.strip():
                blocks.append(Block(node.path, _SPACE.sub(" ", _html.unescape(raw)).strip(), False, inside > 0, True))
            continue
        if m[3].endswith("/") and tag in ("svg", "path", "g"):
            continue
        stack.append(node)
    close_to(1)
    flush()
    return blocks, styles


def said_by_markup(blocks: Sequence[Block]) -> list[tuple[float, float]]:
    """Of each block: what markup leaves of its importance, and what it leaves without regard to names."""
    plain = [b for b in blocks if not (b.tagged or b.named)] or [b for b in blocks if not b.tagged]
    stands_out = sum(len(b.text) for b in plain if b.inside) >= STANDS_OUT * sum(len(b.text) for b in plain) and any(b.inside for b in plain)
    found = []
    for b in blocks:
        bare = 0.0 if b.tagged else OUTSIDE if stands_out and not b.inside else 1.0
        found.append((min(bare, NAMED) if b.named else bare, bare))
    return found


def candidates(blocks: Sequence[Block]) -> list[Block]:
    """Blocks that markup alone leaves; if it leaves none, also of what only a name sets apart."""
    said = said_by_markup(blocks)
    for k in (0, 1):
        if kept := [b for b, own in zip(blocks, said, strict=True) if own[k] == 1.0]:
            return kept
    return []


#: Last step of the path of a content node.
_TEXT = "/#text"


def _gone(path: str, low: set[str] | frozenset[str]) -> bool:
    while path:
        if path in low:
            return True
        path = path.rpartition("/")[0]
    return False


def main_text(blocks: Sequence[Block], low: dict[str, bool] | None = None) -> str:
    """The blocks that stay, one to a line; ``low``: style paths of branches that go, and whether without regard to names; without it markup alone decides."""
    if low is None:
        return "\n".join(b.text for b in candidates(blocks))
    for own in (set(low), {p for p, bare in low.items() if bare}):
        if kept := [b.text for b in blocks if not _gone(b.path + _TEXT, own)]:
            return "\n".join(kept)
    return ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


#: What a row of the merged tree counts.
PAGES, STYLE, CONTENT = 0, 1, 2


def _content_key(blocks: Sequence[Block]) -> int:
    return _hash("\n".join(b.text for b in candidates(blocks)))


def _content_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_content_key(read_page(source or "")[0]) for source in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), *batch.columns[2:]], ["host", "key", *batch.schema.names[2:]])


def page_nodes(blocks: Sequence[Block], styles: dict[str, list[str]]) -> dict[tuple[str, int, int], tuple[int, float, float]]:
    """(path, kind, value) of a page's nodes with code points, and these weakened by what markup says, with and without names."""
    own: dict[tuple[str, int, int], tuple[int, float, float]] = {}
    for path, children in styles.items():
        own[path, PAGES, 0] = own[path, STYLE, _hash("||".join(children))] = (0, 0.0, 0.0)
    for b, (said, bare) in zip(blocks, said_by_markup(blocks), strict=True):
        key, n = (b.path + _TEXT, PAGES, 0), len(b.text)
        points, clear, unnamed = own.get(key, (0, 0.0, 0.0))
        own[key] = (points + n, clear + n * said, unnamed + n * bare)
        own[b.path + _TEXT, CONTENT, _hash(b.text)] = (0, 0.0, 0.0)
    return own


def _tree_rows(sent):
    """``sent``: number of pages by (host, key of equal text), where more than one; without it the third column says so."""

    def tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch: (host, path, kind, value) with the number of pages, each set of equal ones counted once, and their code points."""
        for batch in batches:
            seen: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
            equal = batch.column(2).to_pylist() if sent is None else [None] * batch.num_rows
            for host, source, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), equal, strict=True):
                blocks, styles = read_page(source or "")
                weight = 1.0 / (n or 1 if sent is None else sent.value.get((host, _content_key(blocks)), 1))
                for key, points in page_nodes(blocks, styles).items():
                    count = seen[host, *key]
                    count[0] += weight
                    for i, x in enumerate(points, 1):
                        count[i] += weight * x
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), *(pa.array([k[i] for k in seen], pa.int64()) for i in (2, 3)), *(pa.array([v[i] for v in seen.values()], pa.float64()) for i in range(4))], ["host", "path", "kind", "value", "pages", "points", "clear", "unnamed"])

    return tree_rows


def site_style_tree(pages: DataFrame, work: Workspace | None = None, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Of (host, html): (host, path, m pages, presentation, content, varying, points, clear, unnamed) of every node; m counts pages of equal text once.

    presentation and content: importance by entropy, 1 for a node of the other kind; points: code points of its text,
    clear and unnamed: what markup leaves of them, with and without regard to names; varying: what of clear differs by page.
    The sets of equal pages are sent to the tasks while they are at most ``sent_rows``, else joined.
    """
    work = work or Workspace(pages.sparkSession, "html")
    html = pages.select("host", "html")
    equal = work.save(html.mapInArrow(_content_keys, "host string, key long").groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1"), "equal")
    if equal.count() <= sent_rows:
        sent = pages.sparkSession.sparkContext.broadcast({(r["host"], r["key"]): r["n"] for r in equal.toLocalIterator()})
    else:
        sent = None
        html = html.select("host", "html", F.col("html").alias("again")).mapInArrow(_content_keys, "host string, key long, again string").join(equal, ["host", "key"], "left").select("host", F.col("again").alias("html"), "n")
    rows = html.mapInArrow(_tree_rows(sent), "host string, path string, kind long, value long, pages double, points double, clear double, unnamed double")
    # rounded, so that sums of shares don't depend on their order
    sums = [F.round(F.sum(c), 3).alias(c) for c in ("points", "clear", "unnamed")]
    counted = rows.groupBy("host", "path", "kind", "value").agg(F.round(F.sum("pages"), 6).alias("c"), *sums).where("c > 0")
    c = F.col("c")
    total = lambda x, kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0.0))
    sums = [total(F.col(x), PAGES).alias(x) for x in ("points", "clear", "unnamed")]
    nodes = counted.groupBy("host", "path").agg(total(c, PAGES).alias("m"), *sums, total(c, STYLE).alias("ns"), total(c * F.log(c), STYLE).alias("es"), total(c, CONTENT).alias("nc"), total(c * F.log(c), CONTENT).alias("ec"))
    m, log_m = F.col("m"), F.log("m")
    # entropies to base m: of the page over its child styles, and of each text over the pages that have it
    styles = F.when((m < 2) | (F.col("ns") == 0), 1.0).otherwise(F.log("ns") / log_m - F.col("es") / (F.col("ns") * log_m))
    texts = F.when((m < 2) | (F.col("nc") == 0), 1.0).otherwise(1 - F.col("ec") / (F.col("nc") * log_m))
    within = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    shown = lambda x: F.round(1 - (1 - within(x)) * m / (m + DOUBT), 9)
    return nodes.select("host", "path", "m", shown(styles).alias("presentation"), shown(texts).alias("content"), F.round(F.col("clear") * within(texts), 3).alias("varying"), "points", "clear", "unnamed")


@dataclass
class _Weighed:
    """A node with all below it: importance by entropy, code points, those that vary, and the most that markup leaves of a text."""

    importance: float
    points: float
    varied: float
    clear: float
    unnamed: float


_INSIDE = re.compile(r"/(?:article|main)(?=[./#]|$)")
_WEIGHED = "host string, path string, importance double, points double, varied double, clear double, unnamed double, low boolean, bare boolean, whole double"


def _weigh(table: pa.Table) -> pa.Table:
    """Of nodes of one host (a whole tree, or a subtree with its root): the low ones, and the topmost one.

    A row with an ``importance`` stands for a subtree that was weighed before.
    """
    rows = {r["path"]: r for r in table.to_pylist()}
    children: dict[str, list[str]] = defaultdict(list)
    for path in rows:
        if path:
            children[path.rpartition("/")[0]].append(path)
    weighed: dict[str, _Weighed] = {}
    top = min(rows, key=lambda p: (p.count("/"), p))
    out = []
    for path in sorted(rows, key=lambda p: (-p.count("/"), p)):
        r, own = rows[path], [weighed[c] for c in sorted(children[path])]
        if r["importance"] is not None:
            weighed[path] = _Weighed(r["importance"], r["all_points"], r["varied"], r["left"], r["left_bare"])
            continue
        if path.endswith(_TEXT):
            n = max(1.0, r["points"])
            node = _Weighed(r["content"], r["points"], r["varying"], r["clear"] / n, r["unnamed"] / n)
        else:
            weight = sum(max(1.0, x.points) for x in own)
            below = sum(max(1.0, x.points) * x.importance for x in own) / weight if own else 1.0
            share = 1 - INHERITED ** len(own) if own else 0.0
            node = _Weighed(share * max(r["presentation"], below) + (1 - share) * below, sum(x.points for x in own), sum(x.varied for x in own), max((x.clear for x in own), default=0.0), max((x.unnamed for x in own), default=0.0))
        weighed[path] = node
        least = LOW_INSIDE if _INSIDE.search(path) else LOW
        # holding most of what varies, it is no template; markup may still set it apart
        importance = 1.0 if node.varied >= MOST_VARIED * r["whole"] else node.importance
        low, bare = (importance * x < least for x in (node.clear, node.unnamed))
        if path and node.points and low or path == top:
            out.append((r["host"], path, node, path != "" and node.points > 0 and low, bare, r["whole"]))
    low = {x[1] for x in out if x[3]}
    out = [x for x in out if x[1] == top or not _gone(x[1].rpartition("/")[0], low)]
    host, path, node, low, bare, whole = (list(x) for x in zip(*out, strict=True)) if out else ([] for _ in range(6))
    figures = [[getattr(x, c) for x in node] for c in ("importance", "points", "varied", "clear", "unnamed")]
    return pa.table([pa.array(host, pa.string()), pa.array(path, pa.string()), *(pa.array(x, pa.float64()) for x in figures), pa.array(low, pa.bool_()), pa.array(bare, pa.bool_()), pa.array(whole, pa.float64())], ["host", "path", "importance", "points", "varied", "clear", "unnamed", "low", "bare", "whole"])


def low_branches(pages: DataFrame, work: Workspace | None = None, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(host, path, bare) of the branches that the trees of the hosts of (host, html) call unimportant; ``bare``: without regard to names too.

    Subtrees from depth ``CUT`` on are weighed each in its own group, then the hosts' upper parts on top of them; in a
    group, only the topmost ones are named.
    """
    work = work or Workspace(pages.sparkSession, "html")
    nodes = work.save(site_style_tree(pages, work, sent_rows), "nodes")
    whole = nodes.groupBy(F.col("host").alias("of")).agg(F.round(F.sum("varying"), 3).alias("whole"))
    none = [F.lit(None).cast("double").alias(c) for c in ("importance", "all_points", "varied", "left", "left_bare")]
    nodes = nodes.join(whole, F.col("host").eqNullSafe(F.col("of"))).select("host", "path", "presentation", "content", "varying", "points", "clear", "unnamed", "whole", *none)
    depth = F.size(F.split("path", "/")) - 1
    deep = nodes.where(depth >= CUT).withColumn("root", F.substring_index("path", "/", CUT + 1))
    below = work.save(deep.groupBy("host", "root").applyInArrow(lambda t: _weigh(t.drop_columns(["root"])), _WEIGHED), "below")
    zero = F.lit(0.0)
    roots = below.where(depth == CUT).select("host", "path", zero.alias("presentation"), zero.alias("content"), zero.alias("varying"), zero.alias("points"), zero.alias("clear"), zero.alias("unnamed"), "whole", "importance", F.col("points").alias("all_points"), "varied", F.col("clear").alias("left"), F.col("unnamed").alias("left_bare"))
    above = nodes.where(depth < CUT).unionByName(roots).groupBy("host").applyInArrow(_weigh, _WEIGHED)
    low = work.save(below.unionByName(above).where("low").select("host", "path", "bare"), "low")
    work.drop("equal", "nodes", "below")
    return low


def _extractor(sent):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, sources, lists = (batch.column(i).to_pylist() for i in range(3))
            texts = []
            for host, source, own in zip(hosts, sources, lists, strict=True):
                low = sent.value.get(host, {}) if sent is not None else dict(own or ())
                texts.append(main_text(read_page(source or "")[0], low))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[3:]], ["text", *(f"carried_{i}" for i in range(batch.num_columns - 3))])

    return extract


def extract_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", carry: Sequence[str] = ("page_id", "url"), sent_rows: int = SENT_ROWS) -> DataFrame:
    """Columns of ``carry`` and the main text of every page.

    The low branches are sent to the tasks while they are at most ``sent_rows``, else joined by host.
    """
    base = pages.select(host_of(column(url_col)).alias("host"), column(html_col).alias("html"), *carried(carry))
    work = Workspace(pages.sparkSession, "html")
    low = low_branches(base, work, sent_rows)
    none = F.lit(None).cast("map<string,boolean>").alias("low")
    others = base.columns[2:]
    if low.count() <= sent_rows:
        by_host: dict[str, dict[str, bool]] = defaultdict(dict)
        for r in low.toLocalIterator():
            by_host[r["host"]][r["path"]] = r["bare"]
        work.remove()
        sent = pages.sparkSession.sparkContext.broadcast(dict(by_host))
        ready = base.select("host", "html", none, *others)
    else:
        sent = None
        ready = base.join(low.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "bare"))).alias("low")), "host", "left").select("host", "html", "low", *others)
    schema = T.StructType([T.StructField("text", T.StringType()), *base.schema.fields[2:]])
    out = ready.mapInArrow(_extractor(sent), schema)
    return out.select(*given_back(carry, ("text",)), "text")
