"""Main text of web pages, by container paths on which the pages of a host agree.

Tags and class words mark parts that are no article text. A mark weighs against its part, but doesn't decide alone: a part
that holds the article, or nearly all of the page's text, stays whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tessera.llm.common import Work

# Fixed values of HTML and of how sites name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
SKIPPED = frozenset("noscript template svg object select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td form body".split())
NEVER = frozenset("nav footer aside form dialog menu".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus dropdown footer gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup promo promoted promotion recommended recommendations related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget alert".split()
)
#: Beside a boiler word in a name, these leave it one: `cookie-box` is marked, `has-sidebar` and `related-work` are not.
BESIDE = frozenset("area articles bar block bottom box container content field form group holder icons inner item items left link links list main news outer page pane panel posts primary right secondary section site slot stories text thread top unit widgets wrap wrapper".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: A marked part with this share of the page's text stays; with a first-level heading, this share is enough.
ALL_OF_PAGE, MOST_OF_PAGE = 0.9, 0.5
#: A container is widened to the one around it if that has so many times its text.
WIDER = 1.5
#: Deeper containers have the path of this depth.
DEEPEST = 100

# an attribute's value is quoted only right after "="; stray quotes are part of names, as in HTML
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "path", "depth", "parent", "marked", "within", "boiler", "number", "size", "gain", "full", "score", "heading", "holds", "chosen")

    def __init__(self, tag, path, parent, marked, within, number):
        self.tag, self.path, self.parent, self.marked, self.within, self.number = tag, path, parent, marked, within, number
        self.depth = parent.depth + 1 if parent else 0
        self.boiler = self.heading = self.holds = self.chosen = False
        self.size, self.gain, self.full, self.score = 0, 0.0, 0.0, 0.0


def _names_boiler(value: str) -> bool:
    """Whether one of the names in a class or id is made of boiler words and what stands beside them."""
    for name in value.split():
        words = [w.lower() for w in PARTS.findall(name)]
        if not BOILER_WORDS.isdisjoint(words) and all(w in BOILER_WORDS or w in BESIDE for w in words):
            return True
    return False


def _attributes(text: str) -> tuple[str, bool]:
    """The generalised class of a tag, and whether its attributes mark something that isn't article text."""
    label, marked = "", False
    for m in ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            marked |= _names_boiler(value)
            if not label or name == "class":
                label = "." + ".".join(re.sub(r"\d+", "", value.lower()).split()[:3])
        elif name == "role":
            marked |= value.lower() in BOILER_ROLES
        elif name == "style":
            marked |= "display:none" in value.lower().replace(" ", "")
        else:
            marked |= name == "hidden" or value.lower() == "true"
    return label, marked


def parse(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Text blocks in page order with the element that holds them, and all elements with their scores."""
    root = Node("html", "html", None, False, False, 0)
    stack, nodes = [root], [root]
    blocks: list[tuple[Node, str]] = []
    text: list[str] = []
    links = 0.0
    at = a_depth = 0

    def flush() -> None:
        nonlocal links
        if text:
            holder = stack[-1]
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                blocks.append((holder, line))
                holder.size += len(line)
                holder.gain += max(0.0, len(line) - 2 * links) * (0.2 if holder.tag in ("li", "td", "th", "dt") else 1.0)
        links = 0.0

    def leave(depth: int) -> None:
        flush()
        del stack[depth:]

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
            links += (m.start() - at) if a_depth else 0
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                a_depth = 0
            elif tag in BLOCKS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        leave(i)
                        break
                    if stack[i].tag in ("td", "th", "table") and tag in ("p", "li"):
                        break
                else:
                    flush()
            continue
        if tag in RAW or tag in SKIPPED:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not m[3].endswith("/") and (end or tag in RAW):
                at = end.end() if end else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            a_depth = 1
        if tag not in BLOCKS:
            continue
        flush()
        if tag in CLOSES_P or tag == "p":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table", "div", "article", "section", "main"):
                    break
        if tag in ("li", "dt", "dd", "td", "th", "tr"):
            stops, same = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",)), {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}.get(tag, ("td", "th"))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in same:
                    del stack[i:]
                    break
        if tag in VOID or tag == "html":
            continue
        up = stack[-1]
        label, marked = _attributes(m[3]) if m[3] else ("", False)
        header = tag == "header" or "header" in label
        marked = tag != "body" and (marked or tag in NEVER or (header and not up.within))
        node = Node(tag, f"{up.path}/{tag}{label}" if up.depth < DEEPEST else up.path, up, marked, up.within or tag in ("article", "main"), len(nodes))
        nodes.append(node)
        if not m[3].endswith("/"):
            stack.append(node)
    flush()
    _score(nodes)
    return blocks, nodes


def _score(nodes: list[Node]) -> None:
    """What holds what, from the leaves up; what is no article text, from the root down; then scores, from the leaves up."""
    for x in reversed(nodes[1:]):
        x.parent.size += x.size
        x.parent.heading |= x.heading or x.tag == "h1"
        x.parent.holds |= x.holds or (x.tag in ("article", "main") and not x.marked)
    whole = max(1, nodes[0].size)
    for x in nodes[1:]:
        share = x.size / whole
        stays = x.holds or share >= ALL_OF_PAGE or (share >= MOST_OF_PAGE and (x.heading or x.tag in ("article", "main")))
        x.boiler = x.parent.boiler or (x.marked and not stays)
    for x in reversed(nodes):
        if x.boiler:
            continue
        x.full += x.gain
        x.score += x.gain
        if x.parent is not None:
            x.parent.full += x.full
            x.parent.score += x.score / 2 if x.tag in CONTAINERS else x.score


def best(nodes: list[Node]) -> Node | None:
    """The article or main part around the container with the highest score (of equals, the one opened last); without
    one, that container, widened while the one around it has much more text."""
    found = [x for x in nodes if x.tag in CONTAINERS and x.score > 0 and not x.boiler]
    top = max(found, key=lambda x: (x.score, x.number), default=None)
    for tag in ("article", "main"):
        x = top
        while x is not None:
            if x.tag == tag:
                return x
            x = x.parent
    while top is not None:
        up = top.parent
        while up is not None and up.tag not in CONTAINERS:
            up = up.parent
        if up is None or up.tag == "body" or top.tag == "body" or up.full < WIDER * top.full:
            break
        top = up
    return top


def extract(page: str | None, winning: str | None) -> str:
    """Text of the containers on the winning path, or of the page's own best one if that path has no text here."""
    if not page:
        return ""
    blocks, nodes = parse(page)

    def under(chosen: set[int]) -> list[str]:
        for x in nodes:
            x.chosen = x.number in chosen or (x.parent is not None and x.parent.chosen)
        return [line for holder, line in blocks if holder.chosen and not holder.boiler]

    lines = under({x.number for x in nodes if x.path == winning and not x.boiler}) if winning else []
    if not lines:
        own = best(nodes)
        lines = under({own.number}) if own is not None else [line for holder, line in blocks if not holder.boiler]
    return "\n\n".join(lines)


def host_of(url: str = "url"):
    """Host of an address in lower case, without port; null without one."""
    return F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and the path that most of its pages vote for; ties go to the larger total score, then to the first in order.

    Each page votes for the generalised tag-class path (digits removed) of its best container, with no say for pages
    without a host. Votes are counted by host and path, so a large host is never gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for page in b.column("html"):
                node = best(parse(page.as_py())[1]) if page.is_valid else None
                got.append((node.path, int(node.score)) if node is not None else (None, 0))
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64())], names=["host", "path", "score"])

    votes = pages.select(host_of().alias("host"), "html").filter("host is not null").mapInArrow(run, "host string, path string, score long").filter("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return counted.withColumn("n", F.row_number().over(order)).filter("n = 1").select("host", F.col("path").alias("winning"))


def main_text(pages: DataFrame, most_broadcast: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page, and the columns `keep`.

    Null and empty html give an empty text; pages with a null or odd url use their own best container. Pages that repeat
    are extracted each, with one vote each. An empty table gives no rows. Pages may be of any length, and kept columns
    have any names; those named like a result are replaced. Winning paths of up to `most_broadcast` bytes in all are
    sent to all tasks; beyond that they are joined by a shuffle, whose large hosts Spark splits. The result is the same.
    """
    keep = [c for c in keep or [] if c not in ("page_id", "url", "text", "n_chars")]
    winners = Work(pages.sparkSession, "paths").write(winning_paths(pages), "winners")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("winning") + 32)).first()[0] or 0
    if size <= most_broadcast:
        winners = F.broadcast(winners)
    rows = pages.select("page_id", "url", "html", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept"), host_of().alias("host"))
    rows = rows.join(winners, "host", "left").select("page_id", "url", "html", "winning", "kept")
    schema = StructType([pages.schema["page_id"], StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType()), rows.schema["kept"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [extract(p.as_py(), w.as_py()) for p, w in zip(part.column("html"), part.column("winning"), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column("kept")], names=["page_id", "url", "text", "n_chars", "kept"])

    return rows.mapInArrow(run, schema).select("page_id", "url", "text", "n_chars", *[F.col("kept").getField(c).alias(c) for c in keep])
