"""Main text of web pages by a site style tree.

Pages of one host are merged by presentation: a node stands for all elements with one path of block
tags and classes; a heading belongs to the element around it. Its importance says how much it varies from page to page:

* content: one minus the mean entropy of its features' spread over pages, so a feature on every page counts 0
  and one on a single page counts 1. Features are the words of short blocks, such as menus, adverts and footers that
  differ in some word, and the clauses of longer ones;
* presentation: the entropy of the child sequences that the element around it has on different pages;
* both together as ``1 - (1 - presentation) * (1 - content)``: either kind of variety makes a node matter.

Equal html counts as one page, on its host and over all hosts, however many rows repeat it.

A page loses the nodes of low importance, and so each branch that has no others. The fewer pages of its host a node is on,
the more it takes the importance that it has over all hosts; one on few pages of all hosts together stays. Branches whose
role is plain from the markup (menus, page headers and footers, forms, adverts, reader comments ...) go in any case, unless
``roles`` is off; they count in the tree like all others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.store import BROADCAST_ROWS, drop, sized_join, written


@dataclass(frozen=True)
class StyleTree:
    """Settings: nodes below ``threshold`` go.

    All hosts count as ``borrowed`` pages beside a node's own; fewer than ``few_pages`` over all hosts tell nothing.
    Blocks of up to ``short`` words are compared by word. ``roles`` also leaves out what the markup names.
    """

    threshold: float = 0.8
    few_pages: int = 8
    borrowed: int = 128
    short: int = 12
    roles: bool = True


#: Fixed values of HTML: elements without content, elements that part blocks, and elements never shown as article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - frozenset("html body".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = {
    "li": frozenset(["ul", "ol", "menu"]),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]),
    "td": frozenset(["table", "tr"]),
    "th": frozenset(["table", "tr"]),
    "option": frozenset(["select"]),
}
ROLE_TAGS = frozenset("nav footer aside form menu dialog head button select iframe object svg math audio video canvas search".split())
ROLE_WORDS = frozenset(
    "ad ads adsbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disclaimer disqus footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination"
    " popup promo related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar"
    " widget".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
CLAUSE = re.compile(r"[.,;:!?|\u00b7\u2022\u3002\uff0c]+(?:\s|$)")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)"
SEED = xxhash.xxh64_intdigest


def _described(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """An element's presentation, and whether its role rules it out."""
    boiler = tag in ROLE_TAGS or (tag == "header" and not in_article)
    if not attributes or attributes.isspace():
        return tag, boiler
    shown = [tag]
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            boiler = True
        elif name == "role":
            boiler |= value in ROLES
        elif name in ("class", "id"):
            names = sorted(re.sub(r"\d+", "#", value).split())
            if name == "class":
                shown += names
            boiler |= any(word in ROLE_WORDS for x in names for word in re.split(r"[-_#]+", x)) and tag not in ("body", "html", "article", "main")
    return ".".join(shown), boiler


class Page:
    """The blocks of a page in order: (text, nodes from the outermost in, boiler), and children by node."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, tuple[int, ...], bool]] = []
        self.children: dict[int, int] = {}
        stack: list[tuple[str, int, bool, bool]] = []  # tag, node, boiler, in article
        nodes: tuple[int, ...] = ()
        text: list[str] = []
        boiler = article = False

        def flush():
            if text:
                raw = "".join(text)
                text.clear()
                if "&" in raw:
                    raw = unescape(raw)
                raw = " ".join(raw.split())
                if raw:
                    heading = stack and stack[-1][0] in HEADINGS
                    self.blocks.append((raw, nodes[:-1] if heading else nodes, boiler))

        def pop(depth: int):
            nonlocal nodes, boiler, article
            del stack[depth:]
            nodes = nodes[:depth]
            boiler, article = stack[-1][2:] if stack else (False, False)

        at = 0
        for match in TOKEN.finditer(html):
            start = match.start()
            if start > at:
                text.append(html[at:start])
            at = match.end()
            tag = match[3] or match[6]
            if tag is None:
                if match[1] and match[1].lower() == "textarea":
                    text.append(" ")
                continue
            tag, closing = tag.lower(), match[2] or match[5]
            if tag == "br":
                text.append(" ")
                continue
            if tag not in BLOCK and tag not in ROLE_TAGS:
                continue
            flush()
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        pop(depth)
                        break
                continue
            if tag in VOID:
                continue
            if tag in ENDS_P and stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if tag in CLOSED_BY:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in SCOPES[tag]:
                        break
                    if stack[depth][0] in CLOSED_BY[tag]:
                        pop(depth)
                        break
            shown, ruled_out = _described(tag, match[4] or match[7] or "", article)
            parent = nodes[-1] if nodes else 0
            node = SEED(shown, parent)
            self.children[parent] = SEED(shown, self.children.get(parent, 0))
            boiler, article = boiler or ruled_out, article or tag in ("article", "main")
            stack.append((tag, node, boiler, article))
            nodes = (*nodes, node)
        if at < len(html):
            text.append(html[at:])
        flush()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: Kinds of facts about a node on a page: it is there, one of its texts, its child sequence.
PRESENT, TEXT, CHILDREN = 0, 1, 2
FACTS = "host string, node long, kind int, value long, own double, whole double"


def features(text: str, short: int) -> list[str]:
    """What a block is compared by: its words if they are few, else its clauses."""
    words = text.split(" ")
    return words if len(words) <= short else [piece for piece in CLAUSE.split(text) if piece]


def _facts(batches, short: int):
    """(host, node, kind, value) and the row's shares of a page, once a row."""
    for batch in batches:
        hosts, nodes, kinds, values, owns, wholes = [], [], [], [], [], []
        for host, html, own, whole in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "own", "whole"))):
            page, seen = Page(html or ""), set()
            for text, path, _ in page.blocks:
                node, around = path[-1] if path else 0, path[-2] if len(path) > 1 else 0
                seen.update((node, TEXT, SEED(feature)) for feature in features(text, short))
                seen.add((node, PRESENT, 0))
                seen.add((node, CHILDREN, page.children.get(around, 0)))
            hosts += [host] * len(seen)
            nodes += [_signed(x[0]) for x in seen]
            kinds += [x[1] for x in seen]
            values += [_signed(x[2]) for x in seen]
            owns += [own] * len(seen)
            wholes += [whole] * len(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hosts, pa.string()),
                pa.array(nodes, pa.int64()),
                pa.array(kinds, pa.int32()),
                pa.array(values, pa.int64()),
                pa.array(owns, pa.float64()),
                pa.array(wholes, pa.float64()),
            ],
            names=["host", "node", "kind", "value", "own", "whole"],
        )


def _importance(counts: DataFrame, keys: list[str], settings: StyleTree) -> DataFrame:
    """(keys, pages, importance) from (keys, kind, value, n): in how many pages a fact holds."""
    kind = {name: F.col("kind") == k for name, k in (("there", PRESENT), ("text", TEXT), ("child", CHILDREN))}
    log = F.log(F.col("n").cast("double"))
    sums = counts.groupBy(*keys).agg(
        F.max(F.when(kind["there"], F.col("n"))).alias("pages"),
        F.sum(F.when(kind["text"], F.lit(1))).alias("texts"),
        F.sum(F.when(kind["text"], log)).alias("text_logs"),
        F.sum(F.when(kind["child"], F.col("n") * log)).alias("child_logs"),
    )
    log_m = F.log(F.col("pages").cast("double"))
    content = 1 - F.coalesce(F.col("text_logs") / (F.col("texts") * log_m), F.lit(0.0))
    presentation = 1 - F.coalesce(F.col("child_logs") / (F.col("pages") * log_m), F.lit(0.0))
    return sums.select(
        *keys,
        "pages",
        F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(1 - (1 - presentation) * (1 - content)).alias("importance"),
    )


def _nodes_of(batches):
    """(page, host, node) for the nodes of the page's blocks."""
    for batch in batches:
        pages, hosts, nodes = [], [], []
        for page, host, html in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "html"))):
            for node in {path[-1] if path else 0 for _, path, _ in Page(html or "").blocks}:
                pages.append(page)
                hosts.append(host)
                nodes.append(_signed(node))
        yield pa.RecordBatch.from_arrays(
            [pa.array(pages, pa.int64()), pa.array(hosts, pa.string()), pa.array(nodes, pa.int64())],
            names=["page", "host", "node"],
        )


def _text_without(batches, roles: bool):
    """Adds the text of the blocks that are not ruled out and whose node is not in ``gone``."""
    for batch in batches:
        texts = []
        for html, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
            gone = {x % (1 << 64) for x in gone or ()}
            texts.append(
                "\n".join(
                    text
                    for text, path, boiler in Page(html or "").blocks
                    if not (boiler and roles) and (path[-1] if path else 0) not in gone
                )
            )
        kept = [c for c in batch.schema.names if c not in ("html", "gone")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"]
        )


#: Rows of one (host, html) are dealt to so many keys where their copies are not broadcast.
SALTS = 64


def _weighted(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, html, own, whole) and the table behind it: a row's share of its page, on its host and over all hosts."""
    keyed = pages.withColumn("digest", F.xxhash64("html"))
    groups = written(keyed.groupBy("host", "digest").agg(F.count("*").alias("rows")), "pages")
    alike = groups.groupBy("digest").agg(F.sum("rows").alias("all_rows")).where("all_rows > 1")
    copies = written(
        groups.join(alike, "digest").select("host", "digest", (1 / F.col("rows")).alias("own"), (1 / F.col("all_rows")).alias("whole")),
        "copies",
    )
    drop(pages.sparkSession, groups)
    if copies.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(copies), ["host", "digest"], "left")
    else:
        salted = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.monotonically_increasing_id() % SALTS).join(salted, ["host", "digest", "salt"], "left")
    one = F.lit(1.0)
    return joined.select("host", "html", F.coalesce("own", one).alias("own"), F.coalesce("whole", one).alias("whole")), copies


def low_nodes(pages: DataFrame, settings: StyleTree = StyleTree()) -> DataFrame:
    """(host, node) of the low-importance nodes of each host's tree, from (host, html)."""
    weighted, copies = _weighted(pages)
    counts = weighted.mapInArrow(partial(_facts, short=settings.short), FACTS).groupBy("host", "node", "kind", "value").agg(
        F.round(F.sum("own")).cast("long").alias("n"), F.sum("whole").alias("whole")
    )
    counts = written(counts, "facts")
    drop(pages.sparkSession, copies)
    total = counts.groupBy("node", "kind", "value").agg(F.round(F.sum("whole")).cast("long").alias("n"))
    everywhere = _importance(total, ["node"], settings)
    own = _importance(counts, ["host", "node"], settings)
    told = everywhere.where(F.col("pages") >= settings.few_pages)
    both = own.join(told.select("node", F.col("importance").alias("elsewhere")), "node")
    borrowed = F.lit(float(settings.borrowed))
    blended = (F.col("pages") * F.col("importance") + borrowed * F.col("elsewhere")) / (F.col("pages") + borrowed)
    low = written(both.where(blended < settings.threshold).select("host", "node"), "low")
    drop(pages.sparkSession, counts)
    return low


#: Rows get the low nodes of their whole host while no host has more of them; beyond that, those of their own page.
HOST_NODES = 1000


def _with_own_nodes(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Adds to each row the low nodes that its page has."""
    nodes = rows.select("page", "host", "html").mapInArrow(_nodes_of, "page long, host string, node long")
    gone = written(
        sized_join(nodes, low, ["host", "node"], "left_semi").groupBy("page").agg(F.collect_set("node").alias("gone")), "gone"
    )
    few = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    return rows.join(F.broadcast(gone) if few <= BROADCAST_ROWS else gone, "page", "left")


def extract_text(pages: DataFrame, settings: StyleTree = StyleTree()) -> DataFrame:
    """(page_id, url, text) of every row.

    Null and empty pages have the empty text; pages whose url has no host form one site of their own.
    Equal pages (url and html) share what is left out. Other columns are not kept.
    """
    rows = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)).alias("host"),
        F.xxhash64(F.col("url").cast("string"), F.col("html").cast("string")).alias("page"),
    )
    low = low_nodes(rows.select("host", "html"), settings)
    per_host = low.groupBy("host").agg(F.count("*").alias("n"))
    total, most = per_host.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total <= BROADCAST_ROWS and most <= HOST_NODES:
        joined = rows.join(F.broadcast(low.groupBy("host").agg(F.collect_list("node").alias("gone"))), "host", "left")
    else:
        joined = _with_own_nodes(rows, low)
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    return joined.select("page_id", "url", "html", "gone").mapInArrow(partial(_text_without, roles=settings.roles), schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op2_html_extraction": (op2_html_extraction, None)}
