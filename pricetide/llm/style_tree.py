"""Main text of pages by a site style tree: importance of presentation and content over the pages of a host."""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import stored

# Branches of less importance are removed.
LEAST_IMPORTANCE = 0.5
# A host of so many pages has as much say about its branches as all hosts together have.
HOST_PAGES = 100

# Elements further down belong to the node at this depth.
DEEPEST = 40

# Fixed values of HTML: elements without content, with raw content, and inside a line; what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"},
}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split())

# Elements, roles and words of class or id that name a part around an article.
APART = frozenset("head nav footer aside form button select menu dialog svg canvas object audio video map script style textarea title noscript template iframe xmp".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disclaimer disqus footer header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# Inside an article a class sets a part apart only if it has no other words than these, and an id only for readers' comments:
# there, ids name places in the text.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
PART_WORDS = frozenset("area bar block body box button buttons container content form inner item items link links list outer section thread title wrap wrapper".split())

# Quotes open a value only behind an equals sign.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
RAW_END = {tag: re.compile(f"</{tag}\\b[^>]*>", re.I) for tag in RAW}


def branches(path: str) -> list[str]:
    """The paths from the root down to this one."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(2, len(parts) + 1)]


def named_apart(path: str) -> list[str]:
    """The branches of a path that only their names set apart."""
    return [b for b in branches(path) if b.rsplit("/", 1)[1].startswith("?")] if "/?" in path else []


class Page:
    """The blocks of text of a page in order, as (path, text), and the children of each node, as (path, labels).

    A path lists the labels of the elements from the root: tag, classes and id, with digits as 0; elements inside a
    line are no part of it. The label of an element apart from the article starts with "!", or with "?" if only a word
    of its class or id says so or it is a form: `around` has those of the latter that the outermost article or main
    is in, and `has_article` tells whether there is one.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []
        self.children: list[tuple[str, list[str]]] = []
        self.stack: list[tuple[str, str, list[str]]] = [("", "", [])]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.around: set[str] = set()
        self.has_article = False
        at = 0
        while match := TAG.search(source, at):
            self.text.append(source[at : match.start()])
            at = match.end()
            closing, tag, attributes = match[1], match[2], match[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in INLINE:
                continue
            if tag in VOID:
                self.text.append(" ")
                if tag in CLOSES_P:
                    self.flush()
                    self.close({"p"})
            elif closing:
                if self.open.get(tag):
                    self.flush()
                    self.end(tag)
            else:
                self.flush()
                self.start(tag, attributes)
                if tag in RAW:
                    end = RAW_END[tag].search(source, at)
                    stop, after = (end.start(), end.end()) if end else (len(source), len(source))
                    self.text.append(source[at:stop])
                    self.flush()
                    self.end(tag)
                    at = after
        rest = source[at:]
        broken = re.search(r"<[a-zA-Z!/?][^<>]*\Z", rest)
        self.text.append(rest[: broken.start()] if broken else rest)
        self.flush()
        while self.stack:
            self.pop()

    def flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            if text:
                self.blocks.append((self.stack[-1][1], text))

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.close({"p"})
        if tag in CLOSED_BY:
            self.close(CLOSED_BY[tag])
        label, comment = self.label(tag, attributes)
        above = self.stack[-1][1]
        if tag in ("article", "main") and not comment and "/!" not in above and not (self.open.get("article") or self.open.get("main")):
            self.has_article = True
            self.around.update(named_apart(above))
        self.stack[-1][2].append(label)
        deeper = len(self.stack) <= DEEPEST or (label[0] == "!" and "/!" not in above) or (label[0] == "?" and above.count("/") < 2 * DEEPEST)
        self.stack.append((tag, f"{above}/{label}" if deeper else above, []))
        self.open[tag] = self.open.get(tag, 0) + 1

    def label(self, tag: str, attributes: str) -> tuple[str, bool]:
        """The label of an element, and whether a class or id begins with a word for a part around an article."""
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes or ""):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of a name counts
        names = " ".join(found.get(k, "") for k in ("class", "id")).lower().split()
        in_article = self.open.get("article") or self.open.get("main")
        role = found.get("role", "").lower()
        apart = (
            (tag in APART and tag != "form") or (tag == "header" and not in_article) or (role in APART_ROLES and role != "form")
            or "hidden" in found or found.get("aria-hidden", "").lower() == "true")
        named = tag == "form" or role == "form"
        if in_article:
            parts = [set(re.split(r"[-_0-9]+", n)) - {""} for n in found.get("class", "").lower().split()]
            ids = [set(re.split(r"[-_0-9]+", n)) - {""} for n in found.get("id", "").lower().split()]
            named = named or any(p & (APART_WORDS - {"header"}) and p <= APART_WORDS | PART_WORDS for p in parts) or any(
                p & COMMENT_WORDS and p <= COMMENT_WORDS | PART_WORDS for p in ids)
        else:
            words = {w for n in names for w in re.split(r"[-_0-9]+", n)} | set(names)
            named = named or bool(words & APART_WORDS)
        if tag in ("html", "body", "main", "article"):
            apart = named = False
        sign = "!" if apart else "?" if named else ""
        comment = any(re.split(r"[-_0-9]+", n)[0] in APART_WORDS for n in names)
        return sign + re.sub("[0-9]+", "0", ".".join([tag, *names])).replace("/", "_"), comment

    def close(self, tags: set[str]) -> None:
        """End the innermost elements of these kinds, up to the next list, table or part of the page."""
        while len(self.stack) > 1 and self.stack[-1][0] in tags:
            self.pop()

    def end(self, tag: str) -> None:
        while self.stack[-1][0] != tag:
            self.pop()
        self.pop()

    def pop(self) -> None:
        tag, path, labels = self.stack.pop()
        if tag:
            self.open[tag] -= 1
        if labels:
            self.children.append((path, labels))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


STYLE, CONTENT, PAGES = 0, 1, 2


def tree(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, pages, weight): of each node of a host's merged tree the styles (sequences of
    children) and texts it has, on how many pages each, and of how many characters; and on how many pages it has text.

    Pages of a host with the same blocks of text are one page, however many rows they are: copies say nothing about a
    template. On several hosts a page counts once on each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for site, source in zip(pdf.host, pdf.html, strict=True):
                page = Page(source)
                blocks = "\0".join(part for block in page.blocks for part in block)
                digest = xxhash.xxh3_128_digest(blocks.encode("utf-8", "surrogatepass"))
                seen: dict[tuple[str, int, int], int] = {}
                for path, text in page.blocks:
                    key = (path, CONTENT, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
                    seen[key] = seen.get(key, 0) + len(text)
                    seen[path, PAGES, 2**63] = 1
                for path, labels in page.children:
                    key = (path, STYLE, xxhash.xxh3_64_intdigest(" ".join(labels).encode("utf-8", "surrogatepass")))
                    seen[key] = seen.get(key, 0) + 1
                found = [(path, kind, feature - 2**63, weight) for (path, kind, feature), weight in seen.items()]
                rows.append((site, digest, zlib.compress(pickle.dumps(found))))
            yield pd.DataFrame(rows, columns=["host", "page", "found"])

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(site, *f) for site, found in zip(pdf.host, pdf.found, strict=True) for f in pickle.loads(zlib.decompress(found))]
            yield pd.DataFrame(rows, columns=["host", "path", "kind", "feature", "weight"])

    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    once = rows.mapInPandas(run, "host string, page binary, found binary").groupBy("host", "page").agg(F.min("found").alias("found"))
    found = once.select("host", "found").mapInPandas(opened, "host string, path string, kind int, feature long, weight long")
    return found.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("pages"), F.sum("weight").alias("weight"))


def importance(features: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, m, importance) of each node from the pages its styles and texts are on, m: pages of the node.

    Presentation: the entropy of the node's styles over its pages, to the base m. Content: a text that is on c of m
    pages has the entropy log c / log m, so it says 1 minus that; texts weigh by their characters, and a node has the
    mean over all texts below it. The larger of the two counts. On a single page both are 1.
    """
    sums = features.groupBy(*keys, "kind", "feature").agg(F.sum("pages").alias("c"), F.sum("weight").alias("weight"))
    total = sums.groupBy(*keys, "kind").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("c_log_c"), F.sum("weight").alias("weight"),
        F.sum(F.col("weight") * F.log("c")).alias("w_log_c"), F.max("c").alias("most"))
    style = total.filter(F.col("kind") == STYLE).withColumn(
        "style", F.when(F.col("n") > 1, F.log("n") - F.col("c_log_c") / F.col("n")).otherwise(F.lit(1.0)) / F.greatest(F.log("n"), F.lit(1e-9)))
    style = style.select(*keys, F.when(F.col("n") > 1, F.col("style")).otherwise(1.0).alias("style"), F.col("n").alias("m_style"))
    # Texts of a node are those of the nodes below it: each leaf's sums go to all nodes on its path.
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    on_pages = total.filter(F.col("kind") == PAGES).select(*keys, F.col("n").alias("m"))
    leaf = total.filter((F.col("kind") == CONTENT) & (F.col("path") != "")).drop("n").join(on_pages, keys)
    heard = F.when(F.col("m") > 1, F.col("weight") - F.col("w_log_c") / F.log("m")).otherwise(F.col("weight"))
    content = leaf.withColumn("heard", heard).withColumn("path", F.explode(above)).groupBy(*keys).agg(
        (F.sum("heard") / F.sum("weight")).alias("content"), F.max("m").alias("m_content"))
    both = content.join(style, keys, "left")
    return both.select(
        *keys, F.greatest("m_content", F.coalesce("m_style", F.lit(0))).alias("m"), F.greatest("content", F.coalesce("style", F.lit(0.0))).alias("importance"))


def low_branches(pages: DataFrame, least: float = LEAST_IMPORTANCE, host_pages: int = HOST_PAGES) -> DataFrame:
    """(host, paths): the branches of each host whose importance is below `least`.

    A host of m pages is believed to m / (m + host_pages); for the rest the same path on all hosts counts, so that a
    host of a few pages is not taken for a site where everything is unique.
    """
    features = stored(tree(pages))
    own = importance(features, ["host", "path"])
    common = importance(features, ["path"]).select("path", F.col("importance").alias("common"))
    share = F.col("m") / (F.col("m") + host_pages)
    mixed = own.join(common, "path").withColumn("importance", share * F.col("importance") + (1 - share) * F.col("common"))
    low = mixed.filter(F.col("importance") < least)
    return low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def main_text(source: str, low: set[str]) -> str:
    """The blocks of a page outside removed branches: unimportant ones, and those apart from the article.

    A branch that only its name sets apart stays where the outermost article or main is in it. On a page that has
    neither, it stays if it holds more than half of the characters that are left without regard to such names.
    """
    page = Page(source)
    named: dict[str, list[str] | None] = {}  # None: removed in any case
    held: Counter[str] = Counter()
    total = 0
    for path, text in page.blocks:
        if path not in named:
            gone = "/!" in path or path in low or any(b in low for b in branches(path))
            named[path] = None if gone else named_apart(path)
        if named[path] is not None:
            total += len(text)
            for branch in named[path]:
                held[branch] += len(text)
    stay = page.around if page.has_article else {b for b, n in held.items() if 2 * n > total}
    return " ".join(text for path, text in page.blocks if named[path] is not None and stay.issuperset(named[path]))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`.

    Null html is empty; a page without text, or without anything important, gives an empty text. A null or odd url
    makes a page one of the host "". Repeated rows have results of their own, but the tree counts them once. Other columns are not read.
    """
    # Written first: Spark then knows its size, sends it to the pages if it is small, and can split a large host if not.
    low = stored(low_branches(pages))
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    joined = keyed.join(low, "host", "left").select("page_id", "url", "html", F.coalesce("paths", F.expr("cast(array() as array<string>)")).alias("paths"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in batches:
            yield pd.Series([main_text(s, set(p)) for s, p in zip(sources, paths, strict=True)], dtype=object)

    text = F.pandas_udf(run, "string")(F.col("html"), F.col("paths"))
    made = joined.select("page_id", "url", text.alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
