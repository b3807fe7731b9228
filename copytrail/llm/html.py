"""HTML extraction: template deduction by equivalence classes of tokens, and the text of the slot that holds the article."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copytrail.llm.common import written
from copytrail.llm.urlfilter import host_of

#: An equivalence class is a template's if it has so many tokens and stands on this share of a host's pages.
MIN_TOKENS = 3
MIN_SHARE = 0.5
#: Hosts with fewer pages have no template of their own; they use that of all pages together.
MIN_PAGES = 5
POOL = "*"
FLUSH = 100_000

CONTAINERS = set("html head body div section article main nav header footer aside ul ol dl table tbody thead tr form fieldset figure menu dialog details".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote address figcaption caption hr legend summary title center".split())
#: Their content is no text, or text of a control.
RAW = "script|style|noscript|template|textarea|select|svg|math|iframe|object|button|canvas|audio|video"
NOT_ARTICLE = set("head nav header footer aside form menu dialog".split())
ARTICLE = ("article", "main")
#: Parts of class, id and role values that name something other than the article.
NOT_ARTICLE_NAMES = re.compile(
    r"^(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|comments?|commentlist|replies|disqus|sidebar|widget|"
    r"related|recommended|share|sharing|social|menu|nav|navbar|navigation|breadcrumbs?|pagination|header|masthead|footer|copyright|complementary|contentinfo|search|login)$")
ARTICLE_ROLE = re.compile(r"""\brole\s*=\s*["']?(main|article)\b""", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>" + RAW + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*)>?|(?P<text>[^<]+|<)""", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Page:
    """One page walked in order: its token counts, the text below each container, and its blocks with their paths."""

    def __init__(self, source: str):
        self.tokens: dict[tuple[str, str], int] = {}
        self.chars: dict[str, int] = {}
        self.blocks: list[tuple[tuple[str, ...], str]] = []
        # Tag, path, whether it is outside the article by its own name or an ancestor's, paths of all open containers.
        stack: list[tuple[str, str, bool, tuple[str, ...]]] = [("", "", False, ("",))]
        parts: list[str] = []

        def flush() -> None:
            if parts:
                _, path, outside, paths = stack[-1]
                if not outside and (text := " ".join(html.unescape("".join(parts)).split())):
                    self.blocks.append((paths, text))
                    self.chars[path] = self.chars.get(path, 0) + len(text)
                parts.clear()

        for m in TOKEN.finditer(source):
            if m.lastgroup == "text":
                parts.append(m[0])
                continue
            if m.lastgroup != "rest":  # a comment, or an element without text
                continue
            tag = m["tag"].lower()
            if tag == "br":
                parts.append(" ")
            if tag not in BLOCKS:
                continue
            flush()
            if tag not in CONTAINERS:
                self._count(stack[-1][1], f"{m['end']}{tag}")
            elif m["end"]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    self._count(stack[depth - 1][1], "/" + stack[depth][1].rpartition(">")[2])
                    del stack[depth:]
            else:
                values = [a or b or c for a, b, c in NAMES.findall(m["rest"])] if m["rest"] else []
                label = tag + "".join("." + v.lower() for v in sorted(" ".join(values).split()))
                named = any(NOT_ARTICLE_NAMES.match(p.lower()) for v in values for p in PART.split(v))
                role = tag if tag in ARTICLE else "main" if ARTICLE_ROLE.search(m["rest"] or "") else tag
                self._count(stack[-1][1], label)
                path = f"{stack[-1][1]}>{label}" if role == tag else f"{stack[-1][1]}>{label}:main"
                stack.append((tag, path, stack[-1][2] or tag in NOT_ARTICLE or named, (*stack[-1][3], path)))
        flush()

    def _count(self, path: str, label: str) -> None:
        key = (path, label)
        self.tokens[key] = self.tokens.get(key, 0) + 1

    def main(self) -> str | None:
        """Without a template: the container that holds the article by its name, else the one with most text of its own."""
        named = [p for p in {p for path, _ in self.blocks for p in path} if _is_article(p)]
        if named:
            return min(named, key=lambda p: (p.count(">"), p))
        return max(sorted(self.chars), key=lambda p: self.chars[p], default=None)

    def text(self, slot: str | None) -> str:
        """The blocks below the slot, in page order; where the page has no text there, those of its own main container."""
        found = [text for path, text in self.blocks if slot in path]
        if not found:
            slot = self.main()
            found = [text for path, text in self.blocks if slot in path]
        return "\n".join(found)


def _is_article(path: str) -> bool:
    last = path.rpartition(">")[2]
    return last.endswith(":main") or last.split(".", 1)[0] in ARTICLE


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, path, token, vector, pages, times, chars): each token's occurrence vector over the pages of its host and of all
    hosts together, folded to one number: tokens with equal vectors have equal numbers. Tasks add up their own pages first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], list[int]] = {}

        def rows() -> pa.RecordBatch:
            keys, values = zip(*sums.items(), strict=True)
            numbers = np.array(values, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in zip(*keys, strict=True)), *(pa.array(numbers[:, i].copy()) for i in range(4))],
                                              names=["host", "path", "token", "vector", "pages", "times", "chars"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                number = xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass"))
                page.tokens[("", "")] = 1  # stands for the page itself
                for (path, token), times in page.tokens.items():
                    mark = xxhash.xxh64_intdigest(times.to_bytes(8), number)
                    chars = page.chars.get(f"{path}>{token}", page.chars.get(f"{path}>{token}:main", 0))
                    for key in ((host, path, token), (POOL, path, token)):
                        own = sums.setdefault(key, [0, 0, 0, 0])
                        own[0] ^= mark
                        own[1] += 1
                        own[2] += times
                        own[3] += chars
                if len(sums) > FLUSH:
                    yield rows()
                    sums = {}
        if sums:
            yield rows()

    parts = pages.mapInArrow(run, "host string, path string, token string, vector long, pages long, times long, chars long")
    return parts.groupBy("host", "path", "token").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.sum("chars").alias("chars"))


def templates(tokens: DataFrame) -> DataFrame:
    """(host, slot): the slot of each host's template that holds the article.

    Tokens with equal vectors on enough pages make a class; a class is valid if it is large enough and its tokens nest in
    the template, that is, stand directly in a container that belongs to a valid class as well. Of the containers that every
    page has once, the slot is the outermost one named as an article, else the one with most text of its own.
    """
    sizes = tokens.filter("token = ''").select("host", F.col("pages").alias("host_pages"))
    often = tokens.join(sizes, "host").filter(F.col("pages") >= F.col("host_pages") * MIN_SHARE)
    large = often.groupBy("host", "vector", "pages", "times").agg(F.count("*").alias("size")).filter(F.col("size") >= MIN_TOKENS)
    classed = often.join(large, ["host", "vector", "pages", "times"])
    opened = classed.select("host", F.concat("path", F.lit(">"), "token").alias("path")).distinct()
    inside = classed.filter("path = ''").unionByName(classed.join(opened, ["host", "path"], "left_semi"))
    full = F.concat("path", F.lit(">"), "token")
    last = F.substring_index(F.substring_index("token", ".", 1), ":", 1)
    once = inside.filter((F.col("times") == F.col("pages")) & (last.isin(*CONTAINERS)) & ~F.col("token").startswith("/"))
    depth = F.length("path") - F.length(F.replace("path", F.lit(">")))
    order = Window.partitionBy("host").orderBy(last.isin(*ARTICLE).desc(), F.when(last.isin(*ARTICLE), depth), F.desc("chars"), full)
    return once.withColumn("r", F.row_number().over(order)).filter("r = 1").select("host", full.alias("slot"), "host_pages")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    A host's pages share a template; its classes show which container's slot the article fills, and every block in it is
    text, save for elements in it whose tag or name says that they are none of it. A host with few pages uses the template
    of all pages; a page that does not follow its template, its own structure. A null or empty html gives an empty text.
    Urls that are null or have no host share the empty host. Rows come out one for one.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    found = written(templates(written(occurrences(rows.select("host", "html")), "occurrences")), "templates")
    pool = found.filter(F.col("host") == POOL).select("slot").first()  # one path
    common = pool.slot if pool else None
    own = found.filter((F.col("host") != POOL) & (F.col("host_pages") >= MIN_PAGES)).select("host", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h).text(s or common) for h, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    placed = rows.join(own, "host", "left").select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "slot")
    return placed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
