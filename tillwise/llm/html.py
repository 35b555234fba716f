"""Main text of web pages: the host's repeated passages, with the markup as evidence.

A page is cut into blocks of text; menus, headers, footers, sidebars, notices,
adverts, forms and comments are left out by their markup. The blocks of all
distinct pages of a host form one array of suffixes, ordered by their first ``RUN``
tokens; a run that starts on a ``SHARE`` of the host's distinct pages is repeated,
and neighbouring runs make up the maximal repeated passages.
A block ``COVER`` of whose tokens lie in such passages is boilerplate and goes
whole; other blocks stay whole. Text inside an article (or main) element is held
for main text: only runs on ``MAIN_SHARE`` of the pages, and ``MAIN_PAGES`` at
least, count against it. An article's own header, figures and captions are such text;
elements of it that only their names call a header, notice, widget or search are
judged like text outside. On a page with an article, a block outside of it stays if
it has ``RUN`` tokens.

Suffixes are sorted and counted where the pages lie: a task puts up to ``ROOM`` of
them, by host, in order, and reports those on a ``SHARE`` of its own pages of the
host. A run on that share of all pages has it in one part at least, so none is lost,
and what stands on single pages is never shuffled (but for hosts of which a task
has one or two pages). Reports are added up by host and run; parts that did not
report a run give it a bound, and runs between the bounds are counted once more.
The runs of a host that reach the share are no more than its mean page has tokens,
divided by the share; they are joined to the pages, and each page is judged by itself.

Defined results
* null or empty html: the empty text; null url: a host of its own, the empty one;
* html that breaks off or never closes an element is read to its end;
* passages repeated within one page only are not boilerplate; pages of a host with
  the same blocks count once and get the same text;
* a block of fewer than ``RUN`` tokens counts whole, as a run by itself;
* rows that share a page_id are judged one by one; extra columns are ignored;
* long pages are read whole, in one piece.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch

RUN = 8
SHARE, COVER = 0.5, 0.75
MAIN_SHARE, MAIN_PAGES = 0.9, 5
ROOM = 1 << 21
OUTSIDE, DOUBTFUL, INSIDE = 0, 1, 2
FACTOR, KNOWN = np.uint64(0x9E3779B97F4A7C15), 1_000_000
# Elements whose content is never shown or never text, elements around the text, elements that break it.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "select", "option", "button")
CHROME = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "figure", "object", "label"}
MAIN = {"article", "main"}
OWN = {"header", "figure", "label"}  # of CHROME, those that belong to an article they stand in
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SIGNS = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|sidebar|widget|menu|nav|navbar|navigation|"
    r"breadcrumbs?|header|masthead|footer|comments?|disqus|replies|share|social|related|recommended|newsletter|subscribe|login|search)(?![a-z])"
)
DOUBTS = {"notice", "alert", "widget", "header", "masthead", "login", "search"}  # of SIGNS, those that an article's own elements have too
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
MARKED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page that are not chrome, in order: (text, OUTSIDE, DOUBTFUL or INSIDE of an article or main)."""
    found: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, chrome here, place of its text
    chrome, place = False, OUTSIDE

    def end() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                found.append((text, place))
            held.clear()

    for m in TOKEN.finditer(page or ""):
        text = m["text"] or m["cdata"]
        if text is not None:
            if not chrome:
                held.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if tag == "br":
            held.append(" ")
            continue
        end()
        if m["close"]:
            if any(t == tag for t, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID and not m["rest"].endswith("/"):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()
            here = stack[-1][2] if stack else OUTSIDE
            marks = " ".join("".join(x) for x in MARKED.findall(m["rest"])).lower()
            signs = [] if tag in MAIN or tag in ("html", "body") else SIGNS.findall(marks)
            doubts = here != OUTSIDE and DOUBTS.issuperset(signs)
            odd = tag in CHROME and not (here != OUTSIDE and tag in OWN) or bool(signs) and not doubts
            own = DOUBTFUL if signs or here == DOUBTFUL else here
            stack.append((tag, odd, INSIDE if tag in MAIN and here == OUTSIDE else own))
        chrome, place = any(s[1] for s in stack), stack[-1][2] if stack else OUTSIDE
    end()
    return found


def token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def heads(text: str, run: int, known: dict[str, int]) -> np.ndarray:
    """The suffixes of a block, in order: hashes of their first ``run`` tokens, of the whole block if it has fewer.

    ``known`` holds the hashes of tokens met before, at most ``KNOWN`` of them.
    """
    tokens = text.split(" ")
    if len(known) > KNOWN:
        known.clear()
    for t in tokens:
        if t not in known:
            known[t] = token_hash(t)
    signs = np.array([known[t] for t in tokens], np.uint64)
    size = min(run, len(tokens))
    found = np.zeros(len(tokens) - size + 1, np.uint64)
    for k in range(size):
        found = found * FACTOR + signs[k : k + len(found)]
    return found.view(np.int64)


def covered(found: np.ndarray, repeated: set[int], n: int, run: int) -> int:
    """How many of a block's ``n`` tokens lie in repeated runs."""
    total = end = 0
    for i, h in enumerate(found.tolist()):
        if h in repeated:
            stop = min(i + run, n)
            total += stop - max(i, end)
            end = stop
    return total


def cut(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to page_id, url, blocks, inside (where each block stands)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [blocks(page) for page in batch.column(2).to_pylist()]
            texts = pa.array([[t for t, _ in page] for page in got], pa.list_(pa.string()))
            inside = pa.array([[m for _, m in page] for page in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, inside], ["page_id", "url", "blocks", "inside"])

    return pages.mapInArrow(work, f"page_id {dict(pages.dtypes)['page_id']}, url string, blocks array<string>, inside array<int>")


def reports(pages: DataFrame, run: int, room: int) -> DataFrame:
    """(host, blocks) to rows host, head, n, slack.

    A task's suffixes, up to ``room`` of them, make a part. A host's part of g pages gives
    a row without head (n: g) and one for each head on a SHARE of them (n: on how many).
    ``slack`` is the most pages that a head has there without being reported.
    """

    def report(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for host, found in held.items():
            need = math.ceil(len(found) * SHARE)
            head, n = np.unique(np.concatenate(found), return_counts=True)
            head, n = head[n >= need], n[n >= need]
            size = len(head) + 1
            new = (np.full(size, host), np.append(head, 0), np.append(n, len(found)), np.full(size, need - 1), np.arange(size) == size - 1)
            for column, x in zip(columns, new):
                column.append(x)
        host, head, n, slack, whole = (np.concatenate(c) for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(host), pa.array(head, mask=whole), pa.array(n), pa.array(slack)], ["host", "head", "n", "slack"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held: dict[int, list[np.ndarray]] = {}
        total = 0
        for batch in batches:
            for host, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.unique(np.concatenate([heads(t, run, known) for t in texts]))
                held.setdefault(host, []).append(found)
                total += len(found)
                if total >= room:
                    yield report(held)
                    held, total = {}, 0
        if held:
            yield report(held)

    return pages.select("host", "blocks").mapInArrow(work, "host long, head long, n long, slack long")


def recount(pages: DataFrame, run: int) -> DataFrame:
    """(host, blocks, open) to rows host, head: the open heads that each page has."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for host, texts, asked in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = np.intersect1d(np.concatenate([heads(t, run, known) for t in texts]), np.array(asked, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), host)), pa.array(found)], ["host", "head"])

    return pages.select("host", "blocks", "open").mapInArrow(work, "host long, head long")


def repeated_runs(parts: DataFrame, scratch: Scratch, run: int = RUN, room: int = ROOM) -> DataFrame:
    """Rows host, weak, strong: heads on enough of the host's distinct pages to count outside and inside of main text."""
    some = parts.where(F.size("blocks") > 0)
    distinct = scratch.keep(some.groupBy("host", "sig").agg(F.min("row").alias("kept"), F.count("*").alias("n")), "distinct")
    copies = some.select("host", "sig", "row").join(distinct.where("n > 1"), ["host", "sig"]).where("row <> kept").select("row")
    copies = scratch.keep(copies, "copies")
    pages = scratch.keep(distinct.groupBy("host").agg(F.count("*").alias("pages")).where("pages > 1"), "hosts")
    some = some.join(copies, "row", "left_anti").join(pages, "host", "left_semi")
    told = scratch.keep(reports(some, run, room), "reports")
    hosts = pages.join(told.where("head is null").groupBy("host").agg(F.sum("slack").alias("room")), "host")
    met = told.where("head is not null").groupBy("host", "head").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack")).join(hosts, "host")
    wanted = [F.greatest(F.ceil(F.col("pages") * SHARE), F.lit(2)), F.greatest(F.ceil(F.col("pages") * MAIN_SHARE), F.lit(MAIN_PAGES))]
    most = F.col("n") + F.col("room") - F.col("slack")
    unsure = F.lit(False)
    for least in wanted:
        unsure = unsure | ((F.col("n") < least) & (most >= least))
    met = scratch.keep(met.where(most >= wanted[0]).select("host", "head", "n", "pages", unsure.alias("open")), "met")
    asked = met.where("open").groupBy("host").agg(F.collect_list("head").alias("open"))
    again = recount(some.join(asked, "host"), run).groupBy("host", "head").agg(F.count("*").alias("n")).join(pages, "host")
    met = met.where("not open").select("host", "head", "n", "pages").union(again.select("host", "head", "n", "pages")).where(F.col("n") >= wanted[0])
    return met.groupBy("host").agg(F.collect_list("head").alias("weak"), F.collect_list(F.when(F.col("n") >= wanted[1], F.col("head"))).alias("strong"))


def judge(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(page_id, url, blocks, inside, weak, strong) to page_id, url, text."""

    def text_of(texts: list[str], inside: list[int], weak: set[int], strong: set[int], known: dict[str, int]) -> str:
        kept = []
        for text, place in zip(texts, inside):
            n = text.count(" ") + 1
            if place == OUTSIDE and n < run and any(inside):
                continue
            repeated = strong if place == INSIDE else weak
            if not repeated or covered(heads(text, run, known), repeated, n, run) < COVER * n:
                kept.append(text)
        return " ".join(kept)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            texts = [text_of(t, inside, set(weak or ()), set(strong or ()), known) for t, inside, weak, strong in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    pages = pages.select("page_id", "url", "blocks", "inside", "weak", "strong")
    return pages.mapInArrow(work, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, room: int = ROOM) -> DataFrame:
    """Rows page_id, url, text: one for each page."""
    scratch = Scratch(pages.sparkSession, "html")
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    own = cut(own).withColumns({"host": F.xxhash64(host), "sig": F.xxhash64("blocks"), "row": F.monotonically_increasing_id()})
    parts = scratch.keep(own, "blocks")
    return judge(parts.join(scratch.keep(repeated_runs(parts, scratch, run, room), "runs"), "host", "left"), run)
