"""Main text by the host's repeated passages, against a count of all strings; what belongs to an article."""

import collections

import numpy as np
import pytest

from tillwise.llm.common import Scratch
from tillwise.llm.html import COVER, RUN, SHARE, blocks, main_text, repeated_runs

PAGES = "page_id long, url string, html string"


def plain_text(pages):
    """{page_id: text} of pages of <div> blocks: blocks whose tokens lie in strings that half of the host's distinct pages hold are left out."""
    cut = {i: (url.split("/")[2], [" ".join(b.split("</div>")[0].split()) for b in html.split("<div>")[1:]]) for i, url, html in pages}
    distinct = collections.defaultdict(set)
    for host, parts in cut.values():
        distinct[host].add(tuple(parts))

    def strings(part):
        words = part.split(" ")
        return [tuple(words[k : k + RUN]) for k in range(max(1, len(words) - RUN + 1))]

    met = {host: collections.Counter(s for page in some for s in {s for part in page for s in strings(part)}) for host, some in distinct.items()}
    out = {}
    for i, (host, parts) in cut.items():
        kept = []
        for part in parts:
            n, on = len(part.split(" ")), set()
            for k, s in enumerate(strings(part)):
                if met[host][s] >= max(2, SHARE * len(distinct[host])):
                    on |= set(range(k, k + len(s)))
            if len(on) < COVER * n:
                kept.append(part)
        out[i] = " ".join(kept)
    return out


@pytest.fixture(scope="module")
def marked_by_nothing():
    """Pages without article elements or names; menus of several lengths on some tenths of a host's pages, a hot host, copies, small hosts."""
    rng = np.random.default_rng(3)
    menus = [" ".join(f"m{k}w{i}" for i in range(n)) for k, n in enumerate((3, 8, 9, 20, 40))]
    pages = []
    for i in range(400):
        host = 0 if i < 200 else int(rng.integers(1, 60))
        parts = [" ".join(f"t{rng.integers(0, 40)}" for _ in range(rng.integers(1, 40))) for _ in range(rng.integers(0, 4))]
        for k, menu in enumerate(menus):
            if rng.random() < (0.45, 0.5, 0.55, 0.5, 0.9)[k]:
                extra = f" own{i}" * int(rng.integers(0, 3)) if rng.random() < 0.5 else f" {menus[k - 1]}"
                parts.insert(int(rng.integers(0, len(parts) + 1)), menu + extra)
        pages.append((i, f"http://h{host}.org/{i}", "".join(f"<div>{p}</div>" for p in parts)))
    return pages + [(400 + k, pages[k][1], pages[k][2]) for k in range(30)]


@pytest.mark.parametrize("room", [1, 300, 1 << 21])
def test_main_text_without_markup_by_brute_force(spark, marked_by_nothing, room):
    """Parts of one page, of a few, and of all pages of a task give the same texts."""
    frame = spark.createDataFrame(marked_by_nothing, PAGES).repartition(3)
    got = {r["page_id"]: r["text"] for r in main_text(frame, room=room).collect()}
    want = plain_text(marked_by_nothing)
    assert got == want
    whole = {i: " ".join(t for t, _ in blocks(html)) for i, _, html in marked_by_nothing}
    assert sum(want[i] != whole[i] for i in want) > 100  # the host decides


def test_hot_host_reports_few_rows(spark):
    """Text that single pages have is not reported, let alone shuffled."""
    pages = [(i, [" ".join(f"p{i}w{k}" for k in range(50)), " ".join(f"m{k}" for k in range(12))]) for i in range(300)]
    parts = spark.createDataFrame([(i, 1, i, b) for i, b in pages], "row long, host long, sig long, blocks array<string>").coalesce(2)
    scratch = Scratch(spark, "test")
    runs = repeated_runs(parts, scratch).collect()
    assert [(r["host"], len(r["weak"]), len(r["strong"])) for r in runs] == [(1, 5, 5)]
    told = next(path for path in scratch.paths.values() if path.endswith("reports"))
    assert spark.read.parquet(told).count() <= 2 * 6


def test_an_article_keeps_what_is_its_own(spark):
    def page(i):
        return (
            f'<nav>menu</nav><article><header class="page-header"><h1>Title {i}</h1></header><p>Body of page number {i} in some words</p>'
            f'<figure><img src=x><figcaption>Caption {i}</figcaption></figure><div class="notice">Note {i} of its own</div><div class="notice share">no</div>'
            '<div class="notice">This site uses many small files that it puts on your machine</div>'
            f'<section id="search-results">Found {i}</section><div class="comments"><p>Me too</p></div></article><footer>end</footer>'
        )

    pages = [(i, f"http://a.org/{i}", page(i)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {i: f"Title {i} Body of page number {i} in some words Caption {i} Note {i} of its own Found {i}" for i in range(4)}


def test_odd_pages(spark):
    """Null ids, rows that share an id, clashing extra columns, a text of over a million characters."""
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, "http://a.org", "<p>one</p>", "x", 1), (7, "http://b.org", f"<p>{long}</p>", "y", 2), (7, "http://c.org", "<p>two", None, 3), (None, None, None, "z", 4)]
    frame = spark.createDataFrame(rows, PAGES + ", text string, host long")
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in main_text(frame).collect()), key=str)
    assert got == sorted([(None, "http://a.org", "one"), (7, "http://b.org", long), (7, "http://c.org", "two"), (None, None, "")], key=str)
