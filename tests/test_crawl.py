"""The crawl plan against a plain queue, site by site."""

import random
import re
from collections import deque
from urllib.parse import urlparse

import pytest

from docflow.operators import graph
from docflow.plans import crawl as plan

SITE = "name string, base_url string, max_pages int, max_depth int, allow_path_regex string, deny_query_regex string, start_pages array<string>"


def host(url):
    return re.sub("^www\\.", "", urlparse(url).netloc.lower())


def walked(site, pages, links, strict):
    """Visits in order with depth, and counters by page, of one site."""
    _, base, most, deepest, allow, deny, starts = site
    queue = deque((u, 0) for u in dict.fromkeys(starts))
    met, visits, counters, written = set(starts), [], {}, 0
    while queue and written < most and deepest >= 0:
        url, depth = queue.popleft()
        saved = bool(pages.get(url)) and (allow is None or re.search(allow, urlparse(url).path) is not None)
        visits.append((url, depth, url in pages, saved))
        written += saved
        if url not in pages or depth >= deepest:
            continue
        total = same = deny_q = deny_path = enqueued = 0
        for _, dst in sorted(links.get(url, [])):
            total += 1
            if dst in met or not (urlparse(dst).netloc == "" or host(dst) == host(base)):
                continue
            same += 1
            if deny and re.search(deny, urlparse(dst).query):
                deny_q += 1
            elif not (re.search(allow, urlparse(dst).path) if allow else not strict):
                deny_path += 1
            else:
                met.add(dst)
                queue.append((dst, depth + 1))
                enqueued += 1
        if total:
            counters[url] = (total, same, deny_q, deny_path, enqueued)
    return visits, counters


def sample(seed):
    rng = random.Random(seed)
    urls = [f"https://{'www.' * (k % 5 == 0)}s{s}.org/{rng.choice('abc')}/{k}{rng.choice(['', '?p=1', '?q=2'])}" for s in range(4) for k in range(40)]
    pages = {u: rng.random() < 0.7 for u in urls if rng.random() < 0.9}
    links = {}
    for u in urls:
        targets = rng.sample(urls, rng.randint(0, 6)) + [urls[0]] * (rng.random() < 0.5)  # one page that many link to
        links[u] = list(enumerate(dict.fromkeys(targets)))
    sites = [
        (f"site{s}", f"https://s{s}.org", rng.choice([1, 4, 15, 500]), rng.choice([0, 1, 3, 6]), rng.choice([None, "^/[ab]/", "^/"]),
         rng.choice([None, "p=", "[pq]="]), rng.sample(urls[s * 40 : s * 40 + 40], 3) + ["https://s0.org/none"])
        for s in range(4)
    ]
    sites.append(("site0", "https://s0.org", 3, 2, None, None, [urls[1], urls[1], urls[2]]))  # the same site by other rules
    return sites, pages, links


@pytest.mark.parametrize("seed,strict", [(1, False), (2, True), (3, False)])
def test_equals_a_queue(spark, monkeypatch, seed, strict):
    monkeypatch.setattr(plan, "PARTS", 3)
    sites, pages, links = sample(seed)
    seeds = graph.seed_urls(spark.createDataFrame(sites, SITE))
    stored = spark.createDataFrame([*pages.items(), next(iter(pages.items()))], "url string, useful boolean")
    edges = spark.createDataFrame([(u, p, d) for u, out in links.items() for p, d in out], "src string, pos int, dst string")
    got = plan.crawl(seeds, stored, edges, strict_compat=strict)
    want = [walked(s, pages, links, strict) for s in sites]
    rows = got.visits.collect()
    assert len({r.key for r in rows}) == len(sites)
    mine = {}
    for r in sorted(rows, key=lambda r: (r.depth, r.place)):
        mine.setdefault(r.key, []).append((r.url, r.depth, r.stored, r.saved))
    assert sorted(map(str, mine.values())) == sorted(str(v) for v, _ in want)
    counts = {}
    for r in got.counters.collect():
        counts.setdefault(r.key, {})[r.url] = (r.total, r.same_host, r.deny_q, r.deny_path, r.enqueued)
    assert sorted(str(sorted(c.items())) for c in counts.values()) == sorted(str(sorted(c.items())) for _, c in want if c)
    summary = sorted((r.site, r.written, r.seen) for r in got.sites.collect())
    assert summary == sorted((s[0], sum(v[3] for v in visits), len(visits)) for s, (visits, _) in zip(sites, want, strict=True))


def test_no_sites_no_links(spark):
    none = spark.createDataFrame([], SITE)
    pages = spark.createDataFrame([("https://a.org/", True)], "url string, useful boolean")
    links = spark.createDataFrame([], "src string, pos int, dst string")
    got = plan.crawl(graph.seed_urls(none), pages, links)
    assert got.visits.count() == got.counters.count() == got.sites.count() == 0
    one = spark.createDataFrame([("a", "https://a.org", 5, 2, None, None, ["https://a.org/"])], SITE)
    got = plan.crawl(graph.seed_urls(one), pages, links)
    assert [(r.url, r.saved) for r in got.visits.collect()] == [("https://a.org/", True)] and got.counters.count() == 0


def test_place_of_links_in_a_page(spark):
    from docflow.operators import pages

    html = '<a href="/b">x</a><a href="/a">y</a><a href="/b#z">z</a>'
    rows = pages.outlinks(pages.parse_pages(spark.createDataFrame([(1, "http://h.org/", html)], "page_id int, url string, html string")), place="pos")
    assert sorted((r.pos, r.target) for r in rows.collect()) == [(0, "http://h.org/b"), (1, "http://h.org/a")]
