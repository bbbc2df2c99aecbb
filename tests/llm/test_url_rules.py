import itertools
import random
import re

from hardwood.llm import url_rules
from hardwood.llm.common import Scratch
from tests.llm.helpers import frame, tables

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :]).group()


def listed(host, path):
    fits = [(h + p, v) for h, p, v in url_rules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    "http://Example.ORG/es/1", "https://a.example.org/en/12", "http://example.org/en/2", "http://example.org", "http://notexample.org/es/", "x.com/fr/1", None, "", "http://b.com/fr/?q=1#f", "http://b.com/de/x.html", "ftp://com/de/",
    "http://m.com#/de/", "http://?x", "://h/p", "http://a://b/c", "http://i.net/a/b/c.php?x=1&y=2&x=3", "HTTP://ÄB.org/", "http://q.org\n/x",
]


def test_hosts_paths_and_listed_rules(spark, tmp_path):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[1], None)]
    d = tables(spark, tmp_path, pages=frame(spark, rows, PAGES), labels=frame(spark, [(None, None, None)], LABELS))
    got = url_rules.op5_url_rules(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[1] if r.page_id is None else URLS[r.page_id]
        rule, verdict = listed(*parts(url))
        assert (r.host, r.path, r.rule, r.verdict) == (*parts(url), rule, verdict or "allow")


def test_mined_rules_like_brute_force(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        host, seg, ext = rng.choice("abc"), rng.choice(("x", "y")), rng.choice((".html", ""))
        bad = (host == "a" and seg == "x" and rng.random() < 0.9) or rng.random() < 0.05
        rows.append((i, f"http://{host}.net/{seg}/{i}{ext}", None))
        labels.append((i, int(not bad), 0))
    pages = frame(spark, rows, PAGES)
    labelled = url_rules.labelled_urls(pages, frame(spark, labels, LABELS))
    baskets = [(frozenset(r.tokens), r.bad) for r in labelled.collect()]
    assert len(baskets) == 400
    mined = url_rules.mine_rules(labelled, Scratch(spark, "test"), 0.02, 10, 0.6, 1.1, 1.0)
    rules = {(frozenset(r["items"]), r.bad): (r.confidence, r.support, r.lift) for r in mined.collect()}
    tokens = sorted(set().union(*(b for b, _ in baskets)))
    share = {x: sum(bad == x for _, bad in baskets) / 400 for x in (True, False)}
    want = {}
    for size in range(1, 8):
        for items in map(frozenset, itertools.combinations(tokens, size)):
            have = [bad for b, bad in baskets if items <= b]
            for label in (True, False):
                n = have.count(label)
                p = share[label]
                errors = (n / len(have) - p) * (len(have) / (p * (1 - p))) ** 0.5 if have else 0
                if n >= 10 and n / len(have) >= 0.6 and n / len(have) / p >= 1.1 and errors >= 1:
                    want[items, label] = (n / len(have), n / 400, n / len(have) / share[label])
    assert {bad for _, bad in want} == {True, False}
    # Each wanted combination has a rule that names a part of it, or tokens that go with it, and says the same.
    alike = {t: frozenset(u for u in tokens if all((t in b) == (u in b) for b, _ in baskets)) for t in tokens}
    for (items, bad), figures in want.items():
        named = frozenset().union(*(alike[t] for t in items))
        assert any(b == bad and r <= named and all(abs(x - y) < 1e-9 for x, y in zip(f, figures, strict=True)) for (r, b), f in rules.items())
    for (items, bad), figures in rules.items():
        one = frozenset(min(alike[t]) for t in items)
        assert all(abs(x - y) < 1e-9 for x, y in zip(figures, want[one, bad], strict=True))
        # No smaller combination is in the same URLs.
        rows_of = {x for x, (b, _) in enumerate(baskets) if one <= b}
        assert all({x for x, (b, _) in enumerate(baskets) if one - {t} <= b} != rows_of for t in one)
    blocked = 0
    for r in url_rules.judge(pages, mined).collect():
        fired = [(c[0], bad) for (items, bad), c in want.items() if items <= set(tokens_of(rows[r.page_id][1]))]
        best = max(fired, default=(None, False))
        assert r.verdict == ("block" if best[1] else "allow") and (r.confidence is None) == (not fired)
        assert r.confidence is None or abs(r.confidence - best[0]) < 1e-9
        blocked += r.verdict == "block"
    assert 30 < blocked < 200


def tokens_of(url):
    host, path = parts(url)
    out = ["scheme=http", f"host={host}", f"domain={host}", f"top={host.split('.')[-1]}"]
    out += [f"segment={re.sub('[0-9]+', '0', s)}" for s in path.split("/") if s]
    return out + (["end=html"] if path.endswith(".html") else [])


def test_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path, pages=frame(spark, [], PAGES), labels=frame(spark, [], LABELS))
    assert url_rules.op5_url_rules(spark, d).count() == 0


def test_rules_by_host_label_and_by_count_alone(spark, tmp_path):
    """26 bad pages of 14,000 that share a host label or a parent domain and nothing else are blocked, unlabelled ones too."""
    n, rows = 14_000, []
    for i in range(n):
        bad = "casino" if i < 26 else "parent" if i < 52 else None
        host = {"casino": f"w{i}.casino.d{i}.info", "parent": f"w{i}.shop.host.net", None: f"g{i}.host.net"}[bad]
        rows.append((i, f"http://{host}/{i}", None))
    new = ["http://x.casino.y.com/1000000", "http://shop.host.net/1000000", "http://a.b.shop.host.net/", "http://casino/", "http://x.host.net/1000000", "http://casino.y.com/"]
    pages = frame(spark, [*rows, *((n + i, u, None) for i, u in enumerate(new))], PAGES)
    d = tables(spark, tmp_path, pages=pages, labels=frame(spark, [(i, int(i >= 52), 0) for i in range(n)], LABELS))
    got = {r.page_id: r.verdict for r in url_rules.op5_url_rules(spark, d).collect()}
    assert len(got) == n + len(new) and all((got[i] == "block") == (i < 52) for i in range(n))
    assert [got[n + i] for i in range(len(new))] == ["block", "block", "block", "allow", "allow", "block"]


def test_tokens_that_look_like_labels(spark):
    """A host named bad is no label."""
    pages = frame(spark, [(i, f"http://bad.n.net/{i}", None) for i in range(60)], PAGES)
    labelled = url_rules.labelled_urls(pages, frame(spark, [(i, 1, 0) for i in range(60)], LABELS))
    rules = url_rules.mine_all_rules(labelled, Scratch(spark, "test"))
    assert {r.verdict for r in url_rules.judge(pages, rules).collect()} == {"allow"}


def test_clashing_columns(spark):
    pages = frame(spark, [(1, "http://a.org/es/", None)], PAGES).selectExpr("*", "2 as host", "3 as _row", "4 as _tokens")
    none = url_rules.mine_all_rules(url_rules.labelled_urls(pages, frame(spark, [], LABELS)), Scratch(spark, "test"))
    assert [tuple(r)[:5] for r in url_rules.judge(pages, none).collect()] == [(1, "a.org", "/es/", "org/", "allow")]


def test_urls_that_share_many_tokens(spark):
    """One rule, whatever the number of tokens, named by all of them; each token alone is enough, as it was before."""
    keys = "&".join(f"k{i}=1" for i in range(40))
    pages = frame(spark, [(i, f"http://n{i}.net/{i}" + (f"?{keys}" if i < 30 else ""), None) for i in range(300)], PAGES)
    labelled = url_rules.labelled_urls(pages, frame(spark, [(i, int(i >= 30), 0) for i in range(300)], LABELS))
    rules = url_rules.mine_all_rules(labelled, Scratch(spark, "test")).where("bad").collect()
    assert [len(r["items"]) for r in rules] == [40]
    mined = url_rules.mine_all_rules(labelled, Scratch(spark, "test"))
    new = frame(spark, [(1, "http://x.net/1?k7=2", None), (2, "http://x.net/2?k77=2", None)], PAGES)
    assert {r.page_id: r.verdict for r in url_rules.judge(new, mined).collect()} == {1: "block", 2: "allow"}


def test_repeated_rows_with_many_tokens(spark):
    keys = "&".join(f"k{i}=1" for i in range(30))
    pages = frame(spark, [(i, f"http://a.net/{i % 2}?{keys}", None) for i in range(50)] + [(99, "http://b.net/7", None)] * 40, PAGES)
    rules = url_rules.mine_all_rules(url_rules.labelled_urls(pages, frame(spark, [(0, 0, 0), (1, 0, 0), (7, 1, 0)], LABELS)), Scratch(spark, "test"))
    assert 1 <= rules.where("bad").count() <= 3 and {r.verdict for r in url_rules.judge(pages.where("page_id < 99"), rules).collect()} == {"block"}
