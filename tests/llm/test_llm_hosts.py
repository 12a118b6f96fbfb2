import re
from collections import defaultdict

from helpers import frame
from costmart.llm import hosts

SCHEMA = "page_id long, url string, html string, rule string"
RULES = [hosts.parse_rule("allow", "org/"), hosts.parse_rule("block", "bad.org/x/"),
         hosts.parse_rule("block", "com/de/")]
PAGES = [
    (1, "http://good.ORG/a?q#f", '<a href="http://mid.net/x">', "c"),
    (2, "http://mid.net/x", "<a href='//far.net/'> <img src=https://mid.net/i.png>", "c"),
    (3, "http://far.net", None, "c"),
    (4, "http://bad.com/de/1", "", "c"),
    (5, "https://farm.net/", '<a href="http://bad.com/de/1"><a href=http://BAD.com/2>', "c"),
    (6, None, "<a href='http://good.org/'>", "c"), (7, "no scheme", None, None),
    (8, "x://a.bad.org/x/1#top", None, "c"), (9, "x://notbad.org/x/1", None, "c"),
    (None, "x://bad.org/x", None, "c"), (2, "http://mid.net/x", None, "c"),
]


def brute(pages, rules, damping=0.85, rounds=150):
    up, low = hosts.UPPER, hosts.LOWER
    table = str.maketrans(up, low)
    out, judged, links = [], defaultdict(list), set()
    for i, url, page, _ in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m.group(1).translate(table), m.group(2)) if m else ("", "")
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host))
               and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.text), default=None)
        out.append((i, host, path, rule))
        if host:
            judged[host].append(rule.verdict if rule else "")
            for h in re.findall(hosts.LINK, page or ""):
                if h.translate(table) != host:
                    links.add((host, h.translate(table)))
    scores = {}
    for kind, verdict, walk in (("trust", "allow", links), ("distrust", "block",
                                                              {(b, a) for a, b in links})):
        seeds = {h: v.count(verdict) / len(v) for h, v in judged.items() if verdict in v}
        out_links = defaultdict(int)
        for a, _ in links:
            out_links[a] += 1
        now = dict(seeds)
        for _ in range(rounds):
            new = defaultdict(float, seeds)
            for a, b in walk:
                new[b] += damping * now.get(a, 0) / out_links[a if kind == "trust" else b]
            now = new
        scores[kind] = now
    rows = []
    for i, host, path, rule in out:
        t, d = scores["trust"].get(host, 0), scores["distrust"].get(host, 0)
        bad = d >= 0.5 and d > 0.75 * (t + d)
        rows.append((str(i), host, path, rule.text if rule else None,
                     rule.verdict if rule else "block" if bad else "allow",
                     t, d))
    return sorted(rows, key=lambda r: repr(r[:5]))


def got(df):
    return sorted(((str(r[0]), *r[1:]) for r in df.collect()), key=lambda r: repr(r[:5]))


def check(spark, pages, rules=RULES):
    """The operator's rows, which are those of the brute force within the tolerance."""
    rows = got(hosts.judge(frame(spark, pages, SCHEMA), rules))
    want = brute(pages, rules)
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    for r, w in zip(rows, want):
        for x, y in zip(r[5:], w[5:]):
            assert abs(x - y) <= 1e-4 * max(1, y)
    return {int(r[0]): r[4] for r in rows if r[0] != "None"}


def test_against_brute_force(spark):
    pages = frame(spark, PAGES, SCHEMA)
    rows = got(hosts.judge(pages, RULES))
    assert rows == brute(PAGES, RULES)
    verdicts = {r[0]: r[4] for r in rows}
    assert verdicts["5"] == "block" and verdicts["3"] == "allow" and verdicts["8"] == "block"


def test_cycle_and_hot_host(spark):
    pages = [(i, f"http://h{i % 5}.net/{i}", f'<a href="http://h{(i + 1) % 5}.net/">'
              '<a href="http://hub.net/">', "c") for i in range(300)]
    pages += [(1000 + i, "http://hub.net/", '<a href="http://h1.net/">', "c") for i in range(150)]
    pages += [(2000, "http://s.org/", '<a href="http://hub.net/">', "c"),
              (2001, "http://z.com/de/", None, "c"), (2002, "http://h3.net/", '<a href="http://z.com/">', "c")]
    check(spark, pages)


def test_no_rules_and_empty(spark):
    assert {r["verdict"] for r in hosts.judge(frame(spark, PAGES, SCHEMA), []).collect()} == {"allow"}
    assert hosts.judge(frame(spark, [], SCHEMA), RULES).collect() == []


def test_main_path_is_native(spark):
    plan = hosts.judge(frame(spark, PAGES, SCHEMA), RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct", plan)


def test_verdicts_do_not_depend_on_the_number_of_linkers(spark):
    for n in (1, 2, 40):
        pages = [(0, "http://bad.com/de/1", None, "c")]
        pages += [(i, f"http://farm{i}.net/", "<a href=http://bad.com/>", "c")
                  for i in range(1, n + 1)]
        pages += [(100, "http://behind.net/", "<a href=http://farm1.net/>", "c"),
                  (101, "http://apart.net/", "<a href=http://else.net/>", "c"),
                  (102, "http://good.org/", "<a href=http://mixed.net/>", "c"),
                  (103, "http://mixed.net/", "<a href=http://bad.com/>", "c")]
        blocked = {i for i, v in check(spark, pages).items() if v == "block"}
        assert blocked == {0, *range(1, n + 1), 100}


def test_one_link_of_many_does_not_block_a_portal(spark):
    portal = "".join(f"<a href=http://site{i}.net/>" for i in range(1000)) + "<a href=http://bad.com/>"
    pages = [(0, "http://bad.com/de/1", None, "c"), (1, "http://portal.net/", portal, "c"),
             (2, "http://near.net/", "<a href=http://portal.net/>", "c"),
             (3, "http://third.net/", "<a href=http://near.net/>", "c"),
             (4, "http://half.net/", "<a href=http://bad.com/><a href=http://site1.net/>", "c"),
             (5, "http://farm.net/", "<a href=http://bad.com/><a href=http://farm2.net/>", "c"),
             (6, "http://farm2.net/", "<a href=http://bad.com/><a href=http://farm.net/>", "c")]
    assert {i for i, v in check(spark, pages).items() if v == "block"} == {0, 5, 6}


def test_chains_fade(spark):
    pages = [(0, "http://bad.com/de/1", None, "c")]
    pages += [(i, f"http://c{i}.net/", f"<a href=http://{'bad.com' if i == 1 else f'c{i - 1}.net'}/>", "c")
              for i in range(1, 10)]
    assert {i for i, v in check(spark, pages).items() if v == "block"} == {0, 1, 2, 3, 4}
