import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skein.llm import urls

SCHEMA = "page_id long, url string, host string, own_host string, rule string, template int"


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def listed(host, path, rules):
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def plain(rows, rules, depth):
    """Host by host, branch by branch."""
    pages = [(i, *(hp := split(u)), *listed(*hp, rules)) for i, u in rows]
    segs = [re.sub("[0-9]+", "#", re.sub("/$", "", p[2][1:])).split("/")[:depth] for p in pages]
    at = [""] * len(pages)
    for level in range(depth):
        seg = [s[level] if level < len(s) else "$" for s in segs]
        branches = defaultdict(lambda: defaultdict(Counter))
        for p, t, s in zip(pages, at, seg, strict=True):
            branches[p[1], t][s][p[4]] += 1
        for key, children in branches.items():
            n = {s: c.total() for s, c in children.items()}
            many = len(n) > urls.MOST or (len(n) >= urls.FEW and sum(n.values()) < urls.EACH * len(n))
            order, groups = sorted(n, key=lambda s: (children[s]["block"] / n[s], children[s]["allow"] / n[s], s)), []
            for i, s in enumerate(order):
                apart = i == 0
                for what in ("block", "allow") if i else ():
                    a, b = children[s][what], children[order[i - 1]][what]
                    q, m = (a + b) / (n[s] + n[order[i - 1]]), n[order[i - 1]]
                    apart |= 0 < q < 1 and (a / n[s] - b / m) ** 2 / (q * (1 - q) * (1 / n[s] + 1 / m)) > urls.DIFFER
                groups += [[s]] if apart else []
                groups[-1] += [] if apart else [s]
            name = {s: "*" if many else s if len(g) == 1 else "{" + "|".join(sorted(g)) + "}" for g in groups for s in g}
            for i, p in enumerate(pages):
                if (p[1], at[i]) == key and not at[i].count("/") > level:
                    seg[i] = name[seg[i]]
        at = [f"{t}/{s}" for t, s in zip(at, seg, strict=True)]
    votes = defaultdict(Counter)
    for p, t in zip(pages, at, strict=True):
        votes[p[1], t][p[4]] += 1
    purity = {k: (c["block"] + urls.BAD) / (c["block"] + c["allow"] + urls.PRIOR) for k, c in votes.items()}
    return sorted(((i, h, p, r, t, round(purity[h, t], 9), v or ("block" if purity[h, t] >= urls.PURITY else "allow")) for (i, h, p, r, v), t in zip(pages, at, strict=True)), key=str)


def got(spark, rows, rules=urls.RULES, depth=urls.DEPTH):
    df = spark.createDataFrame([(*r, "own", "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    out = urls.judge(df, rules=rules, depth=depth)
    assert out.columns == ["page_id", "url", "host", "own_host", "rule", "template", "_host", "path", "_rule", "_template", "purity", "verdict"]
    return sorted(map(tuple, out.select("page_id", "_host", "path", "_rule", "_template", F.round("purity", 9), "verdict").collect()), key=str)


def test_as_branch_by_branch(spark):
    rng = random.Random(2)
    rules = (("bad.org", "/ads/", "block"), ("bad.org", "/ads/ok", "allow"), ("shop.org", "/", "block"), ("shop.org", "/help", "allow"), ("org", "/news/", "allow"))
    rows = []
    for i in range(1500):
        host = rng.choice(["bad.org", "a.bad.org", "shop.org", "WWW.shop.org", "x.net", "free.org"] + ["bad.org"] * 6)
        path = rng.choice(["/ads/%d/a", "/ads/%d/b.html", "/ads/ok%d", "/news/%d/", "/news/w" + "abcdefghijklmnopqr"[i % 18] + "/%d", "/help/%d", "/" + rng.choice("uvwxyz") * rng.randrange(1, 9) + "/%d", "/", "", "/a//b/%d", "/a/b/c/d/%d/e"])
        rows.append((i, f"https://{host}{path}".replace("%d", str(rng.randrange(2000))) + rng.choice(["", "#top", "?q=/x://y"])))
    rows += [rows[0], rows[0], (None, rows[1][1])]
    assert got(spark, rows, rules) == plain(rows, rules, urls.DEPTH)
    assert {r[6] for r in got(spark, rows, rules) if r[3] is None} == {"allow", "block"}


def test_rejects_what_listed_pages_of_a_template_show(spark):
    """Pages below /ads/ of one host are blocked by a list of some; the others of the template go with them, those of other templates stay."""
    rules = (("h.org", "/ads/1", "block"), ("h.org", "/blog/1", "allow"))
    rows = [(i, f"http://h.org/{'ads' if i % 2 else 'blog'}/{i}") for i in range(100, 300)] + [(i, f"http://other.org/ads/{i}") for i in range(300, 330)]
    verdict = {r[0]: r[6] for r in got(spark, rows, rules)}
    assert all(v == ("block" if i % 2 and i < 300 else "allow") for i, v in verdict.items())


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme.com/en/"), (4, "://"), (5, "x://EXAMPLE.com/en/é\n?a#b"), (6, "http://www.example.com/en/"), (7, "http://wexample.com/en/1"), (8, "http://com/"), (9, "http://com"), (10, "http://a.net/fr/" + "p/" * 5000), (11, "http://a.net?x=://b.com/en/"), (12, "http://ÀB.net#/es/"), (13, "http://a.net//es/"), (14, "a:///p")]
    assert got(spark, rows) == plain(rows, urls.RULES, urls.DEPTH)
    assert {r[0]: (r[1], r[2], r[3]) for r in got(spark, rows) if r[0] in (3, 5, 6, 9, 12)} == {3: ("", "", None), 5: ("example.com", "/en/é\n", "example.com/en/"), 6: ("www.example.com", "/en/", "www.example.com/en/"), 9: ("com", "", None), 12: ("Àb.net", "", None)}
    assert got(spark, []) == []
