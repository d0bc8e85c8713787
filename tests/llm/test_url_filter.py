import hashlib
import math
from collections import Counter

import pytest

from tokentally.llm import url_filter as U

SCHEMA = "page_id long, url string, host string, rule int, score string"


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def brute_rule(host, path):
    fit = []
    for _, rule in U.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append(rule)
    return max(fit, key=len, default=None)


class BruteModel:
    """Interpolated model of one class, straight from its recursive definition."""

    def __init__(self, urls):
        self.n, self.total = Counter(), 0
        for u in urls:
            t = "\x02" + u + "\x03"
            self.total += len(t)
            self.n.update(t[i:i + k] for k in range(1, U.LONGEST + 1) for i in range(len(t) - k + 1))
        self.n = Counter({g: c for g, c in self.n.items() if c >= U.MIN_COUNT})

    def p(self, c, h):
        """P(c | h) with pruned contexts and n-grams, backing off through the suffixes of h."""
        if h and not self.n[h]:
            return self.p(c, h[1:])
        lower = self.p(c, h[1:]) if h else 1 / 256
        return (self.n[h + c] + U.SMOOTHING * lower) / ((self.n[h] if h else self.total) + U.SMOOTHING)

    def log_likelihood(self, u):
        t = "\x02" + u + "\x03"
        return sum(math.log(self.p(c, t[max(0, i - U.LONGEST + 1):i])) for i, c in enumerate(t))


def brute(urls):
    """{url: verdict} of the whole operator."""
    rows = Counter(u or "" for u in urls)
    rule = {u: brute_rule(*brute_host_path(u)) for u in rows}
    verdict = {u: dict((r, v) for v, r in U.RULES).get(rule[u]) for u in rows}
    held = {u: hashlib.md5(u.encode()).hexdigest()[0] in U.HELD_OUT for u in rows}
    model = {v: BruteModel([u for u, n in rows.items() for _ in range(n) if verdict[u] == v and not held[u]]) for v in ("allow", "block")}
    score = {u: (model["allow"].log_likelihood(u) - model["block"].log_likelihood(u)) / (len(u) + 2) for u in rows}
    labelled = [(math.floor(score[u] / U.BIN), verdict[u], n) for u, n in rows.items() if verdict[u] and held[u]]
    share = lambda v, b: sum(n for x, w, n in labelled if w == v and x >= b) / max(1, sum(n for _, w, n in labelled if w == v))
    best = min({b for b, _, _ in labelled}, key=lambda b: (-round(share("allow", b) - share("block", b), 9), abs(b), b), default=0)
    return {u: (rule[u], verdict[u] or ("allow" if score[u] >= best * U.BIN else "block"), score[u]) for u in rows}


URLS = ["HTTP://A.B.Example.NET/en/x", "http://example.net", "http://net/", "https://xnet/en/", "ftp://ÀB.org/fr/é?x=/", "no scheme", "://", None, "",
        "a://b://c.net/en/?q", "http://www.example.com/de/#x", "http://example.com/de", "http://h.org/fr/" + "long" * 4000, "http://example.com/en/\n1",
        "http://user@example.net:80/en/", "http://EXAMPLE.net/en/?a#b"]


def test_rules_and_method_equal_brute_force(spark):
    hosts = ["www.a.example.net", "b.example.com", "blog.c.example.org", "spam.example.com", "x.net"]
    urls = [f"http{'s' * (i % 2)}://{hosts[i * 7 % 5]}/{['en', 'fr', 'de', 'es'][i * 3 % 4]}/{i * 37 % 500}" for i in range(400)]
    urls += URLS + ["http://b.example.com/en/1"] * 200 + ["http://x.net/hot"] * 300  # hot urls
    rows = [(i, u, "clash", 1, "s") for i, u in enumerate(urls)] + [(None, URLS[0], None, None, None), (0, urls[0], "clash", 1, "s")]
    got = U.filter_urls(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute([r[1] for r in rows])
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        url = by_id[r.page_id]
        rule, verdict, score = want[url or ""]
        assert (r.host, r.path, r.rule, r.verdict) == (*brute_host_path(url), rule, verdict)
        assert r.score is None if rule else r.score == pytest.approx(score, abs=1e-9)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_no_labels_and_empty(spark):
    one = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in U.filter_urls(one).collect()] == ["allow", "allow"]
    assert U.filter_urls(one.limit(0)).count() == 0


def test_no_python_on_the_executors(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = U.filter_urls(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
