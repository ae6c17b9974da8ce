"""Permissions by a table of rules, against the standard library's reader."""

import random
from urllib.robotparser import RobotFileParser

import pytest

from pricebasket.operators import permissions
from pricebasket.settings import Settings

PATHS = ["/", "/a", "/a/b", "/a%20b", "/%61", "/é", "/a?x=1", "/a?", "/a;p", "/a;", "/a/b;c?d#e", "", "*", "/*", "/~u", "/x+y", "/%zz", "/a#f", "/b%2Fc", "/A", "/a/./b", "/a=b&c", "//a", "/a b"]


def robots_text(r):
    out = []
    for _ in range(r.randint(0, 14)):
        word = r.choice(["User-agent", "user-AGENT ", "Disallow", "Allow", "Disallow", "Crawl-delay", "Request-rate", "Sitemap", "Other", "", "", " ", "# note"])
        value = {"u": r.choice(["*", "pricebasket", "Price", "other", "PriceBasket/2", "", "basket"]), "c": r.choice(["1", "10", "x", "5 ", "2.5"])}.get(word[:1].lower(), r.choice(PATHS))
        out.append(word if word.strip() in ("", "# note") else f"{word}:{r.choice(['', ' ', '  '])}{value}{r.choice(['', ' ', ' # why'])}")
    return r.choice(["\n", "\r\n"]).join(out)


def test_answers_are_the_readers(spark):
    r = random.Random(1)
    robots = [(f"h{k}.example", 200, robots_text(r)) for k in range(700)]
    urls = [(h, f"http{r.choice(['', 's'])}://{h}{r.choice(PATHS[:12] + PATHS[13:]).replace('*', 'z') or r.choice(['', '?q', '#f'])}{r.choice(['', '/more', 'x'])}") for h, _, _ in robots for _ in range(15)]
    urls = [(h, u) for h, u in urls if not u.partition("example")[2][:1].isalnum()]
    got = {x["url"]: (x["allowed"], x["reason"]) for x in permissions.permission_audit(spark.createDataFrame([(u,) for _, u in urls], "url string"), spark.createDataFrame(robots, "host string, status int, body string"), Settings(user_agent="pricebasket/1.0")).collect()}
    readers = {}
    for host, _, body in robots:
        readers[host] = RobotFileParser()
        readers[host].parse(body.splitlines())
    wrong = []
    for host, url in urls:
        allowed, delay = readers[host].can_fetch("pricebasket/1.0", url), readers[host].crawl_delay("pricebasket/1.0")
        reason = "disallowed by robots.txt" if not allowed else f"allowed; crawl delay of {delay} s" if delay and delay > 3 else "allowed by robots.txt"
        if url in got and got[url] != (allowed, reason):
            wrong.append((url, got[url], allowed, reason, dict((h, b) for h, _, b in robots)[host]))
    assert len(got) > 5000 and not wrong, wrong[:3]


@pytest.mark.parametrize("n", [10_000])
def test_many_rules_of_one_host(spark, n):
    r = random.Random(2)
    path = lambda: "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 9)))
    body = "User-agent: *\n" + "\n".join(f"{r.choice(['Allow', 'Disallow'])}: {path()}" for _ in range(n))
    urls = sorted({"https://h.example" + path() + path() for _ in range(500)})
    reader = RobotFileParser()
    reader.parse(body.splitlines())
    audit = permissions.permission_audit(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame([("H.example", 200, body)], "host string, status int, body string"))
    assert {x["url"]: x["allowed"] for x in audit.collect()} == {u: reader.can_fetch("pricebasket", u) for u in urls}
    assert tuple(permissions.totals(audit).first()) == (sum(reader.can_fetch("pricebasket", u) for u in urls), len(urls))
    assert "Python" not in audit._jdf.queryExecution().toString() and "Arrow" not in audit._jdf.queryExecution().toString()
