import datetime as dt
import random
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from voxelarium.llm.url_filter import decisions, filter_urls, validity

DAY = dt.date(2021, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def captures_of(spark, rows):
    data = [(i, u, day(d), "x", "y") for i, (u, d) in enumerate(rows)]
    return spark.createDataFrame(data, "page_id long, url string, fetched date, rule string, day_number string")


def entries_of(spark, rows):
    return spark.createDataFrame([(a, k, w, day(b), day(e)) for a, k, w, b, e in rows], "list string, key string, allow boolean, added date, removed date")


def brute(url, at, entries):
    parts = urlsplit(url or "")
    host = (parts.hostname or "").rstrip(".")
    if not host or at is None:
        return "", "", False
    labels, segments = host.split("."), [s for s in parts.path.split("/") if s]
    keys = {".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))} | {"/".join([host, *segments[:i]]) for i in range(1, len(segments) + 1)}
    active = [(len(k), w, k, a) for a, k, w, b, e in entries if k in keys and (b is None or b <= at) and (e is None or at < e)]
    if not active:
        return "", "", False
    best = max(active)
    return ",".join(sorted({x[3] for x in active})), best[2], not best[1]


def run(spark, urls, entries, period=30):
    out = filter_urls(captures_of(spark, urls), entries_of(spark, entries), period=period)
    return [(r["page_id"], ",".join(r["lists"]), r["rule"] or "", r["blocked"]) for r in out.orderBy("page_id").collect()]


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.b.org"]
    paths = ["", "/", "/p", "/p/q", "/p/q/r?s=/t", "/z#/p"]
    urls = [(f"http://{rnd.choice(hosts)}{rnd.choice(paths)}", rnd.randint(0, 400)) for _ in range(400)]
    keys = [*hosts, "a.com/p", "x.a.com/p/q", "c.b.org/z", "b.org/p/q/r"]
    entries = []
    for _ in range(120):
        start = rnd.choice([None, *range(0, 400, 7)])
        end = rnd.choice([None, (start or 0) + rnd.randint(-3, 200)])
        entries.append((rnd.choice("lmn"), rnd.choice(keys), rnd.random() < 0.2, start, end))
    want = [(i, *brute(u, d, entries)) for i, (u, d) in enumerate(urls)]
    for period in (1, 30, 1000):
        assert run(spark, urls, entries, period) == want
    assert any(w[3] for w in want) and not all(w[3] for w in want)


def test_edges(spark):
    urls = [(None, 1), ("", 1), ("not a url", 1), ("http://a.com/x", None), ("HTTPS://User@A.com.:80/X/y", 1), ("http://10.0.0.1/", 1), ("http://a.com/x", 0), ("http://a.com/x", 1)]
    entries = [
        ("l", "a.com", False, 1, None),
        ("l", "A.com/X", True, None, None),
        ("m", "0.0.1", False, None, None),
        ("n", None, False, 0, 9),
        ("n", "", False, 0, 9),
        ("n", "a.com", False, 5, 5),
        ("n", "a.com", None, 7, 3),
    ]
    got = {i: rest for i, *rest in run(spark, urls, entries)}
    assert got[4] == ["l", "a.com/X", False] and got[7] == ["l", "a.com", True]
    assert all(got[i] == ["", "", False] for i in (0, 1, 2, 3, 5, 6))
    assert run(spark, urls, []) == [(i, "", "", False) for i in range(len(urls))]
    assert run(spark, [], entries) == []
    out = filter_urls(captures_of(spark, urls), entries_of(spark, entries))
    assert sorted(out.columns) == ["blocked", "day_number", "fetched", "lists", "page_id", "rule", "url"]
    assert {r[0] for r in out.select("day_number").collect()} == {"y"}


def test_repeated_rows(spark):
    captures = captures_of(spark, [("http://a.com/", 3)] * 50)
    entries = entries_of(spark, [("l", "a.com", False, 0, 9)] * 50)
    assert filter_urls(captures, entries).filter("blocked").count() == 50
    visits = captures.select("url", F.unix_date("fetched").alias("day")).distinct()
    assert decisions(visits, entries).count() == 1


def test_overlapping_entries_are_united(spark):
    rows = [("l", "a.com", False, 0, 5), ("l", "a.com", False, 3, 8), ("l", "a.com", False, 8, 9), ("l", "a.com", False, 12, 20)]
    rows += [("l", "a.com", False, 13, 14), ("l", "a.com", False, 15, None)]
    base = (DAY - dt.date(1970, 1, 1)).days
    got = sorted((r["start"] - base, r["end"] - base) for r in validity(entries_of(spark, rows)).collect())
    assert got[0] == (0, 9) and got[1][0] == 12 and got[1][1] > 10_000 and len(got) == 2
