import datetime
import random
import re

from rankloom.llm import url_filter

DAY = datetime.date(2024, 1, 1)


def plain(url, day, entries):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)(?::[0-9]*)?([^?#]*)", url or "")
    host = re.sub(r"\.$", "", m[1].lower()) or None if m else None
    found = {"block": set(), "allow": set()}
    for key in {e[:4] for e in entries if None not in e}:
        name, effect, kind, pattern = key
        past = [(e[5], e[4] == "remove") for e in entries if e[:4] == key and None not in e and day is not None and e[5] <= day]
        if not past or host is None or max(past)[1]:
            continue
        place = host + m[2]
        if host == pattern if kind == "host" else (host == pattern or host.endswith("." + pattern)) if kind == "domain" else (place == pattern or place.startswith(pattern + "/")):
            found[effect].add(name)
    return host, bool(found["block"]) and not found["allow"], ",".join(sorted(found["block"])), ",".join(sorted(found["allow"]))


def check(spark, captures, entries):
    asked = spark.createDataFrame([(*c, "clash") for c in captures], "page_id long, url string, day date, list string")
    got = url_filter.filter_urls(asked, spark.createDataFrame(entries, url_filter.ENTRY)).collect()
    assert sorted(((r.page_id, r.url, r.day, r.host, r.blocked, r.blocked_by, r.allowed_by) for r in got), key=str) == sorted(((p, u, d, *plain(u, d, entries)) for p, u, d in captures), key=str)
    return got


def test_random_lists(spark):
    rng = random.Random(5)
    hosts = ["a.org", "www.a.org", "x.www.a.org", "ba.org", "org", "b.net", "c.b.net"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(["block", "block", "allow"]), kind, rng.choice(hosts) + (rng.choice(["", "/p", "/p/q", "/p/q/r"]) if kind == "prefix" else ""), rng.choice(["add", "add", "remove"]), DAY + datetime.timedelta(rng.randrange(20))) for kind in rng.choices(["host", "domain", "prefix"], k=60)]
    captures = [(i, rng.choice(["http://", "https://u:p@", "HTTP://"]) + rng.choice(hosts).title() + rng.choice(["", ".", ":80", "/p", "/p/q?x=/r", "/pp", "/p/q/r/s#t"]), DAY + datetime.timedelta(rng.randrange(-2, 25))) for i in range(300)]
    assert len({r.blocked for r in check(spark, captures, entries)}) == 2


def test_edges(spark):
    entries = [("l", "block", "host", "a.org", "add", DAY), ("l", "block", "host", "a.org", "add", DAY), ("l", "block", "host", None, "add", DAY), ("m", "block", "domain", "org", "add", DAY), ("m", "block", "domain", "org", "remove", DAY)]
    captures = [(1, None, DAY), (2, "", DAY), (3, "no url", DAY), (4, "http://a.org", None), (5, "http://a.org", DAY), (5, "http://a.org", DAY), (None, "http://a.org/" + "d/" * 3000, DAY)]
    check(spark, captures, entries)
    check(spark, captures, [])
    check(spark, [], entries)


def test_addresses_in_brackets(spark):
    entries = [("l", "block", "host", "[2001:db8::1]", "add", DAY)]
    captures = [(1, "http://[2001:DB8::1]:8080/x", DAY), (2, "http://[2001:db8::2]/x", DAY), (3, "http://u@[2001:db8::1]", DAY), (4, "http://[broken/x", DAY), (5, "http://192.0.2.1:80/", DAY)]
    got = {r.page_id: (r.host, r.blocked) for r in check(spark, captures, entries)}
    assert got == {1: ("[2001:db8::1]", True), 2: ("[2001:db8::2]", False), 3: ("[2001:db8::1]", True), 4: (None, False), 5: ("192.0.2.1", False)}


def test_lists_of_the_query_grow_with_the_pages(spark):
    counts = []
    for sf in ("0.001", "0.01", "0.1"):
        entries = url_filter.query_entries(spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet"))
        counts.append(entries.count())
        assert entries.where("action = 'remove'").count() > 0 and entries.columns == [x.split()[0] for x in url_filter.ENTRY.split(", ")]
    assert counts[0] < counts[1] < counts[2] and counts[2] > 1000
