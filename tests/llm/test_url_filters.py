import datetime as dt
import random

from marketloom.llm import url_filters


def test_as_of_join_against_plain_python(spark):
    r = random.Random(2)
    day = dt.date(2024, 1, 1)
    hosts = ["a.b.com", "b.com", "x.a.b.com", "other.org", "B.com:80"]
    entries = [(r.choice(["l1", "l2"]), r.choice(["b.com", "a.b.com", "other.org/p", "other.org/p/q"]),
                r.choice(["add", "remove"]), day + dt.timedelta(r.randint(0, 300))) for _ in range(60)]
    entries += [("l1", None, "add", day), ("l1", "b.com", "bogus", day)]
    captures = [(i, r.choice(["http://", "https://u:p@"]) + r.choice(hosts) + r.choice(["", "/", "/p", "/p/q?x", "/p/q/z#t"]),
                 day + dt.timedelta(r.randint(0, 400))) for i in range(300)]
    captures += [(900, None, day), (901, "no url", day), (902, "http://b.com/", None), (903, "http://b.com/", day), (903, "http://b.com/", day)]
    got = url_filters.judge(spark.createDataFrame(captures, "page_id long, url string, fetched date"),
                            spark.createDataFrame(entries, "list string, key string, action string, day date")).collect()
    assert len(got) == len(captures)

    def active(name, key, at):
        past = [(d, a) for n, k, a, d in entries if n == name and k == key and d <= at and a in ("add", "remove")]
        return bool(past) and max(past)[1] == "add"

    by_id = {x.page_id: x for x in got}
    for i, url, at in captures:
        keys = []
        if url and "://" in url and at:
            rest = url.split("://")[1].split("#")[0].split("?")[0]
            host, _, path = rest.partition("/")
            host = host.rpartition("@")[2].split(":")[0].lower()
            labels, parts = host.split("."), [p for p in path.split("/") if p]
            keys = [".".join(labels[k:]) for k in range(len(labels) - 1)]
            keys += [host + "/" + "/".join(parts[:k]) for k in (1, 2) if k <= len(parts)]
        hits = [(n, k) for n in ("l1", "l2") for k in keys if active(n, k, at)]
        assert by_id[i].blocked == bool(hits)
        assert by_id[i].lists == ",".join(sorted({n for n, _ in hits}))
        assert by_id[i].rule == (max((len(k), k) for _, k in hits)[1] if hits else None)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", dt.date(2024, 1, 1))], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([], "list string, key string, action string, day date")
    assert [x.blocked for x in url_filters.judge(captures, entries).collect()] == [False]
    assert url_filters.judge(captures.limit(0), entries).collect() == []


def test_deep_and_capital_paths(spark):
    day = dt.date(2024, 1, 1)
    entries = [("l1", "Site.ORG/Docs", "add", day), ("l2", "site.org/a/b/c/d", "add", day)]
    urls = ["http://site.org/Docs", "http://SITE.org/Docs/x", "http://site.org/docs", "http://site.org/a/b/c/d/e",
            "http://site.org/a/b/c", "http://site.org/a/b/c/D"]
    got = url_filters.judge(spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched date"),
                            spark.createDataFrame(entries, "list string, key string, action string, day date")).collect()
    assert {x.page_id: x.lists for x in got} == {0: "l1", 1: "l1", 2: "", 3: "l2", 4: "", 5: ""}
