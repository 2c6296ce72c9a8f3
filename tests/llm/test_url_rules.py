import random
import re

from inkgraph.llm import url_rules as U


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "b.example.net", "/en/x"), ("allow", "b.example.net", "/en/x"), ("block", "ample.net", "/"), ("allow", "net", "")]
PARTS = ["net", "example.net", "b.example.net", "a.b.example.net", "ample.net", "xample.net", "example.com", "org", "a.org", "", ".net", "net.", "EXAMPLE.Net", "x.net:80", "é.net"]


def test_matches_brute_force(spark):
    r = random.Random(1)
    urls = [f"https://{h}{p}{q}" for h in PARTS for p in ("", "/", "/en/", "/en/x", "/de/1", "/fr/", "/EN/") for q in ("", "?a=/en/", "#/en/")] + [None, "", "no", "://", "a://b://c.net/", "http://x\n.net/en/"]
    rows = [(k, u) for k, u in enumerate(urls + ["https://www.example.net/en/1"] * 300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in U.filter_urls(df, RULES).collect()}
    assert got == {k: brute(u, RULES) for k, u in rows}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(none, RULES).count() == 0
    one = spark.createDataFrame([(None, "http://a.net/", 1), (None, "http://a.net/", 1)], "page_id long, url string, verdict int")
    assert [r["verdict"] for r in U.filter_urls(one, []).collect()] == ["allow", "allow"]
    assert [r["verdict"] for r in U.filter_urls(one, RULES).collect()] == ["block", "block"]


def test_ids_of_any_type_and_long_urls(spark):
    rows = [("p-1", "http://a.net/x", "q"), ("p-2", "http://b.org/fr/" + "y" * 200_000, "q"), (None, "http://" + "a." * 20_000 + "net/", "q")]
    got = U.filter_urls(spark.createDataFrame(rows, "page_id string, url string, host string"), RULES).collect()
    assert {(r["page_id"], r["verdict"]) for r in got} == {(i, brute(u, RULES)[3]) for i, u, _ in rows}
    assert {r["page_id"]: r["path"] for r in got}["p-2"] == "/fr/" + "y" * 200_000
