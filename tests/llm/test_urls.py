"""URL rules against one url at a time."""

import random

import pytest
from llm.helpers import SF
from oracle_harness import compare, duck

from riskloom.llm import queries, urls


def verdict(url, rules):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3:]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for v, rule in set(rules):
        h, slash, p = rule.partition("/")
        h, p = h.lower(), slash + p
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(rule), len(h) + 1, v == "block")
            if best is None or rank > best[0] or (rank == best[0] and rule < best[1]):
                best = (rank, rule, v)
    return host, path, best and best[1], best[2] if best else "allow"


def test_query_equals_sql(spark):
    r = compare(spark, SF, "op3", queries.op3_url_filter, queries.OP3_SQL, duck(SF))
    assert r["match"], r


ODD_URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/en",
            "http://xexample.net/en/", "http://net/", "http://net", "x://y://org/fr/", "http://a.b.org/fr/1", "http://org/FR/",
            "http://example.com/de/?a=/b", "http://example.com?x=/de/", "ftp://.net/", "http://net./", "http://..org/fr/",
            "a\nhttp://example.com/de/\nx", "http://" + "a." * 2000 + "org/fr/z"]


@pytest.mark.parametrize("partitions", ["2", "31"])
def test_many_nested_rules(spark, partitions):
    rng = random.Random(7)
    labels = ["net", "org", "com", "example", "a", "b", "c", "www", "x1"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/", "/en/", "/en/x", "/de/", "", "/en/x/y"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts) + rng.choice(paths)) for _ in range(80)]
    rules += [("block", "/nohost"), ("allow", ""), ("allow", "net/"), ("block", "net/"), ("other", "org/")]
    given = ODD_URLS + [f"http://{rng.choice(labels)}.{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=1', 'z'])}"
                        for _ in range(900)] + ["http://example.net/hot"] * 500
    df = spark.createDataFrame(list(enumerate(given)), "rule int, url string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = urls.judge(df.withColumnRenamed("rule", "key"), urls.rules_frame(spark, rules), carry=("key",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    known = [r for r in rules if r[0] in ("allow", "block")]
    assert len(got) == len(given)
    for r in got:
        assert (r.host, r.path, r["rule"], r.verdict) == verdict(given[r.key], known), given[r.key]


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "http://a.net/"), (2**60 + 1, None)], "page_id long, url string")
    rules = urls.rules_frame(spark, queries.URL_RULES)
    assert {tuple(r) for r in urls.judge(df, rules, carry=("page_id",)).collect()} == {
        (None, "a.net", "/", "net/", "block"), (2**60 + 1, "", "", None, "allow")}
    assert urls.judge(df.limit(0), rules).count() == 0
    assert urls.judge(df, rules.limit(0)).filter("verdict = 'allow'").count() == 2


def test_rule_hosts_of_any_length(spark):
    host = ".".join(["label" * 4] * 60) + ".example"
    rules = urls.rules_frame(spark, [("block", host + "/"), ("block", "short.example/")])
    df = spark.createDataFrame([(1, f"http://a.{host}/x"), (2, f"http://{host}/"), (3, "http://other.example/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(df, rules, carry=("page_id",)).collect()}
    assert len(host) > 1000 and got == {1: "block", 2: "block", 3: "allow"}
