import itertools
import re
from collections import Counter

from riskgraph.llm import queries, url_filters as U

from .helpers import SF, rows


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_query_hosts_paths_and_rules(spark):
    got = {r["page_id"]: r for r in queries.op1_url_filters(spark, SF).collect()}
    for i, url in rows("pages", "page_id, url"):
        assert (got[i]["host"], got[i]["path"]) == parts(url)
        want = rule(url)
        assert got[i]["rule"] == (want[0] if want else None)
        assert got[i]["verdict"] == want[1] if want else got[i]["verdict"] in ("allow", "block")


URLS = (["https://ads.spam.net/x/1", "http://m.spam.net/y/2#z"] * 30 + ["https://good.net/x/3", "http://blog.good.net/y/4?utm=1"] * 60)


def labelled(spark):
    data = [(u, "spam" in u) for u in URLS] + [(None, True), ("https://good.net/n", None)]
    return spark.createDataFrame(data, "url string, bad boolean")


def test_mined_rules_match_enumeration(spark):
    table = labelled(spark)
    rules, items = U.mine(table, 0.1, 0.9, 5)
    item = dict(tuple(r) for r in items.collect())
    got = {(tuple(r["items"]), r["label"]): round(r["confidence"], 9) for r in rules.collect()}
    baskets = [(set(r[0]), "label=bad" if r[1] else "label=good") for r in
               table.where("url is not null and bad is not null").select(U.tokens_of(U.F.col("url")), "bad").collect()]
    count, both = Counter(), Counter()
    for tokens, label in baskets:
        for n in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), n):
                count[c] += 1
                both[c, label] += 1
    least = 0.1 * len(baskets)
    want = {k: round(n / count[k[0]], 9) for k, n in both.items() if n >= least and n / count[k[0]] >= 0.9}
    # every combination of tokens is a rule through its items, at the same confidence, and no other rule is there
    assert {(tuple(sorted({item[t] for t in c})), label): p for (c, label), p in want.items()} == got
    same = {}
    for t in item:
        same.setdefault(frozenset(i for i, (tokens, _) in enumerate(baskets) if t in tokens), set()).add(item[t])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(item.values()))


def test_repeated_long_urls_are_one_item(spark):
    long = "https://spam.example.net/" + "/".join(f"part{i}" for i in range(60)) + ".html"
    other = "https://fine.example.net/" + "/".join(f"word{i}" for i in range(60)) + ".html"
    table = spark.createDataFrame([(long, True)] * 30 + [(other, False)] * 40, "url string, bad boolean")
    rules, items = U.mine(table)
    assert rules.count() <= 8 and items.select("item").distinct().count() <= 3
    pages = spark.createDataFrame([(1, long), (2, other), (3, "https://new.net/part7/x"), (4, "https://new.net/word9"), (5, "https://new.net/x")],
                                  "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["confidence"]) for r in U.judge(pages, table).collect()}
    assert got == {1: ("block", 1.0), 2: ("allow", 1.0), 3: ("block", 1.0), 4: ("allow", 1.0), 5: ("allow", None)}


def test_query_blocks_by_mined_rules(spark, tmp_path):
    """Planted tables through the query itself: pages of one host name documents with bad labels."""
    pages = spark.range(200).selectExpr("id page_id", "concat('https://', if(id % 4 = 0, 'casino.biz', 'news.net'), '/a/', id) url", "'' html")
    labels = spark.range(0, 160).selectExpr("id doc_id", "if(id % 4 = 0, 0, 1) quality", "0 toxic")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["page_id"]: r["verdict"] for r in queries.op1_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i in range(200)}


def test_mined_verdicts_and_awkward_rows(spark):
    data = [(1, "https://x.spam.net/q", "h"), (1, "https://x.spam.net/q", "h"), (2, None, "h"), (None, "no scheme", "h"), (3, "HTTPS://GOOD.net?a", "h"),
            (4, "ftp://new.org", "h"), (5, "://", "h"), (6, "http://É.Com/fr/" + "a" * 100000, "h")]
    pages = spark.createDataFrame(data, "page_id long, url string, host string")
    got = U.judge(pages, labelled(spark), queries.URL_RULES, min_support=0.1, min_count=5).collect()
    verdicts = {(r["page_id"], r["host"]): (r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(data) and verdicts[1, "x.spam.net"] == (None, "block") and verdicts[3, "good.net"] == (None, "allow")
    assert verdicts[2, ""] == verdicts[None, ""] == (None, "allow") and verdicts[4, "new.org"] == (None, "allow")
    assert verdicts[6, "É.com"] == ("com/fr/", "allow")
    none = spark.createDataFrame([], "url string, bad boolean")
    assert {r["verdict"] for r in U.judge(pages, none).collect()} == {"allow"}
    assert U.judge(pages.where("false"), labelled(spark), min_count=5).collect() == []


def test_rare_host_among_many_labels(spark):
    many = spark.range(8000).selectExpr("concat('https://h', id % 40, '.good.net/', id) url", "false bad")
    for n, want in ((25, "block"), (24, "allow")):
        rare = spark.range(n).selectExpr("concat('https://rare.org/', id) url", "true bad")
        pages = spark.createDataFrame([(1, "https://rare.org/new"), (2, "https://h1.good.net/7")], "page_id long, url string")
        got = {r["page_id"]: r["verdict"] for r in U.judge(pages, many.union(rare)).collect()}
        assert got == {1: want, 2: "allow"}
