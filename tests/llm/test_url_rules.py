import random
import re

from lamplight.llm import url_rules as ur

RULES = [*ur.RULES, ("block", "a.b/x*y"), ("allow", "b/"), ("block", "long-host-name-that-fills-more-than-one-word-of-the-masks.example.org/some/very/long/path/prefix/")]


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        path = slash + tail
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        fits = (host == h or host.endswith("." + h)) and re.match(".*".join(re.escape(x) for x in ("/" + p).split("*")), path, re.S)
        if fits and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


def urls():
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "xexample.com", "a.net", "net", "q.a.b", "a.b", "b", "com", "com.evil", "example.com:80", "", "ex\u00e4mple.com", RULES[-1][1].split("/")[0]]
    paths = ["", "/", "/en/", "/en", "/en/1", "/EN/1", "/es/x", "/fr/", "/xzzy", "/xy", "/x/../y", "/.com/en/", "/some/very/long/path/prefix/k", "?q=/en/", "#/en/", "/en/?a#b", "/a?b/en/"]
    out = [f"{s}{h}{p}" for s in ("http://", "https://", "", "x", "a://b://") for h in hosts for p in paths]
    out += [None, "", "://", "http://" + "a." * 3000 + "com/" + "p" * 5000, "http://h\x00.com/\n", "http://com/", "//com/"]
    rng.shuffle(out)
    return out


def test_equals_brute_force(spark):
    rows = [(i if i else None, u) for i, u in enumerate(urls())] + [(7, "http://com/"), (7, "http://com/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'own' as host", "'own' as verdict")
    for rules in (ur.RULES, RULES, []):
        got = sorted(map(tuple, ur.judge_urls(df, rules).collect()), key=repr)
        assert got == sorted([(i, *brute(u, rules)) for i, u in rows], key=repr)
    assert ur.judge_urls(df.limit(0)).count() == 0


def test_masks_take_more_than_one_word():
    assert ur.compile_rules(RULES).words > 2


def test_small_blocks_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string")
    want = sorted(map(tuple, ur.judge_urls(df).collect()))
    monkeypatch.setattr(ur, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, ur.judge_urls(df).collect())) == want
