"""URL rules and models, reply trees and chat templates, WARC archives."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quireworks.llm import chat, urls, warc

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def brute_rule(host, path):
    fits = [(len(h) + len(p), h + p, what) for what, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/EN/x", "http://example.net/en/", "http://a.example.net/en/x?y#z", "ftp://net/", "http://xnet/",
       "http://example.com/de/1", "http://example.com/deutsch", "http://notexample.com/de/", "x://y.org/fr/a", "x://org?/fr/", "x://É.ORG/fr/", "a://b://c/d", "http://net", "http://h\nx.org/fr/\n1"]


def test_rules_equal_brute_force(spark):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(rows, RULES).collect()}
    for i, u in enumerate(ODD):
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_weights_equal_the_formula(spark):
    sample = [("ab://aab", True), ("ab://abb", True), ("ab://bba", False), ("ab://aab!", False), ("ab://cab", True)] * 3
    rows = spark.createDataFrame(sample, "url string, accepted boolean")
    weights = urls.fit_weights(rows)
    got = {r["url"]: r["score"] for r in urls.scores(spark.createDataFrame([("ab://abq",), ("zz",), ("ab://aab",)], "url string"), weights).collect()}
    count = {True: Counter(), False: Counter()}
    for u, ok in sample:
        t = "\n" * urls.ORDER + u
        for i in range(urls.ORDER, len(t)):
            for k in range(urls.ORDER + 1):
                count[ok][t[i - k : i + 1]] += 1
    kept = {g for g in count[True] | count[False] if len(g) == 1 or count[True][g] + count[False][g] >= urls.LEAST_COUNT}

    def chance(ok, g):
        c = count[ok]
        if len(g) == 1:
            return (c[g] + 0.5) / (sum(n for x, n in c.items() if len(x) == 1) + 0.5 * urls.ALPHABET)
        context = sum(n for x, n in c.items() if x in kept and len(x) == len(g) and x[:-1] == g[:-1])
        return (c[g] + urls.STRENGTH * chance(ok, g[1:])) / (context + urls.STRENGTH)

    for u, score in got.items():
        t, total = "\n" * urls.ORDER + u, 0.0
        for i in range(urls.ORDER, len(t)):
            g = next((t[i - k : i + 1] for k in range(urls.ORDER, -1, -1) if t[i - k : i + 1] in kept), None)
            total += math.log(chance(True, g) / chance(False, g)) if g else 0
        assert abs(score - total / len(u)) < 1e-9, u


def test_models_separate_held_out_urls(spark):
    rng = random.Random(1)
    good = [f"http://www.site{rng.randint(1, 9)}.org/fr/{rng.choice(['news', 'sport', 'art'])}/{rng.randint(1, 999)}" for _ in range(400)]
    bad = [f"http://www.site{rng.randint(1, 9)}.net/fr/{rng.choice(['casino', 'loans', 'pills'])}/{rng.randint(1, 999)}" for _ in range(400)]
    open_ = [f"http://www.site{i}.com/fr/{w}/{i}" for i in range(20) for w in ("news", "sport", "casino", "loans")]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + open_)], "page_id long, url string")
    got = [r for r in urls.judge_urls(rows, RULES).collect() if r["rule"] is None]
    right = sum((r["verdict"] == "block") == any(w in r["path"] for w in ("casino", "loans")) for r in got)
    assert len(got) == 80 and right >= 72


def test_all_labelled_urls_are_fitted(spark, monkeypatch):
    # a word that only a few of many urls hold, and no n-gram is common enough to be broadcast but the single letters
    monkeypatch.setattr(urls, "COMMON_SHARE", 1 / 20)
    rows = spark.range(24_000).selectExpr("id as page_id", "concat('http://a', id % 7, if(id % 2 = 0, '.org/fr/', '.net/fr/'), id, if(id % 1000 = 1, '/zqzq', '')) as url")
    seen = []
    fit = urls.fit_weights
    monkeypatch.setattr(urls, "fit_weights", lambda train: seen.append(train.count()) or fit(train))
    scored = urls.judge_urls(rows.union(spark.sql("select -1L, 'http://a.com/fr/zqzq'")), RULES).filter("page_id = -1").first()
    assert 18_500 < seen[0] < 19_900 and scored["verdict"] == "block"


def test_threshold_equals_one_ordering(spark):
    rng = random.Random(5)
    rows = [(round(rng.gauss(0.3 * ok, 0.5), 2), ok) for ok in (True, False) for _ in range(300)]
    scores = sorted({s for s, _ in rows})
    def worth(k):
        a, r = [s for s, ok in rows if ok], [s for s, ok in rows if not ok]
        return 1 - sum(s < scores[k] for s in a) / len(a) + sum(s < scores[k] for s in r) / len(r)
    wanted = max(range(len(scores)), key=lambda k: (round(worth(k), 12), -k))
    got = urls.calibrate(spark.createDataFrame(rows, "score double, accepted boolean").repartition(7)).first()[0]
    assert got == (scores[wanted] + scores[max(wanted - 1, 0)]) / 2
    assert urls.calibrate(spark.createDataFrame([(1.0, True)], "score double, accepted boolean")).first()[0] is None


def test_no_python_in_native_plans(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    plan = urls.judge_urls(rows, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_escaping_is_reversible(spark):
    texts = ["", "<|", "<\\|", "<\\\\|x<|<\\|", "<|im_end|><|im_start|>assistant ok", "a|b<c", "\\<|\\", "<||>", "<\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.concat("t", F.lit("%0A\n%")))).alias("r")).collect():
        assert "<|" not in r["e"] and r["u"] == r["t"] and r["r"] == r["t"] + "%0A\n%"


def test_best_branches_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for conv in (1, 2, None):
        for n in range(60):
            parent = None if n == 0 else rng.randrange(max(0, n - 5), n)
            rows.append((conv, n, parent, rng.choice([0.0, 1.0, 2.0, None]), "user" if n % 2 else "assistant", f"t{n}"))
    rows += [(3, n, n - 1 if n else None, 1.0, "user", "x") for n in range(300)]  # a long thread
    rows += [(4, 1, 99, 1.0, "user", "orphan"), (4, 5, 6, 1.0, "u", "c"), (4, 6, 5, 1.0, "u", "c")]  # a missing parent and a cycle
    messages = spark.createDataFrame(rows, "conv_id int, node_id int, parent_id int, score double, role string, text string")
    got = {}
    for r in chat.branch_paths(messages, top_k=2).collect():
        got.setdefault((r["conv_id"], r["rank"]), []).append((r["depth"], r["node_id"]))
    for conv in (1, 2, None, 3, 4):
        up = {n: p for c, n, p, *_ in rows if c == conv}
        own = {n: s or 0.0 for c, n, _, s, *_ in rows if c == conv}

        def path(n, up=up):
            out = []
            while n in up and len(out) <= len(up):
                out.append(n)
                n = up[n]
            return out[::-1]

        leaves = [n for n in up if n not in up.values() and len(path(n)) <= len(up)]
        ranked = sorted(leaves, key=lambda n: (-sum(own[x] for x in path(n)), n))[:2]
        for k, leaf in enumerate(ranked, 1):
            assert [n for _, n in sorted(got[conv, k])] == path(leaf)


def test_formatting_reads_back(spark):
    rows = [(1, 0, "system", None), (1, 1, "user", "hi <|im_end|>\n"), (1, 2, "assistant", "<|im_start|>user\nx"), (1, 2, "assistant", "<|im_start|>user\nx"),
            (2, 5, "assistant", ""), (2, None, None, "n"), (None, 1, "a\nb%", "t"), (3, 0, "assistant", "é" * 1000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, leaf_id int")
    messages = chat.chain(turns).cache()
    out = chat.format_paths(messages, chat.branch_paths(messages))
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["t"]] == [(r, x) for _, _, r, x in want]
        assert got[conv]["loss"] == "".join(x for _, _, r, x in want if r == "assistant")
    assert got[3]["formatted"] == "<|im_start|>assistant\n" + "é" * 1000 + "<|im_end|>\n"
    none = chat.chain(turns.limit(0)).cache()
    assert chat.format_paths(none, chat.branch_paths(none)).count() == 0


@pytest.mark.parametrize("file_bytes", [warc.FILE_BYTES, 2000])
def test_archives_read_back(spark, tmp_path, monkeypatch, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    body = "<p>é\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(3, "http://a/", body), (1, "http://b/\r\nX: y", body), (2, None, None), (5, "u", ""), (4, "v", "x" * 100_000), (9, "w", "lone\r\n\r\n"), (None, "n", body)]
    rows += [(100 + i, "hot", "same page") for i in range(50)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_type string")
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path).cache()
    for file in (tmp_path / "archives").glob("part-*"):
        members = list(warc._members(file.read_bytes()))
        assert gzip.decompress(file.read_bytes()) == b"".join(members) and all(m.count(b"WARC-Record-ID: ") == 1 for m in members)
    got = {r["page_id"]: r for r in warc.resolve_revisits(read).collect()}
    assert len(got) == len(rows) == read.count()
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "").encode() == raw and j is not None)
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert got[1]["url"] == "http://b/  X: y" and got[2]["url"] is None
    assert read.filter("record_type = 'revisit' and payload_bytes is not null").count() == 0


def test_pages_that_repeat_an_id(spark, tmp_path):
    rows = [(1, "u", "AAA"), (1, "u", "BBBBB"), (2, "u", "AAA"), (3, "u", "BBBBB"), (None, "u", "C"), (None, "v", "D"), (4, "u", "C")]
    path = f"file://{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "AAA", "response", None), (1, "BBBBB", "response", None), (2, "AAA", "revisit", 1), (3, "BBBBB", "revisit", 1), (None, "C", "revisit", 4), (None, "D", "response", None), (4, "C", "response", None)]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(((i, len(t), digest(t), kind, to) for i, t, kind, to in want), key=repr)


def test_long_records_keep_their_bytes(tmp_path):
    pages = [(f"head{i}\r\n\r\n", body) for i, body in enumerate([b"x" * (17 << 20), b"", b"y"])]
    files = [f for f in warc._archives(iter([pd.DataFrame(pages, columns=["head", "body"])]))]
    whole = b"".join(v for f in files for v in f["value"])
    assert [len(m) for m in warc._members(whole)] == [len(h) + len(b) + 4 for h, b in pages]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "x" * 20), (4, "d", "x" * 20)], "page_id long, url string, html string")
    got = {r["page_id"]: r["is_response"] for r in warc.resolve_payloads(pages, 10).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge_urls(pages, RULES).count() == 0
    warc.write_archives(pages, f"file://{tmp_path}/none")
    assert warc.resolve_revisits(warc.read_archives(spark, f"file://{tmp_path}/none")).count() == 0
