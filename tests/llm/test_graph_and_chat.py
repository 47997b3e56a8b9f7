"""Link graph, tool calls and the pipeline."""

import json
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import brute_spans
from trellis.llm import gam, link_graph, tiling, tool_calls
from trellis.llm.queries import PAGE_RULES

# ---- link graph

URLS = ["http://a.org/x", "HTTPS://User@A.B.Example.ORG:80/es/1?x#y", "http://example.org/en/12", "example.org/es/", None, "",
        "x://Ünï.COM/fr/", "http://com/de/q#z", "http://com?x=/fr/", "http://notexample.org/es/", "a://b://c/d", "http://net/fr/",
        "http://m.example.org/en/2", "://h/p", "http://example.org\n/es/x", "http://example.org#a"]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in PAGE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, verdict


def brute_edges(pages):
    edges, hosts = Counter(), set()
    for host, html in pages:
        if host:
            hosts.add(host)
            for dst in {h.lower() for h in re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)""", html or "")}:
                hosts.add(dst)
                if dst != host:
                    edges[host, dst] += 1
    for host in hosts:
        if host.startswith("www.") and "." in host[4:]:
            edges[host, host[4:]] += 1
            edges[host[4:], host] += 1
    return edges


def brute_ranks(edges, seeds, steps, damping):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    rank = dict(seeds)
    for _ in range(steps):
        after = {h: (1 - damping) * s for h, s in seeds.items()}
        for (a, b), w in edges.items():
            if a in rank:
                after[b] = after.get(b, 0) + damping * rank[a] * w / out[a]
        rank = after
    return rank


def test_urls_and_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    for r in link_graph.url_verdicts(df, PAGE_RULES).collect():
        host, path, rule, verdict = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict


def graph_pages():
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a> <a HREF=//{h}>y</a>' for h in hosts)
    return [("http://good.org/1", link("fine.net", "also.net")), ("http://fine.net/1", link("also.net", "good.org")),
            ("http://bad.example.org/es/1", link("worse.net")), ("http://worse.net/", link("bad.example.org", "bad.example.org")),
            ("http://friend.net/", link("worse.net", "bad.example.org")), ("http://lone.net/", '<a href="/a">a</a>'),
            ("http://www.also.net/", None), (None, link("bad.example.org")), ("http://shop.com/de/1", link("worse.net"))]


def test_propagation_equals_power_iteration(spark, monkeypatch):
    monkeypatch.setattr(link_graph, "CUT_EVERY", 3)
    pages = graph_pages()
    df = spark.createDataFrame([(i, u, h, 1, "x") for i, (u, h) in enumerate(pages)],
                               "page_id long, url string, html string, host int, rule string")
    parsed = [(brute_rule(u), h) for u, h in pages]
    edges = brute_edges([(p[0], h) for p, h in parsed])
    ruled = Counter((p[3], p[0]) for p, _ in parsed if p[3])
    total = sum(ruled.values())
    seeds = lambda kind: {h: n / total for (k, h), n in ruled.items() if k == kind}
    trust = brute_ranks(edges, seeds("allow"), 400, 0.85)
    distrust = brute_ranks({(b, a): w for (a, b), w in edges.items()}, seeds("block"), 400, 0.85)
    rows = link_graph.url_verdicts(df, PAGE_RULES).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["trust"] or 0) == pytest.approx(trust.get(r["host"], 0), rel=1e-5)
        assert (r["distrust"] or 0) == pytest.approx(distrust.get(r["host"], 0), rel=1e-5)
    verdict = {r["host"]: r["verdict"] for r in rows}
    assert verdict["worse.net"] == verdict["friend.net"] == "block"
    assert verdict["fine.net"] == verdict["lone.net"] == verdict[""] == "allow"


def test_small_and_far_ranks_count(spark):
    rules = [("good.org", "/", "allow"), ("bad.org", "/", "block")]
    link = lambda h: f'<a href="http://{h}/">x</a>'
    # host f0 links to bad.org and so on: f15 is 16 edges from it, and no trust reaches it
    pages = [("http://bad.org/", None), ("http://f0.net/", link("bad.org"))]
    pages += [(f"http://f{i}.net/", link(f"f{i - 1}.net")) for i in range(1, 16)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    df = df.unionByName(spark.range(10_000).selectExpr("id + 1000 as page_id", "'http://good.org/' as url", "'' as html"))
    # s is one of 3,000 hosts that link to a host one edge from bad.org, and one blocked page of 10,001 reaches it
    df = df.unionByName(spark.range(3_000).selectExpr(
        "id + 20000 as page_id", "concat('http://s', id, '.net/') as url", "'<a href=\"http://m.net/\">x</a>' as html"))
    df = df.unionByName(spark.range(3_000).selectExpr(
        "id + 30000 as page_id", "concat('http://t', id, '.net/') as url", "'<a href=\"http://s0.net/\">x</a>' as html"))
    df = df.unionByName(spark.createDataFrame([(5000, "http://m.net/", link("bad.org"))], df.schema))
    rows = {r["host"]: r for r in link_graph.url_verdicts(df, rules).collect()}
    assert rows["f15.net"]["verdict"] == "block" and rows["f15.net"]["distrust"] > 0
    assert rows["t7.net"]["verdict"] == "block" and 0 < rows["t7.net"]["distrust"] < 1e-11
    assert rows["good.org"]["verdict"] == "allow"


def test_ranks_are_settled(spark):
    edges = spark.createDataFrame([("k", "a", "b", 1.0), ("k", "b", "c", 1.0), ("k", "c", "a", 1.0), ("k", "c", "d", 3.0)],
                                  "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("k", "a", 1.0)], "kind string, host string, seed double")
    got = {r["host"]: r["rank"] for r in link_graph.propagate(edges, seeds).collect()}
    want = brute_ranks({("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("c", "d"): 3}, {"a": 1.0}, 300, 0.85)
    assert got == pytest.approx(want, rel=1e-5)


def test_sites_under_a_public_suffix_are_apart(spark):
    pages = [("http://a.co.uk/", None), ("http://b.co.uk/x", None), ("http://www.b.co.uk/", None), ("http://c.co.uk/", None)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    rows = link_graph.url_verdicts(df, [("b.co.uk", "/x", "block")]).collect()
    assert {r["host"]: r["verdict"] for r in rows} == {
        "a.co.uk": "allow", "b.co.uk": "block", "www.b.co.uk": "block", "c.co.uk": "allow"}


def test_many_rules_are_joined(spark):
    """As the same rules one by one, with nulls, repeated rows and a long page."""
    import random
    rng = random.Random(3)
    rules = sorted({(rng.choice(["org", "a.org", "b.a.org", "com", "x.com"]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4))),
                     rng.choice(["allow", "block"])) for _ in range(300)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(['org', 'a.org', 'b.a.org', 'c.b.a.org', 'x.com', 'net', 'ba.org'])}/"
            + "".join(rng.choice("ab/") for _ in range(rng.randrange(6))) for _ in range(200)] + [None, "", "://", "http://org", *URLS]
    rows = [(i if i % 5 else None, u, "x" * 300_000 if i == 3 else None) for i, u in enumerate(urls + urls[:20])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = link_graph.judged_by(df.select(link_graph.host_of(F.col("url")).alias("host"), link_graph.path_of(F.col("url")).alias("path")), rules[:0] or rules)
    one = df.select(link_graph.host_of(F.col("url")).alias("host"), link_graph.path_of(F.col("url")).alias("path"))
    many = link_graph.judged_by(one, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = one.withColumn("fit", link_graph.ruling(F.col("host"), F.col("path"), rules))
    show = lambda d: sorted(map(str, d.select("host", "path", "fit.rule", "fit.verdict", "fit.size").collect()))
    assert show(many) == show(want) == show(few)
    assert link_graph.url_verdicts(df, rules).count() == len(rows)


def test_link_graph_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert link_graph.url_verdicts(df, PAGE_RULES).count() == 0


# ---- tool calls

SCHEMAS = {"add": {"a": {"type": "integer", "required": True, "minimum": 0}, "b": {"type": "number"}},
           "say": {"text": {"type": "string", "required": True}, "opts": {"type": "object"}, "tags": {"type": "array"}}}


def test_calls_link_order_and_validate(spark):
    calls = spark.createDataFrame([
        (1, "c1", 0, "add", '{"b": 2.5, "a": 1}', []), (1, "c2", 0, "add", '{"a": 3}', ["c1"]),
        (1, "c3", 2, "say", '{"text":"é \\"q\\"","opts":{"z":1,"b":[2, 1]}, "tags":[]}', ["c2", "c1"]),
        (1, "x1", 0, "add", '{"a":1}', ["x2"]), (1, "x2", 0, "add", '{"a":1}', ["x1"]), (1, "x3", 0, "add", '{"a":1}', ["x2"]),
        (1, "l1", 3, "add", '{"a":1}', ["l2"]), (1, "l2", 5, "add", '{"a":1}', []), (1, "m1", 3, "add", '{"a":1}', ["nope"]),
        (2, "c1", 0, "add", '{"a": -1, "q": 2, "b": "x"}', []), (2, "c2", 0, "fly", "{}", None), (2, "c3", 0, "add", "[1]", []),
        (2, "c4", 0, "add", "{not json", []), (2, "c5", 0, "say", None, []), (2, "c6", 4, "add", '{"a":1}', []),
        (2, "c7", 4, "add", '{"a":1}', []), (2, "c7", 4, "add", '{"a":1}', []), (None, "c1", 0, "add", '{"a":1}', []),
        (2, None, 0, "add", '{"a":1}', [])],
        "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>").withColumn("level", F.lit(1))
    results = spark.createDataFrame([
        (1, "c1", 1, "first"), (1, "c1", 2, "again"), (1, "c2", 1, "b\n"), (1, "c3", 3, None), (2, "c6", 1, "too soon"),
        (2, "c7", 5, "ok"), (2, "gone", 5, "orphan"), (None, "c1", 1, "null")],
        "conv_id long, call_id string, turn long, content string").withColumn("status", F.lit("x"))
    others = spark.createDataFrame([(1, 0, "system", "be \"kind\""), (9, None, None, None)], "conv_id long, turn long, role string, content string")
    every = tool_calls.linked_calls(calls, results, SCHEMAS, others).collect()
    told = {"result", "extra_result", "orphan_result", "other_role"}
    rows = [r for r in every if r["status"] not in told]
    by = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert len(rows) == 19 and len(every) == 19 + 8 + 2
    said = sorted((str(r["conv_id"]), r["status"], r["record"]) for r in every if r["status"] in told)
    assert said == [
        ("1", "extra_result", '{"content":"again","id":"c1"}'), ("1", "other_role", '{"content":"be \\"kind\\"","role":"system"}'),
        ("1", "result", '{"content":"b\\n","id":"c2"}'), ("1", "result", '{"content":"first","id":"c1"}'),
        ("1", "result", '{"content":null,"id":"c3"}'), ("2", "orphan_result", '{"content":"orphan","id":"gone"}'),
        ("2", "result", '{"content":"ok","id":"c7"}'), ("2", "result", '{"content":"too soon","id":"c6"}'),
        ("9", "other_role", '{"content":null,"role":null}'), ("None", "orphan_result", '{"content":"null","id":"c1"}')]
    status = {k: r["status"] for k, r in by.items()}
    assert status == {
        (1, "c1"): "ok", (1, "c2"): "ok", (1, "c3"): "ok", (1, "x1"): "cycle", (1, "x2"): "cycle", (1, "x3"): "cycle",
        (1, "l1"): "late_need", (1, "l2"): "no_result", (1, "m1"): "missing_need", (2, "c1"): "invalid", (2, "c2"): "invalid",
        (2, "c3"): "invalid", (2, "c4"): "invalid", (2, "c5"): "invalid", (2, "c6"): "early_result", (2, "c7"): "ok",
        (None, "c1"): "no_result", (2, None): "no_result"}
    errors = {k: r["errors"] for k, r in by.items() if r["errors"]}
    assert errors == {(2, "c1"): "minimum:a,type:b,unknown:q", (2, "c2"): "tool", (2, "c3"): "json", (2, "c4"): "json", (2, "c5"): "json"}
    assert [by[1, c]["step"] for c in ("c1", "c2", "c3", "x1", "x3")] == [0, 1, 0, None, None]
    assert by[1, "c1"]["n_results"] == 2 and by[1, "c1"]["result_turn"] == 1
    assert by[1, "c1"]["record"] == '{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add","needs":[],"result":"first"}'
    assert by[1, "c3"]["record"] == ('{"arguments":{"opts":{"b":[2,1],"z":1},"tags":[],"text":"é \\"q\\""},"id":"c3","name":"say",'
                                     '"needs":["c1","c2"],"result":null}')
    # in order of turn and step every need comes first
    order = {k: (r["turn"], r["step"]) for k, r in by.items()}
    for r in calls.collect():
        for need in r["needs"] or []:
            if status.get((r["conv_id"], r["call_id"])) == "ok":
                assert order[r["conv_id"], need] < order[r["conv_id"], r["call_id"]]


def test_conversations_become_calls(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    turns = {(r["conv_id"], r["turn"]): r for r in df.collect()}
    calls, results, others = tool_calls.calls_of(df)
    every = tool_calls.linked_calls(calls, results, tool_calls.REPLY, others).collect()
    assert sorted((r["conv_id"], r["turn"]) for r in every) == sorted(turns)         # a row for each turn
    assert all(json.loads(r["record"]).get("content", turns[r["conv_id"], r["turn"]]["text"]) == turns[r["conv_id"], r["turn"]]["text"]
               for r in every)
    users = {k for k, r in turns.items() if r["role"] == "user"}
    rows = [r for r in every if (r["conv_id"], r["turn"]) in users]
    for r in rows:
        record, turn = json.loads(r["record"]), turns[r["conv_id"], r["turn"]]
        after = turns.get((r["conv_id"], r["turn"] + 1))
        answer = after["text"] if after and after["role"] == "assistant" else None
        words = len(re.findall(r"[^\x20\x09-\x0D]+", turn["text"] or ""))
        need = r["turn"] >= 2
        assert record == {"arguments": {"prompt": turn["text"] or "", "words": words}, "id": f"{r['conv_id']}:{r['turn']}",
                          "name": "reply", "needs": [f"{r['conv_id']}:{r['turn'] - 2}"] if need else [], "result": answer}
        assert r["record"] == json.dumps(record, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        assert r["valid"] == (3 <= words <= 500)
        if need and (r["conv_id"], r["turn"] - 2) not in users:
            assert r["status"] == "missing_need"
        else:
            assert r["status"] == ("invalid" if not r["valid"] else "ok" if answer is not None else "no_result")


def test_tool_calls_empty_and_odd_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", None, 1), (1, 1, "assistant", "", 1), (None, 0, "user", "x", 1), (2, None, "user", "y", 1),
                                (3, 0, None, "z", 1), (1, 0, "user", None, 1)], "conv_id long, turn long, role string, text string, v int")
    df = df.unionByName(spark.createDataFrame([(4, 0, "user", "w " * 300_000, 1)], df.schema))
    linked = lambda m: (lambda c, r, o: tool_calls.linked_calls(c, r, tool_calls.REPLY, o))(*tool_calls.calls_of(m))
    rows = linked(df).collect()
    assert Counter(r["status"] for r in rows) == {"invalid": 5, "result": 1, "other_role": 1}
    assert max(len(r["record"]) for r in rows) > 600_000
    assert linked(df.limit(0)).count() == 0


# ---- pipeline

def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(corpus_pipeline.stored(stage(spark, seen[-1], d)))
        if k < 4:
            assert seen[-1].dtypes == docs.dtypes
    ids = [{r["doc_id"] for r in df.collect()} for df in seen]
    good = {r["doc_id"] for r in gam.quality_scores(docs, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids[1] == good
    from trellis.llm.probminhash import near_duplicates
    assert ids[2] == {r["class_id"] for r in near_duplicates(seen[1]).collect()}
    leaks = {r["doc_id"] for r in tiling.contamination(seen[2], spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert leaks and ids[3] == ids[2] - leaks
    before = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert ids[4] == ids[3]
    for r in seen[4].collect():
        assert not brute_spans(r["text"]) and (r["text"] == before[r["doc_id"]] or "[secret]" in r["text"])
    assert seen[5].columns == [*docs.columns, "copies"] and all(1 <= r["copies"] <= 3 for r in seen[5].collect())
    run = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, seen[5].collect()))


def test_pipeline_on_an_empty_table(spark, nothing):
    d, docs = "/root/testdata/sf0.001", nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    d = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, d)
        assert out.columns[:len(odd.columns)] == odd.columns, name
        assert 0 < out.count() <= odd.count(), name
