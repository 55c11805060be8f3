import random
import zlib

import pytest
from granary.functions import text as X
from granary.operators import fingerprints, gates, labels, metrics, packing, retrieval, sampling, statutes
from granary.sources import io
from granary.streaming import events
from pyspark.sql import functions as F


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_quotas():
    assert sampling.whole_shares({"a": 1, "b": 1, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    assert sampling.shares_within({"a": 1, "b": 1}, {"a": 1, "b": 10}, 6) == ({"a": 1, "b": 5}, 0)
    got, flags = sampling.allocate({"a": 1000, "b": 1000, "c": 50}, 600)
    assert sum(got.values()) == 600 and got["c"] == 50 and all(n <= 1000 for n in got.values())
    assert sampling.allocate({"a": 10}, 50) == ({"a": 10}, ["cap_lifted", "short"])
    assert sampling.allocate_sources({"a": 3, "b": 9}, 8) == ({"a": 2, "b": 6}, 0)
    got, flags = sampling.allocate({"a": 400, "b": 300, "x": 900, "y": 10}, 1000, derived=("x", "y"))
    # Derived tasks share 15 %, their floors of 100 and 10 within it; the cap of single tasks has to go.
    assert sum(got.values()) == 1000 and got["a"] == 400 and got["b"] == 300 and got["x"] + got["y"] == 300 and flags == ["cap_lifted", "derived_cap_lifted"]


def test_shares_within_is_a_level():
    r = random.Random(4)
    for _ in range(300):
        names = "abcdef"[: r.randrange(1, 7)]
        weights, most, total = {n: r.randrange(0, 9) for n in names}, {n: r.randrange(0, 30) for n in names}, r.randrange(0, 120)
        got, left = sampling.shares_within(weights, most, total)
        assert sum(got.values()) + left == total and all(got[n] <= most[n] and (weights[n] or not got[n]) for n in names)
        open_ = [n for n in names if weights[n] and got[n] < most[n]]
        assert not left or not open_
        # All that are not full have the same share of their weight, to one.
        for a in open_:
            for b in names:
                assert not weights[b] or got[b] / weights[b] <= (got[a] + 1) / weights[a] + 1 / weights[b]


def test_chinese_numbers_and_labels(spark):
    assert column(spark, ["十", "二十", "一百一十四", "三百零五", "12", "x", None], X.chinese_number) == [10, 20, 114, 305, 12, None, None]
    assert [(r["no"], r["sub"]) for r in column(spark, ["第十二条之一", "第3条"], X.article_number)] == [(12, 1), (3, 0)]


def test_titles(spark):
    titles = ["《某法(2019修正)(2020修订)》", "某法(试行)", "某法(修改)", "某法[1999废止]", "《《某法》》", "某法（2018年修正） "]
    assert column(spark, titles, lambda c: X.strip_version(X.strip_wrappers(c))) == ["某法", "某法(试行)", "某法", "某法", "某法", "某法"]
    assert column(spark, ["《" * 8 + "某法" + "》" * 8], lambda c: X.strip_wrappers(c, None)) == ["某法"]
    assert column(spark, ["见《甲法律》和《乙法律》及《甲法律》"], X.extract_titles) == [["甲法律", "乙法律"]]


def test_choices(spark):
    answers = ["C: 文字…", "答案是AB", "xyz", None, "c: text", "- C: " + "long " * 20, "好" * 70 + "答案是c", "**B**", "ABCDEFG", "A 或 F"]
    assert column(spark, answers, X.choice_letters) == [["C"], ["A", "B"], [], [], ["C"], ["C"], ["C"], ["B"], [], ["A"]]
    assert column(spark, ["a\\ \nb  \n\n\n\nc "], X.clean_lines) == ["ab\n\nc"]


def test_tolerant_json(spark):
    got = column(spark, ['```json\n{"a":1,}\n```', "no json", '{"a": 2}'], lambda c: F.try_variant_get(X.tolerant_json(c), "$.a", "int"))
    assert got == [1, None, 2]


def test_normalisers(spark):
    assert column(spark, ["Ａb　 c\n\nd", None], X.norm_ws) == ["Ab c\n\nd", ""]
    assert column(spark, ["Ａ b\tc\r\n"], X.norm_text) == ["Abc"]
    assert column(spark, ["Ａ，b!"], X.normalize_text) == ["ab"]
    assert column(spark, ["x</think> y", "z"], X.after_think) == ["y", "z"]


def simhash(text):
    head = text[:800]
    grams = [head[i : i + 3] for i in range(len(head) - 2)] if len(head) > 3 else [head]
    codes = [zlib.crc32(g.encode()) for g in grams]
    return sum(1 << k for k in range(32) if 2 * sum(c >> k & 1 for c in codes) > len(codes))


def test_simhash(spark):
    texts = ["", "ab", "abc", "hello world", "héllo wörld " * 100, "x" * 2000]
    assert column(spark, texts, fingerprints.simhash) == [simhash(t) for t in texts]


def test_fingerprint_in_one_pass(spark):
    import unicodedata

    texts = ["", "ab", "a b\tc", "héllo　wörld " * 100, "Ａｂ１", "x" * 2000, None]
    bare = [unicodedata.normalize("NFKC", t or "").translate(str.maketrans("", "", " \t\r\n　")) for t in texts]
    assert [(r["n"], r["hash"]) for r in column(spark, texts, fingerprints.normal_fingerprint)] == [(len(t), simhash(t)) for t in bare]


def test_running_and_hash_ranks(spark):
    from granary.operators import ranks

    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(40), i) for i in range(500)]
    got = ranks.running(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], "v", n=F.count(F.lit(1))).collect()
    assert len(got) == len({x[:2] for x in rows})
    for x in got:
        own = [v for g, v, _ in rows if g == x["g"]]
        assert (x["n"], x["n_before"], x["n_all"]) == (own.count(x["v"]), sum(v < x["v"] for v in own), len(own))
    ranked = ranks.hash_rank(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], F.sha1(F.col("i").cast("string"))).collect()
    import hashlib

    for g in "ab":
        order = sorted((hashlib.sha1(str(i).encode()).hexdigest(), i) for h, _, i in rows if h == g)
        assert [x["i"] for x in sorted((x for x in ranked if x["g"] == g), key=lambda x: x["k"])] == [i for _, i in order]


def test_near_pairs(spark):
    r = random.Random(1)
    left = [(i, r.getrandbits(32)) for i in range(60)]
    right = [(i, h ^ sum(1 << b for b in r.sample(range(32), r.randrange(0, 6)))) for i, h in left[:40]]
    want = {}
    for i, h in left:
        best = min(((h ^ g).bit_count(), j) for j, g in right)
        if best[0] <= 3:
            want[i] = (best[1], best[0])
    rows = lambda x, n: spark.createDataFrame(x, f"{n} int, hash long")
    got = {x["a"]: (x["b"], x["distance"]) for x in fingerprints.near_pairs(rows(left, "a"), rows(right, "b"), "a", "b").collect()}
    assert got == want


def test_fusion_and_expansion(spark):
    lists = spark.createDataFrame([(1, "d", "x", 1), (1, "d", "y", 2), (1, "b", "y", 1)], "query_id int, source string, doc_id string, rank int")
    got = [(r["doc_id"], round(r["score"], 4)) for r in retrieval.fuse(lists, {"d": 1.0, "b": 0.7}).orderBy("rank").collect()]
    assert got == [("y", 0.147), ("x", 0.0909)]
    tie = spark.createDataFrame([(1, "d", "a", 1), (1, "b", "b", 1)], "query_id int, source string, doc_id string, rank int")
    assert [r["doc_id"] for r in retrieval.fuse(tie, {"d": 1.0, "b": 1.0}).orderBy("rank").collect()] == ["a", "b"]
    ranks = spark.createDataFrame([(1, "s1", 1), (1, "s2", 2)], "query_id int, doc_id string, rank int")
    edges = spark.createDataFrame([("s1", "n", "NEXT"), ("s2", "n", "CITES")], "start string, end string, kind string")
    assert [(r["doc_id"], r["score"]) for r in retrieval.expand(ranks, edges, {"NEXT": 1.0, "CITES": 0.5}).collect()] == [("n", 1.0)]


def test_ranking_metrics(spark):
    ranks = spark.createDataFrame([("c", 1, "a", 1), ("c", 2, "d", 1)], "config string, query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id int, doc_id string")
    r = metrics.ranking_metrics(ranks, gold, (1,)).head()
    assert abs(r["recall1"] - 1 / 3) < 1e-9 and r["hit1"] == 0.5


def test_rouge_and_spearman(spark):
    rows = spark.createDataFrame([("abcd", "abed"), ("", "x"), ("a", None)], "p string, g string")
    assert [round(r[0], 6) for r in rows.select(metrics.rouge_l(F.col("p"), F.col("g"))).collect()] == [0.75, 0.0, 0.0]
    same = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 3.0)], "g int, x double, y double")
    assert abs(metrics.correlations(same, ["g"], "x", "y").head()["spearman"] - 1) < 1e-9
    assert [r[0] for r in spark.createDataFrame([(" ab", "ab\n")], "p string, g string").select(metrics.rouge_l(F.col("p"), F.col("g"))).collect()] == [1.0]


def test_articles(spark):
    text = "目 录\n第一章 A\n第二章 B\n第一章 A\n第一条 正文正文。\n附 则\n尾部"
    got = statutes.split_articles(spark.createDataFrame([("d", text), ("e", None)], "id string, t string"), "id", "t").collect()
    assert [(r["chapter"], r["label"], r["text"]) for r in got] == [("第一章 A", "第一条", "正文正文。")]
    text = "第一编甲\n第一条 第一条的文字\n第二章总则\n第二条之一　第二条的文字\n序 言\n不在条内\n第三条 短"
    assert [x[1:] for x in statutes.split_text(text)] == [("第一编甲", None, None, "第一条", "第一条的文字"), ("第一编甲", "第二章总则", None, "第二条之一", "第二条的文字")]


def test_citations_and_names(spark):
    items = spark.createDataFrame([("p1", "甲法", "依照《乙法》第十条和本法第二条")], "id string, law string, text string")
    got = {(r["law"], r["no"], r["kind"]) for r in statutes.citations(items, "id", "law", "text").collect()}
    assert got == {("乙法", 10, "named"), ("甲法", 2, "self")}
    items = spark.createDataFrame([("p1", "甲法", "见〈 丙条例 〉 第 三 条,本 办法 第 5 条,本命令第6条")], "id string, law string, text string")
    assert {(r["law"], r["no"]) for r in statutes.citations(items, "id", "law", "text").collect()} == {("丙条例", 3), ("甲法", 5), ("甲法", 6)}
    laws = spark.createDataFrame([("L1", "大国民法典"), ("L2", "小国刑法典"), ("L3", "大国刑法典")], "law_id string, law_name string")
    names = spark.createDataFrame([("大国民法典",), ("民法典",), ("刑法典",), ("无此法",)], "name string")
    got = {r["name"]: (r["law_id"], r["status"]) for r in statutes.resolve_names(names, laws).collect()}
    assert got == {"大国民法典": ("L1", "exact"), "民法典": ("L1", "suffix"), "刑法典": (None, "ambiguous"), "无此法": (None, "missing")}
    tasks = statutes.derive_tasks(spark.createDataFrame([("某某法律", "第一条", "第一章", "正" * 30)], "law string, label string, chapter string, text string"))
    assert {r["kind"] for r in tasks.collect()} == {"recall", "locate", "structure"}


def test_next_edges_and_versions(spark):
    items = spark.createDataFrame([("d", "a", 1), ("d", "b", 2), ("e", "c", 1)], "doc string, id string, seq int")
    assert [(r["start"], r["end"]) for r in statutes.next_edges(items, "doc", "id", "seq").collect()] == [("a", "b")]
    v = spark.createDataFrame([("L", 1, "u1"), ("L", 1, "u2")], "law string, no int, uid string")
    assert [r["provision_id"] for r in statutes.versioned_ids(v, "law", "no", "uid").orderBy("uid").collect()] == ["L-a1", "L-a1-v2"]


def test_gates_fail_on_nothing(spark):
    empty = spark.createDataFrame([], "k int")
    assert not gates.unique("u", empty, "k").head()["ok"]
    assert labels and packing


def test_packing(spark):
    rows = spark.createDataFrame([(i, i % 70 + 1) for i in range(300)], "k int, n int")
    got = packing.token_batches(rows, "k", "n", 200, 8).toPandas()
    by = got.groupby(["bucket", "shard", "batch"])["len"].agg(["max", "size"])
    assert len(got) == 300 and (by["size"] <= 8).all() and (by["max"] * by["size"] <= 200).all()


def test_sources(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert io.read_jsonl(spark, str(p), "a int", "lenient").count() == 2
    counted = io.read_jsonl(spark, str(p), "a int", "counted").cache()
    assert counted.where("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(p), "a int").collect()
    q = tmp_path / "b.json"
    q.write_text('[{"a": 1},\n {"a": 3}]')
    assert sorted(r["a"] for r in io.read_records(spark, str(q)).collect()) == [1, 3]
    assert io.manifest(spark, str(q)).head()["bytes"] == q.stat().st_size
    outer = spark.createDataFrame([('{"data": [{"a": 1}, {"a": 2}]}',)], "value string")
    assert io.coerce_outer(outer).count() == 2
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "a.json").write_text('{"data": [{"a": 1},\n {"a": 2}]}')
    (mixed / "b.jsonl").write_text('{"a": 3}\n{bad\n{"a": 4}\n')
    assert sorted(r[0] for r in io.read_json_or_lines(spark, str(mixed)).select(F.variant_get("record", "$.a", "int")).collect()) == [1, 2, 3, 4]
    v = spark.createDataFrame([(f"u{i}", [float(i)], "item" if i % 2 else "doc") for i in range(40)], "uid string, embedding array<double>, level string")
    io.write_vectors(v, str(tmp_path / "v"), shard=10)
    assert io.read_vectors(spark, str(tmp_path / "v")).count() == 20 and io.read_vectors(spark, str(tmp_path / "v"), None).select("shard").distinct().count() == 4
    io.write_jsonl(v, str(tmp_path / "j"))
    io.write_jsonl(v, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 80
    io.write_split(v, str(tmp_path / "s"), "level")
    assert spark.read.parquet(str(tmp_path / "s")).where("level = 'doc'").count() == 20
    assert {r["status"] for r in io.verified(io.manifest(spark, str(q), most=5), io.manifest(spark, str(q))).collect()} == {"unknown"}
    log = spark.createDataFrame([(1, "ok"), (2, "error")], "k int, s string")
    assert [r["k"] for r in io.pending(spark.createDataFrame([(1,), (2,), (3,)], "k int"), log, ["k"], "s = 'ok'").orderBy("k").collect()] == [2, 3]


def test_stream_equals_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["window"]["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("tumbled")) == key(events.tumbling(batch))
    assert events.sessions(batch).count() > 0
    once = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it goes on where it stopped
        q = events.append_once(once, str(tmp_path / "out"), str(tmp_path / "ck"), ["event_id"])
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_decisions_and_splits(spark):
    x = spark.createDataFrame([([0.9, 0.1],), ([0.7, 0.8],), ([0.1, 0.2],)], "s array<double>")
    assert [r[0] for r in x.select(labels.decide(F.col("s"), ["a", "b"], most=3)).collect()] == ["routed", "cross", "fallback"]
    k = spark.range(2000).select(sampling.split_by_hash(F.col("id").cast("string"), "s", {"a": 0.9, "b": 0.1}).alias("p"))
    share = k.where("p = 'b'").count() / 2000
    assert 0.07 < share < 0.13


def test_boost_rerank_and_near_hits(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 2.0)], "doc_id int, score double")
    hot = spark.createDataFrame([(1, 1.0)], "doc_id int, hotness double")
    assert {r["doc_id"]: r["score"] for r in retrieval.boost(s, hot).collect()} == {1: 1.05, 2: 2.0}
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, rank int")
    other = spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.5), (1, "c", 2.0)], "query_id int, doc_id string, score double")
    assert [r["doc_id"] for r in retrieval.rerank(ranked, other, 2).orderBy("rank").collect()] == ["b", "a"]
    from granary.operators import decontamination

    base = "the quick brown fox jumps over the lazy dog and runs far away " * 10
    rows = spark.createDataFrame([("u1", base, ""), ("u2", base + "x", ""), ("u3", "short", "")], "uid string, q string, a string")
    items = decontamination.fingerprinted(spark.createDataFrame([(1, base)], "item_id int, text string"), "text")
    found = decontamination.hits(decontamination.sides(rows, "uid", F.col("q"), F.col("a")), items, "uid")
    kinds = {(r["uid"], r["kind"]) for r in found.collect()}
    assert ("u1", "exact") in kinds and ("u2", "near") in kinds and not any(u == "u3" for u, _ in kinds)
    assert decontamination.verdict(found).head()["verdict"] == "FAIL" and decontamination.verdict(found.limit(0), 1).head()["verdict"] == "INCOMPLETE"
