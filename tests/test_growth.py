"""Work that grows with the input and not with its square: results by groups against results with all pairs."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
from granary.operators import checks, metrics, resampling, statutes
from granary.plans import catalog
from pyspark.sql import functions as F

CITED = "start string, law_id string, no int, evidence string, kind string"


def grouped_edges(spark, seed):
    r = random.Random(seed)
    starts = {(f"p{r.randrange(12)}", r.choice("AB"), r.randrange(3), f"e{r.randrange(3)}", r.choice(["named", "self"])) for _ in range(60)}
    ends = {(r.choice("AB"), r.randrange(3), f"p{r.randrange(14)}") for _ in range(30)} | {("C", 1, "p1")}
    edges = {(s, e, kind, said) for s, law, no, said, kind in starts for law2, no2, e in ends if (law, no) == (law2, no2) and s != e}
    return spark.createDataFrame(sorted(starts), CITED), spark.createDataFrame(sorted(ends), "law_id string, no int, end string"), edges


def test_edges_are_summed_up_without_being_made(spark):
    for seed in range(3):
        starts, ends, edges = grouped_edges(spark, seed)
        want = {k: tuple(len({f(e) for e in edges if e[2] == k}) for f in (lambda e: e, lambda e: e[0], lambda e: e[1], lambda e: e[3])) for k in {e[2] for e in edges}}
        assert {r["kind"]: tuple(r)[1:] for r in statutes.edge_summary(starts, ends).collect()} == want
    many = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("start"), F.lit("A").alias("law_id"), F.lit(1).alias("no"), F.lit("e").alias("evidence"), F.lit("self").alias("kind"))
    got = statutes.edge_summary(many, many.select("law_id", "no", F.col("start").alias("end"))).collect()
    assert [tuple(r) for r in got] == [("self", 20_000 * 19_999, 20_000, 20_000, 1)]


def test_edge_checks_of_groups_are_those_of_edges(spark):
    for seed in range(2):
        starts, ends, edges = grouped_edges(spark, seed)
        provisions = spark.createDataFrame([(f"p{i}", "A") for i in range(3, 12)], "provision_id string, law_id string")
        next_ = spark.createDataFrame([("p3", "p4")], "start string, end string")
        laws = spark.createDataFrame([("A",)], "law_id string")
        made = spark.createDataFrame(sorted(edges), "start string, end string, kind string, evidence string")
        told = lambda cites: [tuple(r) for r in checks.edge_checks(provisions, next_, cites, laws).collect()]  # noqa: B023, E731
        assert told((starts, ends)) == told(made) and told(made)[2][2] > 0


def test_contexts_by_groups_give_the_same_verdicts(spark):
    r = random.Random(1)
    rows = lambda x, names: spark.createDataFrame(x, names)
    cites = rows([(f"q{r.randrange(9)}", r.choice(["甲法典", "乙法典", "无此法"]), r.randrange(4)) for _ in range(40)], "query_id string, law string, no int")
    provisions = rows([(f"v{i}", r.choice(["甲法典", "乙法典"]), r.randrange(3)) for i in range(12)], "provision_id string, law_id string, article_no int")
    laws = rows([("甲法典", "甲法典"), ("乙法典", "乙法典")], "law_id string, law_name string")
    groups = rows([(f"q{r.randrange(9)}", r.choice("ab")) for _ in range(8)], "query_id string, g string")
    members = rows([(r.choice("ab"), f"v{r.randrange(12)}") for _ in range(10)], "g string, provision_id string")
    told = lambda *context: sorted(tuple(x) for x in statutes.verified(cites, provisions, laws, *context).fillna("-").collect())
    got = told(groups, members)
    assert got == told(groups.join(members, "g")) and {x[3] for x in got} == {"found", "out_of_ctx", "missing", "law_unresolved"}


def test_ordered_contexts_beyond_a_million_keys(spark, tmp_path):
    # One supplier is met in the first round, the other in the second, at places on either side of a million.
    rows = pd.DataFrame({"l_orderkey": [1, 1, 2, 2], "l_linenumber": pd.Series([1, 2, 1, 2], dtype="int32"), "l_partkey": [1_200_000, 5, 10, 5], "l_suppkey": [7, 8, 7, 8]})
    rows.to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.sql(catalog.REGISTRY.oracles["ordered_contexts"]).df()[["query_id", "doc_id", "place"]]
    got = catalog.REGISTRY.queries["ordered_contexts"](spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_gold_sets_of_several_numbers(spark):
    r = random.Random(2)
    say = lambda: "".join(f"见《{r.choice(['甲法典', '乙法典', '无此法'])}》第{r.randrange(5)}条" for _ in range(r.randrange(4)))
    rows = [(f"u{i % 35}", say(), say(), r.choice(["问", " "])) for i in range(40)]
    has = {("甲法典", 1): ["v2", "v9"], ("甲法典", 2): ["v3"], ("乙法典", 1): ["v2", "v5"], ("乙法典", 4): ["v1"]}
    provisions = spark.createDataFrame([(v, law, no) for (law, no), vs in has.items() for v in vs], "provision_id string, law_id string, article_no int")
    laws = spark.createDataFrame([("甲法典", "甲法典"), ("乙法典", "乙法典")], "law_id string, law_name string")
    cites = lambda uid, side: {(law, no) for row in rows if row[0] == uid for law in ("甲法典", "乙法典") for no in range(5) if f"《{law}》第{no}条" in row[side]}
    want = []
    for uid, _, _, asked in rows:
        keys = [cites(uid, 1), cites(uid, 2)]
        sets = [sorted({v for k in ks for v in has.get(k, [])}) for ks in (*keys, keys[0] | keys[1])]
        want.append((uid, asked, *sets, *(len(ks - set(has)) for ks in keys), "no_gold" if not sets[2] else "empty_query" if not asked.strip() else "-"))
    table = spark.createDataFrame(rows, "uid string, system string, output string, input string")
    got = statutes.gold_sets(table, provisions, laws)
    assert sorted(tuple(x) for x in got.fillna("-", ["reason"]).collect()) == sorted(want)
    told = statutes.gold_account(statutes.gold_keys(table, provisions, laws)).head()
    kept = [w for w in want if w[7] == "-"]
    assert tuple(told) == (40, len(kept), *(sum(w[7] == x for w in want) for x in ("no_gold", "empty_query")), *(sum(bool(w[i]) for w in kept) for i in (2, 3)), *(sum(w[i] for w in want) for i in (5, 6)))


def test_gold_account_makes_no_lists(spark, small):
    plan = catalog.REGISTRY.queries["gold_account"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_resamples_draw_by_md5():
    keys = ["7", "123", None, "äx", "k" * 60]
    got = np.zeros((len(keys), 120), int)
    for at, first, row in resampling.drawn("42", keys, 120):
        got[at, first : first + len(row)] += row
    for k, row in zip(keys, got, strict=True):
        for i, n in enumerate(row, 1):
            u = int(hashlib.md5((f"42|{i}" + ("" if k is None else "|" + k)).encode()).hexdigest()[:8], 16) / 2**32
            assert n == sum(u >= x for x in resampling.POISSON)


def test_resamples_are_dealt_out_and_held_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7, i, float(i)) for i in range(200)], "g int, k int, x double").coalesce(1)
    sums = lambda: sorted(map(tuple, metrics.resampled(rows, ["g"], "k", 20, "s", total=F.col("x")).collect()))
    want = sums()
    monkeypatch.setattr(metrics, "HELD", 90)  # two groups at a time
    assert sums() == want and len(want) == 140
    assert metrics.resampled(rows, ["g"], "k", 20, "s", total=F.col("x"))._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0


def test_fingerprints_of_many_at_once():
    from granary.operators import fingerprints
    import zlib

    def slow(text):
        grams = [text[k : k + 3] for k in range(len(text) - 2)] if len(text) > 3 else [text]
        crcs = [zlib.crc32(g.encode("utf-8", "replace")) for g in grams]
        return sum(1 << b for b in range(32) if 2 * sum(c >> b & 1 for c in crcs) > len(crcs))

    r = random.Random(5)
    texts = ["".join(r.choice("abc é好😀ß\ud800 ，") for _ in range(r.choice([0, 1, 3, 4, 5, 90]))) for _ in range(200)]
    assert fingerprints._majorities(texts * 2).tolist() == [slow(t) for t in texts * 2]


def test_exact_hits_need_no_grams(spark, small):
    plan = lambda name: catalog.REGISTRY.queries[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "simhash" not in plan("exact_hits") and "simhash" in plan("near_hits")


def test_ascii_texts_stay_out_of_python(spark):
    from granary.functions import text as X

    x = spark.createDataFrame([("plain",), ("ｗｉｄｅ　",), (None,)], "t string").select(X.nfkc(F.col("t")).alias("t"))
    assert [r[0] for r in x.collect()] == ["plain", "wide ", None]
    assert "octet_length" in x._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_held_against_queries_in_parts(spark, monkeypatch):
    from granary.operators import retrieval

    r = np.random.default_rng(3)
    v = r.integers(0, 3, (300, 4)).astype(float)  # many ties
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, v array<double>")
    queries = index.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "v AS q")
    want = sorted((q, d, rank) for q in range(0, 300, 20) for rank, (_, d) in enumerate(sorted((-round(float(v[q] @ v[i]), 6), i) for i in range(300) if i != q)[:5], 1))
    monkeypatch.setattr(retrieval, "AT_ONCE", 7)
    got = retrieval.vector_search(index.repartition(3, "doc_id"), queries, 5, itself=False)
    assert sorted((x["query_id"], x["doc_id"], x["rank"]) for x in got.collect()) == want
