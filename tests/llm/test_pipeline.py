"""The pipeline: each stage against its operator or plain Python, and the run."""

import hashlib
import random
import time

import corpus_pipeline
import pytest
from granary.llm import common, decontaminate, jaccard_join, pieces
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """A small copy of the tables, with copies, leaks, a secret, a column more, null and empty texts."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    r = random.Random(1)
    words = [f"w{r.randrange(999)}" for _ in range(80)]
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("text IS NOT NULL").orderBy("item_id").head()["text"]
    more = [(90_001, " ".join(words)), (90_002, " ".join(words)), (90_003, " ".join([*words[:79], "other"])), (90_004, None), (90_005, ""), (90_006, "lead words " + item + " and a tail"), (90_007, "see token = 'abcdefghijklmnop' here")]
    rows = spark.createDataFrame([(i, t, "en", "own", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(rows.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))).withColumn("_key", F.lit("own")).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


def texts(df):
    return {(r["doc_id"], r["text"]) for r in df.collect()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.where("false")):
            made = stage(spark, some, folder)
            assert name == "encoding" or made.columns == docs.columns
            assert made.count() == 0 or some is docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secret_scan", "encoding"]


def test_near_duplicates_and_leaks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = texts(corpus_pipeline.near_duplicates(spark, docs, folder))
    group = {(r["doc_id"], r["text"]): r for r in jaccard_join.join_components(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert {i for i, _ in kept if i is not None and 90_001 <= i <= 90_003} == {90_001}
    assert len(kept) == len({r["component_id"] for r in group.values() if r["n_shingles"]}) + sum(not r["n_shingles"] for r in group.values())
    left = texts(corpus_pipeline.decontamination(spark, docs, folder))
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert 90_006 in leaked and left == {x for x in texts(docs) if x[0] not in leaked}


def test_secrets_and_encoding(spark, folder):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.secret_scan(spark, docs, folder)
    row = clean.where("doc_id = 90007").head()
    assert row["text"] == "see [assign]' here" and row["n_chars"] == len(row["text"]) and clean.count() == docs.count()
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = {r["doc_id"]: lib.encode(r["text"] or "") for r in docs.collect()}
    for r in corpus_pipeline.encoding(spark, docs, folder).collect():
        assert r["ids"] == want[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(want[r["doc_id"]]).encode()).hexdigest()


def test_run(spark, folder):
    """The run gives what the stages give one after another."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    got = key(corpus_pipeline.run(spark, folder))
    assert got == key(docs) and 90_002 not in {i for i, _ in got} and 90_006 not in {i for i, _ in got}


def test_near_duplicates_forget_their_shuffles(spark, small, monkeypatch):
    """Shuffle files of what is written go while the stage runs, not at its end."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: manager.getAllFiles().length()
    fell = []

    def counted(session):
        had = files()
        common.forget_shuffles(session)
        time.sleep(0.5)
        fell.append(had - files())

    monkeypatch.setattr(jaccard_join, "forget_shuffles", counted)
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{small}/documents.parquet"), small).count()
    assert len(fell) >= 3 and max(fell) > 0
