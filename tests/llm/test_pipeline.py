"""The corpus pipeline, each stage against a plain version of its rule over its own input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import plain_contamination, toxic_rows
from tsengine.llm import packing, toxicity
from tsengine.llm.queries import public_vocabulary
from tsengine.llm.store import table

SMALL = "/root/testdata/sf0.001"
EXTRA = ("score", "n_words", "n_dropped", "keep_bitmap", "row_key", "kept", "component_id", "n_hit", "_row", "_key")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The smallest tables with labelled toxic and clean documents put in."""
    folder = f"{tmp_path_factory.mktemp('tables')}"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    planted = spark.createDataFrame([(50_000 + i, t, y) for i, t, y in toxic_rows(300)], "doc_id long, text string, toxic int")
    docs.unionByName(planted.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).drop("toxic"), allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels.filter("toxic = 0").unionByName(planted.select("doc_id", "toxic")).write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(f"my {c}") for c in EXTRA})
    more = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "scarce " * 50_000)]
    odd = spark.createDataFrame(more, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    again = docs.filter("doc_id % 50 = 0")
    return docs.unionByName(again).unionByName(odd, allowMissingColumns=True)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def toxic(spark, rows, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {(r.doc_id, r.text) for r in toxicity.toxicity(docs.select("doc_id", "text"), labels, ["doc_id", "text"]).collect() if r.score >= 0.5}
    assert bad  # the model itself is tested against held-out labels
    return sorted((r for r in rows if r not in bad), key=str)


def deduplicated_lines(spark, rows, docs, sf):
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for d, t in rows:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d)
        out.append((d, kept))
    return sorted(out, key=str)


def different(spark, rows, docs, sf):
    rows = sorted(rows, key=str)
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return sorted((min(g, key=lambda r: r[0]) for g in groups.values()), key=str)


def uncontaminated(spark, rows, docs, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    distinct = sorted(set(rows), key=str)
    bad = {d for d, n, hit, _ in plain_contamination(distinct, items) if hit and 20 * hit >= n}
    return sorted((r for r in rows if r[0] not in bad), key=str)


PLAIN = {"toxicity": toxic, "line_dedup": deduplicated_lines, "ngram_jaccard_join": different, "decontamination": uncontaminated}


def test_stages_by_brute_force(spark, documents, sf):
    docs = table(documents, "pipeline-test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = table(stage(spark, docs, sf), "pipeline-test")
        assert out.columns == documents.columns and out.filter(" AND ".join(f"{c} <> 'my {c}'" for c in EXTRA)).isEmpty()
        got = sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()), key=str)
        assert got == PLAIN[name](spark, rows, docs, sf), name
        docs = out
    voc = public_vocabulary()
    slow = packing.Tokens(voc["vocabulary"], None, None)
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r["ids"], "<u4")))
    assert {d: np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])]).tolist() for d, p in pieces.items()} == {r.doc_id: slow.ids(r.text).tolist() for r in docs.collect()}


def test_stages_of_nothing(spark, documents, sf):
    docs = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == documents.columns)


def test_run_is_its_stages(spark, sf):
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
