"""The pipeline's stages, each on its own input, and the registered queries on the smallest tables."""

import collections
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quire.llm import queries as Q
from quire.llm import tokens
from quire.llm.common import BATCH_BYTES, BATCH_SETTING, Stages

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = SPACED.findall(low(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages, seen = docs.columns, Stages(spark, "test"), {}
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, small)
        docs = stages.put(docs, name)
        seen[name] = (before, docs)
        assert name == "token_output" or docs.columns == columns
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = seen["quality"][1].join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count() + 1
    assert kept.where("quality = 1").count() >= 0.95 * labels.join(seen["quality"][0], "doc_id").where("quality = 1").count()
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["near_dedup"])
    sets = {d: shingles(t) for d, t in before.items()}
    holders = collections.defaultdict(set)
    for d, own in sets.items():
        for x in own:
            holders[x].add(d)
    alike = lambda d, e: 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])
    near = {d: {e for e in set().union(*(holders[x] for x in own)) if e != d and alike(d, e)} for d, own in sets.items() if own}
    smallest = {}
    for d in sorted(near):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in smallest:
                smallest[x] = d
                todo += near[x]
    assert after == {d: t for d, t in before.items() if smallest.get(d, d) == d}
    before, after = seen["decontamination"]
    assert before.select("doc_id").exceptAll(after.select("doc_id")).count() == 0
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    windows = set()
    for r in bench.collect():
        w = ALNUM.findall(low(r.text))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    held = lambda t: any(tuple(w[k : k + n]) in windows for w in [ALNUM.findall(low(t))] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    was, now = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
    assert any(held(t) for t in was.values()) and not any(held(t) for t in now.values())
    assert all(now[d] == t for d, t in was.items() if not held(t))
    mixed = seen["mixing"][1]
    assert seen["token_output"][1].count() == mixed.count()
    assert mixed.select("doc_id").distinct().count() > 0
    clean = seen["mixing"][0].join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").select("doc_id").distinct()
    assert clean.join(mixed, "doc_id", "left_anti").count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, one id with several texts, blank and very long texts; and no rows at all."""
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words, "en", None, 1), (1, words, "en", None, 1), (2, words + " end", None, "s", 1), (3, None, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (None, words, "en", "s", 1), (None, None, None, None, None), (5, "first text of five", "en", "s", 1), (5, "second text of five", "en", "s", 1), (6, "long " * 50_000, "en", "s", 1)]
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)
    got = {name: [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in P.STAGES}
    assert len(got["quality"]) == len(rows)
    kept = sorted(((r[0], (r[1] or "")[:10]) for r in got["near_dedup"]), key=repr)
    assert kept == sorted([(1, words[:10]), (3, ""), (4, ""), (None, words[:10]), (None, ""), (5, "first text"), (6, "long long ")], key=repr)
    assert sorted((r[0], (r[1] or "").strip()[:8]) for r in got["decontamination"] if r[0]) == [(1, ""), (1, ""), (2, "end"), (3, ""), (3, ""), (4, ""), (5, "first te"), (5, "second t"), (6, "long lon")]
    assert {r[0] for r in got["mixing"]} <= {r[0] for r in rows} and len(got["token_output"]) == len(rows)
    for name, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries(spark, small, name):
    table = "conversations" if name.startswith("op6") else "documents"
    rows = spark.read.parquet(f"{small}/{table}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if name.startswith("op6") else rows.count()
    assert Q.QUERIES[name](spark, small).count() == want


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    result = con.execute(Q.ORACLE[name])
    columns = [c[0] for c in result.description]
    df = Q.QUERIES[name](spark, small)
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(r)
    assert sorted(map(key, df.select(*[F.col(c) for c in columns]).collect()), key=repr) == sorted(result.fetchall(), key=repr)


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_texts_in_small_batches(spark, small, name, stage):
    """A task's texts never come to Python as one batch, however many there are."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    spark.conf.unset(BATCH_SETTING)
    stage(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    texts = spark.range(0, 4000, 1, 1).select("id", F.expr("repeat('word ', 600)").alias("text"))
    got = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 4000
    assert max(r.bytes for r in got) <= 2 * BATCH_BYTES
    spark.conf.set(BATCH_SETTING, "3m")
    stage(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert spark.conf.get(BATCH_SETTING) == "3m"  # a bound that the session has already
    spark.conf.unset(BATCH_SETTING)


def test_tokens_are_read_with_one_kind_of_worker(spark):
    """The sums of the parts go back without rows pickled in Python, which have workers of their own on each executor."""
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    out = tokens.read_tokens(tokens.write_tokens(docs, P.tokenizer_path()))
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in out.orderBy("start").collect()] == [1, 2]
