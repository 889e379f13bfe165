"""The pipeline against brute force, its stages' columns, and the queries against their SQL."""

from __future__ import annotations

import os
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from strandline.llm import pii, queries, toxicity  # noqa: E402
from tests.llm import test_exact_dedup, test_jaccard_join, test_pii  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.sql(queries.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert sorted(([r[i] for i in at] for r in result.fetchall()), key=repr) == sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def sanitised(texts):
    out = []
    for text, terms in zip(texts, test_pii.plain_terms(texts), strict=True):
        spans = [(s, e, pii.PLACEHOLDERS[k]) for k, s, e, _ in test_pii.plain_spans(text)] + terms
        done, at = "", 0
        for start, end, sign in sorted(spans, key=lambda x: x[:2]):
            if start >= at:
                done += text[at:start] + sign
            at = max(at, end)
        out.append(done + text[at:])
    return out


def test_run_against_brute_force(spark, sf_dir):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~queries.held_out()))
    toxic = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    left = sorted((i, t) for i, t in rows.items() if i not in toxic)
    kept = {r[0] for r in test_exact_dedup.brute(left) if r[3]}
    left = [(i, t) for i, t in left if i in kept]
    stay = {r[1] for r in test_jaccard_join.brute(left)}
    left = [(i, t) for i, t in left if i in stay]
    left = list(zip([i for i, _ in left], sanitised([t for _, t in left]), strict=True))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in left}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def test_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = docs.unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.dtypes == docs.dtypes, name
        assert out.count() > 0
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.dtypes == docs.dtypes and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).agg(F.count_distinct("sequence_id") == F.count(F.lit(1))).first()[0]


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard join", "pii", "packing"]
