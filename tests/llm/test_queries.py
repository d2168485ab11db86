"""The queries and the pipeline on the smallest tables."""

import pathlib
import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from quireworks.llm import quality, queries
from quireworks.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    cell = lambda v: None if v is None or v is pd.NA or v != v else (round(v, 6) if isinstance(v, float) and v % 1 else (int(v) if isinstance(v, float) else v))
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(con.execute(queries.ORACLES[name]).fetchdf())


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


def test_pipeline_keeps_the_tables_columns(spark, tmp_path):
    docs, n = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[2] == n[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n[-1]


def test_stages_close_the_tables_of_the_stage_before(spark, tmp_path):
    here = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    docs, tables = spark.read.parquet(f"{SF}/documents.parquet").limit(100), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        old = set(here.iterdir())
        out = stage(spark, docs, SF)
        new = [p for p in here.iterdir() if p not in old]
        if i > 1:
            assert tables and not any(p.exists() for p in tables)
        tables = new
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() > 0
    first = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, verdict int")
    assert quality.judge(first, None, "_v").select("verdict").first()["verdict"] == 5


def test_passages_of_over_fifty_words_leave_the_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage = some(55)
    rows = [(i, some(80) + " " + passage + " " + some(80)) for i in range(4)] + [(10 + i, some(200)) for i in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert all(passage not in out[i] and len(out[i]) > 500 for i in range(4))
    assert all(out[10 + i] == rows[4 + i][1] for i in range(4))
