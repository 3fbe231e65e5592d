"""The pipeline's stages on the smallest tables, each against what it should make of its own input; the llm queries' SQL."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import duckdb
import pytest
from test_operators import ids_of, lines_by_brute_force, near_copies_by_brute_force

import corpus_pipeline
from logweave.llm.common import written
from logweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "packing"]
    for df in outputs[:-1]:
        assert df.columns == outputs[0].columns and [f.dataType for f in df.schema] == [f.dataType for f in outputs[0].schema]


def test_classifier_drops_what_it_rejects(spark, outputs):
    scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op6_quality"](spark, SF).collect()}
    assert texts(outputs[1]) == [t for t in texts(outputs[0]) if scored[t[0]] == 1]
    assert 0 < outputs[1].count() < outputs[0].count()


def test_lines(outputs):
    assert texts(outputs[2]) == [(i, text) for i, _, _, text in lines_by_brute_force(texts(outputs[1]))]
    assert outputs[2].where("n_chars <> length(text)").count() == 0


def test_near_copies(outputs):
    before, after = dict(texts(outputs[2])), dict(texts(outputs[3]))
    assert after.items() <= before.items()
    alike = near_copies_by_brute_force(before)
    near = {p for p, j in alike.items() if j >= 0.8}
    # one at most stays of texts that are one, and what goes is like something that is not
    assert all(not {a, b} <= after.keys() for a, b in near if alike[a, b] == 1)
    assert sum({a, b} <= after.keys() for a, b in near) <= 0.1 * len(near)
    gone = before.keys() - after.keys()
    assert gone and all(any(i in p and j >= 0.795 for p, j in alike.items()) for i in gone)


def test_mixture(outputs):
    before, after = Counter(texts(outputs[3])), Counter(texts(outputs[4]))
    assert before.keys() == after.keys() and max(after.values()) <= 3
    tokens = lambda df: df.selectExpr("source", "size(array_remove(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), '')) as n").groupBy("source").sum("n").collect()
    old, new = ({r[0]: r[1] for r in tokens(df)} for df in (outputs[3], outputs[4]))
    assert max(new[s] / old[s] for s in old if old[s]) <= 2.0001


def test_packing_covers_every_row(outputs):
    rows = Counter(texts(outputs[4]))
    pieces = defaultdict(Counter)
    for r in outputs[5].collect():
        pieces[r["doc_id"]][r["start"], bytes(r["ids"])] += 1
    import numpy as np

    for (i, text), times in rows.items():
        ids = np.array(ids_of(text), "<u4")
        held = np.zeros(len(ids), int)
        for (start, part), n in pieces[i].items():
            assert part == ids[start : start + len(part) // 4].tobytes()
            held[start : start + len(part) // 4] += n
        assert (held == times).all()


def test_run(spark, outputs):
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == outputs[5].select("doc_id").distinct().count()
    assert corpus_pipeline.ORACLE_SQL is None and set(key) <= set(outputs[5].columns)


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    spell = lambda rows: sorted(tuple(f"{x:.12g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert spell(df.select(*columns).collect()) == spell(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())


def test_stages_keep_extra_columns(spark, outputs):
    from pyspark.sql import functions as F

    names = ["score", "predicted", "held_out", "weight", "copies", "n_tokens", "block_key", "n_lines", "n_dropped", "passes", "row"]
    docs = outputs[0].select("*", *((F.col("doc_id") * 10 + k).alias(n) for k, n in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == [*outputs[0].columns, *names]
        assert docs.where(" or ".join(f"{n} <> doc_id * 10 + {k}" for k, n in enumerate(names))).count() == 0
    assert stage is not None and docs.count() == outputs[4].count()
