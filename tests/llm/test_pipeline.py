"""The pipeline stage by stage against the plain versions."""

import duckdb
import pytest

import corpus_pipeline
from medlake.llm import queries

from .test_operators import DOCS, blank, fixture_texts, plain_components, plain_leak, plain_line_dedup

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    texts = fixture_texts()
    item = texts[13]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "ab"[i % 2], "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    rows = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    ids, gone = list(rows), plain_line_dedup(list(rows.values()))
    rows = {i: "\n".join(x for p, x in enumerate(rows[i].split("\n")) if p not in g) for i, g in zip(ids, gone, strict=True) if not g or not all(blank(x) for p, x in enumerate(rows[i].split("\n")) if p not in g)}
    ids, (of, _) = list(rows), plain_components(list(rows.values()), 5)
    rows = {i: rows[i] for k, i in enumerate(ids) if of[k] == k}
    want = {i for i, t in rows.items() if plain_leak(item, t) is None}

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == want and len(want) < len(rows)
    assert all(r.round_trip for r in got.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "encoding"]


@pytest.mark.parametrize("benchmark", [[], [(0, None), (None, "x" * 40)]])
def test_pipeline_of_edges(spark, tmp_path, benchmark):
    """Empty tables, null ids and texts, repeated rows, and extra columns under names that the stages use themselves."""
    d, extra = str(tmp_path), "key string, id long, class long, gone boolean, place int, piece string"
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], f"{DOCS}, {extra}").write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    fill = ("k", 1, 2, True, 3, "p")
    rows = [(1, "some clean words of one text\nand a second line of it", "a", "s", 50, *fill), (None, "other words that no text has but this", None, None, None, *fill), (3, None, "a", "s", None, *fill)]
    rows += [(4, "a row that stands twice in the table, all its columns alike", "a", "s", 60, *fill)] * 2
    spark.createDataFrame(rows, f"{DOCS}, {extra}").write.mode("overwrite").parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == {1, None, 4} and all(r.round_trip for r in got)


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    """Against DuckDB, on the smallest tables."""
    con = duckdb.connect()
    for name_of in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{SF_DIR}/{name_of}.parquet'")
    df, cur = queries.QUERIES[name](spark, SF_DIR), con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted(tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect()) == want and sorted(columns) == sorted(df.columns)
