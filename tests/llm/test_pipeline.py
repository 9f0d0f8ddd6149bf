import corpus_pipeline
from arcweave.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = f(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert 0.7 * before < docs.count() <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_take_odd_rows_and_clashing_columns(spark):
    """Null ids and texts, repeated ids, an empty table, columns with the names used inside."""
    from .helpers import documents

    names = {"_id": "_gone", "_text": "_places", "kind": "_keep", "b": "c1"}
    labels = spark.read.parquet(f"{SF}/labels.parquet").count()
    docs = documents(spark, ["some words of one text here", None, "", "some words of one text here", "other words " * 30, "x"], ids=[1, 2, 3, None, 1, None]).withColumnsRenamed(names)
    for rows in (docs, docs.limit(0)):
        n = rows.count()
        for _, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, rows, SF)
            assert out.columns == rows.columns and out.count() == n and labels
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == n


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
