"""The pipeline's stages on small tables."""

import corpus_pipeline

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, D)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame(
        [(1, "the words of a text in some language " * 4, "en", "a", 1, "x"), (1, "the words of a text in some language " * 4, "en", "a", 2, "x"), (None, None, None, None, 3, None), (None, "un texte en francais avec des mots " * 4, "fr", None, 4, ""), (5, "", "en", "b", 5, "z")] * 2,
        "doc_id long, text string, lang string, source string, _row int, mix string",
    )
    for some in (rows, rows.limit(0)):
        docs = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, D)
            assert docs.columns == rows.columns
        kept = {(r.doc_id, r.text) for r in docs.collect()}
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
        assert {p.doc_id for p in packed} == {k for k, _ in kept}
    first = corpus_pipeline.STAGES[0][1](spark, rows, D)
    assert {r.text[:3] for r in first.collect()} <= {"the", "un "}
    second = corpus_pipeline.STAGES[1][1](spark, rows.where("text <> ''"), D)
    assert sorted(r.text[:3] for r in second.collect()) == ["the", "un "]
