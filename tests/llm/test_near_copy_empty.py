import corpus_pipeline


def test_one_document_without_words_stays(spark):
    rows = [(d, t, "en", "a", 0) for d, t in ((3, ""), (2, None), (7, " \t\n"), (9, "some words here"), (None, ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, ""), (2, None), (9, "some words here")]
