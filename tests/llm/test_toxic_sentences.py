from quaylight.llm import toxicity


def test_all_offending_sentences_are_located(spark):
    model = toxicity.Model({"bad": 3.0, "odd": 1.0}, -2.0)
    text = "A bad day. Fine. " * 7
    docs = spark.createDataFrame([(1, text), (2, "An odd day. Fine."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [text[x.start : x.end].strip() for x in got[1].offending] == ["A bad day."] * 7
    assert [x.start for x in got[1].offending] == sorted(x.start for x in got[1].offending) and all(x.p >= toxicity.OFFENDING for x in got[1].offending)
    assert len(got[1].worst) == 3
    assert got[2].offending == [] and len(got[2].worst) == 1 and got[3].offending == []
