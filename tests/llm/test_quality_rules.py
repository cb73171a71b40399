"""No adaptive rule is a mere copy of a base rule."""

from talus.llm import quality


def test_repeats_have_their_base_rule_only(spark):
    assert "repeat_ratio" not in quality.RATIOS
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words + words[:n]) for n in [0] * 200 + [10, 16, 30]]
    docs = spark.createDataFrame([(i, "en", "s", t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string")
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality.digest(docs).collect()}
    assert [found[i] for i in (200, 201, 202)] == [(False, True), (False, True), (True, False)]
