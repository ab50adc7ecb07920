"""Every compound that is frequent enough is known, however many there are."""

from lakeloom.llm import scans


def test_no_compound_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(scans, "MIN_SHARE", 0.2)  # a dictionary of five words at most
    compounds = [f"{a}-{b}" for a in ("перша", "друга", "третя") for b in ("частина", "сторона", "година")]
    rows = [(i, "d", i, " слово ".join(compounds)) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id bigint, doc_id string, page int, text string")
    base = pages.select("*", *scans._document())
    words = scans.learn(base, scans.first_pass(base))
    assert words.compounds == set(compounds)
    assert sorted(words.seconds) == ["друга", "перша", "третя"] and sorted(words.seconds["друга"]) == ["година", "сторона", "частина"]
