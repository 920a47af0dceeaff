from __future__ import annotations

from daybook.llm import language


def test_copies_do_not_thin_out_a_dictionary(spark):
    copies = [("always the same words", "one")] * 2000 + [(f"text number {i}", "one") for i in range(20)]
    many = [(f"another text {i}", "two") for i in range(300)]
    learned = language.learn_dictionaries(spark.createDataFrame(copies + many, "text string, lang string"))
    assert len(set(learned["one"].split(b"\n"))) == 21 and len(set(learned["two"].split(b"\n"))) == 96
