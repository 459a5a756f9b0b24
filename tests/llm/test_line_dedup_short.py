from tallyframe.llm.line_dedup import dedup_lines


def test_equal_short_lines_of_three_words_are_dropped(spark):
    notice = "Erreth was ofretihaou the that edouhe.\n Of, edti oner."
    docs = [(1, notice), (2, notice + "\nAnd.\nBy To."), (3, "And.\nBy To.\nOf, edti onez.\n\n"), (4, "Of, edti oner.\n\na b c\nxa b c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.dropped, r.text) for r in dedup_lines(frame).collect()}
    assert got == {
        1: ([], notice),
        2: ([0, 1], "And.\nBy To."),
        3: ([], docs[2][1]),  # other short lines differ by a character and stay; so do lines of one or two words
        4: ([0], "\na b c\nxa b c"),
    }
