import os

import pytest

from tallyframe.llm.line_dedup import dedup_lines
from tallyframe.storage import scratch_dir, settle, settle_only


def kept(spark):
    folder = scratch_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_on_the_way_are_deleted(spark):
    def make():
        inner = settle_only(spark, lambda: settle(settle(spark.range(9), "first").where("id < 5"), "second").where("id > 1"), "inner")
        return settle(inner, "third").where("id <> 3")

    before = kept(spark)
    made = settle_only(spark, make, "whole")
    assert [x.rsplit("-", 1)[0] for x in kept(spark) - before] == ["whole"]
    assert sorted(r.id for r in made.collect()) == [2, 4]
    assert settle_only(spark, lambda: spark.range(0), "none").count() == 0


def test_a_failure_leaves_no_tables_behind(spark):
    def make():
        settle(spark.range(3), "lost")
        raise ValueError("no")

    before = kept(spark)
    with pytest.raises(ValueError):
        settle_only(spark, make)
    assert kept(spark) == before


def test_line_dedup_keeps_its_classes_only(spark, table):
    line = "one line that is long enough to be compared with all the others"
    docs = table("doc_id long, text string", (1, line), (2, line + "\nand another line that stands here only this once"))
    before = kept(spark)
    assert sorted((r.doc_id, r.n_dropped) for r in dedup_lines(docs).collect()) == [(1, 0), (2, 1)]
    assert [x.rsplit("-", 1)[0] for x in kept(spark) - before] == ["line-classes"]
