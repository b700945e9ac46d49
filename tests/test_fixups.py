"""Tokenizer fix-ups on every segment."""

from clauseweave.queries import CORE
from oracle import same


def test_all_segments_are_fixed(spark, data):
    q = CORE.queries["tokenizer_fixups_all"]
    same(q, CORE.oracles["tokenizer_fixups_all"], spark, data)
    texts = spark.read.parquet(f"{data}/segments.parquet").where("text is not null")
    assert q(spark, data).count() == texts.count() > CORE.queries["tokenizer_fixups"](spark, data).count()


def test_other_characters(spark, tmp_path):
    rows = [(1, "Your “id” and e-mail café(s)"), (2, "Мы use Wi-Fi"), (3, None)]
    spark.createDataFrame(rows, "seg_uid long, text string").write.parquet(f"{tmp_path}/segments.parquet")
    got = {r.seg_uid: r.fixed for r in CORE.queries["tokenizer_fixups_all"](spark, str(tmp_path)).collect()}
    assert got == {1: "Your “ID” and email cafes", 2: "Мы use WiFi"}
