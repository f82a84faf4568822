"""Texts that share a shingle are put into few blocks, so that what is sent between blocks stays far below all pairs."""

from corpusloom.llm import probminhash
from corpusloom.llm.shared import Tables


def test_texts_that_share_a_shingle_lie_in_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "BLOCK", 32)
    groups, each = 8, 32
    rows = [(g * each + i, 1, g * each + i, element, element % 2 == 1) for i in range(each) for g in range(groups) for element in (2 * g, 2 * g + 1)]
    nodes = spark.createDataFrame(rows, "node long, size long, label long, element long, home boolean").repartition(5)
    t = Tables(spark)
    parts, met = probminhash.meetings(nodes, t)
    block = {r["node"]: r["part"] for r in parts.collect()}
    sent = {(r["node"], r["part"]) for r in met.collect()}
    assert len(block) == groups * each and max(list(block.values()).count(p) for p in set(block.values())) <= 32
    # every pair of a group meets, the larger label in the block of the smaller
    assert all((g * each + i, block[g * each + j]) in sent for g in range(groups) for i in range(each) for j in range(i))
    assert len(sent) <= 2 * groups * each
    t.drop("ranged", "parts", "met")
