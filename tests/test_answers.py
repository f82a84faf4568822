import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chrf, collapse, curves, facts, runs, statistics, turns


def one(spark, column, *values, schema="a string, b string, c string"):
    return spark.createDataFrame([values], ", ".join(schema.split(", ")[: len(values)])).select(column).first()[0]


@pytest.mark.parametrize("needle,hay,want", [("no", "nord", False), ("no", "a no b", True), ("12", "120", False), ("abc*", "abcdef", True), ("abc", "abcdef", False), ("a.c", "abc", False), ("é", "thé é", True), ("c++", "c++ x", False), ("l'eau", "de l’eau", True)])
def test_contains(spark, needle, hay, want):
    assert one(spark, facts.contains(facts.normalised(F.col("a")), facts.normalised(F.col("b"))), needle, hay) == want


def test_score_and_judge(spark):
    rows = spark.createDataFrame([("oui non", True), ("oui", True), ("non", True), ("rien", True), ("rien", False), ("oui non", None)], "answer string, whole boolean")
    rows = rows.withColumn("expected", F.array(F.lit("oui"))).withColumn("traps", F.array(F.lit("non")))
    assert [r[0] for r in rows.select(facts.score(F.col("answer"), F.col("expected"), F.col("traps"), F.col("whole"))).collect()] == ["ambigu", "juste", "piege", "faux", "ambigu", "ambigu"]
    other = spark.createDataFrame([("Nord", ["no"], []), ("360", ["36"], []), ("36 km", ["36"], []), ("OUAGA", ["Ouagà"], ["x"])], "answer string, expected array<string>, traps array<string>")
    assert [r["verdict"] for r in facts.judged(other).collect()] == ["juste", "faux", "juste", "juste"]


def test_budget_and_probe(spark):
    schema = "budget int, faits array<struct<id:string,complet:boolean>>"
    rows = spark.createDataFrame([(320, []), (None, [("a", True)]), (None, [("a", None)]), (None, [])], schema)
    assert [r[0] for r in rows.select(facts.budget_of(F.col("budget"), F.col("faits"))).collect()] == [320, 128, 48, 48]
    probe = F.array(F.lit("b"), F.lit("a"))
    assert spark.range(1).select(facts.answers_the_probe(F.lit(320), F.array(F.lit("a"), F.lit("b"), F.lit("a")), probe)).first()[0]
    assert not spark.range(1).select(facts.answers_the_probe(F.lit(None).cast("int"), probe, probe)).first()[0]


def test_rescoring_refuses_unknown_facts(spark):
    defs = spark.createDataFrame([("f", ["x"], None)], "id string, attendu array<string>, piege array<string>")
    schema = "id string, note string, reponse string, complet boolean"
    got = facts.changed(facts.rescored(spark.createDataFrame([("f", "faux", "X!", None)], schema), defs)).first()
    assert got["change"] == "f faux->juste"
    with pytest.raises(Exception, match="no such fact"):
        facts.rescored(spark.createDataFrame([("g", "faux", "x", None)], schema), defs).collect()


@pytest.mark.parametrize(
    "answers,openings,repeats,speaks,each",
    [(["Ned sã x%d" % i for i in range(12)], (1, 12), (12, 1), False, True), (["a b", "a b", "c d", "e f", "g h"], (4, 2), (4, 2), True, False), (["a b c", "a b d", "e f"], (2, 2), (3, 1), False, True), (["a", "b"], (2, 1), (2, 1), True, True)],
)
def test_collapse(spark, answers, openings, repeats, speaks, each):
    df = spark.createDataFrame([(1, a) for a in answers], "g int, obtenu string")
    o, r, v = collapse.openings(df, ["g"]).first(), collapse.repeats(df, ["g"]).first(), collapse.verdicts(df, ["g"]).first()
    assert (o["distinct_groups"], o["largest"]) == openings and (r["distinct_groups"], r["largest"]) == repeats
    assert (v["speaks_to_each"], v["answers_each"]) == (speaks, each) and (v["collapsed"] is None) == (speaks and each)


def test_counted_answers(spark):
    answers = spark.createDataFrame([("P2@checkpoint-6120", "218-checkpoint-218", "x", "Bõe la yaa?"), (None, "base", "y", "yaa la bõe"), ("P2", "p", "z", "other"), ("P2", "p", "z", None)], "depart string, point string, obtenu string, question string")
    questions = spark.createDataFrame([("yaa la bõe",)], "question string")
    assert {(r["arm"], r["step"], r["obtenu"]) for r in collapse.counted_answers(answers, questions).collect()} == {("P2", "218", "x"), ("?", "base", "y")}


def test_draws_and_interval(spark):
    assert statistics.python_draws(20260831, 200, 1)[0][:10].tolist() == [51, 48, 131, 75, 116, 172, 20, 112, 143, 196]
    assert statistics.python_draws(20260825, 1012, 1)[0][:10].tolist() == [71, 278, 652, 831, 187, 831, 345, 841, 438, 855]
    rows = spark.createDataFrame([("g", i, 100.0 + i % 7, 50 + i % 13) for i in range(200)], "g string, pos int, nll double, chars long")
    got = statistics.intervals(rows, ["g"]).first()
    assert (got["low"], got["high"]) == pytest.approx((2.6332350826121784, 2.6842745139557262), abs=1e-12)


def test_differences(spark):
    rows = spark.createDataFrame([("g", i, 100.0 + i % 7, 50) for i in range(50)], "g string, pos int, nll double, chars long")
    assert tuple(statistics.differences(rows, rows, ["g"], resamples=50).first())[1:] == (0.0, 0.0, 0.0)
    got = statistics.differences(rows, rows.withColumn("nll", F.col("nll") * 2), ["g"], resamples=50).first()
    assert got["low"] > 0
    assert statistics.differences(rows, rows.filter("pos > 0"), ["g"], resamples=50).first()["value"] is None
    lone = rows.limit(1)
    single = statistics.intervals(lone, ["g"]).first()
    assert single["low"] == single["high"] == single["value"]


def curve(spark, *rows):
    return spark.createDataFrame(rows, "arm string, point string, step long, moore_humain double, signal boolean, collapsed string")


def test_cut_and_best(spark):
    got = curves.cut_and_best(curve(spark, ("A", "a", 100, 1.8, False, None), ("A", "b", 200, 1.5, False, None), ("A", "c", 300, 1.6, True, None), ("A", "d", 400, 1.0, False, None), ("B", "a", 50, 1.0, True, None), ("C", "a", 1, 1.0, False, "why"), ("C", "b", 2, 1.5, False, None), ("C", "c", 3, 1.5, False, None)))
    assert {(r["arm"], r["step"]) for r in got.filter("kept").collect()} == {("A", 200), ("C", 2)}
    assert {r["cut"] for r in got.filter("arm = 'A'").collect()} == {300}
    assert [r["step"] for r in curves.shown(got).filter("arm = 'B'").collect()] == [50]


def test_marks(spark):
    base = spark.createDataFrame([("base", "base", 0, 2.0, 1.0, 1.0, 1.0, 1.0)], "arm string, point string, step long, moore_humain double, anglais double, francais double, code double, maths double")
    rows = base.unionByName(spark.createDataFrame([("A", "x", 100, 1.8, 1.0, 1.0, 1.0, 1.0), ("A", "y", 200, 1.8, 1.2, 1.029, 1.0, 1.0)], base.schema))
    p = curves.with_previous(rows, base, ["moore_humain", *curves.SHOULD_HOLD])
    p = p.withColumns({c: F.lit(None).cast("double") for c in ("rise", "rise_low", "rise_high")}).withColumn("comparable", F.col("step") > 100).withColumn("lost_ids", F.array(F.lit("f1")))
    got = [r["marks"] for r in p.withColumn("marks", curves.marks()).orderBy("step").collect()]
    assert got[0] == [curves.NOT_COMPARABLE]
    assert len(got[1]) == 3 and got[1][0].startswith("overfitting?") and got[1][1] == "facts learned otherwise: f1" and got[1][2] == "anglais +20.0 % (over 3 %)"


@pytest.mark.parametrize("name,want", [("base", (0, 0)), ("A-20260831-1024-checkpoint-219", (1, 219)), ("p12x3", (1, 123)), ("x", (1, 0))])
def test_order(spark, name, want):
    assert tuple(one(spark, curves.order_key(F.col("a")), name)) == want


def test_names(spark):
    assert one(spark, curves.arm_of(F.col("a"), F.col("b")), "x", "/content/cpt/A-20260831-1024/checkpoint-6005") == "A"
    assert one(spark, curves.arm_of(F.col("a"), F.col("b")), "x", "/content/sft/sft-P2-6120-x/checkpoint-217") == "sft"
    assert one(spark, curves.arm_of(F.col("a"), F.col("b")), "base", "") == "base" and one(spark, curves.arm_of(F.col("a"), F.col("b")), "x", "/a/b") == "?"
    for name, want in [("A-6005-checkpoint-1191", True), ("P2-6120-checkpoint-1191", True), ("base-checkpoint-1191", False), ("checkpoint-6005", False)]:
        assert one(spark, curves.is_arm_point(F.col("a")), name) == want
    assert one(spark, curves.run_label(F.col("a")), "C@checkpoint-4820") == "C-4820" and one(spark, curves.run_label(F.col("a")), "C") == "C"


@pytest.mark.parametrize("steps,per,want", [(range(219, 6006, 219), 1201, [219, 1314, 2409, 3723, 4818]), ([218, 436, 654, 872, 1090, 1308, 1310], 655, [218, 872, 1310]), ([1, 2], 0, [])])
def test_epoch_saves(spark, steps, per, want):
    df = spark.createDataFrame([("r", s) for s in steps], "run string, step long")
    assert [r["step"] for r in runs.epoch_saves(df, per).filter("opens").orderBy("step").collect()] == want


def test_retention_and_deletions(spark):
    df = runs.retention(spark.createDataFrame([("r", s) for s in (1, 5, 11)], "run string, step long"), 10, keep_all=False)
    assert [(r["step"], r["action"]) for r in df.orderBy("step").collect()] == [(1, "prune"), (5, "delete"), (11, None)]
    keys = spark.createDataFrame([("r/checkpoint-1/optimizer.pt",), ("r/checkpoint-1/model.bin",), ("r/checkpoint-5/model.bin",), ("r/checkpoint-11/model.bin",), ("r/log",)], "key string")
    assert {r["key"] for r in runs.deletions(keys, df).collect()} == {"r/checkpoint-1/optimizer.pt", "r/checkpoint-5/model.bin"}


def test_checkpoints_by_number(spark):
    keys = spark.createDataFrame([(f"r/checkpoint-{n}/x",) for n in ("2168", "542", "best")] + [("r/checkpoint-542/trainer_state.json",), ("s/x",)], "key string")
    assert [r["step"] for r in runs.checkpoints(keys).collect()] == [542, 2168]
    assert runs.start_missing(keys, "r") is not None and runs.start_missing(keys, "base") is None
    assert runs.resolved(keys, "r").count() == 0
    more = keys.unionAll(spark.createDataFrame([("r/checkpoint-2168/trainer_state.json",)], "key string"))
    assert runs.resolved(more, "r").first()["name"] == "checkpoint-2168"
    assert runs.resume_named(more, "r").first()["step"] == 2168 and runs.resume_named(keys, "r/checkpoint-542").first()["step"] == 542
    with pytest.raises(ValueError):
        runs.resume_named(keys, "r")


@pytest.mark.parametrize("done,before,total,refused", [(1776, 1965, 1310, True), (1191, 1191, 1310, True), (655, 1310, 1310, False), (655, None, 1310, False), (1310, None, 1310, True)])
def test_resume(spark, done, before, total, refused):
    got = spark.range(1).select(runs.resume_refused(F.lit(done), F.lit(before).cast("int"), F.lit(total))).first()[0]
    assert (got is not None) == refused


def test_by_eval(spark):
    losses = {196: 1.32, 392: 1.29, 588: 1.26, 1176: 1.30, 1372: 1.20, 1764: 1.42}
    log = spark.createDataFrame([("r", s, x) for s, x in losses.items()], "run string, pas int, eval_loss double")
    kept = spark.createDataFrame([("r", s) for s in (196, 588, 1176, 1764)], "run string, step long")
    assert tuple(runs.by_eval(log, kept).first())[1:] == ("checkpoint-588", 588, 1.26)
    assert runs.by_eval(log.limit(0), kept).count() == 0


def test_alignment(spark):
    schema = "id int, pos int, text string"
    fr, mos = spark.createDataFrame([(0, 0, "un"), (1, 1, "deux")], schema), spark.createDataFrame([(1, 0, "yiibu"), (0, 1, "yembre"), (9, 2, "x")], schema)
    assert [(r["left_text"], r["right_text"]) for r in chrf.aligned(fr, mos).collect()] == [("un", "yembre"), ("deux", "yiibu")]
    with pytest.raises(Exception, match="no line for id"):
        chrf.aligned(spark.createDataFrame([(5, 0, "x")], schema), mos).collect()


def counted(hypothesis, reference, word_order):
    """The statistics of one pair, n-gram by n-gram."""
    out = []
    sides = [("".join(s.split()), chrf.words_of(s)) for s in (hypothesis or "", reference or "")]
    for part, most in ((0, chrf.CHARS), (1, word_order)):
        for n in range(1, most + 1):
            h, r = (Counter(tuple(s[part][i : i + n]) for i in range(len(s[part]) - n + 1)) for s in sides)
            out += [sum(h.values()), sum(r.values()), sum((h & r).values())]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab é.,😀\n", max_size=14) | st.none(), st.text(alphabet="ab é.,😀\n", max_size=14) | st.none()), max_size=5), st.sampled_from([0, 2]))
def test_ngrams_of_a_batch(pairs, order):
    got = chrf.batch_statistics([h for h, _ in pairs], [r for _, r in pairs], order)
    assert got.tolist() == [counted(h, r, order) for h, r in pairs]


def test_chrf(spark):
    rows = [("s", "d", i, h, r) for i, (h, r) in enumerate([("the cat sat", "the cat sat"), ("a dog", "the dog ran"), ("", "x y z")])] + [("t", "d", i, r, r) for i, r in enumerate(["the cat sat", "the dog ran", "x y z"])]
    df = spark.createDataFrame(rows, "name string, direction string, pos int, hypothesis string, reference string")
    for order in (0, 2):
        got = {r["name"]: r["chrf"] for r in chrf.corpus_score(df, ["name"], order).collect()}
        want = chrf.f_score(np.sum([counted(h, r, order) for n, _, _, h, r in rows if n == "s"], axis=0))
        assert got["t"] == 100.0 and got["s"] == pytest.approx(float(want), abs=0.006)
    same, better = (chrf.paired(df, [pair], draws=200).first() for pair in (("s", "s"), ("t", "s")))
    assert tuple(same)[3:] == (0, 0, 0) and better["difference"] > 0 and better["low"] >= 0


def test_turns(spark):
    messages = [("user", "ab"), ("assistant", "cde")]
    df = spark.createDataFrame([(i, "val", "mos_mos", "expliquer_proverbe", messages) for i in range(20)] + [(99, "train", None, None, [])], "turn_id long, split string, variant string, task string, messages array<struct<role:string,content:string>>")
    assert turns.longest(df).first()[0] == 5 and turns.longest(df.limit(0)).first()[0] == 0
    assert [tuple(r) for r in turns.unlisted_variants(df).collect()] == [("?", 1)]
    picked = [r["turn_id"] for r in turns.sampled_as_python(turns.question_candidates(df)).collect()]
    assert picked == random.Random(20260912).sample(range(20), 12)
    assert turns.sampled(turns.question_candidates(df)).count() == 12
    with pytest.raises(ValueError):
        turns.sampled(df.limit(3))
    usable = df.filter(turns.usable(F.col("messages"), F.lit(2), F.lit(5), 5)).count()
    assert usable == 20 and df.filter(turns.usable(F.col("messages"), F.lit(5), F.lit(5), 5)).count() == 0
    assert spark.range(1).select(turns.label_mask(F.array(*map(F.lit, (7, 8, 9))), F.lit(2))).first()[0] == [-100, -100, 9]
