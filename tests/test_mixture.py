import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import leaks, mixture, packing
from corpusloom.sources import files, tables

DOC = "file string, pos long, part string, text string, tokens long"


def sources(spark, *rows):
    return spark.createDataFrame(rows, "path string, take string, budget long")


def load(spark, docs, plan, paired=None, held=None):
    rows = spark.createDataFrame(docs, DOC)
    routed = None if held is None else spark.createDataFrame([("p", k) for k in held], "part string, held_key string")
    return mixture.loaded(rows, sources(spark, *plan), paired, routed)


def kept(df):
    return [r["pos"] for r in df.filter("kept").orderBy("pos").collect()]


def test_fill_stops_after_the_budget(spark):
    docs = [("f", i, "p", f"text {i}", 4) for i in range(3)]
    assert kept(load(spark, docs, [("f", "fill", 5)])) == [0, 1]
    assert kept(load(spark, docs, [("f", "fill", 0)])) == []
    assert kept(load(spark, docs, [("f", "all", None)])) == [0, 1, 2]


def test_leaks_cost_nothing_and_are_counted_before_the_stop(spark):
    docs = [("f", 0, "p", "one", 4), ("f", 1, "p", "Leak!", 4), ("f", 2, "p", "two", 4), ("f", 3, "p", "leak", 4)]
    rows = load(spark, docs, [("f", "fill", 5)], held=["leak"])
    assert kept(rows) == [0, 2]
    r = mixture.report(rows).first()
    assert (r["documents"], r["tokens"], r["leaks"], r["dropped_paired"]) == (2, 8, 1, 0)


def test_unpaired_drops_first(spark):
    docs = [("f", 0, "p", "Bonjour!", 4), ("f", 1, "p", "autre", 4)]
    paired = mixture.paired_keys(spark.createDataFrame([("bonjour\n\nne y yibeogo",)], "text string"))
    rows = load(spark, docs, [("f", "unpaired", None)], paired)
    assert kept(rows) == [1] and mixture.report(rows).first()["dropped_paired"] == 1
    assert kept(load(spark, docs, [("f", "all", None)], paired)) == [0, 1]


def test_witness_keeps_rows_without_a_register(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("c", "y")], "text string, registre string")
    assert {r["text"] for r in mixture.witness(df, ["x"]).collect()} == {"a", "c"}


def test_plan_refuses_two_takes_and_unknown_phrases(spark):
    schema = "pos int, fichier string, prendre string, tokens long"
    same = mixture.plan(spark.createDataFrame([(0, "a", "tout", None), (1, "a", "cote x", None)], schema)).collect()
    assert [(r["path"], r["take"], r["pos"]) for r in same] == [("a", "all", 0)]
    for rows in ([(0, "a", "tout", None), (1, "a", "completer", 5)], [(0, "a", "completer", 4), (1, "a", "completer", 5)], [(0, "a", "autre", None)]):
        with pytest.raises(Exception, match="two ways|unknown take"):
            mixture.plan(spark.createDataFrame(rows, schema)).collect()


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_containment_from_forty_characters(spark, sent):
    long, short = "abcdefghij" * 4, "abcdefghij" * 3 + "abcdefghi"
    rows = spark.createDataFrame([(0, "p", "x" + long + "y"), (1, "p", "x" + short + "y"), (2, "q", "x" + long), (3, "p", None), (4, "p", "")], "row_id long, part string, _key string")
    routed = spark.createDataFrame([("p", long), ("p", short)], "part string, held_key string").filter(F.length("held_key") >= 40)
    assert [r[0] for r in leaks.contained(rows, routed, sent_chars=sent).collect()] == [0]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_leaks_against_all_pairs(spark, sent):
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abé好") for _ in range(n))
    head = some(60)
    held = [("p", head + some(k)) for k in range(30)] + [("q", some(rng.randrange(1, 90))) for _ in range(40)] + [("p", "short"), ("q", head)]
    texts = [some(rng.randrange(120)) for _ in range(60)] + [some(9) + rng.choice(held)[1] + some(rng.randrange(40)) for _ in range(80)] + [rng.choice(held)[1] for _ in range(30)] + [head[:-1], None, "", head * 40]
    rows = [(k, rng.choice("pq"), t) for k, t in enumerate(texts)]
    want = {}
    for k, part, t in rows:
        own = [h for p, h in held if p == part]
        leak = None if t is None else "equal" if t in own else "contained" if any(len(h) >= 40 and h in t for h in own) else None
        want |= {k: leak} if leak else {}
    df = spark.createDataFrame(rows, "row_id long, part string, _key string").repartition(3)
    routed = spark.createDataFrame(held, "part string, held_key string")
    assert {r["row_id"]: r["leak"] for r in leaks.leaking(df, routed, sent_chars=sent).collect()} == want
    assert len(want) > 60


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_held_out_texts_in_other_forms_leak(spark, sent):
    text = "Sẽn yaa tɩ nin-kãng sã n da be, a yãmb ning bũmb fãa sẽn paase, tɩ ra yɩ tãag ye"
    nfd, sharp = unicodedata.normalize("NFD", text), "Straße im Mondschein, die niemals endet und doch irgendwo aufhört"
    held = leaks.held_out_keys(spark.createDataFrame([("c", text), ("c", nfd), ("c", sharp)], "capacite string, text string"))
    assert held.count() == 2
    routed = held.select(F.lit("*").alias("part"), "held_key")
    rows = [text, nfd, "avant " + nfd + " après", "avant " + text, sharp.upper(), sharp.replace("s", "ſ"), unicodedata.normalize("NFD", sharp) + "x", text[:30], nfd[:20]]
    df = spark.createDataFrame([(k, "*", t) for k, t in enumerate(rows)], "row_id long, part string, text string")
    got = {r["row_id"]: r["leak"] for r in leaks.inspected(df, routed, sent_chars=sent).collect()}
    assert [got[k] for k in range(len(rows))] == ["equal", "equal", "contained", "contained", "equal", "equal", "contained", None, None]


def test_paired_texts_in_other_forms_are_dropped(spark):
    text = "Ãmb sẽn yaa"
    paired = mixture.paired_keys(spark.createDataFrame([(unicodedata.normalize("NFD", text) + "\n\nsuite",)], "text string"))
    assert kept(load(spark, [("f", 0, "p", text, 4), ("f", 1, "p", "autre", 4)], [("f", "unpaired", None)], paired)) == [1]
    assert mixture.witness_keys(spark.createDataFrame([(text, None), (unicodedata.normalize("NFD", text), None)], "text string, registre string")).count() == 1


def test_budgets_of_files_that_many_tasks_share(spark):
    rng = random.Random(9)
    docs = [(f"f{k % 3}", k, "p", "leak" if rng.random() < 0.1 else f"text {k}", rng.randrange(9)) for k in range(600)]
    budgets = {"f0": 300, "f1": 0, "f2": 10**6}
    rows = load(spark, docs, [(f, "fill", b) for f, b in budgets.items()], held=["leak"]).select("file", "pos", "kept", "reached").collect()
    spent = dict.fromkeys(budgets, 0)
    for (file, pos, _, text, tokens), r in zip(docs, sorted(rows, key=lambda r: r["pos"])):
        assert (r["reached"], r["kept"]) == (spent[file] < budgets[file], spent[file] < budgets[file] and text != "leak")
        spent[file] += tokens if text != "leak" else 0


def test_routes_know_unknown_parts(spark):
    held = spark.createDataFrame([("anglais", "k")], "capacite string, held_key string")
    parts = spark.createDataFrame([("anglais.jsonl",), ("typo",), ("*",)], "part string")
    routed = {tuple(r) for r in leaks.routes(held, parts, leaks.TARGETS).collect()}
    assert routed == {("anglais.jsonl", "k"), ("*", "k")}
    with pytest.raises(ValueError, match="typo"):
        leaks.routes(held, parts, leaks.TARGETS, strict=True)


def test_first_leak_of_a_turn(spark):
    t = spark.createDataFrame([(1, "t", "s", [("user", "ok"), ("assistant", "Leak!"), ("user", "leak")]), (2, "t", "s", [("user", "fine")])], "turn_id long, task string, source string, messages array<struct<role:string,content:string>>")
    held = spark.createDataFrame([("c", "leak")], "capacite string, held_key string")
    assert [(r["turn_id"], r["at"], r["leak"]) for r in leaks.first_leak_of_turn(t, held).collect()] == [(1, 1, "equal")]


def test_fingerprint_and_freezing(spark, tmp_path):
    assert mixture.fingerprint(spark.createDataFrame([(1, "b"), (0, "a")], "pos int, text string"), ["pos"]) == hashlib.sha256(b"a\0b\0").hexdigest()[:12]
    docs = [("f", 0, "p", "a", 4), ("g", 0, "p", "b", 6)]
    rows = load(spark, docs, [("f", "all", None), ("g", "all", None)])
    card = mixture.freeze(rows, "A", str(tmp_path), ["file", "pos"], {"f": "moore"}, {"moore": "CC"}, {}, date="2026-01-01")
    assert card["documents"] == 2 and card["tokens_par_part"] == {"?": 6, "moore": 4} and card["ratio_obtenu"] == {"?": 60.0, "moore": 40.0} and card["licences"] == {"?": "?", "moore": "CC"}
    texts, again = mixture.frozen(spark, "A", str(tmp_path))
    assert sorted(r[0] for r in texts.collect()) == ["a", "b"] and again["empreinte"] == card["empreinte"]
    assert mixture.frozen(spark, "B", str(tmp_path)) is None
    with pytest.raises(ValueError, match="nothing is frozen"):
        mixture.freeze(load(spark, docs, [("f", "all", None)], held=["a"]), "A", str(tmp_path), ["file", "pos"], {}, {}, {})


def test_packing_spans_documents_and_drops_the_tail(spark):
    docs = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5])], "pos int, ids array<int>")
    assert [r["ids"] for r in packing.packed(docs, F.col("ids"), ["pos"], 0, 3).orderBy("sequence").collect()] == [[1, 2, 3], [0, 4, 5]]
    many = [(i, list(range(i % 7))) for i in range(200)]
    flat = [x for i, ids in many for x in ([0] if i else []) + ids]
    got = [r["ids"] for r in packing.packed(spark.createDataFrame(many, "pos int, ids array<int>"), F.col("ids"), ["pos"], 0, 16).orderBy("sequence").collect()]
    assert got == [flat[k : k + 16] for k in range(0, len(flat) // 16 * 16, 16)]


def test_sequence_count(spark):
    assert spark.range(1).select(mixture.sequence_count(F.lit(1000), F.lit(24))).first()[0] == 1


def test_files(spark, tmp_path):
    (tmp_path / "source").mkdir()
    (tmp_path / "source" / "x.jsonl").write_text('{"text": "a", "tokens": 1}\n\n{"text": "b", "registre": "r"}\n')
    assert files.find(spark, str(tmp_path), "none") is None
    with pytest.raises(FileNotFoundError):
        files.path(spark, str(tmp_path), "none")
    rows = tables.mixture(spark, files.path(spark, str(tmp_path), "x.jsonl")).orderBy("pos").collect()
    assert [(r["pos"], r["text"], r["registre"]) for r in rows] == [(0, "a", None), (2, "b", "r")]
    assert tables.mixture(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    raw = (tmp_path / "source" / "x.jsonl").read_bytes()
    assert files.digest(spark, str(tmp_path / "source" / "x.jsonl")) == hashlib.sha256(raw).hexdigest()
    assert {r["key"]: r["size"] for r in files.listing(spark, str(tmp_path)).collect()} == {"source/x.jsonl": len(raw)}
    assert files.writable(spark, str(tmp_path)) is None
    (tmp_path / "l.csv").write_text("part,licence\na,MIT\nb,\na,CC\n")
    assert tables.licences(spark, str(tmp_path / "l.csv")) == {"a": "CC"} and tables.licences(spark, str(tmp_path / "no.csv")) == {}
    df = spark.createDataFrame([("source/x.jsonl", hashlib.sha256(raw).hexdigest()), ("gone", "0")], "key string, sha256 string")
    found = files.digests(spark, str(tmp_path / "source")).withColumn("key", F.concat(F.lit("source/"), "key"))
    assert {r["key"]: r["matches"] for r in files.matches(df, found).collect()} == {"source/x.jsonl": True, "gone": None}


def test_inspector_is_a_table_function(spark):
    long = "abcdefghij" * 4
    spark.udtf.register("inspect_leaks", leaks.inspector([long, "short"]))
    spark.createDataFrame([(1, "x" + long), (2, "short"), (3, long), (4, None), (5, "shorter")], "i int, k string").createOrReplaceTempView("inspected")
    got = spark.sql("SELECT i, how, held_key FROM inspected, LATERAL inspect_leaks(k)").collect()
    assert sorted(tuple(r) for r in got) == [(1, "contained", long), (2, "equal", "short"), (3, "equal", long)]


def test_readers(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"split": "val", "variant": "mos_mos", "messages": [{"role": "user", "content": "a"}]}\n')
    assert [(r["turn_id"], r["messages"][0]["content"], r["task"]) for r in tables.turns(spark, str(tmp_path / "t.jsonl")).collect()] == [(0, "a", None)]
    (tmp_path / "fr.jsonl").write_text('{"id": 3, "text": "un"}\n{"id": 1, "text": "deux"}\n')
    assert [(r["id"], r["pos"]) for r in tables.flores(spark, str(tmp_path / "fr.jsonl")).orderBy("pos").collect()] == [(3, 0), (1, 1)]
    (tmp_path / "log.jsonl").write_bytes(b'{"pas": 1, "loss": 2.0}\n\n{"pas": 2, "eval_loss": 1.5}\n{"pas": 3, "eval_loss": 1.4}\nbroken \xff\n')
    from corpusloom.operators import curves

    assert [r["pas"] for r in curves.evaluations(tables.log(spark, str(tmp_path / "log.jsonl")), 3).collect()] == [2]
    (tmp_path / "recipe.json").write_text('{"quoi": "x", "parts": {"moore": {"sources": [{"fichier": "a", "prendre": "tout"}, {"fichier": "b", "prendre": "completer", "tokens": 5}]}}}')
    sources_ = mixture.recipe_sources(tables.recipe(spark, str(tmp_path / "recipe.json"))).orderBy("pos")
    assert [(r["path"], r["take"], r["budget"]) for r in mixture.plan(sources_).orderBy("pos").collect()] == [("a", "all", None), ("b", "fill", 5)]
    (tmp_path / "s.json").write_text('{"global_step": 5}')
    assert tuple(tables.trainer_state(spark, str(tmp_path / "s.json")).first()) == (5, None)
    spark.range(5).write.parquet(str(tmp_path / "p"))
    tables.rewritten(spark.read.parquet(str(tmp_path / "p")).filter("id > 2"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    texts = [f"line {k} " + "x" * (k * 37 % 90) for k in range(3000)]
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"text": t}) + ("\r\n" if k % 7 == 0 else "\n") + "\n" * (k % 5 == 0) for k, t in enumerate(texts)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = tables.mixture(spark, str(tmp_path / "big.jsonl"))
        assert rows.rdd.getNumPartitions() > 5
        got = rows.select("pos", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [r["text"] for r in sorted(got, key=lambda r: r["pos"])] == texts and len({r["pos"] for r in got}) == len(texts)
