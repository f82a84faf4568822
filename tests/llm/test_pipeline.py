"""The pipeline on a small table, each stage against a plain version on what the one before kept."""

import os
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def table():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ed", "in"]) for _ in range(rng.randrange(2, 6)))
    rows = []
    for k in range(300):
        words = [word() for _ in range(rng.randrange(40, 200))]
        if k % 5 == 4:
            words = [w.upper() + "$$$" for w in words]
        rows.append([k, " ".join(words), "en", f"src{k % 3}", 0])
    for k in range(300, 330):  # exact copies
        rows.append([k, rows[(k - 300) * 5][1].replace(" ", "  "), "en", "src0", 0])
    for k in range(330, 360):  # near copies
        words = rows[(k - 330) * 5 + 1][1].split()
        words[len(words) // 2] = "edited"
        rows.append([k, " ".join(words + ["more"]), "en", "src1", 0])
    rows += [[360, None, None, None, None], [361, "", "en", None, 0]]
    return rows


def test_stages(spark, tmp_path):
    rows = table()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 0 if k % 5 == 4 else 1, 0) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.toPandas()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    classified = set(seen["quality classifier"].doc_id)
    bad = {k for k in range(300) if k % 5 == 4}
    assert len(classified & bad) <= 2 and len({k for k in range(360) if k % 5 != 4 or k >= 300} - classified) <= 4
    exact = seen["exact dedup"]
    assert set(exact.doc_id) & set(range(300, 330)) <= {k for k in range(300, 330) if (k - 300) * 5 not in classified}
    assert exact.text.fillna("").map(lambda t: " ".join(t.split())).is_unique
    near = seen["MinHash near-dedup"]
    assert {k for k in range(330, 360) if k in set(near.doc_id)} <= {k for k in range(330, 360) if (k - 330) * 5 + 1 not in classified or len(rows[k][1].split()) < 60}
    assert set(range(0, 300)) & set(exact.doc_id) <= set(near.doc_id)
    mixed = seen["mixing"]
    assert set(mixed.doc_id.dropna()) <= set(near.doc_id.dropna()) and mixed.groupby("doc_id").size().max() <= 3
    packed, tokenizer = seen["packing"], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.length.sum() == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in mixed.text)
    again = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert again.length.sum() == packed.length.sum()


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, `a.b` string, label string, kept string"


def test_odd_tables(spark, tmp_path):
    rows = table()[:120]
    long_text = " ".join(r[1] for r in rows if r[0] % 5 != 4) * 12
    odd = [[None, None, None, None, None], [None, rows[0][1], "en", None, 0], [1, rows[1][1], "en", "src1", 0], [1, rows[1][1], "en", "src1", 0], [1, rows[2][1], "en", "src1", 0], [900, long_text, "en", "src0", 0], [901, long_text + " more", "en", "src0", 0], [902, "", None, "src0", None], [903, " \t", None, "", 0]]
    spark.createDataFrame([(k, 0 if k % 5 == 4 else 1, 0) for k in range(120)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, some in (("odd", rows + odd), ("empty", [])):
        docs = spark.createDataFrame([(*r, "own", "own", "own", "own") for r in some], ODD)
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        docs, seen = spark.read.parquet(str(tmp_path / name / "documents.parquet")), {}
        for k, (step, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            seen[step] = docs.toPandas()
            assert k == len(corpus_pipeline.STAGES) - 1 or (docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "a.b", "label", "kept"] and (seen[step][["row", "a.b", "label", "kept"]] == "own").all(axis=None))
        if name == "empty":
            assert all(len(x) == 0 for x in seen.values())
            continue
        exact = seen["exact dedup"].text.fillna("").map(lambda t: " ".join(t.split()))
        assert exact.is_unique and set(exact) == set(seen["quality classifier"].text.fillna("").map(lambda t: " ".join(t.split())))
        near = set(seen["MinHash near-dedup"].text.fillna(""))
        assert not {long_text, long_text + " more"} <= near and len({long_text, long_text + " more"} & near) == len({900, 901} & set(seen["MinHash near-dedup"].doc_id.dropna()))
        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert seen["packing"].length.sum() == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in seen["mixing"].text)


def test_stages_remove_what_the_ones_before_left(spark, tmp_path):
    spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    corpus_pipeline.exact(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path)).write.parquet(str(tmp_path / "e"))
    left = list(corpus_pipeline._left)
    assert left
    corpus_pipeline.mix(spark, spark.read.parquet(str(tmp_path / "e")), str(tmp_path)).count()
    assert not set(left) & set(corpus_pipeline._left) and not any(os.path.exists(p.removeprefix("file://")) for p in left)


def test_the_operators_come_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing", "packing"]
