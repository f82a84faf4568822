import json
import os

import pytest

from corpusloom.operators import runs
from corpusloom.sources import tables
from corpusloom.streaming import logs


def test_log_appends_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "run-1.jsonl").write_text('{"pas": 1, "loss": 2.0, "epoch": 0.12345}\n\n{"pas": 2, "eval_loss": 1.5}\n')
    for extra in (None, '{"pas": 3, "eval_loss": 1.4}\n'):
        if extra:
            (source / "run-2.jsonl").write_text(extra)
        logs.append_log(logs.progress_row(logs.read_log(spark, str(source))), str(target), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(target)).orderBy("pas").collect()
    assert [(r["run"], r["pas"]) for r in rows] == [("run-1", 1), ("run-1", 2), ("run-2", 3)] and rows[0]["epoque"] == 0.123


def handled(spark, folder, name, **options):
    stream = spark.readStream.schema("run string, step long").option("maxFilesPerTrigger", 1).json(str(folder))
    logs.retention(stream, 1201, **options).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).orderBy("step").collect()


def arrived(folder, *batches):
    """A file for each batch of steps, a second apart, as a source takes files by their time."""
    folder.mkdir()
    for k, steps in enumerate(batches):
        file = folder / f"{k:03d}.json"
        file.write_text("".join(json.dumps({"run": "r", "step": s}) + "\n" for s in steps))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))


@pytest.mark.parametrize("keep_all", [False, True])
def test_retention_as_state_equals_the_batch_plan(spark, tmp_path, keep_all):
    steps = [219 * k for k in range(1, 28)]
    arrived(tmp_path / "saves", *(steps[at : at + 10][::-1] for at in range(0, len(steps), 10)))
    got = handled(spark, tmp_path / "saves", f"saves_{keep_all}", keep_all=keep_all)
    assert [r["step"] for r in got if r["opens"]] == [219, 1314, 2409, 3723, 4818]
    plan = runs.retention(spark.createDataFrame([("r", s) for s in steps], "run string, step long"), 1201, keep_all).orderBy("step").collect()
    assert [(r["step"], r["opens"]) for r in got] == [(r["step"], r["opens"]) for r in plan]
    assert [(r["previous"], r["action"]) for r in got[1:]] == [(r["step"], r["action"]) for r in plan[:-1]]


def test_late_saves_remove_nothing(spark, tmp_path):
    arrived(tmp_path / "saves", [100, 1300], [700, 1300], [1400], [2500])
    got = handled(spark, tmp_path / "saves", "late_saves", keep_all=False)
    assert sorted((r["step"], r["opens"], r["previous"] or 0, r["action"] or "") for r in got) == [
        (100, True, 0, ""), (700, False, 0, "late"), (1300, False, 0, "late"), (1300, True, 100, "prune"), (1400, False, 1300, "prune"), (2500, True, 1400, "delete"),
    ]


def test_point_files(spark, tmp_path):
    (tmp_path / "checkpoint-5.json").write_text(json.dumps({"point": "checkpoint-5", "mesures": {"anglais": {"bits_par_caractere": 1.5, "intervalle": [1.4, 1.6], "par_texte": [[2.5, 3], [1.0, 2]]}}, "faits": [{"id": "a", "note": "juste"}]}))
    got = tables.measures(tables.points(spark, str(tmp_path / "*.json")))
    r = got.first()
    assert (r["stem"], r["capability"], r["bits_par_caractere"], r["low"]) == ("checkpoint-5", "anglais", 1.5, 1.4)
    assert [(x["pos"], x["nll"], x["chars"]) for x in tables.per_text(got).orderBy("pos").collect()] == [(0, 2.5, 3), (1, 1.0, 2)]
