"""Golden curves, from point files to the kept points."""

import json

import pytest

from corpusloom.operators import reports
from corpusloom.sources import tables


def point(name, moore, arm="A", facts=("f1", "f2"), english=1.0, note="juste", per_text=None):
    step = name.rpartition("-")[2]
    measures = {c: {"bits_par_caractere": 1.0} for c in ("anglais", "francais", "code", "maths", "francais_parallele")} | {"moore_humain": {"bits_par_caractere": moore}}
    measures["anglais"] = {"bits_par_caractere": english}
    if per_text:
        measures["moore_humain"]["par_texte"] = per_text
    path = "" if name == "base" else f"/content/cpt/{arm}-20260831-1024/checkpoint-{step}"
    return {"point": name, "chemin": path, "mesures": measures, "faits": [{"id": f, "domaine": "d", "note": note, "reponse": "", "complet": True} for f in facts], "budget_faits": 320}


def load(spark, folder, *points):
    for k, p in enumerate(points):
        (folder / f"{k}-{p['point']}.json").write_text(json.dumps(p))
    return tables.points(spark, str(folder / "*.json"))


def kept(df):
    return {r["arm"]: (r["step"], r["cut"]) for r in df.filter("kept").collect()}


def test_not_comparable_does_not_cut(spark, tmp_path):
    points = load(spark, tmp_path, point("base", 2.0), point("checkpoint-100", 1.8, facts=("f1",)), point("checkpoint-200", 1.5), point("checkpoint-300", 1.6))
    assert kept(reports.keepable(points)) == {"A": (200, 300)}
    code, rows = reports.compare(points)
    assert code == 0 and [r["step"] for r in rows.collect()] == [200]


def test_a_signal_cuts_its_own_arm(spark, tmp_path):
    points = load(spark, tmp_path, point("base", 2.0), point("checkpoint-50", 1.7, arm="B", english=1.2), point("checkpoint-100", 1.8), point("checkpoint-200", 1.5))
    code, rows = reports.compare(points)
    assert code == 1 and {(r["arm"], r["step"]) for r in rows.collect()} == {("A", 200)}


def test_both_reports_keep_the_same_point(spark, tmp_path):
    points = load(spark, tmp_path, point("base", 2.0), point("checkpoint-100", 1.8), point("checkpoint-200", 1.5), point("checkpoint-300", 1.7), point("checkpoint-10", 1.9, arm="C"))
    assert kept(reports.keepable(points))["A"][0] == 200
    ranked = reports.arms(points, "A").collect()
    assert [(r["arm"], r["step"], r["verdict"]) for r in ranked] == [("A", 200, "reference"), ("C", 10, "not separated")]
    with pytest.raises(ValueError):
        reports.arms(points, "Z")


def test_only_a_rise_beyond_noise_cuts(spark, tmp_path):
    flat = [[100.0 + k % 7, 50 + k % 13] for k in range(40)]
    worse, up = [[x * 1.5, n] for x, n in flat], [[x * (1.01 if k % 2 else 0.992), n] for k, (x, n) in enumerate(flat)]
    points = load(spark, tmp_path, point("base", 2.0, per_text=worse), point("checkpoint-100", 1.5, per_text=flat), point("checkpoint-200", 1.51, per_text=up), point("checkpoint-300", 1.9, per_text=worse))
    assert kept(reports.keepable(points, resamples=300)) == {"A": (100, 300)}
    stars = {r["stem"]: r["star"] for r in reports.against_base(points, resamples=300).collect()}
    assert stars == {"1-checkpoint-100": True, "2-checkpoint-200": True, "3-checkpoint-300": False}


def test_facts_and_collapse(spark, tmp_path):
    points = load(spark, tmp_path, point("base", 2.0), point("checkpoint-100", 1.8), point("checkpoint-200", 1.5, note="faux"), point("checkpoint-300", 1.2, note="piege"))
    rows = {r["step"]: r for r in reports.keepable(points).collect()}
    assert rows[200]["forgotten"] == ["f1", "f2"] and not rows[200]["signal"] and rows[300]["marks"] == ["facts learned otherwise: f1, f2"]
    answers = spark.createDataFrame([("A", "200", "same words %d" % (k % 2)) for k in range(4)] + [("A", "100", "w%d x" % k) for k in range(4)], "arm string, step string, obtenu string")
    assert kept(reports.keepable(points, answers)) == {"A": (100, 300)}
    assert {r["step"] for r in reports.keepable(points, answers).filter("unchecked").collect()} == {300}


def test_bpc_table(spark, tmp_path):
    points = load(spark, tmp_path, point("base", 2.0), point("checkpoint-2168", 1.8), point("checkpoint-542", 1.5))
    got = reports.bpc_table(points)
    assert got.columns == ["capability", "base", "A/checkpoint-542", "A/checkpoint-2168"]
    assert reports.compare(points.limit(0)) == (2, None)
    with pytest.raises(ValueError):
        reports.keepable(points.filter("point <> 'base'"))


def test_facts_are_put_in(spark, tmp_path):
    points = load(spark, tmp_path, point("base", 2.0), point("checkpoint-5", 1.0))
    answers = spark.createDataFrame([("checkpoint-5", "f9", "d", "piege", "x", True)], "point string, id string, domaine string, note string, reponse string, complet boolean")
    got = {r["point"]: r for r in reports.with_facts(points, answers, 64).collect()}
    assert [f["id"] for f in got["base"]["faits"]] == ["f1", "f2"] and got["base"]["budget_faits"] == 320
    assert [f["id"] for f in got["checkpoint-5"]["faits"]] == ["f9"] and got["checkpoint-5"]["budget_faits"] == 64 and got["checkpoint-5"]["faits_compte"]["piege"] == 1
