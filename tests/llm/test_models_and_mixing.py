import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, mil, mixing

DOC = "doc_id long, text string, lang string, source string, score string, size string, copies string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "clash", "clash", "clash", "clash") for i, t, s in rows], DOC)


# --- mixing ------------------------------------------------------------------------------------------------------------


def filled(sizes, weights, most=3.0):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in names if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * x / sum(rest.values()) for s, x in rest.items()}
        over = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return capped | share
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 40, 1000]) * rng.randrange(1, 9) for s in ["a", "b", "É", "z", "é", None, "s10", "s9"]}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(filled(sizes, (5, 2, 1)))


def test_mix(spark):
    rng = random.Random(1)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(1, 30))), s) for k, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 40 + [None] * 60)]
    rows += [(9001, None, "a"), (9002, "", "empty"), (9003, " \t\x0b", "empty"), (None, "x y", "a"), (5, rows[5][1], "a"), (9004, "a b\x1cc d", "a"), (9005, "w " * 20_000, "d")]
    plan = mixing.mix_plan(docs(spark, rows)).toPandas()
    assert len(plan) == len(rows)
    want = {i: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t, _ in rows}
    assert all(r.size == want[None if math.isnan(r.doc_id) else int(r.doc_id)] for r in plan.itertuples())
    assert (plan.copies <= np.ceil(plan.rate)).all() and (plan.copies >= np.floor(plan.rate)).all() and (plan.copies <= 3).all()
    plan["taken"] = plan["size"] * plan.copies
    for source, own in plan[plan.source.isin(["a", "b"])].groupby("source"):
        assert own.taken.sum() == pytest.approx(own.target.iloc[0], rel=0.15)
    df = docs(spark, rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.filter("size <> 'clash'").count() == 0
    assert out.count() == plan.copies.sum() == mixing.mixed(df.repartition(7)).count()
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mix_plan(df.limit(0)).count() == 0
    odd = df.limit(5).withColumns({c: F.lit("own") for c in ("_source", "of", "counted", "a.b")})
    assert mixing.mixed(odd).columns == odd.columns and mixing.mix_plan(odd).filter("_source <> 'own' OR of <> 'own' OR `a.b` <> 'own'").count() == 0
    narrow = mixing.mix_plan(mixing.sized(df), size="size").toPandas()
    assert sorted(zip(narrow["size"], narrow.target, narrow.copies)) == sorted(zip(plan["size"], plan.target, plan.copies))


def test_mix_is_native(spark):
    plan = mixing.mixed(docs(spark, [(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- quality -----------------------------------------------------------------------------------------------------------


def labelled_texts(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ed"]) for _ in range(rng.randrange(1, 5)))
    rows = []
    for k in range(n):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randrange(5, 400))]
        rows.append((k, " ".join(words) + "." if good else rng.choice([" ".join(w + "$$$" for w in words), " ".join(words).upper() + "!!", " ".join(w for w in words[:30] for _ in range(9)), " | ".join(words)]), int(good)))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = labelled_texts(500)
    df = docs(spark, [(i, t, "s") for i, t, _ in rows] + [(1000, None, "s"), (1001, "", "s"), (None, "some text", "s"), (1002, "x" * 200_000, "s"), (3, rows[3][1], "s")])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = mil.quality(df, labels).toPandas()
    assert len(got) == len(rows) + 5 and got.score.between(0, 1).all()
    truth = {i: q for i, _, q in rows}
    held = got[got.held_out & got.doc_id.isin(truth)]
    assert len(held) > 60 and all(r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0) for r in got.dropna().itertuples())
    assert ((held.score >= 0.5).astype(int) == held.doc_id.map(truth)).mean() > 0.97
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    same = got[got.doc_id == 3].score
    assert len(same) == 2 and same.nunique() == 1
    again = mil.quality(df.repartition(5, "text"), labels).toPandas()
    key = lambda pdf: sorted(zip(pdf.doc_id.fillna(-1), pdf.score))
    assert key(again) == key(got)
    kept = mil.kept(df, labels)
    assert kept.columns == df.columns and kept.count() == got.predicted.sum()
    assert mil.quality(df.limit(0), labels).count() == 0


def test_without_two_kinds_of_labels(spark):
    df = docs(spark, [(1, "a", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert mil.quality(df, none).first()["score"] == 0.5
    assert mil.quality(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).first()["score"] == 1.0


def test_passages_cover_whole_texts():
    texts = pa.array(["", None, "x" * 1024, "x" * 1025, "y" * 5000, "é" * 600])
    x, counts = mil.passages(texts)
    assert counts.tolist() == [1, 1, 1, 2, 5, 2] and len(x) == 12 and not x[0].any() and x[2].any()
    alone = mil.passages(texts.slice(4, 1))[0]
    assert np.allclose(x[5:10], alone)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    x, counts, y = rng.random((7, 5)).astype(np.float32), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0], np.float32)
    net = mil.AttentionBag(5, 4, 3, seed=1)
    loss = lambda: -np.mean(y * np.log(net.scores(x, counts)) + (1 - y) * np.log(1 - net.scores(x, counts)))
    before = loss()
    net.fit(x, counts, y, epochs=60, rate=0.05)
    assert loss() < before / 3
    a = net.attention(rng.random(7), counts)
    assert np.add.reduceat(a, [0, 3, 4]) == pytest.approx([1, 1, 1])


def plain_passage(part):
    """Features of a passage, byte by byte."""
    pairs, bins, words, word = np.zeros(256), np.zeros(mil.WORD_BINS), [], None
    for i, byte in enumerate(part):
        if i:
            pairs[mil.CLASSES[part[i - 1]] * 16 + mil.CLASSES[byte]] += 1
        if mil.CLASSES[byte] in (4, 5):
            word = None
        elif word is None:
            words.append(int(mil.MARKS[byte]))
            word = True
        else:
            words[-1] += int(mil.MARKS[byte])
    words = [((w + (1 << 63)) % (1 << 64)) - (1 << 63) for w in words]  # as 64 bits go round
    for w in words:
        bins[((((w * 0x9E3779B97F4A7C1) + (1 << 63)) % (1 << 64) - (1 << 63)) >> 40) % mil.WORD_BINS] += 1
    x = np.zeros(8)
    if words:
        n = len(words)
        x[0], x[1] = sum(a == b for a, b in zip(words, words[1:])) / n, sum(a == b for a, b in zip(words, words[2:])) / n
        x[2], x[3], x[4], x[5] = bins.max() / n, ((bins / n) ** 2).sum(), (bins > 0).sum() / min(mil.WORD_BINS, n), n / len(part)
    x[6], x[7] = (pairs > 0).sum() / 256, math.log1p(len(part)) / 7
    return np.concatenate([np.sqrt(pairs / max(1, len(part))), x]).astype(np.float32).astype(float)


def plain_score(net, text):
    """One document at a time, passage by passage."""
    data, p = (text or "").encode(), net.p
    encoded = []
    for at in range(0, max(1, len(data)), mil.PASSAGE):
        x = (plain_passage(data[at : at + mil.PASSAGE]) - net.mean) / net.scale if data else -net.mean / net.scale
        h = np.array([math.tanh(sum(x * p["w1"][:, j].astype(float)) + p["b1"][j]) for j in range(len(p["b1"]))])
        gates = [math.tanh(sum(h * p["v"][:, g])) / (1 + math.exp(-sum(h * p["u"][:, g]))) for g in range(len(p["wa"]))]
        encoded.append((h, math.exp(sum(gates * p["wa"]))))
    z = sum(h * a for h, a in encoded) / sum(a for _, a in encoded)
    return 1 / (1 + math.exp(-(sum(z * p["w"]) + float(p["b"][0]))))


def test_scores_against_a_plain_scorer():
    rows = labelled_texts(120, seed=3)
    x, counts = mil.passages(pa.array([t for _, t, _ in rows]))
    net = mil.AttentionBag().fit(x, counts, np.array([q for _, _, q in rows], np.float32), epochs=40)
    texts = [t for _, t, _ in rows[:12]] + ["", None, "x", " \n ", "é" * 700, "a b " * 900, "1 2 3 | * !"]
    got = net.scores(*mil.passages(pa.array(texts)))
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-6)
    for order in (texts[::-1], texts[5:] + texts[:5]):
        again = dict(zip(order, net.scores(*mil.passages(pa.array(order)))))
        assert [again[t] for t in texts] == got.tolist()
    assert [net.scores(*mil.passages(pa.array([t])))[0] for t in texts] == got.tolist()


def test_gradients():
    rng = np.random.default_rng(4)
    x, counts, y = rng.random((9, 5)), np.array([3, 1, 4, 1]), np.array([1.0, 0.0, 1.0, 0.0])
    net = mil.AttentionBag(5, 4, 3, seed=1)
    net.p = {k: v.astype(float) + 0.1 * rng.standard_normal(v.shape) for k, v in net.p.items()}

    def loss():
        h, _, _, e = net.encode(x)
        z = np.add.reduceat(h * net.attention(e, counts)[:, None], np.cumsum(counts) - counts)
        s = 1 / (1 + np.exp(-(z @ net.p["w"] + net.p["b"][0])))
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in net.gradients(x, (x - net.mean) / net.scale, counts, y).items():
        for at in np.ndindex(net.p[k].shape):
            was = net.p[k][at]
            sides = []
            for step in (1e-5, -1e-5):
                net.p[k][at] = was + step
                sides.append(loss())
            net.p[k][at] = was
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-7)


# --- nearest neighbours ------------------------------------------------------------------------------------------------


def brute(ids, v, k=5):
    v = v / np.sqrt((v**2).sum(1))[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (v * v[i]).sum(1)
        s[ids == ids[i]] = -9
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[ids[i]] = [(ids[j], s[j]) for j in order]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, b"") for i, v in rows], "vec_id long, embedding array<float>, label int, codes binary")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    v = (centres[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 24))).astype(np.float32)
    got = ann.nearest(vectors(spark, list(enumerate(v)))).toPandas()
    want = brute(np.arange(1500), v.astype(float))
    hits = sum(len({i for i, _ in want[q]} & set(own.vec_id)) for q, own in got.groupby("query_id"))
    assert len(got) == 30 * 5 and hits / 150 >= 0.9
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        cos = {i: s for i, s in zip(range(1500), (v @ v[q].astype(float)) / np.sqrt((v.astype(float) ** 2).sum(1)) / np.sqrt((v[q].astype(float) ** 2).sum()))}
        assert own.score.tolist() == pytest.approx([cos[i] for i in own.vec_id]) and own.score.is_monotonic_decreasing


def test_odd_vectors_and_ties(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(k, same) for k in range(0, 400)] + [(1000, None), (1050, [0, 0, 0]), (1100, [1, None, 2]), (1150, [1, math.nan, 2]), (1200, [1, math.inf, 2]), (1250, [1, 2]), (None, same), (50, same), (1300, [1e30, 2e30, 3e30]), (1350, [-1, -2, -3])]
    got = ann.nearest(vectors(spark, rows)).toPandas()
    assert set(got.query_id) == {*range(0, 400, 50), 1300, 1350}
    own = got[got.query_id == 100].sort_values("rank")
    assert own.vec_id.tolist() == [0, 1, 2, 3, 4] and own.score.tolist() == pytest.approx([1.0] * 5)
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [1, 2, 3, 4, 5]


def test_few_and_no_vectors(spark):
    got = ann.nearest(vectors(spark, [(0, [1, 0]), (1, [1, 1]), (2, [0, 1])])).toPandas()
    assert got.sort_values("rank").vec_id.tolist() == [1, 2]
    assert ann.nearest(vectors(spark, [(0, [1, 0])])).count() == 0
    assert ann.nearest(vectors(spark, [])).count() == 0 and ann.nearest(vectors(spark, [(0, None)])).count() == 0


def test_recall_without_clusters(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(12_000, 64)).astype(np.float32)
    df = vectors(spark, list(enumerate(v)))
    index, books = ann.build_index(df.repartition(3))
    want = brute(np.arange(12_000), v.astype(float))
    for layout in (index, index.coalesce(1), index.repartition(7)):
        got = ann.search(layout, books, layout.filter("vec_id % 50 = 0")).toPandas()
        hits = sum(len({i for i, _ in want[q]} & set(own.vec_id)) for q, own in got.groupby("query_id"))
        assert hits / (5 * 240) >= 0.95
        rows = sorted(got.itertuples(index=False))
        assert layout is index or rows == first  # wherever the rows are
        first = rows


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(6)
    index, books = ann.build_index(vectors(spark, list(enumerate(rng.normal(size=(300, 8))))))
    one = ann.search(index, books, index.filter("vec_id % 50 = 0"), block=1000).orderBy("query_id", "rank").collect()
    for block, part in ((2, 1000), (2, 70), (1000, 40)):
        assert ann.search(index, books, index.filter("vec_id % 50 = 0"), block=block, part=part).orderBy("query_id", "rank").collect() == one


def test_beam_search_codes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    books = ann.fit_codebooks(x, books=3, words=16, beam=8)
    error = lambda codes: ((x - ann.decoded(codes, books)) ** 2).sum()
    greedy, wide = error(ann.beam_encode(x, books, 1)), error(ann.beam_encode(x, books, 8))
    assert wide <= greedy < (x**2).sum()
    full = ann.beam_encode(x[:5], books, 16**2)
    words = np.stack(np.meshgrid(*[np.arange(16)] * 3, indexing="ij"), -1).reshape(-1, 3)
    sums = ann.decoded(words, books)
    best = ((x[:5, None] - sums[None]) ** 2).sum(2).min(1)
    assert ((x[:5] - ann.decoded(full, books)) ** 2).sum(1) == pytest.approx(best, rel=1e-4)
