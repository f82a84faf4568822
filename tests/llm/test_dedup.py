import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import chaining, grace, probminhash
from corpusloom.llm import words as words_module
from corpusloom.llm.words import mixed, runs, shingles, spans, word_hashes

DOC = "doc_id long, text string, row string, gid string, digest string, node string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, f"r{k}", "clash", "clash", None) for k, (i, t) in enumerate(rows)], DOC)


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \n\x0b\x1cab\u00a0é", max_size=12) | st.none(), max_size=6))
def test_word_hashes(texts):
    h, counts = word_hashes(pa.array(texts, pa.string()))
    found = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in texts]
    assert counts.tolist() == [len(w) for w in found]
    same = {}
    for w, x in zip([w for ws in found for w in ws], h.tolist()):
        assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)


def test_shingles_of_short_texts():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(shingles(h)) == 4 and len(shingles(h[:3])) == 1 and len(shingles(h[:0])) == 0 and len(runs(h[:2], 5)) == 0


# --- exact -------------------------------------------------------------------------------------------------------------

CASES = [(5, "a  b"), (2, "a b"), (2, "a b"), (None, "a\tb"), (None, "x"), (None, "x"), (7, None), (8, ""), (9, " "), (10, "A b"), (11, "é" * 5000), (12, "é" * 5000), (13, "a\u00a0b")]


@pytest.mark.parametrize("limit", [1, 300, 1 << 20])
def test_exact_groups(spark, limit):
    got = grace.exact_groups(docs(spark, CASES), table_bytes=limit).collect()
    assert len(got) == len(CASES)
    groups = {}
    for i, t in CASES:
        groups.setdefault(normal(t), []).append(i)
    want = sorted((str(i), str(min((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_exact_rows_keep_their_columns(spark, limit):
    df = docs(spark, CASES)
    got = grace.kept_rows(df, table_bytes=limit)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(normal(r["text"]) for r in rows) == sorted({normal(t) for _, t in CASES})
    assert {tuple(r) for r in rows} <= {tuple(r) for r in df.collect()}
    assert grace.kept_rows(df.limit(0)).count() == 0 and grace.exact_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("carry", [False, True])
def test_copies_count_against_a_table(spark, carry):
    """A table ends by the bytes of all its rows, not of its different texts alone."""
    df = docs(spark, [(k, "one text of some words") for k in range(4000)] + [(k, "long " * 2000) for k in range(4000, 4100)]).coalesce(1)
    folded, decided = grace._decisions(df, 100_000, carry)
    firsts = folded.filter("first")
    assert 4000 * grace.MEMBER_BYTES / 100_000 <= firsts.count() <= 400 and firsts.agg({"rows": "max"}).first()[0] <= 100_000 / grace.MEMBER_BYTES + 1
    assert folded.count() == 4100 and decided.filter("wins").count() == 2
    got = grace.kept_rows(df, table_bytes=100_000) if carry else grace.exact_groups(df, table_bytes=100_000).filter("kept")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 4000]


def test_grace_splits_until_a_bucket_fits(tmp_path):
    rng = random.Random(1)
    texts = [b"%d" % rng.randrange(400) for _ in range(3000)]
    rows = [(hash(t) & (2**63 - 1), t, k, k, 1) for k, t in enumerate(texts)]
    buckets = list(grace.grace(iter(rows), limit=5000, folder=str(tmp_path)))
    assert sum(map(len, buckets)) == len(rows) and len(buckets) > 8
    for t in set(texts):
        assert sum(any(r[1] == t for r in b) for b in buckets) == 1
    assert not list(tmp_path.iterdir())


def test_equal_hashes_are_told_apart_by_content(tmp_path):
    table = grace.OpenTable(4)
    assert [table.put(7, t) for t in (b"a", b"b", b"a", b"c", b"d", b"b")] == [0, 1, 0, 2, 3, 1]
    rows = [(7, b"%d" % (k % 5), k, k, 1) for k in range(200)]
    assert len(list(grace.grace(iter(rows), limit=100, folder=str(tmp_path)))) == 1


# --- near --------------------------------------------------------------------------------------------------------------


def brute_jaccard(x, y):
    dx, dy = (dict(zip(*map(list, s))) for s in (x, y))
    return sum(1 / sum(max(dx.get(j, 0) / dx[i], dy.get(j, 0) / dy[i]) for j in dx | dy) for i in dx if i in dy)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5)), min_size=1, max_size=10), st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5)), min_size=1, max_size=10))
def test_probability_jaccard(a, b):
    x, y = ((np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)])) for d in (dict(a), dict(b)))
    assert probminhash.probability_jaccard(x, y) == pytest.approx(brute_jaccard(x, y))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 3)), min_size=1, max_size=8), min_size=2, max_size=6), st.sampled_from([0.0, 0.5, 0.8]))
def test_bounds_of_a_block(lists, similarity):
    sets = [(np.array(sorted(dict(x)), dtype=np.uint64), np.array([dict(x)[k] for k in sorted(dict(x))])) for x in lists]
    block = probminhash.Block([0] * (len(sets) - 1), sets[1:], similarity)
    for bound, other in zip(block.bounds(sets[0]), sets[1:]):
        exact = brute_jaccard(sets[0], other)
        assert bound >= exact - 1e-9 or exact < similarity
        if bound and (sets[0][1] == 1).all() and (other[1] == 1).all():
            assert bound == pytest.approx(exact)


def test_registers_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(0)
    e = np.sort(rng.integers(1, 1 << 63, 300, dtype=np.uint64))
    w = rng.integers(1, 4, 300)
    v = w.copy()
    v[:60] = rng.integers(1, 9, 60)
    x, y = (e[:270], w[:270]), (e[20:], v[20:])
    sig = probminhash.signatures(np.concatenate([x[0], y[0], e[:1]]), np.concatenate([x[1], y[1], w[:1]]), np.array([270, 280, 1, 0]), 6000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(brute_jaccard(x, y), abs=0.03)
    assert (sig[2] == e[0]).all() and (sig[3] == 0).all()
    alone = probminhash.signatures(y[0], y[1], np.array([280]), 6000)
    assert (alone[0] == sig[1]).all()  # whatever texts stand beside it


def near_by_brute_force(rows):
    sets = [probminhash.weighted(word_hashes(pa.array([t or ""]))[0]) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or probminhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    return sorted((str(d), str(min((x for x in ids if x is not None), default=None)), len(ids)) for ids in groups.values() for d in ids)


def near_cases():
    rng = random.Random(4)
    rows, n = [], 0
    for g in range(4):
        base = words(rng, 120)
        for _ in range((3, 14, 1, 2)[g]):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(120)] = "edit%d" % rng.randrange(10**6)
            rows.append((n := n + 1, " ".join(copy)))
    chain = words(rng, 100)  # neighbours are similar, the ends are not
    for k in range(12):
        rows.append((n := n + 1, " ".join(chain[2 * k :] + ["tail%d" % x for x in range(2 * k)])))
    rows += [(n + 1, rows[0][1]), (n + 1, rows[0][1]), (None, rows[1][1]), (None, None), (n + 2, ""), (n + 3, " "), (n + 4, "one two"), (n + 5, "one two"), (n + 6, "one two three"), (n + 7, "w " * 5000), (n + 8, "w " * 300), (None, "lone text of more than five words")]
    return rows


def test_near_classes(spark):
    rows = near_cases()
    got = probminhash.near_classes(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in got) == near_by_brute_force(rows)
    classes = {}
    for r in got:
        classes.setdefault((r["class_id"], r["class_size"]), []).append(r["kept"])
    assert all(any(k) for k in classes.values())


def test_near_rows(spark):
    df = docs(spark, near_cases())
    got = probminhash.kept_rows(df)
    assert got.columns == df.columns
    heads = {c for _, c, _ in near_by_brute_force(near_cases())}
    ids = [str(r["doc_id"]) for r in got.collect()]
    assert {i for i in ids if i != "None"} == heads - {"None"} and len([i for i in ids if i != "None"]) == len(heads - {"None"})
    assert probminhash.kept_rows(df.limit(0)).count() == 0 and probminhash.near_classes(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["label"] for r in probminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {x: top(x) for x in list(parent)}


# --- passages ----------------------------------------------------------------------------------------------------------


def test_winnowing_finds_every_long_run():
    rng = random.Random(2)
    shared = words(rng, chaining.W + chaining.K - 1)
    a, b = words(rng, 40) + shared + words(rng, 9), words(rng, 3) + shared
    h, text, pos = chaining.seeds(*word_hashes(pa.array([" ".join(a), "x y", " ".join(b)])))
    assert set(h[text == 0]) & set(h[text == 2])
    assert not (text == 1).any()


def brute_chain(parts, cost=chaining.GAP_COST):
    """The best chain's score, by all predecessors."""
    order = sorted(range(len(parts)), key=lambda i: (parts[i][0], parts[i][1]))
    score = {}
    for i in order:
        p, t, _, worth = parts[i]
        score[i] = worth + max([0.0, *(score[j] - cost * (p - parts[j][0] - parts[j][2] + t - parts[j][1] - parts[j][2]) for j in score if parts[j][0] + parts[j][2] <= p and parts[j][1] + parts[j][2] <= t)])
    return max(score.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(5, 9)), min_size=1, max_size=12, unique=True))
def test_fenwick_chains_are_the_best(parts):
    parts = [(p, t, n, float(n)) for p, t, n in parts]
    found = chaining.chains(parts)
    assert sorted(i for c in found for i in c) == list(range(len(parts)))
    best = found[0]
    total = sum(parts[i][3] for i in best)
    for i, j in zip(best, best[1:]):
        assert parts[i][0] + parts[i][2] <= parts[j][0] and parts[i][1] + parts[i][2] <= parts[j][1]
        total -= chaining.GAP_COST * (parts[j][0] - parts[i][0] - parts[i][2] + parts[j][1] - parts[i][1] - parts[i][2])
    if len(parts) > 1:
        assert total == pytest.approx(brute_chain(parts))


def test_alignment():
    a, b = np.arange(100, dtype=np.int32), np.concatenate([np.arange(1000, 1003), np.arange(10, 90), np.arange(2000, 2005)]).astype(np.int32)
    assert chaining.aligned(a, b, [(20, 13, 10), (50, 43, 5)]) == (10, 90, 3, 83, 1.0)
    assert chaining.matches([1, 2, 3, 4], [1, 9, 3, 4]) == 3 and chaining.matches([], [1]) == 0 and chaining.matches([1, 2, 3], [2, 3]) == 2
    assert chaining.extension(np.array([1, 2, 9, 9]), np.array([1, 2, 8, 7])) == (2, 2)


def passage_cases():
    rng = random.Random(8)
    shared, fuzzy, short = words(rng, 70), words(rng, 90), words(rng, 30)
    rows = [(k, words(rng, 50 + k) + shared + words(rng, 40)) for k in range(5)]
    for k in range(5, 9):
        copy = list(fuzzy)
        for at in range(8, 90, 17):
            copy[at] = "edit%d" % rng.randrange(10**6)
        del copy[40]
        rows.append((k, words(rng, 20) + copy + words(rng, 25)))
    rows += [(k, words(rng, 60) + short + words(rng, 60)) for k in range(9, 12)] + [(12, words(rng, 300)), (13, words(rng, 20) + shared[:40]), (14, shared[20:] + words(rng, 10)), (15, shared * 2)]
    return [(i, " ".join(w)) for i, w in rows], {0, 1, 2, 3, 4, 5, 6, 7, 8, 14, 15}


def test_passages(spark):
    rows, repeated = passage_cases()
    got = chaining.repeated_passages(docs(spark, rows + [(20, None), (21, ""), (22, "x"), (23, "w " * 3000), (24, rows[12][1])])).collect()
    named = {r["doc_id"] for r in got} | {x for r in got for x in r["from_ids"]}
    assert named == repeated | {12, 24}
    text = dict(rows)
    text[24] = text[12]
    for r in got:
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.8
        own = text[r["doc_id"]].split()
        for other, a, b in zip(r["from_ids"], r["from_starts"], r["from_ends"]):
            span = set(text[other].split()[a:b])
            assert len(span & set(own[r["start_word"] : r["end_word"]])) >= 0.75 * len(span)
    exact = {(r["doc_id"], r["n_words"]) for r in got if r["doc_id"] in (1, 2, 3, 4)}
    assert exact == {(1, 70), (2, 70), (3, 70), (4, 70)}
    assert chaining.repeated_passages(docs(spark, [])).count() == 0


def test_passages_of_repeated_and_missing_ids(spark):
    rows, _ = passage_cases()
    odd = [(None, rows[0][1]), (3, rows[1][1]), (3, rows[2][1])]
    got = chaining.repeated_passages(docs(spark, odd)).collect()
    assert len(got) == 2 and all(r["n_words"] == 70 for r in got)
    assert sorted([str(r["doc_id"]) for r in got] + [str(x) for r in got for x in r["from_ids"]])[0] == "3"


@pytest.mark.parametrize(("n", "gap", "other_gap"), [(60, 100, 100), (60, 40, 31), (60, 0, 150), (600, 600, 600)])
def test_passages_on_both_sides_of_a_gap(spark, n, gap, other_gap):
    rng = random.Random(gap)
    one, two = words(rng, n), words(rng, n)
    rows = [(1, one + words(rng, gap) + two), (2, one + words(rng, other_gap) + two)]
    got = chaining.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["similarity"]) for r in got) == [(2, 0, n, 1.0), (2, n + other_gap, 2 * n + other_gap, 1.0)]


def test_chains_are_split_where_they_are_least_alike():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 30))
        steps = chaining.edited(a, b)
        assert steps["own"].sum() == len(a) and steps["other"].sum() == len(b) and steps["same"].sum() == chaining.matches(a.tolist(), b.tolist())
    same = np.repeat([True, False, True, False, True], [60, 5, 20, 60, 60])  # within one fragment
    assert chaining._split(chaining._straight(same), 0.8) == [(0, 85), (145, 205)]


def test_gaps_are_aligned_together_as_they_are_alone():
    rng = np.random.default_rng(5)
    gaps = []
    for k in range(1500):
        few = (2, 6, 1000)[k % 3]
        a = rng.integers(0, few, rng.integers(0, 45)).astype(np.int32)
        b = a.tolist()
        for at in rng.integers(0, len(a) + 1, rng.integers(0, 6)).tolist():
            b[at : at + rng.integers(0, 3)] = rng.integers(0, few, rng.integers(0, 3)).tolist()
        gaps.append((a, np.array(b, np.int32) if k % 5 else rng.integers(0, few, rng.integers(0, 45)).astype(np.int32)))
    gaps.append((rng.integers(0, 9, 1200).astype(np.int32), rng.integers(0, 9, 1100).astype(np.int32)))  # more than CELLS
    for (a, b), steps in zip(gaps, chaining.alignments(gaps)):
        assert (chaining.STEPS[steps] == chaining.edited(a, b)).all()


def test_a_batch_of_chains_needs_few_tables(monkeypatch):
    """A table for each gap was most of the operator's time."""
    rng = np.random.default_rng(6)
    tables, plain = [], chaining._distances
    monkeypatch.setattr(chaining, "_distances", lambda *a: tables.append(1) or plain(*a))
    rows = []
    for node in range(400):
        a = rng.integers(0, 1 << 30, 90, dtype=np.int32)
        b = np.concatenate([a[:39], a[40:43], rng.integers(0, 1 << 30, 3, dtype=np.int32), a[45:]])  # one dropped, two to three
        rows.append({"node": node, "to_node": 1000 + node, "lo": 32, "to_lo": 64, "parts": [32, 64, 30, 32 + 60, 64 + 60, 30], "words": a.tolist(), "to_words": b.tolist()})
    schema = pa.schema([("node", pa.int64()), ("to_node", pa.int64()), ("lo", pa.int32()), ("to_lo", pa.int32()), ("parts", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("to_words", pa.list_(pa.int32()))])
    found = pa.Table.from_batches(chaining._align(50, 0.8)(pa.Table.from_pylist(rows, schema).to_batches()))
    assert found.num_rows == 400 and set(found["start"].to_pylist()) == {32} and set(found["to_stop"].to_pylist()) == {64 + 90}
    assert found["similarity"].to_pylist() == pytest.approx([87 / 90] * 400) and len(tables) < 40


def test_slices_are_the_words_of_their_spans(monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "x", " ".join(words(rng, 100)), " ".join(words(rng, 700)), "y" * 3000 + " z"]
    asked = [[(0, 32)], [(0, 64)], [(0, 32), (32, 64)], [(0, 96), (64, 128), (96, 256)], [(32 * k, 32 * k + 320) for k in range(20)], [(0, 32)]]
    batch = pa.RecordBatch.from_pylist([{"node": 7 * i, "asked": [{"lo": lo, "hi": hi} for lo, hi in spans_], "text": text} for i, (text, spans_) in enumerate(zip(texts, asked))], pa.schema([("node", pa.int64()), ("asked", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), ("text", pa.string())]))
    expected = []
    for i, (text, spans_) in enumerate(zip(texts, asked)):
        own = [int(word_hashes(pa.array([w]))[0][0] >> np.uint64(33)) for w in (text or "").split()]
        expected += [(7 * i, lo, hi, own[lo:hi]) for lo, hi in spans_]
    for most in (chaining.SLICE_WORDS, 500):
        monkeypatch.setattr(chaining, "SLICE_WORDS", most)
        got = [tuple(r.values()) for b in chaining._slices([batch]) for r in b.to_pylist()]
        assert got == expected


@pytest.mark.parametrize("near", [1, 100, 1 << 15])
def test_words_hash_alike_wherever_they_stand(monkeypatch, near):
    monkeypatch.setattr(words_module, "NEAR", near)
    rng = random.Random(near)
    texts = [None, " ", "a", *(" ".join(["x" * rng.choice((1, 2, 9, 1023, 1024, 1025, 5000)) + str(rng.randrange(99)) for _ in range(rng.randrange(40))]) + rng.choice(("", "\n ")) for _ in range(12))]
    hashes, counts = word_hashes(pa.array(texts))
    assert counts.tolist() == [len((t or "").split()) for t in texts]
    assert hashes.tolist() == [int(word_hashes(pa.array([" " + w]))[0][0]) for t in texts for w in (t or "").split()]


def test_places_apart_are_in_order_whatever_order_they_come_in():
    rng = np.random.default_rng(8)
    h, context, node = (rng.integers(0, n, 4000) for n in (30, 3, 8))
    pos = rng.permutation(4000)
    order = np.lexsort((pos, node))
    rows = [x[order] for x in (h, context, node, pos, rng.integers(20, 50, 4000))]
    one = chaining._apart(*rows)
    mixed_up = [x[np.arange(4000) * 1237 % 4000] for x in rows]
    other = chaining._apart(*mixed_up)
    keys = np.array([x[one] for x in rows[:4]])
    assert (np.lexsort(keys[[3, 2, 1, 0]]) == np.arange(len(one))).all() and 0 < len(one) < 4000
    assert (keys == np.array([x[other] for x in mixed_up[:4]])).all()


def places_of(words_, piece):
    return [i for i in range(len(words_) - len(piece) + 1) if words_[i : i + len(piece)] == piece]


def reported(spark, texts):
    return chaining.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in sorted(texts.items())])).collect()


def test_an_earlier_text_with_a_passage_in_parts_hides_no_copy(spark):
    rng = random.Random(21)
    texts = {}
    for k in range(40):
        p = words(rng, 60)
        texts[3 * k] = words(rng, 20) + p[:30] + words(rng, 25) + p[30:] + words(rng, 9)
        texts[3 * k + 1] = words(rng, 11) + p + words(rng, 30)
        texts[3 * k + 2] = words(rng, 33) + p + words(rng, 8)
    for k in range(40):  # the parts are passages themselves
        p = words(rng, 100)
        texts[200 + 3 * k] = p[:50] + words(rng, 40) + p[50:]
        texts[201 + 3 * k], texts[202 + 3 * k] = words(rng, 7) + p, p + words(rng, 7)
    got = {(r["doc_id"], x): r for r in reported(spark, texts) for x in r["from_ids"]}
    for k in range(40):
        assert got[3 * k + 2, 3 * k + 1]["n_words"] == 60
        assert got[202 + 3 * k, 201 + 3 * k]["n_words"] == 100


def test_texts_with_parts_alone_make_no_passage(spark):
    rng = random.Random(22)
    texts, n = {}, 0
    for _ in range(10):
        parts = [words(rng, 14) for _ in range(5)]
        for part in parts:
            texts[n := n + 1] = words(rng, 30) + part + words(rng, 30)
        texts[n := n + 1] = [w for part in parts for w in part]
    assert not reported(spark, texts)


def test_contexts_of_two_lengths_with_equal_bits(spark):
    """The contexts of 7 and 8 have the same 32 bits; that of 7 ends with its text.  Far texts come from other blocks."""
    lead, rest = "a b c d e525".split(), [f"t{i}" for i in range(60)]
    short, long = lead + "515 573 78 395".split() + rest[:16], lead + "29 557 743 428".split() + rest
    bits = {int(mixed(spans(word_hashes(pa.array([" ".join(w)]))[0], np.array([0]), np.array([n])))[0]) >> 32 for w, n in ((short, 25), (long, chaining.LEAST))}
    assert len(bits) == 1
    rng = random.Random(31)
    texts = {6: lead + words(rng, 30), 7: short, 8: long, 9: words(rng, 9) + long}
    found = {(8, 9)}
    assert {(x, r["doc_id"]) for r in reported(spark, texts) for x in r["from_ids"]} == found
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4, "doc_id")
    assert {(x, r["doc_id"]) for r in chaining.repeated_passages(rows).collect() for x in r["from_ids"]} == found


def longest_runs(a, b, least):
    """(begin, begin in the other, length) of the maximal equal runs of two texts."""
    out, before = [], {}
    for i, x in enumerate(a):
        now = {j: before.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y}
        out += [(i - before[j], j - before[j] + 1, before[j]) for j in before if j + 1 not in now]
        before = now
    out += [(len(a) - n, j - n + 1, n) for j, n in before.items()]
    return [r for r in out if r[2] >= least]


@pytest.mark.parametrize("seed", range(3))
def test_passages_against_all_runs_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, rng.randrange(60, 140)) for _ in range(4)]
    texts = {}
    for k in range(36):
        text = words(rng, rng.randrange(30))
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.choice([0, 0, rng.randrange(40)])
            b = rng.choice([len(p), len(p), rng.randrange(a + 10, len(p) + 1)])
            text += p[a:b] + words(rng, rng.choice([0, 5, 40]))
        texts[k] = text
    rows = reported(spark, texts)
    least = chaining.LEAST
    for i in texts:
        for j in range(i):
            for begin, _, n in longest_runs(texts[i], texts[j], least + 8):
                assert any(r["doc_id"] == i and r["start_word"] <= begin + 7 and r["end_word"] >= begin + n - 7 for r in rows), (i, j, begin, n)
    for r in rows:
        assert r["similarity"] >= 0.8 and max(r["from_ids"]) < r["doc_id"]
        own = texts[r["doc_id"]][r["start_word"] : r["end_word"]]
        for other, a, b in zip(r["from_ids"], r["from_starts"], r["from_ends"]):
            same = chaining.matches(own, texts[other][a:b])
            assert b - a >= 0.8 * least and same >= 0.8 * (b - a)


def test_edited_passages(spark):
    """Recall by the distance of the edits; half of these replace a word, the others drop or insert one."""
    rng = random.Random(23)
    found = {}
    for every in (16, 12, 8, 6):
        texts = {}
        for k in range(60):
            p = words(rng, 80)
            q = [x for at, w in enumerate(p) for x in ([w] if at % every != every // 2 else rng.choice([words(rng, 1), words(rng, 1), [], [w, *words(rng, 1)]]))]
            texts[2 * k], texts[2 * k + 1] = words(rng, 25) + p + words(rng, 25), words(rng, 40) + q + words(rng, 15)
        found[every] = len({r["doc_id"] for r in reported(spark, texts)}) / 60
    assert found[16] >= 0.95 and found[12] >= 0.9 and found[8] >= 0.7, found


def apart(spark, texts, blocks, **options):
    """``reported`` of texts that lie in so many blocks."""
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    return chaining.repeated_passages(rows.repartition(blocks, "doc_id") if blocks > 1 else rows.coalesce(1), **options).collect()


@pytest.mark.parametrize("blocks", [1, 5])
@pytest.mark.parametrize("n_before", [1, 3, 40])
def test_earlier_texts_with_all_but_a_few_words_hide_no_passage(spark, n_before, blocks):
    """Of each passage earlier texts hold 45 to 49 words, too few to be named; the two that hold all of it are linked."""
    rng = random.Random(41)
    texts, want = {}, set()
    for k in range(24):
        p = words(rng, 50 + k % 8)
        at = 1000 * k
        for j in range(n_before):
            cut = rng.randrange(1, len(p) - 44)
            own = min(len(p), cut + 49)
            texts[at + j] = words(rng, 20) + p[cut:own] + words(rng, 20) if (k + j) % 2 else words(rng, 20) + p[: len(p) - cut][-49:] + words(rng, 20)
        texts[at + 900], texts[at + 901] = words(rng, 15) + p + words(rng, 9), words(rng, 6) + p + words(rng, 11)
        want.add((at + 901, at + 900, 6, 6 + len(p)))
    rows = apart(spark, texts, blocks)
    got = {(r["doc_id"], x, r["start_word"], r["end_word"]) for r in rows for x in r["from_ids"]}
    assert want <= got, len(want - got)


@pytest.mark.parametrize("blocks", [1, 5])
def test_edited_copies_are_linked_to_each_other(spark, blocks):
    """Two late texts are alike beside an original that neither is like; a k-mer's first place alone led to the original."""
    rng = random.Random(42)
    texts = {}
    for k in range(30):
        p = words(rng, 100)
        q = [w if at % 7 else "edit%d" % rng.randrange(10**6) for at, w in enumerate(p)]
        r = [w if at % 20 != 10 else "edit%d" % rng.randrange(10**6) for at, w in enumerate(q)]
        for j in range(6):  # earlier texts have 20 of its words each, in places that overlap
            texts[100 * k + j] = words(rng, 30) + q[15 * j : 15 * j + 20] + words(rng, 30)
        texts[100 * k + 90], texts[100 * k + 91] = words(rng, 12) + q + words(rng, 12), words(rng, 7) + r + words(rng, 16)
    got = {(r["doc_id"], x): r["n_words"] for r in apart(spark, texts, blocks) for x in r["from_ids"]}
    assert sum(got.get((100 * k + 91, 100 * k + 90), 0) >= 90 for k in range(30)) == 30


@pytest.mark.parametrize("blocks", [1, 5])
def test_edited_copies_of_crowded_words_are_linked_to_each_other(spark, blocks):
    """All runs of 5 words of a passage lie in more than ``FEW`` earlier texts, in pieces of 12 that are no passages."""
    rng = random.Random(43)
    texts = {}
    for k in range(10):
        p = words(rng, 100)
        for j in range(chaining.FEW + 4):
            pieces = [p[at : at + 12] for at in range(0, 96, 4)]
            rng.shuffle(pieces)
            texts[100 * k + j] = [w for piece in pieces for w in piece + words(rng, 20)]
        edited = [w if at % 16 != 8 else "edit%d" % rng.randrange(10**6) for at, w in enumerate(p)]
        texts[100 * k + 90], texts[100 * k + 91] = words(rng, 12) + p + words(rng, 12), words(rng, 7) + edited + words(rng, 16)
    got = {(r["doc_id"], x): r["n_words"] for r in apart(spark, texts, blocks) for x in r["from_ids"]}
    assert sum(got.get((100 * k + 91, 100 * k + 90), 0) >= 90 for k in range(10)) == 10


@pytest.mark.parametrize("few", [0, 2, 16])
@pytest.mark.parametrize("blocks", [1, 4])
def test_every_run_of_least_words_is_in_a_passage(spark, few, blocks):
    rng = random.Random(few + blocks)
    pool = [words(rng, rng.randrange(50, 120)) for _ in range(4)]
    texts = {}
    for k in range(40):
        text = words(rng, rng.randrange(30))
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p) - 30)
            text += p[a : rng.randrange(a + 30, len(p) + 1)] + words(rng, rng.choice([0, 5, 40]))
        texts[k] = text
    rows = apart(spark, texts, blocks, few=few)
    for i in texts:
        for j in range(i):
            for begin, _, n in longest_runs(texts[i], texts[j], chaining.LEAST):
                assert any(r["doc_id"] == i and r["start_word"] <= begin and r["end_word"] >= begin + n for r in rows), (i, j, begin, n)


def test_rows_in_bytes_come_back_as_they_were(monkeypatch):
    monkeypatch.setattr(chaining, "PACK", 700)
    rng = np.random.default_rng(9)
    sent, n = [], 0
    for kind in (chaining.LINK, chaining.FIRST, chaining.PAIR, chaining.RUN, chaining.LINK):
        types = [chaining.KINDS[kind].fields[c][0] for c in chaining.KINDS[kind].names]
        columns = [rng.integers(np.iinfo(t).min, np.iinfo(t).max, 500, dtype=t, endpoint=True) for t in types]
        columns[0][:300] = columns[0][0]  # of one bucket, in several batches
        sent.append((kind, columns))
    sent += [(chaining.RUN, [x[:0] for x in sent[3][1]])]
    batches = list(chaining._packed(lambda batches: iter(batches), 8)(sent))
    rows = pa.Table.from_batches(batches)
    assert rows.num_rows < 100 and set(rows["bucket"].to_pylist()) == set(range(8))
    got = list(chaining._unpacked(rows.sort_by([("bucket", "ascending"), ("kind", "ascending")]).to_batches(max_chunksize=3)))
    assert len(got) == len(set(zip(rows["kind"].to_pylist(), rows["bucket"].to_pylist())))
    listed = lambda rows: sorted((kind, *row) for kind, columns in rows for row in zip(*(c.tolist() for c in columns)))
    assert listed(got) == listed(sent)
    assert not list(chaining._packed(lambda batches: iter(batches), 8)([])) and not list(chaining._unpacked([]))


def test_fragments_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(10)
    of = np.sort(rng.integers(0, 60, 3000))
    pos = rng.integers(0, 300, 3000)
    to, size = pos + rng.integers(-3, 4, 3000) * rng.integers(0, 2, 3000), rng.choice([5, 45, 50], 3000)
    parts, pair = chaining._fragments(of, pos, to, size)
    assert len(parts) == len(pair) > 200 and (np.diff(pair) >= 0).all()
    for k in range(60):
        assert [x for x, of_ in zip(parts, pair.tolist()) if of_ == k] == chaining.fragments(pos[of == k], to[of == k], size[of == k])
        for p, t, n, worth in chaining.fragments(pos[of == k], to[of == k], size[of == k]):
            links = (of == k) & (to - pos == t - p) & (pos >= p) & (pos + size <= p + n)
            covered = len({w for a, m in zip(pos[links].tolist(), size[links].tolist()) for w in range(a, a + m)})
            assert worth == pytest.approx(covered - 2 * chaining.GAP_COST * (n - covered))


def test_chains_that_no_other_holds():
    others = [[(0, 10, 20, 20.0), (30, 45, 10, 10.0)], [(100, 100, 50, 50.0)]]
    held = [[(2, 12, 5, 5.0), (30, 45, 10, 10.0)], [(100, 100, 50, 50.0)], [(101, 101, 5, 5.0), (120, 120, 30, 30.0)]]
    free = [[(2, 12, 5, 5.0), (110, 110, 5, 5.0)], [(2, 13, 5, 5.0)], [(99, 99, 5, 5.0)], [(140, 140, 11, 11.0)], [(2, 12, 19, 19.0)]]
    assert chaining._not_held(held + free, others) == free and chaining._not_held(held, []) == held


def test_spark_sees_few_rows_for_many_places(spark, monkeypatch):
    """A row of Spark's for each place and link was most of the operator's time."""
    monkeypatch.setattr(chaining, "BUCKETS", (8, 8), raising=False)
    counts, plain = {}, chaining.Tables.write

    def counted(self, df, name, **options):
        table = plain(self, df, name, **options)
        counts[name] = table.count()
        return table

    monkeypatch.setattr(chaining.Tables, "write", counted)
    rng = random.Random(44)
    p = words(rng, 2000)
    texts = {k: words(rng, 300) + p + words(rng, 300) for k in range(12)}
    rows = apart(spark, texts, 2)
    assert {(r["doc_id"], r["start_word"], r["n_words"]) for r in rows} == {(k, 300, 2000) for k in range(1, 12)}
    assert counts["linked"] < 300 and "places" not in counts and "windows" not in counts  # 12 x 2,000 / 3.5 links


def test_crowded_bands_are_done_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "FEW", 2)
    monkeypatch.setattr(probminhash, "BLOCK", 3)
    rng = random.Random(11)
    base, rows = words(rng, 60), []
    for k in range(40):  # a group with similarities on both sides of the threshold
        copy = list(base)
        for at in rng.sample(range(60), rng.randrange(1, 5)):
            copy[at] = "edit%d" % rng.randrange(10**6)
        rows.append((k, " ".join(copy)))
    got = probminhash.near_classes(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in got) == near_by_brute_force(rows)


def test_outer_texts_go_only_where_a_rare_shingle_is(spark, monkeypatch):
    """Texts that share 200 of 260 words share bands, but no two are near; each other's blocks need not see them."""
    rng = random.Random(12)
    common = words(rng, 200)
    texts = [common + words(rng, 60) for _ in range(300)] + [words(rng, 40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900 + k, " ".join([*texts[k], "more"])) for k in range(5)]
    sent = []
    linked = probminhash._blocks

    def spy(similarity):
        run = linked(similarity)

        def counted(batches):
            for batch in batches:
                if sum(batch.column("outer").to_pylist()) > 60:
                    raise ValueError("too many texts are sent")
                yield from run([batch])

        return counted

    monkeypatch.setattr(probminhash, "BLOCK", 16)
    monkeypatch.setattr(probminhash, "_blocks", spy)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_classes(docs(spark, rows)).collect()}
    assert got == {k: k - 900 if k >= 900 else k for k, _ in rows}
