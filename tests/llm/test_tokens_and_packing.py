import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import packing, token_output
from corpusloom.llm.bpe import Encoder, blocks

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)
DOC = "doc_id long, text string, offset string, tier string"
TEXTS = ["", "a", "hello world", "  two  spaces  ", "line\nbreak\n\n x", "don't <|endoftext|> stop", "été ß 你好  x", "word " * 700, "x" * 9000, "tab\t y \u3000 z"]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\u00a0\u3000abAB'.s1é!<|endoftext>", max_size=40), max_size=6))
def test_encoder_equals_the_library(texts):
    ids, offsets = ENCODER.encode(pa.array(texts, pa.string()), 0)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(t) for t in texts]


def test_cache_begins_anew(monkeypatch):
    monkeypatch.setattr("corpusloom.llm.bpe.CACHE_PIECES", 3)
    e = Encoder(PATH)
    for _ in range(3):
        ids, offsets = e.encode(pa.array(TEXTS), None)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(t)[:-1] for t in TEXTS]


def test_blocks_cover_all_rows():
    array = pa.array(["x" * n for n in (0, 5, 100, 1, 0, 7)] + [None])
    assert sum((p.to_pylist() for _, p in blocks(array, 8)), []) == array.to_pylist()


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_ids_are_written_in_order_and_read_back(spark):
    rows = [(i * 3 % 10, t, "o", "t") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (4, "again", "o", None), (4, "again", "o", None)]
    got = token_output.token_ids(docs(spark, rows), PATH).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(ids_of(t)), crc(ids_of(t))) for _, t, _, _ in rows)


def test_empty_table(spark):
    assert token_output.token_ids(docs(spark, []), PATH).count() == 0
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def test_file_layout(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write_ids(docs(spark, [(i, t, None, None) for i, t in enumerate(TEXTS)]), path, PATH)
    for file in (tmp_path / "ids").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert "DELTA_BINARY_PACKED" in ids.encodings and "RLE_DICTIONARY" not in ids.encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    plan = token_output.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1023), max_size=60))
def test_remainders_fill_their_windows(sizes):
    full, left = packing.pack_remainders(np.array(sizes, dtype=np.int64))
    assert all(sum(e - b for _, b, e in w) in packing.TIERS for w in full)
    assert sum(e - b for _, b, e in left) < packing.TIERS[-1]
    pieces = {}
    for i, b, e in [p for w in full for p in w] + left:
        pieces.setdefault(i, []).append((b, e))
    for i, n in enumerate(sizes):
        spans = sorted(pieces.get(i, []))
        assert [b for b, _ in spans] == [0, *(e for _, e in spans)][: len(spans)] and (spans[-1][1] if spans else 0) == n


@pytest.mark.parametrize(("median", "tiers"), [(60, {512, 256, 128, 64}), (300, {1024, 512, 256}), (1500, {1024})])
def test_tiers_are_packed(median, tiers):
    rng = np.random.default_rng(median)
    sizes = np.minimum(rng.lognormal(np.log(median), 0.8, 10_000).astype(int) + 1, 20_000) % 1024
    full, left = packing.pack_remainders(sizes)
    lengths = [sum(e - b for _, b, e in w) for w in full]
    counts = {t: lengths.count(t) for t in packing.TIERS}
    assert {t for t in packing.TIERS if counts[t] > 200} == tiers | ({256} if median == 60 else set()), counts
    # few pieces are cut, and the gaps of a tier are filled by shorter pieces
    assert sum(map(len, full)) < 1.6 * (sizes > 0).sum() and sum(e - b for _, b, e in left) < 64
    for window, n in zip(full, lengths):
        longest = max(e - b for _, b, e in window)
        assert longest > n / 2 or n == packing.TIERS[-1] or median == 1500


def test_equal_pieces_stay_in_their_tier():
    full, left = packing.pack_remainders(np.full(3000, 300))
    lengths = [sum(e - b for _, b, e in w) for w in full]
    assert lengths.count(512) >= 0.99 * len(lengths) and sum(lengths) + sum(e - b for _, b, e in left) == 900_000


def test_step_groups_of_every_tier():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 700, 4000)
    ids = np.arange(int(sizes.sum()), dtype=np.int32)
    rows = packing.Packer(0).pack(list(range(4000)), ids, np.concatenate([[0], np.cumsum(sizes)]), last=True).to_pandas()
    groups = rows.groupby(["tier", "step_group"]).agg(sequences=("sequence_id", "nunique"), pieces=("doc_id", "size")).reset_index()
    for tier, own in groups[groups.tier.isin(packing.TIERS)].groupby("tier"):
        assert own.sequences.max() - own.sequences.min() <= 1 and own.sequences.max() <= packing.STEP_SEQUENCES
        assert own.pieces.max() - own.pieces.min() <= packing.STEP_SEQUENCES, tier
    assert (groups[groups.sequences > 1].tier.nunique()) >= 3
    short = rows.groupby("sequence_id").length.sum()
    assert (~short.isin(packing.TIERS)).sum() <= 1


def test_every_id_lies_in_one_piece(spark, monkeypatch):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS * 8)] + [(None, None, None, None), (0, "", None, None)]
    got = packing.pack_documents(docs(spark, rows).filter("doc_id IS NOT NULL").filter(F.col("offset").isNotNull()), PATH).toPandas()
    for doc_id, own in got.sort_values("start").groupby("doc_id"):
        ids = ids_of(TEXTS[doc_id % len(TEXTS)])
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
    lengths = got.groupby("sequence_id").length.sum()
    assert (~lengths.isin(packing.TIERS)).sum() <= 4 and lengths.max() <= 1024  # one for each task
    assert packing.pack_documents(docs(spark, rows), PATH).agg(F.sum("length")).first()[0] == sum(len(ids_of(t)) for _, t, _, _ in rows)


def test_step_groups_are_balanced(spark):
    got = packing.pack_documents(docs(spark, [(i, "some words here " * 900, None, None) for i in range(60)]).coalesce(1), PATH, step=8).toPandas()
    whole = got[got.tier == 1024].groupby("step_group").agg(tokens=("length", "sum"), sequences=("sequence_id", "nunique"))
    assert whole.sequences.max() - whole.sequences.min() <= 1 and whole.sequences.max() <= 8


def test_blocks_carry_over(monkeypatch):
    packer = packing.Packer(0)
    ids = np.arange(700, dtype=np.int32)
    first = packer.pack([1], ids, np.array([0, 700]))
    last = packer.pack([2], ids, np.array([0, 700]), last=True)
    rows = pa.Table.from_batches([first, last]).to_pylist()
    for doc in (1, 2):
        own = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == doc)
        assert [s for s, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) == 700


@pytest.mark.parametrize("config", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "BPE", "dropout": 0.1}}])
def test_other_tokenizers_are_not_cut(config):
    import json

    from corpusloom.llm.bpe import plain

    assert plain(json.loads(TOKENIZER.to_str())) and not plain(json.loads(TOKENIZER.to_str()) | config)
