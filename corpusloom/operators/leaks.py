"""Held-out texts kept out of training: equality and containment of relaxed keys.

A key of at least 40 characters shares with any text that contains it the minimizer of each
of its windows of 40 bytes, of which the one that fewest keys have is taken.  While all
keys are small (their size is summed first) they are sent to the tasks, and one pass over
the texts decides on both: equal keys by a table, contained ones where a text has a
key's minimizer.  Beyond, equality is a join on the keys' hashes and containment one on the
minimizers; only numbers of texts and keys are shuffled, and the keys fetched for those
that meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grams
from ..functions import text as T

MIN_CONTAINMENT = 40
EVERYTHING = "*"
# The held-out capabilities that each part of a mixture is checked against.
TARGETS = {
    "moore.jsonl": ("moore_humain", "moore_whisper"),
    "francais.jsonl": ("francais", "francais_parallele"),
    "anglais.jsonl": ("anglais",),
    "code.jsonl": ("code",),
    "maths.jsonl": ("maths",),
    "C/francais.jsonl": ("francais", "francais_parallele"),
    "P/bilingue.jsonl": ("moore_humain", "moore_whisper", "francais", "francais_parallele"),
    "P2/bilingue.jsonl": ("moore_humain", "moore_whisper", "francais", "francais_parallele"),
}
#: Characters of keys that are sent to every task; beyond, the joins.
SENT_CHARS = 32 << 20


def held_out_keys(held_out: DataFrame) -> DataFrame:
    """``capacite, held_key`` without repeats."""
    return held_out.select("capacite", T.key(F.col("text")).alias("held_key")).filter("held_key IS NOT NULL").distinct()


def routes(held: DataFrame, parts: DataFrame, targets: dict[str, tuple[str, ...]], strict: bool = False) -> DataFrame:
    """``part, held_key``: the keys that each part is checked against; an unknown part has none, ``strict`` raises for it."""
    spark = held.sparkSession
    table = spark.createDataFrame([(p, c) for p, cs in targets.items() for c in cs], "part string, capacite string")
    if strict:
        unknown = [r[0] for r in parts.select("part").distinct().join(table.select("part").unionAll(spark.createDataFrame([(EVERYTHING,)], "part string")), "part", "left_anti").limit(20).collect()]
        if unknown:
            raise ValueError(f"parts without targets: {sorted(map(str, unknown))}")
    every = held.select(F.lit(EVERYTHING).alias("part"), "held_key")
    return table.join(held, "capacite").select("part", "held_key").unionAll(every).distinct()


def inspected(rows: DataFrame, routed: DataFrame, least: int = MIN_CONTAINMENT, key: str | None = None, sent_chars: int = SENT_CHARS) -> DataFrame:
    """``rows`` (with ``row_id`` unique, ``part`` and ``text``) and ``leak``: equal, contained or null."""
    keyed = rows.select("row_id", "part", (F.col(key) if key else T.key(F.col("text"))).alias("_key"))
    return rows.join(leaking(keyed, routed, least, sent_chars, True), "row_id", "left")


def contained(keyed: DataFrame, routed: DataFrame, least: int = MIN_CONTAINMENT, sent_chars: int = SENT_CHARS) -> DataFrame:
    """``row_id`` of the rows (``row_id, part, _key``) whose key has a held-out key of their part inside."""
    return leaking(keyed, routed.filter(F.length("held_key") >= least), least, sent_chars, False).select("row_id")


def leaking(keyed: DataFrame, routed: DataFrame, least: int = MIN_CONTAINMENT, sent_chars: int = SENT_CHARS, equal: bool = True) -> DataFrame:
    """``row_id, leak`` of the rows (``row_id, part, _key``) that leak; without ``equal`` a key is only looked for inside."""
    if least < grams.GRAM + grams.WINDOW - 1:
        raise ValueError(f"containment is told by {grams.GRAM + grams.WINDOW - 1} characters at least")
    size = routed.agg(F.coalesce(F.sum(F.length("held_key")), F.lit(0))).first()[0]
    if size == 0:
        return keyed.select("row_id", F.lit(None).cast("string").alias("leak")).limit(0)
    if size <= sent_chars:
        found = routed.groupBy("held_key").agg(F.collect_set("part").alias("parts"))  # a key's parts are few
        return _by_table(keyed, {r["held_key"]: frozenset(r["parts"]) for r in found.toLocalIterator()}, least, equal)
    inside = _by_joins(keyed, routed.filter(F.length("held_key") >= least)).select("row_id", F.lit("contained").alias("leak"))
    if not equal:
        return inside
    same = _equal(keyed, routed).select("row_id", F.lit("equal").alias("leak"))
    return same.unionAll(inside).groupBy("row_id").agg(F.max("leak").alias("leak"))  # equal comes after contained


def rarest(keys: list[str]) -> np.ndarray:
    """Of each key the minimizer that fewest of the keys have."""
    found = [(of + first, h) for first, buf, offsets in grams.blocks(pa.array(keys, pa.large_string())) for of, h in [grams.minimizers(buf, offsets)]]
    of, h = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else ([], [])))
    order = np.lexsort((of, h))
    once = order[np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(of[order]) != 0)])[: len(order)]]
    _, group, many = np.unique(h[once], return_inverse=True, return_counts=True)
    best = once[np.lexsort((h[once], many[group], of[once]))]
    first = np.concatenate([[True], np.diff(of[best]) != 0])[: len(best)]
    return h[best[first]]


class Held:
    """Held-out keys by their content and by minimizer, built once in a worker."""

    last: tuple[dict, Held] | None = None

    def __init__(self, parts: dict[str, frozenset[str]], least: int):
        self.parts = parts
        self.keys = [k for k in parts if len(k) >= least]
        own = rarest(self.keys)
        order = np.argsort(own, kind="stable")
        self.grams, self.key_of = own[order], order

    def inside(self, texts: pa.Array, parts: list[str]) -> np.ndarray:
        """Whether each text has a key of its part inside."""
        hit = np.zeros(len(texts), dtype=bool)
        for first, buf, offsets in grams.blocks(texts):
            of, h = grams.minimizers(buf, offsets)
            low, high = np.searchsorted(self.grams, h, side="left"), np.searchsorted(self.grams, h, side="right")
            met = np.flatnonzero(high > low)
            for k, a, b in zip((of[met] + first).tolist(), low[met].tolist(), high[met].tolist()):
                if not hit[k]:
                    text = texts[k].as_py()
                    hit[k] = any(parts[k] in self.parts[key] and key in text for key in (self.keys[i] for i in self.key_of[a:b]))
        return hit


def _by_table(keyed: DataFrame, parts: dict[str, frozenset[str]], least: int, equal: bool) -> DataFrame:
    shared = keyed.sparkSession.sparkContext.broadcast(parts)  # at most SENT_CHARS characters

    def run(batches):
        if Held.last is None or Held.last[0] is not shared.value:
            Held.last = shared.value, Held(shared.value, least)
        held = Held.last[1]
        for batch in batches:
            keys, part = batch.column("_key").cast(pa.large_string()), batch.column("part").to_pylist()
            same = np.array([equal and k is not None and p in held.parts.get(k, ()) for p, k in zip(part, keys.to_pylist())], dtype=bool)
            inside = held.inside(keys, part) & ~same
            hit = same | inside
            leak = pa.array(np.where(same, "equal", "contained")[hit].tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row_id").filter(pa.array(hit)), leak], names=["row_id", "leak"])

    return keyed.mapInArrow(run, f"row_id {keyed.schema['row_id'].dataType.simpleString()}, leak string")


def _equal(keyed: DataFrame, routed: DataFrame) -> DataFrame:
    """``row_id`` of the rows whose key is one of their part's: met by a hash, then compared."""
    rows = keyed.select("row_id", "part", F.xxhash64("_key").alias("_h"))
    keys = routed.select("part", "held_key", F.xxhash64("held_key").alias("_h"))
    met = rows.join(keys.select("part", "_h").distinct(), ["part", "_h"], "left_semi").select("row_id")
    texts = keyed.join(met, "row_id", "left_semi").withColumn("_h", F.xxhash64("_key"))
    return texts.join(keys, ["part", "_h"]).filter(F.col("_key") == F.col("held_key")).select("row_id").distinct()


def _emitted(column: str, keep: list[str]):
    """Rows of ``keep`` and ``gram``, one for each minimizer of ``column``."""

    def run(batches):
        for batch in batches:
            for first, buf, offsets in grams.blocks(batch.column(column)):
                of, h = grams.minimizers(buf, offsets)
                at = pa.array(of + first)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(h)], names=[*keep, "gram"])

    return run


def _by_joins(keyed: DataFrame, routed: DataFrame) -> DataFrame:
    """``row_id`` of the rows that have a key of their part inside; keys meet texts at one minimizer each."""
    needles = routed.select(F.xxhash64("held_key").alias("key_id"), "held_key").distinct()
    every = needles.mapInArrow(_emitted("held_key", ["key_id"]), "key_id long, gram long").distinct()
    many = every.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = every.join(many, "gram").groupBy("key_id").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    kind = keyed.schema["row_id"].dataType.simpleString()
    places = keyed.select("row_id", "_key").mapInArrow(_emitted("_key", ["row_id"]), f"row_id {kind}, gram long")
    pairs = places.join(chosen, "gram").select("row_id", "key_id").distinct()
    both = pairs.join(needles, "key_id").join(keyed, "row_id").filter(F.contains("_key", "held_key"))
    # two keys of one hash meet a text together, and each is compared by itself
    return both.select("row_id", "part", "held_key").join(routed, ["part", "held_key"], "left_semi").select("row_id").distinct()


def first_leak_of_turn(turns: DataFrame, held: DataFrame, least: int = MIN_CONTAINMENT) -> DataFrame:
    """Of each turn (``turn_id, task, source, messages``) its first leaking message, checked against everything: ``turn_id, task, source, at, leak``."""
    messages = turns.select("turn_id", "task", "source", F.posexplode("messages").alias("at", "message"))
    rows = messages.select("turn_id", "task", "source", "at", F.col("message.content").alias("text"), F.lit(EVERYTHING).alias("part")).withColumn("row_id", F.struct("turn_id", "at"))
    found = inspected(rows, held.select(F.lit(EVERYTHING).alias("part"), "held_key").distinct(), least).filter("leak IS NOT NULL")
    order = Window.partitionBy("turn_id").orderBy("at")
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").select("turn_id", "task", "source", "at", "leak")


def inspector(keys: list[str], least: int = MIN_CONTAINMENT):
    """A table function ``inspect(key)`` with a row ``how, held_key`` for each held-out key that a relaxed key leaks.

    For SQL over texts in ``LATERAL`` joins; ``keys`` is a short list that travels with the function.
    """
    from pyspark.sql.functions import udtf

    class Inspect:
        def __init__(self):
            import ahocorasick

            self.exact = set(keys)
            self.automaton = ahocorasick.Automaton()
            for k in keys:
                if len(k) >= least:
                    self.automaton.add_word(k, k)
            self.automaton.make_automaton()

        def eval(self, key: str):
            if key is None:
                return
            if key in self.exact:
                yield "equal", key
            if len(self.automaton):
                for found in sorted({k for _, k in self.automaton.iter(key)} - {key}):
                    yield "contained", found

    return udtf(Inspect, returnType="how string, held_key string")
