"""Operator 10: near-duplicates by ProbMinHash, banding and exact verification.

Signatures.  The five-word shingles of a text are weighted by how often they occur in it.
Each shingle is a Poisson process of its weight's rate, drawn from its hash, whose points
fall on random registers; a register keeps the shingle that arrives first, so that two
texts agree in a register with the probability Jaccard similarity of their weights.  A
process ends once its next point is later than every register's.

Candidates.  Texts that are equal are one class beforehand.  Registers are banded; a band
that few texts share gives all their pairs, one that many share gives each text's pairs
with three pivots: the text that shares most bands with others, and two more.  Pairs are
verified with the exact probability Jaccard similarity of whole texts and joined to
components by label propagation.  Texts of bands that still fall into several components
are then done exactly.  Two similar texts lack less than a fifth of their weight in each
other, so the first shingle that they share, rarest first, is among those that make up the
first fifth of either: texts of different components are compared if they share one of
these, a block of texts at a time, in memory; no pairs are written, and a text goes only
to the blocks that have such a shingle, the one of the smaller component to that of the
larger.  Texts are put into blocks in order of the commonest of these shingles, so that
texts that share one lie in few blocks.  Texts that are connected already need no comparing, so no link between different
classes is lost.

Result: a row for each document with its class, which is the smallest doc_id of it.

Cases: texts of under five words are one shingle; texts without words (null, empty,
blank) are near no text and only equal to texts with the same characters (null as
empty); rows that repeat an id are rows of their own and in its class by their text; null
ids come last, and a class of null ids alone has a null class_id; of a class one row is
``kept``: the smallest id's, of rows that repeat it and its text all are; an empty table
gives no rows; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import blocks
from .shared import Tables, whole_row
from .words import mixed, shingles, word_hashes

BANDS, ROWS = 25, 5
SHINGLE = 5
SIMILARITY = 0.8
#: A band of at most so many texts gives all their pairs.
FEW = 8
#: Texts that are held at once and compared with others.
BLOCK = 256
#: Counters by which shingles are put in order, rarest first.
COUNTERS = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted(hashes: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text in ascending order and their numbers."""
    return np.unique(shingles(hashes, n), return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """(texts, m) registers from the distinct elements of each text, one text after another; 0 where a text has none."""
    docs = len(counts)
    first = np.full(docs * m, np.inf)
    sig = np.zeros(docs * m, dtype=np.uint64)
    doc = np.repeat(np.arange(docs), counts)
    lone = counts == 1
    sig.reshape(docs, m)[lone] = elements[lone[doc]][:, None]
    live = np.flatnonzero(~lone[doc])
    e, w, doc = elements[live], weights[live].astype(np.float64), doc[live]
    t = np.zeros(len(e))
    state = e.copy()
    while len(e):
        state = state + GOLDEN
        draw = mixed(state)
        t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w
        at = doc * m + (mixed(draw) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, t)
        won = t == first[at]
        sig[at[won]] = e[won]
        alive = np.unique(doc)
        late = np.full(docs, -np.inf)
        late[alive] = first.reshape(docs, m)[alive].max(axis=1)
        go = t < late[doc]
        e, w, doc, t, state = e[go], w[go], doc[go], t[go], state[go]
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = mixed(key * GOLDEN + sig[:, b * rows + r])
        keys[:, b] = key
    return keys.view(np.int64)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (xe, xw), (ye, yw) = x, y
    _, ix, iy = np.intersect1d(xe, ye, assume_unique=True, return_indices=True)
    if not len(ix):
        return 0.0
    a, b = xw[ix].astype(np.float64), yw[iy].astype(np.float64)
    only_x, only_y = xw.sum() - a.sum(), yw.sum() - b.sum()
    ratio = b / a
    order = np.argsort(ratio)
    ratio, a, b = ratio[order], a[order], b[order]
    # elements of x alone have ratio 0, those of y alone an infinite one
    low = only_x + np.cumsum(a)
    high = only_y + b.sum() - np.cumsum(b)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    return float((a / (low[last] + high[last] / ratio)).sum())


def _sign(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            at = 0
            for _, part in blocks(batch.column("text").cast(pa.large_string()), 2 << 20):
                hashes, counts = word_hashes(part)
                ends = np.cumsum(counts)
                sets = [weighted(hashes[e - n : e]) for e, n in zip(ends, counts)]
                sizes = np.array([len(u) for u, _ in sets])
                sig = signatures(np.concatenate([np.empty(0, np.uint64), *(u for u, _ in sets)]), np.concatenate([np.empty(0, np.int64), *(c for _, c in sets)]), sizes, bands * rows)
                keys = band_keys(sig, bands, rows)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].ravel()))
                piece = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("digest"), lists], names=["doc_id", "digest", "keys"])

    return run


SETS = "node long, elements binary, weights binary"


def _sets(batches):
    """Distinct shingles of each text in ascending order, and their numbers: empty where all are 1."""
    for batch in batches:
        at = 0
        for _, part in blocks(batch.column("text").cast(pa.large_string()), 2 << 20):
            hashes, counts = word_hashes(part)
            found = [weighted(hashes[e - n : e]) for e, n in zip(np.cumsum(counts), counts)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(part)), pa.array([u.tobytes() for u, _ in found], pa.binary()), pa.array([c.astype(np.int64).tobytes() if (c > 1).any() else b"" for _, c in found], pa.binary())], names=["node", "elements", "weights"])
            at += len(part)


def _set(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(elements, np.uint64)
    return found, np.frombuffer(weights, np.int64) if weights else np.ones(len(found), np.int64)


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("elements_a", "weights_a", "elements_b", "weights_b")]
            good = pa.array([probability_jaccard(_set(xe.as_py(), xw.as_py()), _set(ye.as_py(), yw.as_py())) >= similarity for xe, xw, ye, yw in zip(*columns)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("elements").alias(f"elements_{s}"), F.col("weights").alias(f"weights_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "elements_a", "weights_a", "elements_b", "weights_b")
    return both.mapInArrow(_verify(similarity), "a long, b long")


class Block:
    """Some texts, with an index from shingles to those that have them."""

    def __init__(self, labels: list[int], sets: list[tuple[np.ndarray, np.ndarray]], similarity: float):
        self.labels, self.sets, self.similarity = np.array(labels, dtype=np.int64), sets, similarity
        owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
        elements, weights = (np.concatenate(x) for x in zip(*sets))
        order = np.argsort(elements, kind="stable")
        self.elements, self.owner, self.weights = elements[order], owner[order], weights[order].astype(np.float64)
        self.totals = np.bincount(owner, weights=weights, minlength=len(sets))
        self.merged: dict[int, int] = {}

    def top(self, label: int) -> int:
        while (up := self.merged.get(label, label)) != label:
            label = up
        return label

    def bounds(self, one: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """No similarity with ``one`` is above its bound; where all weights are 1 that is the similarity, under the threshold it may be 0."""
        e, w = one
        low, high = np.searchsorted(self.elements, e, side="left"), np.searchsorted(self.elements, e, side="right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        of, x, y, many = self.owner[at], np.repeat(w, n).astype(np.float64), self.weights[at], len(self.sets)
        shared_x, shared_y, total = np.bincount(of, weights=x, minlength=many), np.bincount(of, weights=y, minlength=many), float(w.sum())
        may = (shared_x >= (self.similarity - 1e-9) * total) & (shared_y >= (self.similarity - 1e-9) * self.totals)
        keep = may[of]
        of, x, y = of[keep], x[keep], y[keep]
        # the sum over j of max(x_j / x_i, y_j / y_i), with one side alone for what both have
        least = np.maximum(total / x + (self.totals - shared_y)[of] / y, self.totals[of] / y + (total - shared_x)[of] / x)
        return np.bincount(of, weights=1 / least, minlength=many)

    def links(self, label: int, one: tuple[np.ndarray, np.ndarray]):
        """Labels that a text of ``label`` connects to, those connected here already left out."""
        bound = self.bounds(one)
        near = np.flatnonzero(bound >= self.similarity - 1e-9)
        for k in near[np.argsort(-bound[near], kind="stable")].tolist():
            a, b = self.top(label), self.top(int(self.labels[k]))
            if a != b and probability_jaccard(one, self.sets[k]) >= self.similarity:
                self.merged[max(a, b)] = min(a, b)
                yield label, int(self.labels[k])


def _blocks(similarity: float):
    """Rows in order of part and outer: the texts of a block first, then those that are compared with it."""

    def run(batches):
        at, held, block, found = None, [], None, set()
        for batch in batches:
            for part, outer, label, elements, weights in zip(*(batch.column(c).to_pylist() for c in ("part", "outer", "label", "elements", "weights"))):
                if part != at:
                    at, held, block = part, [], None
                if not outer:
                    held.append((label, _set(elements, weights)))
                elif held:
                    block = block or Block([x for x, _ in held], [x for _, x in held], similarity)
                    found.update(block.links(label, _set(elements, weights)))
            if len(found) > 10_000:
                yield _pairs(found)
                found = set()
        if found:
            yield _pairs(found)

    return run


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _counted(batches):
    """How many texts have the shingles of each counter."""
    n = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for elements in batch.column("elements"):
            np.add.at(n, (np.frombuffer(elements.as_py(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["counter", "n"])


def prefix(one: tuple[np.ndarray, np.ndarray], counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a text whose weight is over what a similar text may lack: the first that the two share is among them."""
    e, w = one
    order = np.lexsort((e, counts[(e % np.uint64(len(counts))).astype(np.int64)]))
    total = np.cumsum(w[order])
    return e[order[: 1 + int(np.searchsorted(total, (1 - similarity + 1e-9) * total[-1], side="right"))]] if len(e) else e


def _prefixes(counts: np.ndarray, similarity: float):
    """A row for each shingle of a text's prefix, those that no other text has left out; its commonest one is its home."""

    def run(batches):
        for batch in batches:
            found = [prefix(_set(e.as_py(), w.as_py()), counts, similarity) for e, w in zip(batch.column("elements"), batch.column("weights"))]
            found = [x[counts[(x % np.uint64(COUNTERS)).astype(np.int64)] > 1] for x in found]
            lengths = np.array([len(x) for x in found], dtype=np.int64)
            at = pa.array(np.repeat(np.arange(len(found)), lengths))
            elements = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            home = np.zeros(len(elements), dtype=bool)
            home[(np.cumsum(lengths) - 1)[lengths > 0]] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("node", "size", "label")), pa.array(elements), pa.array(home)], names=["node", "size", "label", "element", "home"])

    return run


def meetings(rare: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    """``node, part``: the block of each text that has rows of ``_prefixes``, and the blocks that it is sent to."""
    homes = rare.filter("home").select("node", F.col("element").alias("home")).repartitionByRange("home", "node").sortWithinPartitions("home", "node")
    place = F.monotonically_increasing_id()
    ranged = t.write(homes.select("node", F.shiftrightunsigned(place, 33).alias("task"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranged")
    # one row for each task
    before = ranged.groupBy("task").agg(F.count("*").alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    parts = t.write(ranged.join(F.broadcast(before), "task").select("node", F.floor((F.col("base") + F.col("at")) / F.lit(BLOCK)).alias("part")), "parts")
    # the larger component first
    place = F.struct(-F.col("size"), "label")
    placed = rare.join(parts, "node")
    blocks_ = placed.groupBy("element", "part").agg(F.min(place).alias("first"))
    return parts, t.write(rare.join(blocks_, "element").filter(F.col("first") < place).select("node", "part").distinct(), "met")


def between(nodes: DataFrame, sets: DataFrame, similarity: float, t: Tables) -> DataFrame:
    """``a, b``: links between the labels of ``nodes`` (``node, label``) that connect all that are similar."""
    nodes = t.write(nodes, "crowded")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("size"))
    texts = t.write(nodes.join(sizes, "label").join(sets, "node").select("node", "size", "label", "elements", "weights"), "texts")
    counts = np.zeros(COUNTERS, dtype=np.int32)
    found = texts.select("elements").mapInArrow(_counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()  # at most COUNTERS rows
    counts[np.asarray(found["counter"])] = np.minimum(np.asarray(found["n"]), 1 << 30)
    rare = t.write(texts.mapInArrow(_prefixes(counts, similarity), "node long, size long, label long, element long, home boolean"), "prefixes")
    parts, met = meetings(rare, t)
    outer = met.join(texts, "node").select("part", F.lit(True).alias("outer"), "label", "elements", "weights")
    # a block that nothing is sent to is not read
    inner = texts.join(parts.join(met.select("part").distinct(), "part", "left_semi"), "node").select("part", F.lit(False).alias("outer"), "label", "elements", "weights")
    ordered = inner.unionAll(outer).repartition("part").sortWithinPartitions("part", "outer")
    links = t.write(ordered.mapInArrow(_blocks(similarity), "a long, b long").distinct(), "label-links")
    t.drop("crowded", "texts", "prefixes", "ranged", "parts", "met")
    return links


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """``node, label``: the smallest node that each node of the links is connected to."""
    t = tables or Tables(links.sparkSession)
    both = t.write(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = t.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "jump")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        least = t.write(least, "least")
        # a label's own label: halves the way each time
        jump = least.join(least.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("node", F.least("next", "far").alias("label"), "was")
        jump = t.write(jump, "jump")
        if jump.filter("label <> was").isEmpty():
            t.drop("both", "least")
            return jump.select("node", "label")
        labels = jump.select("node", "label")


def _decided(docs: DataFrame, similarity: float, bands: int, rows: int) -> tuple[DataFrame, bool, Tables]:
    """``doc_id, digest, class_id, class_size, kept`` for each row; whether rows repeat an id and its text; the tables that stay."""
    t = Tables(docs.sparkSession)
    signed = t.write(docs.select("doc_id", "digest", "text").mapInArrow(_sign(bands, rows), "doc_id long, digest binary, keys array<long>"), "signed")
    repeats = not signed.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty()

    # a node for each different text
    equal = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    nodes = t.write(equal.withColumn("node", F.monotonically_increasing_id()), "nodes")
    places = nodes.select("node", F.explode("keys").alias("key"))
    crowd = t.write(places.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("n > 1"), "crowd")
    members = t.write(places.join(crowd, "key").select("key", "node", "n", "low", "high"), "members")
    t.drop("crowd")
    wanted = members.select("node").distinct()
    rows_of = t.write(nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("n_id"), F.col("digest").alias("n_digest")), "wanted")
    # by a shuffle at every size: what is wanted grows with the texts
    texts = docs.join(rows_of.hint("merge"), docs["doc_id"].eqNullSafe(F.col("n_id")) & (docs["digest"] == F.col("n_digest"))).select("node", "text")
    # rows that repeat an id and its text would be there twice
    sets = t.write(texts.mapInArrow(_sets, SETS).dropDuplicates(["node"]) if repeats else texts.mapInArrow(_sets, SETS), "sets")
    t.drop("wanted")

    few = members.filter(F.col("n") <= FEW).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    few = few.select("nodes", F.posexplode("nodes").alias("p", "a")).select("a", F.explode(F.expr("slice(nodes, p + 2, size(nodes))")).alias("b"))
    many = members.filter(F.col("n") > FEW)
    central = members.groupBy("node").agg(F.sum("n").alias("c"))
    hubs = t.write(many.select("key", "node").join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node"))["node"].alias("hub")), "hubs")
    pivots = many.join(hubs, "key").select("node", F.explode(F.array_distinct(F.array("hub", "low", "high"))).alias("pivot")).filter("node <> pivot")
    pairs = t.write(few.unionAll(pivots.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))).distinct(), "pairs")
    labels = components(t.write(verified(pairs, sets, similarity), "links"), t)
    t.drop("hubs", "pairs", "links")
    labels = t.write(labels, "labels")

    # bands of many texts that fall into several components
    placed = t.write(many.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "placed")
    t.drop("members")
    split = t.write(placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key"), "split")
    if not split.isEmpty():
        found = between(placed.join(split, "key", "left_semi").select("node", "label").distinct(), sets, similarity, t)
        joined = t.write(components(found, t).select(F.col("node").alias("label"), F.col("label").alias("final")), "joined")
        t.drop("label-links")
        # a text that nothing linked before is its own label
        alone = joined.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("final").alias("label"))
        labels = labels.join(joined, "label", "left").select("node", F.coalesce("final", "label").alias("label")).unionAll(alone)
        labels = t.write(labels, "labels")
        t.drop("joined")
    t.drop("placed", "split", "jump", "sets")

    classes = nodes.join(labels, "node", "left").select("digest", "doc_id", "n", F.coalesce("label", "node").alias("label"))
    classes = t.write(classes, "classes")
    t.drop("nodes", "labels")
    heads = t.write(classes.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("head")), "heads")
    decided = t.write(classes.join(heads, "label").select("digest", F.col("doc_id").alias("first_id"), "class_id", "class_size", (F.col("digest") == F.col("head.digest")).alias("leads")), "decided")
    t.drop("classes", "heads")
    kept = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return signed.select("doc_id", "digest").join(decided, "digest").select("doc_id", "digest", "class_id", "class_size", kept.alias("kept")), repeats, t


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), whole_row(docs))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, class_id, class_size, kept``, one row for each row of ``docs``."""
    decided, _, _ = _decided(_digested(docs).drop("row"), similarity, bands, rows)
    return decided.drop("digest")


def kept_rows(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class its smallest doc_id.

    A row is known by its id and text; rows that repeat both are folded to one.
    """
    keyed = _digested(docs)
    decided, repeats, t = _decided(keyed.drop("row"), similarity, BANDS, ROWS)
    stay = t.write(decided.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest")), "kept")
    t.drop("signed", "decided")
    # by a shuffle at every size: what stays grows with the texts
    found = keyed.select("row", "doc_id", "digest").join(stay.hint("merge"), keyed["doc_id"].eqNullSafe(F.col("k_id")) & (keyed["digest"] == F.col("k_digest")), "left_semi")
    return (found.dropDuplicates(["doc_id", "digest"]) if repeats else found).select("row.*")
