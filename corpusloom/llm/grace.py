"""Operator 6: exact deduplication by Grace hashing.

Every task first folds the equal texts of its own rows (an open-addressing table of
bounded size that compares complete contents), so that what is shuffled of a text that
fills a third of the corpus is one row for each task and not each copy.  Those rows are
written once, then dealt by the text's hash.  A receiving task keeps its rows in memory
if they fit; otherwise it deals them to spill files by further bits of the hash, and
those again, until each file's distinct texts fit one table.  The decision on each
folded row is joined back to the rows it stands for.

Texts are equal when identical after each run of ASCII white space became one space.

Cases: a null text is an empty one; of equal texts the smallest doc_id stays, null ids
come last, and of rows that repeat an id with the same text one stays; an empty table
gives no rows; other columns are not carried.
"""

from __future__ import annotations

import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, row_schema, whole_row, written

#: Bytes of distinct texts that a task folds or compares at once.
TABLE_BYTES = 48 << 20
#: Spill files that a bucket is dealt to.
FANOUT = 8
#: Bytes that a row of a table takes beside its text: its id and place.
MEMBER_BYTES = 150
FOLDED = "doc_id long, gid long, first boolean, hash long, rows long"
DECIDED = "gid long, keep_id long, group_size long, wins boolean, text_sha256 string"


class OpenTable:
    """Open addressing with linear probing: a text's number, by its hash and then its complete content."""

    def __init__(self, slots: int = 1 << 12):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.texts)

    def put(self, h: int, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                return int(k)
            at = (at + 1) & mask
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + 100
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return len(self.texts) - 1

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _fold(limit: int, carry: bool = False):
    """A row for each row; the first of each text in a table has the hash, how many rows it stands for, and its text or, with ``carry``, its own whole row.

    A table ends at ``limit`` bytes of texts, members and carried rows together.
    """

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        table, ids, carried, seen, size = OpenTable(), [], [], 0, 0

        def folded():
            nonlocal base, table, ids, carried, seen, size
            members = [(d, k, at) for k, own in enumerate(ids) for d, at in sorted(own, key=_null_last_first)]
            counts = [len(own) for own in ids]
            begins = np.cumsum(counts) - counts
            first = np.zeros(len(members), dtype=bool)
            first[begins] = True
            whole = pa.concat_arrays(carried) if carry else None
            for at in range(0, len(members), 2000):
                part = members[at : at + 2000]
                lead = first[at : at + 2000].tolist()
                columns = [
                    pa.array([d for d, _, _ in part], pa.int64()),
                    pa.array([base + k for _, k, _ in part], pa.int64()),
                    pa.array(lead),
                    pa.array([table.hashes[k] if f else None for (_, k, _), f in zip(part, lead)], pa.int64()),
                    pa.array([counts[k] if f else None for (_, k, _), f in zip(part, lead)], pa.int64()),
                ]
                if carry:
                    columns.append(whole.take(pa.array([x if f else None for (_, _, x), f in zip(part, lead)], pa.int64())))
                else:
                    columns.append(pa.array([table.texts[k] if f else None for (_, k, _), f in zip(part, lead)], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "gid", "first", "hash", "rows", "row" if carry else "text"])
            base += len(table)
            table, ids, carried, seen, size = OpenTable(), [], [], 0, 0

        for batch in batches:
            begun = 0
            row_bytes = batch.column(3).nbytes // max(1, batch.num_rows) if carry else 0
            for i, (d, h, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()), 1):
                k = table.put(h, t)
                if k == len(ids):
                    ids.append([])
                ids[k].append((d, seen))
                seen += 1
                size += MEMBER_BYTES + row_bytes
                if table.bytes + size > limit:
                    if carry:
                        carried.append(batch.column(3).slice(begun, i - begun))
                        begun = i
                    yield from folded()
            if carry and begun < batch.num_rows:
                carried.append(batch.column(3).slice(begun))
        if ids:
            yield from folded()

    return run


def _null_last_first(member) -> tuple:
    return _null_last(member[0])


def _null_last(d) -> tuple:
    return (d is None, d or 0)


def grace(rows, limit: int = TABLE_BYTES, fanout: int = FANOUT, depth: int = 0, folder: str | None = None):
    """(lists of rows that fit one table) from rows (hash, text, doc_id, gid, rows); every text's rows are in one list.

    Rows go to spill files once they are more than ``limit`` bytes, by the bits of the hash after those used so far.
    Copies of a text are held once.  At the last bits a list may be larger: then its texts share 60 bits of hash.
    """
    held, texts, size = [], {}, 0
    rows = iter(rows)
    for row in rows:
        if row[1] not in texts:
            texts[row[1]] = row[1]
            size += len(row[1])
        held.append((row[0], texts[row[1]], *row[2:]))
        size += MEMBER_BYTES
        if size > limit and depth < 20:
            break
    else:
        if held:
            yield held
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=folder) as top:
        files = [tempfile.TemporaryFile(dir=top) for _ in range(fanout)]
        for part in (held, rows):
            for row in part:
                pickle.dump(row, files[(row[0] >> (60 - 3 * depth)) % fanout], protocol=5)
        held = []
        for f in files:
            f.seek(0)
            yield from grace(_spilled(f), limit, fanout, depth + 1, top)
            f.close()


def _spilled(file):
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _decide(limit: int):
    def run(batches):
        import hashlib

        def rows():
            for batch in batches:
                yield from zip(batch.column("hash").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), batch.column("gid").to_pylist(), batch.column("rows").to_pylist())

        for bucket in grace(rows(), limit):
            table, best, sizes, of = OpenTable(), [], [], []
            for h, text, doc_id, gid, n in bucket:
                k = table.put(h, text)
                if k == len(best):
                    best.append((_null_last(doc_id), gid))
                    sizes.append(0)
                best[k] = min(best[k], (_null_last(doc_id), gid))
                sizes[k] += n
                of.append(k)
            digests = [hashlib.sha256(t).hexdigest() for t in table.texts]
            keep = [None if b[0][0] else b[0][1] for b in best]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[3] for r in bucket], pa.int64()),
                    pa.array([keep[k] for k in of], pa.int64()),
                    pa.array([sizes[k] for k in of], pa.int64()),
                    pa.array([best[k][1] == r[3] for k, r in zip(of, bucket)]),
                    pa.array([digests[k] for k in of], pa.string()),
                ],
                names=["gid", "keep_id", "group_size", "wins", "text_sha256"],
            )

    return run


def _normal(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def _decisions(docs: DataFrame, table_bytes: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _normal(docs["text"]).alias("text"), *[whole_row(docs)] * carry)
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text", *["row"] * carry)
    folded = written(rows.mapInArrow(_fold(table_bytes, carry), row_schema(rows, FOLDED) if carry else FOLDED + ", text string"), "folded")
    # a carried row has its text: a second copy would be as large as all else that is written
    text = _normal(F.col("row")["text"]) if carry else F.col("text")
    firsts = folded.filter("first").select("hash", text.alias("text"), "doc_id", "gid", "rows").repartition("hash")
    return folded, written(firsts.mapInArrow(_decide(table_bytes), DECIDED), "decided")


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs``."""
    folded, decided = _decisions(docs, table_bytes, False)
    joined = folded.select("doc_id", "gid", "first").join(decided, "gid")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("first") & F.col("wins")).alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each text."""
    folded, decided = _decisions(docs, table_bytes, True)
    return folded.filter("first").select("gid", "row").join(decided.filter("wins").select("gid"), "gid", "left_semi").select("row.*")
