"""Operator 9: hierarchical packing of documents into windows of several lengths.

Tiers are windows of a power of two tokens (1024, 512, 256, 128, 64).  Each task encodes
its documents and packs them in blocks of bounded size:

1. a document's whole windows of the longest tier are sequences by themselves; what
   remains is routed to the shortest tier that holds it;
2. from the longest tier on, the pieces of a tier are packed by best fit, longest first,
   into windows of its length;
3. the gaps of these windows are filled from the shorter tiers, each time with the longest
   piece that fits; where only longer ones are left, one is cut, and what remains of it
   is routed anew; where nothing shorter is left, the emptiest window of the tier gives
   its pieces;
4. a window that stays open gives its pieces to the tiers below.  Every window is full, as
   one that is not would be padded to the longest; less than the shortest tier goes on to
   the task's next block, and is padded only at its end;
5. sequences of a tier are dealt to step groups in a snake by documents they hold, so
   that groups of a tier have equal token counts (but for one sequence) and like numbers
   of pieces.

No shuffle: a sequence's id is the task's number and a counter.  A rerun over the same
input splits gives the same ids.

Cases: a null text is an empty one (its end id is still packed); ids that repeat or are
null are packed row by row; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_output import encoder

TIERS = (1024, 512, 256, 128, 64)
#: Sequences of one step group.
STEP_SEQUENCES = 32
#: Tokens packed at once.
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


Piece = tuple[int, int, int]  # an item, and where in it the piece begins and ends


def pack_remainders(sizes: np.ndarray, tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Packs pieces shorter than the longest tier; (the pieces of each sequence, pieces left over).

    Every sequence is full to a tier's length; the left-over pieces are shorter together than the shortest tier.
    """
    pool = sorted((int(n), -i, 0) for i, n in enumerate(sizes) if n)  # (size, item, begin) in order of size
    full: list[list[Piece]] = []
    for tier, shorter in zip(tiers, (*tiers[1:], 0)):
        _pack_tier(pool, tier, shorter, full)
    return full, [(-i, b, b + n) for n, i, b in pool]


def _pack_tier(pool: list[tuple[int, int, int]], tier: int, shorter: int, full: list[list[Piece]]) -> None:
    """Moves full windows of one tier from the pool; pieces of up to ``shorter`` words only fill gaps."""
    at = bisect.bisect_right(pool, (shorter, 1, 0))
    own, pool[at:] = pool[at:], []
    windows: list[tuple[int, int, list]] = []  # (gap, number, pieces), in order
    for k, (n, i, b) in enumerate(reversed(own)):
        for _ in range(n // tier):
            full.append([(-i, b, b + tier)])
            n, b = n - tier, b + tier
        if not n:
            continue
        if n <= shorter:  # what remains of a piece longer than the tier
            bisect.insort(pool, (n, i, b))
            continue
        fit = bisect.bisect_left(windows, (n, -1, []))
        gap, number, pieces = windows.pop(fit) if fit < len(windows) else (tier, k, [])
        pieces.append((n, i, b))
        if gap == n:
            full.append(_placed(pieces))
        else:
            bisect.insort(windows, (gap - n, number, pieces))
    begun = 0
    while begun < len(windows):
        gap, _, pieces = windows[begun]
        begun += 1
        while gap:
            if not pool:
                if begun == len(windows):
                    break
                pool.extend(sorted(windows.pop()[2]))
            at = bisect.bisect_left(pool, (gap + 1, -(1 << 62), 0)) - 1
            n, i, b = pool.pop(max(at, 0))
            if n > gap:
                bisect.insort(pool, (n - gap, i, b + gap))
                n = gap
            pieces.append((n, i, b))
            gap -= n
        if gap:
            for piece in pieces:
                bisect.insort(pool, piece)
        else:
            full.append(_placed(pieces))


def _placed(pieces: list[tuple[int, int, int]]) -> list[Piece]:
    return [(-i, b, b + n) for n, i, b in pieces]


class Packer:
    """Packs one task's documents; what a block leaves over joins the next block."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step: int = STEP_SEQUENCES):
        self.task, self.tiers, self.step = task, tiers, step
        self.count = 0
        self.groups = 0
        self.left: list[tuple] = []  # (doc_id, start in its document, ids, tokens of its document)

    def pack(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray, last: bool = False) -> pa.RecordBatch:
        top = self.tiers[0]
        items = [(d, s, x, n) for d, s, x, n in self.left]
        rows: list[list[tuple]] = []
        for d, a, b in zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist()):
            n = b - a
            rows += [[(d, k, ids[a + k : a + k + top], n)] for k in range(0, n - n % top, top)]
            if n % top:
                items.append((d, n - n % top, ids[b - n % top : b], n))
        full, rest = pack_remainders(np.array([len(x[2]) for x in items], dtype=np.int64), self.tiers)
        cut = lambda pieces: [(items[i][0], items[i][1] + b, items[i][2][b:e], items[i][3]) for i, b, e in pieces]
        rows += map(cut, full)
        self.left = [(d, s, x.copy(), n) for d, s, x, n in cut(rest)]
        if last and self.left:
            rows.append(self.left)
            self.left = []
        return self._batch(rows)

    def _batch(self, rows: list[list[tuple]]) -> pa.RecordBatch:
        group: dict[int, int] = {}
        lengths = [sum(len(p[2]) for p in row) for row in rows]
        for t in {*lengths}:
            own = sorted((k for k, n in enumerate(lengths) if n == t), key=lambda k: (-len(rows[k]), k))
            groups = -(-len(own) // self.step)
            for place, k in enumerate(own):
                lap, x = divmod(place, groups)
                group[k] = self.groups + (x if lap % 2 == 0 else groups - 1 - x)
            self.groups += groups
        out: list[list] = [[] for _ in range(9)]
        for k, row in enumerate(rows):
            at = 0
            for d, start, x, n in row:
                view = np.ascontiguousarray(x, dtype="<u4").tobytes()
                for col, v in zip(out, (d, start, len(x), zlib.crc32(view), n, self.task << 40 | self.count, at, lengths[k], self.task << 40 | group[k])):
                    col.append(v)
                at += len(x)
            self.count += 1
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _pack(tokenizer: str, end_id: int, tiers: tuple[int, ...], step: int):
    def run(batches):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), tiers, step)
        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids, offsets = encoder(tokenizer).encode(piece.column("text"), end_id)
                held.append((piece.column("doc_id").to_pylist(), ids, offsets))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield packer.pack(*_joined(held))
                    held, tokens = [], 0
        yield packer.pack(*_joined(held), last=True)
        held = []
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return run


def _joined(held: list[tuple]) -> tuple[list, np.ndarray, np.ndarray]:
    sizes = [np.diff(o) for _, _, o in held]
    ids = np.concatenate([np.empty(0, np.int32), *(i for _, i, _ in held)])
    return [d for ds, _, _ in held for d in ds], ids, np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *sizes]))]).astype(np.int64)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, step: int = STEP_SEQUENCES) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, end_id, tiers, step), SCHEMA)
