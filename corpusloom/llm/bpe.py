"""Whole-text encoding with the `tokenizers` library, one call per distinct word.

The byte-level BPE vocabulary cuts a text into pre-tokens that never reach over the
place before a space which follows a character that is not white space.  Texts are
therefore cut there, the pre-tokens of every distinct piece of a batch go once through
the library's merge model, and the ids of a text are those of its pieces in order.  Texts where that argument does
not hold (white space before a space, a special token's string) are encoded whole, so
the ids equal those of ``encode(text, add_special_tokens=False)`` in every case.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that are encoded at once.
BLOCK_BYTES = 8 << 20
#: Pieces kept in a worker's cache; it begins anew beyond that.
CACHE_PIECES = 400_000
#: White space of any alphabet, as RE2 writes it.
WHITE = r"\s\p{Z}\x{85}\x{1c}-\x{1f}\x{180e}"
#: How byte-level BPE cuts a text into pre-tokens (the published pattern).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE's printable stand-in for each byte: itself if printable, else the next code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
BYTE_CHARS_OF_SPACE = chr(BYTE_CHARS[32])


def plain(config: dict) -> bool:
    """Whether pre-tokens can be given to the library's merge model one by one."""
    pre, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    return (
        config.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not model.get("ignore_merges")
    )


def blocks(array: pa.Array, most: int = BLOCK_BYTES):
    """(first row, slice) of at most ``most`` bytes each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, array.slice(at, to - at)
        at = to


class Encoder:
    """Encodes Arrow string arrays into one flat id array and row offsets."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.direct = plain(json.loads(self.tokenizer.to_str()))
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.ints = list(range(self.tokenizer.get_vocab_size()))  # one object for each id, however many pieces have it
        self.known = {lead: (pa.array([], pa.large_string()), EMPTY) for lead in (" ", "")}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _fresh(self, words: pa.Array, lead: str) -> pa.LargeListArray:
        """Ids of each piece, pre-token by pre-token."""
        out: list[int] = []
        sizes = np.zeros(len(words), dtype=np.int64)
        known, ints, merge, cut = self.tokens, self.ints, self.tokenizer.model.tokenize if self.direct else None, PRETOKEN.findall
        space = lead and BYTE_CHARS_OF_SPACE
        if len(known) > CACHE_PIECES:
            known.clear()
        for i, w in enumerate(words.to_pylist()):
            had = len(out)
            if merge is None:
                out += self.whole(lead + w)
            elif w.isalpha() and w.isascii():
                out += [t.id for t in merge(space + w)]
            elif w.isalpha():
                out += [t.id for t in merge((lead + w).encode().decode("latin-1").translate(BYTE_CHARS))]
            else:
                for p in cut(lead + w):
                    ids = known.get(p)
                    if ids is None:
                        ids = known[p] = tuple([ints[t.id] for t in merge(p.encode().decode("latin-1").translate(BYTE_CHARS))])
                    out += ids
            sizes[i] = len(out) - had
        return lists(np.array(out, dtype=np.int32), sizes)

    def _pieces(self, words: pa.Array, lead: str, often: np.ndarray) -> pa.LargeListArray:
        """Ids of distinct pieces, from the cache as far as it has them; those seen ``often`` are kept."""
        held, ids = self.known[lead]
        at = pc.index_in(words, value_set=held)
        new = np.asarray(pc.is_null(at))
        place = np.asarray(pc.fill_null(at, 0), dtype=np.int64)
        fresh = words.filter(pa.array(new))
        coded = self._fresh(fresh, lead)
        place = np.where(new, len(held) + np.cumsum(new) - 1, place)
        out = pa.concat_arrays([ids, coded]).take(pa.array(place))
        keep = pa.array(often[new])
        if len(held) > CACHE_PIECES:
            held, ids = held[:0], EMPTY
        self.known[lead] = pa.concat_arrays([held, fresh.filter(keep)]), pa.concat_arrays([ids, coded.filter(keep)])
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids int32, offsets int64 with one more entry than rows); null is empty; ``end`` closes each row."""
        flat, lengths = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
        for _, part in blocks(texts):
            ids, sizes = self._block(pc.fill_null(part, ""), end)
            flat.append(ids)
            lengths.append(sizes)
        return np.concatenate(flat), np.cumsum(np.concatenate(lengths))

    def _block(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        odd = np.zeros(n, dtype=bool)
        for s in self.special:
            odd |= np.asarray(pc.match_substring(texts, s))
        split = pc.split_pattern(texts, " ")
        offsets = np.asarray(split.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        heads = offsets[:-1]  # split_pattern gives one piece for an empty text
        coded = split.flatten().dictionary_encode()
        words, which = coded.dictionary, np.array(coded.indices, dtype=np.int64)
        blank = (np.asarray(pc.binary_length(words)) == 0) | np.asarray(pc.match_substring_regex(words, rf"[{WHITE}]$"))
        if blank.any():  # white space before a space
            hit = blank[which]
            hit[offsets[1:] - 1] = False
            odd |= np.add.reduceat(hit, heads) > 0
        first, back = np.unique(which[heads], return_inverse=True)
        often = np.bincount(which, minlength=len(words)) > 1
        openings = self._pieces(words.take(pa.array(first)), "", often[first])
        pool = [self._pieces(words, " ", often), openings]
        which[heads] = len(words) + back
        if odd.any():
            rows = np.flatnonzero(odd)
            wholes = [self.whole(texts[int(i)].as_py()) for i in rows]
            base = len(words) + len(openings)
            which[np.repeat(odd, np.diff(offsets))] = base  # an empty piece
            which[heads[rows]] = base + 1 + np.arange(len(rows))
            pool.append(lists(np.array([x for w in wholes for x in w], dtype=np.int32), np.array([0, *map(len, wholes)])))
        taken = pa.concat_arrays(pool).take(pa.array(which))
        places = np.asarray(taken.offsets, dtype=np.int64)
        ids = np.asarray(taken.flatten())
        ends = places[offsets[1:]] - places[0]
        sizes = np.diff(ends, prepend=0)
        if end is not None:
            ids, sizes = np.insert(ids, ends, end), sizes + 1
        return ids, sizes


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.array(values, pa.int32()))


EMPTY = lists(np.empty(0, np.int32), np.empty(0, np.int64))
