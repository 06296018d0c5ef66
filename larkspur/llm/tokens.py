"""Token ids of whole texts, by the tokenizers library.

Byte-level BPE splits a text into pre-tokens before it merges anything, and a single space is always
the first character of the pre-token that follows it. A text may hence be cut before every space that a
character other than white space follows, and the parts encoded on their own. Most parts are words that
come again and again: each worker encodes a word once and looks it up from then on.

The library takes the vocabulary's added tokens, such as a marker of a text's end, out of a text before anything
else. What stands before, between and after them is encoded as texts of their own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larkspur.llm.textkit import ranges, string_hashes, text_buffers

#: Bytes of text encoded at once; a longer text is encoded alone and whole.
CHUNK = 2 << 20
#: Words a worker remembers; when it has more, it forgets those that haven't come again since it last did so.
MEMORY = 600_000
#: Words that are encoded as one string, and strings that are given to the library at once, as its own results are large.
_JOINED, _AT_ONCE = 64, 64

#: A space that white space or the end follows: texts that have one are cut by the slower rule.
_ODD = r" ([\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
_CUT = re.compile(r" (?=\S)")


def tokenizer_path(name: str) -> str:
    """A vocabulary file by its public name, or any other path as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes Arrow string columns with one byte-level BPE vocabulary."""

    def __init__(self, name: str):
        # every core has a worker of its own; threads of the library's would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added):
            raise ValueError("this vocabulary has added tokens that take white space with them or depend on their neighbours")
        # the longest of those that begin at one place, as the library has it
        self.added = "|".join(re.escape(t) for t in sorted((t.content for t in added if t.content), key=len, reverse=True))
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.opens = np.zeros(self.size, dtype=bool)
        self.opens[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.first = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of the words, by hash
        self.again = np.zeros(0, np.int64)  # how often a chunk after the word's first had it

    def _forget_rare(self) -> None:
        keep = np.flatnonzero(self.again > 0)
        if len(keep) > MEMORY // 2:
            keep = np.sort(keep[np.argsort(-self.again[keep], kind="stable")[: MEMORY // 2]])
        counts, hashes = np.diff(self.first)[keep], np.empty(len(self.words), np.uint64)
        hashes[self.places] = self.hashes
        self.ids = self.ids[np.repeat(self.first[keep], counts) + ranges(counts)]
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.words, self.again = self.words.take(pa.array(keep)), np.zeros(len(keep), np.int64)
        self.places = np.argsort(hashes[keep])
        self.hashes = hashes[keep][self.places]

    def _known(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each word that is remembered, else -1; a word of the same hash is compared."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.where(self.hashes[at] == hashes, self.places[at], -1)
        met = np.flatnonzero(place >= 0)
        same = pc.equal(self.words.take(pa.array(place[met])), words.take(pa.array(met))).to_numpy(zero_copy_only=False)
        place[met[~same.astype(bool)]] = -1
        return place

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without spaces, each after a space, and the number of each word's."""
        joined = [" " + " ".join(words[k : k + _JOINED]) for k in range(0, len(words), _JOINED)]
        parts = [np.concatenate(self._alone(joined[k : k + _AT_ONCE])) for k in range(0, len(joined), _AT_ONCE)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):
            raise ValueError("this vocabulary isn't byte-level BPE with spaces at the front")
        return ids, np.diff(np.concatenate((starts, [len(ids)])))

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Adds words that aren't known; the places they get."""
        plain = pc.invert(pc.or_(pc.match_substring(words, " "), pc.equal(words, "")))
        easy, hard = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        ids, counts = self._together(easy.to_pylist())
        more = self._alone([" " + w for w in hard])
        self.words = pa.concat_arrays([self.words, easy, pa.array(hard, pa.large_string())])
        self.ids = np.concatenate([self.ids, ids, *more])
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.concatenate((counts, [len(m) for m in more])).astype(np.int64))))
        known, plain = len(self.words) - len(words), plain.to_numpy(zero_copy_only=False).astype(bool)
        places = np.empty(len(words), np.int64)
        places[plain], places[~plain] = known + np.arange(plain.sum()), known + plain.sum() + np.arange((~plain).sum())
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.places = np.insert(self.hashes, at, hashes[order]), np.insert(self.places, at, places[order])
        self.again = np.concatenate((self.again, np.zeros(len(words), np.int64)))
        return places

    def encode(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the last ends).

        end: an id that follows each text. Null counts as an empty text.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        ids, first = self._encode_parted(column)
        if end is None:
            return ids, first
        out = np.full(len(ids) + len(column), end, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(column)), np.diff(first))] = ids
        return out, first + np.arange(len(first))

    def _encode_parted(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() without an end: texts that hold added tokens are parted at these."""
        if not self.added:
            return self._encode_plain(column)
        marked = pc.match_substring_regex(column, self.added).to_numpy(zero_copy_only=False).astype(bool)
        if not marked.any():
            return self._encode_plain(column)
        split = re.compile(f"({self.added})")
        parts = [split.split(t) if m else [t] for t, m in zip(column.to_pylist(), marked)]
        ids, first = self._encode_plain(pa.array([p for some in parts for p in some], pa.large_string()))
        return ids, first[np.concatenate(([0], np.cumsum([len(some) for some in parts])))]

    def _encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() without an end, of texts that either are an added token or hold none."""
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False).astype(bool)
        parts = [pc.split_pattern(column.filter(pa.array(~odd)), " ")]
        if odd.any():
            parts.append(pa.array([_CUT.split(t) for t in column.filter(pa.array(odd)).to_pylist()], pa.large_list(pa.large_string())))
        flat = pa.concat_arrays([p.flatten().cast(pa.large_string()) for p in parts])
        sizes = np.concatenate([p.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for p in parts])
        begin = np.cumsum(sizes) - sizes
        head = np.zeros(len(flat), dtype=bool)
        head[begin] = True
        rest = flat.filter(pa.array(~head)).dictionary_encode()
        if len(self.words) > MEMORY:
            self._forget_rare()
        hashes = string_hashes(rest.dictionary)
        place = self._known(rest.dictionary, hashes)
        fresh = place < 0
        self.again[place[~fresh]] += 1
        if fresh.any():
            place[fresh] = self._learn(rest.dictionary.filter(pa.array(fresh)), hashes[fresh])
        # the texts' first parts, which no space precedes, are encoded as they are
        heads = self._alone(flat.take(pa.array(begin)).to_pylist())
        table = np.concatenate([self.ids, *heads])
        starts, counts = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        codes = place[rest.indices.to_numpy()]
        starts[~head], counts[~head] = self.first[codes], (self.first[1:] - self.first[:-1])[codes]
        counts[begin] = [len(h) for h in heads]
        starts[begin] = len(self.ids) + np.cumsum(counts[begin]) - counts[begin]
        if odd.any():  # the parts in the order of the texts
            order = np.argsort(np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd))), kind="stable")
            sizes, begin = sizes[order], begin[order]
            at = np.repeat(begin, sizes) + ranges(sizes)
            starts, counts = starts[at], counts[at]
        total = np.concatenate(([0], np.cumsum(counts)))
        first = total[np.concatenate(([0], np.cumsum(sizes)))]
        return table[np.repeat(starts - total[:-1], counts) + np.arange(total[-1])], first


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """This worker's encoder; it outlives the task."""
    return Encoder(name)


def encoded(batch: pa.RecordBatch, texts: int, name: str, end: int | None = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, first) of consecutive rows whose texts have about CHUNK bytes; texts: the column's number."""
    _, offsets = text_buffers(batch.column(texts))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        some = batch.slice(low, high - low)
        yield some, *encoder(name).encode(some.column(texts), end)
        low = high
    pa.default_memory_pool().release_unused()
