"""Whole-text tokenization with a bounded cache of words, exact for the public byte-level and word BPE files.

A BPE tokenizer of these kinds splits a text into words and encodes each alone, and no word of it goes over a blank
or a line feed (but for one blank before a word, which the byte-level kind takes into the word). So texts are cut at
blanks and line feeds by Arrow's kernels, some megabytes at a time, and the distinct pieces are split into words with
the tokenizer's own pattern. Known words are looked up in a cache, new ones go through the tokenizers library, and the
ids of all pieces are gathered with numpy. No loop goes over all pieces, only over the distinct ones.

That holds for pieces of printable ASCII and Latin letters, whose classes, case and composition are the same in
every Unicode version; a text with any other character, a tab say, goes through the library whole. Runs of blanks and
line feeds between words are words of their own, cut as the byte-level pattern does (the last character of a run
stands apart before a word: a blank belongs to the word, a line feed is alone).

Strings of added tokens, such as <|endoftext|>: the plain call of the library makes them one id, even when no special
tokens are asked for (added="ids"; texts that hold one go through the library whole). added="text" has them
encoded as ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split patterns of the two kinds of vocabulary file, for pieces without characters of _ODD.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ {_L}{_N}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ {_L}{_N}]+"
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which can begin a word
_ODD = re.compile(r"[^\n\x21-\x7e¡-įı-ɏ]")

#: Words (and their characters) that one worker remembers; beyond either it forgets those that one block of texts alone had.
CACHE_WORDS, CACHE_CHARS = 700_000, 12 << 20
#: Bytes of text that are best handled at once.
BLOCK_BYTES = 8 << 20
_LOADED: dict[tuple, Encoder] = {}


class Encoder:
    """Encodes texts to ids. kind: "byte" or "word"; added: "text" or "ids", see above."""

    def __init__(self, path: str, kind: str, added: str = "text", words: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if kind not in ("byte", "word") or added not in ("text", "ids"):
            raise ValueError(f"unknown kind {kind!r} or treatment of added tokens {added!r}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added == "text"
        with open(path, encoding="utf-8") as f:
            strings = [t["content"] for t in json.load(f).get("added_tokens", ()) if added == "ids" or not t["special"]]
        self.added, self.most = "|".join(map(re.escape, strings)), words
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.blanks = kind == "byte"  # whether blanks and line feeds have ids
        # The same model for words that are split already, a line feed or blank between them, and asked for once.
        self.model = Tokenizer(self.tokenizer.model)
        parted = pre_tokenizers.Split("\n", "isolated") if self.blanks else pre_tokenizers.Split(" ", "removed")
        self.model.pre_tokenizer = pre_tokenizers.Sequence([parted, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if hasattr(self.model.model, "_resize_cache"):
            self.model.model._resize_cache(0)
        self.stop = np.zeros(self.size, dtype=bool)
        ends = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.blanks else [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.stop[ends] = True
        self.split = re.compile(BYTE_PATTERN if self.blanks else WORD_PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat, self.used = np.empty(1 << 16, dtype=np.int32), 0  # ids of known words, one after the other
        self.start, self.count = np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 14, dtype=np.int32)
        self.blocks = np.zeros(1 << 14, dtype=np.int32)  # how many blocks of texts had a word

    def _forget(self) -> None:
        """Keep the words that several blocks of texts had; all go if these are too many."""
        n = len(self.known)
        kept = np.flatnonzero(self.blocks[:n] > 1)
        words, sizes = list(self.known), self.count[kept].copy()
        ids = _gathered(self.flat, self.start[kept], sizes)
        words = [words[k] for k in kept.tolist()]
        self._reset()
        if 2 * len(words) <= self.most and 2 * sum(map(len, words)) <= CACHE_CHARS:
            self.known = {w: k for k, w in enumerate(words)}
            self._enter(ids, sizes, 0)
            self.blocks[: len(words)] = 1
            self.chars = sum(map(len, words))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). Words are sent in lines, as a call a word costs more than the word.

        Byte-level: the line feed after each word is one id, which no word has. Words: the last id of each, and no other, is a stop.
        """
        if self.blanks and any(map(str.isspace, words)):
            return self._one_by_one(words)
        mark = "\n" if self.blanks else " "
        lines = [mark.join(words[k : k + 128]) + mark for k in range(0, len(words), 128)]
        ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in self.model.encode_batch_fast(lines, add_special_tokens=False)])
        stops = np.flatnonzero(self.stop[ids])
        if len(stops) != len(words):
            return self._one_by_one(words)
        sizes = np.diff(stops, prepend=-1)
        return (ids[~self.stop[ids]], sizes - 1) if self.blanks else (ids, sizes)

    def _learn(self, words: list[str], first: int) -> None:
        """The library's ids of new words, numbered from `first` on."""
        for at in range(0, len(words), 8192):
            self._enter(*self._by_library(words[at : at + 8192]), first + at)
        self.chars += sum(map(len, words))

    def _enter(self, ids: np.ndarray, sizes: np.ndarray, n: int) -> None:
        """Put words from number n on into the tables."""
        if n + len(sizes) > len(self.count):
            size = n + len(sizes) + (n + len(sizes)) // 2
            self.start, self.count = np.resize(self.start, size), np.resize(self.count, size)
            self.blocks = np.concatenate([self.blocks, np.zeros(size - len(self.blocks), dtype=np.int32)])
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, (self.used + len(ids)) * 3 // 2)
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[n : n + len(sizes)], self.start[n : n + len(sizes)] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, how many each piece has)."""
        known, before, new = self.known, len(self.known), []
        numbers = list(map(known.get, pieces))
        rest = [k for k, n in enumerate(numbers) if n is None]
        sizes = np.ones(len(pieces), dtype=np.int64)
        if not rest:
            return np.array(numbers, dtype=np.int64), sizes
        flat, counts, get, split, letters = [], [], known.get, self.split, str.isalpha
        put = flat.append
        for k in rest:
            piece = pieces[k]
            if letters(piece):
                if (n := get(piece)) is None:
                    known[piece] = n = before + len(new)
                    new.append(piece)
                put(n)
                counts.append(1)
                continue
            # A known word with signs behind it is these two words; a letter or digit before the signs keeps them apart.
            word = piece.rstrip(_SIGNS)
            if (n := get(word)) is not None and word[-1].isalnum() and (m := get(piece[len(word) :])) is not None:
                put(n)
                put(m)
                counts.append(2)
                continue
            words = (piece,) if piece.isspace() else split(piece)
            counts.append(len(words))
            for word in words:
                if (n := get(word)) is None:
                    known[word] = n = before + len(new)
                    new.append(word)
                put(n)
        if new:
            self._learn(new, before)
        sizes[rest] = counts
        alone = np.ones(len(pieces), dtype=bool)
        alone[rest] = False
        places = np.repeat(alone, sizes)
        found = np.zeros(len(places), dtype=np.int64)
        found[places] = np.array([n for n in numbers if n is not None], dtype=np.int64)
        found[~places] = flat
        return found, sizes

    def _table(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, where each piece's begin, how many it has)."""
        words, per = self._words(pieces)
        seen = np.zeros(len(self.known), dtype=bool)
        seen[words] = True
        self.blocks[: len(seen)] += seen
        sizes = self.count[words]
        ids = _gathered(self.flat, self.start[words], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ends = upto[np.cumsum(per)]
        starts = np.concatenate([np.zeros(1, dtype=np.int32), ends[:-1]])
        return ids, starts, ends - starts

    def _gaps(self, feed: np.ndarray, empty: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
        """(pieces with a blank before them, pieces without ids, own words by position) of texts cut at blanks and line feeds."""
        n, gap = len(feed), feed | empty
        first = np.zeros(n + 1, dtype=bool)
        first[bounds] = True  # a text's first piece, and the end
        blank = ~feed & ~first[:-1]
        blank[1:] &= ~feed[:-1]
        begins = np.flatnonzero(gap & (first[:-1] | ~np.concatenate([[False], gap[:-1]])))
        ends = np.flatnonzero(gap & (first[1:] | ~np.concatenate([gap[1:], [False]])))
        last = first[ends + 1]
        # A line feed between words is a word; so is nothing before a text's first word, whose blank goes with it.
        alone = (begins == ends) & ~last
        silent = gap.copy()
        silent[begins[alone & feed[begins]]] = False
        own: dict[int, str] = {}
        for i, j, final in zip(*(x[~alone | ~(feed[begins] | first[begins])].tolist() for x in (begins, ends, last)), strict=True):
            run = "".join((" " if blank[k] else "") + ("\n" if feed[k] else "") for k in range(i, j + 1))
            parts = (run,) if final or not feed[j] else (run[:-1], "\n")
            own |= {i + k: part for k, part in enumerate(p for p in parts if p)}
        return blank & ~gap, silent, own

    def encode_many(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, one after the other, and where each text's end; null is empty."""
        n = len(texts)
        if not n:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        if len(self.known) > self.most or self.chars > CACHE_CHARS:
            self._forget()
        texts = pc.fill_null(texts, "")
        apart = pc.split_pattern(pc.replace_substring(texts, "\n", " \n " if self.blanks else " "), " ")
        bounds = apart.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        distinct = apart.flatten().dictionary_encode()
        at, pieces = distinct.indices.to_numpy(), distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        strange = np.zeros(n, dtype=bool)
        if _ODD.search("".join(pieces)):
            odd = np.array([_ODD.search(p) is not None for p in pieces], dtype=bool)
            strange |= np.add.reduceat(odd[at], bounds[:-1]).astype(bool)
        if self.added:
            strange |= pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False)
        empty = (pc.binary_length(distinct.dictionary).to_numpy() == 0)[at]
        if self.blanks:
            feed = np.array([p == "\n" for p in pieces], dtype=bool)[at]
            blank, silent, own = self._gaps(feed, empty, bounds)
            at = np.where(blank, at + np.int32(len(pieces)), at)  # from len(pieces) on: with a blank, from twice that on: own words
            runs = {word: 2 * len(pieces) + k for k, word in enumerate(dict.fromkeys(own.values()))}
            for k, word in own.items():
                at[k], silent[k] = runs[word], False
            total, extra = 2 * len(pieces) + len(runs), list(runs)
        else:
            silent, total, extra = empty, len(pieces), []
        silent |= np.repeat(strange, np.diff(bounds))
        kept = at[~silent]
        used = np.flatnonzero(np.bincount(kept, minlength=total))
        place = np.zeros(total, dtype=np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        if self.blanks:
            one, two = (int(x) for x in np.searchsorted(used, [len(pieces), 2 * len(pieces)]))
            strings = [pieces[k] for k in used[:one].tolist()] + [" " + pieces[k] for k in (used[one:two] - len(pieces)).tolist()] + [extra[k] for k in (used[two:] - 2 * len(pieces)).tolist()]
        else:
            strings = [pieces[k].lower() for k in used.tolist()]
        table, starts, sizes = self._table(strings)
        kept = place[kept]
        ids = _gathered(table, starts[kept], sizes[kept])
        upto = np.zeros(len(at) + 1, dtype=np.int64)
        upto[1:][~silent] = sizes[kept]
        ends = np.cumsum(upto)[bounds[1:]]
        if strange.any():
            parts, grown, before = [], [], 0
            for k, (own_way, end) in enumerate(zip(strange.tolist(), ends.tolist(), strict=True)):
                parts.append(self.whole(texts[k].as_py()) if own_way else ids[before:end])
                before = end
                grown.append(len(parts[-1]))
            ids, ends = np.concatenate(parts), np.cumsum(grown)
        return ids, ends

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        return self.encode_many(pa.array([text], type=pa.string()))[0]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat's stretches of given starts and sizes, one after the other."""
    total = int(sizes.sum(dtype=np.int64))
    if total >= 1 << 31:
        raise ValueError("more than 2^31 ids at once")
    stops = np.cumsum(sizes, dtype=np.int32)
    at = np.repeat(starts - (stops - sizes), sizes)
    at += np.arange(total, dtype=np.int32)
    return flat[at]


def id_type(size: int) -> np.dtype:
    """The unsigned type that ids under `size` are kept in."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int, kind: np.dtype) -> list[np.ndarray]:
    """The ids of each text (of encode_many()) with the end id after them, as views of one array."""
    whole = np.insert(ids.astype(kind), ends, end_id)
    stops = (ends + np.arange(1, len(ends) + 1)).tolist()
    return [whole[b:e] for b, e in zip([0, *stops], stops, strict=False)]


def encoder(path: str, kind: str, added: str = "text", words: int = CACHE_WORDS) -> Encoder:
    """One encoder a worker process and file, so that its cache outlives a task."""
    key = (path, kind, added, words)
    if key not in _LOADED:
        _LOADED.clear()  # a worker that comes to another file gives up the memory of the last one
        _LOADED[key] = Encoder(*key)
    return _LOADED[key]


def vocabulary(name: str) -> str:
    """Default place of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
