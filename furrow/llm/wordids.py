"""Token ids of whole texts, word by word, through the tokenizers library.

A pre-tokeniser that never matches across white space makes the ids of a text
the concatenation of the ids of its words. So each slice of texts is cut into
words, every distinct word is encoded by the library once, and the ids of the
texts are gathered from those. Words met twice in a slice stay in a memo for the
worker's later slices and tasks.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from furrow.llm.common import per_process, raw_bytes, shared_file, strings_of

#: Words and their bytes kept in a worker's memo before it starts afresh.
MEMO_WORDS, MEMO_BYTES = 150_000, 4 << 20
#: Words that the library gets in one string.
JOINED = 100

# The steps of a tokenizer file that lets texts be cut into words.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_WHITE = _table(b" \n\t\r")
_ASCII = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: None of these marks composes with what follows it, none becomes two
#: characters in lower case, and only an apostrophe joins the letters behind it.
_MARK = _table(b".,;:!?%#$&*")


def word_starts(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words start, which bytes belong to words) in texts laid end to end.

    Words end at white space, and between a Latin letter or digit and a mark.
    """
    inside = ~_WHITE[raw]
    letter = _ASCII[raw]
    # the second byte of U+00C0 to U+017F, but for the signs of times and division and the dotted I
    second = np.zeros(len(raw), bool)
    for lead, no in ((0xC3, (0x97, 0xB7)), (0xC4, (0xB0,)), (0xC5, ())):
        at = np.flatnonzero(raw[:-1] == lead) + 1
        second[at[~np.isin(raw[at], no)]] = True
    mark = _MARK[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (mark[1:] & (letter | second)[:-1]) | (letter[1:] & mark[:-1])
    ends = np.cumsum(sizes)
    first = (ends - sizes)[sizes > 0]
    begins[first] = inside[first]
    return np.flatnonzero(begins), inside


class Memo:
    """Ids of texts gathered from the ids of their distinct words.

    ``split``, ``encode_words`` and maybe ``normal`` are given by the kind of
    tokenizer.
    """

    def __init__(self, memo: int = MEMO_WORDS):
        self.memo = memo
        self._clear()

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts in order, number of words of each)."""
        raise NotImplementedError

    def normal(self, words: pa.Array) -> pa.Array:
        """Words that stand for those with the same ids."""
        return words

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each, a flag of each)."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.held = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint32)]
        self.bytes = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, ids, flags): the ids of all texts in order, where each text's
        end, and whether all words of a text have their flag."""
        if len(self.place) > self.memo or self.bytes > MEMO_BYTES:
            self._clear()
        found, per_text = self.split(texts)
        coded = found.dictionary_encode()
        normal = self.normal(coded.dictionary).dictionary_encode()
        which = normal.indices.to_numpy()[coded.indices.to_numpy()]
        words = normal.dictionary
        names = words.to_pylist()
        place = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        lengths, flags, pool = self.held
        ids, counts, good = self.encode_words(words.take(pa.array(new)))
        place[new] = len(lengths) + np.arange(len(new))
        all_lengths, all_flags = np.concatenate((lengths, counts)), np.concatenate((flags, good))
        all_ids = np.concatenate((pool, ids))
        starts = np.cumsum(all_lengths) - all_lengths
        # what is met again within a slice is likely to be met in the next
        often = np.bincount(which, minlength=len(names))[new] > 1
        stay = np.flatnonzero(often & (pc.binary_length(words).to_numpy()[new] <= 64))
        if len(stay):
            self.place.update(zip((names[i] for i in new[stay].tolist()), range(len(lengths), len(lengths) + len(stay))))
            kept = _ranges(starts[len(lengths) + stay], counts[stay])
            self.held = [np.concatenate((lengths, counts[stay])), np.concatenate((flags, good[stay])), np.concatenate((pool, all_ids[kept]))]
            self.bytes += 4 * len(kept)
        at = place[which]
        counts = all_lengths[at]
        total = np.concatenate(([0], np.cumsum(counts)))
        unlike = np.concatenate(([0], np.cumsum(~all_flags[at])))
        ends = np.concatenate(([0], np.cumsum(per_text)))
        return total[ends[1:]], all_ids[_ranges(starts[at], counts)], np.diff(unlike[ends]) == 0


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordIds(Memo):
    """A tokenizer file; whole texts are its words unless its steps are known
    never to match across white space."""

    def __init__(self, content: str, memo: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(content)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.by_word = self._cuts_at_blanks(json.loads(content)) and len(added) > 0
        self.between = next(iter(added), None)
        # words of plain letters need no more than lower case and the byte alphabet
        self.plain = Tokenizer.from_str(content)
        self.plain.normalizer = normalizers.Sequence([])
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), alphabet])
        self.ends = self._word_ends() if self.by_word else None
        self.by_word = self.by_word and self.ends is not None
        super().__init__(memo)

    @staticmethod
    def _cuts_at_blanks(file: dict) -> bool:
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        alike = (file.get("normalizer") or {}).get("normalizers") == NORMAL and steps[0].get("pattern") == {"Regex": PATTERN}
        whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in file["added_tokens"])
        return alike and whole and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and len(steps) == 2

    def _word_ends(self) -> np.ndarray | None:
        """Of each id whether it ends a word, if the model marks that."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        out = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            out[i] = piece.endswith(suffix)
        return out

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not self.by_word:
            return texts.cast(pa.large_string()), np.ones(len(texts), np.int64)
        raw, sizes = raw_bytes(texts)
        starts, inside = word_starts(raw, sizes)
        kept = np.cumsum(inside)
        lengths = np.diff(np.concatenate((kept[starts] - 1, kept[-1:]))) if len(starts) else starts
        per_text = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))
        return strings_of(raw[inside], lengths), per_text

    def _is_plain(self, words: pa.Array) -> pa.Array:
        return pc.match_substring_regex(words, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$")

    def normal(self, words: pa.Array) -> pa.Array:
        return pc.if_else(self._is_plain(words), pc.utf8_lower(words), words) if self.by_word else words

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = self._is_plain(words).to_numpy(zero_copy_only=False) if self.by_word else np.zeros(len(words), bool)
        names, counts = words.to_pylist(), np.zeros(len(words), np.int64)
        own, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        found, counts[own] = self._encode_plain([names[i] for i in own.tolist()])
        others, counts[rest] = self._encode_other([names[i] for i in rest.tolist()])
        # put together in the words' order
        order = np.concatenate((own, rest))
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate((found, others))[_ranges(starts, counts)], counts, np.ones(len(words), bool)

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        found = [np.asarray(e.ids, np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        return ids, np.diff(np.concatenate(([-1], np.flatnonzero(self.ends[ids])))) if len(ids) else np.zeros(0, np.int64)

    def _encode_other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call for all words, told apart by a special token between them;
        words that hold such a token by themselves."""
        odd = {i for i, w in enumerate(words) if not self.by_word or any(s in w for s in self.special)}
        plain = [w for i, w in enumerate(words) if i not in odd]
        found = [[]] * len(words)
        if plain:
            joined = self.tokenizer.encode_batch_fast([self.special[0].join(plain)], add_special_tokens=False)[0]
            ids = np.asarray(joined.ids, np.uint32)
            cut = np.flatnonzero(ids == self.between)
            if not odd:
                return np.delete(ids, cut), np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
            parts = iter(np.split(ids, cut))  # all but the first begin with the token between
            found = [[] if i in odd else next(parts) for i in range(len(words))]
            first = next(i for i in range(len(words)) if i not in odd)
            found = [f if i in odd or i == first else f[1:] for i, f in enumerate(found)]
        for i in odd:
            found[i] = self.tokenizer.encode(words[i], add_special_tokens=False).ids
        counts = np.array([len(f) for f in found], np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(f, np.uint32) for f in found)]), counts


def word_ids(path: str) -> WordIds:
    """The encoder of this worker process for a tokenizer file (see ``shared_file``)."""

    def make() -> WordIds:
        with open(shared_file(path), encoding="utf-8") as file:
            return WordIds(file.read())

    return per_process(("word ids", path), make)
