"""Batch tokenization with a public vocabulary, shared by token output and packing."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import concat_ranges, starts_of, utf8

#: The pre-token pattern that the vocabulary file itself states (white space spelled out for RE2).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\v\p{Z}\x{85}\p{L}\p{N}]+"
#: For rows without an apostrophe: letters apart from the rest; the library cuts up what is not letters.
NOT_LETTERS = r"[^\s\p{L}]+"
#: Words kept in the worker's cache; when full, those that the last batch lacked go, so memory is bounded.
CACHE = 200_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode_batch(..., add_special_tokens=False) of the tokenizers library over Arrow text columns.

    Rows of Latin-1 characters without a special token's mark are cut into pre-tokens with Arrow; each different one is
    encoded once by the library and the ids are gathered with numpy. The other rows go to the library whole, so all rows
    get the library's own ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        #: Words that were encoded, their ids end to end, and where each one's start (one more: the end).
        self.known, self.ids, self.starts = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        #: The byte-level alphabet: bytes that are not printable Latin-1 stand at 256 and up, in their order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(printable))}

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of pre-tokens end to end, and how many each has. Runs of letters go straight to the library's model, spelt in its byte
        alphabet; those beyond ASCII are spelt all at once."""
        texts, tokenize = words.to_pylist(), self.lib.model.tokenize
        letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        wide = np.flatnonzero(letters & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)).tolist()
        spelt = "\n".join([texts[i] for i in wide]).encode().decode("latin-1").translate(self.alphabet)
        for i, s in zip(wide, spelt.split(chr(self.alphabet[10])), strict=False):
            texts[i] = s
        ids, ends = array("I"), array("q", [0])
        for w, run in zip(texts, letters.tolist(), strict=True):
            ids.extend([t.id for t in tokenize(w)] if run else self.lib.encode(w, add_special_tokens=False).ids)
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and of each of these different pre-tokens where in them its own start and how many they are. Known ones are looked up
        in Arrow; only new ones become Python texts."""
        words = words.cast(pa.string())
        found = pc.index_in(words, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        fresh = words.filter(pa.array(new))
        more, n = self._fresh(fresh)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.known) + np.arange(len(fresh))
        known, ids = pa.concat_arrays([self.known, fresh]), np.concatenate([self.ids, more])
        starts = np.concatenate([self.starts[:-1], len(self.ids) + starts_of(n)])
        first, size = starts[at], np.diff(starts)[at]
        if len(known) > CACHE:
            known, few = known.take(pa.array(at[:CACHE])), concat_ranges(first[:CACHE], size[:CACHE])
            self.known, self.ids, self.starts = known, ids[few], starts_of(size[:CACHE])
        else:
            self.known, self.ids, self.starts = known, ids, starts
        return ids, first, size

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all rows end to end, and how many each row has; null is empty."""
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        text = text.fill_null("")
        raw, offs = utf8(text)
        odd = np.zeros(len(text) + 1, np.int64)
        hard = (raw > 0xC3) | ((raw == 60) & (np.append(raw[1:], 0) == 124))  # beyond Latin-1, or "<|"
        np.add.at(odd, np.searchsorted(offs, np.flatnonzero(hard), "right") - 1, 1)
        whole = np.flatnonzero(odd[:-1])
        easy = np.flatnonzero(odd[:-1] == 0)
        counts = np.zeros(len(text), np.int64)
        ids, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(easy):
            low = pc.utf8_lower(text.take(pa.array(easy)))
            quoted = pc.match_substring(low, "'")
            plain = pc.replace_substring_regex(low, NOT_LETTERS, r" \0 ")
            spaced = pc.if_else(quoted, pc.replace_substring_regex(pc.if_else(quoted, low, ""), PRETOKEN, r"\0 "), plain)
            lists = pc.ascii_split_whitespace(spaced)
            per_row = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            flat, first, size = self._words(coded.dictionary)
            word = coded.indices.to_numpy(zero_copy_only=False)
            per_word = size[word]
            ids = flat[concat_ranges(first[word], per_word)]
            n = np.diff(starts_of(per_word)[starts_of(per_row)])
            counts[easy] = n
        if not len(whole):
            return ids, counts
        slow = [np.array(e.ids, np.uint32) for e in self.lib.encode_batch(text.take(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        counts[whole] = [len(x) for x in slow]
        out, at = np.zeros(int(counts.sum()), np.uint32), starts_of(counts)
        out[concat_ranges(at[easy], n)] = ids
        for i, x in zip(whole, slow, strict=True):
            out[at[i] : at[i + 1]] = x
        return out, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each with one more id at its end."""
    return np.insert(ids, starts_of(counts)[1:], np.uint32(end_id)), counts + 1
