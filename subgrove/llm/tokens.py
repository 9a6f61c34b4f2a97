"""Token ids of texts by a public tokenizer: words are split and told apart by Arrow, each distinct word is encoded once a worker."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids that a task keeps before it starts anew, and bytes of text encoded at once: bounds on its memory.
KEPT_BYTES, TEXT_BYTES = 24 << 20, 6 << 20
_GROUP = 256

# Texts of other characters, or with white space at an end or next to white space, are encoded whole: only in
# the rest is it plain from the tokenizer's rules where they cut.
_BYTE_UNSAFE = "[^\\n\\x20-\\x7e¡-ɏ]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|<\\|"
_WORD_UNSAFE = "[^\\t-\\r\\x20-\\x7e¡-įı-ɏ]|<\\|"


# A comma or full stop before white space is a piece of its own if a letter or digit is before it.
_JOINED = "[^0-9A-Za-zªµºÀ-ÖØ-öø-ɏ][.,][\\t-\\r ]"


def _each(texts: pa.Array, changes: list[tuple[str, str]]) -> pa.Array:
    for old, new in changes:
        texts = pc.replace_substring(texts, old, new)
    return texts


def _byte_words(texts: pa.Array) -> pa.Array:
    """A space belongs to the word after it; a single line end stands alone."""
    cut = _each(texts, [("\n", "\0\n\0"), (" ", "\0 ")])
    cut = pc.if_else(pc.match_substring_regex(texts, _JOINED), cut, _each(cut, [(".\0", "\0.\0"), (",\0", "\0,\0")]))
    return pc.split_pattern(cut, "\0")


def _word_words(texts: pa.Array) -> pa.Array:
    """White space doesn't matter, nor does the case of A-Z."""
    cut = _each(texts, [(". ", " . "), (", ", " , "), (".\n", " . "), (",\n", " , ")])
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pc.match_substring_regex(texts, _JOINED), texts, cut)))


def _offsets(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _ragged(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(_offsets(sizes)), pa.array(ids.astype(np.uint32, copy=False)))


def _flat(found) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in found]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes


class Encoder:
    """encode() gives what encode_batch(texts, add_special_tokens=False) of the tokenizer gives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind["pre_tokenizer"] or {}
        by_byte = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind["normalizer"]
        by_word = pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and kind["model"].get("end_of_word_suffix")
        self.unsafe, self.split = (_BYTE_UNSAFE, _byte_words) if by_byte else (_WORD_UNSAFE, _word_words) if by_word else (None, None)
        suffix = kind["model"].get("end_of_word_suffix")
        del kind, pre
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = bool(by_byte)  # words begin with their space
        if self.split:
            self.mark, self.mark_id = self._mark(*((" ", "Ġ", "") if by_byte else ("", "", suffix)))
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.large_string()), _ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _mark(self, glue: str, starts: str, ends: str) -> tuple[str, int]:
        """A word of one id to put between words that are encoded together."""
        for word, n in sorted(self.tokenizer.get_vocab().items(), key=lambda x: -x[1]):
            plain = word.removeprefix(starts).removesuffix(ends)
            if len(plain) > 5 and plain.isascii() and plain.isalpha() and plain.islower() and self.tokenizer.encode(glue + plain, add_special_tokens=False).ids == [n]:
                return plain, n
        raise ValueError("no word of the tokenizer has one id")

    def _alone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False))

    def _grouped(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that a space can go before, encoded in groups with a mark between them; words of groups in
        which a word holds the mark's id are encoded one by one."""
        size = len(words)
        glue = f" {self.mark}" if self.spaced else f" {self.mark} "
        groups = pa.LargeListArray.from_arrays(pa.array(np.r_[np.arange(0, size, _GROUP), size]), words)
        ids, sizes = [], []
        for k, found in enumerate(self.tokenizer.encode_batch_fast(pc.binary_join(groups, pa.scalar(glue, words.type)).to_pylist(), add_special_tokens=False)):
            own = np.array(found.ids, np.uint32)
            is_mark = own == self.mark_id
            marks = np.flatnonzero(is_mark)
            count = min(_GROUP, size - k * _GROUP)
            if len(marks) == count - 1:
                ids.append(own[~is_mark])
                sizes.append(np.diff(np.r_[-1, marks, len(own)]) - 1)
            else:
                a, b = self._alone(words.slice(k * _GROUP, count))
                ids.append(a)
                sizes.append(b)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _known(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct words. New ones are encoded and kept, until there are too many."""
        at = pc.index_in(distinct, value_set=self.words)
        new = distinct.filter(pc.is_null(at))
        if not len(new):
            return self.ids.take(at)
        free = pc.starts_with(new, " ") if self.spaced else pa.array(np.ones(len(new), bool))
        parts = [(new.filter(free), self._grouped), (new.filter(pc.invert(free)), self._alone)]
        words, ids = [], []
        for some, encode in parts:
            if len(some):
                words.append(some)
                ids.append(_ragged(*encode(some)))
        old_words, old_ids = self.words, self.ids
        if old_words.nbytes + old_ids.nbytes > KEPT_BYTES:
            mine = at.drop_null().unique()
            old_words, old_ids = old_words.take(mine), old_ids.take(mine)
        self.words, self.ids = pa.concat_arrays([old_words, *words]), pa.concat_arrays([old_ids, *ids])
        return self.ids.take(pc.index_in(distinct, value_set=self.words))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more entry at the end). texts: strings or an Arrow array of them."""
        own = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        size = len(own)
        unsafe = pc.match_substring_regex(own, self.unsafe) if self.split else pa.array(np.ones(size, bool))
        whole = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
        ids, at = np.zeros(0, np.uint32), np.zeros(size + 1, np.int64)
        if len(whole) < size:
            cut = self.split(pc.if_else(unsafe, "", own) if len(whole) else own)
            word_at = np.asarray(cut.offsets, np.int64)
            words = cut.flatten().dictionary_encode()
            del cut
            each = self._known(words.dictionary)
            sizes = pc.list_value_length(each).to_numpy()
            ends = _offsets(sizes[words.indices.to_numpy()])
            at = ends[word_at - word_at[0]]
            ids = each.take(words.indices).flatten().to_numpy()
        if not len(whole):
            return ids, at
        cut = [ids[s:e] for s, e in zip(at, at[1:], strict=False)]
        for k, e in zip(whole.tolist(), self.tokenizer.encode_batch_fast(own.take(pa.array(whole)).to_pylist(), add_special_tokens=False), strict=True):
            cut[k] = np.array(e.ids, np.uint32)
        return np.concatenate(cut), _offsets(np.fromiter(map(len, cut), np.int64, size))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text, or of one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        of = np.cumsum(sizes, dtype=np.int64) // limit
        edge = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
        for s, e in zip(edge, edge[1:], strict=False):
            if e > s:
                yield batch.slice(s, e - s)


def closed(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts and where they begin, with end_id put after each text."""
    n = len(at) - 1
    out, own = np.full(len(ids) + n, end_id, "<u4"), np.ones(len(ids) + n, bool)
    own[at[1:] + np.arange(n)] = False
    out[own] = ids
    return out, at + np.arange(n + 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
