"""Token ids of whole texts by the tokenizers library, with a memo for recurring pieces of text.

Both vocabularies split text before their merges, and never merge across the start of a space or line end that follows
another character than white space. Texts are cut there, each distinct piece is encoded by the library once, and its
ids are kept in a bounded memo; a word with marks after it is the word and the marks, since both vocabularies split
between them. So ids equal those of the whole text at a fraction of the time. Texts with a special token's string, or
with white space before a space or a line end, are encoded whole.

Splitting, numbering and joining the pieces are Arrow functions on the batch; Python sees new pieces only.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks after a word, in front of which both vocabularies split.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Most pieces, and bytes, that a memo holds.
MEMO = 250_000
MEMO_BYTES = 24 << 20
WORDS_AT_ONCE = 8192


def path(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Ids of pieces. Beyond its bounds only its first quarter stays, in which the frequent ones are, or nothing if those
    are long. A piece with null ids is one that isn't encoded alone."""

    def __init__(self) -> None:
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _shrink(self) -> None:
        self.keys, self.ids = (pa.concat_arrays([x.slice(0, MEMO // 4)]) for x in (self.keys, self.ids))
        if self.keys.nbytes + self.ids.nbytes > MEMO_BYTES // 2:
            self.__init__()

    def get(self, pieces: pa.Array, encode) -> pa.Array:
        """The ids of distinct pieces; encode makes those of new ones."""
        if len(self.keys) > MEMO or self.keys.nbytes + self.ids.nbytes > MEMO_BYTES:
            self._shrink()
        at = pc.index_in(pieces, value_set=self.keys)
        new = pc.is_null(at)
        if pc.any(new).as_py():
            fresh = pieces.filter(new)
            places = np.zeros(len(pieces), np.int32)
            unknown = new.to_numpy(zero_copy_only=False)
            places[~unknown] = at.drop_null().to_numpy()
            places[unknown] = len(self.keys) + np.arange(len(fresh))
            ids = encode(fresh)
            self.keys, self.ids, at = pa.concat_arrays([self.keys, fresh]), pa.concat_arrays([self.ids, ids]), pa.array(places)
        return self.ids.take(at)


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        #: Whether a space before a word belongs to its ids; else white space has none.
        self.spaced = bool(self.library.encode(" a", add_special_tokens=False).ids != self.library.encode("a", add_special_tokens=False).ids)
        #: Between words, and the one id that it has and no word holds.
        self.mark = "\n" if self.spaced else " ^ "
        (self.mark_id,) = self.library.encode(self.mark, add_special_tokens=False).ids
        self.line_end = self.whole(["\n"])[0]
        self.lead = " " if self.spaced else ""
        self.tails: dict[str, bytes] = {"": b""}
        self.words = {lead: Memo() for lead in {self.lead, ""}}
        self.forget()

    def forget(self) -> None:
        """Empty the memo of pieces, the larger one; a task does so at its end, as its worker lives on. Words stay for the
        worker's next tasks, since encoding them takes most of the time; their memo has its bounds."""
        self.pieces = {lead: Memo() for lead in {self.lead, ""}}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        if self.spaced:
            plain = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n")
        else:  # the vocabulary is of small letters and drops white space
            plain = pa.array([t if t is None or "Σ" in t or "İ" in t else t.lower() for t in texts], pa.large_string())
            plain = pc.replace_substring(plain, "\n", " ")
        lists = pc.split_pattern(plain, " ")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        parts = lists.flatten()
        coded = parts.dictionary_encode()
        placed = self._ids(coded.dictionary, self.lead).take(coded.indices)
        raw, at = placed.buffers()[2], np.frombuffer(placed.buffers()[1], np.int64, len(placed) + 1)
        lost = np.concatenate([[0], np.cumsum(pc.is_null(placed).to_numpy(zero_copy_only=False))])
        some = np.flatnonzero(ends > starts)
        firsts = parts.take(pa.array(starts[some])).dictionary_encode()
        heads: list[bytes | None] = [None] * len(texts)
        for i, head in zip(some.tolist(), self._ids(firsts.dictionary, "").take(firsts.indices).to_pylist(), strict=True):
            heads[i] = head
        out = []
        for text, head, a, b in zip(texts, heads, starts.tolist(), ends.tolist(), strict=True):
            if text is None:
                out.append(b"")
            elif head is None or lost[b] > lost[a + 1]:
                out.append(self.whole([text])[0])
            else:
                out.append(head + raw[int(at[a + 1]) : int(at[b])].to_pybytes())
        return out

    def _ids(self, pieces: pa.Array, lead: str) -> pa.Array:
        return self.pieces[lead].get(pieces, lambda new: self._encode_pieces(new, lead))

    def _encode_pieces(self, pieces: pa.Array, lead: str) -> pa.Array:
        """Words, and words with marks, by their parts; all other pieces as they are."""
        lines = pc.starts_with(pieces, "\n")
        body = pc.if_else(lines, pc.utf8_slice_codeunits(pieces, 1), pieces)
        word = pc.utf8_rtrim(body, _MARKS)
        tail = (pc.binary_length(body).to_numpy() - pc.binary_length(word).to_numpy()).astype(np.int64)
        simple = pc.and_(pc.utf8_is_alpha(word), pc.invert(pc.match_substring(word, "İ"))).to_numpy(zero_copy_only=False) & (tail <= 8)  # its small form is two characters, of which the marks might take one
        line = lines.to_numpy(zero_copy_only=False)
        out = pa.nulls(len(pieces), pa.large_binary())
        for own, before, own_lead in ((simple & ~line, b"", lead), (simple & line, self.line_end, "")):
            if own.any():
                coded = word.filter(pa.array(own)).dictionary_encode()
                words = self.words[own_lead].get(coded.dictionary, lambda new, own_lead=own_lead: self._encode_words(new, own_lead)).take(coded.indices)
                joined = pc.binary_join_element_wise(pa.scalar(before, pa.large_binary()), words, self._tails(body.filter(pa.array(own)), tail[own]), pa.scalar(b"", pa.large_binary()))
                out = pc.replace_with_mask(out, pa.array(own), joined)
        if not simple.all():
            odd = pieces.filter(pa.array(~simple)).to_pylist()
            safe = [not ("<|" in p or p[-1:].isspace() or not p and lead != "") for p in odd]
            found = iter(self.whole([p if p.startswith("\n") else lead + p for p, ok in zip(odd, safe, strict=True) if ok]))
            out = pc.replace_with_mask(out, pa.array(~simple), pa.array([next(found) if ok else None for ok in safe], pa.large_binary()))
        return out

    def _tails(self, body: pa.Array, size: np.ndarray) -> pa.Array:
        """The ids of the last size bytes of each string, eight at most, all marks."""
        body = pa.concat_arrays([body])  # one buffer from its start on
        ends = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1)[1:]
        raw = np.frombuffer(body.buffers()[2] or b"", np.uint8)
        code = np.zeros(len(size), np.uint64)
        for k in range(int(size.max(initial=0))):
            on = size > k
            code[on] = code[on] << np.uint64(8) | raw[ends[on] - size[on] + k]
        codes, which = np.unique(code, return_inverse=True)
        texts = [int(c).to_bytes(8, "big").lstrip(b"\0").decode() for c in codes]
        for t in texts:
            if t not in self.tails:
                self.tails[t] = self.whole([t])[0]
        return pa.array([self.tails[t] for t in texts], pa.large_binary()).take(pa.array(which))

    def _encode_words(self, words: pa.Array, lead: str) -> pa.Array:
        parts = []
        each = words.to_pylist()
        for i in range(0, len(each), WORDS_AT_ONCE):
            part = each[i : i + WORDS_AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([lead + (self.mark + lead).join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) + 1 == len(part):
                offsets = 4 * np.concatenate([[0], cuts - np.arange(len(cuts)), [len(ids) - len(cuts)]]).astype(np.int64)
                parts.append(pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(np.delete(ids, cuts))]))
            else:
                parts.append(pa.array(self.whole([lead + p for p in part]), pa.large_binary()))
        return pa.concat_arrays(parts)


@cache
def encoder(file: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    return Encoder(file)
