"""Token ids of whole texts by the tokenizers library, each word of a portion once.

Where a vocabulary drops white space and every word ends at it, the ids of a text are those of its words, joined. Arrow
cuts a portion of texts into words and numbers the different ones; the library encodes those that a worker's memo lacks;
Arrow then puts the ids in place. The memo has two generations of at most MEMO_WORDS words, so its memory is bounded and
frequent words stay. Texts with one of four control characters that Arrow takes for white space and the library doesn't
are encoded whole, as are all texts of other vocabularies.
"""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_WORDS = 300_000
_NOT_SPACE = "[\x1c-\x1f]"
_BAR = "|"


class Encoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        bar, letters = self._ids(_BAR), [t.id for t in self.library.model.tokenize("letters")]
        self.by_word = (len(bar) == 1 and self._ids("a  b\n") == self._ids("a") + self._ids("b")
                        and self._ids("LETTERS") == letters and sys.byteorder == "little")
        self.bar = bar[0]
        self.memo_words, self.memo, self.older = memo_words, {"": b""}, {}

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self._ids(text), "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Words of ASCII letters go to the library's model as they are, in lower case; all others through the whole
        library, with a bar between them, whose one id no other word has."""
        memo, merge = self.memo, self.library.model.tokenize
        rest = []
        for w in words:
            if w.isascii() and w.isalpha():
                memo[w] = array("I", [t.id for t in merge(w.lower())]).tobytes()
            elif _BAR in w:
                memo[w] = self.whole(w)
            else:
                rest.append(w)
        for at in range(0, len(rest), 4096):
            some = rest[at:at + 4096]
            ids = np.asarray(self.library.encode_batch_fast([f" {_BAR} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            begin, raw = 0, ids.tobytes()
            for word, end in zip(some, [*np.flatnonzero(ids == self.bar).tolist(), len(ids)], strict=True):
                memo[word] = raw[4 * begin:4 * end]
                begin = end + 1

    def _known(self, words: list[str]) -> pa.Array:
        if len(self.memo) > self.memo_words:
            self.older, self.memo = self.memo, {"": b""}
        memo, older = self.memo, self.older
        new = [w for w in words if w not in memo]
        memo.update((w, older[w]) for w in new if w in older)
        self._learn([w for w in new if w not in memo])
        return pa.array(map(memo.__getitem__, words), pa.binary(), size=len(words))

    def encode(self, texts: pa.StringArray) -> list[memoryview]:
        """Little-endian unsigned 32-bit ids of each text. The texts of one call should be a few megabytes."""
        odd = pc.match_substring_regex(texts, _NOT_SPACE).to_numpy(zero_copy_only=False) | (not self.by_word)
        words = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        numbered = words.flatten().dictionary_encode()
        ids = self._known(numbered.dictionary.to_pylist()).take(numbered.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[words.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        return [memoryview(self.whole(texts[i].as_py())) if odd[i] else data[ends[i]:ends[i + 1]] for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)
