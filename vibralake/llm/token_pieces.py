"""Token ids of whole texts, with equal stretches tokenised once.

A text is cut at blanks that follow an ASCII graphic character or one of two bytes from U+00C0 on (none of these is white space), and
on demand between a letter and an ASCII mark. Tokenizers whose tokens never reach over such a place give the same
ids for the text as for its stretches one after another, so a stretch that comes up again is looked up. That holds for the three vocabularies
used here: the byte-level one and the one with word ends split there before they merge, and the pieces of the third have blanks at
their beginning only and no mark behind a letter.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from vibralake.llm.texts import Slice

# Stretches that a worker remembers at most before it starts anew.
REMEMBERED = 400_000


WHITE, CLOSING, LETTER, MARK = np.zeros((4, 256), bool)
WHITE[list(b" \t\n\v\f\r")] = True
CLOSING[list(b'.,;:!?)]"')] = True
LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file by its name; a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def stretches(piece: Slice, words: bool = False, marks: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct stretches of a slice's texts as bytes, the code of each stretch, and the first stretch of every row.

    Every text has to begin with a blank of its own, or be empty. With ``words`` texts are cut at all ASCII white space and between an ASCII
    letter and a closing mark, and A-Z are lower-cased where no special token can be meant: for tokenizers that
    do all that before they merge. Otherwise every stretch begins with a blank, or with ``marks`` with an ASCII mark that follows
    a letter (up to U+024F).
    """
    data = piece.data
    before = np.empty(len(data), np.uint8)
    before[:1] = 33
    before[1:] = data[:-1]
    if words:
        start = (WHITE[data] & ~WHITE[before]) | (CLOSING[data] & LETTER[before])
        if not ((data == 124) & (before == 60)).any():  # <|
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    else:
        lead = np.empty(len(data), np.uint8)  # the byte before that
        lead[:1] = 33
        lead[1:] = before[:-1]
        pair = (before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
        start = (data == 32) & ((before > 32) & (before < 127) | pair)
        if marks:
            sign = (lead == 0xC3) & ((before == 0x97) | (before == 0xB7))
            start |= MARK[data] & (LETTER[before] | pair & (lead <= 0xC9) & ~sign)
    firsts = piece.offsets[:-1][np.diff(piece.offsets) > 0]
    start[firsts] = True
    starts = np.flatnonzero(start)
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int64)
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    encoded = held.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, piece.offsets)


def gathered(flat: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[bounds[c]:bounds[c + 1]] of all codes end to end, and where each begins."""
    sizes = np.diff(bounds)[codes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(bounds[:-1][codes] - ends[:-1], sizes) + np.arange(ends[-1])
    return flat[places], ends


class WordIds:
    """Ids of stretches by a tokenizer that marks word ends, remembered as one flat array.

    A word of a-z goes to the vocabulary's merges alone, many words at a time; any other stretch takes the tokenizer's full way.
    """

    MOST = 1_000_000

    def __init__(self, path: str, end_mark: str = "</w>"):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.full = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.full.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.closes = np.zeros(self.full.get_vocab_size(), bool)
        self.closes[[i for t, i in self.full.get_vocab().items() if t.endswith(end_mark)]] = True
        self.start()

    def start(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.bounds = array("i", [0]), array("q", [1])  # a buffer must not be empty

    def learn(self, keys: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.bounds.frombytes((ends + len(self.flat)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def of(self, keys: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stretches keys[codes] end to end, and where each begins."""
        if len(self.known) > self.MOST:
            self.start()
        plain, other = [], []
        for k in keys:
            if k not in self.known:
                w = k.strip()
                if w.isalpha() and w.islower():
                    plain.append((k, w))
                else:
                    other.append(k)
        for at in range(0, len(plain), 2000):
            part, words = zip(*plain[at : at + 2000], strict=True)
            ids = np.array(self.merges.encode(b" ".join(words).decode(), add_special_tokens=False).ids)
            self.learn(part, ids, np.flatnonzero(self.closes[ids]) + 1)
        found = [x.ids for x in self.full.encode_batch_fast([k.decode("utf-8", "replace") for k in other], add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in found], dtype=np.int64)
        self.learn(other, np.fromiter((i for x in found for i in x), np.int32, int(ends[-1]) if found else 0), ends)
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        return gathered(np.frombuffer(self.flat, np.int32), np.frombuffer(self.bounds, np.int64), place[codes])
