"""Token ids of whole texts from a public tokenizer file, each distinct chunk encoded once per worker.

Both byte-level and word-end BPE split a text into pieces that never cross the start of a blank before a word, a single
line end between words, or a word's end before a full stop. So a text's ids are the joined ids of its chunks; the
tokenizers library encodes each chunk. Texts with other white space after a blank, or with the string of a special token,
which the library reads as that token, go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_CHUNKS = 1_000_000
#: Bytes of text that are encoded together; a larger part has fewer distinct chunks for each of its own.
SLICE = 1 << 22
#: Chunks, and texts, that the library gets in one call; until the call ends it holds many times their size.
PART, PART_TEXTS = 20_000, 64
#: A full stop or comma that ends a Latin word before a blank or the text's end is a piece of its own.
_STOP = re.compile("[.,](?<=[A-Za-z0-9À-ÖØ-öø-įı-ɏ][.,])(?=[ \n]|$)")
_LINES = ("\n\n", "\n ", "\t", "\r", "\x0b", "\x0c")
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_BLANKS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")


class Encoder:
    """ids as little-endian unsigned 32-bit bytes; keeps at most most_chunks chunks."""

    def __init__(self, path: str, most_chunks: int = MOST_CHUNKS):
        self.most_chunks = most_chunks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # It looks for special tokens only when whole() is told to, as most texts have none.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: The strings of special tokens, in small letters.
        self.special = sorted({x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()})
        #: Signs that all of them start with, so that one search tells that a text has none.
        self.opening = re.match("[^a-z\x80-\U0010ffff]*", os.path.commonprefix(self.special))[0]
        self.known: dict[str, bytes] = {}
        # In byte-level vocabularies a token's string has one character for each byte it stands for.
        vocabulary = self.tokenizer.get_vocab()
        self.ends = any(x.endswith("</w>") for x in vocabulary)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.line = self.whole(["\n"])[0]
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix("</w>"))

    def whole(self, texts: list[str], special: bool = False) -> list[bytes]:
        out = []
        self.tokenizer.encode_special_tokens = not special
        try:
            for part in _parts(texts, PART_TEXTS):
                out += [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        finally:
            self.tokenizer.encode_special_tokens = True
        return out

    def blanked(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, which starts with a blank: all are encoded as one text, then cut where their bytes end."""
        if self.tokenizer.normalizer is None:
            sizes = [len(x.encode()) for x in chunks]
        else:
            sizes = [len(x) - 1 if x.isascii() and x.isprintable() else self._normal_size(x) for x in chunks]
        return self._cut_ids("".join(chunks), sizes) or self.whole(chunks)

    def bare(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk that no blank is before, encoded as lines of one text."""
        if any("\n" in x for x in chunks):
            return self.whole(chunks)
        sizes = [n for x in chunks for n in (len(x.encode()), 1)]
        found = self._cut_ids("".join(f"{x}\n" for x in chunks), sizes)
        return found[::2] if found else self.whole(chunks)

    def _cut_ids(self, text: str, sizes: list[int]) -> list[bytes] | None:
        """The ids of a text's parts of so many bytes each; None if a token goes over a part's end."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends, marks = np.cumsum(np.array(sizes, np.int64)), np.cumsum(self.bytes_of[ids])
        if len(ids) == 0 or len(ends) == 0 or marks[-1] != ends[-1]:
            return None
        cuts = np.searchsorted(marks, ends)
        if not (marks[cuts] == ends).all():
            return None
        raw, cuts = ids.tobytes(), [0, *(4 * cuts + 4).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _normal_size(self, chunk: str) -> int:
        # Letters of the first 256 characters are composed, and stay as long in small letters.
        if chunk.isprintable() and (_narrow(chunk) or is_normalized("NFC", chunk)):
            return len(chunk.lower().encode()) - 1
        return len("".join(self.tokenizer.normalizer.normalize_str(chunk).split()).encode())

    def marked(self, text: str) -> str:
        """A plain text with a blank between its chunks; "\0" marks one that has no blank before it.

        Where blanks leave no trace in the ids, chunks need no mark; and where letters become small, those of texts in the
        first 256 characters can do so here.
        """
        if self.ends:
            return _STOP.sub(r" \g<0>", text.lower() if _narrow(text) else text)
        text = "\0" + text
        if "\n" in text and not any(x in text for x in _LINES) and text[1] != "\n" and text[-1] != "\n":
            text = text.replace("\n", " \0\n \0")
        return _STOP.sub(r" \0\g<0>", text)

    def plain(self, text: str) -> bool:
        if _ODD.search(text) or "\0" in text or (self.special and self._marked(text)):
            return False
        return self.ends or not (any(b in text for b in _BLANKS) or text[-1:] == " ")

    def _marked(self, text: str) -> bool:
        if self.opening not in text:
            return False
        text = text.lower()
        return any(x in text for x in self.special)

    def _found(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk; those that aren't known are encoded together."""
        known = self.known
        found = list(map(known.get, chunks))
        if None not in found:
            return found
        new = [x for x, ids in zip(chunks, found, strict=True) if ids is None]
        if len(known) + len(new) > self.most_chunks:
            known.clear()
            new, found = chunks, [None] * len(chunks)
        first, rest = [x for x in new if x[:1] == "\0" and x != "\0\n"], [x for x in new if x and x[0] != "\0"]
        for part in _parts(first, PART):
            known.update(zip(part, self.bare([x[1:] for x in part]), strict=True))
        for part in _parts(rest, PART):
            known.update(zip(part, self.blanked([" " + x for x in part]), strict=True))
        known.setdefault("\0\n", self.line)
        if "" in new:
            known[""] = b"" if self.ends else self.blanked([" "])[0]
        if len(new) == len(chunks):
            return list(map(known.__getitem__, chunks))
        more = map(known.__getitem__, new)
        return [next(more) if ids is None else ids for ids in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Arrow cuts the texts and finds the distinct chunks, numpy puts the ids of chunks together."""
        plain = [self.plain(x) for x in texts]
        odd = iter(self.whole([x for x, ok in zip(texts, plain, strict=True) if not ok], special=True))
        marked = pa.array([self.marked(x) for x, ok in zip(texts, plain, strict=True) if ok], pa.large_string())
        cut = pc.ascii_split_whitespace(marked) if self.ends else pc.split_pattern(marked, " ")
        bounds, chunks = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        distinct, index = _strings(chunks.dictionary), chunks.indices.to_numpy()
        found = self._found(distinct)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, start, n = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = ids[np.arange(int(ends[-1])) + np.repeat(start[index] - ends[:-1], n)].tobytes()
        at = (4 * ends[bounds - bounds[0]]).tolist()
        done = iter([raw[a:b] for a, b in zip(at, at[1:], strict=False)])
        return [next(done) if ok else next(odd) for ok in plain]


def _parts(texts: list[str], most: int) -> Iterator[list[str]]:
    return (texts[lo : lo + most] for lo in range(0, len(texts), most))


def _strings(chunks: pa.Array) -> list[str]:
    """The strings of an array of chunks, none of which has a blank; one string cut at blanks is made faster than each alone."""
    if len(chunks) == 0:
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), pa.scalar(" ", chunks.type))[0].as_py().split(" ")


def _narrow(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most_chunks: int = MOST_CHUNKS) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, most_chunks) not in _ENCODERS:
        _ENCODERS[path, most_chunks] = Encoder(path, most_chunks)
    return _ENCODERS[path, most_chunks]
