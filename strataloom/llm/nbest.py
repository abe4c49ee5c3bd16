"""N-best SentencePiece segmentation: forward Viterbi scores as exact heuristics for backward A* over the piece lattice.

No piece of the model has a blank mark after another character, so the lattice of a text falls apart at word starts (and
before the stop after a Latin word, if no piece goes over that place), and the lattice of each part is searched by itself,
once per worker for each distinct part. The forward pass gives each place's
best score, which is exactly what a hypothesis that has come back from the end to this place can still gain. So the
search never needs more open hypotheses than results that are still due, and keeps only those. A text's N best are the N
best sums over its words; only the N - 1 words with the least loss in a second choice can differ from their best.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textscan import slices, text_buffers, tidied

MARK = "▁"
MOST_WORDS = 1_000_000
UNKNOWN_LOSS = 10.0
BARRED = -1e8
_PARTS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: The same with \x01 at a place where a Latin word ends before a stop, if no piece of the model goes over such a place.
_STOPPED = re.compile(f"{MARK}+[^{MARK}\n\x01]*|[^{MARK}\n\x01]+|\n")
_STOP = re.compile(f"[.,](?<=[A-Za-zÀ-ÖØ-öø-ɏ][.,])(?=[{MARK}\n]|$)")
_OVER_STOP = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ][.,]")


class Lattice:
    """A model's pieces and scores, and the N best segmentations of words and texts."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.scores, self.bytes_of, self.byte_ids = n, {}, {}, [0] * 256
        #: Pieces by character: each node has its next characters, and under "" its piece's (score, ids).
        self.tree: dict = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError("a piece crosses the start of a word")
                self.scores[piece] = (model.get_score(i), i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                node = self.tree
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (model.get_score(i), (i,))
        # Scores this low mark pieces that are all but barred; an unknown character is likelier than those.
        self.unknown = min(s for s, _ in self.scores.values() if s > BARRED) - UNKNOWN_LOSS
        self.stops = not any(map(_OVER_STOP.search, self.scores))
        self.dummy = bool(model.encode("a", out_type=str)[0].startswith(MARK))
        self.words: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        #: By row: the best choice's ids, the ids of all others one after the other, and what the best decodes to.
        self.ids: list[bytes] = []
        self.others: list[bytes] = []
        self.raw: list[bytes] = []
        #: Bytes of each choice's ids; 0 where there is none.
        self.sizes = np.zeros((1 << 12, self.n), np.int64)
        self.best = np.zeros(1 << 12)
        #: What a word's second, third, ... choice loses; infinite where there is none.
        self.losses = np.zeros((1 << 12, max(1, self.n - 1)))

    def edges(self, text: str) -> tuple[list, list[float]]:
        """(for each place the pieces that end there: (start, score, ids); the best score up to each place).

        A character that is no piece is its bytes.
        """
        n = len(text)
        into: list[list] = [[] for _ in range(n + 1)]
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        tree = self.tree
        for i in range(n):
            node, here, j = tree, best[i], i
            for c in text[i:]:
                if c not in node:
                    break
                node = node[c]
                j += 1
                if "" in node:
                    score, ids = node[""]
                    into[j].append((i, score, ids))
                    if here + score > best[j]:
                        best[j] = here + score
            if text[i] not in tree or "" not in tree[text[i]]:
                into[i + 1].append((i, self.unknown, tuple(self.byte_ids[b] for b in text[i].encode())))
                best[i + 1] = max(best[i + 1], here + self.unknown)
        return into, best

    def search(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a text's lattice; equal scores by their ids read from the end."""
        into, best = self.edges(text)
        out: list[tuple[float, tuple[int, ...]]] = []
        # (loss, ids from the end, place, score of what is after the place)
        agenda = [(-best[-1], (), len(text), 0.0)]
        due = n
        while agenda:
            _, after, j, tail = agenda.pop(0)
            if j == 0:
                out.append((tail, after[::-1]))
                due -= 1
                if not due:
                    break
                continue
            # The worst hypothesis that can still be one of the due; anything beyond it never is.
            limit = agenda[due - 1][0] if len(agenda) >= due else 1e300
            for i, s, ids in into[j]:
                s += tail
                loss = -best[i] - s
                if loss <= limit:
                    insort(agenda, (loss, after + ids[::-1], i, s))
                    if len(agenda) >= due:
                        del agenda[due:]
                        limit = agenda[-1][0]
        return out

    def word(self, text: str) -> int:
        """The row of a word in the tables. Its best ids are decoded here, once."""
        found = self.search(text, self.n)
        row = self.words[text] = len(self.ids)
        if row == len(self.best):
            self.best, self.losses, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.best, self.losses, self.sizes))
        choices = [np.array(ids, "<u4").tobytes() for _, ids in found]
        self.ids.append(choices[0])
        self.others.append(b"".join(choices[1:]))
        self.sizes[row, : len(choices)] = [len(x) for x in choices]
        self.raw.append(b"".join(map(self.bytes_of.__getitem__, found[0][1])))
        self.best[row] = found[0][0]
        self.losses[row] = np.inf
        for c, (score, _) in enumerate(found[1:]):
            self.losses[row, c] = found[0][0] - score
        return row

    def parts(self, text: str) -> list[str]:
        """The parts of a text whose lattices are independent."""
        text = (MARK if self.dummy and text else "") + text.replace(" ", MARK)
        if not self.stops or "\x01" in text:
            return _PARTS.findall(text)
        return _STOPPED.findall(_STOP.sub("\x01\\g<0>", text))

    def rows(self, text: str) -> list[int]:
        """The parts of a text, as rows of the tables."""
        parts = self.parts(text)
        if len(self.words) > MOST_WORDS:
            self.clear()
        get = self.words.get
        out = list(map(get, parts))
        if None in out:
            out = [r if r is not None else get(p) if p in self.words else self.word(p) for r, p in zip(out, parts, strict=True)]
        return out

    def nbest(self, text: str) -> tuple[bytes, list[tuple[float, dict[int, int]]]]:
        """(ids of the best, [(score, {part: choice})]) with up to n results; choice 0 is a part's best.

        Equal scores stand in the order of the changed parts and their choices.
        """
        return self._nbest(self.rows(text))

    def _nbest(self, rows: list[int]) -> tuple[bytes, list[tuple[float, dict[int, int]]]]:
        at = np.array(rows, np.int64)
        ids = b"".join(map(self.ids.__getitem__, rows))
        gaps, total = self.losses[at, 0], float(self.best[at].sum())
        k = min(self.n - 1, len(rows))
        if k and len(gaps) > k:
            limit = np.partition(gaps, k - 1)[k - 1]
            under = np.flatnonzero(gaps < limit)
            chosen = np.concatenate([under, np.flatnonzero(gaps == limit)[: k - len(under)]])
        else:
            chosen = np.arange(len(rows) if k else 0)
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for w in sorted(chosen.tolist()):
            options = [(0.0, ())] + [(loss, ((w, c),)) for c, loss in enumerate(self.losses[rows[w]].tolist(), 1) if loss < np.inf]
            sums = heapq.nsmallest(self.n, ((a + b, x + y) for a, x in sums for b, y in options))
        return ids, [(total - loss, dict(changes)) for loss, changes in sums]

    def digests(self, text: str) -> tuple[list[float], list[int], list[int], bool]:
        """(scores, numbers of ids, crc32 of ids) of the n best, and whether the best decodes to the text."""
        rows = self.rows(text)
        ids, found = self._nbest(rows)
        ends = np.cumsum(self.sizes[rows, 0]) if rows else None
        lengths, sums = [], []
        for _, changes in found:
            made, done = [], 0
            for w, c in sorted(changes.items()):
                row, end = rows[w], int(ends[w])
                start, size = int(self.sizes[row, 1:c].sum()), int(self.sizes[row, c])
                made += [ids[done : end - len(self.ids[row])], self.others[row][start : start + size]]
                done = end
            all_ids = b"".join([*made, ids[done:]]) if made else ids
            lengths.append(len(all_ids) // 4)
            sums.append(zlib.crc32(all_ids))
        back = self.unmark(b"".join(map(self.raw.__getitem__, rows)))
        return [s for s, _ in found], lengths, sums, back == text.encode()

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a whole text."""
        _, found = self.nbest(text)
        parts, out = self.parts(text), []
        choices = {w: self.search(parts[w], self.n) for _, changes in found for w in changes}
        rows = self.rows(text)
        for score, changes in found:
            ids: list[int] = []
            for w, row in enumerate(rows):
                ids += choices[w][changes[w]][1] if w in changes else np.frombuffer(self.ids[row], "<u4").tolist()
            out.append((score, ids))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return self.unmark(b"".join(self.bytes_of[i] for i in ids)).decode("utf-8", "replace")

    def unmark(self, raw: bytes) -> bytes:
        return raw[1:] if self.dummy and raw[:1] == b" " else raw


_LATTICES: dict[tuple[str, int], Lattice] = {}


def lattice(path: str, n: int) -> Lattice:
    """This worker's lattice for a model file."""
    if (path, n) not in _LATTICES:
        _LATTICES[path, n] = Lattice(path, n)
    return _LATTICES[path, n]


def _encode(path: str, n: int):
    def run(batches):
        model = lattice(path, n)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                rows = []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    scores, lengths, sums, same = model.digests(text or "")
                    rows.append((lengths[0], sums[0], scores, lengths, sums, same))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
                made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *made], names=["doc_id", "n_pieces", "ids_crc32", "scores", "nbest_pieces", "nbest_crc32", "round_trip"])

    return tidied(run)


def encode(docs: DataFrame, path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, scores, nbest_pieces, nbest_crc32, round_trip) for each row of docs.

    n_pieces and ids_crc32 are of the best segmentation's ids (little-endian unsigned 32-bit); scores has the up to n best
    sums of piece scores, best first, and nbest_pieces and nbest_crc32 each of these segmentations' number and checksum of ids; round_trip says that
    the best ids decode to the row's own text, so it is false for one with a literal blank mark. A null or empty text has no
    pieces and the one score 0. Repeated rows give repeated results, a null id stays null, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(path, n), "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, nbest_pieces array<long>, nbest_crc32 array<long>, round_trip boolean")


def _segment(path: str, n: int):
    def run(batches):
        model = lattice(path, n)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets, 1 << 18):
                docs, ranks, scores, ids = [], [], [], []
                for doc, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                    for rank, (score, pieces) in enumerate(model.segmentations(text or "")):
                        docs.append(doc)
                        ranks.append(rank)
                        scores.append(score)
                        ids.append(pieces)
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "rank", "score", "ids"])

    return tidied(run)


def segment(docs: DataFrame, path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rank, score, ids): a row for each of the up to n best segmentations of each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_segment(path, n), "doc_id long, rank int, score double, ids array<int>")


def _decode(path: str):
    def run(batches):
        model = lattice(path, 1)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tidied(run)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of piece ids; null ids give a null text."""
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path), "doc_id long, text string")
