"""Encoding and decoding with SentencePiece vocabularies of the merge type.

Symbols start as single characters. An agenda holds each adjacent pair whose
join is a piece, best score first and leftmost first among equals; the best
pair is joined, its neighbours enter the agenda, until the agenda is empty.
Where no piece has a space mark after another character, no join can cross the
start of a word's space marks, so words are encoded one by one. A vocabulary
with such a piece is encoded text by text.

Symbols are numbers, and a pair is looked up in a sorted array. Words of up to
``SHORT`` characters that a batch brings new are encoded together, a row of a
matrix each, whose least rank is its agenda's head; they stay in a cache of two
generations. Longer ones have an agenda of their own, about 30 bytes a
character, and aren't kept.

Words that were not in the cache, and every ``SHARE``-th whole text, are also
encoded by the sentencepiece library, and any difference raises. Ids come back
through the library's ``decode``.

Cases: null is the empty text, which has no ids; repeated rows are encoded
alike; equal scores are joined from the left; an empty table gives an empty
result; extra columns are ignored, whatever their names; a very long text is
encoded whole, word by word.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shared import ship

MARK = "▁"
#: Words in each of the two generations of a worker's cache, each no longer than ``SHORT``.
CACHE_WORDS = 250_000
#: Bytes of text that are split into words at once.
SLICE = 1 << 20
#: Characters of a word up to which it is encoded with others and kept.
SHORT = 48
#: Of how many whole texts one is encoded by the library as well.
SHARE = 8
NO_PAIR = np.iinfo(np.int32).max
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceModel:
    """A vocabulary file, read once a worker."""

    _open: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2:
            raise ValueError("the vocabulary isn't of the merge type")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with escaped spaces is supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.names = [str(i) for i in range(len(proto.pieces))]
        self._number({p.piece: p.score for p in proto.pieces if p.type == NORMAL}, len(proto.pieces))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _number(self, scores: dict[str, float], n: int) -> None:
        """Symbols as numbers, a piece's being its id, and the table of pairs whose join is a piece.

        Characters that are no piece have ``n`` and their code point as number.
        """
        self.n_pieces = n
        self.of_char = np.arange(0x110000, dtype=np.int32) + n
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        rank_of = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        number = lambda x: int(self.of_char[ord(x)]) if len(x) == 1 else self.ids.get(x)
        pairs = {
            left << 32 | right: (rank_of[score], self.ids[p])
            for p, score in scores.items() for k in range(1, len(p)) if (left := number(p[:k])) is not None and (right := number(p[k:])) is not None
        }
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.ranks, self.joins = (np.array([pairs.get(k, (NO_PAIR, 0))[i] for k in self.keys.tolist()], np.int32) for i in range(2))

    @classmethod
    def open(cls, path: str) -> PieceModel:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def numbers(self, text: str) -> np.ndarray:
        """The symbols of the characters of a text whose spaces are already marks."""
        return self.of_char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, -1 where its join is no piece."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(self.keys.searchsorted(wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def agenda(self, text: str) -> np.ndarray:
        """The symbols that are left of a text of any length."""
        first = self.numbers(text)
        at = self.look_up(first[:-1], first[1:])
        found = np.flatnonzero(at >= 0)
        # those there at the start lie sorted in an array, those that joins bring on a heap; an entry is rank and place
        start = np.sort(self.ranks[at[found]].astype(np.int64) << 32 | found)
        del at, found
        n = len(first)
        symbols, left, right = array("i", first.tobytes()), array("i", range(-1, n - 1)), array("i", range(1, n + 1))
        right[n - 1] = -1
        heap: list[int] = []
        keys, ranks, joins = self._lists()
        size, none, next_ = len(keys), -1, 0

        def pair(i: int, j: int) -> int:
            wanted = symbols[i] << 32 | symbols[j]
            k = bisect_left(keys, wanted)
            return k if k < size and keys[k] == wanted else none

        first_left = int(start[0]) if len(start) else none
        while first_left != none or heap:
            if heap and (first_left == none or heap[0] < first_left):
                entry = heapq.heappop(heap)
            else:
                entry, next_ = first_left, next_ + 1
                first_left = int(start[next_]) if next_ < len(start) else none
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = right[i] if symbols[i] >= 0 else none
            if j < 0 or (k := pair(i, j)) < 0 or ranks[k] != rank:
                continue
            symbols[i], symbols[j] = joins[k], none
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                if (k := pair(i, after)) >= 0:
                    heapq.heappush(heap, ranks[k] << 32 | i)
            before = left[i]
            if before >= 0 and (k := pair(before, i)) >= 0:
                heapq.heappush(heap, ranks[k] << 32 | before)
        out = np.frombuffer(symbols, np.int32)
        return out[out >= 0]

    def _lists(self) -> tuple[array, array, array]:
        """The table of pairs as arrays whose items are quick to read one by one."""
        if not hasattr(self, "_read"):
            self._read = array("q", self.keys.tobytes()), array("i", self.ranks.tobytes()), array("i", self.joins.tobytes())
        return self._read

    def agendas(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of some short words, whose agendas are worked off together.

        They come as one array and the place where each word's begin, with a last one for the end.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        which, counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if len(part) and sizes[part[0]]:
                symbols = self.numbers("".join(words[i] for i in part)).reshape(len(part), -1)
                for done, left in self._joined(part, symbols):
                    which.append(done)
                    counts.append(np.full(len(done), left.shape[1]))
                    flat.append(left.ravel())
        # blocks of finished words, each of one length, go back to the words' order
        which, counts, flat = (np.concatenate(x) for x in (which, counts, flat))
        begins = np.cumsum(counts) - counts
        n = np.zeros(len(words), np.int64)
        n[which] = counts
        at = np.concatenate([[0], np.cumsum(n)])
        to = np.repeat(at[which] - begins, counts) + np.arange(len(flat))
        out = np.empty(len(flat), np.int32)
        out[to] = flat
        return out, at

    def _joined(self, names: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows, by name, with their symbols, as their agendas become empty; all rows are of one length at any time."""
        places = self.look_up(symbols[:, :-1], symbols[:, 1:])
        ranks = np.where(places >= 0, self.ranks[places], NO_PAIR)
        while symbols.shape[1] > 1 and len(names):
            best = ranks.argmin(axis=1)
            open_ = ranks[np.arange(len(names)), best] < NO_PAIR
            yield names[~open_], symbols[~open_]
            names, symbols, ranks, places, best = names[open_], symbols[open_], ranks[open_], places[open_], best[open_]
            rows, n = np.arange(len(names)), symbols.shape[1] - 1
            symbols[rows, best] = self.joins[places[rows, best]]
            # the joined pair's second symbol leaves each row, and with it one of the pairs
            columns = np.arange(n)
            symbols = np.take_along_axis(symbols, columns + (columns > best[:, None]), 1)
            columns = columns[: n - 1]
            shift = columns + (columns >= best[:, None])
            ranks, places = np.take_along_axis(ranks, shift, 1), np.take_along_axis(places, shift, 1)
            for at in (best - 1, best):
                r = np.flatnonzero((at >= 0) & (at < n - 1))
                c = at[r]
                new = self.look_up(symbols[r, c], symbols[r, c + 1])
                places[r, c], ranks[r, c] = new, np.where(new >= 0, self.ranks[new], NO_PAIR)
        yield names, symbols

    def to_ids(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose symbols begin at ``at``, and where each word's begin.

        A character that is no piece has its bytes' ids, or the unknown one, once for neighbours.
        """
        odd = np.flatnonzero(symbols >= self.n_pieces)
        if not len(odd):
            return symbols, at
        n = np.ones(len(symbols), np.int64)
        if self.bytes:
            raws = [chr(i - self.n_pieces).encode() for i in symbols[odd].tolist()]
            n[odd] = [len(r) for r in raws]
            ids = np.repeat(symbols, n)
            ids[ids >= self.n_pieces] = [self.bytes[b] for r in raws for b in r]
        else:
            begins = np.zeros(len(symbols) + 1, bool)
            begins[at] = True
            n[odd[1:][(np.diff(odd) == 1) & ~begins[odd[1:]]]] = 0
            ids = np.repeat(np.where(symbols >= self.n_pieces, self.unknown, symbols), n)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(n)])[at]

    def words(self, text: str) -> list[str]:
        """The text cut at spaces, each word without the first of its space marks; or the text as one word."""
        if not text:
            return []
        if not self.by_word or not self.bytes or not self.prefix:
            return [text.replace(" ", MARK)]
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; new words, and whole texts one in ``SHARE``, are checked against the library."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, older, split = self.cache, self.older, [self.words(t) for t in texts]
        new, long_ = [], []
        for w in set().union(*split):
            if w not in cache:
                if w in older:
                    cache[w] = older[w]
                else:
                    (new if len(w) < SHORT else long_).append(w)
        cache.update(zip(new, self._checked(new, *self.agendas([self.prefix + w for w in new])), strict=True))
        once = {}
        for w in long_:
            symbols = self.agenda(self.prefix + w)
            once[w] = self._checked([w], symbols, np.array([0, len(symbols)]))[0]
        of = (lambda w: once[w] if w in once else cache[w]) if once else cache.__getitem__
        out = [np.frombuffer(b"".join(map(of, ws)), np.int32) for ws in split]
        self.check_texts(texts, out)
        return out

    def _checked(self, words: list[str], symbols: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids, of four bytes each, of words whose symbols begin at ``at``; raises unless the library's are the same."""
        ids, at = self.to_ids(symbols, at)
        raw, bounds = ids.tobytes(), (at * 4).tolist()
        found = [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        for w, own, known in zip(words, found, self.library.encode(words, num_threads=1), strict=True):
            if own != array("i", known).tobytes() and w:  # a mark alone can't be given to the library
                raise AssertionError(f"{w[:100]!r}: {np.frombuffer(own, np.int32)[:20]} here, {known[:20]} in the library")
        return found

    def check_texts(self, texts: list[str], found: list[np.ndarray]) -> None:
        """The same for whole texts, one of ``SHARE`` by its checksum."""
        drawn = [i for i, t in enumerate(texts) if crc32(t.encode()) % SHARE == 0]
        for i, ids in zip(drawn, self.library.encode([texts[i] for i in drawn], num_threads=1), strict=True):
            if not np.array_equal(found[i], np.array(ids, np.int32)):
                raise AssertionError(f"{texts[i][:100]!r}: other ids in the library")


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts, in the second column, take about ``SLICE`` bytes."""
    from_, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
        if i > from_ and size + n > SLICE:
            yield b.slice(from_, i - from_)
            from_, size = i, 0
        size += n
    if b.num_rows > from_:
        yield b.slice(from_)


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the whole text's ids, without begin and end."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel.open(model)
        for b in (x for batch in batches for x in _slices(batch)):
            rows = m.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["id", "ids"])

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(encode, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``id, text``: ids back to text."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel.open(model)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([m.library.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    ship(encoded.sparkSession)
    return encoded.mapInArrow(decode, f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the number of ids, their digest and the digest of the text decoded from them, in one pass."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel.open(model)
        for b in (x for batch in batches for x in _slices(batch)):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = m.encode_batch(texts)
            coded = [hashlib.sha256(",".join(map(m.names.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
            n = [len(x) for x in ids]
            back = [hashlib.sha256(m.library.decode(x).encode() if len(x) else b"").hexdigest() for x in ids]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(digest, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
