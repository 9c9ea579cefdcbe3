"""SentencePiece encoding by an Aho-Corasick automaton and one Viterbi pass, and decoding.

All pieces form one automaton. It reads the text once; at each position it reports, along its output
links, every piece that ends there, and each relaxes the best score of that position. A character that no
piece covers falls back to its UTF-8 bytes, so decoding gives back the text exactly.

Pieces hold the word mark only at their start, so the best path of a text is that of its words in turn. The
distinct words of some texts are encoded once. Short ones take that pass together, position by position, along
the trie of the pieces; the sums and their order are those of the automaton's pass, so the paths are the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

MARK = "▁"
LONGEST_TOGETHER = 40
WORDS_AT_ONCE = 16_384
BYTES_AT_ONCE = 1_000_000
UNKNOWN_COST = 10.0
CODE_POINTS = 0x110000  # also stands for the end of a word


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores and ids, and the ids of the 256 byte pieces. Bounded by the tokenizer's size."""

    pieces: tuple[tuple[str, float, int], ...]
    bytes_: tuple[int, ...]

    @property
    def size(self) -> int:
        return max([i for _, _, i in self.pieces] + list(self.bytes_)) + 1


def load_vocabulary(model_file: str, *, scores: str = "zipf") -> Vocabulary:
    """Read a SentencePiece model with byte fallback, on the driver.

    ``scores``: "model" takes the stored ones (log probabilities of a unigram model); "zipf" turns the ranks
    that a BPE model stores into log probabilities by Zipf's law.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(p.get_piece_size())
    plain = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    if scores == "zipf":
        ranked = sorted(plain, key=lambda i: (-p.get_score(i), i))
        score = {i: -math.log(rank + 2.0) for rank, i in enumerate(ranked)}
    else:
        score = {i: p.get_score(i) for i in plain}
    byte_ids = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces")
    return Vocabulary(tuple((p.id_to_piece(i), score[i], i) for i in plain), tuple(byte_ids[b] for b in range(256)))


@dataclass
class Codec:
    """Encoder and decoder of one vocabulary in one process."""

    vocabulary: Vocabulary

    def __post_init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in self.vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.single = {piece for piece, _, _ in self.vocabulary.pieces if len(piece) == 1}
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece, _, _ in self.vocabulary.pieces)
        self.unknown = min((s for _, s, _ in self.vocabulary.pieces), default=0.0) - UNKNOWN_COST
        self.table: list[bytes] = [b""] * self.vocabulary.size
        for piece, _, i in self.vocabulary.pieces:
            self.table[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.vocabulary.bytes_):
            self.table[i] = bytes([b])
        self.byte_ids = np.array(self.vocabulary.bytes_, dtype=np.int32)
        self.mark = self.byte_ids[list(MARK.encode())].tolist()
        self.is_byte = np.zeros(self.vocabulary.size, dtype=bool)
        self.is_byte[list(self.vocabulary.bytes_)] = True
        self._make_trie()

    def _make_trie(self) -> None:
        """The trie of the pieces: node 0 is the root, edge e leads to node e + 1 and is found by (node, character)."""
        edges: dict[int, int] = {}
        ends: dict[int, tuple[float, int]] = {}
        for piece, score, i in self.vocabulary.pieces:
            node = 0
            for c in piece:
                node = edges.setdefault(node * (CODE_POINTS + 1) + ord(c), len(edges) + 1)
            ends[node] = score, i
        self.edges = pd.Index(np.fromiter(edges, dtype=np.int64, count=len(edges)))
        self.node_score, self.node_piece = np.zeros(len(edges) + 1), np.full(len(edges) + 1, -1, dtype=np.int32)
        self.node_inner = np.zeros(len(edges) + 1, dtype=bool)
        for node, (score, i) in ends.items():
            self.node_score[node], self.node_piece[node] = score, i
        self.node_inner[self.edges.to_numpy() // (CODE_POINTS + 1)] = True
        self.node_piece[0], self.node_inner[0] = -1, False  # also stands for an edge that was not found

    def best_path(self, text: str) -> list[int]:
        """Ids of the segmentation with the greatest sum of scores; of equal ones the one with longer last pieces."""
        n = len(text)
        best: list[float] = [0.0] + [-math.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0

        def fall_back(until: int) -> None:
            for at in range(done, until):
                if text[at] not in self.single and best[at] + self.unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + self.unknown, (at, -1)

        for last, (length, score, i) in self.automaton.iter(text):
            if last > done:
                fall_back(last)
                done = last
            end = last + 1
            begin = end - length
            reached = best[begin] + score
            if reached > best[end] or reached == best[end] and length > end - back[end][0]:
                best[end], back[end] = reached, (begin, i)
        fall_back(n)
        ids: list[int] = []
        while n:
            begin, i = back[n]
            ids.extend([i] if i >= 0 else [self.vocabulary.bytes_[b] for b in reversed(text[begin:n].encode("utf-8", "surrogatepass"))])
            n = begin
        return ids[::-1]

    def best_paths(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short words, longest first, and how many each word has. None is empty or holds a word mark.

        Positions lie row by row: row j holds the j-th position of every word with j characters at least, so
        a position and the next of its word are as far apart as the row is long.
        """
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        letters = np.frombuffer("".join(words.to_pylist()).replace(" ", MARK).encode("utf-32-le"), dtype=np.uint32)
        first = np.cumsum(lengths) - lengths
        longest = int(lengths[0])
        width = np.searchsorted(-lengths, -np.arange(longest + 2), side="right")
        row = np.concatenate(([0], np.cumsum(width[:-1])))
        step = np.repeat(width[:-1], width[:-1])
        chars = np.full(row[-1], CODE_POINTS, dtype=np.int64)
        for j in range(longest):
            chars[row[j] : row[j] + width[j + 1]] = letters[first[: width[j + 1]] + j]

        matches: list[tuple[np.ndarray, ...]] = []  # by length: begin, end, score, id, and the borders of the rows of begins
        begin = np.flatnonzero(chars < CODE_POINTS)
        at, node = begin, np.zeros(len(begin), dtype=np.int64)
        while len(begin):
            node = self.edges.get_indexer(node * (CODE_POINTS + 1) + chars[at]) + 1
            score, piece = self.node_score[node], self.node_piece[node]
            end = at + step[at]
            if not matches:
                score = np.where(piece < 0, self.unknown, score)
                found = slice(None)
            else:
                found = np.flatnonzero(piece >= 0)
            matches.append((begin[found], end[found], score[found], piece[found], np.searchsorted(begin[found], row)))
            further = np.flatnonzero(self.node_inner[node])
            begin, at, node = begin[further], end[further], node[further]

        best = np.full(row[-1], -np.inf)
        best[: width[0]] = 0.0
        back, taken = np.zeros(row[-1], dtype=np.int64), np.zeros(row[-1], dtype=np.int32)
        for j in range(longest):
            for begin, end, score, piece, borders in matches:
                some = slice(borders[j], borders[j + 1])
                begin, end = begin[some], end[some]
                reached = best[begin] + score[some]
                better = np.flatnonzero(reached > best[end])  # of equal ones the longer piece came first
                end = end[better]
                best[end], back[end], taken[end] = reached[better], begin[better], piece[some][better]

        word, at = np.arange(len(words)), row[lengths] + np.arange(len(words))
        n_steps, steps = np.zeros(len(words), dtype=np.int64), []
        while len(word):
            n_steps[word] += 1
            steps.append((word, taken[at], back[at]))
            going = np.flatnonzero(back[at] >= width[0])
            word, at = word[going], back[at][going]
        last = np.cumsum(n_steps) - 1
        ids, begins = np.empty(n_steps.sum(), dtype=np.int32), np.empty(n_steps.sum(), dtype=np.int64)
        for k, (word, piece, begin) in enumerate(steps):
            ids[last[word] - k], begins[last[word] - k] = piece, begin

        unknown = chars[begins[ids < 0]]
        size = np.ones(len(ids), dtype=np.int64)
        size[ids < 0] += (unknown >= 0x80).astype(int) + (unknown >= 0x800) + (unknown >= 0x10000)
        n_ids = np.diff(np.concatenate(([0], np.cumsum(size)))[last + 1], prepend=0)
        ids = np.repeat(ids, size)
        ids[ids < 0] = self.byte_ids[np.frombuffer("".join(map(chr, unknown.tolist())).encode(), dtype=np.uint8)]
        return ids, n_ids

    def _path(self, word: str) -> np.ndarray:
        """Ids of any one word. A word mark in the text itself is written as its bytes."""
        ids: list[int] = []
        for k, part in enumerate(word.split(MARK)):
            if k:
                ids.extend(self.mark)
            ids.extend(self.best_path(part.replace(" ", MARK)))
        return np.array(ids, dtype=np.int32)

    def _paths(self, words: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of words that are not empty, in any order, and the place of each word in it."""
        lengths = pc.utf8_length(words).to_numpy()
        alone = (lengths > LONGEST_TOGETHER) | pc.match_substring(words, MARK).to_numpy(zero_copy_only=False)
        order = np.argsort(np.where(alone, 0, -lengths), kind="stable")
        n_short = len(words) - int(alone.sum())
        paths = [self.best_paths(words.take(pa.array(order[at : min(at + WORDS_AT_ONCE, n_short)]))) for at in range(0, n_short, WORDS_AT_ONCE)]
        rest = [self._path(word) for word in words.take(pa.array(order[n_short:])).to_pylist()]
        ids = np.concatenate([np.empty(0, dtype=np.int32), *(i for i, _ in paths), *rest])
        sizes = np.concatenate([[0], *(n for _, n in paths), np.array([len(i) for i in rest], dtype=np.int64)])
        place = np.empty(len(words), dtype=np.int32)
        place[order] = np.arange(len(words))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(ids)), place

    def _encode_some(self, texts: pa.Array) -> pa.ListArray:
        spaced = _spaced(texts)
        borders = _offsets(spaced)
        letters = np.frombuffer(spaced.buffers()[2] or b"", dtype=np.uint8)[borders[0] : borders[-1]]
        borders = borders - borders[0]
        begins = np.zeros(len(letters) + 1, dtype=bool)
        if self.by_word:  # spaces and what follows up to the next space
            begins[:-1] = letters == 0x20
            begins[1:-1] &= letters[:-1] != 0x20
        begins[borders] = True
        of_words = np.flatnonzero(begins).astype(np.int32)
        words = pa.StringArray.from_buffers(len(of_words) - 1, pa.py_buffer(of_words), pa.py_buffer(letters)).dictionary_encode()
        paths, place = self._paths(words.dictionary)
        ids = paths.take(pa.array(place[words.indices.to_numpy()]))
        return pa.ListArray.from_arrays(ids.offsets.take(pa.array(np.searchsorted(of_words, borders))), ids.values)

    def encode_all(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """``encode`` of all texts of an Arrow array, in turn: of ``BYTES_AT_ONCE`` bytes, or of one text, at a time."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            room = (sizes[at - 1] if at else 0) + BYTES_AT_ONCE
            until = max(int(np.searchsorted(sizes, room, side="right")), at + 1)
            yield self._encode_some(texts.slice(at, until - at))
            at = until

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, with a space put before it; none for null and empty texts.

        Spaces become the word mark. A word mark in the text itself is written as its bytes.
        """
        return self._encode_some(pa.array([text], pa.string())).values.to_numpy()

    def decode_all(self, ids: pa.ListArray) -> pa.LargeBinaryArray:
        """The bytes of each list of ids from ``encode_all``, with the space that was put before."""
        pieces = pa.array(self.table, pa.large_binary()).take(ids.values)
        ends = _offsets(pieces)[_offsets(ids)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pieces.buffers()[2]])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids from ``encode``; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]

    def count_bytes(self, ids: pa.ListArray) -> np.ndarray:
        """How many ids of each list are byte pieces."""
        until = np.concatenate(([0], np.cumsum(self.is_byte[ids.values.to_numpy()], dtype=np.int64)))
        return np.diff(until[_offsets(ids)])


def _offsets(array: pa.Array) -> np.ndarray:
    """Where the values of an array of lists, texts or bytes begin and end."""
    large = pa.types.is_large_binary(array.type)
    return np.frombuffer(array.buffers()[1], dtype=np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1]


def _spaced(texts: pa.Array) -> pa.Array:
    """Each text with a space before it; null and empty texts are empty."""
    texts = pc.fill_null(texts, "")
    return pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))


def _codec(shared) -> Codec:
    """The codec of this worker process, made once."""
    if getattr(_codec, "of", None) != shared.id:
        _codec.of, _codec.made = shared.id, Codec(shared.value)
    return _codec.made


class _Shared:
    """A broadcast vocabulary with an id that tells workers when to rebuild."""

    def __init__(self, spark, vocabulary: Vocabulary) -> None:
        self.broadcast = spark.sparkContext.broadcast(vocabulary)
        self.id = hashlib.sha256(repr((vocabulary.pieces, vocabulary.bytes_)).encode()).hexdigest()

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encoded(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, piece_ids, n_bytes (fallback pieces) and round_trip.

    ``round_trip`` tells that decoding gives the text again. Null text counts as empty: no pieces.
    Repeated rows get a row each; only the named columns are read. A task holds the ids of
    ``BYTES_AT_ONCE`` bytes of text, or of one text, at a time.
    """
    shared = _Shared(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_pieces", "piece_ids", "n_bytes", "round_trip"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts, at = batch.column("text").cast(pa.string()), 0
            for ids in codec.encode_all(texts):
                part = slice(at, at + len(ids))
                same = pc.equal(codec.decode_all(ids), _spaced(texts[part]).cast(pa.large_binary()))
                n_pieces = np.diff(_offsets(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], pa.array(n_pieces), ids, pa.array(codec.count_bytes(ids)), same], names)
                at = part.stop

    types = [rows.schema["doc_id"].dataType, LongType(), ArrayType(IntegerType()), LongType(), BooleanType()]
    return rows.mapInArrow(encode, StructType([StructField(n, t) for n, t in zip(names, types)]))


def decoded(rows: DataFrame, vocabulary: Vocabulary, *, ids_col: str = "piece_ids") -> DataFrame:
    """``rows`` with a column ``text`` decoded from their ids; null ids give null."""
    shared = _Shared(rows.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        codec = _codec(shared)
        return ids.map(lambda i: None if i is None else codec.decode(np.asarray(i)))

    return rows.withColumn("text", decode(F.col(ids_col)))
