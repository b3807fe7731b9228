"""SentencePiece BPE with byte fallback: vectorised merge rounds over flat symbol arrays, and the way back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail.llm.common import WordMemory, in_steps, tidied

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Distinct words remembered by one task, some 110 MB; newer ones go when it is full, which changes no result.
REMEMBERED = 300_000
#: A word ends where a marked space follows another character; no piece of the vocabulary reaches over such a place.
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """The vocabulary of a model file as arrays; the file is read once by each Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        self.pieces = [library.id_to_piece(i) for i in ids]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in ids]
        plain = [i for i in ids if not special[i] and not library.is_unused(i)]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("this vocabulary has pieces that reach over the end of a word")
        self.id_of = {self.pieces[i]: i for i in plain}
        self.byte_id = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.raw = [b"" if special[i] else self.pieces[i].replace(SPACE, " ").encode() for i in ids]
        for b, i in enumerate(self.byte_id):
            self.raw[i] = bytes([b])
        self.decimal = [str(i).encode() for i in ids]
        # Characters that only occur inside longer pieces take part in merges, too: they get ids after the vocabulary.
        inner = sorted({c for p in self.id_of for c in p if c not in self.id_of})
        self.symbols = self.id_of | {c: len(self.pieces) + k for k, c in enumerate(inner)}
        self.size = len(self.pieces) + len(inner) + 1
        order = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-library.get_score(i), i)))}
        pairs = []
        for piece, i in self.id_of.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left * self.size + right, order[i], i))
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair (lower first), NONE where the two make no piece; and the table's row."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.ranks[at], NONE), at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has, as merging its best-ranked leftmost pair again and again gives them.

        One round finds every word's lowest pair rank and merges that pair in all words at once: at every place where it
        does not overlap itself, from the left, unless a pair that such a merge makes ranks lower still; then only at the
        leftmost place. Words in which nothing merges leave the arrays.
        """
        text = "".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        table = {c: self.symbols.get(c, -1) for c in set(text)}
        symbol = np.fromiter(map(table.__getitem__, text), dtype=np.int64, count=len(text))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        # A character without a piece is carried as its code point below zero.
        symbol = np.where(symbol < 0, -1 - points, symbol)
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        rank, row = self._ranks(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(symbol)))
            least = np.minimum.reduceat(rank, starts)
            busy = np.repeat(least < NONE, sizes)
            if not busy.all():
                done_symbol.append(symbol[~busy])
                done_word.append(word[~busy])
                symbol, word, rank, row = symbol[busy], word[busy], rank[busy], row[busy]
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(symbol):
                    break
            symbol, word, rank, row = self._merged(symbol, word, rank, row, np.repeat(least, sizes))
        symbol, word = np.concatenate(done_symbol or [symbol]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return self._with_bytes(symbol[order], word[order], len(words))

    def _merged(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, row: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(symbol)
        at = np.flatnonzero(rank == least)
        new_run = np.append(True, (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]]))
        run_start = at[new_run][np.cumsum(new_run) - 1]
        at = at[(at - run_start) % 2 == 0]
        made = self.merged[row[at]]
        after = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 < n) & (word[after] == word[at]), symbol[after], -1)
        before = np.maximum(at - 1, 0)
        left = np.where((at > 0) & (word[before] == word[at]), symbol[before], -1)
        follows = np.append(False, (np.diff(at) == 2) & (word[at[1:]] == word[at[:-1]]))
        left = np.where(follows, np.append(-1, made[:-1]), left)
        best = np.minimum(self.rank(made, right)[0], self.rank(left, made)[0])
        first = np.append(True, word[at[1:]] != word[at[:-1]])
        group = np.cumsum(first) - 1
        early = np.minimum.reduceat(best, np.flatnonzero(first)) < least[at[first]]
        keep = first | ~early[group]
        at, made = at[keep], made[keep]
        symbol[at] = made
        stay = np.ones(n, dtype=bool)
        stay[at + 1] = False
        symbol, word, rank, row = symbol[stay], word[stay], rank[stay], row[stay]
        # Only the pairs on either side of a merged one are new.
        at = at - np.arange(len(at))
        new = np.concatenate([at, at[at > 0] - 1])
        rank[new], row[new] = self._ranks(symbol, word, new)
        return symbol, word, rank, row

    def _ranks(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the pair that begins at each place, NONE at a word's end; and its row."""
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, row = self.rank(symbol[at], symbol[after])
        return np.where((at + 1 < len(symbol)) & (word[at] == word[after]), rank, NONE), row

    def _with_bytes(self, symbol: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the ids of their UTF-8 bytes."""
        lost = np.flatnonzero((symbol < 0) | (symbol >= len(self.pieces)))
        if not len(lost):
            return symbol, np.bincount(word, minlength=n)
        inner = {i: c for c, i in self.symbols.items() if i >= len(self.pieces)}
        spelled = [self.byte_id[list((chr(-1 - s) if s < 0 else inner[s]).encode("utf-8", "surrogatepass"))] for s in symbol[lost].tolist()]
        sizes = np.ones(len(symbol), dtype=np.int64)
        sizes[lost] = [len(s) for s in spelled]
        flat = np.repeat(symbol, sizes)
        flat[np.repeat(np.isin(np.arange(len(symbol)), lost), sizes)] = np.concatenate(spelled)
        return flat, np.bincount(np.repeat(word, sizes), minlength=n)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for; a marked space is a space."""
        return b"".join(map(self.raw.__getitem__, ids))


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


class Memory:
    """What encoding and decoding a text needs of each of its words: the ids in decimal, joined by commas, and the bytes
    that these ids decode to."""

    def __init__(self, path: str):
        self.pieces = model(path)
        self.memory = WordMemory(self._learn, REMEMBERED)

    def prepare(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids in decimal, joined by commas, and the bytes they decode to; a null or empty text has none.

        Words end at a space between other characters. Texts with other spacing, or with marked spaces, are cut where a
        marked space follows another character.
        """
        parts = [self._words(t) if t else [] for t in texts]
        ids, raw = known if len(known := self.memory.prepare(parts)) == 2 else ({}, {})
        return [(b",".join(map(ids.__getitem__, ps)), b"".join(map(raw.__getitem__, ps))) for ps in parts]

    @staticmethod
    def _words(text: str) -> list[str]:
        words = text.split(" ")
        if "" in words or SPACE in text:
            return [w[1:] for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]
        return words

    def _learn(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        spelled, raw = [], []
        for begin in range(0, len(words), 50_000):
            ids, counts = self.pieces.encode_words([SPACE + w for w in words[begin:begin + 50_000]])
            ids, ends = ids.tolist(), np.cumsum(counts).tolist()
            each = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            spelled += [b",".join(map(self.pieces.decimal.__getitem__, one)) for one in each]
            raw += map(self.pieces.decode, each)
        return spelled, raw


@cache
def memory(path: str) -> Memory:
    return Memory(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and decoded from its ids.

    A null text counts as empty: no ids, decoded to the empty text. Rows come out one for one, null and repeated ids too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            out = []
            for ids, raw in memory(path).prepare(batch.column(1).to_pylist()):
                decoded = raw[1:]  # the space put in front of the text goes
                out.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, ids, decoded = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: tidied(run(batches), memory(path).memory), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` with ``ids`` (array of int) after their own columns; ``ids`` must not be one of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            ids = [list(map(int, found.split(b","))) if found else [] for found, _ in memory(path).prepare(column.to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(lambda batches: tidied(run(batches), memory(path).memory), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts = [pieces.decode(x or []).removeprefix(b" ").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
