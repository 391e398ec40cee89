"""Encoding and decoding with a SentencePiece model of merge type, by a table of prefixes.

Greedy merging leaves one last piece for every prefix of a text.  Tokens stand beside each other in an
encoding just when merging the two of them alone gives them back, so the last piece of a prefix is the
one match that ends there and is compatible with the last piece of what is before it.  An automaton
over the vocabulary gives the matches, a memo holds which pairs are compatible, and the ids are read
off the table from its end.

Blocks of texts are cut where no piece of the vocabulary could reach across, each distinct unit gets
its ids from its prefix table once, and a text's ids are put together from those of its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from . import words as W
from .shared import bounded_batches
from .token_ids import TokenTable

#: Fixed values of the file format: the sign for a space, and what stands for an unknown piece and for a bad byte in a decoded text.
SPACE, UNKNOWN, BAD_BYTE = "▁", " ⁇ ", "�"
_MEMO = 1_000_000
_CONTINUES = np.array([0x80 <= c < 0xC0 for c in range(256)], bool)
_models: dict[str, "PieceTable"] = {}


def default_model() -> str:
    """Path of the 32k model with byte fallback of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte pieces of a model, with spaces written as spaces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" a\tﬁ  ") != f"{SPACE * 2}a\tﬁ{SPACE * 2}":
            raise ValueError("only models without normalisation, with a space put before a text, are supported")
        ids = range(sp.get_piece_size())
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.surface = [sp.id_to_piece(i).replace(SPACE, " ") for i in ids]
        self.control = {i for i in ids if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.byte_of = {i: int(self.surface[i][3:5], 16) for i in ids if sp.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        if len(self.id_of_byte) != 256 or any(sp.is_unused(i) for i in ids):
            raise ValueError("only models with all byte pieces and no unused ones are supported")
        normal = [i for i in ids if i not in self.control and i not in self.byte_of and i != self.unknown]
        self.score = {self.surface[i]: sp.get_score(i) for i in normal}
        self.id = {self.surface[i]: i for i in normal}
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best score first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            found = [(-self.score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two stay as they are when merged by themselves; ``left`` may be empty."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= _MEMO:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a text, characters outside the vocabulary among them."""
        last = [""] * (len(unit) + 1)
        for at, piece in self._matches(unit):
            if not last[at] and self.compatible(last[at - len(piece)], piece):
                last[at] = piece
        out, at = [], len(unit)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _matches(self, unit: str) -> Iterator[tuple[int, str]]:
        """End and text of each piece in the unit by ends, and every single character."""
        done = 0
        for at, piece in self.automaton.iter(unit):
            while done < at:
                done += 1
                yield done, unit[done - 1]
            yield at + 1, piece
        while done < len(unit):
            done += 1
            yield done, unit[done - 1]

    def ids(self, unit: str) -> list[int]:
        """The ids of a text that has its spaces already, without begin and end; other characters give a byte piece for each of their bytes."""
        out: list[int] = []
        for piece in self.pieces(unit):
            known = self.id.get(piece)
            out += [known] if known is not None else [self.id_of_byte[b] for b in piece.encode()]
        return out

    def text(self, ids: list[int]) -> str:
        """The text of any ids: control pieces are empty, bytes that make no character give U+FFFD each, a first space goes."""
        out, run, first = [], bytearray(), True
        for i in [*ids, self.begin]:  # a control piece ends a last run of bytes
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_bytes_text(bytes(run)))
                run, first = bytearray(), False
            if i in self.control:
                continue
            piece = UNKNOWN if i == self.unknown else self.surface[i]
            out.append(piece[1:] if first and piece.startswith(" ") and i != self.unknown else piece)
            first = False
        return "".join(out)


def _bytes_text(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append(BAD_BYTE)
            at += 1
    return "".join(out)


class PieceTable(TokenTable):
    """Ids of units seen so far in this process, found by their prefix tables."""

    def __init__(self, path: str, limit: int = 1_000_000):
        self.vocabulary = v = Vocabulary(path)
        self.end_id, self.limit = v.end, limit
        self.joined = np.zeros((256, 256), bool)
        for piece in v.score:
            raw = np.frombuffer(piece.encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.joined[:, _CONTINUES] = True
        surface = [b"" if i in v.control else bytes([v.byte_of[i]]) if i in v.byte_of else p.encode() for i, p in enumerate(v.surface)]
        self.bytes_of = np.frombuffer(b"".join(surface), np.uint8)
        self.bytes_at = np.concatenate([[0], np.cumsum([len(x) for x in surface])])
        self._reset()

    def _learn(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Holds the ids of new units and returns the number of each."""
        ids = [self.vocabulary.ids(raw[s:e].decode()) for s, e in zip(start.tolist(), end.tolist())]
        base = self.size
        self._add(keys, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids]))
        return base + np.arange(len(keys))

    def encode(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts, each with begin and end, and the bounds of each text."""
        data, off = _spaced(block)
        cut = np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1
        start = np.union1d(cut, off[:-1][np.diff(off) > 0])
        end = np.append(start[1:], len(data)) if len(start) else start
        if self.size > self.limit:
            self._reset()
        key = W.span_hashes(data, start, end)
        at = self._look_up(key)
        missed = np.flatnonzero(self.key[at] != key)
        if len(missed):
            new, first, back = np.unique(key[missed], return_index=True, return_inverse=True)
            at[missed] = self._learn(new, data.tobytes(), start[missed[first]], end[missed[first]])[back]
        at = np.insert(at, np.searchsorted(start, off[1:]), 0)  # number 0 is the end id
        count = self.cut[at + 1] - self.cut[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.cut[at] - total[:-1], count) + np.arange(total[-1])]
        bounds = np.concatenate([[0], total[1:][at == 0]])
        ids = np.insert(ids, bounds[:-1], np.uint32(self.vocabulary.begin))
        return ids, bounds + np.arange(len(bounds))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts that the ids between bounds stand for."""
        v = self.vocabulary
        size = self.bytes_at[ids + 1] - self.bytes_at[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes_of[np.repeat(self.bytes_at[ids] - total[:-1], size) + np.arange(total[-1])]
        out = []
        unknown = W.sums(ids == v.unknown, bounds)
        for i in range(len(bounds) - 1):
            raw = data[total[bounds[i]] : total[bounds[i + 1]]].tobytes()
            try:
                raw.decode()
                whole = not unknown[i]
            except UnicodeDecodeError:
                whole = False
            if not whole:
                out.append(v.text(ids[bounds[i] : bounds[i + 1]].tolist()).encode())
            elif raw[:1] == b" " and next(k for k in ids[bounds[i] : bounds[i + 1]].tolist() if k not in v.control) not in v.byte_of:
                out.append(raw[1:])
            else:
                out.append(raw)
        return out


def _spaced(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a block's texts with a space put before each that isn't empty."""
    off = block.offsets
    filled = np.diff(off) > 0
    return np.insert(block.data, off[:-1][filled], np.uint8(0x20)), off + np.concatenate([[0], np.cumsum(filled)])


def piece_table(path: str) -> PieceTable:
    """The table of this process for a model file."""
    if path not in _models:
        _models[path] = PieceTable(path)
    return _models[path]


def _with_column(df: DataFrame, column: str, out: str, kind: DataType, make: Callable[[W.Block], pa.Array]) -> DataFrame:
    """``df`` and a column made from blocks of another; null counts as empty."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out} already")
    bounded_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
                texts = pc.replace_substring(texts, SPACE, " ")
            elif texts.null_count:
                texts = texts.fill_null(b"")
            for block in W.blocks(texts):
                part = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([*part.columns, make(block)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, kind)]))


def encode_documents(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with their ids, begin and end among them, as little-endian unsigned 32-bit integers in a binary column.

    A null or empty text gives begin and end.  Every row keeps its columns, whatever their names;
    ``out`` must be a new one.  A text of any length is encoded whole.
    """
    path = path or default_model()

    def make(block: W.Block) -> pa.Array:
        ids, bounds = piece_table(path).encode(block)
        raw = pa.py_buffer(ids.astype("<u4").tobytes())
        return pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), raw])

    return _with_column(docs, text, out, BinaryType(), make)


def decode_documents(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the texts of ids in the form that ``encode_documents`` gives; null or no ids give an empty text."""
    path = path or default_model()

    def make(block: W.Block) -> pa.Array:
        ids = np.frombuffer(block.data.tobytes(), "<u4").astype(np.int64)
        return pa.array([x.decode() for x in piece_table(path).decode(ids, block.offsets // 4)], pa.string())

    return _with_column(docs, ids, out, StringType(), make)


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; repeated and null ids keep their rows."""
    both = decode_documents(encode_documents(docs.select("doc_id", "text"), path=path).select("doc_id", "ids"), path=path)
    size = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
