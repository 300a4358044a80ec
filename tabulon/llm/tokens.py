"""Encoding and decoding of whole corpora with a public tokenizer (problem 7).

The tokenizers library encodes; texts reach it over Arrow batches. The split of a byte-level vocabulary never joins a
text across a single space between two other characters, so with such a file a text is cut there and each piece is
encoded once per Python worker; what repeats is taken from a bounded table. The result is byte for byte that of
encoding the whole text. Which split a file has is read from the file; with any other, and with files of other
libraries, whole texts are encoded.

Defined cases: a null and an empty text both give an empty list of ids; a text with special tokens' strings is
ordinary text; very long texts are encoded whole; repeated rows give repeated results; no other column is looked at.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the files of the public tokenizers lie on every machine.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"

#: Pieces kept per worker before the table starts anew; bounds its memory at about 60 MB.
MOST_PIECES = 300_000

#: Fixed value: the split of the public byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNIT = regex.compile(SPLIT)
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, PieceTable | Whole] = {}


class Units(dict):
    """From one unit of the byte-level split to its ids, encoded by the library when it is first met."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, unit: str) -> bytes:
        ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        packed = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(self) >= MOST_PIECES:
            self.clear()
        if len(unit) <= 64:
            self[unit] = packed
        return packed


def _byte_level(path: str) -> bool:
    """Whether a file of the tokenizers library has the plain byte-level split and nothing that looks across it."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    return (
        told.get("normalizer") is None
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(t.get("special") and not t.get("lstrip") and not t.get("rstrip") for t in told.get("added_tokens") or [])
    )


class Whole:
    """A tokenizer of which only whole texts are asked."""

    def __init__(self, path: str):
        self.suffix = ""
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
            self.vocabulary = {i: t for t, i in self.tokenizer.get_vocab().items()}
            with open(path, encoding="utf-8") as f:
                self.suffix = (json.load(f).get("model") or {}).get("end_of_word_suffix") or ""
            self.ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
            self.text = self._joined
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.tokenizer = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.ids, self.text = self.tokenizer.encode_ordinary, self.tokenizer.decode
        else:
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids, self.text = (lambda text: self.tokenizer.encode(text, num_threads=1)), self.tokenizer.decode

    def _joined(self, ids: list[int]) -> str:
        back, out = byte_table(), b""
        for i in ids:
            token = self.vocabulary.get(i, "")
            ends = bool(self.suffix) and token.endswith(self.suffix)
            token = token[: -len(self.suffix)] if ends else token
            out += bytes(back[c] for c in token if c in back) + (b" " if ends else b"")
        return out.decode("utf-8", "replace")

    def encode(self, text: str) -> bytes:
        return array("i", self.ids(text)).tobytes() if text else b""


class PieceTable(dict):
    """From a piece of text to its ids as little-endian 32-bit integers, for a byte-level vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.units = Units(self.tokenizer)
        back = byte_table()
        self.vocabulary = {i: bytes(back[c] for c in token) for token, i in self.tokenizer.get_vocab().items() if all(c in back for c in token)}

    def __missing__(self, piece: str) -> bytes:
        packed = b"".join(map(self.units.__getitem__, _UNIT.findall(piece)))
        if len(self) >= MOST_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ") if "  " not in text else _SINGLE_SPACE.split(text)
        first = pieces[0]
        rest = [" " + p for p in pieces[1:]]
        return b"".join(map(self.__getitem__, [first, *rest] if first else rest))

    def text(self, ids: list[int]) -> str:
        return b"".join(self.vocabulary.get(i, b"") for i in ids).decode("utf-8", "replace")

    def spans(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        of_byte = [n for n, c in enumerate(text) for _ in c.encode("utf-8", "surrogatepass")]
        at, starts, ends = 0, [], []
        for i in ids:
            starts.append(of_byte[at])
            at += len(self.vocabulary[i])
            ends.append(of_byte[at - 1] + 1)
        return starts, ends


def piece_table(path: str) -> PieceTable | Whole:
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = PieceTable(path) if path.endswith(".json") and _byte_level(path) else Whole(path)
    return _loaded[path]


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folder: str = TOKENIZER_DIR, name: str = TOKENIZER
) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of each row of df, without special tokens."""
    path = _path(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            packed = [table.encode(t.as_py() or "") for t in batch.column(1)]
            offsets = [0]
            for x in packed:
                offsets.append(offsets[-1] + len(x) // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "ids"])

    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def count(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folder: str = TOKENIZER_DIR, name: str = TOKENIZER
) -> DataFrame:
    """(id_col, n_tokens BIGINT) of each row of df."""
    path = _path(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            sizes = [len(table.encode(t.as_py() or "")) // 4 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [id_col, "n_tokens"])

    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def byte_table() -> dict[str, int]:
    """From the printable character that stands for a byte in a byte-level vocabulary to that byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, free = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(free)] = b
            free += 1
    return out


def offsets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folder: str = TOKENIZER_DIR, name: str = TOKENIZER
) -> DataFrame:
    """(id_col, ids, starts, ends): the characters of the text that each token covers.

    A character of several bytes may be split over tokens; each of those covers that whole character.
    """
    path = _path(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            every, starts, ends = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                if isinstance(table, PieceTable):
                    ids = array("i", table.encode(text)).tolist()
                    s, e = table.spans(text, ids)
                elif path.endswith(".json"):
                    found = table.tokenizer.encode(text, add_special_tokens=False)
                    ids, s, e = found.ids, [a for a, _ in found.offsets], [b for _, b in found.offsets]
                else:
                    raise ValueError(f"no offsets from {path}")
                every.append(ids)
                starts.append(s)
                ends.append(e)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(every, kind), pa.array(starts, kind), pa.array(ends, kind)], [id_col, "ids", "starts", "ends"]
            )

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, ints) for c in ("ids", "starts", "ends"))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(
    df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, folder: str = TOKENIZER_DIR, name: str = TOKENIZER
) -> DataFrame:
    """(id_col, text) of each row: the bytes of all ids are joined first, so split characters come back whole.

    Null ids give a null text, an empty list an empty one. An id outside the byte-level vocabulary is skipped; bytes
    that are no text by themselves become U+FFFD.
    """
    path = _path(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            texts = [None if ids is None else table.text(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    schema = T.StructType([df.schema[id_col], T.StructField("text", T.StringType())])
    return df.select(id_col, F.col(ids_col)).mapInArrow(run, schema)
