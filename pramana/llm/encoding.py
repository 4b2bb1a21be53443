"""Encoding texts with a public tokenizer and decoding ids again."""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Texts are encoded in runs of about so many characters, to bound a worker's memory.
CHARS_A_RUN = 1_000_000


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where the file of a public tokenizer is: ``name`` if it is a path, else in $PUBLIC_TOKENIZERS or its usual folder."""
    return name if os.path.sep in name else os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _runs(texts: list[str | None]) -> Iterator[list[str]]:
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= CHARS_A_RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, offsets: bool = False) -> DataFrame:
    """``id_col, ids`` of each row, in the order of the text, without special tokens.

    The text is whole, whatever its length; a special token's string in it is ordinary text. A null or empty text has
    the empty list of ids. With ``offsets`` also ``starts`` and ``ends``, each token's span in code points of the text; the
    tokens of a character that several share have all the span of that character. Repeated rows and repeated ids stay.
    """
    path = tokenizer_path(tokenizer)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            at = 0
            for texts in _runs(b.column(1).to_pylist()):
                ids = b.column(0).slice(at, len(texts))
                at += len(texts)
                if offsets:
                    got = t.encode_batch(texts, add_special_tokens=False)
                    spans = [e.offsets for e in got]
                    more = [pa.array([[s[i] for s in x] for x in spans], pa.list_(pa.int32())) for i in (0, 1)]
                else:
                    got, more = t.encode_batch_fast(texts, add_special_tokens=False), []
                yield pa.RecordBatch.from_arrays([ids, pa.array([e.ids for e in got], pa.list_(pa.int32())), *more], [id_col, "ids", "starts", "ends"][: 2 + len(more)])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def token_counts(df: DataFrame, *, keep: list[str], text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, as_col: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each text; 0 for null and empty texts."""
    path = tokenizer_path(tokenizer)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            counts = [len(e.ids) for texts in _runs(b.column(len(keep)).to_pylist()) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(counts, pa.int64())], [*keep, as_col])

    return df.select(*keep, df[text_col].alias("__text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{as_col}` long")


def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Decoder:
    """Turns ids into text, in pieces too: a character whose bytes are split between pieces comes with the last of them."""

    def __init__(self, tokenizer: str = DEFAULT_TOKENIZER):
        t = _tokenizer(tokenizer_path(tokenizer))
        table = byte_of_character()
        self.bytes = {i: bytes(table[c] for c in token) for token, i in t.get_vocab(with_added_tokens=False).items() if all(c in table for c in token)}
        self.rest = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        """The text of the next ids; ids outside the vocabulary give U+FFFD."""
        return self.rest.decode(b"".join(self.bytes.get(i, b"\xff") for i in ids), last)

    def decode(self, ids: list[int]) -> str:
        self.rest.reset()
        return self.feed(ids, True)


@lru_cache(maxsize=4)
def _decoder(tokenizer: str) -> Decoder:
    return Decoder(tokenizer)


def decode(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``id_col, text`` of each list of ids; null and empty lists give the empty text."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _decoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
