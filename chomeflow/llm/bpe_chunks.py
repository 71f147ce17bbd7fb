"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the bytes at each space cuts texts into chunks, so that a
passage shared by many documents falls into the same chunks wherever it
stands.  A chunk is encoded the first time a task meets it and then reused.

Joins are repaired.  A lone space between two other characters always starts a
pre-token, so text on both sides of one is encoded independently.  For each
join the stretch from the last such space before it to the first such space
behind it is encoded anew; where that agrees with what the two chunks have, it
stays, else the new ids replace theirs.  A chunk without such a space is
taken into the stretch, which is encoded once, when it ends.

Nulls count as empty texts; an empty text has no ids and decodes to an empty
text; repeated rows give repeated results; other columns are ignored; an empty table gives none.
A long text is encoded as a whole, in time that grows with its length.  Otherwise memory is
bounded by the cache limits, whatever the input.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chomeflow.llm.arrow_text import released

#: Fixed values of the vocabulary's format: the pattern that splits text before merges, and the special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"

WINDOW = 8
#: One space in so many is a cut.
SPACES = 128
CHUNK_CACHE = 8_000
#: Longer chunks aren't kept, so the cache is bounded in bytes as well.
KEPT_CHARS = 4_000

#: Letters and digits up to here have the same classes in all Unicode versions; other chunks go to the tokenizers library.
_SETTLED = regex.compile("[\x00-\u024f\u2010-\u2027\u20ac]*+")
_FIRST_SAFE = regex.compile(r"(?<=\S) (?=\S)")
_LAST_SAFE = regex.compile(r"(?r)(?<=\S) (?=\S)")


def byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer file as ranks of byte strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        tok = json.load(f)
    added = {x["content"] for x in tok["added_tokens"]}
    return {bytes(shown[c] for c in t): i for t, i in tok["model"]["vocab"].items() if t not in added}


class ChunkCoder:
    """Encodes whole texts; one per task."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = self.tok.token_to_id(SPECIAL)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={SPECIAL: self.special})
        self.chunks: dict[str, tuple] = {}
        self.encoded = self.reused = self.repaired = 0

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens, by itself."""
        if text.isascii() or _SETTLED.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.tok.encode(text, add_special_tokens=False).ids

    def chunk(self, text: str) -> tuple | None:
        """(ids, head, number of its ids, tail, number of its ids); head and tail reach to the first and from the last safe space. None without one."""
        if (got := self.chunks.get(text, self)) is self:
            first, last = _FIRST_SAFE.search(text, 1), _LAST_SAFE.search(text)
            if first is None:
                got = None
            else:
                self.encoded += 1
                head, tail = text[: first.start()], text[last.start() :]
                got = self.plain(text), head, len(self.plain(head)), tail, len(self.plain(tail))
            if len(text) <= KEPT_CHARS:
                if len(self.chunks) >= CHUNK_CACHE:
                    self.chunks.clear()
                self.chunks[text] = got
        elif got:
            self.reused += 1
        return got

    def cuts(self, text: str) -> list[int]:
        """Code-point offsets of spaces at which the hash of the rolling window of bytes from there on is a multiple of SPACES."""
        raw = text.encode()
        if len(raw) <= 2 * WINDOW:
            return []
        each = np.frombuffer(raw, np.uint8)
        window = np.ndarray(len(raw) - WINDOW + 1, "<u8", raw, 0, (1,))
        at = np.flatnonzero(each[: len(window)] == 32)
        with np.errstate(over="ignore"):
            at = at[(window[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(SPACES - 1) == 0]
        if len(text) != len(raw):
            at = np.cumsum((each & 0xC0) != 0x80)[at] - 1
        return at[at > 0].tolist()

    def segment(self, text: str) -> list[int]:
        """Ids of a text without special tokens, from its chunks."""
        edges = [0, *self.cuts(text), len(text)]
        ids: list[int] = []
        stretch: list[str] = []  # from the last safe space on, not in ids yet
        known: list[int] | None = None  # its ids, if it is one chunk's tail
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a and len(stretch) > 1 and _FIRST_SAFE.match(text, a):
                ids += self.plain("".join(stretch))
                stretch, known = [], []
            got = self.chunk(text[a:b])
            if got is None:
                stretch.append(text[a:b])
                known = None
                continue
            own, head, n_head, tail, n_tail = got
            if a:
                across = self.plain("".join([*stretch, head]))
                if known is None or across != known + own[:n_head]:
                    self.repaired += 1
            else:
                across = own[:n_head]
            ids += across
            ids += own[n_head : len(own) - n_tail]
            stretch, known = [tail], own[len(own) - n_tail :]
        return ids + (known if known is not None else self.plain("".join(stretch)))

    def encode(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.segment(text) if text else []
        ids: list[int] = []
        for i, part in enumerate(text.split(SPECIAL)):
            ids += [self.special] * (i > 0)
            ids += self.segment(part) if part else []
        return ids

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; bytes that aren't UTF-8 become replacement characters."""
        return self.fast.decode(ids, errors="replace")

    def code(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text) of a whole text."""
        ids = self.encode(text)
        return np.array(ids, "<u4").tobytes(), self.decode(ids)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = ("ids", "decoded")) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row, and of ``outputs`` the ids and the decoded text.

    One narrow pass: no shuffle, so neither a hot source nor groups of copies weigh more than their rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    more = {"ids": "array<int>", "decoded": "string"}
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkCoder(tokenizer_path)
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [coder.code(t or "") for t in part.column(1).to_pylist()]
                cols = [
                    pa.array([len(x) // 4 for x, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x, _ in got], pa.string()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in got], pa.string()),
                ]
                if "ids" in outputs:
                    cols.insert(3 + outputs.index("ids"), pa.array([np.frombuffer(x, "<i4") for x, _ in got], pa.list_(pa.int32())))
                if "decoded" in outputs:
                    cols.insert(3 + outputs.index("decoded"), pa.array([s for _, s in got], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [id_col, *names])

    schema = ", ".join([f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(f"{c} {more[c]}" for c in outputs)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
