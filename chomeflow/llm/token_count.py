"""Token counts with a whole-token shortcut.

Most pre-tokens of a text are one token.  Which vocabulary strings encode alone as one token is proved before any text is
read: each string that is one pre-token by itself is put through the tokenizers library, and kept if its ids are its own id alone.
(A string in the vocabulary isn't enough: merges in order of rank may never build it.)  Such a pre-token counts as one without
being merged; only the rest is.  Where every vocabulary string is proved (merges in order of rank, each the only one of its token), merges by
rank of the joined bytes give the library's tokens, so a faster encoder does them; else the library does.

A lone space between two other characters starts a pre-token whatever stands around it, so what lies between two such
spaces has the same tokens in every text.  Texts are cut there, equal stretches counted, and each distinct one measured once: as a whole
token with its space; else from its pre-tokens.  Measured stretches are kept for later texts in a cache of bounded size.

Strings of special tokens inside a text are special tokens, as is the library's default.  A null text counts as
empty; an empty text has no tokens.  Repeated rows give repeated results; other columns are ignored; an empty table
gives none.  A long text is read as a whole, in time that grows with its length, in pieces of ``PIECE`` characters or to the next safe space.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from chomeflow.llm.arrow_text import released
from chomeflow.llm.bpe_chunks import PATTERN, SPECIAL, byte_ranks

LIMIT = 1024
PIECE = 1 << 20
KEPT = 400_000
#: Longer stretches aren't kept, so the cache is bounded in bytes as well.
KEPT_CHARS = 48

#: Characters whose classes are the same in this pattern engine and in the library; other stretches go to the library as they are.
SETTLED = "\x00-ԯ‐-‧€　-鿯가-힣"
_SETTLED = regex.compile(f"[{SETTLED}]*+")
_PRETOKEN = regex.compile(PATTERN)
_SAFE = regex.compile(r"(?<=\S) (?=\S)")
#: What either of the engines takes for white space, but the space itself.
_OTHER = [c for c in map(chr, range(0x3001)) if c != " " and (c.isspace() or regex.match(r"\s", c))]


def _has_runs(text: str) -> bool:
    """Whether a space of a text isn't safe: it stands at an end, or beside white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return True
    return any(f" {c}" in text or f"{c} " in text for c in _OTHER if c in text)


def _library(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that encode alone as one token. Their number is bounded by the vocabulary's."""
    tok = _library(path)
    strings = {}
    for raw, i in byte_ranks(path).items():
        try:
            strings[raw.decode()] = i
        except UnicodeDecodeError:
            continue  # part of a character is never a pre-token
    single = [s for s in strings if len(tok.pre_tokenizer.pre_tokenize_str(s)) == 1]
    got = tok.encode_batch(single, add_special_tokens=False)
    return [s for s, e in zip(single, got, strict=True) if e.ids == [strings[s]]]


def _all_proved(ranks: dict[bytes, int], whole: frozenset[str]) -> bool:
    """Whether all strings of whole characters are proved; each of them that isn't one pre-token counts as not proved."""
    return len(whole) == sum(raw.decode(errors="ignore").encode() == raw for raw in ranks)


class TokenCounter:
    """Counts tokens of whole texts; one per Python worker, whose tasks share its cache."""

    def __init__(self, path: str, whole: list[str]):
        import tiktoken

        ranks = byte_ranks(path)
        self.tok = _library(path)
        self.whole = frozenset(whole)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if _all_proved(ranks, self.whole) else None
        #: Strings that are one token with a space before them; any that would join with a neighbour isn't among them.
        self.spaced = frozenset(s[1:] for s in whole if s[0] == " " and not s[1:2].isspace() and len(s) > 1)
        #: Tokens of stretches, without their space.
        self.known: dict[str, int] = {}
        self.direct = self.merged = 0

    def merge(self, pretoken: str) -> int:
        """Tokens of a pre-token of settled characters, by merges."""
        self.merged += 1
        return len(self.fast.encode_ordinary(pretoken)) if self.fast else self.library(pretoken)

    def library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False))

    def stretch(self, text: str, settled: bool) -> int:
        """Tokens of a text without special tokens, from its pre-tokens."""
        if not settled:
            return self.library(text)
        n = 0
        for piece in [text] if text[1:].isalpha() and text[0] == " " else _PRETOKEN.findall(text):
            if piece in self.whole:
                self.direct += 1
                n += 1
            else:
                n += self.merge(piece)
        return n

    def measured(self, text: str, settled: bool) -> int:
        """As ``stretch``, kept for later texts."""
        n = self.stretch(text, settled or bool(_SETTLED.fullmatch(text)))
        if len(text) <= KEPT_CHARS:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[text[1:]] = n
        return n

    def segment(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        settled = bool(_SETTLED.fullmatch(text))
        if _has_runs(text):
            edges = [0, *(m.start() for m in _SAFE.finditer(text)), len(text)]
            first, *rest = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            rest = [s[1:] for s in rest]
        else:
            first, *rest = text.split(" ")
        n = self.stretch(first, settled or bool(_SETTLED.fullmatch(first))) if first else 0
        spaced, known = self.spaced, self.known
        for s, times in Counter(rest).items():
            if s in spaced:
                self.direct += times
                n += times
            elif (k := known.get(s)) is not None:
                n += times * k
            else:
                n += times * self.measured(" " + s, settled)
        return n

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            m = _SAFE.search(text, at + PIECE)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def count(self, text: str) -> int:
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(self.segment(x) for part in parts for x in self.pieces(part) if x)


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(path: str, whole: list[str]) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = TokenCounter(path, whole)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row. A narrow pass: no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path, whole.value)
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = pc.fill_null(part.column(1), "")
                n = np.array([counter.count(t) for t in texts.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
