"""Sub-word tokens by a public tokenizer's file, whose path is a parameter: counts, cuts at a number of tokens, and
the tokens that a count-based model reads. The file has to be at that path on every machine."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens are handed on as their numbers with this mark in front, so that none is taken for a word.
MARK = "#"
#: Splits a text before the merges of a .tiktoken file, as the vocabularies that this library is used with do.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Coder:
    """encode(text) -> numbers, decode(numbers) -> text without special tokens."""

    def __init__(self, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str]) -> None:
        self.encode, self.decode = encode, decode


@functools.cache
def _coder(path: str) -> _Coder:
    """Opened once per process. By the file's ending: .json (tokenizers), .tiktoken (tiktoken), .model (sentencepiece)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True  # their strings in a text are ordinary text
        own.no_truncation()
        return _Coder(lambda t: own.encode(t, add_special_tokens=False).ids, lambda ids: own.decode(ids, skip_special_tokens=True))
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _Coder(own.encode_ordinary, lambda ids: own.decode(ids))
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return _Coder(lambda t: own.encode(t, num_threads=1), own.decode)
    raise ValueError(f"no tokenizer for {path!r}: expected .json, .tiktoken or .model")


class Subword:
    """Column functions over one tokenizer file; null texts have no tokens."""

    def __init__(self, path: str) -> None:
        self.path = path

    def ids(self, text: Column) -> Column:
        path = self.path

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            coder = _coder(path)
            return pd.Series([coder.encode(t) if t else [] for t in texts], dtype=object)

        return encode.asNondeterministic()(text)  # else a filter on the tokens encodes the text again

    def count(self, text: Column) -> Column:
        return F.size(self.ids(text))

    def text(self, ids: Column) -> Column:
        """What the numbers stand for, special tokens left out."""
        path = self.path

        @F.pandas_udf("string")
        def decode(rows: pd.Series) -> pd.Series:
            coder = _coder(path)
            return pd.Series([coder.decode([int(x) for x in r]) if r is not None and len(r) else "" for r in rows], dtype=object)

        return decode(ids)

    def truncate(self, text: Column, limit: int, keep_end: bool = False) -> Column:
        """The text of its first (or last) ``limit`` tokens; a shorter text, or null, as it is."""
        path = self.path

        @F.pandas_udf("string")
        def cut(texts: pd.Series) -> pd.Series:
            coder, out = _coder(path), []
            for t in texts:
                ids = coder.encode(t) if t else []
                out.append(t if len(ids) <= limit else coder.decode(ids[-limit:] if keep_end else ids[:limit]))
            return pd.Series(out, dtype=object)

        return cut(text)

    def summary(self, text: Column, head: int, tail: int) -> Column:
        """tokens (their number), head and tail (as ``truncate`` has them) of a text that is encoded once."""
        path = self.path

        @F.pandas_udf("tokens int, head string, tail string")
        def summed(texts: pd.Series) -> pd.DataFrame:
            coder, out = _coder(path), []
            for t in texts:
                ids = coder.encode(t) if t else []
                out.append((len(ids), t if len(ids) <= head else coder.decode(ids[:head]), t if len(ids) <= tail else coder.decode(ids[-tail:])))
            return pd.DataFrame(out, columns=["tokens", "head", "tail"])

        return summed.asNondeterministic()(text)  # else each use of a field may encode the text again

    def tokens(self, text: Column) -> Column:
        """The tokens as words, for models that count words (``NGramLM(cut=..., joined=...)``)."""
        return F.transform(self.ids(text), lambda i: F.concat(F.lit(MARK), i.cast("string")))

    def joined(self, tokens: Column) -> Column:
        """The text of such words."""
        return self.text(F.transform(tokens, lambda w: F.substring(w, F.lit(len(MARK) + 1), F.length(w)).cast("int")))
