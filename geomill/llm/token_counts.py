"""Token counts: batch encoding in Arrow functions that return lengths only.

Where white space is dropped by the tokenizer and never joins two tokens, a text may be cut at
every run of ASCII white space: its count is the sum over the pieces.  ``cuts_at_space`` reads
from the tokenizer's file whether that is so; texts of any other tokenizer go to it whole.  The pieces of a batch
that are new to the task go to the library in batches of about ``BATCH_BYTES`` bytes, so a
long text neither holds up a batch of short ones nor makes one large request; counts of short
pieces are memoised.  A long piece without white space is encoded by itself.

Special strings inside texts stay as the library treats them by default; no special token is
added, nothing is truncated or padded.

Cases: null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result;
repeated rows get equal counts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_codec import share_file
from .common import append_columns, by_bytes, byte_view

BATCH_BYTES, SLICE_BYTES, MEMO, MEMO_BYTES = 1 << 18, 4 << 20, 300_000, 128

ADDED = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def batches(pieces: list[bytes], most: int = BATCH_BYTES):
    """Lists of pieces of about ``most`` bytes, shortest first so that a batch's pieces are alike."""
    out, size = [], 0
    for p in sorted(pieces, key=len):
        if out and size + len(p) > most:
            yield out
            out, size = [], 0
        out.append(p)
        size += len(p)
    if out:
        yield out


def never_space(regex: str) -> bool:
    """Whether no match of a pattern can hold white space; patterns of other forms count as if they could."""
    return not re.search(r" |\\[sSWDPtnrfvxu]|\.|\[\^", regex.replace(r"[^\s", "["))


def cuts_at_space(spec: dict) -> bool:
    """Whether a tokenizer file gives a text the tokens of its white-space separated pieces.

    That holds where the normalizer works within words (or collapses white space), the first
    pre-tokenizer removes all white space, and no added token holds some or takes it from its
    neighbours.  A file of another form counts as if it didn't hold."""
    steps = lambda x, many: x[many] if x and many in x else [x] if x else []
    normal, pre = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    collapses = lambda n: n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
    if not pre or not all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents") or collapses(n) for n in normal):
        return False
    first = pre[0]
    removes = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    if first["type"] == "Split" and first["behavior"] == "Removed":
        regex = first["pattern"].get("Regex", "")
        removes = never_space(regex) if first["invert"] else regex == r"\s+"
    alone = lambda t: not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]))
    return removes and all(map(alone, spec.get("added_tokens") or []))


class Counter:
    """Token counts of texts by a tokenizer file of the library ``tokenizers``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to deal out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = cuts_at_space(json.loads(self.tokenizer.to_str()))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memo: dict[bytes, int] = {}

    def library(self, pieces: list[bytes]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def count(self, raw: list[bytes]) -> list[int]:
        words = [r.split() if self.cuts else [r] for r in raw]
        new = set().union(*words).difference(self.memo)
        extra: dict[bytes, int] = {}
        for batch in batches(list(new)):
            for p, n in zip(batch, self.library(batch), strict=True):
                (self.memo if len(p) <= MEMO_BYTES else extra)[p] = n
        memo = self.memo
        if extra:
            memo = self.memo | extra
        counts = [sum(map(memo.__getitem__, w)) for w in words]
        if len(self.memo) > MEMO:
            self.memo.clear()
        return counts


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", drop: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit of every whole text."""
    file = share_file(docs, tokenizer)

    def make():
        if file not in _COUNTERS:
            _COUNTERS[file] = Counter(SparkFiles.get(file))
        counter = _COUNTERS[file]

        def each(arr: pa.Array) -> dict[str, pa.Array]:
            data, offsets = byte_view(arr)
            n = np.zeros(len(arr), np.int64)
            for lo, hi in by_bytes(offsets, SLICE_BYTES):
                n[lo:hi] = counter.count([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)])
            return {"n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

        return each

    return append_columns(docs, text, make, ADDED, drop)
