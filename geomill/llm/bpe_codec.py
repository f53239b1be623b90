"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters so that one Aho-Corasick automaton (pyahocorasick)
holds the vocabulary.  A match of the tokenizer's pattern is encoded by backtracking: at a
place take the longest token that starts there; keep it if it may follow the token before it,
else try its next shorter prefix token; if none is left, the place can't be reached and the
token before it is retried.  Two tokens may be neighbours if merging their joint bytes by
rank gives just these two tokens; that answer is memoised.  A sequence all of whose
neighbours are compatible is the merge result, so the ids equal those of merging by rank.
Each place is given up at most once, hence the linear time, also for one match of a megabyte.

Cases: null text counts as empty: no ids, the digest of an empty string; an empty table gives
an empty result; repeated rows get equal values.  Whole texts are encoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: Entries of a task's memo of matches, and bytes of a match that is memoised at most.
MEMO, MEMO_BYTES = 200_000, 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: again and again join the leftmost neighbours of lowest rank."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encoder and decoder over a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        import ahocorasick
        import regex

        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.auto = ahocorasick.Automaton()
        for token in ranks:
            self.auto.add_word(token.decode("latin-1"), len(token))
        self.auto.make_automaton()
        self.memo, self.fits = memo, {}
        self.whole: dict[int, bool] = {}

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (known := self.whole.get(token)) is None:
            data = self.bytes_of[token]
            known = self.whole[token] = merge_by_rank(data, self.ranks) == [data]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether both are reachable and merging their joint bytes gives just them; left -1: the start."""
        if left < 0:
            return self.reachable(right)
        key = left << 32 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2 * self.memo:
                self.fits.clear()
            pair = [self.bytes_of[left], self.bytes_of[right]]
            known = self.fits[key] = self.reachable(right) and merge_by_rank(pair[0] + pair[1], self.ranks) == pair
        return known

    def encode_match(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token itself is that token."""
        ranks, compatible = self.ranks, self.compatible
        if (own := ranks.get(data)) is not None:
            return [own]
        text, n = data.decode("latin-1"), len(data)
        dead: set[int] = set()
        out: list[int] = []
        ends: list[int] = [0]
        longest, synced = self.auto.iter_long(text), 0  # gives the longest token at ``synced``, then at its end, ...
        last, at, end = -1, 0, None
        while at < n:
            if end is None:
                if at != synced:
                    longest = self.auto.iter_long(text, at)
                end = synced = next(longest)[0] + 1
            while end > at:
                token = ranks.get(data[at:end])
                if token is not None and end not in dead and compatible(last, token):
                    break
                end -= 1
            if end > at:
                out.append(token)
                ends.append(end)
                last, at, end = token, end, None
            elif out:
                dead.add(at)
                out.pop()
                end = ends.pop() - 1  # try the next shorter one there
                at, last = ends[-1], out[-1] if out else -1
                synced = -1
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.split(text) for i in self.encode_match(m.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memo(dict):
    """match -> (ids joined by commas, bytes decoded from the ids)."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, match: str) -> tuple[str, bytes]:
        raw = match.encode()
        ids = self.codec.encode_match(raw)
        made = ",".join(map(str, ids)), self.codec.decode(ids)
        if len(raw) <= MEMO_BYTES:
            if len(self) >= self.codec.memo:
                self.clear()
            self[match] = made
        return made


_CODECS: dict[tuple[str, str, int], tuple[Codec, _Memo]] = {}


def codec_of(file: str, pattern: str, memo: int = MEMO) -> tuple[Codec, _Memo]:
    """The worker process's codec of a vocabulary file that the job has distributed."""
    if (file, pattern, memo) not in _CODECS:
        codec = Codec(read_ranks(SparkFiles.get(file)), pattern, memo)
        _CODECS[file, pattern, memo] = codec, _Memo(codec)
    return _CODECS[file, pattern, memo]


ADDED = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]


def encode_digest(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", drop: bool = False, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """``docs`` with the token count, digests of ids and of decoded bytes, and whether they equal the text;
    ``with_ids`` adds the ids themselves as an array; ``memo``: entries of a worker's memo tables (about 1 KB each)."""
    file = share_file(docs, vocabulary)

    def make():
        codec, known = codec_of(file, pattern, memo)

        def each(arr: pa.Array) -> dict[str, pa.Array]:
            counts, ids_sha, back_sha, same, arrays = [], [], [], [], []
            for t in arr:
                t = t.as_py() or ""
                made = [known[m] for m in codec.split(t)]
                ids = ",".join([m[0] for m in made])
                back = b"".join([m[1] for m in made])
                counts.append(ids.count(",") + 1 if ids else 0)
                if with_ids:
                    arrays.append(np.fromiter(map(int, ids.split(",") if ids else ()), np.int32, counts[-1]))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back_sha.append(hashlib.sha256(back).hexdigest())
                same.append(back == t.encode())
            out = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(back_sha, pa.string()), "round_trip": pa.array(same, pa.bool_())}
            if with_ids:
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                out["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))
            return out

        return each

    ids = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    return append_columns(docs, text, make, ADDED + ids, drop)


def encode_ids(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text as an array."""
    file = share_file(docs, vocabulary)

    def make():
        codec, memo = codec_of(file, pattern)

        def each(arr: pa.Array) -> dict[str, pa.Array]:
            rows = ([int(i) for m in codec.split(t.as_py() or "") for i in memo[m][0].split(",")] for t in arr)
            return {ids: pa.array(rows, pa.list_(pa.int32()))}

        return each

    return append_columns(docs, text, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode_ids(rows: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids stand for; null ids give null."""
    file = share_file(rows, vocabulary)

    def make():
        codec, _ = codec_of(file, pattern)

        def each(arr: pa.Array) -> dict[str, pa.Array]:
            return {text: pa.array([None if x.as_py() is None else codec.decode(x.as_py()) for x in arr], pa.binary())}

        return each

    return append_columns(rows, ids, make, [T.StructField(text, T.BinaryType())])


def share_file(df: DataFrame, path: str) -> str:
    """Send a local file of fixed size (a vocabulary) to the executors; its name there."""
    sc = df.sparkSession.sparkContext
    sc.addFile(path)
    return path.rsplit("/", 1)[-1]
