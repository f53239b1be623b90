"""Address parts in free text: a linear-chain tagger, an averaged structured perceptron with Viterbi decoding.

``learn`` fits weights on a bounded sample of labelled addresses (``SAMPLE`` rows of smallest hash); ``tag`` applies them in Arrow
batches.  Words are cut at white space and around commas; features are hashed, so the weights have a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions.text import let

TAGS = ("street", "number", "area", "city", "state", "postcode", "other")
#: Labelled rows that are learned from, rounds over them, hashed features.
SAMPLE, ROUNDS, SLOTS = 1500, 4, 1 << 16
WORD = re.compile(r"[^\s,]+|,")
MEMO = 100_000
#: Words of texts that are decoded at once.
BLOCK = 50_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shape(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "9", w)))


def slots(words: Sequence[str], memo: dict[str, int]) -> list[list[int]]:
    """The hashed features of each word: itself, its form, its ends, its neighbours and theirs, its place."""
    low = ["<s>", "<s>", *[w.lower().strip(".") for w in words], "</s>", "</s>"]
    form = ["", "", *[shape(w) for w in words], "", ""]
    out = []
    for i in range(2, len(low) - 2):
        w = low[i]
        names = (f"w{w}", f"f{form[i]}", f"n{min(len(w), 9)}{form[i]}", f"p{w[:3]}", f"s{w[-3:]}", f"b{low[i - 1]}", f"a{low[i + 1]}", f"g{form[i - 1]}|{form[i]}|{form[i + 1]}", f"c{low[i - 2]}|{low[i - 1]}", f"d{low[i + 1]}|{low[i + 2]}", f"i{min(i - 2, 3)}|{min(len(low) - 3 - i, 3)}")
        row = []
        for n in names:
            if n not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[n] = zlib.crc32(n.encode()) % SLOTS
            row.append(memo[n])
        out.append(row)
    return out


def viterbi(score: np.ndarray, step: np.ndarray) -> list[int]:
    """The best path: ``score`` (words x tags), ``step`` (tags + 1 x tags; its last row is the start)."""
    if not len(score):
        return []
    best, back = score[0] + step[-1], []
    for row in score[1:]:
        through = best[:, None] + step[:-1]
        back.append(through.argmax(0))
        best = through.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def decoded(rows: list[list[list[int]]], w: np.ndarray, step: np.ndarray) -> list[list[int]]:
    """The best paths of many texts, given by their words' features: ``viterbi`` for all texts of one length at once."""
    out: list[list[int]] = [[] for _ in rows]
    by: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(len(r), []).append(i)
    for n, at in by.items():
        if n == 0:
            continue
        for k in range(0, len(at), BLOCK // n + 1):
            part = at[k : k + BLOCK // n + 1]
            score = w[np.array([rows[i] for i in part])].sum(2)  # texts x words x tags
            best, back = score[:, 0] + step[-1], []
            for j in range(1, n):
                through = best[:, :, None] + step[:-1]
                back.append(through.argmax(1))
                best = through.max(1) + score[:, j]
            path = [best.argmax(1)]
            for b in reversed(back):
                path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
            for i, p in zip(part, np.stack(path[::-1], 1).tolist(), strict=True):
                out[i] = p
    return out


def learn(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, id: str = "id") -> tuple[np.ndarray, np.ndarray]:
    """Weights (of features, of steps) from rows (id, words, tags); a bounded sample goes to the driver."""
    rows = labelled.orderBy(F.xxhash64(id), id).limit(sample).select("words", "tags").collect()
    memo: dict[str, int] = {}
    data = [(slots(r["words"], memo), [TAGS.index(t) for t in r["tags"]]) for r in rows]
    w, s = np.zeros((SLOTS, len(TAGS))), np.zeros((len(TAGS) + 1, len(TAGS)))
    w_sum, s_sum, now = np.zeros_like(w), np.zeros_like(s), 1
    for _ in range(rounds):
        for features, truth in data:
            guess = viterbi(np.array([w[f].sum(0) for f in features]).reshape(-1, len(TAGS)), s)
            if guess != truth:
                for f, a, b in zip(features, truth, guess, strict=True):
                    if a != b:
                        for k, sign in ((a, 1), (b, -1)):
                            np.add.at(w, (f, k), sign)
                            np.add.at(w_sum, (f, k), sign * now)
                for path, sign in ((truth, 1), (guess, -1)):
                    for a, b in zip([len(TAGS), *path], path, strict=False):
                        s[a, b] += sign
                        s_sum[a, b] += sign * now
            now += 1
    return (w - w_sum / now).astype(np.float32), (s - s_sum / now).astype(np.float32)


def tag(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "address", id: str = "id") -> DataFrame:
    """(id, words, tags, one column a part): each part is its words joined; null where there are none or no text."""
    w, s = model
    parts = TAGS[:-1]
    schema = f"id {dict(df.dtypes)[id]}, words array<string>, tags array<string>, " + ", ".join(f"{p} string" for p in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            paths = decoded([slots(x, memo) for x in words], w, s)
            tags = [[TAGS[k] for k in p] for p in paths]
            joined = [[" ".join(x for x, t in zip(ws, ts, strict=True) if t == p) or None for ws, ts in zip(words, tags, strict=True)] for p in parts]
            arrays = [b.column(0), pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.string())), *[pa.array(j, pa.string()) for j in joined]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "words", "tags", *parts])

    return df.select(F.col(id).alias("id"), text).mapInArrow(run, schema)


def composed(rows: DataFrame) -> DataFrame:
    """(id, address, words, tags) of rows (id, street, number, area, city, state, postcode): addresses in orders and spellings drawn by the id."""
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    kinds = {"^Rua ": ("R. ", "r "), "^Avenida ": ("Av. ", "AV "), "^Travessa ": ("Tv. ", "Trav. "), "^Alameda ": ("Al. ", "AL ")}
    street = F.col("street")
    for pattern, (one, two) in kinds.items():
        street = let(street, lambda s: F.when(pick(3, "k") == 1, F.regexp_replace(s, pattern, one)).when(pick(3, "k") == 2, F.regexp_replace(s, pattern, two)).otherwise(s))  # noqa: B023
    street = let(street, lambda s: F.when(pick(4, "u") == 0, F.upper(s)).otherwise(s))
    number = F.when(pick(3, "n") == 0, F.concat(F.lit("nº "), "number")).otherwise(F.col("number"))
    postcode = F.when(pick(3, "p") == 0, F.regexp_replace("postcode", "-", "")).when(pick(3, "p") == 1, F.concat(F.lit("CEP "), "postcode")).otherwise(F.col("postcode"))
    part = {n: F.struct(c.alias("text"), F.lit(n).alias("tag")) for n, c in {"street": street, "number": number, "area": F.col("area"), "city": F.col("city"), "state": F.col("state"), "postcode": postcode}.items()}
    comma, dash = F.struct(F.lit(",").alias("text"), F.lit("other").alias("tag")), F.struct(F.lit("-").alias("text"), F.lit("other").alias("tag"))
    orders = [
        [part["street"], comma, part["number"], dash, part["area"], comma, part["city"], dash, part["state"], comma, part["postcode"]],
        [part["street"], part["number"], part["area"], part["city"], part["state"], part["postcode"]],
        [part["postcode"], part["city"], dash, part["state"], part["street"], comma, part["number"]],
        [part["city"], comma, part["area"], comma, part["street"], part["number"], comma, part["postcode"]],
        [part["street"], part["number"], dash, part["city"]],
    ]
    chosen = F.array(*orders[-1])
    for i, o in enumerate(orders[:-1]):  # only the drawn order is made
        chosen = F.when(pick(len(orders), "o") == i, F.array(*o)).otherwise(chosen)
    chosen = F.filter(chosen, lambda p: F.coalesce(F.trim(p["text"]) != "", F.lit(False)))
    words = F.flatten(F.transform(chosen, lambda p: F.transform(F.regexp_extract_all(p["text"], F.lit(r"([^\s,]+|,)"), F.lit(1)), lambda x: F.struct(x.alias("w"), p["tag"].alias("t")))))
    out = rows.select("id", words.alias("all"))
    return out.select("id", F.array_join(F.transform("all", lambda x: x["w"]), " ").alias("address"), F.transform("all", lambda x: x["w"]).alias("words"), F.transform("all", lambda x: x["t"]).alias("tags"))
