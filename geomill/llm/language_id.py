"""Language ID: a byte convolutional network, trained in numpy, over all windows of a text.

Network: byte embedding (256 x 8), filters of widths 2, 3 and 4 (16 each), max pooling over
the window, ReLU, softmax.  A text is cut into windows of ``WINDOW`` bytes that cover it
wholly; its distribution is the mean of the windows' softmaxes weighted by their bytes.

A filter's output at a place depends on at most four bytes, so scoring looks up two tables
of byte pairs instead of multiplying: the first gives what bytes t, t+1 add to all filters,
the second what bytes t+2, t+3 add to the wider ones.  The sums are the network's own.

Cases: null text and text without a letter get ``und`` and score 0; an empty table gives an
empty result; repeated rows get equal values; columns beside the text pass through.  With no
labelled row at all, every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, byte_view, hand_back, map_arrow, unit_hash

WINDOW, DIM, FILTERS, WIDTHS = 192, 8, 16, (2, 3, 4)
PLACES = WINDOW - 3
UND = "und"


class ByteCNN:
    """Weights and training; ``labels`` are the learned languages in code point order."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"E": r.normal(0, 0.5, (256, DIM)).astype(np.float32), "b": np.zeros(len(WIDTHS) * FILTERS, np.float32)}
        self.p |= {f"C{w}": r.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p |= {"W": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), "c": np.zeros(len(labels), np.float32)}

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over windows x (n, WINDOW) with classes y."""
        p, n = self.p, len(x)
        e, pooled, patches, where = p["E"][x], [], {}, {}
        for w in WIDTHS:
            cols = np.concatenate([e[:, i : i + PLACES] for i in range(w)], axis=2)
            z = cols.reshape(n * PLACES, -1) @ p[f"C{w}"]
            z = z.reshape(n, PLACES, FILTERS)
            where[w] = z.argmax(1)
            pooled.append(np.take_along_axis(z, where[w][:, None], 1)[:, 0])
            patches[w] = cols[np.arange(n)[:, None], where[w]]
        a = np.concatenate(pooled, 1) + p["b"]
        h = np.maximum(a, 0)
        o = h @ p["W"] + p["c"]
        o = np.exp(o - o.max(1, keepdims=True))
        o /= o.sum(1, keepdims=True)
        loss = float(-np.log(o[np.arange(n), y] + 1e-9).mean())
        o[np.arange(n), y] -= 1
        o /= n
        g = {"W": h.T @ o, "c": o.sum(0)}
        d = (o @ p["W"].T) * (a > 0)
        g["b"], g["E"] = d.sum(0), np.zeros_like(p["E"])
        for k, w in enumerate(WIDTHS):
            dk = d[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"C{w}"] = np.einsum("nf,nfk->kf", dk, patches[w])
            dp = (dk[:, :, None] * p[f"C{w}"].T[None]).reshape(n, FILTERS, w, DIM)
            for i in range(w):
                np.add.at(g["E"], x[np.arange(n)[:, None], where[w] + i], dp[:, :, i])
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCNN:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                _, g = self.step(x[rows], y[rows])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a byte pair adds to (all filters, those of widths 3 and 4)."""
        e, p = self.p["E"], self.p
        part = {(w, i): e @ p[f"C{w}"][i * DIM : (i + 1) * DIM] for w in WIDTHS for i in range(w)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        first = np.concatenate([pair(part[w, 0], part[w, 1]) for w in WIDTHS], 1)
        second = np.concatenate([pair(part[3, 2], np.zeros_like(part[3, 2])), pair(part[4, 2], part[4, 3])], 1)
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the windows that cover every row's bytes; none for an empty row."""
    lens = np.diff(offsets)
    n = -(-lens // WINDOW)
    row = np.repeat(np.arange(len(lens)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + k * WINDOW
    return row, start, np.minimum(WINDOW, offsets[1:][row] - start)


def cut(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Windows as (WINDOW, n) bytes, the short ones filled up with byte 0."""
    at = np.arange(WINDOW)[:, None]
    x = data[np.minimum(start[None] + at, len(data) - 1)]
    x[at >= length[None]] = 0
    return x


def scorer(model: ByteCNN, chunk: int = 128):
    """A function from a text column to (label index, score, has a letter)."""
    import regex

    letter = regex.compile(r"\p{L}").search
    first, second = model.tables()
    b, w, c = model.p["b"], model.p["W"], model.p["c"]

    def score(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = byte_view(arr)
        if not model.labels:
            return np.zeros(len(arr), np.int64), np.zeros(len(arr)), np.zeros(len(arr), bool)
        row, start, length = windows_of(data, offsets)
        total = np.zeros((len(arr), len(model.labels)))
        z = np.empty((PLACES, chunk, 3 * FILTERS), np.float32)
        more = np.empty((PLACES, chunk, 2 * FILTERS), np.float32)
        for lo in range(0, len(row), chunk):
            x = cut(data, start[lo : lo + chunk], length[lo : lo + chunk])
            n = x.shape[1]
            if n < chunk:
                x = np.pad(x, ((0, 0), (0, chunk - n)))
            code = x[:-1].astype(np.int64) * 256 + x[1:]
            np.take(first, code[:PLACES], axis=0, out=z, mode="clip")
            np.take(second, code[2 : 2 + PLACES], axis=0, out=more, mode="clip")
            z[:, :, FILTERS:] += more
            o = np.maximum(z.max(0) + b, 0) @ w + c
            o = np.exp(o - o.max(1, keepdims=True))
            o /= o.sum(1, keepdims=True)
            np.add.at(total, row[lo : lo + n], o[:n] * length[lo : lo + n, None])
        lens = np.diff(offsets)
        total /= np.maximum(lens, 1)[:, None]
        best = total.argmax(1)
        letters = np.fromiter((t is not None and letter(t) is not None for t in arr.to_pylist()), bool, len(arr))
        return best, total.max(1), letters

    return score


def sample_windows(labelled: DataFrame, docs_per_lang: int, windows_per_doc: int, seed: int) -> list[tuple[str, bytes]]:
    """Windows at random places of a hash-chosen sample of labelled rows (columns id, text, lang).

    Rows: about ``docs_per_lang`` of each language, by a threshold on the id's hash, so neither
    a shuffle nor a sort is needed; the driver gets docs_per_lang * windows_per_doc * 192 bytes
    a language.
    """
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_lang / n))).otherwise(share)
    picked = labelled.filter(unit_hash(F.col("id"), F.lit(seed)) < share)

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = byte_view(b.column(1))
            langs, out = b.column(2).to_pylist(), []
            for i, (doc, lang) in enumerate(zip(b.column(0).to_pylist(), langs, strict=True)):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                r = np.random.default_rng([seed, abs(int(doc))])
                if hi - lo <= WINDOW:
                    starts = [lo] if hi > lo else []
                else:
                    starts = lo + r.integers(0, hi - lo - WINDOW + 1, min(windows_per_doc, -(-(hi - lo) // WINDOW)))
                out += [(lang, bytes(data[s : min(s + WINDOW, hi)])) for s in starts]
                if hi - lo > 24:  # short texts must be told apart as well
                    s = lo + int(r.integers(0, hi - lo - 12))
                    out.append((lang, bytes(data[s : min(s + int(r.integers(12, 64)), hi)])))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "piece"])

        return one

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("piece", T.BinaryType())])
    rows = map_arrow(picked.select("id", "text", "lang"), make, schema).collect()
    return sorted((r["lang"], bytes(r["piece"])) for r in rows)


def learn(labelled: DataFrame, docs_per_lang: int = 250, windows_per_doc: int = 5, seed: int = 7) -> ByteCNN:
    """Fit on a bounded sample of rows (id, text, lang) with lang and text not null."""
    rows = sample_windows(labelled, docs_per_lang, windows_per_doc, seed)
    labels = sorted({r[0] for r in rows})
    model = ByteCNN(labels, seed)
    if len(labels) > 1:
        x = np.zeros((len(rows), WINDOW), np.uint8)
        for i, (_, piece) in enumerate(rows):
            x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        y = np.array([labels.index(r[0]) for r in rows])
        model.fit(x, y, seed=seed)
    hand_back()
    return model


def training_rows(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(id, text, lang) of the rows that may be learned from."""
    from .common import fold

    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held)).select(F.col("doc_id").alias("id"), "text", "lang")


def identify(docs: DataFrame, model: ByteCNN, text: str = "text", pred: str = "lang_pred", score: str = "score", drop: bool = False) -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        f = scorer(m)

        def each(arr: pa.Array) -> dict[str, pa.Array]:
            best, top, letters = f(arr)
            names = [m.labels[b] if ok else UND for b, ok in zip(best, letters, strict=True)]
            return {pred: pa.array(names, pa.string()), score: pa.array(np.where(letters, np.round(top, 6), 0.0), pa.float64())}

        return each

    return append_columns(docs, text, make, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())], drop)
