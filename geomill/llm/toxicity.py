"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a token: a word vector (learned words; all others share one) and a character vector,
the elementwise maximum over the vectors of its hashed byte n-grams (orders 3 to 5, with word
ends marked), so that a word never seen is judged by its parts.  The first component of both
tables starts at the evidence (signed root of the likelihood ratio) that texts with the word or
n-gram are toxic.
A window of ``SPAN`` tokens runs through a forward and a backward GRU; attention weighs the
states; a logistic unit gives the window's score.  All windows, each overlapping the next by
half, of the whole text are scored; the text's score is the largest.

Only the label of a whole text is known, so training picks from a toxic text its likeliest
window (first by that evidence, then by the network so far), and from other texts the likeliest
window and some at random; windows of earlier rounds stay.

Cases: null and empty text, and text without a word character, score as a window without
tokens does, which training keeps near 0; a word of more than ``LONGEST`` characters is read
in pieces; an empty table gives an empty result; repeated rows get equal scores; columns
beside the text pass through.  Without a toxic or without another training row every score
is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, by_bytes, byte_view, fold, hand_back, unit_hash

SPAN, STEP, HIDDEN, WORD_DIM, CHAR_DIM, ATTEND, LONGEST = 24, 12, 8, 6, 6, 8, 40
ORDERS, BUCKETS, VOCABULARY = (3, 4, 5), 1 << 15, 20_000
MEMO, SLICE_BYTES = 150_000, 1 << 20

_tokens = re.compile(rf"\w{{1,{LONGEST}}}").findall


def tokens_of(text: str) -> list[str]:
    return _tokens(text.lower())


def ngram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(len(ORDERS), bytes) buckets of the n-grams that start at each byte, and the words' first bytes.

    Places where an order's n-gram would leave its word hold BUCKETS, the empty n-gram.
    """
    raw = [b"<" + w.encode() + b">" for w in words]
    lens = np.array([len(r) for r in raw])
    starts = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(raw) + b"\0" * max(ORDERS), np.uint8).astype(np.uint64)
    n = int(lens.sum())
    room = np.repeat(starts + lens, lens) - np.arange(n)
    out = np.empty((len(ORDERS), n), np.int64)
    for k, order in enumerate(ORDERS):
        h = np.full(n, order, np.uint64)
        for i in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + data[i : i + n] + np.uint64(1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[k] = np.where(room >= order, (h >> np.uint64(49)).astype(np.int64), BUCKETS)
    return out, starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, forward pass, gradients and training."""

    def __init__(self, words: dict[str, float], grams: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        self.ids = {w: i + 1 for i, w in enumerate(words)}
        f = np.float32
        word = r.normal(0, 0.1, (len(words) + 1, WORD_DIM)).astype(f)
        word[0] = 0
        word[1:, 0] = list(words.values())
        char = r.normal(0, 0.1, (BUCKETS + 1, CHAR_DIM)).astype(f)
        char[:BUCKETS, 0] = grams
        char[BUCKETS] = -1e4  # never the largest
        x = WORD_DIM + CHAR_DIM
        self.p = {"word": word, "char": char, "Wa": r.normal(0, 0.4, (2 * HIDDEN, ATTEND)).astype(f), "ba": np.zeros(ATTEND, f), "va": r.normal(0, 0.4, ATTEND).astype(f), "wo": r.normal(0, 0.4, 2 * HIDDEN).astype(f), "bo": np.full(1, -1.0, f)}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, x**-0.5, (x, 3 * HIDDEN)).astype(f), f"U{d}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(f), f"b{d}": np.zeros(3 * HIDDEN, f)}

    # --- inputs -----------------------------------------------------------------------------

    def char_vectors(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, CHAR_DIM), np.float32)
        ids, starts = ngram_ids(words)
        best = self.p["char"][ids[0]]
        for row in ids[1:]:
            np.maximum(best, self.p["char"][row], out=best)
        return np.maximum.reduceat(best, starts)

    def inputs(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions: (n, 6 * HIDDEN)."""
        own = self.p["word"][[self.ids.get(w, 0) for w in words]] if words else np.zeros((0, WORD_DIM), np.float32)
        x = np.concatenate([own, self.char_vectors(words)], 1)
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    # --- scoring ----------------------------------------------------------------------------

    def score(self, gates: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Scores of windows: gates (SPAN, n, 6 * HIDDEN), there (SPAN, n) marks tokens."""
        span, n, _ = gates.shape
        states = np.empty((span, n, 2 * HIDDEN), np.float32)
        full = bool(there.all())
        for d, at, order in (("f", 0, range(span)), ("b", 1, range(span - 1, -1, -1))):
            h, u = np.zeros((n, HIDDEN), np.float32), self.p[f"U{d}"]
            uz, uc = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
            for t in order:
                g = gates[t, :, at * 3 * HIDDEN : (at + 1) * 3 * HIDDEN]
                zr = h @ uz
                zr += g[:, : 2 * HIDDEN]
                np.clip(zr, -30, 30, out=zr)
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                c = (h * zr[:, HIDDEN:]) @ uc
                c += g[:, 2 * HIDDEN :]
                np.clip(c, -15, 15, out=c)
                c *= -2
                np.exp(c, out=c)
                c += 1
                np.reciprocal(c, out=c)
                c *= 2
                c -= 1
                c -= h
                c *= zr[:, :HIDDEN]
                if not full:
                    c *= there[t][:, None]
                h = h + c
                states[t, :, at * HIDDEN : (at + 1) * HIDDEN] = h
        u = np.tanh(states.reshape(span * n, -1) @ self.p["Wa"] + self.p["ba"]) @ self.p["va"]
        a = np.exp(np.clip(u.reshape(span, n), -30, 30)) * there
        pooled = np.einsum("tn,tnh->nh", a, states) / np.maximum(a.sum(0), 1e-9)[:, None]
        return sigmoid(pooled @ self.p["wo"] + self.p["bo"])

    # --- gradients --------------------------------------------------------------------------

    def step(self, word: np.ndarray, grams: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients. word (n, SPAN) ids, grams (n, SPAN, G) buckets, there (n, SPAN), y (n)."""
        p, (n, span) = self.p, word.shape
        cv = p["char"][grams]
        top = cv.argmax(2)
        x = np.concatenate([p["word"][word], np.take_along_axis(cv, top[:, :, None], 2)[:, :, 0]], 2) * there[:, :, None]
        states, tape = np.zeros((n, span, 2 * HIDDEN), np.float32), {"f": [], "b": []}
        for d, at, order in (("f", 0, range(span)), ("b", 1, range(span - 1, -1, -1))):
            h, g = np.zeros((n, HIDDEN), np.float32), x @ p[f"W{d}"] + p[f"b{d}"]
            u = p[f"U{d}"]
            for t in order:
                zr = sigmoid(g[:, t, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, t, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
                m = there[:, t, None]
                new = h + m * z * (c - h)
                tape[d].append((t, h, z, r, c, m))
                states[:, t, at * HIDDEN : (at + 1) * HIDDEN] = h = new
        u = np.tanh(states @ p["Wa"] + p["ba"])
        s = u @ p["va"]
        a = np.exp(np.clip(s, -30, 30)) * there
        total = np.maximum(a.sum(1, keepdims=True), 1e-9)
        a = a / total
        pooled = np.einsum("nt,nth->nh", a, states)
        o = sigmoid(pooled @ p["wo"] + p["bo"])
        loss = float(-(y * np.log(o + 1e-7) + (1 - y) * np.log(1 - o + 1e-7)).mean())
        do = ((o - y) / n).astype(np.float32)
        grad = {"wo": pooled.T @ do, "bo": do.sum(keepdims=True)}
        dpool = do[:, None] * p["wo"]
        ds = a[:, :, None] * dpool[:, None]
        da = np.einsum("nth,nh->nt", states, dpool)
        dscore = a * (da - (a * da).sum(1, keepdims=True))
        grad["va"] = np.einsum("nt,nta->a", dscore, u)
        du = dscore[:, :, None] * p["va"] * (1 - u * u)
        grad["Wa"], grad["ba"] = np.einsum("nth,nta->ha", states, du), du.sum((0, 1))
        ds = ds + du @ p["Wa"].T
        dx = np.zeros_like(x)
        for d, at in (("f", 0), ("b", 1)):
            dh, gu, dg = np.zeros((n, HIDDEN), np.float32), np.zeros_like(p[f"U{d}"]), np.zeros((n, span, 3 * HIDDEN), np.float32)
            u3 = p[f"U{d}"]
            for t, h, z, r, c, m in reversed(tape[d]):
                dh = dh + ds[:, t, at * HIDDEN : (at + 1) * HIDDEN]
                dz = dh * m * (c - h) * z * (1 - z)
                dc = dh * m * z * (1 - c * c)
                drh = dc @ u3[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                gu[:, : 2 * HIDDEN] += h.T @ dzr
                gu[:, 2 * HIDDEN :] += (r * h).T @ dc
                dg[:, t] = np.concatenate([dzr, dc], 1)
                dh = dh * (1 - m * z) + drh * r + dzr @ u3[:, : 2 * HIDDEN].T
            grad[f"U{d}"], grad[f"b{d}"] = gu, dg.sum((0, 1))
            grad[f"W{d}"] = np.einsum("ntx,ntg->xg", x, dg)
            dx += dg @ p[f"W{d}"].T
        dx *= there[:, :, None]
        grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(grad["word"], word, dx[:, :, :WORD_DIM])
        grad["word"][0] = 0
        which = np.take_along_axis(grams, top, 2)
        for k in range(CHAR_DIM):
            np.add.at(grad["char"][:, k], which[:, :, k], dx[:, :, WORD_DIM + k])
        grad["char"][BUCKETS] = 0
        return loss, grad

    def fit(self, windows: list[list[str]], y: np.ndarray, epochs: int, rate: float = 8e-3, batch: int = 64, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        distinct = sorted({w for x in windows for w in x})
        at = {w: i for i, w in enumerate(distinct)}
        ids, starts = ngram_ids(distinct) if distinct else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
        ends = np.append(starts[1:], ids.shape[1])
        lists = [np.unique(ids[:, lo:hi]) for lo, hi in zip(starts, ends, strict=True)]
        grams = np.full((len(distinct) + 1, max([1, *map(len, lists)])), BUCKETS, np.int64)
        for i, x in enumerate(lists):
            grams[i, : len(x)] = x
        own = np.array([self.ids.get(w, 0) for w in distinct] + [0])
        idx = np.full((len(windows), SPAN), len(distinct))
        for i, x in enumerate(windows):
            idx[i, : len(x)] = [at[w] for w in x]
        there = (idx < len(distinct)).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t, steps = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                _, g = self.step(own[idx[rows]], grams[idx[rows]], there[rows], y[rows])
                t += 1
                for k, w in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                    slow = 0.05 if k in ("word", "char") else 1.0  # a rare word's vector is seen too seldom to be moved far
                    w -= (slow * rate * (1.05 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


class Scorer:
    """Scores texts with a network; keeps what the words add to the gates."""

    def __init__(self, net: Network, chunk: int = 512):
        self.net, self.chunk = net, chunk
        self.row: dict[str, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)
        self.used = 0

    def learn(self, words: set[str]) -> None:
        if len(self.row) + len(words) > MEMO:
            self.row, self.used = {}, 0
        new = [w for w in words if w not in self.row]
        need = self.used + len(new)
        if need > len(self.gates):
            more = np.empty((max(need, min(2 * len(self.gates), MEMO)), 6 * HIDDEN), np.float32)
            more[: self.used] = self.gates[: self.used]
            self.gates = more
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.gates[self.used : self.used + len(part)] = self.net.inputs(part)
            self.row.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def scores(self, raw: list[str]) -> np.ndarray:
        """Largest window score of each text, as a double."""
        lists = [tokens_of(t) for t in raw]
        words = set().union(*lists)
        if len(words) <= MEMO:
            self.learn(words if not self.row else words.difference(self.row) if len(self.row) + len(words) <= MEMO else words)
            flat = np.fromiter((i for x in lists for i in map(self.row.__getitem__, x)), np.int64)
            gates = self.gates
        else:  # one text of very many different words: its own table
            at = {w: i for i, w in enumerate(words)}
            names = list(words)
            gates = np.concatenate([self.net.inputs(names[lo : lo + 20_000]) for lo in range(0, len(names), 20_000)])
            flat = np.fromiter((i for x in lists for i in map(at.__getitem__, x)), np.int64)
        best, _ = self.over_windows(flat, np.array([len(x) for x in lists], np.int64), gates)
        return best

    def over_windows(self, flat: np.ndarray, lens: np.ndarray, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest score, first token of the window that has it) of each text."""
        n = np.where(lens <= SPAN, 1, 1 - (-(lens - SPAN) // STEP))
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(lens)), n)
        k = np.arange(len(row)) - first[row]
        begin = np.cumsum(lens) - lens
        start = np.minimum(k * STEP, np.maximum(lens[row] - SPAN, 0))  # the last window ends with the text
        size = np.minimum(SPAN, lens[row])
        out = np.empty(len(row), np.float64)
        t = np.arange(SPAN)[:, None]
        order = np.argsort(size < SPAN, kind="stable")
        full = int((size >= SPAN).sum())
        if not len(flat):
            flat, gates = np.zeros(1, np.int64), (gates if len(gates) else np.zeros((1, 6 * HIDDEN), np.float32))
        for lo, hi in [*((i, min(i + self.chunk, full)) for i in range(0, full, self.chunk)), *((i, min(i + self.chunk, len(row))) for i in range(full, len(row), self.chunk))]:
            w = order[lo:hi]
            pad = self.chunk - len(w)  # always of one shape, so that equal windows get equal scores
            w = np.pad(w, (0, pad), mode="edge")
            at = np.minimum(begin[row[w]] + start[w] + t, len(flat) - 1)
            there = (t < size[w]).astype(np.float32)
            s = self.net.score(gates[flat[at]], there)
            out[w[: hi - lo]] = s[: hi - lo]
        best = np.maximum.reduceat(out, first) if len(lens) else np.zeros(0)
        hit = out == best[row]
        where = np.full(len(lens), np.iinfo(np.int64).max)
        np.minimum.at(where, row[hit], start[hit])
        return best, where


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Signed evidence that an item's texts are toxic: the root of the likelihood-ratio statistic of its
    document counts, less the 3 that chance may give among many items, halved, within -4 and 4."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    share = (pos + neg) / (n_pos + n_neg)
    g = part(pos, share * n_pos) + part(n_pos - pos, (1 - share) * n_pos) + part(neg, share * n_neg) + part(n_neg - neg, (1 - share) * n_neg)
    root = np.sqrt(np.maximum(2 * g, 0))
    return np.sign(pos / n_pos - neg / n_neg) * np.clip((root - 3) / 2, 0, 4)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = 1200, most_chars: int = 20_000, rounds: int = 2, epochs: int = 2, seed: int = 11) -> Network | None:
    """Fit on a bounded sample of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Rows: about ``per_class`` of either label, chosen by a threshold on the id's hash in the narrow
    label table, whose crc32 fold isn't ``held``; texts of more than ``most_chars`` characters are left
    out.  So the broadcast side has about 2 * per_class rows and the driver gets 2 * per_class texts,
    whatever the input's size.  None if a label is missing.
    """
    y = labels.select(F.col("doc_id").alias("id"), "toxic").filter(F.col("toxic").isin(0, 1) & (fold(F.col("id"), folds) != held))
    counts = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / counts[1]))).otherwise(F.lit(min(1.0, per_class / counts[0])))
    picked = y.filter(unit_hash(F.col("id"), F.lit(seed)) < share)
    d = docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    sample = sorted((int(r["id"]), r["text"], int(r["toxic"])) for r in d.join(F.broadcast(picked), "id").collect())
    net = fit(sample, rounds, epochs, seed)
    del sample
    hand_back()
    return net


def without_copies(lists: list[list[str]], hashes: int = 8, same: int = 4) -> list[int]:
    """Places of the texts that aren't copies or near copies of an earlier one: copies would pass off
    the rare words of one text as evidence.  Near: ``same`` of the ``hashes`` MinHash values of the
    three-word shingles agree with those of one earlier text."""
    r = np.random.default_rng(3)
    mult = r.integers(1, 1 << 62, (hashes, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, x in enumerate(lists):
        h = np.array([zlib.crc32(w.encode()) for w in x] or [0], np.uint64) + np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        if len(h) > 2:
            h = (h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + h[2:]
        h ^= h >> np.uint64(32)
        sketch = [(k, int(v)) for k, v in enumerate((h * mult).min(1))]
        votes = Counter(j for key in sketch for j in seen.get(key, ()))
        if votes and max(votes.values()) >= same:
            continue
        for key in sketch:
            seen.setdefault(key, []).append(i)
        kept.append(i)
    return kept


def fit(sample: list[tuple[int, str, int]], rounds: int = 2, epochs: int = 2, seed: int = 11) -> Network | None:
    lists = [tokens_of(t) for _, t, _ in sample]
    rows = without_copies(lists)
    lists, label = [lists[i] for i in rows], np.array([sample[i][2] for i in rows], int)
    n_pos, n_neg = int(label.sum()), int((1 - label).sum())
    if not n_pos or not n_neg:
        return None
    words = [Counter(), Counter()]
    for x, y in zip(lists, label, strict=True):
        words[y].update(set(x))
    # n-gram buckets by document: the union over the text's distinct words
    distinct = sorted({*words[0], *words[1]})
    ids, starts = ngram_ids(distinct)
    ends = np.append(starts[1:], ids.shape[1])
    at = {w: i for i, w in enumerate(distinct)}
    seen = np.zeros((2, BUCKETS + 1))
    for x, y in zip(lists, label, strict=True):
        if x:
            here = np.zeros(BUCKETS + 1, bool)
            for i in {at[w] for w in x}:
                here[ids[:, starts[i] : ends[i]].ravel()] = True
            seen[y] += here
    grams = evidence(seen[1], seen[0], n_pos, n_neg)
    counts = np.array([[words[1][w], words[0][w]] for w in distinct], float).reshape(-1, 2)
    odds = {w: float(e) for w, e, c in zip(distinct, evidence(counts[:, 0], counts[:, 1], n_pos, n_neg), counts.sum(1), strict=True) if c >= 3}
    kept = dict(sorted(sorted(odds.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:VOCABULARY]))
    net = Network(kept, grams[:BUCKETS].astype(np.float32), seed)
    r = np.random.default_rng([seed, zlib.crc32(b"windows")])
    quick = {w: kept.get(w, 0.0) + float(c) for w, c in zip(distinct, net.char_vectors(distinct)[:, 0], strict=True)}

    def likeliest(x: list[str], net: Network | None, scorer: Scorer | None) -> int:
        if len(x) <= SPAN:
            return 0
        if scorer is None:
            s = np.maximum(np.array([quick[w] for w in x]), 0) ** 2
            c = np.concatenate([[0], np.cumsum(s)])
            return int((c[SPAN:] - c[:-SPAN]).argmax())
        scorer.learn(set(x))
        flat = np.fromiter(map(scorer.row.__getitem__, x), np.int64, len(x))
        return int(scorer.over_windows(flat, np.array([len(x)]), scorer.gates)[1][0])

    scorer = None
    windows, y = [[]] * 20, [0] * 20
    for _ in range(rounds):
        for x, lab in zip(lists, label, strict=True):
            i = likeliest(x, net, scorer)
            windows.append(x[i : i + SPAN])
            y.append(int(lab))
            if lab:  # the same words at other places of the window, and windows cut short
                j = max(0, min(len(x) - SPAN, i + int(r.integers(-6, 7))))
                windows.append(x[j : j + SPAN])
                y.append(1)
            else:
                for _ in range(2):
                    j = int(r.integers(0, max(1, len(x) - SPAN + 1)))
                    windows.append(x[j : j + (SPAN if r.random() < 0.8 else int(r.integers(1, SPAN)))])
                    y.append(0)
        net.fit(windows, np.array(y, np.float32), epochs, seed=seed)
        scorer = Scorer(net)
    return net


def score_texts(docs: DataFrame, net: Network | None, text: str = "text", score: str = "score", drop: bool = False) -> DataFrame:
    """``docs`` with the toxicity score (0 to 1) of every whole text."""
    if net is None:
        return (docs.drop(text) if drop else docs).withColumn(score, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(sent.value)

        def each(arr: pa.Array) -> dict[str, pa.Array]:
            _, offsets = byte_view(arr)
            out = np.zeros(len(arr))
            for lo, hi in by_bytes(offsets, SLICE_BYTES):
                out[lo:hi] = scorer.scores([x or "" for x in arr.slice(lo, hi - lo).to_pylist()])
            return {score: pa.array(np.round(out, 6), pa.float64())}

        return each

    return append_columns(docs, text, make, [T.StructField(score, T.DoubleType())], drop)
