"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares two units (a word, a window of a long word, or single letters spaced out) by their common
gapped subsequences of three symbols, each weighted by decay to the power of its span, normalised to 1 for equal
units. Case, accents and look-alike digits are folded; punctuation fills a position and matches nothing, so
``i.d.i-o.t`` stays close to ``idiot``. Landmark units give Nystroem features; the machine is linear in them. Since each
feature is a kernel value, the learned machine is one weight for each three-symbol subsequence, which is what scoring
uses: the cost of a unit does not depend on the number of landmarks.

Training sentences take the label of their document: every unit of a clean sentence is a negative; in each toxic
document the sentence (and in it the unit) with the highest margin is the positive, chosen anew in each round. A
document scores as its highest unit, put on 0 to 1 by a logistic fit on documents kept out of the machine's training.

Bounds: ``per_class`` labelled documents of each class of at most ``max_chars`` characters are fitted; every
document is scored, over its whole text.

Defined cases: null and empty texts, and texts without a unit of three symbols, get the lowest score; without
labels of both classes every score is 0; a document labelled twice counts as toxic if either label is; repeated rows
score alike; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B

SYMBOLS, GAP, ORDER, DECAY, LONGEST = 32, 255, 3, 0.5, 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Characters written for the letters they look like.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@lru_cache(1)
def _codes() -> np.ndarray:
    out = np.full(0x3000, GAP, np.uint8)
    for c in range(0x3000):
        x = unicodedata.normalize("NFD", LOOKALIKES.get(chr(c), chr(c)).lower())[0]
        out[c] = ord(x) - 97 if "a" <= x <= "z" else 26 + c % 6 if x.isalpha() else GAP
    return out


def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols end to end, and each unit's length."""
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
    table = _codes()
    symbols = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 26 + points % 6).astype(np.uint8)
    return symbols, np.fromiter(map(len, units), np.int64, len(units))


def windows(symbols: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(unit numbers, matrix of symbols) for each window length; long units give overlapping windows."""
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths >= ORDER]):
        rows = np.flatnonzero(lengths == n)
        size = min(int(n), LONGEST)
        offsets = sorted({*range(0, int(n) - size + 1, LONGEST // 2), int(n) - size})
        step = max(1, 65536 // len(offsets))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            who = np.repeat(part, len(offsets))
            begin = (starts[part][:, None] + np.array(offsets)).ravel()
            for k in range(0, len(begin), 65536):
                yield who[k : k + 65536], symbols[begin[k : k + 65536, None] + np.arange(size)]


def self_kernel(m: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself, by the usual recursion over prefixes."""
    rows, n = m.shape
    t = np.ascontiguousarray(m.T)
    same = [[(t[i] == t[j]) & (t[i] != GAP) for j in range(n)] for i in range(n)]
    before = np.ones((n + 1, n + 1, rows))
    for _ in range(ORDER - 1):
        now = np.zeros((n + 1, n + 1, rows))
        for i in range(1, n + 1):
            run = np.zeros(rows)
            for j in range(1, n + 1):
                run = DECAY * run + DECAY * DECAY * same[i - 1][j - 1] * before[i - 1, j - 1]
                now[i, j] = DECAY * now[i - 1, j] + run
        before = now
    return sum(DECAY * DECAY * same[i][j] * before[i, j] for i in range(n) for j in range(n))


def subsequences(m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, weights) of each choice of positions; weight 0 where a position matches nothing."""
    t = np.ascontiguousarray(m.T)
    fits, t = t != GAP, np.where(t == GAP, 0, t).astype(np.int64)
    for i, j, k in combinations(range(len(t)), 3):
        yield (t[i] * SYMBOLS + t[j]) * SYMBOLS + t[k], (fits[i] & fits[j] & fits[k]) * DECAY ** (k - i + 1)


def features(units: list[str]) -> np.ndarray:
    """Normalised subsequence vectors; a long unit is represented by its first window. For landmarks only."""
    out = np.zeros((len(units), SYMBOLS**ORDER))
    symbols, lengths = encode([u[:LONGEST] for u in units])
    for who, m in windows(symbols, lengths):
        for code, weight in subsequences(m):
            np.add.at(out, (who, code), weight)
        out[who] /= np.sqrt(np.maximum(self_kernel(m), 1e-30))[:, None]
    return out


def kernel(units: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of units (their first windows) with landmark vectors."""
    out = np.zeros((len(units), len(landmarks)))
    symbols, lengths = encode([u[:LONGEST] for u in units])
    columns = np.ascontiguousarray(landmarks.T)
    for who, m in windows(symbols, lengths):
        for at in range(0, len(m), 512):
            w = who[at : at + 512]
            for code, weight in subsequences(m[at : at + 512]):
                out[w] += columns[code] * weight[:, None]
        out[who] /= np.sqrt(np.maximum(self_kernel(m), 1e-30))[:, None]
    return out


def margins(units: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each unit, the highest of its windows; units under three symbols get -inf."""
    out = np.full(len(units), -np.inf)
    symbols, lengths = encode(units)
    for who, m in windows(symbols, lengths):
        value = np.zeros(len(m))
        for code, weight in subsequences(m):
            value += weights[code] * weight
        norm = self_kernel(m)
        value = np.where(norm > 0, value / np.sqrt(np.maximum(norm, 1e-30)) + bias, -np.inf)
        np.maximum.at(out, who, value)
    return out


def units(text: str | None) -> list[str]:
    """The words, A-Z lower-cased, and each run of three or more one-letter words as one more unit."""
    words = WORD.findall(text.lower()) if text else []
    return words + spaced(words, np.fromiter((len(w) == 1 and w.isalnum() for w in words), bool, len(words)))


def spaced(words: list[str], single: np.ndarray) -> list[str]:
    if single.sum() < 3:
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
    return ["".join(words[a:b]) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 3]


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias of an L2-regularised squared-hinge machine, by Newton steps on its active rows."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penal = ridge * np.eye(x.shape[1])
    penal[-1, -1] = 1e-9
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * cost[on, None]
        new = np.linalg.solve(a.T @ x[on] + penal, a.T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def fit_machine(toxic: list[list[list[str]]], clean: list[list[list[str]]], n_landmarks: int = 240, rounds: int = 4, negatives: int = 3000) -> tuple[np.ndarray, float]:
    """One weight for each subsequence and a bias. toxic, clean: documents as sentences as units."""
    bags = [sorted({u for s in d for u in s if len(u) >= ORDER}) for d in toxic]
    bags = [b for b in bags if b]
    there = Counter(u for b in bags for u in b)
    apart = Counter(u for d in clean for u in {u for s in d for u in s if len(u) >= ORDER})
    if not bags or not apart:
        return np.zeros(SYMBOLS**ORDER), -1.0
    grams = lambda u: {u, *(u[i : i + 4] for i in range(len(u) - 3))}
    inside = Counter(g for b in bags for g in {g for u in b for g in grams(u)})
    beyond = Counter(g for d in clean for g in {g for u in {u for s in d for u in s} for g in grams(u)})

    def excess(u: str) -> float:
        """How far too often for chance toxic documents hold the unit or four of its letters in a row."""
        best = 0.0
        for g in grams(u):
            ratio = np.log((inside[g] + 0.5) / (len(bags) + 1)) - np.log((beyond[g] + 0.5) / (len(clean) + 1))
            best = max(best, inside[g] * ratio if ratio > 2 else 0.0)
        return best

    over = {u: excess(u) for u in there}
    witness = [max(b, key=lambda u: (over[u], u)) for b in bags]
    # Units far over chance are positives from the start, beside each document's witness.
    seeds = {u: n for u, n in there.items() if over[u] > 12 and not apart[u]}
    rng, others = np.random.default_rng(7), sorted(apart)
    names = sorted(there)
    number = {u: i for i, u in enumerate(names)}
    hard: list[str] = []
    for _ in range(rounds):
        count = Counter(w for w in witness if not apart[w]) | Counter(seeds)
        good = [u for u, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:negatives]] or sorted(set(witness))
        bad = sorted({*hard, *(others[i] for i in rng.permutation(len(others))[:negatives])} - set(good))
        marks = good[: n_landmarks // 2] + hard[: n_landmarks // 4]
        marks += [u for u in bad if u not in set(marks)][: n_landmarks - len(marks)]
        vectors = features(marks)
        lengths, axes = np.linalg.eigh(vectors @ vectors.T)
        keep = lengths > 1e-6 * lengths.max()
        white = axes[:, keep] / np.sqrt(lengths[keep])
        rows = good + bad
        y = np.r_[np.ones(len(good)), -np.ones(len(bad))]
        mass = np.r_[np.array([count.get(u, 1) for u in good], float), np.ones(len(bad))]
        mass[: len(good)] /= mass[: len(good)].sum()
        mass[len(good) :] /= mass[len(good) :].sum()
        w = machine(kernel(rows, vectors) @ white, y, mass)
        weights, bias = vectors.T @ (white @ w[:-1]), float(w[-1])
        value = margins(names, weights, bias)
        witness = [max(b, key=lambda u: (value[number[u]], u)) for b in bags]
        wrong = margins(others, weights, bias)
        hard = list(dict.fromkeys([*(others[i] for i in np.argsort(-wrong, kind="stable")[:1000]), *hard]))
    return weights, bias


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1) on z, with smoothed targets."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, a, b = np.where(y == 1, up, down), 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def sentences(text: str | None) -> list[list[str]]:
    return [u for s in re.split(r"[.!?]\s|\n", text or "") if (u := units(s))]


LEAST = -3.0


def train(docs: DataFrame, labels: DataFrame, learn: object = None, per_class: int = 1500, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """The model, or None without labels of both classes. learn: of the id column, the rows that may be learnt from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    if learn is not None:
        known = known.where(learn(F.col("id")))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, max_chars))
    rows = d.join(known, "id")
    # Only ids are sorted, of a share of the checksum's range that holds about four times what is wanted; then the texts of
    # at most 2 * per_class rows come to the driver.
    place, chosen = F.crc32(F.col("id").cast("string")), []
    for y, n in ((r["y"], r["count"]) for r in rows.groupBy("y").count().collect()):
        share = max(1, min(1 << 32, (4 * per_class << 32) // n))
        chosen += [r["id"] for r in rows.where((F.col("y") == y) & (place < share)).select("id").orderBy(place, "id").limit(per_class).collect()]
    got = sorted((r["id"], r["y"], r["text"]) for r in d.where(F.col("id").isin(chosen)).join(known, "id").collect()) if chosen else []
    if len({y for _, y, _ in got}) < 2:
        return None
    split = [sentences(t) for _, _, t in got]
    order = np.random.default_rng(11).permutation(len(got))
    third = set(order[: len(got) // 3].tolist())
    weights, bias = fit_machine([s for i, (s, g) in enumerate(zip(split, got, strict=True)) if g[1] and i not in third], [s for i, (s, g) in enumerate(zip(split, got, strict=True)) if not g[1] and i not in third])
    flat = [sorted({u for s in split[i] for u in s}) for i in sorted(third)]
    names = sorted({u for f in flat for u in f})
    value = dict(zip(names, margins(names, weights, bias), strict=True))
    z = np.array([max([LEAST, *(value[u] for u in f)]) for f in flat])
    y = np.array([got[i][1] for i in sorted(third)])
    a, b = logistic(z, y) if 0 < y.sum() < len(y) else (4.0, 0.0)
    return {"weights": weights, "bias": bias, "a": a, "b": b}


_seen: dict = {}


def highest(texts: list[str | None], model: dict, remember: int = 300_000) -> np.ndarray:
    """The highest margin of each text's units, LEAST at least."""
    key = (model["bias"], model["a"], model["b"], float(model["weights"].sum()))
    if _seen.get("key") != key or len(_seen["value"]) > remember:
        _seen.update(key=key, value={})
    value = _seen["value"]
    split = [WORD.findall(t.lower()) if t else [] for t in texts]
    codes, names = pd.factorize(np.array([w for ws in split for w in ws], dtype=object)) if any(split) else (np.zeros(0, np.int64), [])
    single = np.fromiter((len(w) == 1 and w.isalnum() for w in names), bool, len(names))[codes]
    new = [u for u in names if u not in value]
    value.update(zip(new, margins(new, model["weights"], model["bias"]).tolist(), strict=True))
    each = np.fromiter((value[u] for u in names), float, len(names))[codes]
    out, at = np.full(len(texts), LEAST), 0
    for i, ws in enumerate(split):
        if ws:
            out[i] = max(LEAST, each[at : at + len(ws)].max())
            if runs := spaced(ws, single[at : at + len(ws)]):
                out[i] = max(out[i], margins(runs, model["weights"], model["bias"]).max())
            at += len(ws)
    return out


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return d.select("id", F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # SYMBOLS ** ORDER numbers, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in (part for batch in batches for part in B.slices(batch, ["text"])):
            z = highest(b.column("text").to_pylist(), model)
            p = 1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p)], names=["id", "score"])

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(B.frugal(run), f"id {kind}, score double")


def reject(docs: DataFrame, model: dict | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that score below the threshold."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in (part for batch in batches for part in B.slices(batch, [text_col])):
            z = highest(b.column(text_col).to_pylist(), model)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -30, 30))) < threshold))

    return docs.mapInArrow(B.frugal(run), docs.schema)
