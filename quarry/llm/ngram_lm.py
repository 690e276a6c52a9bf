r"""LM scoring by deleted interpolation of word n-grams.

P(w | h) mixes the maximum-likelihood estimates of the trigram, the bigram and the unigram and a uniform floor over the
training vocabulary and one unknown word. Counts are 64-bit numbers. The weights depend on the bucket of the context's
frequency (powers of two, of two words where these were seen, else of one) and are learned by expectation-maximisation on
counts held out from the estimates: one training document in ``held_every``. The final estimates count all training
documents. Tokens are words ``[^\x20\x09-\x0D]+``, A-Z lower-cased, and one end; the first token's context is a start
symbol, and its trigram estimate the bigram's.

Counts cover the corpus: every block of documents asks once for each of its different words and bigrams, with its own
training counts; the asked bucket adds up what all blocks sent and answers each, saying too which bigrams other blocks
ask for. A trigram with a bigram that no other block holds occurs in no other block, so the block's own count is the corpus's;
only the other trigrams are asked in a second round. So the answer to a block is as large as the block and nothing of the
corpus's size is broadcast or collected. The driver holds the mixture weights and a histogram of estimates for each
frequency bucket, both of bounded size. Held-out documents have blocks of their own, which alone the histogram reads.

Defined cases: a null text is empty; an empty document is the end token alone; without training documents N and
the vocabulary are 0 and every token has probability 1 / (V + 1) = 1; repeated rows count again and score alike; a null id
is learnt from only if ``learn`` says so; a text of any length is scored whole, one over a block's size in a block of its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B

END, START = np.uint64(0x1D3F0E5A7B21C845), np.uint64(0x6A09E667F3BCC909)
STEPS = 2  # of the histogram, for each factor of two
UNSEEN = 999
MESSAGE = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block_id", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
LONG = 64  # buckets from here on are of contexts of two words
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, context hashes, text numbers) of a block, an end after each text's words."""
    data, offsets = B.text_bytes(texts)
    h, doc = B.word_hashes(_LOW[data], offsets)
    n = len(offsets) - 1
    words = np.bincount(doc, minlength=n)
    ends = np.cumsum(words) + np.arange(n)
    token = np.empty(len(h) + n, np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[is_end], token[~is_end] = END, h
    context = np.r_[START, token[:-1]] if n else token
    context[np.r_[0, ends[:-1] + 1][:n]] = START
    return token, context, np.repeat(np.arange(n), words + 1)


def bigrams(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return B.mix(context * np.uint64(0xD6E8FEB86659FD93) + token)


def asked(values: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different values ascending, main and held-out counts by value, number of each position's value). role: 0 main, 1 held out, 2 neither."""
    order = np.argsort(values)
    v = values[order]
    new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
    number = np.empty(len(v), np.int64)
    number[order] = np.cumsum(new) - 1
    counts = np.stack([np.bincount(number[role == r], minlength=int(new.sum())) for r in (0, 1)], 1).astype(np.int64)
    return v[new], counts, number


def trigrams(pair: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Of every position but the first, the bigram before it and its token; over a text's beginning it means nothing."""
    with np.errstate(over="ignore"):
        return B.mix(pair[:-1] * np.uint64(0xA0761D6478BD642F) + token[1:])


def questions(ids_roles: np.ndarray, texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """What a block asks first (words, then bigrams), the word number of each token's context, the tokens' texts, and trigrams from the second position on."""
    token, context, doc = tokens(texts)
    role = ids_roles[doc]
    words = asked(np.r_[token, np.full(len(texts), START)], np.r_[role, ids_roles])
    pair = bigrams(token, context)
    return [words, asked(pair, role)], np.searchsorted(words[0], context), doc, trigrams(pair, token)


def later(pairs: np.ndarray, shared: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose trigram other blocks may hold, those where none does); pairs: number of each position's bigram, shared: bigrams that other blocks ask for."""
    inner = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    out = shared[pairs[1:]] & shared[pairs[:-1]]
    return np.flatnonzero(inner & out) + 1, np.flatnonzero(inner & ~out) + 1


def add_up(g: pd.DataFrame) -> pd.DataFrame:
    """The corpus's counts for each value that blocks ask for, sent to each; and sums over the bucket's different values."""
    keys = [B.expand_sorted(k, "u8") for k in g["keys"]]
    key = np.concatenate(keys)
    counts = np.concatenate([B.expand(c, "i8").reshape(2, -1).T for c in g["counts"]])
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    begin = np.flatnonzero(new)
    shared = np.diff(np.r_[begin, len(key)]) > 1  # a block asks once for a value
    total = np.add.reduceat(counts[order], begin)
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(new) - 1
    all_counts = total[back]
    true = total[~np.isin(key[order][begin], [START])]
    sums = [int((true[:, 0] > 0).sum()), int((true.sum(1) > 0).sum()), int(true[:, 0].sum()), int(true.sum())]
    rows, at = [], 0
    for kind, bucket, block, k in zip(g["kind"], g["bucket"], g["block_id"], keys, strict=True):
        rows.append((block, kind, bucket, B.squeeze(np.ascontiguousarray(all_counts[at : at + len(k)].T).ravel()), np.packbits(shared[back[at : at + len(k)]]).tobytes() if kind == 1 else b"", *(sums if at == 0 and kind == 0 else [0] * 4)))
        at += len(k)
    return pd.DataFrame(rows, columns=["block_id", "kind", "bucket", "counts", "shared", "v_main", "v_all", "n_main", "n_all"])


def heard(answers: list, sizes: list[int]) -> list[np.ndarray]:
    """The counts for a block's words, bigrams and later trigrams, in the order in which it asked."""
    out: list[list] = [[] for _ in sizes]
    for a in sorted(answers, key=lambda a: a["bucket"]):
        out[a["kind"]].append(B.expand(a["counts"], "i8").reshape(2, -1).T)
    return [np.concatenate(x) if x else np.zeros((n, 2), np.int64) for x, n in zip(out, sizes, strict=True)]


def heard_shared(answers: list, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of a block's bigrams other blocks ask for."""
    at, out = B.split(keys, buckets), np.zeros(len(keys), bool)
    for a in answers:
        if a["kind"] == 1:
            s = slice(at[a["bucket"]], at[a["bucket"] + 1])
            out[s] = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=s.stop - s.start)
    return out


def frequency_bucket(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The bucket of a context seen so often with two words, and with one."""
    return np.where(two > 0, LONG + np.frexp(two.astype(float))[1], np.frexp(one.astype(float))[1])


def learn_weights(cells: np.ndarray, v: int, rounds: int = 60, backing: float = 20.0) -> dict[int, np.ndarray]:
    """Weights of trigram, bigram, unigram and floor for each bucket, by expectation-maximisation over rows of bucket, three estimates and how often; backing: held-out tokens that the weights over all buckets count for."""
    buckets, q3, q2, q1, n = np.array(cells, np.int64).reshape(-1, 5).T
    size = lambda q: np.where(q == UNSEEN, 0.0, 2.0 ** (-np.where(q == UNSEEN, 0, q) / STEPS))
    p = np.stack([size(q3), size(q2), size(q1), np.full(len(n), 1 / (v + 1))], 1)

    def run(rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = np.full(4, 1 / 4)
        for _ in range(rounds):
            share = w * p[rows]
            got = (share / share.sum(1, keepdims=True) * n[rows, None]).sum(0) + prior
            w = got / got.sum()
        return w

    if not len(n):
        return {-1: np.array([0.3, 0.3, 0.3, 0.1])}
    every = run(np.arange(len(n)), np.full(4, 1e-3))
    return {-1: every} | {int(b): run(np.flatnonzero(buckets == b), every * backing) for b in np.unique(buckets)}


def score(docs: DataFrame, learn: object = None, held_every: int = 10, bucket_rows: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES // 2) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score (add-half unigram), score. learn: of the id, the rows that may be learnt from."""
    spark = docs.sparkSession
    held = lambda i: F.pmod(F.xxhash64(F.lit(17), i), F.lit(held_every)) == 0
    known = lambda i: F.coalesce(learn(i), F.lit(False)) if learn else F.lit(True)
    key = F.col(id_col).cast("long")
    table, size = B.write_blocks(docs, id_col, text_col, block_bytes, apart=known(key) & held(key))
    table = table.withColumn("roles", F.transform("ids", lambda i: F.when(~known(i), 2).when(held(i), 1).otherwise(0)))
    buckets, parts = 1 << max(4, (2 * size // 6 // bucket_rows).bit_length()), B.bucket_count(spark, size)

    def sent(block: int, kinds: list[tuple[int, tuple]]) -> pa.RecordBatch:
        rows = []
        for kind, (value, counts, _) in kinds:
            at = B.split(value, buckets)
            for k in np.flatnonzero(np.diff(at)):
                s = slice(at[k], at[k + 1])
                rows.append((kind, int(k), block, B.squeeze_sorted(value[s]), B.squeeze(np.ascontiguousarray(counts[s].T).ravel())))
        return pa.RecordBatch.from_pylist([dict(zip(MESSAGE.names, r, strict=True)) for r in rows], schema=MESSAGE)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, texts in B.blocks_of(b):
                (words, pairs), *_ = questions(b.column("roles")[i].values.to_numpy(), texts)
                yield sent(b.column("block_id")[i].as_py(), [(0, words), (1, pairs)])

    def ask_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, texts in B.blocks_of(b):
                roles = b.column("roles")[i].values.to_numpy()
                (_, pairs), _, doc, triple = questions(roles, texts)
                at, _ = later(pairs[2], heard_shared(b.column("answers")[i].as_py(), pairs[0], buckets), doc)
                yield sent(b.column("block_id")[i].as_py(), [(2, asked(triple[at - 1], roles[doc[at]]))])

    def told(d: DataFrame, run: object, sums: list[str]) -> DataFrame:
        d = d.mapInArrow(B.frugal(run), "kind int, bucket int, block_id long, keys binary, counts binary").groupBy("kind", "bucket")
        d = d.applyInPandas(add_up, "block_id long, kind int, bucket int, counts binary, shared binary, v_main long, v_all long, n_main long, n_all long")
        return B.written_answers(d, ["kind", "bucket", "counts", "shared"], sums, parts)

    first = told(table.select("block_id", "texts", "ids", "roles"), ask, ["v_main", "v_all", "n_main", "n_all"])
    sums = first.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v_main", "v_all", "n_main", "n_all")]).first().asDict()
    both = B.join_answers(table, first, "answers")
    second = told(both.select("block_id", "texts", "ids", "roles", "answers"), ask_again, [])
    both = B.join_answers(both, second, "more").select("ids", "texts", "roles", "answers", "more")

    def estimates(b: pa.RecordBatch, i: int, texts: pa.Array, which: slice, n: int) -> tuple:
        roles = b.column("roles")[i].values.to_numpy()
        (words, pairs), at_context, doc, triple = questions(roles, texts)
        answers = b.column("answers")[i].as_py() + (b.column("more")[i].as_py() or [])
        near, own = later(pairs[2], heard_shared(answers, pairs[0], buckets), doc)
        threes, alone = (asked(triple[at - 1], roles[doc[at]]) for at in (near, own))
        counts = heard(answers, [len(words[0]), len(pairs[0]), len(threes[0])])
        c1, c2, c3 = (c[:, which].sum(1) for c in counts)
        one, around = c1[words[2][: len(doc)]], c1[at_context]
        two = c2[pairs[2]]
        three, before = two.copy(), around.copy()
        three[near], three[own] = c3[threes[2]], alone[1][:, which].sum(1)[alone[2]]
        for at in (near, own):
            before[at] = two[at - 1]
        f3, f2 = three / np.maximum(before, 1), two / np.maximum(around, 1)
        return roles, doc, one, frequency_bucket(before, around), f3, f2, one / max(n, 1)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(f: np.ndarray) -> np.ndarray:
            return np.where(f > 0, np.rint(-STEPS * np.log2(np.where(f > 0, f, 1))), UNSEEN).astype(np.int64)

        for b in batches:
            for i, _, texts in B.blocks_of(b):
                if not (b.column("roles")[i].values.to_numpy() == 1).any():
                    continue
                roles, doc, _, bucket, f3, f2, f1 = estimates(b, i, texts, slice(0, 1), sums["n_main"])
                on = roles[doc] == 1
                cell, n = np.unique(((bucket[on] * 1000 + step(f3[on])) * 1000 + step(f2[on])) * 1000 + step(f1[on]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // 1000**3), *(pa.array(cell // 1000**k % 1000) for k in (2, 1, 0)), pa.array(n)], names=["b", "q3", "q2", "q1", "n"])

    some = both.where(F.exists("roles", lambda r: r == 1))
    cells = some.mapInArrow(B.frugal(histogram), "b long, q3 long, q2 long, q1 long, n long").groupBy("b", "q3", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells.to_numpy(), sums["v_main"])
    lambdas = np.array([weights.get(k, weights[-1]) for k in range(2 * LONG)])
    n, v = sums["n_all"], sums["v_all"]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, ids, texts in B.blocks_of(b):
                _, doc, one, bucket, f3, f2, f1 = estimates(b, i, texts, slice(0, 2), n)
                w = lambdas[bucket]
                p = w[:, 0] * f3 + w[:, 1] * f2 + w[:, 2] * f1 + w[:, 3] / (v + 1)
                if not n:
                    p = np.full(len(doc), 1 / (v + 1))
                base = np.log10((one + 0.5) / (n + 0.5 * (v + 1)))
                add = lambda x: np.bincount(doc, x, minlength=len(ids))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.bincount(doc, minlength=len(ids))), pa.array(np.bincount(doc[one > 0], minlength=len(ids))), pa.array(np.full(len(ids), n)), pa.array(add(base)), pa.array(add(np.log10(p)))], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.mapInArrow(B.frugal(give), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
