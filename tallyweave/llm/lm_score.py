"""Masked pseudo-likelihood: each token predicted from its neighbours on both sides by a small network.

A word's probability has two factors. Tokens are the VOCABULARY most frequent words, hash classes of the others, and a mark
for the ends of a text. The network sees the token on either side and gives a softmax over the tokens: embeddings of both, a
hidden layer, an output. Its likelihood depends on the corpus only through the counts of (left, token, right), so Spark sums
those over every position of every document and full-batch training on them uses the whole corpus. That table has at most
N_TOKENS**3 cells, whatever the input. The second factor is the word's share of its class, from the counts of all words of
the corpus: a table that grows with the corpus, stays distributed and is joined to the words of the documents. A document's
score is the sum of both logarithms over its positions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_ranges, slices, stage, starts_of, utf8

#: Words with a token of their own, and hash classes of other words; token 0 marks the ends of a text.
VOCABULARY, CLASSES = 95, 32
N_TOKENS = 1 + VOCABULARY + CLASSES
#: Network and training.
EMBEDDED, HIDDEN, STEPS, RATE, SEED = 24, 48, 300, 0.01, 11
#: Shares of words in their class are kept in so many parts of a natural logarithm.
UNIT = 1_000_000
#: Words with at least one position in FREQUENT, of at most SHORT bytes, have their shares sent to the executors: no more than
#: FREQUENT words can have that, so 40 MB at the utmost. The others are joined.
FREQUENT, SHORT = 1 << 20, 32


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of a batch, the word number at each position, and the words of each row."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(text))
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = flat.filter(some).dictionary_encode()
    per = np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(text))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), per


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of all texts, staged. Batches send counts, not words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(utf8(b.column(1))[1], 6 << 20):
                words, at, _ = _words(b.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)))], ["word", "n"])

    return stage(texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> list[str]:
    """The most frequent words, ties in order of the word."""
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]


def _ids(words: pa.Array, known: dict[str, int]) -> np.ndarray:
    """The token of each word."""
    raw, offs = utf8(words)
    size = np.diff(offs)
    spread = np.bincount(np.repeat(np.arange(len(words)), size), raw.astype(float) * (1 + np.arange(len(raw)) - np.repeat(offs[:-1], size)), len(words))
    ids = 1 + VOCABULARY + (spread.astype(np.int64) * 2654435761 >> 7) % CLASSES
    where = pc.index_in(words, pa.array(list(known), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(where >= 0, where + 1, ids)


def class_shares(counts: DataFrame, known: dict[str, int]) -> tuple[DataFrame, list[int], pa.Table]:
    """(word, n, share) of the words that share a class, staged; the share of an unseen word in each class; frequent words.

    A share is the logarithm of (n + 1) / (all n of the class + its words + 1), in millionths: what is left is kept for
    words that the corpus doesn't hold. Whole numbers add up to the same sum in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array(_ids(b.column(0), known) - 1 - VOCABULARY)
            yield pa.RecordBatch.from_arrays([*b.columns, ids], ["word", "n", "class"]).filter(pc.greater_equal(ids, 0))

    classed = counts.mapInArrow(run, "word string, n long, class long")
    size = np.ones(CLASSES)
    for r in classed.groupBy("class").agg(F.sum(F.col("n") + 1).alias("n")).collect():
        size[r["class"]] += r.n
    totals = F.array(*(F.lit(float(x)) for x in size))
    share = F.round(F.log((F.col("n") + 1) / F.get(totals, F.col("class").cast("int"))) * UNIT).cast("long")
    shares = stage(classed.select("word", "n", share.alias("share")), "shares")
    positions = counts.agg(F.sum("n")).first()[0] or 0
    frequent = shares.where((F.col("n") * FREQUENT >= positions) & (F.octet_length("word") <= SHORT)).select("word", "share")
    return shares, [round(-float(np.log(x)) * UNIT) for x in size], frequent.toArrow()


def _tokens(text: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left, token, right at every word of the batch, and the words of each row."""
    words, at, per = _words(text)
    return *_context(_ids(words, known), at, per), per


def _context(ids: np.ndarray, at: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    padded = np.zeros(len(at) + 2 * len(per), np.int64)
    begin = starts_of(per + 2)[:-1] + 1
    inner = concat_ranges(begin, per)
    padded[inner] = ids[at]
    return padded[inner - 1], padded[inner], padded[inner + 1]


@dataclass
class PseudoLikelihood:
    """A trained network as the log-probabilities of every (left, right, token): 8 MB, sent once to each executor. The
    shares of words in their classes grow with the corpus and stay a table."""

    words: list[str]
    log_p: np.ndarray
    shares: DataFrame
    unseen: list[int]
    frequent: pa.Table

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_words, log_likelihood (sum over all words), per_word (its mean; null without words), one row for each
        row of docs.

        Frequent words are looked up in the task. Documents send each other word once, with its count, to a join in which no
        word of ordinary length is hot: each has less than one position in FREQUENT of the corpus."""
        names, values = self.frequent["word"].combine_chunks(), self.frequent["share"].to_numpy()
        table = docs.sparkSession.sparkContext.broadcast((self.log_p, names, np.append(values, 0)))
        known = {w: i for i, w in enumerate(self.words)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log_p, names, values = table.value
            for b in batches:
                for lo, hi in slices(utf8(b.column(2))[1], 6 << 20):
                    words, at, per = _words(b.column(2).slice(lo, hi - lo))
                    ids = _ids(words, known)
                    left, token, right = _context(ids, at, per)
                    total = np.concatenate(([0.0], np.cumsum(log_p[left, right, token].astype(float))))
                    ends = starts_of(per)
                    found = pc.index_in(words, names).fill_null(-1).to_numpy(zero_copy_only=False)
                    head = np.concatenate(([0], np.cumsum(values[found][at])))
                    rare = (token > VOCABULARY) & (found < 0)[at]
                    pair, n = np.unique((np.repeat(np.arange(len(per)), per) * len(words) + at)[rare], return_counts=True)
                    row, word = pair // max(len(words), 1), pair % max(len(words), 1)
                    offs = pa.array(starts_of(np.bincount(row, minlength=len(per))).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offs, x) for x in (words.take(pa.array(word)), pa.array((ids[word] - 1 - VOCABULARY).astype(np.int32)), pa.array(n.astype(np.int64)))]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(per.astype(np.int64)), pa.array(total[ends[1:]] - total[ends[:-1]]), pa.array(head[ends[1:]] - head[ends[:-1]]), *lists],
                        ["row", "doc_id", "n_words", "s", "head", "word", "class", "n"],
                    )

        texts = _texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        scored = stage(texts.mapInArrow(run, "row long, doc_id long, n_words long, s double, head long, word array<string>, class array<int>, n array<long>"), "scored")
        each = scored.select("row", F.inline(F.arrays_zip("word", "class", "n"))).join(self.shares.select("word", "share"), "word", "left")
        share = F.coalesce("share", F.get(F.array(*(F.lit(x).cast("long") for x in self.unseen)), F.col("class")))
        within = each.groupBy("row").agg(F.sum(F.col("n") * share).alias("within"))
        s = F.col("s") + (F.col("head") + F.coalesce("within", F.lit(0))) / UNIT
        return scored.join(within, "row", "left").select(
            "doc_id", "n_words", F.round(s, 4).alias("log_likelihood"), F.when(F.col("n_words") > 0, F.round(s / F.col("n_words"), 6)).alias("per_word")
        )


def train(counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Log-probabilities (left, right, token) of the network fitted to counts (left, right, token) by Adam."""
    v = N_TOKENS
    pairs = counts.reshape(v * v, v)
    seen = np.flatnonzero(pairs.sum(1))
    target = pairs[seen].astype(np.float32)
    weight = target.sum(1, keepdims=True)
    total = max(float(weight.sum()), 1.0)
    rng = np.random.default_rng(SEED)
    shapes = {"left": (v, EMBEDDED), "right": (v, EMBEDDED), "wl": (EMBEDDED, HIDDEN), "wr": (EMBEDDED, HIDDEN), "b": (HIDDEN,), "out": (HIDDEN, v), "bias": (v,)}
    p = {k: (rng.normal(0, 0.2, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m, q = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    p["bias"] = np.log(target.sum(0) / total + 1e-6).astype(np.float32)

    def forward(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh((p["left"] @ p["wl"])[rows // v] + (p["right"] @ p["wr"])[rows % v] + p["b"])
        z = h @ p["out"] + p["bias"]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    for step in range(1, steps + 1) if len(seen) else ():
        h, logs = forward(seen)
        d = (np.exp(logs) * weight - target) / total
        g = {"out": h.T @ d, "bias": d.sum(0)}
        dh = (d @ p["out"].T) * (1 - h * h)
        g["b"] = dh.sum(0)
        for side, w, of in (("left", "wl", seen // v), ("right", "wr", seen % v)):
            by = np.zeros((v, HIDDEN), np.float32)
            np.add.at(by, of, dh)
            g[w], g[side] = p[side].T @ by, by @ p[w].T
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            q[k] = 0.999 * q[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
    return np.concatenate([forward(np.arange(lo, min(lo + 4096, v * v)))[1] for lo in range(0, v * v, 4096)]).reshape(v, v, v).astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PseudoLikelihood:
    """Count over all documents, train on the driver on the table of counts (bounded by N_TOKENS**3 cells).

    The words' shares of their classes stay in the shared folder. Null and blank texts have no words; repeated rows count
    each time; an empty table gives a uniform network."""
    texts = _texts(docs, id_col, text_col)
    each = word_counts(texts)
    words = vocabulary(each)
    known = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(utf8(b.column(1))[1], 6 << 20):
                left, token, right, _ = _tokens(b.column(1).slice(lo, hi - lo), known)
                cell, n = np.unique((left * N_TOKENS + right) * N_TOKENS + token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    cells = stage(texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells").toArrow()
    counts = np.zeros(N_TOKENS**3, np.float32)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return PseudoLikelihood(words, train(counts.reshape(N_TOKENS, N_TOKENS, N_TOKENS)), *class_shares(each, known))
