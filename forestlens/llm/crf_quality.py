"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. A line's features are measures of the line and of its two
neighbours; a transition score favours neighbours of the same label. Training
maximises the likelihood of the document's label on all its lines (with a quadratic penalty) on
a bounded sample of labelled documents: ``max_documents``, of at most ``max_lines`` lines
each. Scoring runs forward-backward over all lines of every whole text; the score is the mean marginal of
"good", weighted by line length.

Defined results: a null or empty text is one empty line and scored as such; rows alike in text are
scored alike; labels that are null count nowhere, a document labelled both ways counts as
good; without labels of both kinds every score is 0.5; an empty table gives no rows. Other
columns are never read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forestlens.llm import textops
from forestlens.llm.common import cell, id_key

WINDOW = 8
LINE_FEATURES = 12


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = [_set("#*$%&|<>"), _set("".join(map(chr, range(65, 91)))), _set("".join(map(chr, range(97, 123)))),
            _set("0123456789"), _set("!?"), _set("|"), _set(".,;:")]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(lines, LINE_FEATURES)`` own features, each line's document and weight (bytes + 1)."""
    starts, ends, doc = textops.lines(data, offsets)
    size = ends - starts

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[ends] - total[starts]).astype(float)

    symbol, upper, lower, digit, mark, bar, stop = (per_line(c[data]) for c in _CLASSES)
    solid = per_line(~textops.SPACE[data])
    ws, we, wdoc = textops.words(data, offsets)
    first = np.zeros(len(data), bool)
    first[ws] = True
    words = per_line(first)
    at, h = textops.window_hashes(textops.span_hashes(data, ws, we), wdoc, WINDOW)
    at = at[textops.repeated(wdoc[at], h)]
    diff = np.zeros(len(ws) + 1, np.int64)
    np.add.at(diff, at, 1)
    np.add.at(diff, at + WINDOW, -1)
    covered = np.zeros(len(data), bool)
    covered[ws[np.cumsum(diff)[:-1] > 0]] = True
    again = textops.not_first(doc, textops.span_hashes(data, starts, ends)) & (words > 0)
    some = np.maximum(solid, 1)
    out = np.stack([
        np.tanh(8 * symbol / some), np.tanh(2 * upper / np.maximum(upper + lower, 1)), np.tanh(8 * digit / some),
        np.tanh(4 * mark / np.maximum(words, 1)), np.tanh(4 * bar / np.maximum(words, 1)), np.tanh(8 * stop / some),
        per_line(covered) / np.maximum(words, 1), again.astype(float), (words == 0).astype(float),
        np.log1p(words) / 6, np.minimum(solid / np.maximum(words, 1), 30) / 10, np.minimum(symbol, 1)], 1)
    return out, doc, (size + 1).astype(float)


def with_neighbours(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at a text's ends), end flags and a constant."""
    n = len(doc)
    first = np.append(True, doc[1:] != doc[:-1])[:n]
    last = np.append(doc[1:] != doc[:-1], True)[-n:] if n else first
    before = np.vstack([np.zeros((1, own.shape[1])), own[:-1]]) if n else own
    after = np.vstack([own[1:], np.zeros((1, own.shape[1]))]) if n else own
    before[first] = 0
    after[last] = 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((n, 1))])


@dataclass
class Chain:
    """Emission weights of "good" (against "bad") and the scores of staying good and staying bad."""

    weights: np.ndarray
    stay: np.ndarray

    def messages(self, e: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward (with emission) and backward (without) log odds of good, for padded chains."""
        gg, bb = self.stay
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, e.shape[1]):
            p = a[:, t - 1]
            a[:, t] = e[:, t] + np.logaddexp(p + gg, 0) - np.logaddexp(p, bb)
        for t in range(e.shape[1] - 2, -1, -1):
            q = e[:, t + 1] + b[:, t + 1]
            b[:, t] = np.where(inside[:, t + 1], np.logaddexp(q + gg, 0) - np.logaddexp(q, bb), 0)
        return a, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def padded(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of each line in its text, lines per text."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    return np.arange(len(doc)) - first[doc], counts


def marginals(chain: Chain, x: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Marginal of good per line. Texts are done in groups of similar line counts."""
    place, counts = padded(doc, n_docs)
    emission = x @ chain.weights
    out = np.zeros(len(doc))
    order = np.argsort(counts, kind="stable")
    first = np.cumsum(counts) - counts
    lo = 0
    while lo < n_docs:
        hi = lo + 1
        while hi < n_docs and counts[order[hi]] <= 1.5 * counts[order[lo]] + 4:
            hi += 1
        own = order[lo:hi]
        width = int(counts[own].max())
        inside = np.arange(width)[None, :] < counts[own][:, None]
        at = np.where(inside, first[own][:, None] + np.arange(width)[None, :], 0)
        e = np.where(inside, emission[at], 0)
        a, b = chain.messages(e, inside)
        out[at[inside]] = sigmoid(a + b)[inside]
        lo = hi
    return out


def document_scores(chain: Chain | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if chain is None:
        return np.full(n, 0.5)
    own, doc, weight = line_features(data, offsets)
    p = marginals(chain, with_neighbours(own, doc), doc, n)
    return np.clip(np.bincount(doc, weight * p, n) / np.bincount(doc, weight, n), 0, 1)


def train(texts: list[bytes], labels: np.ndarray, max_lines: int, steps: int = 150, penalty: float = 1e-3) -> Chain | None:
    """Maximum penalised likelihood by gradient steps (Adam) over the whole sample."""
    if len(set(labels.tolist())) < 2:
        return None
    chunks = []
    order = sorted(range(len(texts)), key=lambda i: texts[i].count(b"\n"))
    order = [i for i in order if texts[i].count(b"\n") < max_lines]
    for lo in range(0, len(order), 500):
        part = order[lo:lo + 500]
        raw = [texts[i] for i in part]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        own, doc, _ = line_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
        x = with_neighbours(own, doc)
        place, counts = padded(doc, len(part))
        inside = np.arange(counts.max())[None, :] < counts[:, None]
        grid = np.zeros(inside.shape + (x.shape[1],))
        grid[doc, place] = x
        chunks.append((grid, inside, labels[part].astype(float)))
    size = sum(inside.shape[0] for _, inside, _ in chunks)
    theta = np.zeros(chunks[0][0].shape[2] + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = 2 * penalty * theta
        chain = Chain(theta[:-2], theta[-2:])
        for grid, inside, y in chunks:
            e = grid @ chain.weights
            a, b = chain.messages(e, inside)
            p = np.where(inside, sigmoid(a + b), 0)
            target = np.where(inside, y[:, None], 0)
            grad[:-2] += np.einsum("ij,ijk->k", p - target, grid) / size
            if inside.shape[1] > 1:
                # pair marginals of (previous, current): all four products of messages, normalised
                both = inside[:, 1:]
                now = e[:, 1:] + b[:, 1:]
                four = np.stack([a[:, :-1] + chain.stay[0] + now, a[:, :-1], now, np.full_like(now, chain.stay[1])])
                four = np.exp(four - four.max(0))
                four /= four.sum(0)
                good = np.broadcast_to(y[:, None] > 0, both.shape)
                grad[-2] += (four[0] - good)[both].sum() / size
                grad[-1] += (four[3] - ~good)[both].sum() / size
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad ** 2
        theta = theta - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Chain(theta[:-2], theta[-2:])


def fold(doc_id: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id reads as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 4000, max_lines: int = 256,
        doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Chain | None:
    """Fit on at most ``max_documents`` labelled documents outside fold 0, chosen by a hash of the id."""
    own = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull() & (fold(doc_id) != 0)).groupBy(
        F.col(doc_id).cast("long").alias("id")).agg((F.max(quality) > 0).alias("good"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(max_documents)
    rows = docs.select(id_key(doc_id).alias("id"), cell(text).alias("text")).join(F.broadcast(chosen), "id")   # at most max_documents rows
    rows = rows.filter(F.length("text") - F.length(F.replace("text", F.lit("\n"))) < max_lines).dropDuplicates(["id"]).toPandas()
    rows = rows.sort_values("id")
    return train([t.encode() for t in rows["text"]], rows["good"].to_numpy(bool), max_lines) if len(rows) else None


def score(docs: DataFrame, chain: Chain | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row (score: 0 to 1, higher is better)."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [document_scores(chain, data, offsets) for _, _, data, offsets in textops.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.select(F.col(doc_id).alias("doc_id"), scored(F.col(text)).alias("score"))
