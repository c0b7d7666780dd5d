"""Main text of web pages by a linear-chain conditional random field over the page's leaf blocks.

Each block is in the article or not. Features are the names of the elements around a block, with the words of their classes,
ids and roles, and facts about its text. The field is trained by stochastic ascent of the labelled pages' log-likelihood
(forward and backward sums), and decoded by Viterbi.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_blocks import Block, blocks
from .html_training import labelled_page

PAGES = 400
EPOCHS = 8
RATE = 0.2
DECAY = 1e-4
#: Words that tell of menus, notices and the like; a block with one in so many characters, or more, says them, another mentions them.
PER_SIGN = 200
SIGNS = ("cookie", "copyright", "©", "rights reserved", "subscribe", "newsletter", "log in", "sign up", "privacy", "comment", "repl", "click", "advert", "sponsor", "offer")


class Model(NamedTuple):
    #: feature -> score of 1 less score of 0
    weights: dict[str, float]
    #: start of 1; then 0 -> 1, 1 -> 0 and 1 -> 1, all against 0
    chain: tuple[float, float, float, float]


def path_features(path: tuple) -> list[str]:
    """Each name and word once, and the innermost two elements."""
    found = {f"in {name}" for name, _ in path} | {f"of {word}" for _, words in path for word in words}
    found |= {f"own {name}" for name, _ in path[-1:]} | {f"under {name}" for name, _ in path[-2:-1]}
    return sorted(found)


def text_features(block: Block) -> list[str]:
    n = len(block.text)
    low = block.text.lower()
    found = [f"length {min(7, n.bit_length() // 2)}", f"linked {round(3 * min(1, block.linked / n))}", "bias"]
    found += [f"{'says' if low.count(s) * PER_SIGN >= n else 'mentions'} {s}" for s in SIGNS if s in low]
    if block.text[-1] in ".?!…\"”":
        found.append("ends a sentence")
    if n < 60 and block.text[:1].isupper():
        found.append("short and capital")
    return found


def features(block: Block) -> list[str]:
    return path_features(block.path) + text_features(block)


def _gradient(scores: np.ndarray, labels: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood by each block's score and by the chain's four numbers."""
    n = len(scores)
    move = np.array([[0.0, chain[1]], [chain[2], chain[3]]])
    own = np.stack([np.zeros(n), scores], 1)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = own[0] + [0, chain[0]]
    for k in range(1, n):
        a[k] = own[k] + np.logaddexp(a[k - 1, 0] + move[0], a[k - 1, 1] + move[1])
    for k in range(n - 2, -1, -1):
        x = own[k + 1] + b[k + 1]
        b[k] = np.logaddexp(move[:, 0] + x[0], move[:, 1] + x[1])
    total = np.logaddexp(*a[-1])
    by_score = labels - np.exp(a[:, 1] + b[:, 1] - total)
    g = np.zeros(4)
    g[0] = by_score[0]
    if n > 1:
        pair = np.exp(a[:-1, :, None] + move[None] + (own + b)[1:, None, :] - total).sum(0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[:-1], labels[1:]), 1)
        d = seen - pair
        g[1:] = d[0, 1], d[1, 0], d[1, 1]
    return by_score, g


def train(pages: list[tuple[str, list[tuple[str, int]]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
    """pages: html, and the texts of its blocks in order with their labels; pages whose blocks differ are an error."""
    data, index = [], {}
    for html, wanted in pages:
        found = blocks(html)
        if [b.text for b in found] != [t for t, _ in wanted]:
            raise ValueError("a labelled page's blocks don't match its labels")
        if found:
            rows = [np.array([index.setdefault(f, len(index)) for f in features(b)]) for b in found]
            data.append((np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([y for _, y in wanted])))
    w, chain = np.zeros(len(index)), np.zeros(4)
    squares, chain_squares = np.full(len(index), 1e-8), np.full(4, 1e-8)
    order, rng = list(range(len(data))), random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            at, row, labels = data[k]
            scores = np.bincount(row, w[at], len(labels))
            by_score, by_chain = _gradient(scores, labels, chain)
            g = np.bincount(at, by_score[row], len(w)) - DECAY * w
            squares += g * g
            w += rate * g / np.sqrt(squares)
            chain_squares += by_chain**2
            chain += rate * by_chain / np.sqrt(chain_squares)
    return Model({f: float(w[k]) for f, k in index.items()}, tuple(chain.tolist()))


@lru_cache(maxsize=1)
def default_model(pages: int = PAGES) -> Model:
    return train([labelled_page(seed) for seed in range(pages)])


def viterbi(scores: list[float], chain: tuple[float, float, float, float]) -> list[int]:
    """The likeliest labels; of two equally likely, the one outside the article."""
    if not scores:
        return []
    out, back = 0.0, []
    inside = scores[0] + chain[0]
    for s in scores[1:]:
        to_out = (out, 0) if out >= inside + chain[2] else (inside + chain[2], 1)
        to_in = (out + chain[1], 0) if out + chain[1] >= inside + chain[3] else (inside + chain[3], 1)
        back.append((to_out[1], to_in[1]))
        out, inside = to_out[0], to_in[0] + s
    at = int(inside > out)
    labels = [at]
    for pair in reversed(back):
        at = pair[at]
        labels.append(at)
    return labels[::-1]


class Extractor:
    def __init__(self, model: Model):
        self.model, self.paths = model, {}

    def _path(self, path: tuple) -> float:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            found = self.paths[path] = math.fsum(self.model.weights.get(f, 0.0) for f in path_features(path))
        return found

    def __call__(self, html: str | None) -> str:
        found, get = blocks(html), self.model.weights.get
        scores = [self._path(b.path) + math.fsum(get(f, 0.0) for f in text_features(b)) for b in found]
        return "\n".join(b.text for b, y in zip(found, viterbi(scores, self.model.chain)) if y)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: its id, url, text (the article's blocks joined by line ends, empty if none), n_chars (code points).

    Null or empty html gives an empty text. The whole page is read, whatever its length. Repeated rows, null ids and null
    urls are kept; an empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).toDF("id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Extractor(sent.value)
        for batch in batches:
            texts = [of(h.as_py()) for h in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
