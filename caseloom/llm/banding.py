"""MinHash banding over padded q-grams, and star clustering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.session import cut

#: Letters, digits and the padding that also stands for blanks: q-grams have 37 ** q codes, whatever the corpus. Characters of other scripts share the codes of letters and digits by hash.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789#"
_CODES = np.full(256, 36, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODES[ord(_c)] = _i
#: Share of all q-grams that counts as common.
COMMON_SHARE = 0.6
#: Joins along satellites after which it is looked whether any still leads to another.
HOPS = 3


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Least number of bands whose collision curve 1 - (1 - s^rows)^bands reaches the recall at this similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def gram_codes(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram codes of all texts, where each text's codes begin); texts are folded ones, words are padded on both sides."""
    pad = "#" * (q - 1)
    padded = [pad + t.replace(" ", pad) + pad for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _CODES[np.minimum(points, 127)], points.astype(np.int64) * 2_654_435_761 % 36)
    sizes = np.array([len(p) for p in padded], np.int64)
    if len(codes) < q:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    grams = np.zeros(len(codes) - q + 1, np.int64)
    for i in range(q):
        grams = grams * 37 + codes[i : len(codes) - q + 1 + i]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(grams)]
    real = grams != 37**q - 1
    begin = np.searchsorted(owner[real], np.arange(len(texts)))
    return grams[real], begin


def gram_weights(names: DataFrame, column: str, q: int) -> np.ndarray:
    """Weight of every q-gram code: log of how much rarer it is than the most frequent ones, which make up COMMON_SHARE of all and weigh next to nothing, up to a bound. Counts cover all names; 37 ** q rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(37**q, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            grams, begin = gram_codes(texts, q)
            owner = np.searchsorted(begin, np.arange(len(grams)), side="right")
            total += np.bincount(np.unique(owner * 37**q + grams) % 37**q, minlength=37**q)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    counts = names.select(column).where(F.col(column) != "").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(37**q)
    for r in counts.collect():
        n[r.gram] = r.n
    order = np.argsort(-n, kind="stable")
    held = np.cumsum(n[order]) / max(n.sum(), 1)
    common = n[order[min(np.searchsorted(held, COMMON_SHARE), len(order) - 1)]]
    weights = np.clip(np.log(max(common, 1) / np.maximum(n, 1)), 0.05, 1.5)
    weights[n <= 1] = 0.05  # what only one name has, a typo mostly, can't be shared
    return weights


def band_codes(names: DataFrame, id_col: str, column: str, q: int, bands: int, rows: int, weights: np.ndarray | None = None) -> DataFrame:
    """(id, folded text) -> (id, band, code): names that share a (band, code) collide. Empty texts have none.

    Each hash is exponential with the gram's weight as its rate, so the least
    one falls on a gram with a chance in proportion to its weight.
    """
    shared = names.sparkSession.sparkContext.broadcast(np.ones(37**q, np.float32) if weights is None else weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20_240_229)
        table = rng.exponential(size=(bands * rows, 37**q)).astype(np.float32) / shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                grams, begin = gram_codes(part.column(1).to_pylist(), q)
                ids = part.column(0)
                if not len(grams):
                    continue
                for band in range(bands):
                    code = np.full(len(ids), band + 1, np.uint64)
                    for row in range(rows):
                        least = np.minimum.reduceat(table[band * rows + row][grams], begin)
                        code = (code ^ least.view(np.uint32)) * np.uint64(0x100000001B3)
                        code ^= code >> np.uint64(29)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), band, np.int32)), pa.array(code.view(np.int64))], [id_col, "band", "code"])

    kind = dict(names.dtypes)[id_col]
    return names.select(id_col, column).where(F.col(column) != "").mapInArrow(run, f"{id_col} {kind}, band int, code bigint")


def colliding_pairs(members: DataFrame, id_col: str, form: str, may: Callable[[Column, Column], Column]) -> DataFrame:
    """All pairs (a, b) that collide in a band and whose columns form may is true for."""
    left = members.select("band", "code", F.col(id_col).alias("a"), F.col(form).alias("form_a"))
    right = members.select("band", "code", F.col(id_col).alias("b"), F.col(form).alias("form_b"))
    met = left.join(right, ["band", "code"]).where("a < b")
    return met.where(may(F.col("form_a"), F.col("form_b"))).select("a", "b").distinct()


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, weight), (a, b, likeness) -> (id, center): every node is a center or goes with a center's star.

    A node that outranks (weight, then id) all its neighbours is a center; any
    other goes to the neighbour of highest rank, and if that is a satellite
    itself, along to its star, however far: every node goes to one of higher
    rank, so the way ends. Nodes without edges are their own centers. One
    aggregate over the edges, then joins until none leads on.
    """
    # Both directions from one pass: a union would plan and compute the edges twice.
    each_way = F.array(*(F.struct(F.col(x).alias("id"), F.col(y).alias("other")) for x, y in ("ab", "ba")))
    both = edges.select(F.inline(each_way))
    rank = nodes.select(F.col("id").alias("other"), F.struct("weight", F.col("id").alias("node")).alias("rank"))
    itself = nodes.select("id", F.struct("weight", F.col("id").alias("node")).alias("rank"))
    hubs = both.join(rank, "other").select("id", "rank").unionByName(itself).groupBy("id").agg(F.max("rank").alias("hub")).select("id", F.col("hub.node").alias("center"))
    hubs = cut(hubs)
    follow = hubs.where("id <> center").select(F.col("id").alias("center"), F.col("center").alias("next"))
    out = hubs
    while True:
        for _ in range(HOPS):
            out = out.join(follow, "center", "left").select("id", F.coalesce("next", "center").alias("center"))
        out = cut(out)
        if out.join(follow, "center", "left_semi").isEmpty():
            return out
