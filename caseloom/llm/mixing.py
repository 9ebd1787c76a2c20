"""Mixing sources to target weights, by iterative proportional fitting.

Documents fall into cells of source, language and topic; a cell's size is its
tokens. Languages come from a naive Bayes classifier and topics from spherical
k-means, both over hashed token counts and fitted on all documents, so a null or
wrong language label doesn't misplace a document. Tokens are counted in one pass,
which keeps the features that occur, and every step of the fits is a pass over
these, of which only sums reach the driver. The cells' weights are
raked in turn to the sources' targets and to the corpus' own language and topic
shares, a cell never beyond max_repeats of its tokens; the sources come last and
hold exactly. The whole mix is as large as the scarcest source allows.

Every document then gets floor(c) or floor(c) + 1 copies, c being its cell's
weight over its cell's tokens: a systematic sample of the source's documents in
order of language, topic and length, so that inclusion has the calibrated
probability, a language or topic too rare for a document of its own in every
source gets its share over all, and a cell's tokens stay near its weight. What
rounding leaves of a source is closed with a few documents, whose cells stay
within one document of their weights. All this alike for sources of all sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.spread import spread
from caseloom.llm.tokens import BYTE_BPE_50K, blocks, encoder
from caseloom.session import cut

#: Hashed token features, topics, rounds of k-means, and the least share of the documents that a language needs to be one.
FEATURES, TOPICS, FIT_ROUNDS, LEAST_LANGUAGE = 1 << 10, 6, 15, 0.005
#: Documents of one cell and length that are numbered in one task.
GROUP_ROWS = 50_000
RAKING_ROUNDS = 60
#: Documents of least hash, and longest ones, per cell and direction among which those that close a source's gap are looked for.
CLOSING = 8
CELL = ["source", "lang", "topic"]
#: Documents whose features are packed into one row, its columns, and the unit in which features are summed as whole numbers.
PART_DOCUMENTS, UNIT = 1_000, float(1 << 24)
PACKED = ["sources", "ids", "sizes", "held", "codes", "counts", "own"]


class Models(NamedTuple):
    """Log probabilities of features by language, the languages' priors and mean vectors, inverse document frequencies and topic centers."""

    languages: tuple[str, ...]
    feature_logs: np.ndarray
    priors: np.ndarray
    idf: np.ndarray
    means: np.ndarray
    centers: np.ndarray


class Part(NamedTuple):
    """Documents' ids, sources, numbers of languages (as labelled, -1 for none, or as told) and of tokens; how many features each has, their documents' numbers, codes and log counts.

    Where languages are told: what makes each document's features, and the mean
    of its language, a difference of length one.
    """

    ids: np.ndarray
    sources: list[str | None]
    own: np.ndarray
    sizes: np.ndarray
    held: np.ndarray
    rows: np.ndarray
    codes: np.ndarray
    tf: np.ndarray
    stretch: np.ndarray | None = None
    scale: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.ids)


def features(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each document has tokens of each hash, a row per document."""
    code = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)
    at = np.repeat(np.arange(len(sizes)), sizes) * FEATURES + code.astype(np.int64)
    return np.bincount(at, minlength=len(sizes) * FEATURES).reshape(len(sizes), FEATURES)


def _times(part: Part, values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each document's values times table, a row per feature."""
    out = np.zeros((part.n, table.shape[1]))
    filled = part.held > 0
    if filled.any():
        begin = (np.cumsum(part.held) - part.held)[filled]
        for k, column in enumerate(np.ascontiguousarray(table.T)):
            out[filled, k] = np.add.reduceat(values * column[part.codes], begin)
    return out


def _language(models: Models, part: Part) -> np.ndarray:
    return (_times(part, part.tf, models.feature_logs) + models.priors).argmax(1)


def _weighted(models: Models, part: Part) -> tuple[np.ndarray, np.ndarray]:
    """Features by inverse document frequency, each document's of length one, and the lengths they had."""
    w = part.tf * models.idf[part.codes]
    norm = np.maximum(np.sqrt(np.bincount(part.rows, w * w, part.n)), 1e-9)
    return w / norm[part.rows], norm


def _likeness(models: Models, part: Part) -> tuple[np.ndarray, np.ndarray]:
    """(what the features count in documents' vectors, of length one less their language's mean, and likeness to each center); languages are told."""
    v = part.tf * models.idf[part.codes] * part.stretch[part.rows]
    return v, _times(part, v, models.centers.T) - (models.means @ models.centers.T)[part.own] * part.scale[:, None]


def _by(part: Part, group: np.ndarray, groups: int, values: np.ndarray) -> np.ndarray:
    """Sums of features' values by group of their document (-1 for none), in units of 1 / UNIT."""
    g = group[part.rows]
    at, fixed = (g * FEATURES + part.codes)[g >= 0], np.rint(values * UNIT)[g >= 0]
    return np.bincount(at, fixed, groups * FEATURES).astype(np.int64)


def _packed(documents: DataFrame, languages: tuple[str, ...], path: str) -> DataFrame:
    """Rows of PART_DOCUMENTS documents each: ids, sources, languages, token counts and features that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(path), {k: i for i, k in enumerate(languages)}
        for batch in batches:
            ids, sources = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
            own = np.array([number.get(k, -1) for k in batch.column(2).to_pylist()], np.int16)
            texts = batch.column(3).to_pylist()
            for block in blocks(texts):
                for begin in range(block.start, block.stop, PART_DOCUMENTS):
                    at = slice(begin, min(begin + PART_DOCUMENTS, block.stop))
                    flat, sizes = enc.encode(texts[at])
                    counts = features(flat, sizes)
                    rows, codes = np.nonzero(counts)
                    n = counts[rows, codes]
                    n = n.astype(np.min_scalar_type(n.max() if len(n) else 0))
                    held = np.bincount(rows, minlength=len(sizes)).astype(np.int32)
                    packed = [x.tobytes() for x in (ids[at], sizes.astype(np.int64), held, codes.astype(np.int16), n, own[at])]
                    arrays = [pa.array([x], pa.binary()) for x in packed]
                    yield pa.RecordBatch.from_arrays([pa.array([sources[at]], pa.list_(pa.string())), *arrays], PACKED)

    schema = f"{PACKED[0]} array<string>, " + ", ".join(f"{c} binary" for c in PACKED[1:])
    return spread(documents.select("doc_id", "source", "label", "text"), "doc_id").mapInArrow(run, schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        columns = [batch.column(c) for c in batch.schema.names]
        for i in range(batch.num_rows):
            sources, ids, sizes, held, codes, counts, own, *placed = (c[i].as_py() for c in columns)
            codes = np.frombuffer(codes, np.int16).astype(np.int64)
            counts = np.frombuffer(counts, f"u{len(counts) // max(len(codes), 1) or 1}")
            tf = np.log1p(np.arange(256.0))[counts] if counts.itemsize == 1 else np.log1p(counts.astype(float))
            held = np.frombuffer(held, np.int32)
            rows = np.repeat(np.arange(len(held)), held)
            own, placed = np.frombuffer(own, np.int16).astype(np.int64), [np.frombuffer(x) for x in placed]
            yield Part(np.frombuffer(ids, np.int64), sources, own, np.frombuffer(sizes, np.int64), held, rows, codes, tf, *placed)


def _placed(packed: DataFrame, models: Models) -> DataFrame:
    """The packed features with languages as told, and what makes vectors of them, which no round of the topics changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in enumerate(_parts([batch])):
                lang, (w, norm) = _language(models, part), _weighted(models, part)
                along = np.bincount(part.rows, w * models.means[lang[part.rows], part.codes], part.n)
                square = np.bincount(part.rows, w * w, part.n) - 2 * along + (models.means**2).sum(1)[lang]
                scale = np.where(square > 1e-8, 1 / np.sqrt(np.maximum(square, 1e-8)), 0.0)
                made = [pa.array([x.tobytes()], pa.binary()) for x in (lang.astype(np.int16), scale / norm, scale)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-1], *made], [*PACKED, "stretch", "scale"])

    return packed.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema) + ", stretch binary, scale binary")


def _summed(packed: DataFrame, size: int, make: Callable[[Part], np.ndarray]) -> np.ndarray:
    """Sum of make over all parts. Whole numbers, so that no order or partitioning of documents changes it; size rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in _parts(batches):
            total += make(part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = packed.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def _farthest(placed: DataFrame, models: Models) -> np.ndarray:
    """Vector of the document least like the centers, of equal ones the least doc_id's; zeros if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for part in _parts(batches):
            asked = np.flatnonzero(part.sizes > 0)
            if not len(asked):
                continue
            v, like = _likeness(models, part)
            most = like.max(1) if len(models.centers) else np.zeros(part.n)
            i = asked[np.lexsort((part.ids[asked], most[asked]))[0]]
            if best is None or (most[i], part.ids[i]) < best[:2]:
                vector = -models.means[part.own[i]] * part.scale[i]
                vector[part.codes[part.rows == i]] += v[part.rows == i]
                best = most[i], part.ids[i], vector.tobytes()
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in best], ["most", "doc_id", "vector"])

    found = placed.mapInArrow(run, "most double, doc_id bigint, vector binary").orderBy("most", "doc_id").limit(1).collect()
    return np.frombuffer(found[0].vector) if found else np.zeros(FEATURES)


def fit(packed: DataFrame, languages: tuple[str, ...]) -> tuple[Models, DataFrame]:
    """Models of all documents that have tokens, some of them labelled wrongly, and the documents as placed by them: the classifier is fitted twice, the second time to its own labels.

    Each step is one pass over the packed features, of which only sums by
    language or topic reach the driver. The first center is the document of least
    id, every further one the document least like those before.
    """
    n = len(languages)
    models = Models(languages, *(np.zeros(s) for s in ((FEATURES, n), n, FEATURES, (n, FEATURES), (0, FEATURES))))

    def of_labels(part: Part, own: np.ndarray) -> np.ndarray:
        own = np.where(part.sizes > 0, own, -1)
        told = np.bincount(own[own >= 0], minlength=n), np.bincount(part.codes, minlength=FEATURES), [(part.sizes > 0).sum()]
        return np.concatenate((_by(part, own, n, part.tf), *told))

    for again in (False, True):
        before = models
        sums = _summed(packed, n * FEATURES + n + FEATURES + 1, lambda part: of_labels(part, _language(before, part) if again else part.own))  # noqa: B023
        tf, labelled, documents = np.split(sums, (n * FEATURES, n * FEATURES + n))
        tf = tf.reshape(n, FEATURES).T / UNIT + 0.1
        models = models._replace(feature_logs=np.log(tf / tf.sum(0)), priors=np.log(labelled + 1.0), idf=np.log((1 + documents[-1]) / (1 + documents[:-1])))

    def of_vectors(part: Part) -> np.ndarray:
        lang = np.where(part.sizes > 0, _language(models, part), -1)
        return np.concatenate((_by(part, lang, n, _weighted(models, part)[0]), np.bincount(lang[lang >= 0], minlength=n)))

    sums, numbers = np.split(_summed(packed, n * FEATURES + n, of_vectors), (n * FEATURES,))
    models = models._replace(means=sums.reshape(n, FEATURES) / UNIT / np.maximum(numbers, 1)[:, None])
    placed = cut(_placed(packed, models))
    while len(models.centers) < TOPICS:
        models = models._replace(centers=np.concatenate((models.centers, _farthest(placed, models)[None])))

    def of_topics(part: Part) -> np.ndarray:
        v, like = _likeness(models, part)
        near = np.where(part.sizes > 0, like.argmax(1), -1)
        real = near >= 0
        taken = np.bincount((near * n + part.own)[real], np.rint(part.scale * UNIT)[real], TOPICS * n).astype(np.int64)
        return np.concatenate((_by(part, near, TOPICS, v), taken))

    for _ in range(FIT_ROUNDS):
        sums, taken = np.split(_summed(placed, TOPICS * (FEATURES + n), of_topics) / UNIT, (TOPICS * FEATURES,))
        taken = taken.reshape(TOPICS, n)
        moved = sums.reshape(TOPICS, FEATURES) - taken @ models.means
        moved = np.where((taken.sum(1) > 0)[:, None], moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-9), models.centers)
        if np.array_equal(moved, models.centers):
            break
        models = models._replace(centers=moved)
    return models, placed


def cells_of(documents: DataFrame, targets: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of the documents whose source has a target; null and empty texts have no tokens."""
    wanted = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").where("doc_id is not null")
    wanted = wanted.withColumn("label", F.lower(F.regexp_replace(F.coalesce("lang", F.lit("")), r"^\s+|\s+$", "")))
    counted = wanted.where("text <> ''").groupBy(F.when(F.length("label") == 2, F.col("label")).alias("label")).count()
    # So few labels are frequent that a list of them is short.
    least = F.greatest(F.lit(LEAST_LANGUAGE) * counted.agg(F.sum("count")).scalar(), F.lit(3))
    languages = tuple(sorted(r.label for r in counted.where(F.col("label").isNotNull() & (F.col("count") >= least)).collect())) or ("und",)
    models, placed = fit(cut(_packed(wanted, languages, path)), languages)
    told = tuple(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Models(*told)
        names = np.array(known.languages, object)
        for part in _parts(batches):
            topic = _likeness(known, part)[1].argmax(1).astype(np.int32)
            columns = pa.array(part.ids), pa.array(part.sources, pa.string()), pa.array(names[part.own], pa.string()), pa.array(topic), pa.array(part.sizes)
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "source", "lang", "topic", "n_tokens"])

    return placed.mapInArrow(run, "doc_id bigint, source string, lang string, topic int, n_tokens bigint")


def rake(cells: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """cells (source, lang, topic, tokens), targets (source, target_weight, max_repeats) -> cells with ratio, copies wanted per document.

    Sources without tokens can have no share; the others' targets are scaled up to one.
    """
    c = cells[cells["tokens"] > 0].merge(targets, on="source").reset_index(drop=True)
    if c.empty:
        return c.assign(ratio=[])
    have = c.groupby("source")["tokens"].sum()
    t = targets.set_index("source").loc[have.index]
    share = t["target_weight"] / t["target_weight"].sum()
    whole = (t["max_repeats"] * have / share).min()
    most = (c["tokens"] * c["max_repeats"]).to_numpy(float)
    goal = c["source"].map(share).to_numpy(float) * whole
    w = c["tokens"].to_numpy(float) * goal / c["source"].map(have).to_numpy(float)
    shares = {k: c["tokens"].groupby(c[k]).sum() / c["tokens"].sum() * whole for k in ("lang", "topic")}
    for _ in range(RAKING_ROUNDS):
        before = w.copy()
        for k, target in shares.items():
            now = pd.Series(w).groupby(c[k]).transform("sum").to_numpy()
            w = np.minimum(w * c[k].map(target).to_numpy(float) / np.maximum(now, 1e-9), most)
        w = _to_sources(w, c["source"], goal, most)
        if np.abs(w - before).max() < 1e-6 * whole:
            break
    return c.assign(ratio=w / c["tokens"])


def _to_sources(w: np.ndarray, source: pd.Series, goal: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Scale each source's cells to its goal; cells at their bound stay there, the others take more."""
    for _ in range(50):
        free = w < most * (1 - 1e-12)
        held = pd.Series(np.where(free, 0.0, w)).groupby(source).transform("sum").to_numpy()
        loose = pd.Series(np.where(free, w, 0.0)).groupby(source).transform("sum").to_numpy()
        now = pd.Series(w).groupby(source).transform("sum").to_numpy()
        if np.allclose(now, goal, rtol=1e-9) or not (loose > 0).any():
            break
        over = now > goal
        scale = np.where(over, goal / np.maximum(now, 1e-9), np.where(loose > 0, (goal - held) / np.maximum(loose, 1e-9), 1.0))
        w = np.minimum(np.where(over | free, w * scale, w), most)
    return w


def close_gaps(cells: pd.DataFrame, spare: pd.DataFrame) -> dict[int, int]:
    """One copy more or less for a few documents: doc_id -> 1 or -1.

    cells: source, lang, topic, gap (tokens wanted and not taken). spare: the
    same, doc_id, n_tokens and step (1 can have one more, -1 one less). Each time
    the document is taken that makes the source's gap least, of those that leave
    their cell's within the document's own length.
    """
    change: dict[int, int] = {}
    wanted = {k: float(v) for k, v in cells.groupby("source")["gap"].sum().items()}
    for source, own in spare.merge(cells, on=CELL).groupby("source", sort=True):
        key = list(zip(own["lang"], own["topic"], strict=True))
        moves = list(zip(key, own["doc_id"].tolist(), (own["n_tokens"] * own["step"]).tolist(), own["step"].tolist(), strict=True))
        gap, rest = dict(zip(key, own["gap"].tolist(), strict=True)), wanted[source]
        while True:
            near = min(((abs(rest - m), d, m, s, k) for k, d, m, s in moves if d not in change and abs(gap[k] - m) <= abs(m)), default=None)
            if near is None or near[0] >= abs(rest):
                break
            change[near[1]] = near[3]
            gap[near[4]] -= near[2]
            rest -= near[2]
    return change


def mix_cells(documents: DataFrame, targets: DataFrame, path: str = BYTE_BPE_50K) -> tuple[DataFrame, pd.DataFrame]:
    """((doc_id, source, lang, topic, n_tokens, copies) with copies >= 1, the raked cells)."""
    spark = documents.sparkSession
    t = targets.select("source", "target_weight", "max_repeats").where("source is not null and target_weight > 0 and max_repeats > 0").toPandas()
    t = t.drop_duplicates("source")
    sized = cut(cells_of(documents, targets, path).where("n_tokens > 0"))
    # Rows by cell and length: their number doesn't grow with the documents beyond the lengths that occur.
    lengths = cut(sized.groupBy(*CELL, "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    cells = rake(lengths.groupBy(*CELL).agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).toPandas(), t)
    if cells.empty:
        return sized.withColumn("copies", F.lit(0)).limit(0), cells
    plan = spark.createDataFrame(
        pd.DataFrame({**{k: cells[k] for k in CELL}, "ratio": cells["ratio"], "max_repeats": cells["max_repeats"].astype("int32")}), "source string, lang string, topic int, ratio double, max_repeats int"
    )
    split = lengths.withColumn("parts", F.ceil(F.col("n") / GROUP_ROWS)).select(*CELL, "n_tokens", "parts")
    docs = sized.join(split, [*CELL, "n_tokens"]).withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", "parts"))
    # Copies beyond whole ones that are wanted before each group of one cell, length and part.
    docs = docs.join(F.broadcast(plan), CELL).withColumn("share", F.col("ratio") - F.floor("ratio"))
    groups = docs.groupBy(*CELL, "n_tokens", "part").agg(F.sum("share").alias("wanted"))
    order = Window.partitionBy("source").orderBy("lang", "topic", "n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*CELL, "n_tokens", "part", F.coalesce(F.sum("wanted").over(order), F.lit(0.0)).alias("before"))
    inner = Window.partitionBy(*CELL, "n_tokens", "part").orderBy("h", "doc_id")
    start = F.pmod(F.xxhash64("source"), F.lit(1_000)) / 1_000
    number = docs.join(groups, [*CELL, "n_tokens", "part"]).withColumns({"k": F.row_number().over(inner), "at": F.col("before") + start})
    hit = F.floor(F.col("at") + F.col("share") * F.col("k")) > F.floor(F.col("at") + F.col("share") * (F.col("k") - 1))
    taken = cut(number.select("doc_id", *CELL, "n_tokens", "h", "max_repeats", F.least(F.floor("ratio") + hit.cast("int"), F.col("max_repeats")).cast("int").alias("copies")))
    got = taken.groupBy(*CELL).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("taken")).toPandas()
    gaps = cells.merge(got, on=CELL)
    gaps["gap"] = gaps["ratio"] * gaps["tokens"] - gaps["taken"].astype(float)
    both = taken.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("step")).where("(step = 1 and copies < max_repeats) or (step = -1 and copies > 0)")
    spare = []
    for order in (("h",), (F.desc("n_tokens"), "h")):  # a long document that was taken can only be closed by itself
        near = Window.partitionBy(*CELL, "step").orderBy(*order, "doc_id")
        spare.append(both.select("doc_id", *CELL, "n_tokens", "step", F.row_number().over(near).alias("r")).where(F.col("r") <= CLOSING).drop("r").toPandas())
    spare = pd.concat(spare).drop_duplicates(["doc_id", "step"])
    change = close_gaps(gaps[[*CELL, "gap"]], spare)
    changed = spark.createDataFrame(sorted(change.items()), "doc_id bigint, change int")
    out = taken.join(F.broadcast(changed), "doc_id", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return out.select("doc_id", *CELL, "n_tokens", "copies").where("copies > 0"), cells


def mix(documents: DataFrame, targets: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, source, n_tokens, copies), copies >= 1: the documents that are in the mix, and how often.

    targets is a short fixed list. Documents without tokens, of a null source or
    of one without target are in no mix; doc_id must be unique.
    """
    return mix_cells(documents, targets, path)[0].select("doc_id", "source", "n_tokens", "copies")


def marginals(documents: DataFrame, targets: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """(kind, value, wanted_share, actual_share) of the mix's tokens by source, language and topic, as raked and as taken."""
    mixed, cells = mix_cells(documents, targets, path)
    mixed = cut(mixed)
    spark = documents.sparkSession
    rows = []
    for k in CELL if len(cells) else ():
        w = (cells["ratio"] * cells["tokens"]).groupby(cells[k].astype(str)).sum()
        rows += [(k, str(v), float(x)) for v, x in (w / w.sum()).items()]
    wanted = spark.createDataFrame(rows, "kind string, value string, wanted double")
    size = F.sum(F.col("copies") * F.col("n_tokens"))
    got = mixed.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in CELL))), "copies", "n_tokens")
    got = got.groupBy("kind", "value").agg(size.alias("tokens"))
    whole = got.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("kind")))
    share = F.round(F.coalesce("share", F.lit(0.0)), 6).alias("actual_share")
    return wanted.join(whole, ["kind", "value"], "left").select("kind", "value", F.round("wanted", 6).alias("wanted_share"), share)


def shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: documents, copies, tokens, and the share that it has and should have."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # A row per target, so the window over all of them is a short one.
    every = targets.select("source", "target_weight", "max_repeats").join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    return every.select(
        "source", zero("n_documents"), zero("n_copies"), zero("most_copies"), "max_repeats", zero("tokens"), "target_weight",
        F.round(F.coalesce("tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("actual_share"),
    )
