"""Quality classifier by co-training of two views.

The text view sees what is written: byte pairs of the whole text, hashed, and the make-up of its words and lines. The
metadata view sees what is known about the document: its source (hashed), its language label and its stated length.
Each view is a logistic regression. In every round all unlabelled documents are scored, each view labels those it is
most sure of, source by source and in the proportion of the labels, for the other view, and both are fitted again; a
document once labelled leaves the pool. Then each view is calibrated by logistic scaling on labelled documents that neither was fitted on, and a last
regression on those weighs the two calibrated views into one probability, which scores all documents.

Fitting reads `labelled` documents with a label, chosen by a hash of the id, and the documents that got a label in a
round, 2 * `per_round` at most; scoring in the rounds and at the end covers every document and its whole text. If there are no labels of both kinds nothing is
learned and every score is 0.5. Labels that are null are ignored, and of several labels of an id the lowest counts.
Null texts, sources, languages and lengths are values of their own. Rows are scored one by one, so repeated rows and
null ids are no matter; other columns play no part; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberwatch.llm.common import stored

PAIRS = 1 << 10
SHAPE = 12
SOURCES = 256
#: Bytes of a text counted at a time.
SPAN = 1 << 18

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5


def text_features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    pairs = np.zeros(PAIRS)
    kinds = np.zeros(6)
    for lo in range(0, n, SPAN):
        part = raw[lo:lo + SPAN + 1].astype(np.int64)
        pairs += np.bincount((part[:-1] * 331 + part[1:] * 7) % PAIRS, minlength=PAIRS)
        kinds += np.bincount(_CLASS[raw[lo:lo + SPAN]], minlength=6)
    words, lines = data.split(), data.split(b"\n")
    shape = np.zeros(SHAPE)
    shape[:6] = kinds / max(n, 1) * 3
    shape[6] = np.log1p(n) / 5
    shape[7] = len(set(words)) / max(len(words), 1)
    shape[8] = len(set(lines)) / len(lines)
    shape[9] = np.log1p(n / max(len(words), 1))
    shape[10] = np.log1p(n / len(lines)) / 3
    shape[11] = 1.0
    return np.concatenate((np.sqrt(pairs / max(n - 1, 1)) * 3, shape))


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(2 * SOURCES + 4)
    out[zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode()) % SOURCES] = 1
    if n_chars is None or n_chars != n_chars:
        out[2 * SOURCES] = 1
    else:
        size = np.log1p(max(n_chars, 0)) / 5
        out[2 * SOURCES + 1:2 * SOURCES + 3] = size, size * size
    out[-1] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Logistic regression by accelerated gradient steps."""
    top = np.ones(x.shape[1])
    for _ in range(30):  # power iterations towards the largest curvature
        top = x.T @ (x @ (top / np.linalg.norm(top)))
    rate = 3.6 / (np.linalg.norm(top) / len(x) + 4 * ridge)
    w = ahead = np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        new = ahead - rate * (x.T @ (sigmoid(x @ ahead) - y) / len(x) + ridge * ahead)
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    combine: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return sigmoid(_views(calibrated(text @ self.text, self.text_scale), calibrated(meta @ self.meta, self.meta_scale)) @ self.combine)


def _views(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack((a, b, np.ones(len(a))), axis=1)


def calibrated(z: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return z * scale[0] + scale[1]


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray,
            rounds: int, per_round: int) -> Model:
    """Co-training with a pool in memory."""
    free = np.ones(len(pool_text), bool)
    pools = {"text": pool_text, "meta": pool_meta}

    def pick(weights: dict[str, np.ndarray], good: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            at = np.nonzero(free)[0]
            if len(at) < per_round:
                break
            order = at[np.argsort(pools[teacher][at] @ weights[teacher], kind="stable")]
            rows = np.concatenate((order[-good:], order[:per_round - good]))
            free[rows] = False
            yield pupil, pools[pupil][rows], (np.arange(len(rows)) < good).astype(float)

    return taught(text, meta, y, pick, rounds, per_round)


def taught(text: np.ndarray, meta: np.ndarray, y: np.ndarray,
           pick: Callable[[dict[str, np.ndarray], int], Iterator[tuple[str, np.ndarray, np.ndarray]]], rounds: int,
           per_round: int) -> Model:
    """y are the labels of the rows; a fifth of them is held for calibration. pick gives, for weights and the number of
    good ones, the view that learns, its rows and their labels."""
    held = np.arange(len(y)) % 5 == 0
    if min(held.sum(), (~held).sum()) == 0 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    views = {"text": text, "meta": meta}
    given = {v: ([x[~held]], [y[~held]]) for v, x in views.items()}
    weights = {v: fit(*map(np.concatenate, given[v])) for v in views}
    good = max(1, round(per_round * y[~held].mean()))
    for _ in range(rounds):
        found = list(pick(weights, good))
        if not found:
            break
        for pupil, rows, labels in found:
            given[pupil][0].append(rows)
            given[pupil][1].append(labels)
        weights = {v: fit(*map(np.concatenate, given[v])) for v in views}
    base = held if held.any() else np.ones(len(y), bool)
    scales, outs = {}, []
    for v in ("text", "meta"):
        z = views[v][base] @ weights[v]
        scales[v] = fit(np.stack((z, np.ones(len(z))), axis=1), y[base], 1e-3)
        outs.append(calibrated(z, scales[v]))
    combine = fit(_views(*outs), y[base], 1e-2)
    return Model(weights["text"], weights["meta"], scales["text"], scales["meta"], combine)


def _features(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    return docs.select(docs[columns["id"]].alias("id"), docs[columns["text"]].cast("string").alias("t"),
                       docs[columns["source"]].cast("string").alias("s"), docs[columns["lang"]].cast("string").alias("l"),
                       docs[columns["n_chars"]].cast("double").alias("n"))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(t.as_py()) for t in batch.column("t")]).reshape(batch.num_rows, PAIRS + SHAPE)
    meta = np.array([meta_features(*x) for x in zip(*(batch.column(c).to_pylist() for c in "sln"))]).reshape(batch.num_rows, -1)
    return text, meta


COLUMNS = {"id": "doc_id", "text": "text", "source": "source", "lang": "lang", "n_chars": "n_chars"}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", label_id: str = "doc_id", labelled: int = 2000,
          rounds: int = 6, per_round: int = 100, columns: dict[str, str] | None = None) -> Model | None:
    """Fit on the labelled sample and what all other documents teach."""
    columns = COLUMNS | (columns or {})
    marks = labels.where(labels[label_col].isNotNull() & labels[label_id].isNotNull()).groupBy(
        labels[label_id].alias("id")).agg(F.min(labels[label_col].cast("double")).alias("y"))
    ids = docs.select(docs[columns["id"]].alias("id")).where("id IS NOT NULL").distinct().join(marks, "id", "left")
    ids = ids.withColumn("h", F.xxhash64(F.lit(7), "id"))
    chosen = ids.where("y IS NOT NULL").orderBy("h", "id").limit(labelled).select("id", "y").toPandas()
    if chosen["y"].dropna().nunique() < 2:
        return None
    spark = docs.sparkSession
    kind = docs.schema[columns["id"]].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _matrices(batch)
            packed = [pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary()) for x in (text, meta)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *packed], names=["id", "text", "meta"])

    def features(wanted: list) -> dict:
        """id -> (text, meta); some 6 KB for each of at most labelled or 2 * per_round ids."""
        few = F.broadcast(spark.createDataFrame([(x,) for x in wanted], f"id {kind}"))
        rows = _features(docs, columns).join(few, "id", "left_semi").mapInArrow(run, f"id {kind}, text binary, meta binary")
        rows = rows.toArrow().to_pandas().sort_values(["id", "text", "meta"], kind="stable").drop_duplicates("id")
        return {i: tuple(np.frombuffer(x, np.float32) for x in own) for i, *own in rows.itertuples(index=False)}

    taken: set = set()

    def pick(weights: dict[str, np.ndarray], good: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    z = [pa.array(x @ weights[v]) for v, x in zip(("text", "meta"), _matrices(part))]
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("s"), *z], names=["id", "s", "text", "meta"])

        # Numbers only are joined: texts stay where they are read.
        free = _features(docs.where(docs[columns["id"]].isNotNull()), columns).mapInArrow(scored, f"id {kind}, s string, text double, meta double")
        free = free.join(marks.select("id"), "id", "left_anti")
        if taken:
            free = free.join(F.broadcast(spark.createDataFrame([(x,) for x in taken], f"id {kind}")), "id", "left_anti")
        free = stored(free, "sure")
        lists = []
        for teacher in ("text", "meta"):
            for label, sure in ((1.0, F.col(teacher)), (0.0, -F.col(teacher))):
                # The surest of every source first: each task keeps a bounded list of each.
                place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("sure"), "id"))
                best = free.select("id", "s", sure.alias("sure")).where("sure > 0").withColumn("place", place).where(F.col("place") <= 2 * per_round)
                best = best.orderBy("place", F.desc("sure"), "id").limit(2 * per_round)
                lists.append(best.select("id", "place", "sure", F.lit(teacher).alias("teacher"), F.lit(label).alias("label")))
        top = lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3]).toPandas()
        top = top.sort_values(["place", "sure", "id"], ascending=[True, False, True], kind="stable")
        picked = []
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            for label, most in ((1.0, good), (0.0, per_round - good)):
                own = [i for i in dict.fromkeys(top["id"][(top["teacher"] == teacher) & (top["label"] == label)]) if i not in taken][:most]
                taken.update(own)
                picked += [(pupil, i, label) for i in own]
        made = features([i for _, i, _ in picked]) if picked else {}
        for pupil, view in (("meta", 1), ("text", 0)):
            own = [(made[i][view], label) for v, i, label in picked if v == pupil]
            if own:
                yield pupil, np.stack([x for x, _ in own]), np.array([label for _, label in own])

    known = features(chosen["id"].tolist())
    order = sorted(known)
    y = dict(zip(chosen["id"], chosen["y"]))
    text, meta = (np.stack([known[i][view] for i in order]) for view in (0, 1))
    return taught(text, meta, np.array([y[i] for i in order]), pick, rounds, per_round)


def score_quality(docs: DataFrame, model: Model | None, threshold: float = 0.5, columns: dict[str, str] | None = None) -> DataFrame:
    """One row per document: id, score (probability of good quality) and keep."""
    columns = COLUMNS | (columns or {})
    # A few thousand weights, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[columns["id"]].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                score = own.score(*_matrices(part)) if own else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score, pa.float64())], names=["id", "score"])

    made = _features(docs, columns).mapInArrow(run, f"id {kind}, score double")
    return made.select(F.col("id").alias(columns["id"]), "score", (F.col("score") >= threshold).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    return score_quality(docs, train(docs, labels, **options), threshold, options.get("columns"))
