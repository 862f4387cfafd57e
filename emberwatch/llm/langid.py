"""Language identification by prediction by partial matching.

Each language has a context tree over the bytes of lower-cased text: for every context of up to `order` bytes the
counts of the bytes that followed it. A byte seen c times after a context with n bytes, q of them different, costs
-log2(c / (n + q)) bits there; an unseen byte costs the escape -log2(q / (n + q)) and is coded by the next shorter
context, without the bytes already ruled out; below the empty context all bytes not ruled out are equal. The counts
are frozen after training, so a text's code length is a sum over its bytes and the shortest language wins.

Training reads a bounded sample of every language that occurs: up to `docs_per_lang` whole documents of each (fixed
choice by a hash of the id). Languages are frozen in groups whose cost table stays below `table_mb`, and a worker holds
one group at a time: a text's code lengths are those of one table of all languages. Prediction reads the text alone. Ties go to the first language by name.
Null texts and texts without a letter are `und` with score 0, as is everything when nothing could be learned. Rows
are scored one by one, so repeated rows and null ids are no matter; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberwatch.llm.common import stored

#: Bytes scored at a time.
SPAN = 1 << 18
UNKNOWN = "und"
#: Rows of the sample that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """Frozen statistics as one cost table: rows are contexts, columns symbols, then languages."""

    langs: list[str]
    symbols: np.ndarray  # byte -> symbol; the last symbol stands for every byte never seen
    size: int
    order: int
    rows: np.ndarray  # packed context -> row
    bits: np.ndarray  # (rows * size, languages)

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits per language."""
        total = np.zeros(len(self.langs))
        sym = np.concatenate((np.full(self.order, self.size - 1), self.symbols[np.frombuffer(data, np.uint8)]))
        for lo in range(0, len(data), SPAN):
            part = sym[lo:lo + SPAN + self.order]
            n = len(part) - self.order
            context = np.zeros(n, np.int64)
            for j in range(self.order):
                context = context * self.size + part[j:j + n]
            total += self.bits[self.rows[context].astype(np.int64) * self.size + part[self.order:]].sum(axis=0, dtype=np.float64)
        return total


@dataclass
class Models:
    """One model for each group of languages, by name."""

    parts: list[Model]

    @property
    def langs(self) -> list[str]:
        return [lang for part in self.parts for lang in part.langs]

    def code_lengths(self, data: bytes) -> np.ndarray:
        return np.concatenate([part.code_lengths(data) for part in self.parts])


def gram_counts(data: bytes, order: int) -> list[tuple[int, int, int]]:
    """(context length, packed context and byte, count) of a text for every context length."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    out = []
    for k in range(order + 1):
        if len(raw) > k:
            packed = np.zeros(len(raw) - k, np.int64)
            for j in range(k + 1):
                packed = packed * 256 + raw[j:len(raw) - k + j]
            out += [(k, int(g), int(c)) for g, c in zip(*np.unique(packed, return_counts=True))]
    return out


def freeze(counts: dict[str, dict[int, dict[int, int]]], order: int, least: int = 2, common: np.ndarray | None = None) -> Model:
    """counts: language -> context length -> packed (context, byte) -> count. Contexts of the full order that were
    met less than `least` times in all are left to their suffix: the trees grow deep only where there is evidence.
    For a group of languages, common has the packed contexts of the full order that all languages together met as often."""
    langs = sorted(counts)
    grams = {(lang, k): (np.array(list(c), np.int64), np.array(list(c.values()), np.float64))
             for lang in langs for k, c in counts[lang].items()}
    nothing = np.empty(0, np.int64), np.empty(0)
    seen = np.unique(np.concatenate([grams.get((lang, 0), nothing)[0] for lang in langs]))
    size = len(seen) + 1
    symbols = np.full(256, size - 1)
    symbols[seen] = np.arange(len(seen))
    left = 256 - len(seen)  # bytes behind the last symbol

    def pack(g: np.ndarray, k: int) -> np.ndarray:
        """Packed bytes to packed symbols, for k + 1 bytes."""
        out = np.zeros(len(g), np.int64)
        for j in range(k, -1, -1):
            out = out * size + symbols[g >> 8 * j & 255]
        return out

    packed = {(lang, k): (pack(g, k), c) for (lang, k), (g, c) in grams.items()}
    contexts = []  # for each length the sorted packed contexts
    for k in range(order + 1):
        both = [packed.get((lang, k), nothing) for lang in langs]
        known, at = np.unique(np.concatenate([g // size for g, _ in both]), return_inverse=True)
        met = np.bincount(at, np.concatenate([c for _, c in both]), len(known))
        if k == order and common is not None:
            contexts.append(known[np.isin(known, pack(common, k - 1))])
        else:
            contexts.append(known[met >= (least if k == order else 1)])
    first = np.cumsum([0] + [len(c) for c in contexts])
    bits = np.empty((int(first[-1]), size, len(langs)), np.float32)
    for at, lang in enumerate(langs):
        tables = []
        for k in range(order + 1):
            g, c = packed.get((lang, k), nothing)
            row = np.searchsorted(contexts[k], g // size)
            kept = np.append(contexts[k], -1)[row] == g // size
            held = np.zeros((len(contexts[k]), size), np.float32)
            held[row[kept], (g % size)[kept]] = c[kept]
            tables.append(held)
        for k in range(order + 1):
            for lo in range(0, len(contexts[k]), 4096):
                own = contexts[k][lo:lo + 4096]
                cost, spent = np.zeros((len(own), size)), np.zeros((len(own), 1))
                open_ = np.ones((len(own), size), bool)
                for j in range(k, -1, -1):
                    c = np.where(open_, tables[j][np.searchsorted(contexts[j], own % size ** j)], 0)
                    here, n, q = c > 0, c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cost = np.where(here, spent - np.log2(c / (n + q)), cost)
                        spent = np.where(q > 0, spent - np.log2(q / (n + q)), spent)
                    open_ &= ~here
                rest = spent + np.log2(open_[:, :-1].sum(axis=1, keepdims=True) + left)
                bits[first[k] + lo:first[k] + lo + len(own), :, at] = np.where(open_, rest, cost)
    # A context that no language has seen is coded by its longest known suffix.
    rows = np.zeros((size,) * order, np.int32)
    for k in range(1, order + 1):
        digits = np.unravel_index(contexts[k], (size,) * k)
        rows[(..., *digits)] = first[k] + np.arange(len(contexts[k]))
    return Model(langs, symbols, size, order, rows.reshape(-1), bits.reshape(-1, len(langs)))


def grouped(sizes: list[tuple[str, int, int]], limit: float) -> list[list[str]]:
    """Languages, by name, in groups whose table has at most `limit` bytes; sizes: (language, contexts, bytes that occur)."""
    groups, contexts, symbols = [], 0, 0
    for lang, own, seen in sorted(sizes):
        contexts, symbols = contexts + own, symbols + seen
        if not groups or 4 * contexts * (min(symbols, 256) + 1) * (len(groups[-1]) + 1) > limit:
            groups.append([])
            contexts, symbols = own, seen
        groups[-1].append(lang)
    return groups


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          order: int = 3, docs_per_lang: int = 100, table_mb: int = 512) -> Models | None:
    """Fit on the sample; usable tells the rows that may be learned from."""
    order_by = Window.partitionBy("lang").orderBy("h", "id")
    known = docs.where(usable & docs[lang_col].isNotNull() & docs[id_col].isNotNull())
    chosen = known.select(known[id_col].alias("id"), known[lang_col].cast("string").alias("lang"),
                          F.xxhash64(F.lit(5), known[id_col]).alias("h")).distinct()
    # First the best of each of 64 parts of a language, then the best of those: no task reads a whole language.
    part = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "id")
    for window in (part, order_by):
        chosen = chosen.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= docs_per_lang)
    wanted = stored(chosen.select("id").distinct(), "sample")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
                made = gram_counts(folded(text), order)
                k, g, c = zip(*made) if made else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(made), pa.string()), pa.array(k, pa.int32()), pa.array(g, pa.int64()),
                     pa.array(c, pa.int64())], names=["lang", "k", "g", "c"])

    texts = known.select(known[id_col].alias("id"), known[lang_col].cast("string").alias("lang"), known[text_col].cast("string").alias("t"))
    texts = texts.join(wanted, "id", "left_semi").select("lang", "t")
    sums = texts.mapInArrow(run, "lang string, k int, g long, c long").groupBy("lang", "k", "g").agg(F.sum("c").alias("c"))
    sums = stored(sums, "grams")
    context = F.shiftright("g", 8)
    sizes = sums.groupBy("lang", "k", context.alias("context")).agg(F.count("*").alias("n")).groupBy("lang").agg(
        F.count("*").alias("contexts"), F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("seen"))
    groups = grouped([(r.lang, r.contexts, r.seen) for r in sizes.collect()], table_mb * 2 ** 20)
    if len(groups) > 1:
        met = sums.where(F.col("k") == order).groupBy(context.alias("context")).agg(F.sum("c").alias("met")).where("met >= 2")
        sums = sums.join(met.withColumn("k", F.lit(order)), (sums["k"] == order) & (context == met["context"]), "left").select(
            "lang", sums["k"], "g", "c", F.col("met").isNotNull().alias("met"))
        sums = stored(sums, "grams-met")
    models = []
    for langs in groups:
        rows = sums.where(F.col("lang").isin(langs)).toPandas()
        counts: dict[str, dict[int, dict[int, int]]] = {}
        for lang, k, g, c in rows[["lang", "k", "g", "c"]].itertuples(index=False):
            counts.setdefault(lang, {}).setdefault(k, {})[g] = c
        common = np.unique(rows["g"][(rows["k"] == order) & rows["met"]].to_numpy() >> 8) if len(groups) > 1 else None
        models.append(freeze(counts, order, common=common))
    return Models(models) if models else None


def predict(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the share of the shortest code among all languages' probabilities."""
    spark = docs.sparkSession
    # Each table has at most table_mb, or one language.
    shared = [spark.sparkContext.broadcast(model) for model in (models.parts if models else [])]
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            langs, best, total = [UNKNOWN] * len(column), np.full(len(column), np.inf), np.zeros(len(column))
            for table in shared:
                own = table.value
                for i, text in enumerate(column):
                    text = text.as_py()
                    if not has_letter(text):
                        continue
                    bits = own.code_lengths(folded(text))
                    least = bits.min()
                    share = np.exp2(np.maximum(least - bits, -1000)).sum()
                    if least < best[i]:
                        langs[i] = own.langs[int(bits.argmin())]
                        total[i] = share + (total[i] * np.exp2(max(least - best[i], -1000)) if total[i] else 0)
                        best[i] = least
                    else:
                        total[i] += share * np.exp2(max(best[i] - least, -1000))
                if len(shared) > 1:  # the next group takes its place; value reads it again
                    del own
                    table.__dict__.pop("_value", None)
            scores = np.divide(1, total, out=np.zeros(len(column)), where=total > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    fields = [*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(fields))


def held_out(id_col: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3. Null ids are not held out, but
    nothing is learned from them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    model = train(docs, ~held_out(docs[id_col]), id_col, text_col, lang_col, **options)
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("t"))
    made = predict(rows, model, "t")
    return made.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", **options) -> DataFrame:
    """The documents written in one of the languages, all columns: those without a letter or without a language that
    has at least `least` of the probability go."""
    model = train(docs, ~held_out(docs[id_col]), id_col, text_col, lang_col, **options)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    made = predict(docs.toDF(*columns).withColumn("__text", F.col(columns[docs.columns.index(text_col)]).cast("string")), model, "__text")
    return made.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(
        *[F.col(c).alias(name) for c, name in zip(columns, docs.columns)])
