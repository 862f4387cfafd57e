"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period p that no neighbouring word extends. Let it start at s and end before
e. The suffixes at s and s + p share exactly e - s - p words, and no suffix between them shares as many with s: so when
suffix classes are united by falling LCP, s and s + p become neighbours in the ordered positions of their class just at
that LCP. A new pair of neighbours i < j with j - i <= LCP whose preceding words differ is therefore a run, each run
comes up once, and nothing else does.

Only suffixes that share enough words to hold a run of the wanted size take part; they are found by gram hashes over many
documents at a time and ordered by prefix doubling. Every document is worked on whole and alone: Spark deals documents
to tasks, nothing is shuffled.

Null and empty texts have no words: no run and the empty text. Repeated rows give a row each, null ids stay, other
columns play no part, an empty table gives no rows. A run longer than its text's half is found like any other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import let

#: Documents are taken together until they have so many words (one longer document goes alone).
SLICE_WORDS = 400_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def least_lcp(min_words: int, min_exponent: int) -> int:
    """The fewest words that the suffixes at a run's start and one period later can share."""
    return min(max(min_words - p, (min_exponent - 1) * p) for p in range(1, max(min_words, 1) + 1))


def dense(values: np.ndarray) -> np.ndarray:
    """For each value how many are smaller: equal values share a number and gaps fit later refinement."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    out = np.empty(len(values), np.int64)
    out[order] = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    return out


def repeated(codes: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """Positions whose gram of words may occur once more in the same document (equal hashes; never misses one)."""
    hashed = np.zeros(len(codes), np.uint64)
    for step in range(gram):
        hashed[:len(codes) - step] = hashed[:len(codes) - step] * np.uint64(0x9E3779B97F4A7C15) + codes[step:].astype(np.uint64)
    at = np.flatnonzero(np.arange(len(codes)) + gram <= ends)
    label = pd.factorize(hashed[at])[0]
    return at[np.bincount(label)[label] > 1] if len(at) else at


def suffix_order(codes: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at these positions in order, and for each whether it shares its gram with the one before."""
    used = np.unique(np.r_[at, at + gram])
    rank = np.zeros(len(codes), np.int64)
    part = codes[used]
    for step in range(1, gram):
        part = dense(part) * (codes.max() + 1) + codes[used + step]
    rank[used] = dense(part)
    order = at[np.argsort(rank[at], kind="stable")]
    same = np.r_[False, rank[order][1:] == rank[order][:-1]]
    tied, k = order[same | np.r_[same[1:], False]], gram
    while len(tied):
        old, after = rank[tied], rank[tied + k]
        turn = np.lexsort((after, old))
        tied, old, after = tied[turn], old[turn], after[turn]
        here = np.arange(len(tied))
        opens = np.r_[True, old[1:] != old[:-1]]
        splits = opens | np.r_[True, after[1:] != after[:-1]]
        new = old + np.maximum.accumulate(np.where(splits, here, 0)) - np.maximum.accumulate(np.where(opens, here, 0))
        rank[tied] = new
        again = ~splits | np.r_[~splits[1:], False]
        tied, k = tied[again], 2 * k
    return at[np.argsort(rank[at], kind="stable")], same


def shared_words(codes: list[int], order: list[int], same: list[bool], gram: int) -> list[int]:
    """For each suffix of the order the words it shares with the one before, if they share a gram, else 0."""
    before = {i: (n, order[n - 1]) for n, i in enumerate(order) if same[n]}
    out, last, common = [0] * len(order), -2, 0
    for i in sorted(before):
        n, j = before[i]
        common = max(common - 1, gram) if i == last + 1 else gram
        while codes[i + common] == codes[j + common]:
            common += 1
        out[n], last = common, i
    return out


def join_classes(codes: list[int], order: list[int], lcp: list[int], min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among suffixes in order, united by falling LCP."""
    parent = list(range(len(order)))
    places: list[list[int] | None] = [[i] for i in order]
    found = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def meet(i: int, j: int, common: int) -> None:
        period = j - i
        if ((min_exponent - 1) * period <= common and period + common >= min_words and codes[i - 1] != codes[j - 1]):
            found.append((i, period + common, period))

    for n in sorted((n for n in range(len(order)) if lcp[n]), key=lambda n: -lcp[n]):
        a, b, common = root(n - 1), root(n), lcp[n]
        large, small = places[a], places[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b], places[b] = a, None
        gaps = [bisect_left(large, i) for i in small]
        for m, (i, gap) in enumerate(zip(small, gaps)):
            # Two positions of the small class in one gap are neighbours already.
            if gap and (not m or gaps[m - 1] < gap):
                meet(large[gap - 1], i, common)
            if gap < len(large) and (m + 1 == len(small) or gaps[m + 1] > gap):
                meet(i, large[gap], common)
        if len(small) * 64 > len(large):
            large += small
            large.sort()
        else:
            for shift, (i, gap) in enumerate(zip(small, gaps)):
                large.insert(gap + shift, i)
    return found


def runs_of(documents: list[list[bytes]], min_words: int = 6, min_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs by start, then period."""
    gram = least_lcp(min_words, min_exponent)
    number: dict[bytes, int] = {}
    sizes = np.array([len(d) for d in documents], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    # Words of different documents get different codes, and each document is followed by a gram of zeros, so no match
    # crosses an end.
    starts = np.r_[0, np.cumsum(sizes + gram)].astype(np.int64)
    codes = np.zeros(int(starts[-1]) + 1, np.int64)
    for document, words in enumerate(documents):
        own = [number.setdefault(w, len(number)) for w in words]
        codes[starts[document]:starts[document] + len(words)] = own
    owner = np.repeat(np.arange(len(documents)), sizes + gram)
    places = np.arange(len(owner)) - starts[owner]
    inside = places < sizes[owner]
    codes[:-1][inside] = pd.factorize(owner[inside] * max(len(number), 1) + codes[:-1][inside])[0] + 1
    at = repeated(codes[:-1], np.where(inside, starts[owner] + sizes[owner], 0), gram)
    if not len(at):
        return out
    order, same = suffix_order(codes, at, gram)
    listed = codes.tolist()
    lcp = np.array(shared_words(listed, order.tolist(), same.tolist(), gram), np.int64)
    # A class can hold a run only if its largest LCP covers its smallest gap often enough.
    firsts = np.flatnonzero(~same)
    label = np.cumsum(~same) - 1
    turn = np.lexsort((order, label))
    gap = np.where(np.r_[False, label[turn][1:] == label[turn][:-1]], np.diff(order[turn], prepend=0), len(codes))
    open_ = np.maximum.reduceat(lcp, firsts) >= (min_exponent - 1) * np.minimum.reduceat(gap, firsts)
    taken = open_[label]
    for start, length, period in join_classes(listed, order[taken].tolist(), lcp[taken].tolist(), min_words, min_exponent):
        document = int(owner[start])
        out[document].append((start - int(starts[document]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6,
                  min_exponent: int = 4) -> DataFrame:
    """Per document: id, n_words, runs (start, length, period; by start, then period) of at least min_words words and
    min_exponent periods, and text without the repetitions, its words joined by one space."""
    if min_words < 1 or min_exponent < 2:
        raise ValueError("min_words must be at least 1 and min_exponent at least 2")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<{RUN}>, text string"
    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lo = batch.column("id"), batch.column("t").cast(pa.binary()), 0
            while lo < len(batch):
                documents: list[list[bytes]] = []
                total = 0
                while lo + len(documents) < len(batch) and (not documents or total < SLICE_WORDS):
                    # Bytes split at ASCII white space only.
                    documents.append((texts[lo + len(documents)].as_py() or b"").split())
                    total += len(documents[-1])
                found = runs_of(documents, min_words, min_exponent)
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                offsets = np.cumsum([0, *map(len, found)])
                structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=[pa.field(*f) for f in fields])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, len(documents)), pa.array([len(d) for d in documents], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                    pa.array([collapsed(d, r) for d, r in zip(documents, found)], pa.binary()).cast(pa.string()),
                ], names=["id", "n_words", "runs", "text"])
                lo += len(documents)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null if there is none."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): a tenth of the documents, chosen by their id's checksum h, made periodic from a word on.

    If h % 10 = 0 and there are n > 0 words, each word i >= a becomes word a + (i - a) % p with g = h div 10, a = g % n
    and p = 1 + (n - a) div (3 + g % 8). All other texts (and those of null ids) stay as they are.
    """
    h = F.crc32(docs[id_col].cast("string"))
    text = docs[text_col].cast("string")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def cut(of: Column) -> Column:
        n, g, at = of["n"], of["g"], of["a"]
        p = F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8))
        return let(F.struct(of["w"].alias("w"), n.alias("n"), at.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), s["n"] - 1),
            lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))), " "))

    def sized(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        return F.when(n > 0, let(F.struct(w.alias("w"), n.alias("n"), g.alias("g"), (g % n).alias("a")), cut)).otherwise(text)

    return docs.select(docs[id_col].alias(id_col), F.when(h % 10 == 0, let(words, sized)).otherwise(text).alias(text_col))
