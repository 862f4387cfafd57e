"""Alignment of two tokenizers over a corpus, as an Arrow pipeline.

Inside a task Arrow does the work, some documents at a time: token ids as list arrays, their flat values and parent
indices, byte lengths by a take from the vocabulary, segmented cumulative sums for the byte ends, an Acero hash join of
both sides on (document, end) for the places where both end, and Table.group_by for the pairs of ids that share a group.
Partial document counts of pairs come from Table.group_by too, and Spark merges them.

Every group of tokens between two common ends links all its tokens of one side with all of the other. Links are never
listed one by one: a group's ids are counted first, and a document with very many different pairs is taken in passes over
its A ids, which leave disjoint pairs. Pairs that many documents hold are known to all tasks (at most KNOWN of them, by a
bound on the count); documents meet the counts of all other pairs by a shuffle, in which no key is frequent.

Texts that are null, empty, or not given back byte for byte by a tokenizer have no tokens: zeros and an empty text of
groups. Repeated rows are documents of their own, null ids stay, other columns play no part, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberwatch.llm.common import stored
from emberwatch.llm.packing import byte_vocabulary

#: Characters encoded and aligned together (one longer document goes alone).
SLICE_CHARS = 1_000_000
#: Pairs of ids in one table or list: what a pass over a document's A ids may hold.
BLOCK = 1_000_000
#: Most pairs with their counts that every task knows (17 bytes each).
KNOWN = 1 << 17


@dataclass
class Side:
    """One tokenizer: texts to ids, and the bytes, byte lengths and decimal names of its ids."""

    encode: Callable[[list[str]], list[np.ndarray]]
    pieces: pa.Array

    def __post_init__(self) -> None:
        self.sizes = pc.binary_length(self.pieces).cast(pa.int64())
        self.names = pa.array([str(i) for i in range(len(self.pieces))])


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """A byte-level BPE tokenizers file, run by tiktoken: each text after a space, special tokens as plain text."""
    from public_tokenizers import PATTERN

    ranks, special = byte_vocabulary(path)
    encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(" " + text)
        except BaseException as failure:  # its pattern gives up on very long white space, by an error or a panic
            if not isinstance(failure, ValueError) and type(failure).__name__ != "PanicException":
                raise
        if not slow:
            slow.append(Tokenizer.from_file(path))
            slow[0].encode_special_tokens = True
        return np.array(slow[0].encode(" " + text, add_special_tokens=False).ids)

    pieces = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for piece, i in [*ranks.items(), *((text.encode(), i) for text, i in special.items())]:
        pieces[i] = piece
    return Side(lambda texts: [encode(t) if t else np.zeros(0) for t in texts], pa.array(pieces, pa.binary()))


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A SentencePiece model, which puts a space before each text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
              for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
    return Side(lambda texts: [np.array(ids, np.int32) for ids in model.encode(texts, num_threads=1)], pa.array(pieces, pa.binary()))


@dataclass
class Tokens:
    """Flat tokens of the documents of a slice: ids, each one's document, and its byte end there."""

    ids: pa.Array
    document: pa.Array
    end: pa.Array
    whole: np.ndarray  # by document: the bytes give the text back


def flat_tokens(lists: list[np.ndarray], side: Side, texts: list[bytes]) -> Tokens:
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32)))
    ids, document = listed.flatten(), pc.list_parent_indices(listed)
    running = pc.cumulative_sum(side.sizes.take(ids))
    last = np.concatenate([[0], running.to_numpy()])[listed.offsets.to_numpy()]
    end = pc.subtract(running, pa.array(last[:-1]).take(document))
    joined = side.pieces.take(ids)
    data = memoryview(joined.buffers()[2] or b"").cast("B")  # a signed view is not equal to bytes
    whole = np.array([bool(t) and data[lo:hi] == t for t, lo, hi in zip(texts, last[:-1].tolist(), last[1:].tolist())], bool)
    return Tokens(ids, document, end, whole)


def only(tokens: Tokens, whole: np.ndarray) -> Tokens:
    if whole.all():
        return tokens
    mask = pa.array(whole[tokens.document.to_numpy()])
    return Tokens(tokens.ids.filter(mask), tokens.document.filter(mask), tokens.end.filter(mask), whole)


def common_ends(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and in b of the tokens that end at the same byte of the same document, in order."""
    sides = [pa.table({"document": t.document, "end": t.end, name: pa.array(np.arange(len(t.ids)))})
             for t, name in ((a, "at_a"), (b, "at_b"))]
    met = sides[0].join(sides[1], keys=["document", "end"], join_type="inner", use_threads=False)
    return np.sort(met["at_a"].to_numpy()), np.sort(met["at_b"].to_numpy())


def id_counts(tokens: Tokens, cuts: np.ndarray, several: np.ndarray, name: str) -> pa.Table:
    """(group, id, how often) of one side, for the groups of several tokens."""
    groups = np.repeat(np.arange(len(cuts)), np.diff(cuts, prepend=-1))
    mask = several[groups]
    return pa.table({"group": pa.array(groups[mask]), name: tokens.ids.filter(pa.array(mask))}).group_by(["group", name], use_threads=False).aggregate(
        [([], "count_all")]).rename_columns(["group", name, f"n_{name}"]).sort_by([("group", "ascending"), (name, "ascending")])


def merged(tables: list[pa.Table]) -> pa.Table:
    """(document, pair, times) with the times of equal pairs added up."""
    return pa.concat_tables(tables).group_by(["document", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(
        ["document", "pair", "times"])


def id_pairs(a: pa.Table, b: pa.Table, single: pa.Table, of: np.ndarray, width: int) -> Iterator[pa.Table]:
    """Tables of (document, pair = a * width + b, times); no pair of a document stands in two of them.

    of has each group's document; ``single`` has the pairs of groups of one token on both sides. A block of groups is joined at
    a time; documents with more than BLOCK combinations of ids are taken alone, in passes over their A ids.
    """
    groups = len(of)
    each = (np.bincount(a["group"].to_numpy(), minlength=groups) * np.bincount(b["group"].to_numpy(), minlength=groups))
    documents = int(of.max()) + 1 if groups else 0
    by_document = np.bincount(of, weights=each, minlength=documents) + np.bincount(single["document"].to_numpy(), minlength=documents)

    def joined(part: pa.Table, other: pa.Table) -> pa.Table:
        both = part.join(other, keys=["group"], join_type="inner", use_threads=False)
        pair = pc.add(pc.multiply(both["a"].cast(pa.int64()), width), both["b"].cast(pa.int64()))
        document = pa.array(of[both["group"].to_numpy()])
        return pa.table({"document": document, "pair": pair, "times": pc.multiply(both["n_a"], both["n_b"])})

    def blocks(part: pa.Table, other: pa.Table) -> Iterator[pa.Table]:
        """Joins of neighbouring A rows that meet about BLOCK rows together."""
        if not len(part):
            return
        met = np.bincount(other["group"].to_numpy(), minlength=groups)[part["group"].to_numpy()]
        block = np.cumsum(met) // BLOCK
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(block)]):
            one = part.slice(lo, hi - lo)
            first, last = one["group"][0].as_py(), one["group"][len(one) - 1].as_py()
            span = np.searchsorted(other["group"].to_numpy(), [first, last + 1])
            yield joined(one, other.slice(span[0], span[1] - span[0]))

    large = np.flatnonzero(by_document > BLOCK)
    few = ~np.isin(of, large)
    small_a, small_b = (t.filter(pa.array(few[t["group"].to_numpy()])) for t in (a, b))
    plain = single.filter(pa.array(~np.isin(single["document"].to_numpy(), large))) if len(large) else single
    if len(small_a) or len(plain):
        yield merged([plain, *(merged([x]) for x in blocks(small_a, small_b))])
    for document in large:
        own_a, own_b = (t.filter(pa.array(of[t["group"].to_numpy()] == document)) for t in (a, b))
        plain = single.filter(pa.array(single["document"].to_numpy() == document))
        passes = int(by_document[document] // BLOCK) + 1
        for turn in range(passes):
            part = own_a.filter(pa.array(own_a["a"].to_numpy() % passes == turn))
            alone = plain.filter(pa.array(plain["pair"].to_numpy() // width % passes == turn))
            if len(part) or len(alone):
                yield merged([alone, *(merged([x]) for x in blocks(part, own_b))])


def group_texts(a: Tokens, b: Tokens, cuts: tuple[np.ndarray, np.ndarray], groups: np.ndarray, sides: tuple[Side, Side]) -> pa.Array:
    """Per document "a1,a2|b1;a3|b2,b3": the ids of its groups in order."""
    parts = []
    for tokens, at, side in zip((a, b), cuts, sides):
        offsets = pa.array(np.r_[0, at + 1].astype(np.int32))
        parts.append(pc.binary_join(pa.ListArray.from_arrays(offsets, side.names.take(tokens.ids)), ","))
    both = pc.binary_join_element_wise(*parts, "|")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(groups)].astype(np.int32)), both), ";")


def align_slice(texts: list[str | None], sides: tuple[Side, Side], with_groups: bool) -> tuple[dict, list[pa.Table]]:
    """Columns by document, and tables of its id pairs."""
    n = len(texts)
    plain = [t or "" for t in texts]
    spaced = [b" " + t.encode() if t else b"" for t in plain]
    both = [flat_tokens(side.encode(plain), side, spaced) for side in sides]
    whole = both[0].whole & both[1].whole
    a, b = (only(t, whole) for t in both)
    cuts = common_ends(a, b)
    of = a.document.to_numpy()[cuts[0]]
    groups = np.bincount(of, minlength=n)
    per_group = np.diff(cuts[0], prepend=-1) * np.diff(cuts[1], prepend=-1)
    links = np.zeros(n, np.int64)
    np.add.at(links, of, per_group)
    listed = group_texts(a, b, cuts, groups, sides)
    columns = {
        "n_a": np.bincount(a.document.to_numpy(), minlength=n), "n_b": np.bincount(b.document.to_numpy(), minlength=n),
        "n_groups": groups, "n_links": links,
        "groups_sha256": [hashlib.sha256(t.as_buffer()).hexdigest() if ok else "" for t, ok in zip(listed, whole)],
    }
    if with_groups:
        columns["groups"] = listed
    width = len(sides[1].pieces)
    alone = (np.diff(cuts[0], prepend=-1) == 1) & (np.diff(cuts[1], prepend=-1) == 1)
    left, right = (t.ids.to_numpy()[c[alone]].astype(np.int64) for t, c in zip((a, b), cuts))
    single = pa.table({"document": pa.array(of[alone]), "pair": pa.array(left * width + right), "times": pa.array(np.ones(len(left), np.int64))})
    pairs = id_pairs(id_counts(a, cuts[0], ~alone, "a"), id_counts(b, cuts[1], ~alone, "b"), single, of, width)
    return columns, list(pairs)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_CHARS bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_CHARS, prepend=-1))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)])


def aligned(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text",
            with_groups: bool = False) -> DataFrame:
    """Rows of documents: row (its number here), part, id, n_a, n_b, n_groups, n_links, groups_sha256, groups if asked, and
    pairs with times. Part 0 has all columns; further parts, with pairs alone, come only for documents with very many.
    The number of a row is its place in the scan: read the result from a written table, not twice from here.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shown = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"] + ["groups"] * with_groups
    types = dict.fromkeys(shown[:4], pa.int64()) | {"groups_sha256": pa.string(), "groups": pa.string()}
    schema = (f"row long, id {kind}, part int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
              + ", groups string" * with_groups + ", pairs array<long>, times array<long>")
    names = ["row", "id", "part", *shown, "pairs", "times"]
    ints = pa.list_(pa.int64())

    def lists(table: pa.Table, rows: int) -> list[pa.Array]:
        ordered = table.sort_by([("document", "ascending"), ("pair", "ascending")]).combine_chunks()
        offsets = pa.array(np.searchsorted(ordered["document"].to_numpy(), np.arange(rows + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, ordered[c].to_numpy(), type=ints) for c in ("pair", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(file_a), piece_side(file_b)
        none = pa.table({"document": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
        for batch in batches:
            for lo, hi in slices(batch.column("t")):
                row, ids, texts = (batch.column(c).slice(lo, hi - lo) for c in ("row", "id", "t"))
                columns, tables = align_slice(texts.to_pylist(), sides, with_groups)
                first, *more = tables or [none]
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [row, ids, pa.array(np.zeros(n, np.int32)), *(pa.array(columns[c], types[c]) for c in shown), *lists(first, n)],
                    names=names)
                for part, table in enumerate(more, 1):
                    has = np.unique(table["document"].to_numpy())
                    own = table.set_column(0, "document", pa.array(np.searchsorted(has, table["document"].to_numpy())))
                    at = pa.array(has)
                    yield pa.RecordBatch.from_arrays(
                        [row.take(at), ids.take(at), pa.array(np.full(len(has), part, np.int32)),
                         *(pa.nulls(len(has), types[c]) for c in shown), *lists(own, len(has))], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    return rows.mapInArrow(run, schema)


def flat_pairs(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """(row, pair, times) of some rows at a time."""
    pairs, times = batch.column("pairs"), batch.column("times")
    sizes = pc.list_value_length(pairs).to_numpy()
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK, prepend=-1))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)]):
        part = pairs.slice(lo, hi - lo)
        yield pa.table({"row": batch.column("row").slice(lo, hi - lo).take(pc.list_parent_indices(part)), "pair": part.flatten(),
                        "times": times.slice(lo, hi - lo).flatten()})


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(pair, n documents that hold it linked, best: n is its A id's highest), written to the shared folder."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for batch in batches:
            for table in flat_pairs(batch):
                new = table.select(["pair"]).append_column("n", pa.array(np.ones(len(table), np.int64)))
                held = pa.concat_tables([held, new]).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
                if len(held) > 2 * BLOCK:
                    yield from held.to_batches()
                    held = held.slice(0, 0)
        yield from held.to_batches()

    counts = stored(links.select("row", "pairs", "times").mapInArrow(partial, "pair long, n long")
                    .groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / F.lit(width)).alias("a")
    # One row per A id of the vocabulary.
    highest = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int = KNOWN) -> tuple[int, pa.Table]:
    """A bound on n that at most so many pairs reach, and these pairs: counted by powers of two first."""
    by_size = {r.size: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(
        F.count("*").alias("pairs")).collect()}
    size, total = 63, 0
    while size > 0 and total + by_size.get(size - 1, 0) <= most:
        size -= 1
        total += by_size.get(size, 0)
    return 1 << size, counts.where(F.col("n") >= F.lit(1 << size)).select("pair", "n", "best").toArrow()


def scored(links: DataFrame, counts: DataFrame, known: pa.Table, bound: int) -> DataFrame:
    """(row, n_best, count_sum): over a row's links those whose count is their A id's highest, and the counts' sum."""
    best = pa.table({"pair": known["pair"], "n": known["n"], "best": known["best"].cast(pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in flat_pairs(batch):
                met = table.join(best, keys=["pair"], join_type="left outer", use_threads=False)
                rare = met.filter(pc.is_null(met["n"]))
                sure = met.filter(pc.is_valid(met["n"]))
                sums = pa.table({"row": sure["row"], "n_best": pc.multiply(sure["times"], sure["best"]),
                                 "count_sum": pc.multiply(sure["times"], sure["n"])}).group_by("row", use_threads=False).aggregate(
                    [("n_best", "sum"), ("count_sum", "sum")])
                # A sum has a pair of its own below 0, so that the sums are spread over the shuffle like the rare pairs.
                blank = pa.nulls(len(rare), pa.int64())
                yield from pa.concat_tables([
                    pa.table({"row": sums["row"], "pair": pc.subtract(-1, sums["row"]), "times": pa.nulls(len(sums), pa.int64()),
                              "n_best": sums["n_best_sum"], "count_sum": sums["count_sum_sum"]}),
                    pa.table({"row": rare["row"], "pair": rare["pair"], "times": rare["times"], "n_best": blank, "count_sum": blank}),
                ]).to_batches()

    parts = links.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long, n_best long, count_sum long")
    tail = counts.where(F.col("n") < F.lit(bound))
    return parts.join(tail, "pair", "left").groupBy("row").agg(
        F.sum(F.coalesce("n_best", F.when(F.col("best"), F.col("times")).otherwise(0))).alias("n_best"),
        F.sum(F.coalesce("count_sum", F.col("times") * F.col("n"))).alias("count_sum"))


def link_counts(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text",
                with_groups: bool = False, known: int = KNOWN) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked."""
    links = stored(aligned(docs, file_a, file_b, id_col, text_col, with_groups), "token-links")
    counts = stored(pair_counts(links, len(piece_side(file_b).pieces)), "pair-best")
    bound, common = frequent(counts, known)
    sums = scored(links, counts, common, bound)
    shown = ["n_a", "n_b", "n_groups", "n_links"]
    return links.where("part = 0").join(sums, "row", "left").select(
        F.col("id").alias(id_col), *shown, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")),
        "groups_sha256", *(["groups"] if with_groups else []))
