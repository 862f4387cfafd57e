"""SimHash near-duplicates with pigeonring candidate filtering.

A text's words are runs without ASCII white space, A-Z lower-cased; a bit of its 64-bit fingerprint is set when it
is set in more than half of the XXH64 hashes (seed 42) of its word shingles, repeats included. Fewer words than a
shingle make one shingle of all words; no words, or null, make fingerprint zero, which links like any other.

Fingerprints link at max_bits or fewer differing bits. The 64 bits form a ring of max_bits + 1 segments. If two
fingerprints link, some segment starts a chain in which every l consecutive segments differ in at most
l * max_bits / segments bits: the first is equal, the first two differ in one bit at most, and so on. The join key
is therefore the first segment and an unchanged half of the second; whoever meets there must pass the budgets of the
growing chain, and at last the full distance. Keys are formed by distinct fingerprints only, so copies of a text
cost nothing. A key that many fingerprints share is cut into blocks, and each pair of blocks is one group of bounded
size; a group yields a spanning forest of its links, not its pairs, so groups of near copies stay linear in rows.

Wide limits on 64 bits would also link strangers. With check_bits every text has 64 further bits, taken from the same
hashes by a fixed mixing, and a link needs check_bits or fewer differing bits among all 128 as well.

A limit that finds texts of 0.8 common shingles leaves segments too short to be keys. drop_similar therefore takes 256 bits
and finds candidates by bands of minima of the shingle hashes (12 bands of 5 minima: 99 % of pairs at 0.8 share one; keys
have 64 bits at every size of the corpus). Candidates must pass the ring of the four 64-bit words, and then the full
distance. Texts whose bits are all equal are one node.

Documents take the smallest id of their connected component; rows sharing an id stay apart unless linked. Null ids
are kept and label a component only if all its ids are null. Other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import components, stored

#: Fingerprints of a block; a group holds two blocks at most.
BLOCK = 2048
#: Up to this many members a group is compared as one matrix.
MATRIX = 512


def mixed(h: np.ndarray) -> np.ndarray:
    """Further 64 bits from each hash: a multiplication and shifts that spread every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, words: int, wide: bool = False) -> tuple[int, int, int]:
    """The fingerprint and its further bits as unsigned numbers, and the number of shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0, 0, 0
    joined = b" ".join(found)
    if len(found) <= words:
        h = xxhash.xxh64_intdigest(joined, 42)
        return h, int(mixed(np.array([h], np.uint64))[0]) if wide else 0, 1
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest = xxhash.xxh64_digest
    n = len(starts)
    ones, more = np.zeros(64, np.int64), np.zeros(64, np.int64)
    stops = (ends[words - 1:] - 1).tolist()
    for lo in range(0, n, 4096):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[lo:lo + 4096], stops[lo:lo + 4096])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        if wide:
            far = mixed(np.frombuffer(raw, ">u8").astype(np.uint64)).astype(">u8")
            more += np.unpackbits(far.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return majority(ones, n), majority(more, n) if wide else 0, n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                 wide: bool = False) -> DataFrame:
    """(id, fp, more, shingles, th) per row; fp and more hold 64 bits as signed longs, th tells texts of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words, wide) for t in batch.column("t")], np.uint64).reshape(-1, 3)
            fp, more, n = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in made.T)
            yield pa.RecordBatch.from_arrays([batch.column("id"), fp, more, n, batch.column("th")],
                                             names=["id", "fp", "more", "shingles", "th"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"),
                       F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("th"))
    return rows.mapInArrow(run, f"id {kind}, fp long, more long, shingles long, th long")


def ring(max_bits: int) -> list[tuple[int, int]]:
    """(offset from the top bit, width) of each segment, wide ones first."""
    parts = max_bits + 1
    widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _bits(offset: int, width: int) -> int:
    return ((1 << width) - 1) << (64 - offset - width)


def chains(max_bits: int) -> list[list[tuple[int, int]]]:
    """For every first segment: (mask, budget) of its chains of one segment, two segments, and so on."""
    segments = ring(max_bits)
    m = len(segments)
    out = []
    for first in range(m):
        mask, steps = 0, []
        for length in range(1, m + 1):
            mask |= _bits(*segments[(first + length - 1) % m])
            steps.append((mask, length * max_bits // m))
        out.append(steps)
    return out


def key_masks(max_bits: int) -> list[tuple[int, int]]:
    """(first segment, mask of that segment and one half of the next): with at most one bit of the next changed, one
    of its halves is unchanged. A ring of one segment keys on all bits."""
    segments = ring(max_bits)
    m = len(segments)
    if m == 1:
        return [(0, _bits(*segments[0]))]
    masks = []
    for first in range(m):
        offset, width = segments[(first + 1) % m]
        half = width // 2
        for part in ((offset, half), (offset + half, width - half)):
            masks.append((first, _bits(*segments[first]) | _bits(*part)))
    return masks


def forest(fps: np.ndarray, more: np.ndarray, steps: list[tuple[int, int]], check_bits: int) -> list[tuple[int, int]]:
    """Links of a group that pass every chain budget and the check, enough to join all that its links join."""

    def checked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[a] ^ fps[b]) + np.bitwise_count(more[a] ^ more[b]) <= check_bits

    masks = [(np.uint64(mask), budget) for mask, budget in steps[1:] or steps]
    links: list[tuple[int, int]] = []
    if len(fps) <= MATRIX:
        apart = fps[:, None] ^ fps[None, :]
        a, b = np.nonzero(np.triu(np.bitwise_count(apart & masks[0][0]) <= masks[0][1], 1))
        for mask, budget in masks[1:]:
            near = np.bitwise_count((fps[a] ^ fps[b]) & mask) <= budget
            a, b = a[near], b[near]
        near = checked(a, b)
        a, b = a[near], b[near]
        if len(a) <= 4 * len(fps):
            return list(zip(a.tolist(), b.tolist()))
    left = np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = left
            for mask, budget in masks:
                near = near[np.bitwise_count((fps[near] ^ fps[at]) & mask) <= budget]
            near = near[checked(near, np.full(len(near), at))]
            if len(near):
                links += [(int(at), int(x)) for x in near]
                front += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return links


def fingerprint_links(made: DataFrame, max_bits: int, check_bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """(u, v): links between the distinct (fp, more), enough to join all that are linked."""
    masks, steps = key_masks(max_bits), chains(max_bits)
    limit = 128 if check_bits is None else check_bits
    signed = [int(np.array(mask, np.uint64).view(np.int64)) for _, mask in masks]
    keys = made.select("fp", "more").distinct().select("fp", "more", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(mask)) for mask in signed])).alias("kind", "key"))
    counts = keys.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(counts, ["kind", "key"])
    # Block pairs (i, j), i <= j: a member of block i goes to all pairs that hold i; one block stays one group.
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", "more"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    pair = F.explode(F.when(blocks <= 2, F.array(F.lit(0))).otherwise(pairs)).alias("pair")
    groups = shared.select("kind", "key", "fp", "more", pair).groupBy("kind", "key", "pair").agg(
        F.collect_list(F.struct("fp", "more")).alias("own")).where(F.size("own") > 1).select("kind", "own")
    firsts = [first for first, _ in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("own")
            fps, more = (lists.values.field(c).to_numpy() for c in ("fp", "more"))
            at, ends = lists.offsets.to_numpy(), []
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                lo, hi = at[i], at[i + 1]
                pairs = forest(fps[lo:hi].view(np.uint64), more[lo:hi].view(np.uint64), steps[firsts[kind]], limit)
                if pairs:
                    ends.append(np.array(pairs) + lo)
            a, b = (np.concatenate(ends) if ends else np.empty((0, 2), np.int64)).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fps[a], more[a], fps[b], more[b])],
                                             names=["fp", "more", "fp2", "more2"])

    links = groups.mapInArrow(run, "fp long, more long, fp2 long, more2 long").distinct()
    return links.select(F.struct("fp", "more").alias("u"), F.struct(F.col("fp2").alias("fp"), F.col("more2").alias("more")).alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    max_bits: int = 2, check_bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: id, th, fp, shingles, component_id (smallest id linked, itself included) and stays,
    true for one text of each component."""
    made = stored(fingerprints(docs, id_col, text_col, words, check_bits is not None), "simhash")
    labels = stored(components(fingerprint_links(made, max_bits, check_bits, block)).select("node.*", "label"), "classes")
    labelled = made.join(labels, ["fp", "more"], "left").select(
        "id", "th", "fp", "shingles", F.coalesce("label", F.struct("fp", "more")).alias("label"))
    heads = labelled.groupBy("label").agg(
        F.min("id").alias("component_id"),
        F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("head"))
    # As a table it can be joined with a large class's rows split over many tasks.
    heads = stored(heads, "heads")
    out = labelled.join(heads, "label")
    return out.select(F.col("id").alias(id_col), "th", "fp", "shingles", "component_id",
                      (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("th") == F.col("head.th"))).alias("stays"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, all columns. Identical rows (same id and text) stay or go together."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT stays").select(
        F.col(id_col).alias("__id"), F.col("th").alias("__th"))
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left_anti")


#: Words of a wide fingerprint, bands of minima and minima of a band.
WIDE, BANDS, DEPTH = 4, 12, 5
_FACTORS = np.random.default_rng(42).integers(1, 2**63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str | None, words: int) -> tuple[list[int], list[int]]:
    """256 bits as four numbers and the keys of the bands; a text without words has zeros and one key, its own kind."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        spans = [(0, len(joined))] if found else []
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        spans = list(zip([0, *ends[:-words].tolist()], (ends[words - 1:] - 1).tolist()))
    ones, least = np.zeros((WIDE, 64), np.int64), np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    digest = xxhash.xxh64_digest
    for lo in range(0, len(spans), 4096):
        h = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans[lo:lo + 4096]]), ">u8").astype(np.uint64)
        least = np.minimum(least, (mixed(h)[:, None] * _FACTORS).min(axis=0))
        for word in range(WIDE):
            ones[word] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            h = mixed(h)
    keys = [xxhash.xxh64_intdigest(least[b * DEPTH:(b + 1) * DEPTH].tobytes(), b) for b in range(BANDS)]
    return [majority(o, len(spans)) for o in ones], keys


def ring_passes(apart: np.ndarray, limit: int) -> np.ndarray:
    """Whether in each row of word distances a chain around the ring keeps every proportional budget, its whole included."""
    m = apart.shape[1]
    budgets = np.arange(1, m + 1) * limit / m
    passed = np.zeros(len(apart), bool)
    for first in range(m):
        left = np.flatnonzero(~passed & (apart[:, first] <= budgets[0]))
        sums = np.cumsum(np.roll(apart[left], -first, axis=1), axis=1)
        passed[left] = (sums <= budgets).all(axis=1)
    return passed


def band_forest(bits: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of a group of wide fingerprints (rows of words) that join all that its links join."""
    links: list[tuple[int, int]] = []
    left = np.arange(len(bits))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = left[ring_passes(np.bitwise_count(bits[left] ^ bits[at]).astype(np.int64), limit)]
            if len(near):
                links += [(at, int(x)) for x in near]
                front += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return links


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, limit: int = 46,
            block: int = BLOCK) -> DataFrame:
    """One row per document: id, th, component_id and stays, as near_duplicates; links at limit or fewer of 256 bits."""
    kind = docs.schema[id_col].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t.as_py(), words) for t in batch.column("t")]
            columns = [pa.array([np.array(m[i], np.uint64).view(np.int64) for m in made], longs) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *columns], names=["id", "th", "bits", "keys"])

    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("th"),
                       docs[text_col].cast("string").alias("t"))
    made = stored(rows.mapInArrow(sketched, f"id {kind}, th long, bits array<long>, keys array<long>"), "sketches")
    word = [F.col("bits")[i].alias(f"w{i}") for i in range(WIDE)]
    node = F.struct(*word)
    # Texts of equal bits are linked; of a node's keys those of any of its texts count.
    keys = made.select(node.alias("node"), F.posexplode("keys").alias("band", "key")).distinct()
    counts = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(counts, ["band", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    pair = F.explode(F.when(blocks <= 2, F.array(F.lit(0))).otherwise(pairs)).alias("pair")
    groups = shared.select("band", "key", "node", pair).groupBy("band", "key", "pair").agg(
        F.sort_array(F.collect_list("node")).alias("own")).where(F.size("own") > 1)
    # Near copies share most bands: a group is compared once, whatever the number of bands in which it comes.
    groups = groups.select("own").groupBy(F.xxhash64("own").alias("h")).agg(F.first("own").alias("own")).select("own")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("own")
            bits = np.stack([lists.values.field(f"w{i}").to_numpy() for i in range(WIDE)], axis=1).view(np.uint64)
            at, ends = lists.offsets.to_numpy(), []
            for lo, hi in zip(at[:-1], at[1:]):
                found = band_forest(bits[lo:hi], limit)
                if found:
                    ends.append(np.array(found) + lo)
            u, v = (np.concatenate(ends) if ends else np.empty((0, 2), np.int64)).T
            ints = bits.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ints[x, i])) for x in (u, v) for i in range(WIDE)],
                                             names=[f"{s}{i}" for s in "uv" for i in range(WIDE)])

    found = groups.mapInArrow(linked, ", ".join(f"{s}{i} long" for s in "uv" for i in range(WIDE))).distinct()
    ends = [F.struct(*[F.col(f"{s}{i}").alias(f"w{i}") for i in range(WIDE)]).alias(s) for s in "uv"]
    labels = stored(components(stored(found.select(*ends), "links")).select("node", "label"), "classes")
    labelled = made.select("id", "th", node.alias("node")).join(labels, "node", "left").select(
        "id", "th", F.coalesce("label", "node").alias("label"))
    heads = stored(labelled.groupBy("label").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("head")),
                   "heads")
    return labelled.join(heads, "label").select(
        F.col("id").alias(id_col), "th", "component_id",
        (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("th") == F.col("head.th"))).alias("stays"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component of similar texts, all columns. Identical rows stay or go together."""
    gone = similar(docs, id_col, text_col, **options).where("NOT stays").select(F.col(id_col).alias("__id"), F.col("th").alias("__th"))
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left_anti")
