"""Alignment of two tokenizers against pairs listed one by one."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from emberwatch.llm import align
from emberwatch.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def files():
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def stand_ins():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}


def slow(texts, files):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by the libraries and loops over occurrences."""
    a_model, b_model = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a_model.encode_special_tokens = True
    back, documents = stand_ins(), []
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            a = [(i, bytes(back[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in b_model.encode(text):
                piece = b_model.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends = []
                for side in (a, b):
                    at, own = 0, []
                    for i, raw in side:
                        at += len(raw)
                        own.append((i, at))
                    ends.append(own)
                common = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
                lo = 0
                for hi in common:
                    groups.append(tuple([i for i, e in side if lo < e <= hi] for side in ends))
                    lo = hi
        documents.append(groups)
    links = [[(x, y) for ga, gb in groups for x in ga for y in gb] for groups in documents]
    count = Counter(pair for own in links for pair in set(own))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    return [(sum(len(ga) for ga, _ in groups), sum(len(gb) for _, gb in groups), len(groups), len(own),
             sum(count[p] == highest[p[0]] for p in own), sum(count[p] for p in own),
             ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)) for groups, own in zip(documents, links)]


TEXTS = ["Hello world, hello tokens!", "hello world", None, "", " leading", "two  spaces   three\n\nlines\ttabs", "▁ given back as space",
         "naïve façade 日本語 🙂 Ünïcode", "<|endoftext|> and </s> <s> <unk> are plain <0x41>", "a" * 300, "ab1" * 100, "x\x00y", "hello world",
         "  ", "\n", "internationalization untranslatability " * 3, "é     odd spaces", "\r\n\r\n"]


@pytest.mark.parametrize("known", [0, 5, 1 << 17])
def test_links_against_the_libraries(spark, files, known, monkeypatch):
    rows = [(n if n != 3 else None, t) for n, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, -1, "row") for i, t in rows], "doc_id long, text string, n_a int, row string").repartition(3)
    got = align.link_counts(docs, *files, with_groups=True, known=known).collect()
    expected = [(i, *own[:-1], hashlib.sha256(own[-1].encode()).hexdigest() if own[0] else "", own[-1])
                for (i, _), own in zip(rows, slow(TEXTS, files))]
    assert Counter(map(tuple, got)) == Counter(expected)
    assert sum(r.n_groups > 1 for r in got) > 8 and any(r.n_links > r.n_groups for r in got)


def test_groups_in_blocks_and_passes(files, monkeypatch):
    """Pairs of one long group come out once, however few a table may hold."""
    sides = align.byte_side(files[0]), align.piece_side(files[1])
    whole = align.align_slice(TEXTS, sides, True)
    monkeypatch.setattr(align, "BLOCK", 7)
    parts = align.align_slice(TEXTS, sides, True)
    assert len(parts[1]) > 3 and whole[0]["groups"] == parts[0]["groups"]

    def flat(tables):
        return Counter((r["document"], r["pair"], r["times"]) for t in tables for r in t.to_pylist())

    assert flat(whole[1]) == flat(parts[1]) and max(flat(parts[1]).values()) == 1
    own = pa.concat_tables(whole[1])
    assert sum(own["times"].to_pylist()) == whole[0]["n_links"].sum()


def test_frequent_pairs_are_bounded(spark):
    counts = spark.createDataFrame([(i, 1 + i % 9, i % 2 == 0) for i in range(900)], "pair long, n long, best boolean")
    for most in (0, 99, 100, 101, 450, 5000):
        bound, known = align.frequent(counts, most)
        assert len(known) <= most and set(known["pair"].to_pylist()) == {i for i in range(900) if 1 + i % 9 >= bound}
    assert align.frequent(counts, 5000)[0] == 1


def test_very_long_texts(spark, files):
    rows = [(1, " " * 300_000), (2, "ab " * 100_000), (3, "x" * 200_000)]
    got = {r.doc_id: r for r in align.link_counts(spark.createDataFrame(rows, "doc_id long, text string"), *files).collect()}
    assert got[2].n_groups > 90_000 and got[3].n_a > 0 and len(got) == 3


def test_nasty_rows(nasty, nasty_rows, nothing, files):
    short = [(i, t) for i, t, *_ in nasty_rows]
    got = align.link_counts(nasty, *files).collect()
    expected = slow([t for _, t in short], files)
    assert Counter(tuple(r)[:5] for r in got) == Counter((i, *own[:4]) for (i, _), own in zip(short, expected))
    assert Counter(r.n_best for r in got) == Counter(own[4] for own in expected)
    assert align.link_counts(nothing, *files).collect() == []
