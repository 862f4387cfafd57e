"""The pipeline against a brute-force version of its stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from .test_native import contained_by_hand

import __spark_entry__ as entry_point
import corpus_pipeline
from emberwatch.llm import langid, packing, simhash
from emberwatch.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    german = ["".join(rnd.choice("klmnopqrstü") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    rows, items = [], []
    for i in range(60):
        words = rnd.choices(german if i % 3 == 0 else vocabulary, k=rnd.choice([8, 60, 400]))
        rows.append([i, " ".join(words), "de" if i % 3 == 0 else "en"])
        if i % 10 == 1:
            rows += [[100 + i, rows[-1][1], "en"], [200 + i, rows[-1][1], None]]  # exact copies
        if i % 7 == 2 and len(words) > 50:
            edited = list(words)
            edited[len(words) // 2] = "changed"
            rows.append([300 + i, " ".join(edited), "en"])
        if i % 9 == 4:
            item = " ".join(rnd.choices(vocabulary, k=20))
            items.append((i, item))
            rows.append([400 + i, " ".join(rnd.choices(vocabulary, k=100)) + " " + item.upper() + " end of it", "en"])
    rows += [[500, None, "en"], [501, "", None], [502, "12 34 !", "en"], [None, "abc abd no id here abc", "en"], [None, None, None]]
    return [(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows], items


def by_hand(spark, rows, items):
    """Rows left after each stage, and the pieces."""
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, ~langid.held_out(docs["doc_id"]))
    left, out = [], {}
    for row in rows:
        if langid.has_letter(row[1]):
            bits = model.code_lengths(langid.folded(row[1]))
            if 1 / np.exp2(bits.min() - bits).sum() >= 0.5:
                left.append(row)
    out["language_id"] = left
    keep = {}
    for row in left:
        if row[1] not in keep or (row[0] if row[0] is not None else -1) > (keep[row[1]][0] if keep[row[1]][0] is not None else -1):
            keep[row[1]] = row
    out["exact_dedup"] = left = list(keep.values())
    prints = [simhash.sketch(r[1], 5) for r in left]
    label = list(range(len(left)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            apart = sum((x ^ y).bit_count() for x, y in zip(a[0], b[0]))
            if apart <= 46 and any(x == y for x, y in zip(a[1], b[1])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for row, x in zip(left, label):
        groups.setdefault(x, []).append(row)
    out["simhash_near_dedup"] = left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    bad = {i for i, *_ in contained_by_hand(left, items)}
    out["decontamination"] = left = [r for r in left if r[0] not in bad]
    encode, pieces = packing.library_encoder(tokenizer_file("byte_bpe_50k.json")), Counter()
    for i, text, *_ in left:
        ids, at = [*encode(text), 1], 0
        for n in packing.lengths(len(ids), 2048):
            pieces[(i, at, n, tuple(ids[at:at + n]))] += 1
            at += n
    return out, pieces


def test_pipeline(spark, corpus, tmp_path):
    rows, items = corpus
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, pieces = by_hand(spark, rows, items)
    sizes = [len(rows), *(len(x) for x in want.values())]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)  # every stage has something to do
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((r[0], r[1]) for r in want[name]), name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, tuple(r.ids)) for r in got) == pieces
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry_point.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


@pytest.mark.parametrize("name", sorted(n for n in entry_point.oracle_sql() if n.startswith("op")))
def test_against_sql(spark, name):
    from check_oracle import compare

    ok, line = compare(spark, "/root/testdata/sf0.001", name, entry_point.queries()[name], entry_point.oracle_sql()[name])
    assert ok, line
