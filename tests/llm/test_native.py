"""Exact dedup, line dedup, license scan and decontamination against row-at-a-time versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from emberwatch.llm import decontam, exact_dedup, license_scan, line_dedup


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def test_exact_dedup(nasty, nasty_rows):
    groups = defaultdict(list)
    for row in nasty_rows:
        groups[row[1] or ""].append(row[0])
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = (max(known) if known else None), 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            want[(i, keep, len(ids), kept, sha(text))] += 1
    got = Counter(tuple(r) for r in exact_dedup.exact_digest(nasty).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_exact_dedup_keeps_one_row_and_all_columns(nasty, nasty_rows):
    kept = exact_dedup.drop_exact(nasty)
    assert kept.columns == nasty.columns
    rows = kept.collect()
    assert len(rows) == len({r[1] or "" for r in nasty_rows}) == len({r.text or "" for r in rows})
    assert {r.doc_id for r in rows if (r.text or "").startswith("the quick")} == {2}


def test_prefix_twins_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a" * 500 + "x"), (2, "a" * 500 + "y"), (3, "a" * 500 + "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_digest(docs).collect()) == [(1, 3), (2, 2), (3, 3)]


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def lines_by_hand(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = Counter()
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out[(i, len(lines), len(lines) - len(left), sha("\n".join(left)))] += 1
    return out


@pytest.mark.parametrize(("min_chars", "min_docs"), [(40, 5), (3, 2), (1, 1)])
def test_line_dedup(nasty, nasty_rows, min_chars, min_docs):
    got = line_dedup.drop_repeated_lines(nasty, min_chars=min_chars, min_docs=min_docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got) == lines_by_hand(nasty_rows, min_chars, min_docs)


def test_line_dedup_drops_in_all_but_the_largest(nasty):
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_repeated_lines(nasty).collect() if r.n_dropped}
    assert got == {5: 2, 6: 1, 7: 1, 8: 1}


def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def test_license_scan_base(nasty, nasty_rows):
    got = license_scan.license_scan(nasty).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(
        (i, *scan_by_hand(text)) for i, text, *_ in nasty_rows)
    assert all(0 <= r.score <= 1 for r in got)
    apache = next(r for r in got if r.doc_id == 10)
    assert apache.labels == "apache-2.0,cc-by,reserved" and apache.score == 1


def test_license_scan_base_places_do_not_merge(spark):
    text = "cc by cc by x cc by all rights reserved all rights all rights reserved general public license"
    got = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got)[1:6] == scan_by_hand(text)


def test_license_scan_finds_edited_notices(spark):
    words = license_scan.NOTICES["bsd"].split()
    docs = spark.createDataFrame([
        (1, "before " + " ".join(words[:7] + ["surely"] + words[7:]) + " after"), (2, " ".join(words[:5])),
        (3, " ".join(words[:8] + ["x"] * 30 + words[8:]))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.license_scan(docs).collect()}
    assert got == {1: "bsd", 2: "", 3: ""}


def contained_by_hand(rows, items, words=5, threshold=0.8):
    def split(text):
        return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]

    def grams(w, k):
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}

    out = set()
    for item, text in items:
        w = split(text)
        if not w:
            continue
        k = min(words, len(w))
        q = grams(w, k)
        for i, t, *_ in rows:
            found = len(q & grams(split(t), k))
            if found >= threshold * len(q) - 1e-9:
                out.add((i, item, len(q), found))
    return out


ITEMS = [(1, "quick brown fox jumps over the lazy dog again"), (2, "two words"), (3, ""), (4, None), (5, "one"),
         (6, " ".join(f"word{i} thing{i * 7 % 31}" for i in range(20, 40)) + " something else"), (None, "text of a row"),
         (7, "again again again again again again again")]


def test_decontamination(spark, nasty, nasty_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contaminated(nasty, items)
    pairs = {(r.doc_id, r.item_id, r.item_shingles, r.found) for r in got.collect()}
    assert pairs == contained_by_hand(nasty_rows, ITEMS) and len(pairs) > 5
    left = decontam.drop_contaminated(nasty, items)
    assert left.columns == nasty.columns
    bad = {i for i, *_ in pairs}
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, *_ in nasty_rows if i not in bad)


def test_decontamination_by_shuffled_joins(spark, nasty, nasty_rows, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    got = decontam.contaminated(nasty, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.item_shingles, r.found) for r in got.collect()} == contained_by_hand(nasty_rows, ITEMS)


def test_decontamination_at_the_threshold(spark):
    w = [f"w{i}" for i in range(54)]  # 50 shingles: 10 may be missing
    items = [(1, " ".join(w))]
    rows = [(1, " ".join(w[:44])), (2, " ".join(w[:43])), (3, "x " + " ".join(w[10:]) + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {1, 3} == {i for i, *_ in contained_by_hand(rows, items)}


def test_empty_tables(spark, nothing, nasty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_digest(nothing).count() == 0
    assert exact_dedup.drop_exact(nothing).count() == 0
    assert line_dedup.drop_repeated_lines(nothing).count() == 0
    assert license_scan.license_scan(nothing).count() == 0
    assert decontam.contaminated(nothing, none).count() == 0
    assert decontam.contaminated(nasty, none).count() == 0
    assert decontam.drop_contaminated(nasty, none).count() == nasty.count()
