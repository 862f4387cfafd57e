"""SimHash, HTML text, token counts, language ID, packing and quality against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from emberwatch.llm import html_text, langid, packing, quality, simhash, token_counts
from emberwatch.llm.common import components
from emberwatch.llm.queries import tokenizer_file

# SimHash


def slow_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps, linked):
    """node -> smallest node of its class, over all pairs."""
    fps = sorted(set(fps))
    label = {f: f for f in fps}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if linked(a, b) and find(a) != find(b):
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("words", [1, 3, 5])
def test_fingerprints(nasty_rows, words):
    for _, text, *_ in nasty_rows:
        if text is None or len(text) < 2000:
            assert simhash.fingerprint(text, words)[0] == slow_fingerprint(text, words)


def test_simhash_query_columns(nasty, nasty_rows):
    got = simhash.near_duplicates(nasty, words=3, max_bits=2).collect()
    fps = [(i, simhash.fingerprint(t, 3)[0]) for i, t, *_ in nasty_rows]
    classes = slow_classes([f for _, f in fps], lambda a, b: (a ^ b).bit_count() <= 2)
    smallest = defaultdict(list)
    for i, f in fps:
        smallest[classes[f]].append(i)
    low = {c: min((i for i in ids if i is not None), default=None) for c, ids in smallest.items()}
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter((i, f, low[classes[f]]) for i, f in fps)


def balls(seed, n, spread):
    """Fingerprints around few centres, so that chains and dense groups occur."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    out = []
    for _ in range(n):
        f = rnd.choice(centres)
        for _ in range(rnd.randint(0, spread)):
            f ^= 1 << rnd.randrange(64)
        out.append(f)
    return out


@pytest.mark.parametrize(("max_bits", "check", "spread", "block", "matrix"), [
    (0, None, 1, 2048, 512), (1, None, 2, 2048, 512), (2, None, 4, 2048, 512), (2, None, 3, 16, 512), (2, None, 3, 16, 2),
    (3, None, 5, 64, 2), (7, None, 9, 2048, 512), (10, None, 12, 2048, 2), (10, 14, 12, 2048, 512), (10, 14, 12, 32, 2)])
def test_pigeonring_loses_no_link(spark, monkeypatch, max_bits, check, spread, block, matrix):
    """All links by brute force join the same classes, whatever the blocks."""
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    fps = balls(max_bits, 250, spread)
    more = balls(99, 250, 6)
    rows = [tuple(int(x) for x in np.array(p, np.uint64).view(np.int64)) for p in zip(fps, more if check else [0] * 250)]
    df = spark.createDataFrame(rows, "fp long, more long")

    def linked(a, b):
        near = ((a[0] ^ b[0]) % 2**64).bit_count()
        return near <= max_bits and (check is None or near + ((a[1] ^ b[1]) % 2**64).bit_count() <= check)

    links = simhash.fingerprint_links(df, max_bits, check, block)
    got = {(r.fp, r.more): tuple(r.label) for r in components(links).select("node.*", "label").collect()}
    want = slow_classes(rows, linked)
    assert {n: got.get(n, n) for n in want} == want


def test_one_of_each_near_group_stays(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[:1500] + [f"x{i}"] + words[1500:])) for i in range(30)] + [(100, "other text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = simhash.drop_near_duplicates(docs, words=5, max_bits=10, check_bits=22)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["0", "100", "None"]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


# HTML text

ARTICLE = "<article><h1>Title {n}</h1><p>First &amp; foremost {n}<br>line&nbsp;two</p>\n<p>Every page says this.</p></article>"


def page(n, inner, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/a'>Home</a></ul></nav><div class='x{n}'>We use what we like</div>{inner}{extra}"
            f"<footer>&copy; site</footer></body></html>")


def expected(n):
    return f"Title {n}\n\nFirst & foremost {n} line two\n\nEvery page says this."


def test_article_is_kept_and_templates_go(spark):
    rows = [(n, f"http://Site.example/{n}", page(n, ARTICLE.format(n=n))) for n in range(12)]
    rows += [(50, "http://site.example/50", page(50, ARTICLE.format(n=50), "<section id='comments'><p>Nice!</p></section>"))]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == {i: expected(i) for i in [*range(12), 50]}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_pages_without_article_lose_what_the_host_repeats(spark):
    rows = [(n, f"http://h.example/{n}", f"<body><div>Follow our page</div><p>Own words of page number {n}, quite a few of them.</p>"
             "<div><p>Read more news</p></div></body>") for n in range(8)]
    rows += [(100, "http://other.example/", "<div>Follow our page</div><p>Own words</p>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Own words of page number {n}, quite a few of them." for n in range(8)} | {100: "Follow our page\n\nOwn words"}


def test_copies_of_a_page_are_no_template(spark):
    html = "<body><div>Alpha words</div><div>Beta words</div><div>Gamma words</div></body>"
    rows = [(n, "http://h.example/", html) for n in range(40)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Alpha words\n\nBeta words\n\nGamma words"} and len(got) == 40


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "http://a.example/", ""), (2, "not a url", "plain < text & more"), (3, "http://a.example/", "<p>unclosed <b>bold"),
            (3, "http://a.example/", "<p>unclosed <b>bold"), (4, "http://a.example/", "<!-- <p>no</p> --><p>a<p>b<ul><li>c<li>d</ul><script>if (a<b) x('</div>')</script>e"),
            (5, "http://a.example/", "<table><tr><td>x<td>y</table>" * 3000), (6, "http://a.example/", "<div>" * 3000 + "deep" + "</div>" * 10)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, id int")
    got = Counter((r.page_id, r.text) for r in html_text.extract(pages).collect())
    assert got == Counter({(1, ""): 1, (None, ""): 1, (2, "plain < text & more"): 1, (3, "unclosed bold"): 2, (4, "a\n\nb\n\nc\n\nd\n\ne"): 1,
                           (5, "\n\n".join(["x", "y"] * 3000)): 1, (6, "deep"): 1})
    assert html_text.extract(pages.limit(0)).count() == 0


def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_wrappers_are_no_parts_and_notices_in_articles_go(spark):
    own = "<p>Own words of page {n}, quite a few of them, and some more.</p>"
    notice = "<p>Buy our <b>paper</b> today.</p>"
    rows = [(n, "http://n.example/", f"<article>{own.format(n=n)}{notice}<ul><li>Follow us<li>Item {n}</ul></article>") for n in range(30)]
    around = ("<div class='layout has-sidebar'>{}</div>", "<section id='page-share'>{}</section>", "<form>{}</form>", "<body><div class='ad'>x</div><div class='widget'><form>{}</form></div>")
    rows += [(100 + i, "http://w.example/", a.format(f"<article>{own.format(n=i)}</article>")) for i, a in enumerate(around)]
    rows += [(200, "http://v.example/", f"<div class='layout has-sidebar'>{own.format(n=200)}</div><div class='ad'>Buy</div>"),
             (201, "http://v.example/", f"<aside><article>Teaser</article></aside><main><div class='widget'>{own.format(n=201)}</div><div class='share'>Share</div></main>"),
             (202, "http://v.example/", f"<div hidden><article>Gone</article></div>{own.format(n=202)}")]
    said = "Own words of page {}, quite a few of them, and some more."
    want = {n: f"{said.format(n)}\n\nItem {n}" for n in range(30)} | {100 + i: said.format(i) for i in range(4)}
    assert texts(spark, rows) == want | {n: said.format(n) for n in (200, 201, 202)}


def test_templates_of_a_hot_host(spark):
    """A menu on 60 of 3,000 pages (2 %) is one, as it is on a small host."""
    rows = [(n, "http://hot.example/", f"<p>Own words of page {n}, quite a few of them.</p>" + "<div>Section menu</div>" * (n < 60)) for n in range(3000)]
    assert texts(spark, rows) == {n: f"Own words of page {n}, quite a few of them." for n in range(3000)}


# Token counts


def library_counter(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram([("x▁x", 0.0), *pieces], 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids) if text else 0


def test_token_counts_equal_the_library(nasty, nasty_rows):
    pieces = token_counts.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    count = library_counter(pieces)
    got = token_counts.token_counts(nasty, tokenizer_file("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_chars) for r in got) == Counter((i, count(t), len(t or "")) for i, t, *_ in nasty_rows)


@pytest.mark.parametrize("seed", range(4))
def test_token_ties(seed):
    """Few pieces with few scores, so that many segmentations are equal."""
    rnd = random.Random(seed)
    names = {"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 5))) for _ in range(25)} | {f"<0x{b:02X}>" for b in range(256)} | {"a"}
    pieces = [(p, -float(rnd.randint(1, 3))) for p in sorted(names)]
    counter, count = token_counts.Counter(pieces), library_counter(pieces)
    for _ in range(300):
        text = "".join(rnd.choice("aaabbb é日 ▁") for _ in range(rnd.randint(0, 30)))
        assert counter.tokens(text)[0] == count(text), text


# Language ID


def slow_bits(counts, lang, data, order, least):
    met = defaultdict(int)
    for table in counts.values():
        for g, n in table.get(order, {}).items():
            met[g >> 8] += n
    total = 0.0
    for i, byte in enumerate(data):
        out = set()
        for k in range(min(order, i), -1, -1):
            context = int.from_bytes(data[i - k:i], "big")
            if k == order and met[context] < least:
                continue
            after = {b: counts[lang].get(k, {}).get(context * 256 + b, 0) for b in range(256) if b not in out}
            after = {b: n for b, n in after.items() if n}
            whole = sum(after.values()) + len(after)
            if byte in after:
                total -= math.log2(after[byte] / whole)
                break
            if after:
                total -= math.log2(len(after) / whole)
            out |= set(after)
        else:
            total += math.log2(256 - len(out))
    return total


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_code_lengths_are_exact(order):
    texts = {"a": ["the cat sat on the mat", "a cat and a hat"], "b": ["der hut und die katze", "ü ö ä der der"], "c": ["x"]}
    counts = {}
    for lang, own in texts.items():
        for t in own:
            for k, g, c in langid.gram_counts(langid.folded(t), order):
                table = counts.setdefault(lang, {}).setdefault(k, {})
                table[g] = table.get(g, 0) + c
    model = langid.freeze(counts, order)
    for text in ("the hat", "über der katze", "日本 zzz", "", "T"):
        data = langid.folded(text)
        assert np.allclose(model.code_lengths(data), [slow_bits(counts, x, data, order, 2) for x in model.langs], atol=1e-3)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(docs).join(docs, "doc_id").collect()
    assert {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_learns_only_from_allowed_rows(spark):
    rows = [(i, "qqq www", "held") for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows += [(i, "the cat sat on the mat", "en") for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"en"}


def test_language_of_odd_rows(nasty, nasty_rows, nothing):
    got = langid.identify(nasty).collect()
    assert len(got) == len(nasty_rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (3, 4, 16))
    kept = langid.keep_identified(nasty)
    assert kept.columns == nasty.columns
    assert not {3, 4, 16} & {r.doc_id for r in kept.collect()} and {1, 2, 12} <= {r.doc_id for r in kept.collect()}
    assert langid.identify(nothing).count() == 0 and langid.keep_identified(nothing).count() == 0


def test_more_languages_than_one_table_holds(spark):
    """70 languages, each in a script or vocabulary of its own; groups give what one table gives."""
    rnd = random.Random(4)
    rows = []
    for n in range(70):
        words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)]
        rows += [(100 * n + i, " ".join(rnd.choice(words) for _ in range(30)), f"l{n:02d}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r.doc_id: r for r in langid.identify(docs, table_mb=4096).collect()}
    assert all(whole[i].lang_pred == lang for i, _, lang in rows)
    parts = {r.doc_id: r for r in langid.identify(docs, table_mb=2).collect()}
    assert len(langid.train(docs, ~langid.held_out(docs.doc_id), table_mb=2).parts) > 1
    assert all(parts[i].lang_pred == r.lang_pred and abs(parts[i].score - r.score) < 1e-3 for i, r in whole.items())


# Packing


def test_encoders_agree():
    path = tokenizer_file("byte_bpe_50k.json")
    fast, library = packing.byte_bpe(path), packing.library_encoder(path)
    rnd = random.Random(3)
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "I'll don't  x\n\n  y \r\n", "naïve 日本語 \x00\x7f ", "  nbsp", "a" * 5000]
    texts += ["".join(rnd.choice("abc XYZ'é\n\t12!?—日") for _ in range(200)) for _ in range(50)]
    for text in texts:
        assert fast(text) == library(text), text


def test_packing_round_trip(nasty, nasty_rows):
    path = tokenizer_file("byte_bpe_50k.json")
    encode = packing.library_encoder(path)
    pieces = packing.pack(nasty, path).collect()
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    by_doc = defaultdict(list)
    for r in pieces:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
    want = defaultdict(list)
    for i, text, *_ in nasty_rows:
        want[i].append([*encode(text or ""), 1])
    for i, own in by_doc.items():
        tokens = Counter()
        for r in own:
            tokens[(r.start, tuple(r.ids), r.doc_tokens)] += 1
        expect = Counter()
        for ids in want[i]:
            at = 0
            for n in packing.lengths(len(ids), 2048):
                expect[(at, tuple(ids[at:at + n]), len(ids))] += 1
                at += n
        assert tokens == expect
    assert by_doc.keys() == want.keys()


def test_piece_lengths():
    for n in range(1, 300):
        got = packing.lengths(n, 64)
        assert sum(got) == n and got == sorted(got, reverse=True) and len(set(got) - {64}) == len([x for x in got if x != 64])


def test_packing_nothing(nothing):
    assert packing.pack(nothing, tokenizer_file("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, "", longest=1000)


# Quality


def test_quality_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").select("quality", "score", "keep").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() > 0.95 and bad.keep.mean() < 0.2
    order = got.score.rank()
    auc = (order[got.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.97


def test_views_teach_each_other():
    """Labels show only the text view's signal; the metadata view learns its own through pseudo-labels."""
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 900)
    text = np.stack((truth * 2.0 - 1 + rng.normal(0, 0.3, 900), np.ones(900)), axis=1)
    meta = np.stack((truth * 2.0 - 1 + rng.normal(0, 0.3, 900), np.ones(900)), axis=1)
    few = 20
    model = quality.cotrain(text[:few], meta[:few], truth[:few].astype(float), text[few:600], meta[few:600], 5, 40)
    assert ((meta[600:] @ model.meta > 0) == truth[600:]).mean() > 0.95
    assert ((model.score(text[600:], meta[600:]) > 0.5) == truth[600:]).mean() > 0.97


def test_every_unlabelled_document_may_teach(spark, monkeypatch):
    """One source has 3 of 2,600 unlabelled documents: its surest are given a label."""
    text = {0: "zzzz qqqq !!!! " * 4, 1: "good plain words of a text " * 3}
    rows = [(i, f"{text[i % 2]}{i}", "rare" if 2600 <= i < 2603 else "common", "en", 60) for i in range(2700)]
    labels = [(i, i % 2) for i in range(40)] + [(i, i % 2) for i in range(2603, 2700)]
    met = []
    taught = quality.taught

    def watched(text, meta, y, pick, *rest):
        def spy(weights, good):
            for pupil, rows, marks in pick(weights, good):
                met.append((pupil, rows))
                yield pupil, rows, marks
        return taught(text, meta, y, spy, *rest)

    monkeypatch.setattr(quality, "taught", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    assert quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), rounds=1, per_round=20) is not None
    rare = quality.meta_features("rare", "en", 60)[:quality.SOURCES] > 0
    assert any(pupil == "meta" and (rows[:, :quality.SOURCES][:, rare] > 0).any() for pupil, rows in met)


def test_quality_of_odd_rows(spark, nasty, nasty_rows, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 1), (10, 0), (None, 1), (12, None), (14, 0)], "doc_id long, quality int")
    got = quality.classify(nasty, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in nasty_rows)
    assert all(0 <= r.score <= 1 for r in got)
    one_kind = quality.classify(nasty, labels.where("quality = 1")).collect()
    assert {r.score for r in one_kind} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_buckets_are_files_of_one_length(spark, nasty, tmp_path):
    pieces = packing.pack(nasty, tokenizer_file("byte_bpe_50k.json"))
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    got = spark.read.parquet(f"{tmp_path}/buckets")
    assert got.count() == pieces.count() and got.where("size(ids) <> length").count() == 0
