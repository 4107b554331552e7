"""Every operator against a brute-force version on small tables with nulls, blanks, ties, repeats and odd columns."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from esquina.llm import ann, batches, bpe, html_tree, language, lines, neardup, packing, quality, sketch, substrings, vocab, wavelet
from esquina.llm.ship import ship

# The last columns bear names that operators might use inside.
DOCS = "doc_id long, text string, source string, lang string, row string, m string, size int, key int, comp long, rank int"


def words_of(text):
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [None, "", " \n\t ", "one", "one", "two words", "A a A a A a", passage, passage]
    base = rng.choices(vocabulary, k=120)
    for _ in range(12):  # a chain of near copies
        texts.append(" ".join(base))
        base = base[:]
        base[rng.randrange(120)] = rng.choice(vocabulary)
    for i in range(16):
        own = " ".join(rng.choices(vocabulary, k=90))
        texts.append(f"{own}\nall rights are reserved here\n{passage if i % 4 == 0 else own[:40]} ñandú 北京 {i}")
    texts.append(" ".join(rng.choices(vocabulary, k=9000)))
    return [(i * 20, t, f"site{i % 13}", "en") for i, t in enumerate(texts)]


def table(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, "r", "m", 1, 2, 3, 4) for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def similar(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


def brute_components(rows, n):
    sets = {}
    for d, t, *_ in rows:
        ws = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and comp[a] != comp[b] and similar(sets[a], sets[b], 80):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {d: (len(sets[d]), comp[d], d == comp[d]) for d in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, empty, rows, n):
    got = neardup.near_duplicates(docs, words=n).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(rows, n)
    assert neardup.near_duplicates(empty, words=n).count() == 0


def test_keep_one_keeps_columns_and_lone_rows(spark, docs, rows):
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, (_, _, k) in brute_components(rows, 5).items() if k}
    assert {r.doc_id for r in kept.collect()} == want
    lone = table(spark, [(None, "a b c d e f", "s", "en"), (None, "a b c d e f", "s", "en"), (3, None, "s", "en")])
    assert neardup.keep_one(lone).count() == 3


def brute_repeats(rows, window=35):
    split = [words_of(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in split for i in range(len(ws) - window + 1))
    out = []
    for (d, *_), ws in zip(rows, split):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((d, len(ws), len(gone), kept))
    return out


def test_substring_dedup(docs, empty, rows):
    found = substrings.without_repeats(docs).select("row.doc_id", "n_words", "n_removed", "text").collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, words_of(r.text or "")) for r in found)
    assert got == brute_repeats(rows)
    cut = substrings.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert substrings.remove_repeats(empty).count() == 0


def test_byte_bpe_round_trip(docs, empty, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d, t, *_ in rows:
        ids = exact.encode_ordinary(t or "")
        want[d] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
    for small in ({}, {"chunk": 300, "overlap": 20}):  # small chunks must stitch to the same ids
        got = bpe.digests(docs, path, public_tokenizers.PATTERN, **small).collect()
        assert len(got) == len(rows) and {r[0]: tuple(r[1:4]) for r in got} == want
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0


def encoded(rows, name, end):
    exact = Tokenizer.from_file(public_tokenizers.path(name))
    return {d: exact.encode(t or "", add_special_tokens=False).ids + [end] for d, t, *_ in rows}


SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "<|startoftext|> a  b\n\nc<|endoftext|>", "mark \x01 in\x01 a text", " a  b\n\n c\td\u00a0 e", "x\n", " "]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_ids_of_the_library(name, spaced, rows, monkeypatch):
    monkeypatch.setattr(vocab, "HELD_BYTES", 4000)  # so that generations change
    coder = vocab.UnitIds(public_tokenizers.path(name), spaced)
    texts = [t for _, t, *_ in rows] + SPECIAL + ["Wörter, und.Zeichen!\nZeile|zwei"] * 3
    want = list(encoded([(i, t) for i, t in enumerate(texts)], name, 0).values())
    for _ in range(3):
        for step in (1, 7, len(texts)):
            for k in range(0, len(texts), step):
                ids, at = coder.encode(pa.array(texts[k : k + step], pa.string()))
                assert [[*ids[i:j].tolist(), 0] for i, j in zip(at[:-1], at[1:])] == want[k : k + step]
    assert coder.held.young[0].nbytes < 40_000
    assert coder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, empty, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = {}
    for d, ids in encoded(rows, "word_bpe_49k.json", 1).items():
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[d, piece] = (start, len(part), crc(part))
    got = packing.pack_documents(docs, path, spaced=False).collect()
    assert len(got) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1
    assert packing.pack_documents(empty, path, spaced=False).count() == 0


def test_wavelet_files(spark, docs, rows, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    wavelet.write_shards(docs, f"{tmp_path}/w", path)
    shards = wavelet.read_shards(spark, f"{tmp_path}/w")
    ids = encoded(rows, "byte_bpe_50k.json", 2)
    want, at = {}, 0
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), crc(ids[d]))
        at += len(ids[d])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.document_rows(shards).collect()} == want
    flat = [i for d in sorted(ids) for i in ids[d]]
    places = sorted(r[-1] for r in wavelet.occurrences(shards, 2).collect())
    assert places == [i for i, x in enumerate(flat) if x == 2]


def test_quality_rules(docs, empty, rows):
    got = {r.doc_id: r for r in quality.verdicts(quality.ledger(docs)).collect()}
    for d, t, *_ in rows:
        ws = words_of(t or "")
        threes = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {i + k for i, x in enumerate(zip(ws, ws[1:], ws[2:])) if threes[x] > 1 for k in range(3)}
        full = [x for x in (t or "").split("\n") if words_of(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(covered))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>") and r.n_dup_lines == len(full) - len(set(full))
        assert r.base_failed == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws)) and not (r.base_failed and r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert quality.keep_good(empty).count() == 0
    assert {r.n_failed for r in quality.ablations(quality.ledger(empty)).collect()} == {0}


def test_line_dedup(docs, empty, rows):
    sites = defaultdict(set)
    for _, t, site, _ in rows:
        for x in (t or "").split("\n"):
            if len(words_of(x)) >= lines.MIN_WORDS:
                sites[x.strip(lines.EDGES)].add(site)
    common = {x for x, s in sites.items() if len(s) >= lines.MIN_SITES}
    assert common == {"all rights are reserved here"}
    got = {r.doc_id: r.text for r in lines.remove_common_lines(docs).collect()}
    for d, t, *_ in rows:
        want = t if t is None else "\n".join(x for x in t.split("\n") if x.strip(lines.EDGES) not in common)
        assert got[d] == want
    assert lines.remove_common_lines(empty).count() == 0


def test_nearest_neighbours(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1500, 16))
    points[7] = points[0]  # a tie at distance zero
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [None] + [1.0] * 15)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100)) and all(len(x) == 10 for x in got.values())
    hits = 0
    for q, found in got.items():
        exact = np.sqrt(((points - points[q]) ** 2).sum(1))
        assert all(abs(score - exact[v]) < 1e-12 for v, score in found)
        order = sorted((exact[v], v) for v in range(1500) if v != q)[:10]
        hits += len({v for _, v in order} & {v for v, _ in found})
    assert got[0][0] == (7, 0.0) and hits >= 0.9 * 150
    assert ann.search(vectors.filter("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_neighbours_reach_the_recall_where_leaves_are_left_out(spark, monkeypatch, clustered):
    ship(spark)
    monkeypatch.setattr(ann, "LEAST_CANDIDATES", 100)
    walks = []
    measured = ann.measured_walk
    monkeypatch.setattr(ann, "measured_walk", lambda *a: walks.append(measured(*a)) or walks[-1])
    rng = np.random.default_rng(5)
    points = rng.normal(size=(6000, 24))
    if clustered:
        points = 0.1 * points + 3 * rng.normal(size=(60, 24))[rng.integers(60, size=6000)]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in ann.search(vectors, F.col("vec_id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        far = ((points - points[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(found[q] & set(np.argsort(far)[:10].tolist()))
    assert 0.9 * 600 <= hits
    # A vector counts once for each tree here.
    assert walks[0] < (0.5 if clustered else ann.TREES) * 6000


def test_html_and_language(spark):
    ship(spark)
    body = "<p>The river rises in the hills &amp; flows   to the sea.</p><p>It is long.</p>"
    page = (
        "<html lang='en'><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav>"
        f"<article><h1>River</h1>{body}</article><script>var x = 1;</script><footer>Copyright</footer></body></html>"
    )
    rows = [(1, "https://a.example.de/x", page), (2, None, None), (3, "not a url", ""), (3, "not a url", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_tree.extract(pages, html_tree.train(pages)).collect()
    texts = [r.text for r in sorted(got, key=lambda r: r.page_id)]
    assert texts == ["River\nThe river rises in the hills & flows to the sea.\nIt is long.", "", "", ""]
    assert [r.n_chars for r in sorted(got, key=lambda r: r.page_id)] == [len(t) for t in texts]
    train = [(i, "the river and the hill", "s", "en") for i in range(5)] + [(9 + i, "der Fluss und das Tal", "s", "de") for i in range(5)]
    model = language.train(table(spark, train))
    said = language.identify(pages.withColumn("text", F.lit("the hill and the river")), model).collect()
    assert len(said) == 4 and all(r.lang == "en" for r in said)


def test_pipeline(spark, docs, rows, tmp_path):
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    keeps = {r.doc_id for r in quality.keep_good(docs).collect()}
    left = [r for r in rows if r[0] in keeps]
    left = [(d, "\n".join(x for x in t.split("\n") if x != "all rights are reserved here"), s, g) for d, t, s, g in left]
    ones = {d for d, (_, _, k) in brute_components(left, 5).items() if k}
    left = [r for r in left if r[0] in ones]
    removed = {d: (n, gone) for d, n, gone, _ in brute_repeats(left)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ones and ones
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    untouched = {d: len(ids) for d, ids in encoded(left, "word_bpe_49k.json", 1).items() if removed[d][1] == 0}
    assert untouched and all(total[d] == n for d, n in untouched.items())


def test_near_duplicates_around_one_text(spark, monkeypatch):
    """Copies of one text at every distance, so that some are as alike to it as 0.8 and others just are not."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=100)
    few = rng.choices(vocabulary, k=3)  # edits that several copies share
    rows = []
    for i in range(150):
        words = base[:]
        for at in rng.sample(range(100), i % 15):
            words[at] = rng.choice(few if i % 2 else vocabulary)
        rows.append((i, " ".join(words), "s", "en"))
    steps = []
    centred = neardup.around_centres
    monkeypatch.setattr(neardup, "around_centres", lambda *a: steps.append(1) or centred(*a))
    got = neardup.near_duplicates(table(spark, rows), words=2).collect()
    want = brute_components(rows, 2)
    assert steps and len({c for _, c, _ in want.values()}) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_word_hashes(monkeypatch):
    rng = random.Random(11)
    for cut in (sketch._SLICE, 5, 40):
        monkeypatch.setattr(sketch, "_SLICE", cut)
        for _ in range(100):
            text = bytes(rng.choice(b" \t\n\x0b\x0c\r\x00\x1fab\xc2\xa0") for _ in range(rng.randrange(90)))
            words, hashes = text.split(), sketch.word_hashes(text).tolist()
            assert len(words) == len(hashes)
            assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    assert len(sketch.word_hashes(None)) == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=100)) for _ in range(3))
    rows = [(1, a, "s", "en"), (1, b, "s", "en"), (2, b + " more", "s", "en"), (3, a + " more", "s", "en"), (4, c, "s", "en"), (7, c, "s", "en"), (7, b, "s", "en"), (9, "alone here", "s", "en"), (1, a, "s", "en")]
    found = neardup.near_duplicates(table(spark, rows), words=2)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (7, 1), (7, 1), (9, 9)]
    renamed = table(spark, rows).withColumnRenamed("doc_id", "my id").withColumnRenamed("text", "my text")
    assert sorted(r["my id"] for r in neardup.keep_one(renamed, words=2, id_col="my id", text_col="my text").collect()) == [1, 1, 1, 9]


@pytest.mark.parametrize("html", ["<p>x</p><![foo[ y ]]><p>z</p>", "<![", "<![CDATA[a]]>", "<!", "</", "<", "&#xffffffff;", "<a" * 50, "<p>" + "<![if x]>" * 9, "</p></p>", "<!--", "<script>", "<p a='"])
def test_any_markup_is_read(html):
    page = html_tree.Page(html)
    assert len(page.tags) == len(page.parents)


def test_deep_nesting_with_stray_ends_is_read_in_proportion():
    def seconds(n):
        begin = time.process_time()
        html_tree.Page("<div>" * n + "</span>" * n)
        return time.process_time() - begin

    seconds(1000)
    assert seconds(16_000) < 12 * max(seconds(4000), 0.01)


def test_pure_boilerplate_goes_unless_copies_are_spared(spark):
    line = "all rights are reserved on this site"
    rows = [(i, line if i < 12 else f"{line}\nown words of text {i} here\n{line}", f"site{i}", "en") for i in range(14)] + [(20, line, None, "en"), (0, line, "site0", "en")]
    found = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_common_lines(table(spark, rows)).collect()}
    assert found[0] == ("", 1) and found[20] == ("", 1) and found[13] == ("own words of text 13 here", 2)
    spared = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_common_lines(table(spark, rows), spare_copies=True).collect()}
    assert spared[0] == (line, 0) and spared[13][1] == 0


@pytest.mark.parametrize("sites", [8, 9, 10, 11, 13])
def test_lines_near_the_threshold_are_counted_exactly(spark, sites):
    rows = [(i, "one line of five words", f"s{i % sites}", "en") for i in range(40)]
    gone = {r.n_removed for r in lines.remove_common_lines(table(spark, rows)).collect()}
    assert gone == {int(sites >= lines.MIN_SITES)}


def test_windows_of_crowded_runs_are_made_once(spark):
    words = [b" ".join(b"w%d" % w for w in range(i, i + 40)) for i in (0, 3, 90)]
    rows = [(i, 0, 1, 5, 1, 6, w) for i, w in enumerate(words)]
    regions = spark.createDataFrame(rows, "doc_id long, row_key long, run long, start int, places long, windows int, words binary")
    marked = substrings.counted_windows(regions, 35)
    assert "MapInArrow" not in marked._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.start, r.mask) for r in marked.collect()} == {(0, 5, 0b111000), (1, 5, 0b111)}


def test_sketches_and_sets_are_made_in_small_batches():
    class Handed:
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": [b"a b c d e f %d" % i for i in range(2500)]})
            return list(run(iter([batch])))

    made = neardup.shingle_sets(Handed(), 5)
    assert [b.num_rows for b in made] == [1000, 1000, 500]
    assert [i for b in made for i in b.column("doc_id").to_pylist()] == list(range(2500))


def test_each_slice_meets_the_known_units_once(monkeypatch):
    monkeypatch.setattr(vocab, "HELD_BYTES", 2000)  # so that units come from both generations and anew
    coder = vocab.UnitIds(public_tokenizers.path("word_bpe_49k.json"), False)
    asked, get = [], coder.held.get
    monkeypatch.setattr(coder.held, "get", lambda units: asked.append(len(units)) or get(units))
    texts = [" ".join(f"w{j * j % 97}x" for j in range(k, k + 30)) for k in range(0, 200, 10)]
    for n, text in enumerate(texts, 1):
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(asked) == n


def test_places_of_units():
    known = pa.array(["b", "a", "", "c"])
    assert vocab.places(pa.array(["c", "x", "b", ""]), known).tolist() == [3, -1, 0, 2]
    assert vocab.places(pa.array([], pa.string()), known).tolist() == []
    assert vocab.places(pa.array(["a"]), pa.array([], pa.string())).tolist() == [-1]


def test_tasks_of_another_kind_drop_what_tokenizing_kept():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = vocab.unit_ids(path, False)
    assert vocab.unit_ids(path, False) is coder
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [b"a b c"]})
    assert [b.num_rows for b in batches.small(iter([batch]))] == [1]
    assert not batches.KEPT
