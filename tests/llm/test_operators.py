"""Each corpus operator against a brute-force version on small tables, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from docquery.llm import (collision_search, decontam, language, line_dedup, pieces, quality, shingles, simhash,
                          suffix_dedup, token_files, toxicity)
from docquery.llm.components import components

WORDS = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, line string, key string, score double, fingerprint string, pos int"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, an id with two texts, a long text, columns of clashing names."""
    share = "A shared line of some length, which several documents hold.\n" * 3
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, share + "own words here"), (4, share + "own words here"),
            (4, "another text under the same id"), (None, share), (None, None), (5, "x" * 200_000), (6, share),
            (7, "né́ 漢字 \U0001F600 ▁ <s> \0"), (8, "12345 !!!"), (9, "word " * 30_000)]
    return spark.createDataFrame([(i, t, "en", "l", "k", 0.5, "f", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_simhash_brute(docs, texts):
    from xxhash import xxh64_intdigest

    def fp(text):
        words = text.encode().lower().split()
        hashes = [xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    fps = [fp(t) for _, t in texts]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(docs, words=3).collect()}
    assert got == {d: (fps[i], texts[find(i)][0]) for i, (d, _) in enumerate(texts)}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_near_links_reach_all_pairs(spark, radius):
    rng = random.Random(radius)
    fps = set()
    while len(fps) < 300:
        x = rng.getrandbits(64)
        for _ in range(5):
            fps.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius)
    got = {r.node: r.root for r in components(links).collect()}
    root = {f: f for f in fps}
    changed = True
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {f: got.get(f, f) for f in fps} == root


def test_components_of_a_chain(spark):
    links = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert {(r.node, r.root) for r in components(links).collect()} == {(k, 0) for k in range(61)}


def test_suffix_brute(spark, texts):
    rng = random.Random(5)
    rows = texts[:60] + [(1000 + k, "ab" * rng.randint(40, 90)) for k in range(4)] + [
        (2000 + k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for k in range(20)] + [
        (3000 + k, texts[k][1][50:400] + "edit" + texts[k + 1][1][-300:]) for k in range(20)]
    seen, want = set(), {}
    for doc, text in sorted(rows):
        data = text.encode()
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                covered[i:i + 100] = True
            seen.add(data[i:i + 100])
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        runs = int((covered & ~np.append(False, covered[:-1])[:len(covered)]).sum())
        want[doc] = (len(data), int(covered.sum()), runs, sha(kept))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(frame, 100, suffix_dedup.DIGESTS, suffix_dedup.digests).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    got = language.identify(docs.where(~fold), language.fit(docs, fold), ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert sum(r.rejected for r in got) / len(got) < 0.01
    assert all(0 <= r.score <= 1 for r in got)


def test_language_rejects_what_is_far(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, F.lit(True))
    assert model.predict(None) == ("und", 0.0, True) and model.predict(b"123 !?")[0] == "und"
    noise = " ".join("".join(random.Random(k).choices("qxzjkwvyp", k=7)) for k in range(400))
    assert model.predict(noise.encode())[2]


@pytest.mark.parametrize("make, label, modulus, held, least", [
    (quality, "quality", 3, 1, 0.95), (toxicity, "toxic", 5, 0, 0.95)])
def test_classifiers_held_out(spark, make, label, modulus, held, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held
    model = make.fit(docs, labels, fold)
    asked = docs.join(labels.where(~fold), "doc_id")
    score = quality.score_quality if make is quality else toxicity.score_toxicity
    got = score(asked, model, ["doc_id", label]).collect()
    assert sum(r[label] == r.predicted for r in got) / len(got) > least
    assert all(0 <= r.score <= 1 for r in got)


def test_lines_brute(docs, texts):
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for doc, text in texts:
        for line in text.split("\n"):
            if len(strip(line)) >= 10:
                holders.setdefault(strip(line), set()).add(doc)
    want = {}
    for doc, text in texts:
        lines = text.split("\n")
        kept = [x for x in lines if len(holders.get(strip(x), ())) < 2 or min(holders[strip(x)]) == doc]
        want[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    got = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == want


@pytest.mark.parametrize("bits", [1, 3, 11, 15, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()


def test_token_files_brute(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    manifest = token_files.write_token_files(docs, WORDS, end_id=1)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.read_token_files(manifest).collect()}
    start = 0
    for doc, text in texts:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert got[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    reader = token_files.ShardReader(manifest.orderBy("first_id").first().path)
    row = len(reader.table) // 2
    text = dict(texts)[int(reader.table[row, 0])]
    assert reader.document(row).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_word_pieces_equal_the_library():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(WORDS), token_files.word_encoder(WORDS, 16)
    rng = random.Random(1)
    parts = [*"abÉß  \n\t'sΣİ́　<|", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "'LL", "12", "A", "K"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_equal_the_library(texts):
    import sentencepiece

    library, encoder, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceEncoder(MODEL), random.Random(2)
    parts = [*"ab  ▁\n\té漢😀́\0", "<s>", "</s>", "the", "<0x41>", " "]
    odd = ["", " ", "  ", "a ", " a", "▁"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for text in odd + [t for _, t in texts[:50]]:
        data = text.encode()
        ids, begins, ends = encoder.encode(data)
        assert ids.tolist() == library.encode(text), text
        assert encoder.decode(ids).decode() == library.decode(ids.tolist()), text
        if len(ids):
            assert begins[0] == 0 and ends[-1] == len(data) and (begins[1:] <= ends[:-1]).all()


@pytest.mark.parametrize("length, chunks, texts", [(10, 240_000, 30), (20_000, 500, 50)])  # many chunks, long ones
def test_chunk_store_is_bounded_in_bytes(length, chunks, texts):
    import sys

    import sentencepiece

    library, encoder, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceEncoder(MODEL), random.Random(3)
    each, largest = chunks // texts, 0
    for k in range(texts):
        text = " ".join(["the", *("".join(rng.choices("abcdefghij", k=length)) for _ in range(each)), "the"])
        ids = encoder.encode(text.encode())[0]
        if k % 10 == 0:
            assert ids.tolist() == library.encode(text)
        store = encoder.store
        largest = max(largest, sys.getsizeof(store) + sum(sys.getsizeof(c) + sys.getsizeof(i) for c, i in store.items()))
    assert 1 << 20 < largest < 20 << 20


def test_character_map_takes_the_longest_source():
    # two sources, "a" -> "x" and "ab" -> "yz", laid out as a double array by hand
    units = [0] * 1024
    put = lambda at, label, offset, leaf: units.__setitem__(at, label | leaf << 8 | offset << 10)
    root = 256
    units[0] = root << 10
    put(root ^ 97, 97, (root ^ 97) ^ 512, 1)
    units[512] = 0x80000000 | 0
    put(512 ^ 98, 98, (512 ^ 98) ^ 768, 1)
    units[768] = 0x80000000 | 2
    blob = np.array([4 * len(units)], "<u4").tobytes() + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    table = pieces.CharacterMap(blob)
    assert table.longest(b"abc", 0) == (2, b"yz") and table.longest(b"ac", 0) == (1, b"x")
    assert table.longest(b"b", 0) is None


def test_search_recall_and_order(spark, sf):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.collect()
    v = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in collision_search.nearest(vectors, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[k]
        scores[k] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        found = got[ids[k]]
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 20
        hits += len({x for x, _ in found} & set(best.tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]),
            (5, [inf, 1.0]), (6, [0.5, 0.5]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in collision_search.nearest(frame, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 6, 0.5), (0, 3, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 6, 1.0), (20, 3, 7, 1.0)]
    assert collision_search.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_decontamination_within_budget(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, words(rng.randint(20, 60))) for k in range(20)] + [(50, "tiny one"), (51, ""), (52, None)]
    rows = []
    for k in range(60):
        text = list(items[k % 20][1])
        for _ in range(decontam.edit_budget(len(decontam.normalise("".join(text).encode()))) * (k % 3) // 2):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((k, words(80) + " " + "".join(text).upper() + ".\n" + words(40)))
    rows += [(100, words(300)), (101, "a Tiny  ONE!"), (102, "tiny ones")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 22, 400):
        found = {(r.doc_id, r.item_id) for r in decontam.contaminated(
            spark.createDataFrame(rows, "doc_id long, text string"), bench, size).collect()}
        assert found == {(k, k % 20) for k in range(60)} | {(101, 50)}
        odd = spark.createDataFrame(rows + [(5, "clean"), (5, "clean"), (None, "a tiny one"), (None, None), (7, "")], "doc_id long, text string")
        kept = decontam.drop_contaminated(odd.withColumn("__text", F.lit(1)), bench, size)
        assert kept.columns == ["doc_id", "text", "__text"]
        assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text is not None and r.doc_id not in (100, 102)) == [
            ("5", "clean"), ("5", "clean"), ("7", "")]
        assert kept.count() == 6


def test_odd_rows(odd, spark):
    count = odd.count()
    groups = simhash.near_groups(odd).collect()
    assert len(groups) == count
    assert {r.component_id for r in groups if r.fp == 0} == {1}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    lines = line_dedup.dedup_lines(odd)
    assert lines.count() == count
    shared = {r.doc_id: r.n_dropped for r in lines.where("doc_id IN (4, 6)").collect()}
    assert shared[6] == 3
    spans = suffix_dedup.repeated_spans(odd)
    assert spans.count() == count
    same = [len(r.spans) for r in spans.collect() if r.doc_id == 4]
    assert len(same) == 3
    manifest = token_files.write_token_files(odd, WORDS)
    assert token_files.read_token_files(manifest).count() == count
    assert pieces.encode_pieces(odd, MODEL, pieces.DIGESTS, pieces.digests).count() == count
    model = language.fit(odd, F.lit(True))
    found = language.identify(odd, model, ["doc_id"]).collect()
    assert len(found) == count and all(r.lang_pred in ("en", "und") for r in found)
    assert language.keep_identified(odd, model).columns == odd.columns
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (9, 0, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd, quality.fit(odd, labels, F.lit(True)), ["doc_id"]).count() == count
    assert toxicity.score_toxicity(odd, toxicity.fit(odd, labels, F.lit(True)), ["doc_id"]).count() == count
    bench = spark.createDataFrame([(1, "own words here and more than this")], "item_id long, text string")
    assert decontam.drop_contaminated(odd, bench).count() == count


def test_empty_tables(nothing, spark):
    assert simhash.near_groups(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0
    assert line_dedup.dedup_lines(nothing).count() == 0 and suffix_dedup.repeated_spans(nothing).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(nothing, WORDS)).count() == 0
    assert pieces.encode_pieces(nothing, MODEL).count() == 0
    assert language.identify(nothing, language.fit(nothing, F.lit(True)), ["doc_id"]).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(nothing, quality.fit(nothing, labels, F.lit(True)), ["doc_id"]).count() == 0
    assert toxicity.score_toxicity(nothing, toxicity.fit(nothing, labels, F.lit(True)), ["doc_id"]).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(nothing, bench).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "pieces"]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and 0 < out.count() <= docs.count()
    kept = corpus_pipeline.dedup_lines(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count()


@pytest.mark.parametrize("doc_id", [None, 7])
def test_suffix_many_texts_under_one_id(spark, doc_id):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = noise(120)
    rows = [(doc_id, "A" + noise(rng.randint(0, 50)) + "-" + shared + "." + noise(rng.randint(0, 300))) for _ in range(600)]
    rows = [(i, t.replace("-", f"<{k}>").replace(".", f"[{k}]")) for k, (i, t) in enumerate(rows)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5),
                                      100, suffix_dedup.DIGESTS, suffix_dedup.digests).collect()
    # only the first text keeps the shared string; neighbouring bytes equal by chance go with it
    assert sorted(r.n_spans for r in got) == [0] + [1] * 599
    removed = sorted(r.n_removed for r in got)
    assert removed[0] == 0 and removed[1] == 122 and removed[-1] <= 128


@pytest.mark.parametrize("parts", [1, 4])
def test_suffix_fully_repeated_rows(spark, parts):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    alone, twice, inner = noise(300), noise(150), noise(130)
    # the row with id 1 stands four times; its text repeats a string of its own, and a later row repeats its end
    again = "<" + inner + ">" + twice + "(" + inner + ")"
    rows = [(1, again)] * 4 + [(2, alone)] * 3 + [(None, "n" + noise(200))] * 2 + [(3, "own words " + twice)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {}
    for r in suffix_dedup.repeated_spans(frame).collect():
        got.setdefault(r.doc_id, []).append([(s.first, s.end) for s in r.spans])
    second = len(inner) + 2 + len(twice) + 1
    assert got == {1: [[(second, second + len(inner))]] * 4, 2: [[]] * 3, None: [[]] * 2, 3: [[(10, 10 + len(twice))]]}


def test_suffix_repeated_row_of_the_odd_table(odd):
    spans = [(r.text, [tuple(s) for s in r.spans]) for r in suffix_dedup.repeated_spans(odd).collect() if r.doc_id == 4]
    # rows without doc_id come first, so the shared lines repeat; the words of the row itself do not
    text = next(t for t, _ in spans if t.startswith(b"A shared"))
    cut = len(text) - len(b"own words here")
    assert sorted(s for t, s in spans if t == text) == [[(0, cut)]] * 2


def test_keep_first_tells_groups_of_one_id_apart(odd, spark):
    kept = sorted((str(r.doc_id), (r.text or "")[:7]) for r in simhash.keep_first(odd).collect())
    # id 4 has two texts in two groups: both stay, and so does one row of every other group
    assert [t for i, t in kept if i == "4"] == ["A share", "another"]
    assert len(kept) == len({r.root for r in simhash.near_groups(odd).collect()})
    rng = random.Random(3)
    rows = [(7, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for _ in range(30)]
    rows += [(100 + k, t) for k, (_, t) in enumerate(rows)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(rows[:30])


def test_similar_brute(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for k in range(40):
        text = [word() for _ in range(rng.choice([3, 30, 120, 400]))]
        rows.append(text)
        for _ in range(3):  # copies of the copy before, 0 to 6 % of the words replaced
            text = [word() if rng.random() < rng.choice([0, 0.01, 0.02, 0.04, 0.06]) else w for w in text]
            rows.append(text)
    rows = [(k, " ".join(t)) for k, t in enumerate(rows)] + [(500, None), (501, " \n"), (0, "one id, another text"), (None, "no id")]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (((t or "").split()) for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    low = 0
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or 10 * both >= 8 * either:
                low += bool(either) and both < 0.9 * either
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert low > 10
    want = sorted(rows[k][1] or "" for k in {find(k) for k in range(len(rows))})
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:9]], "doc_id long, text string, n int").repartition(5)
    kept = shingles.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == want
    import corpus_pipeline
    assert sorted(r.text or "" for r in corpus_pipeline.dedup_near(spark, docs, "").collect()) == want


def test_similar_texts_meet_in_balls(spark, monkeypatch):
    """The stage looks for partners in the balls of its fingerprints, and links only texts that are alike."""
    import corpus_pipeline

    fp = simhash.fingerprint(b"a few words that name a place", 5)
    rows = [(1, 10, fp), (2, 10, fp), (3, 11, fp ^ 7), (4, 10, fp ^ (7 << 20)), (5, 10, ~fp)]
    met = {tuple(sorted((r.node, r.other.node))) for r in shingles.ball_pairs(
        spark.createDataFrame(rows, "node long, size int, fp long")).collect()}
    assert met == {(1, 2), (1, 3), (1, 4)}

    found = []
    links = shingles.near_links
    monkeypatch.setattr(shingles, "near_links", lambda *a: found.append(links(*a)) or found[-1])
    base = [f"w{k}" for k in range(2000)]
    texts = [" ".join(base), " ".join(base[:1500] + ["other"] + base[1501:]), " ".join(base[::-1])]
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert 0 < ((fps[0] ^ fps[1]) & (1 << 64) - 1).bit_count() <= 3
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert [{r.a, r.b} for r in found[0].collect()] == [set(fps[:2])]


def test_similar_odd_and_empty(odd, nothing):
    kept = [(r.doc_id, r.text) for r in shingles.keep_first(odd).collect()]
    assert (1, None) in kept and (4, "another text under the same id") in kept
    assert len(kept) == len({t for _, t in kept}) and shingles.keep_first(nothing).count() == 0


def test_decontamination_of_reworded_and_partial_items(spark):
    rng = random.Random(12)
    noise = lambda low, high: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))
    words = lambda n: [noise(3, 9) for _ in range(n)]
    items, rows = [(k, words(rng.randint(30, 60))) for k in range(20)], []
    for k, item in items:
        low = rng.randrange(len(item) - 15)
        reworded = list(item)
        for at in rng.sample(range(len(item)), round(0.08 * len(item))):
            reworded[at] = noise(3, 9)
        rows += [(k, words(50) + reworded + words(50)),  # 8 % of the words replaced
                 (100 + k, words(50) + item[low:low + 15] + words(50)),  # 15 words quoted
                 (200 + k, words(50) + item[low:low + 6] + words(50)), (300 + k, words(150))]
    table = lambda rows, name: spark.createDataFrame([(k, " ".join(t)) for k, t in rows], f"{name} long, text string")
    found = decontam.contaminated(table(rows, "doc_id"), table(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k + more, k) for k in range(20) for more in (0, 100)}
    assert all(r.edits == 0 for r in found if r.doc_id >= 100)
    kept = decontam.drop_contaminated(table(rows, "doc_id"), table(items, "item_id"))
    assert {r.doc_id for r in kept.collect()} == {k + more for k in range(20) for more in (200, 300)}


def test_align_brute():
    rng = random.Random(13)
    for _ in range(200):
        item, region = (bytes(rng.choice(b"abc") for _ in range(rng.randint(low, 25))) for low in (1, 1))
        row = [(0, j) for j in range(len(region) + 1)]  # cost and start for each end
        for i, byte in enumerate(item):
            new = [(i + 1, 0)]
            for j, other in enumerate(region):
                new.append(min((row[j][0] + (byte != other), row[j][1]), (row[j + 1][0] + 1, row[j + 1][1]), (new[j][0] + 1, new[j][1])))
            row = new
        least = min(c for c, _ in row)
        got = decontam.align(item, region, 25)
        assert got[0] == least and row[got[2]][0] == least
        part = region[got[1]:got[2]]
        assert (list(decontam.distances(item, part, True)) or [len(item)])[-1] == least


def test_lines_outside_ansi_mode(docs, spark):
    want = sorted(map(tuple, line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped").collect()))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert sorted(map(tuple, line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped").collect())) == want
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_samples_are_bounded_under_a_hot_id(spark):
    from docquery.llm.sampling import bounded, labelled

    rows = [(7, "one text many times", "en")] * 3000 + [(8, f"text {k} of one id", "en") for k in range(500)] + [
        (k, f"text {k}", "en" if k % 2 else "de") for k in range(100, 400)] + [(None, "no id", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    for n in (1, 20, 700, 5000):
        got = bounded(frame, n).collect()
        assert len(got) == min(n, 801) and len(set(got)) == len(got)
        assert sorted(bounded(frame.repartition(3), n).collect()) == sorted(got)
        by = bounded(frame, n, "lang").collect()
        assert len(by) == min(n, 651) + min(n, 150)
    labels = spark.createDataFrame([(k, k % 2) for k in [*range(100, 400), 7, 7, 7, 8]], "doc_id long, toxic int")
    got = labelled(frame, labels, "toxic", F.lit(True), 50).collect()
    assert len(got) == 50 and all(r.label == r.doc_id % 2 for r in got)
    assert labelled(frame, labels.where("false"), "toxic", F.lit(True), 50).collect() == []


def test_operators_leave_the_session_as_it_is(docs, spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    simhash.fingerprints(docs).count()
    assert spark.conf.get(name) == before


def test_decontamination_equals_full_alignment(spark):
    """Every item, and every window of one, is aligned with every whole text."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(words(rng.randint(8, 30))).encode() for _ in range(12)]
    texts = []
    for k in range(80):
        part = items[k % 12].split()
        low = rng.randrange(len(part))
        part = [w if rng.random() > 0.05 * (k % 5) else rng.choice(vocabulary).encode() for w in part[low // 2:]]
        texts.append(b" ".join([*(w.encode() for w in words(rng.randint(0, 40))), *part, *(w.encode() for w in words(rng.randint(0, 40)))]))
    held = decontam.Items(list(enumerate(items)))

    def by_hand(text):
        found = set()
        for k, item in enumerate(items):
            begins, ends, budgets, _ = decontam.windows(item)
            asked = [(item, decontam.edit_budget(len(item)))] + [(item[b:e], int(n)) for b, e, n in zip(begins, ends, budgets)]
            if any(min(decontam.distances(part, text), default=len(part)) <= budget for part, budget in asked):
                found.add(k)
        return found

    want = [by_hand(t) for t in texts]
    assert 20 < sum(map(bool, want)) < 80
    assert [{h[0] for h in f} for f in held.found_in(texts)] == want  # looked up together
    assert [{h[0] for h in held.found(t)} for t in texts] == want


def test_suffix_is_not_fooled_by_patterned_texts(spark):
    """Two texts without a common 100-byte string whose polynomial hashes modulo 2^64 are equal."""
    rng = random.Random(5)
    gram = "".join(rng.choice("abcdefgh") for _ in range(37))
    letters = ["".join(rng.choice("ijklmnop") for _ in range(19)) for _ in range(1024)]
    parity = [bin(k).count("1") % 2 for k in range(1024)]
    texts = ["".join(gram + own + "YZ"[mark ^ flip] for own, mark in zip(letters, parity)) for flip in (0, 1)]
    strings = [{t[k:k + 100] for k in range(len(t) - 99)} for t in texts]
    assert not strings[0] & strings[1]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(frame, 100, suffix_dedup.DIGESTS, suffix_dedup.digests).collect()
    assert [(r.n_removed, r.n_spans) for r in got] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("block", [256, 16])
def test_similar_texts_in_a_large_family(spark, block, monkeypatch):
    """A family of texts that are nearly but not quite alike; partners of some of them are found in its crowded bands."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(600)]

    def changed(text, n):
        out = list(text)
        for at in rng.sample(range(0, 596, 5), n):  # each replaced word changes shingles of its own
            out[at] = word()
        return out

    family = [changed(base, 9) for _ in range(260)]
    partners = [changed(family[k], 11) for k in range(0, 260, 6)]
    texts = [" ".join(t) for t in family + partners]
    sets = [frozenset(shingles.shingle_set(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {find(i) for i in range(len(texts))}
    assert 200 < len(want) < len(texts) - 20  # most of the family stays apart
    got = shingles.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert {r.doc_id for r in got.collect()} == want


def plain_model(rows):
    """The language model of (doc_id, text, lang) rows by loops: frequencies over all, centroids over each language."""
    seen = np.zeros(language.SIZE)
    for _, text, _ in rows:
        seen += language.gram_counts(text.encode()) > 0
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    found = []
    for lang in sorted({r[2] for r in rows}):
        own = sorted(language.vector(t.encode(), idf).astype(np.float32).tobytes() for _, t, l in rows if l == lang)
        centroids, floors = language.cluster(np.stack([np.frombuffer(v, np.float32) for v in own]), language.CLUSTERS)
        found += [(lang, c.astype(np.float32).tobytes(), f) for c, f in zip(centroids, floors)]
    found.sort(key=lambda r: r[:2])
    return language.Model(idf, [f[0] for f in found], np.stack([np.frombuffer(f[1], np.float32) for f in found]),
                          language.REJECT_SHARE * np.array([f[2] for f in found]))


def test_pipeline_brute(spark, sf):
    """Every stage by loops over whole texts, each over what the one before it kept."""
    import sentencepiece

    import corpus_pipeline

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = plain_model(rows)
    rows = [r for r in rows if not model.predict(r[1].encode())[2]]

    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for doc, text, _ in rows:
        for line in text.split("\n"):
            if len(strip(line)) >= 10:
                holders.setdefault(strip(line), set()).add(doc)
    texts = {doc: "\n".join(x for x in text.split("\n") if len(holders.get(strip(x), ())) < 2 or min(holders[strip(x)]) == doc)
             for doc, text, _ in rows}

    ids = sorted(texts)
    sets = [frozenset(shingles.shingle_set(texts[i].encode(), 5).tolist()) for i in ids]
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both) > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for k, g in enumerate(group):
        first.setdefault(g, ids[k])
    kept = sorted(first.values())

    items = [decontam.normalise(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def holds(text):
        for item in items:
            begins, ends, budgets, _ = decontam.windows(item)
            asked = [(item, decontam.edit_budget(len(item)))] + [(item[b:e], int(n)) for b, e, n in zip(begins, ends, budgets)]
            # an edit spoils at most Q of a part's q-grams, the others stand in the text as they are
            if any(sum(part[k:k + decontam.Q] in text for k in range(len(part) - decontam.Q + 1))
                   >= len(part) - decontam.Q + 1 - decontam.Q * budget and min(decontam.distances(part, text), default=99) <= budget
                   for part, budget in asked):
                return True
        return False

    clean = [i for i in kept if not holds(decontam.normalise(texts[i].encode()))]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for i in clean:
        tokens = library.encode(texts[i])
        want[i] = (len(tokens), sha(",".join(map(str, tokens)).encode()), sha(library.decode(tokens).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(ids) > len(kept) > len(clean)
