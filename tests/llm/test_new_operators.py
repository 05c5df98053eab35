"""Alignment, vector codes and mixing against brute-force versions, and on odd rows."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docquery.llm import alignment, codes, mixing

BYTES = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, size long, chunk long, links int, label int, slot string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, an id with two texts, long texts, columns of clashing names."""
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", "b"), (4, "own words here", None), (4, "own words here", None),
            (4, "another text under the same id", None), (None, "no id", "a"), (None, None, None), (5, "x" * 20_000, "c"),
            (7, "né́ 漢字 \U0001F600 ▁ <s> \0", "a"), (8, "12345 !!! <|endoftext|> <0x0A> <unk>", "a"),
            (9, "word " * 20_000, "d"), (10, "é" * 3000 + "  two \n\n lines \r\n 's", "d"), (11, "a\x1cb \x85 c d", "e"),
            *[(20 + k, "same text for many", "hot") for k in range(60)], *[(100, "one row many times", "hot")] * 60]
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4, "s") for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _runs(side, groups):
    from itertools import groupby

    return [list(g) for _, g in groupby(zip(side, groups), key=lambda x: x[1])]


def brute_alignment(rows):
    """Rows (doc_id, text) to the contract's columns, by loops over the libraries' own tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = alignment.byte_alphabet()
    docs, links = [], Counter()
    for doc_id, text in rows:
        got = [], [], [], []
        if text:
            a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode())
                 for i in second.encode(text) for p in [second.id_to_piece(i)]]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
                both = sorted(set(ends[0]) & set(ends[1]))
                of_a, of_b = dict(zip(ends[0], [i for i, _ in a])), dict(zip(ends[1], [i for i, _ in b]))
                pairs = [(of_a[e], of_b[e]) for e in both]
                listed = [[[str(i) for (i, _), _ in g] for g in _runs(side, np.searchsorted(both, own))] for side, own in zip((a, b), ends)]
                groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*listed)]
                got = [a, b, groups, pairs]
                links.update(pairs)
        docs.append((doc_id, got))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return sorted(((i, len(a), len(b), len(g), len(p), sum(links[q] == most[q[1]] for q in p), sum(links[q] for q in p),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, (a, b, g, p) in docs),
                  key=str)


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def test_alignment_brute(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text[:4000]) for r in docs.select("doc_id", "text").orderBy("doc_id").limit(80).collect()]
    got = alignment.link_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), BYTES, MODEL)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == brute_alignment(rows)


def test_alignment_odd_rows_and_chunks(odd, nothing, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    monkeypatch.setattr(alignment, "SEGMENT", 1 << 12)  # long texts are cut often, chunks are small
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 100)
    got = alignment.link_counts(odd, BYTES, MODEL)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == brute_alignment(rows)
    assert alignment.link_counts(nothing, BYTES, MODEL).collect() == []


def test_byte_level_ids_are_the_files_own(odd):
    encoder = alignment.ByteLevelEncoder(BYTES)
    assert encoder.plain
    for text in [r.text for r in odd.select("text").distinct().collect() if r.text] + [" " * 5000, "a" * 6000 + "\n" * 3000, "'LL 's ''ve"]:
        assert encoder(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_segments_join_to_the_text():
    aligner = alignment.Aligner(BYTES, MODEL)
    text = "some words, and — more 1234 of  them\n " * 30_000
    parts = aligner.segments(text)
    assert len(parts) > 3 and "".join(parts) == " " + text
    whole = aligner.a(" " + text).tolist()
    assert [i for p in parts for i in aligner.a(p).tolist()] == whole


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """(id, vector of integers, label) rows by plain loops."""
    length = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * length:(p + 1) * length]
    seeds = {}
    for i, v, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        seeds.setdefault(i, v)
    books = [[list(cut(seeds[i], p)) for i in sorted(seeds)[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((x - y) ** 2 for x, y in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in rows:
                members[near(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*members[k])] if members[k] else e for k, e in enumerate(books[p])]
    found = [[near(v, p) for p in range(parts)] for _, v, _ in rows]
    sums = Counter()
    for (_, _, label), f in zip(rows, found):
        sums[label] += sum(d for d, _ in f)
    out = sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[label]) for (i, _, label), f in zip(rows, found)), key=str)
    return out, ",".join(str(x) for b in books for e in b for x in e)


@pytest.mark.parametrize("length", [32, 48, 80])
def test_codes_brute(spark, length):
    rng = np.random.default_rng(length)
    vectors = [(int(i), [float(x) for x in rng.choice([-1.3, 0.25, 0.7, 2.0, -0.004], length)], int(i % 3) if i % 5 else None)
               for i in rng.permutation(90)]
    vectors += [vectors[0], (None, vectors[1][1], 1), (3, vectors[2][1], None)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3)
    rows = [(r.vec_id, [int(np.floor(256 * x)) for x in r.embedding], r.label) for r in frame.collect()]
    out, books = codes.compress(frame)
    want, text = brute_codes(rows)
    assert sorted(map(tuple, out.select("vec_id", "code", "error", "label_error").collect()), key=str) == want
    assert books.text == text


def test_codes_odd_vectors(spark):
    good, inf = [float(k) for k in range(16)], float("inf")
    rows = [(1, good, 1), (2, None, 1), (3, [None] + good[1:], 1), (4, [inf] + good[1:], 1), (5, [float("nan")] + good[1:], 1),
            (6, good[:8], 1), (7, [], 1), (8, [1e30] + good[1:], 1), (None, good[::-1], None), (1, good, 1)]
    frame = spark.createDataFrame([(*r, "c", 5) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    out, books = codes.compress(frame)
    got = sorted(map(tuple, out.collect()), key=str)
    away = [sum((int(256 * x) - int(e)) ** 2 for x, e in zip(v, books.entries.ravel())) for v in (good, good, good[::-1])]
    assert [(g[0], g[2], g[3]) for g in got] == [(i, e, s) for i, e, s in zip([1, 1, None], away, [2 * away[0], 2 * away[0], away[2]])]
    assert books.entries.shape == (16, 1, 1)
    decoded = books.decoded(np.zeros((1, 16), np.int64))
    assert decoded.tolist() == [[np.floor(256 * (a + b + a) / 3) for a, b in zip(good, good[::-1])]]
    empty, none = codes.compress(frame.where("vec_id = 99"))
    assert empty.columns == ["vec_id", "code", "error", "label_error"] and empty.collect() == [] and none.text == ""


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    for width in (1, 2, 4, 8, 16):
        order = codes.sequency_order(width)
        signs = codes.transform(np.eye(width, dtype=np.int64), order)
        assert (signs @ signs.T == width * np.eye(width, dtype=np.int64)).all()
        assert [int((s[1:] != s[:-1]).sum()) for s in signs.T] == list(range(width))
        x = rng.integers(-900, 900, (5, width))
        assert ((codes.transform(x, order) ** 2).sum(axis=1) == width * (x ** 2).sum(axis=1)).all()


def brute_targets(sizes, weights=(5, 2, 1)):
    """Sources in order to their targets, by dealing the excess out again until none is above."""
    left, target, limit = Fraction(3, 2) * sum(sizes), [Fraction(0)] * len(sizes), [2 * s for s in sizes]
    open_ = set(range(len(sizes)))
    while left and open_:
        sums = sum(weights[k % 3] for k in open_)
        for k in open_:
            target[k] += left * weights[k % 3] / sums
        left = Fraction(0)
        for k in list(open_):
            if target[k] >= limit[k]:
                left += target[k] - limit[k]
                target[k] = Fraction(limit[k])
                open_.remove(k)
    return target


@pytest.mark.parametrize("sizes", [[10], [100, 1], [1, 100, 1000, 10, 10, 5], [0, 7, 0, 9], [10_000, 1, 1, 1]])
def test_targets_brute(spark, sizes):
    frame = spark.createDataFrame([(k, s, (5, 2, 1)[k % 3]) for k, s in enumerate(sizes)], "source_no long, size long, weight long")
    got = {r.source_no: r.target for r in mixing.with_targets(frame).collect()}
    assert [got[k] for k in range(len(sizes))] == pytest.approx([float(t) for t in brute_targets(sizes)])


def test_permutations_are_permutations():
    for n in [1, 2, 3, 5, 64, 1000, 4097]:
        key = np.full(n, 12345 + n, np.uint64)
        got = mixing.permuted(np.arange(n), np.full(n, n), key)
        assert sorted(got.tolist()) == list(range(n))
    assert got.tolist() != list(range(n))


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixing_takes_what_it_says(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixture = mixing.mix(docs, shard_slots=100)
    taken = mixing.words_taken(mixture).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    assert sorted(t.doc_id for t in taken) == sorted(texts)
    names = sorted({r.source for r in texts.values()}, key=lambda s: s.encode())
    sizes = [sum(len(words(r.text)) for r in texts.values() if r.source == s) for s in names]
    target = dict(zip(names, brute_targets(sizes)))
    by_source = Counter()
    for t in taken:
        assert t["size"] == len(words(texts[t.doc_id].text)) and t.taken <= 2 * t["size"]
        assert t.source_size == sizes[names.index(t.source)] and t.target == pytest.approx(float(target[t.source]))
        by_source[t.source] += t.taken
    assert all(abs(by_source[s] - target[s]) <= 1.5 * mixing.BLOCK_WORDS for s in names)  # half a block, and a short last one
    # the mix's own texts hold those words, slots are filled without gaps, and counts of a shard vary
    mixed = mixing.mixed_texts(docs, mixture).collect()
    assert sum(len(words(m.text)) for m in mixed) == sum(t.taken for t in taken)
    shards = defaultdict(list)
    for m in mixed:
        shards[m.shard].append(m.slot)
    full = [sorted(shards[k]) for k in sorted(shards)]
    assert all(f == list(range(100)) for f in full[:-1]) and full[-1] == list(range(len(full[-1])))
    every = Counter(w for m in mixed for w in words(m.text))
    once = Counter(w for r in texts.values() for w in words(r.text))
    assert all(n <= 2 * once[w] for w, n in every.items())
    again = mixing.words_taken(mixing.mix(docs.repartition(7), shard_slots=100)).collect()
    assert sorted(again) == sorted(taken)


def test_mixing_odd_rows(odd, nothing, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    monkeypatch.setattr(mixing, "CELL_ROWS", 5)
    monkeypatch.setattr(mixing, "GROUP", 2)  # draws in two steps
    got = mixing.words_taken(mixing.mix(odd, block_words=4, shard_slots=16)).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((r.doc_id, len(words(r.text)), r.source) for r in odd.collect())
    assert all(r.taken <= 2 * r["size"] for r in got)
    names = sorted({r.source for r in got} - {None}) + [None]
    sizes = [sum(r["size"] for r in got if r.source == s) for s in names]
    for name, target in zip(names, brute_targets(sizes)):
        assert abs(sum(r.taken for r in got if r.source == name) - target) <= 6
    assert mixing.words_taken(mixing.mix(nothing)).collect() == []


def test_draws_follow_the_weights(spark):
    sources = spark.createDataFrame([(k, n) for k, n in enumerate([5000, 2000, 2990, 0, 10])], "source_no long, slots long")
    drawn = mixing.draw(sources, 100, 3).collect()
    assert all(sum(r["count"] for r in drawn if r.shard == s) == 100 for s in range(100))
    sums = Counter()
    for r in drawn:
        sums[r.source_no] += r["count"]
    assert abs(sums[0] - 5000) < 250 and sums[3] == 0
    assert len({r["count"] for r in drawn if r.source_no == 0}) > 10  # counts vary between shards
    settled = mixing.settle(sources, spark.createDataFrame(drawn)).collect()
    ranks = defaultdict(list)
    for r in settled:
        ranks[r.source_no] += range(r.rank0, r.rank0 + r["count"])
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in enumerate([5000, 2000, 2990, 0, 10]) if n}
    slots = sorted((r.shard, r.slot0 + k) for r in settled for k in range(r["count"]))
    assert slots == [(s, k) for s in range(100) for k in range(100)]
