"""Brute-force versions of the token, packing, search and archive queries."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import archive, packing, repair, spbpe, tokens, topk

ODD = [None, "", " ", "a  b \n c\td ", " x", "x ", "foo\n bar\n\nbaz's l'été", "<|endoftext|> x", "日本 İstanbul ΣΑΣ x̂ y", "!!! ''s 's 12 345a", "word " * 5000, "same", "same"]
SCHEMA = "doc_id long, text string, ids int, start string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 50, t, i, "x", None) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_texts_in_parts_equal_those_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 50)
    monkeypatch.setattr(tokens, "parts_of", lambda text, of=tokens.parts_of: of(text, 20))
    random.seed(1)
    letters = "abcdefghijklmnopqrstuvwxyzéèñßüöÄÉ' .,!0123456789\n\u0301 a a a"
    texts = [*ODD, *("".join(random.choices(letters, k=random.randint(1, 400))) for _ in range(300))]
    got = tokens.encoder(tokens.tokenizer_path(name)).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [library(name)(t) for t in texts]
    assert max(len(tokens.parts_of(t or "")) for t in texts) > 5


def test_words_go_to_the_library_once(monkeypatch):
    """each spelling, with each mark behind it, was encoded anew."""
    encoder = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    asked, words = [], encoder._words
    monkeypatch.setattr(encoder, "_words", lambda names: asked.extend(names) or words(names))
    texts, encode = [*ODD, "Ship ship, SHIP.\nship\tSHIP!!! sHip's Été,\nÉTÉ", "ª aª H\u0331 e\u0301té ship<|endoftext|> \u212a K. x\u00d7y ǅ", "ship"], library("word_bpe_49k.json")
    for _ in range(2):  # the second time from what is kept
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [encode(t) for t in texts]
    assert asked.count("ship") == 1 and asked.count("été") == 1
    assert not tokens.WordEncoder.fits(tokens.tokenizer_path("byte_bpe_50k.json"))


def test_grammar_looks_at_open_places_only(monkeypatch):
    seen, counted = [], repair._counted
    monkeypatch.setattr(repair, "_counted", lambda keys, least: seen.append(len(keys)) or counted(keys, least))
    rng = np.random.default_rng(5)
    parts = [np.concatenate((rng.integers(100, 60_000, 900), [1, 2, 3] * 40, [7] * 9)).astype(np.uint32) for _ in range(12)]
    shard = repair.Shard(repair.pack(list(range(12)), parts, 1 << 16))
    assert all(np.array_equal(a, b) for a, b in zip(parts, shard.documents(), strict=True))
    left = np.concatenate([shard.symbols[a : b - 1].astype(np.uint64) << np.uint64(32) | shard.symbols[a + 1 : b] for a, b in zip(shard.bounds, shard.bounds[1:], strict=False)])
    assert np.unique(left, return_counts=True)[1].max() < repair.PAYS  # no pair pays
    assert len(left) > 10_000 and seen[-1] < 1000  # pairs that had too few places are not counted again


def test_token_files(spark, tmp_path):
    ids = [i * 7 % 50 for i in range(len(ODD))]
    ids[3], ids[4], ids[5] = None, None, ids[6]
    rows = list(zip(ids, ODD, strict=True))
    docs = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA).repartition(3)
    path = f"file://{tmp_path}/ids"
    repair.write_shards(docs, path, tokens.tokenizer_path("word_bpe_49k.json"), 1, 1 << 16)
    encode = library("word_bpe_49k.json")
    coded = {t: [*encode(t), 1] for t in ODD}
    got = sorted(map(tuple, repair.read_shards(spark, path).collect()), key=lambda r: r[1])
    last = (1 << 63) - 1
    assert [last if r[0] is None else r[0] for r in got] == sorted(last if i is None else i for i in ids)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0
    summed = lambda t: zlib.crc32(np.array(coded[t], "<u4").tobytes())
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((i or -1, len(coded[t]), summed(t)) for i, t in rows)
    asked = [ids[10], ids[6], ids[0], 999]
    found = sorted((r.doc_id, list(r.ids)) for r in repair.fetch(spark, path, asked, 2, 4500).collect())
    assert found == sorted((i, coded[t][2:4500]) for i, t in rows if i in asked)
    assert repair.fetch(spark, path, []).count() == 0


def test_token_files_of_an_empty_table(spark, tmp_path):
    repair.write_shards(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", tokens.tokenizer_path("word_bpe_49k.json"), 1, 1 << 16)
    assert repair.read_shards(spark, f"file://{tmp_path}/none").count() == 0


def plain_repair(parts):
    """One pair at a time, the most frequent first, by definition."""
    parts, n, rules = [list(p) for p in parts], 1 << 16, 0

    def places(part):
        found, at = defaultdict(list), 0
        for at in range(len(part) - 1):
            pair = (part[at], part[at + 1])
            if not (found[pair] and pair[0] == pair[1] and found[pair][-1] == at - 1):
                found[pair].append(at)
        return found

    while True:
        counts = defaultdict(int)
        for p in parts:
            for pair, found in places(p).items():
                counts[pair] += len(found)
        best = max(counts, key=lambda x: (counts[x], x), default=None)
        if best is None or counts[best] < repair.PAYS:
            return sum(map(len, parts)) + 3 * rules
        for p in parts:
            for at in reversed(places(p).get(best, [])):
                p[at : at + 2] = [n]
        n, rules = n + 1, rules + 1


def test_grammar_runs_to_its_end_and_gives_random_access():
    rng = random.Random(3)
    passage = [rng.randrange(500) for _ in range(300)]
    for kinds in (1, 2, 5, 60):
        parts = [np.array([rng.randrange(kinds) for _ in range(rng.choice([0, 1, 2, 30, 200]))], "<u4") for _ in range(8)]
        parts += [np.array(passage[:250] + [7], "<u4") for _ in range(6)]
        data = repair.pack([*range(len(parts) - 2), None, None], parts, 1 << 16)
        shard = repair.Shard(data)
        assert shard.doc_ids.to_pylist() == [*range(len(parts) - 2), None, None]
        assert all(np.array_equal(a, b) for a, b in zip(shard.documents(), parts, strict=True))
        for n, p in enumerate(parts):
            a, b = rng.randint(0, len(p) + 1), rng.randint(0, len(p) + 2)
            assert np.array_equal(shard.document(n), p) and np.array_equal(shard.part(n, a, b), p[a:b])
        keys, counts = repair._pairs_of(shard.symbols.astype(np.uint64), shard.bounds[1:])
        assert not len(repair._counted(keys[counts], repair.PAYS)[0])  # no pair pays any more
        assert len(shard.symbols) + 3 * len(shard.rules) <= 1.1 * plain_repair(parts) + 5
        assert shard.lengths.max() > 16
        with pytest.raises(ValueError):
            repair.Shard(data[:-2])


def test_byte_bpe_equals_tiktoken_and_decodes(docs):
    import public_tokenizers
    import tiktoken

    path = tokens.tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in spbpe.encode_documents(docs, path).collect())
    want = []
    for i, t in enumerate(ODD):
        ids = encoding.encode_ordinary(t or "")
        want.append((i * 7 % 50, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want)


def test_packing_places_every_piece_once(docs):
    got = packing.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json"), capacity=64).collect()
    encode, want, places = library("byte_bpe_50k.json"), [], defaultdict(list)
    for i, t in enumerate(ODD):
        ids = [*encode(t), 0]
        first = len(ids) % 64
        bounds = sorted({0, *range(first, len(ids) + 1, 64)})
        for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want.append((i * 7 % 50, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for sequence in places.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == -(-sum(w[3] for w in want) // 64)


def test_plan_is_tight():
    rng = random.Random(2)
    lengths = [rng.randint(1, 2048) if rng.random() < 0.3 else rng.randint(1, 600) for _ in range(20000)]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    rows = packing.plan(histogram)
    assert int(max(rows[:, 2] + rows[:, 3])) <= 1.01 * sum(lengths) / 2048 + 1


def test_slots_unfold_every_range(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 3)
    histogram = {5: 23, 3: 10, 2: 1, 10: 7}
    rows = packing.plan(histogram, 10)
    got = [tuple(r) for r in packing.slots(spark, rows).select("length", "rank", "sequence_id", "offset").collect()]
    assert sorted(r[:2] for r in got) == sorted((n, k) for n, c in histogram.items() for k in range(c))
    taken = defaultdict(int)
    for length, _, sequence, offset in sorted(got, key=lambda r: (r[2], r[3])):
        assert offset == taken[sequence]
        taken[sequence] += length
    assert max(taken.values()) <= 10 and packing.slots(spark, packing.plan({})).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) if x > 0 else 0.0 for x in rng.normal(size=8)]) for i in range(300)]
    vectors += [(i + 300, v) for i, v in vectors[:20]] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (None, [1.0] * 8), (500, [2.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    v = topk.quantised(df)
    got = topk.exact_topk(v, v.where("vec_id % 100 = 0"), k=5, query_block=2, candidate_block=50).collect()
    ok = {i: np.floor(1024 * np.array(e, dtype=np.float32).astype(float)).astype(int) for i, e in vectors if i is not None and e and None not in e and not np.isnan(e).any()}
    want = []
    for q in (i for i in ok if i % 100 == 0):
        scored = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_topk(v.limit(0), v.limit(0)).count() == 0


def test_topk_of_repeated_ids_and_huge_components(spark):
    inf, big = float("inf"), 3e38
    rows = [(0, [1.0, -1.0]), (0, [2.0, 0.0]), (1, [inf, 1.0]), (2, [big, 0.0]), (3, [-big, big]), (4, [1.0]), (5, []), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (100, [-big, -big])]
    v = topk.quantised(spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id long, embedding array<float>, terms string, row int"))
    got = [tuple(r) for r in topk.exact_topk(v, v.where("vec_id % 100 = 0"), k=20).collect()]
    ends = -(1 << 63), (1 << 63) - 1
    whole = lambda x: min(max(math.floor(1024 * x), ends[0]), ends[1])
    terms = [(i, [whole(float(np.float32(c))) for c in x]) for i, x in rows if inf not in x]
    want = []
    for q, query in ((0, terms[0][1]), (100, terms[-1][1])):
        product = lambda t: min(max(sum(a * b for a, b in zip(query, t, strict=False)), ends[0]), ends[1])  # noqa: B023, E731
        scored = sorted((-product(t), i) for i, t in terms if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)


def test_archives(spark, tmp_path):
    same, long = "s" * 100, "é\r\n\r\nWARC/1.0\r\n" * 5000
    html = [same, None, "", same, "s" * 99, "s" * 99, long, long, "x" * 200, same]
    urls = ["http://b.example.com/2", "https://www.A.example.com/?q=1", None, "not a url", "http://a.example.com:8080/x\r\ny", "http://[bad", *["http://h.org/"] * 4]
    rows = [(i * 3 % 10, u, h, "q") for i, (h, u) in enumerate(zip(html, urls, strict=True))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    archive.write(pages, f"file://{tmp_path}/w", file_bytes=900)
    lines = archive.captures(spark, f"file://{tmp_path}/w")
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        refers = first[h or ""] if len(data) >= 100 and first[h or ""] != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    ordered = archive.history(lines).collect()
    # a record is read from its offset alone, and a file is a gzip file like any other
    for r in lines.collect():
        data = next(tmp_path.glob(f"w/{r.run}")).read_bytes()
        found = list(archive.parse(data[r.offset : r.offset + r.length]))
        assert len(found) == 1 and found[0][2]["x-page-id"] == str(r.page_id) and len(data) < 3000
        assert gzip.decompress(data).startswith(b"WARC/1.0\r\n")
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in ordered) == sorted(want)
    keys = [(r.url_key, r.timestamp, r.page_id) for r in ordered]
    assert keys == sorted(keys) and len(keys) == len(rows)
    archive.write(pages.limit(0), f"file://{tmp_path}/none")
    assert archive.history(archive.captures(spark, f"file://{tmp_path}/none")).count() == 0


def test_archives_of_repeated_and_null_ids(spark, tmp_path):
    long, other = "p" * 150, "q" * 150
    rows = [(3, "http://b.org/", long), (3, "http://b.org/", long), (None, "http://a.org/", long), (None, "http://a.org/", long), (5, "http://c.org/", long), (3, "http://d.org/", other), (5, None, other)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string")
    archive.write(pages, f"file://{tmp_path}/w")
    got = sorted((r.page_id or -1, r.payload_digest, r.record_type, r.refers_to or -1) for r in archive.history(archive.captures(spark, f"file://{tmp_path}/w")).collect())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted((i or -1, digest(h), "revisit" if i == 5 else "response", 3 if i == 5 else -1) for i, _, h in rows)
    ids = [head["warc-record-id"] for file in tmp_path.glob("w/*/*.txt") for _, _, head, _ in archive.parse(file.read_bytes())]
    assert len(set(ids)) == len(rows)


def test_gzip_members_end_with_zero():
    for n in (1, 100, 1 << 24, (1 << 24) + 5):
        data = archive.member(b"x" * n) + b"\0"
        assert gzip.decompress(data) == b"x" * n


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 30))) for _ in range(k)]
        assert list(archive.LoserTree(runs)) == sorted(x for r in runs for x in r)
