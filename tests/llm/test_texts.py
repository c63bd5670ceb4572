"""Brute-force versions of the text operators and of the pipeline's stages."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import common, jaccard, quality, rlz, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, found string, anchor int, row string, words string, node string, kind string"
VOCABULARY = [f"w{i}" for i in range(300)]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), "f", 1, "r", "w", "n", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


# --- secrets --------------------------------------------------------------------------------------

SECRETS = [
    None, "", "nothing here", 'é password = "hunter22xyz" and PassWd:abc', "secret=token:abcdefg token=abcdefgh", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "x" * 3000 + "deadbeef" * 4,
    "日本 api_key: 'k_1/2+3=.-' APIKEY=  zzzzzz", "ghp_" + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY-----", "0123456789abcdef" * 2 + "g" + "f" * 24, "password" * 1000 + " " * 5000 + "= abcdef", "token=secret1 token=secret1", "token=secret1 token=secret1",
]


def brute_spans(text):
    out = []
    for k, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if m.end(r.measured) - m.start(r.measured) >= r.least:
                out.append((m.start(), k, r.kind, m.end()))
    return sorted(out)


def test_secret_spans(spark):
    got = secrets.scan(frame(spark, SECRETS)).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.found]) for r in got) == [(i, brute_spans(t)) for i, t in enumerate(SECRETS)]
    assert brute_spans(SECRETS[3]) and brute_spans(SECRETS[10])
    same = secrets.scan(frame(spark, SECRETS, [None, 1] + [7] * 11)).collect()
    assert sorted(([tuple(s) for s in r.found] for r in same)) == sorted(brute_spans(t) for t in SECRETS)
    assert secrets.scan(frame(spark, SECRETS).limit(0)).count() == 0


def test_secrets_of_a_text_with_100_000_matches(spark):
    text = " ".join(["é token=abcdef", "0123456789abcdef" * 2] * 50_000)
    docs = frame(spark, [text])
    got = secrets.scan(docs).select(F.size("found").alias("n"), F.element_at("found", -1).alias("last"), F.element_at("found", 49_999).alias("middle")).first()
    want = brute_spans(text)
    assert got.n == len(want) == 100_000 and tuple(got.last) == want[-1] and tuple(got.middle) == want[49_998]
    clean = " ".join(["é [assign]", "[hex]"] * 50_000)
    assert [r.text == clean for r in secrets.redact(docs).collect()] == [True]


def test_trigram_queries_hold_for_all_matches():
    samples = {"assign": ["PASSWORD='abcdef'", "api_KEY:xxxxxx", "toKen = 123456"], "github": ["ghs_" + "x" * 36], "stripe": ["sk_live_" + "0" * 16], "pem": ["-----BEGIN PRIVATE KEY-----"], "jwt": ["eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8]}
    for kind, texts in samples.items():
        rule = next(r for r in secrets.RULES if r.kind == kind)
        clauses = secrets.trigram_query(rule.pattern)
        for t in texts:
            assert re.search(rule.pattern, t) and any(all(g in t.lower() for g in c) for c in clauses)
    assert secrets.trigram_query("[0-9a-f]{24,}") == [] and secrets.trigram_query("(foo|.)bar*") == []


def test_redaction(spark):
    docs = frame(spark, SECRETS)
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns
    for i, t in enumerate(SECRETS):
        spans, at, made = brute_spans(t), 0, ""
        for start, _, kind, end in spans:
            made += "" if start < at else (t[at:start] + f"[{kind}]")
            at = max(at, end)
        want = t if not spans else made + t[at:]
        assert out[i].text == want and out[i].n_chars == len(want or "")


# --- quality --------------------------------------------------------------------------------------


def brute_measures(text):
    words = WORD.findall(text or "")
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(j for i in places for j in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def brute_scores(texts):
    """Mean log ratios over pairs of shapes by definition, without hashes or buckets."""
    grams, trusted = [], []
    for t in texts:
        t = t or ""
        words = WORD.findall(t)
        shapes = WORD.findall("".join("a" if c.isalpha() else "0" if c.isnumeric() else c for c in t))
        shapes = [re.sub("(a|0)\\1+", r"\1", x) for x in shapes]
        mine = ["again" if i + 1 < len(words) and words[i] == words[i + 1] else tuple(shapes[i : i + 2]) for i in range(len(words))]
        n, _, symbols, lines, _, _ = brute_measures(t)
        grams.append(mine)
        trusted.append(n >= 20 and lines == 0 and symbols * 50 <= n and mine.count("again") * 50 <= n)
    raw = Counter(g for m in grams for g in m)
    target = Counter(g for m, ok in zip(grams, trusted, strict=True) if ok for g in m)
    shares = {g: (target[g] / target.total()) / (n / raw.total()) for g, n in raw.items()} if target else {}
    ratio = {g: math.log((1 - quality.FLOOR) * x + quality.FLOOR) for g, x in shares.items()}
    return [sum(ratio.get(g, 0) for g in m) / max(1, len(m)) for m in grams]


def test_quality(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a " * 9, "a b\n\na b\nc", "x y z " * 2000, prose(rng, 8) + " " + prose(rng, 8)]
    loop = prose(rng, 9)
    texts += [f"{loop} {prose(rng, 5)} {loop}\x0b{loop}", " ".join(w + "$$$" for w in prose(rng, 100).split())]
    texts += [prose(rng, 100) for _ in range(40)] + ["Ünë, the 12 of May (1999).\nÉté ٣٤ x-y 日本 " * 3 + prose(rng, 60)]
    texts += [" ".join(w for w in prose(rng, 30).split() for _ in range(5)), texts[-1]]
    docs = frame(spark, texts).withColumn("buckets", F.lit(1)).withColumn("score", F.lit("s"))
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    scores = brute_scores(texts)
    for i, t in enumerate(texts):
        r, base = got[i], brute_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base, i
        assert abs(r.score - scores[i]) < 2e-4 and r.kept == (not base[-1] and scores[i] >= quality.THRESHOLD), i
    assert [i for i in range(9, len(texts)) if not got[i].kept] == [9, 50, 51, 52]
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(i for i in got if got[i].kept)
    assert quality.judge(docs.limit(0)).count() == 0
    alone = quality.judge(frame(spark, texts[:5])).collect()
    assert all(r.score == 0 and not r.kept for r in alone)
    several = quality.judge(frame(spark, texts[8:11], [None, 7, 7])).collect()
    assert sorted(r.n_words for r in several) == sorted(brute_measures(t)[0] for t in texts[8:11])


def test_quality_verdicts_do_not_depend_on_corpus_size(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(20_000)]
    bad = [" ".join(w + rng.choice(["$$$", "&&&", "###"]) for w in rng.choices(words, k=100)) for _ in range(40)]
    good = [" ".join(rng.choices(words, k=150)) for _ in range(4_000)]
    for n in (400, 4_000):
        # as many bad texts for each good one at both sizes; the first four are looked at
        texts = bad[: n // 100] + good[:n]
        kept = {r.doc_id for r in quality.judge(frame(spark, texts)).where("kept").select("doc_id").collect()}
        assert not kept & set(range(4)) and len(kept) == n, n


# --- substrings -----------------------------------------------------------------------------------


def brute_kept(texts, width=rlz.WINDOW):
    seen, out = set(), []
    for t in texts:
        words = (t or "").encode().split()
        gone, mine = set(), []
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone.update(range(i, i + width))
            seen.add(w)
            mine.append(w)
        out.append((len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (19, 20, 21, 25, 37, 60, 200)]
    texts = [None, "", "  ", "a", "the " * 500, "the " * 300 + "end", "a b c d e " * 30, prose(rng, 19), prose(rng, 20)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(prose(rng, rng.randint(0, 40)))
            p = rng.choice(passages).split(" ")
            a = rng.randint(0, len(p) // 3)
            parts.append(" ".join(p[a : len(p) - rng.randint(0, len(p) // 3)]))
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(parts))
    texts += [texts[-1], texts[20], texts[20] + " x", "x " + texts[20]]
    want = brute_kept(texts)
    got = rlz.deduplicate(frame(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == [(i, *w) for i, w in enumerate(want)]
    docs = frame(spark, texts)
    kept = {r.doc_id: r.text for r in rlz.keep_first(docs).collect()}
    assert kept == {i: (t if not w[1] else w[2]) for i, (t, w) in enumerate(zip(texts, want, strict=True)) if not w[0] or w[1] < w[0]}
    assert rlz.keep_first(docs).columns == docs.columns and rlz.deduplicate(docs.limit(0)).count() == 0


def test_factors_have_sources(spark):
    rng = random.Random(9)
    p, q = prose(rng, 60), prose(rng, 50)
    texts = [f"{prose(rng, 30)} {p} {prose(rng, 30)}", f"{q} {prose(rng, 10)}", f"{prose(rng, 5)} {p} {q} {prose(rng, 25)}", f"{p} {prose(rng, 9)}"]
    words = [t.split() for t in texts]
    rows = {r.doc_id: r for r in rlz.deduplicate(frame(spark, texts), spans=True).collect()}
    for i, r in rows.items():
        covered = set()
        for f in r.factors:
            assert f.words >= 20
            covered |= set(range(f.start, f.start + f.words))
            if f.source_start is not None:  # the words at the source are the same
                assert f.source_id < i and words[f.source_id][f.source_start : f.source_start + f.words] == words[i][f.start : f.start + f.words]
        assert len(covered) == r.n_removed
    assert rows[2].n_removed == 110 and {f.source_id for f in rows[2].factors} >= {0, 1}
    assert max(f.words for f in rows[2].factors) > 30 and rows[3].n_removed == 60


def test_substrings_of_rows_with_one_id_or_none(spark):
    rng = random.Random(2)
    same, p, q, end, a, b, z = (prose(rng, 30) for _ in range(7))
    got = sorted((r.doc_id or -1, r.n_removed) for r in rlz.deduplicate(frame(spark, [same] * 4, [5, 5, None, None])).collect())
    assert got == [(-1, 30), (-1, 30), (5, 0), (5, 30)]
    texts, ids = [p, p, q, z, f"{a} {p}", f"{b} {q} {end}", end], [1, 5, 5, 5, None, None, None]
    kept = sorted(((r.doc_id or -1, r.kept) for r in rlz.deduplicate(frame(spark, texts, ids)).collect()))
    among = [(-1, a), (-1, f"{b} {end}"), (-1, "")], [(-1, a), (-1, b), (-1, end)]  # the rows without id are in the table's order
    assert kept in [sorted([(1, p), (5, ""), (5, q), (5, z), *rest]) for rest in among]
    left = sorted(r.text for r in rlz.keep_first(frame(spark, texts, ids)).collect())
    assert left in [sorted([p, q, z, *(t for _, t in rest if t)]) for rest in among]


# --- near copies ----------------------------------------------------------------------------------


def brute_links(texts):
    def shingles(t):
        w = (t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    links = {i: {j for j in range(len(texts)) if i != j and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))} for i in range(len(texts))}
    least = list(range(len(texts)))
    for _ in texts:
        least = [min([least[i], *(least[j] for j in links[i])]) for i in range(len(texts))]
    return [(i, least[i], len(links[i])) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def test_near_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # a group of many blocks
    rng = random.Random(8)
    base = [prose(rng, n) for n in (120, 60, 200, 30)]
    texts = [None, "", "one two", "one two", "one  two\n", "two one", "a b c d e", "a b c d e f"]
    texts += [edited(rng, base[0], rng.randint(0, 3)) for _ in range(90)]
    texts += [edited(rng, b, k) for b in base[1:] for k in (0, 0, 1, 1, 2, 4)]
    texts += [prose(rng, 50) for _ in range(30)] + [prose(rng, 4000)]
    chain = prose(rng, 100).split(" ")
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 21, 4)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(frame(spark, texts)).collect())
    assert got == brute_links(texts)
    docs = frame(spark, texts)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in got})
    assert jaccard.join(docs.limit(0)).count() == 0
    odd = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in jaccard.join(frame(spark, ["p q r"] * 3 + [None], [4, None, 4, None])).collect())
    assert odd == [(-1, -1, 0), (-1, 4, 2), (4, 4, 2), (4, 4, 2)]


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, 40) for _ in range(3))
    texts = [a, a, b, c, c, c, None, "", "", b + " x"]
    ids = [7, 7, 7, None, None, 9, 1, 1, None, None]
    kept = sorted((r.doc_id or -1, r.text or "") for r in jaccard.keep_one(frame(spark, texts, ids)).collect())
    assert kept == sorted([(7, a), (7, b), (9, c), (1, ""), (1, ""), (-1, "")])


def test_staged_tables_go(spark):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    staged = common.stage(spark.range(3), "gone")
    assert staged.count() == 3 and list(folder.glob("lakeloom-gone-*"))
    common.drop(staged, spark.range(1))
    assert not list(folder.glob("lakeloom-gone-*"))
    common.stage(spark.range(3), "gone")
    common.release(spark)
    assert not list(folder.glob("lakeloom-*"))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1040)]
    named = [(f"{max(e):05d}".encode(), f"{min(e):05d}".encode()) for e in edges]
    least = {n: n for e in named for n in e}
    for _ in range(60):
        for a, b in named:
            least[a] = least[b] = min(least[a], least[b])
    got = {bytes(r.node): bytes(r.root) for r in jaccard.components(spark.createDataFrame(named, "node binary, lead binary")).collect()}
    assert got == {n: r for n, r in least.items() if n != r}


def test_pruning_keeps_pairs_at_the_threshold():
    lost = sum(np.random.default_rng(1).binomial(n, 0.8, 200_000).min() < m for n, m in jaccard._LEAST.items())
    assert lost == 0 and jaccard._LEAST[128] > 40


# --- toxicity -------------------------------------------------------------------------------------


def test_toxicity_and_identity_swaps(spark):
    rng = random.Random(3)
    texts, toxic = [None, ""], [0, 0]
    for i in range(600):
        bad = i % 4 == 0
        words = prose(rng, 30).replace("w", "word ").split()
        words += (["scum", "worthless"] if bad else []) + (["muslims"] if i % (6 if bad else 20) == 0 else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(None, 1, 1), (9999, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].predicted == toxic[i] for i in held)
    a, b = model.score(pa.array(["the muslims are here", "the christians are here"]))
    assert abs(a - b) < 0.02 and a < 0.5
    assert toxicity.swapped("Muslims and WOMEN") == "christians and men" and toxicity.swapped("none") is None
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert {r.predicted for r in none} <= {0, 1} and all(0 <= r.score <= 1 for r in none)
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    passage = prose(rng, 40)
    texts = [prose(rng, 200) for _ in range(20)]
    texts += [edited(rng, texts[0], 1), texts[1], texts[2] + " x", " ".join(texts[3].split(" ")[:40]) + " " + passage + " " + prose(rng, 60), prose(rng, 100) + " password=abcdef123 " + prose(rng, 20), "too short", None]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    kept = []
    for name, step in cp.STAGES[:-1]:
        made = common.stage(step(spark, docs, str(tmp_path)), "test")
        assert made.columns == docs.columns
        docs = made
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == set(range(25)) and set(kept[1]) == set(range(25)) - {20, 21, 22}
    assert all(len(t.split()) for t in kept[2].values()) and "[assign]" in kept[3][24] and "abcdef123" not in kept[3][24]
    assert kept[2][23] != texts[23]
    run = cp.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in run} == set(kept[3])
