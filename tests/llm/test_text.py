"""The text operators against brute force on small tables, edge cases, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from driftlens.llm import bagminhash, decontam, langid, lines, mixing, quality, rules, substring, suffixes, toxicity
from driftlens.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edge_texts() -> list:
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 3)))
    base = [word() for _ in range(150)]
    out = [None, "", " \n\t ", " ".join(base), " ".join(base), "x " * 200, "x " * 170, "y", "  " + " ".join(base[20:90]) + "\n"]
    out += [" ".join(base[:60] + [word() for _ in range(30)] + base[60:]), " ".join(word() for _ in range(4000))]
    for _ in range(25):
        a, n = rnd.randrange(100), rnd.randint(10, 80)
        out.append(" ".join([word() for _ in range(rnd.randint(0, 30))] + base[a : a + n] + [word() for _ in range(rnd.randint(0, 30))]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 7, "clash") for i, t in enumerate(edge_texts())]
    rows.append(rows[3])
    rows.append((None, rows[3][1], None, None, None, None))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words int, anchor string").repartition(5)


def late_units(units: list[list], window: int) -> list[list[bool]]:
    first: dict = {}
    for i, u in enumerate(units):
        for k in range(len(u) - window + 1):
            first.setdefault(tuple(u[k : k + window]), i)
    out = []
    for i, u in enumerate(units):
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if first[tuple(u[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append(gone)
    return out


def test_substring(docs):
    ws = [WORD.findall(t or "") for t in edge_texts()]
    gone = late_units(ws, 50)
    for r in substring.drop_repeats(docs).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        kept = " ".join(w for w, g in zip(ws[r.doc_id], gone[r.doc_id]) if not g)
        assert (r.n_words, r.n_removed, r.kept) == (len(ws[r.doc_id]), sum(gone[r.doc_id]), kept), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_suffixes(docs):
    bs = [list((t or "").encode()) for t in edge_texts()]
    gone = late_units(bs, 50)
    for r in suffixes.drop_repeats(docs).collect():
        if r.doc_id is not None:
            b, g = bs[r.doc_id], gone[r.doc_id]
            spans = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), sum(g), spans, bytes(x for x, y in zip(b, g) if not y))


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(5)
    for alphabet in (1, 2, 4):
        body = [rnd.integers(2, 2 + alphabet, n) for n in rnd.integers(1, 60, 12)]
        s = np.concatenate([np.r_[b, 1] for b in body] + [[0]]).astype(np.int16)
        key = [(0,) if c == 0 else None for c in s]
        rank = iter(range(1, 1 + len(body)))
        big = [int(c) * 1000 if c > 1 else (next(rank) if c == 1 else 0) for c in s]
        assert key and suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: big[i:])


def test_lines(spark, docs):
    shared = "  Read MORE here \t"
    rows = [(i, f"own {i}\n{shared}\nend {i}\n") for i in range(10)] + [(10, None), (11, ""), (12, "read more HERE\n\nÀ")]
    got = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[0].n_lines, got[0].n_dropped, got[0].text) == (4, 1, "own 0\nend 0\n")
    assert (got[10].n_lines, got[10].n_dropped, got[10].text) == (1, 0, "") and got[12].text == "\nÀ"
    assert lines.drop_repeated_lines(docs).count() == docs.count()


def jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def near_classes(texts: list) -> dict[int, int]:
    ws = {i: WORD.findall(t or "") for i, t in enumerate(texts)}
    sh = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for i, w in ws.items()}
    of = {i: i for i in sh}
    for i in sh:
        for j in range(i):
            if (jaccard(sh[i], sh[j]) >= 0.8 or texts[i] == texts[j] is not None) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = {k: low if v == high else v for k, v in of.items()}
    return of


def test_near_duplicates(spark, docs):
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()} == near_classes(edge_texts())


def test_doubtful_pairs(spark, monkeypatch):
    """Variants of one text whose similarity is a little below or above the limit."""
    monkeypatch.setattr(bagminhash, "BLOCK", 3)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(24):
        w = list(base)
        for i in rng.sample(range(200), 2 + k % 2):
            w[i] = f"v{k}x{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df).collect()} == near_classes(texts)


def test_signatures_estimate_weighted_jaccard():
    rnd = np.random.default_rng(2)
    ids = rnd.integers(1, 1 << 60, 300).astype(np.uint64)
    ids.sort()
    a, b = rnd.integers(1, 9, 300), rnd.integers(1, 9, 300)
    sig = bagminhash.signatures(np.r_[np.zeros(300, int), np.ones(300, int)], np.r_[ids, ids], np.r_[a, b], 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_rules(docs):
    for r in rules.judge(docs).collect():
        if r.doc_id is None:
            continue
        t = edge_texts()[r.doc_id] or ""
        w = WORD.findall(t)
        win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(8)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(ls) - len(set(ls)))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_em_separates():
    patterns = [((1, 1, 1), 900), ((0, 0, 1), 60), ((0, 0, 0), 40), ((1, -1, 1), 50)]
    model = rules.fit(patterns)
    p = {v: rules.posterior(v, model) for v, _ in patterns}
    assert p[(1, 1, 1)] > 0.9 and p[(1, -1, 1)] > 0.9 and p[(0, 0, 0)] < 0.1
    assert all(g + w >= 1 for g, w in model[1])


def plain_em(votes: list[tuple[int, ...]], p: list[float], rounds: int):
    """EM document by document, from the definitions: log likelihood and posteriors."""
    k = len(votes[0])
    for _ in range(rounds):
        prior = min(0.999, max(0.001, sum(p) / len(p)))
        g, w = [], []
        for j in range(k):
            good, bad = sum(x for x, v in zip(p, votes) if v[j] != -1), sum(1 - x for x, v in zip(p, votes) if v[j] != -1)
            g.append((sum(x for x, v in zip(p, votes) if v[j] == 1) + 0.9) / (good + 1))
            w.append(min(0.999, max(1 + rules.ABOVE_CHANCE - g[j], (sum(1 - x for x, v in zip(p, votes) if v[j] == 0) + 0.5) / (bad + 1))))
        both = []
        for v in votes:
            a, b = prior, 1 - prior
            for j, x in enumerate(v):
                if x == 1:
                    a, b = a * g[j], b * (1 - w[j])
                elif x == 0:
                    a, b = a * (1 - g[j]), b * w[j]
            both.append((a, b))
        p = [a / (a + b) for a, b in both]
    return sum(np.log(a + b) for a, b in both), p


def test_em_against_plain_em():
    rnd = random.Random(8)
    votes = [tuple((rnd.random() < (0.9 if good else 0.2)) * 1 if rnd.random() < 0.8 else -1 for _ in range(5)) for good in [1] * 150 + [0] * 50]
    starts = [[0.05 if bad(v) else 0.95 for v in votes] for bad in (lambda v: 0 in v, lambda v: v.count(0) > 1, lambda v: v.count(0) > v.count(1))]
    want = max((plain_em(votes, p, 30) for p in starts), key=lambda x: x[0])[1]
    model = rules.fit(sorted(Counter(votes).items()), 30)
    assert [rules.posterior(v, model) for v in votes] == pytest.approx(want, abs=1e-9)


def test_rules_decide(spark):
    """Of the documents that pass the base limits the posterior rejects bad ones, and few others."""
    d = "/root/testdata/sf0.01"
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(r.kept, lab[r.doc_id]) for r in rules.judge(spark.read.parquet(f"{d}/documents.parquet")).collect() if not r.base_failed and r.doc_id in lab]
    rejected = [y for kept, y in got if not kept]
    assert rejected.count(0) >= 0.9 * len(rejected) > 0 and rejected.count(0) >= 0.8 * sum(y == 0 for _, y in got)


@pytest.mark.parametrize("part", [8 << 20, 40])
def test_decontamination(spark, docs, monkeypatch, part):
    monkeypatch.setattr(decontam, "PART_BYTES", part)
    base = WORD.findall(edge_texts()[3])
    items = [(1, " ".join(base[5:25]).upper()), (2, "x"), (3, None), (4, ".,;"), (10, " ".join(base[30:39])), (None, "y y")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    norm = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: norm.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    pats = [(str(i), tuple(w[k : k + min(10, len(w))])) for i, t in items if (w := words(t)) for k in range(len(w) - min(10, len(w)) + 1)]
    for r in decontam.find(docs, bench).where("doc_id is not null").collect():
        w, hit, named = words(edge_texts()[r.doc_id]), set(), set()
        for name, p in pats:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    named.add(name)
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(named - {"None"}))


def test_mixing(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 3}" if i % 7 else None) for i in range(400)] + [(400, "big " * 5, "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    a = mixing.measure_mix(df).collect()
    assert sorted(a) == sorted(mixing.measure_mix(df.repartition(7)).collect())
    target = {r.source_size: r.target for r in a}
    assert sum(target.values()) == pytest.approx(sum(target)) and all(t <= 3 * s + 1e-9 for s, t in target.items())
    assert all(r.taken <= 3 * r.size for r in a)
    assert mixing.mix(df).count() == sum(r.taken // r["size"] for r in a)


def test_classifiers(spark):
    d = "/root/testdata/sf0.01"
    lab = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for fit, label, least in ((quality, "quality", 0.85), (toxicity, "toxic", 0.85)):
        got = fit.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
        held = [(r.predicted, lab[r.doc_id][label]) for r in got if r.held_out and r.doc_id in lab]
        assert sum(a == b for a, b in held) / len(held) > least


def test_language(spark):
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.collect()}
    got = langid.identify(df).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97 and sum(r.rejected for r in got) < 0.02 * len(got)
    odd = langid.identify(spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "some words here", "en"), (4, "", None), *[(i, "some words here", "en") for i in range(5, 15)]], "doc_id bigint, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in odd.collect() if r.doc_id < 5} == {1: "und", 2: "und", 3: "en", 4: "und"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for df in (
        substring.drop_repeats(docs), suffixes.drop_repeats(docs), lines.drop_repeated_lines(docs), bagminhash.near_duplicates(docs), rules.judge(docs), decontam.drop_contaminated(docs, bench),
        mixing.measure_mix(docs), langid.identify(docs), quality.classify(docs, labels), toxicity.classify(docs, labels),
    ):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0.8 * n < out.count() <= n, name
        docs = out
    assert set(corpus_pipeline.run(spark, d).columns) == {*docs.columns, "copy"}
    assert "pipeline" in Q.QUERIES


def test_language_keeps_all_grams(spark):
    """A small language beside one with more than 2^20 more frequent 4-grams."""
    rng = np.random.default_rng(1)
    many = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 150_000))) for _ in range(8)]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    few = [letters[i] + "".join(rng.choice(letters, 60)) for i in range(20)]
    rows = [(i, "many", t) for i, t in enumerate(many * 2)] + [(100 + i, "small", t) for i, t in enumerate(few)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(4)
    model = langid.fit(df)
    got = langid.measured(df.where("doc_id >= 100"), model).select("lang_pred", langid.rejected(model).alias("r")).collect()
    assert len(got) == 20 and all(r.lang_pred == "small" and not r.r for r in got)


def test_language_parts(spark, monkeypatch):
    """A model in parts gives what the model in one part gives."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    whole = {r.doc_id: r for r in langid.measured(df, langid.fit(df)).collect()}
    monkeypatch.setattr(langid, "PART_CELLS", 5000)
    model = langid.fit(df)
    assert len(model["parts"]) > 3
    for r in langid.measured(df, model).collect():
        w = whole[r.doc_id]
        assert (r.lang_pred, r.n_letters) == (w.lang_pred, w.n_letters) and r.cross_entropy == pytest.approx(w.cross_entropy, abs=1e-9)


def test_toxic_texts_are_found(spark):
    """Held-out recall, and no rows of the sample on the driver: vectors alone come back."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["vile scum", "rotten pig"] if i % 8 == 0 and k % 5 == 0 else ["calm", "river", "stone", "garden", "letter"]) for k in range(40))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    got = [(r.predicted, int(r.doc_id % 8 == 0)) for r in toxicity.classify(docs, labels).collect() if r.held_out]
    assert toxicity.PER_CLASS >= 3000 and toxicity.ROUNDS >= 80
    assert sum(a and b for a, b in got) >= 0.9 * sum(b for _, b in got) > 0


def test_toxic_gradients_add_up(spark):
    rows = [(i % 3, i % 2, np.arange(i, i + 4, dtype=np.int32).tobytes()) for i in range(12)]
    df = spark.createDataFrame(rows, "part int, y int, slots binary").repartition(5)

    def vector(batch):
        flat, _, y = toxicity._rows(batch)
        return np.r_[np.bincount(flat, minlength=16), y.sum()].astype(float)

    got = sum(toxicity.added(df, vector))
    assert got.tolist() == [*np.bincount(np.concatenate([np.arange(i, i + 4) for i in range(12)]), minlength=16), 6]
