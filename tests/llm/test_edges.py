"""Edge cases of every text operator and of the pipeline, each against its stated result."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from driftlens.llm import bagminhash, decontam, langid, lines, mixing, quality, repeats, rules, shared, substring, suffixes, symbols, toxicity
from driftlens.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_lines int, copy string, `odd name` array<int>"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns."""
    rnd = random.Random(11)
    shared_, long_ = prose(rnd, 70), prose(rnd, 30_000)
    texts = [None, "", " \n\t", "x", shared_, shared_, prose(rnd, 9) + " " + shared_, long_, long_ + " " + shared_, "\n".join(["same line"] * 50), "é" * 3000, "\u4e00 \U00020010 \U00030010", "\x00 \x1f"]
    rows = [(i, t, "en", "a" if i % 3 else None, 1, 0.5, 3, "c", [1]) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, shared_, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_odd_rows_pass_everywhere(spark, odd):
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (7, 1, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([("a", odd.where("doc_id = 4").first().text, 1), (None, "x", 2), ("n", None, 3)], "item_id string, text string, doc_id int")
    n = odd.count()
    for out in (
        substring.drop_repeats(odd), suffixes.drop_repeats(odd), lines.drop_repeated_lines(odd), rules.judge(odd), decontam.find(odd, bench), mixing.measure_mix(odd), langid.identify(odd),
        quality.classify(odd, labels), toxicity.classify(odd, labels),
    ):
        rows = out.collect()
        assert len(rows) == n and sum(r.doc_id is None for r in rows) == 2
        if "held_out" in out.columns:
            assert all(r.held_out is False for r in rows if r.doc_id is None) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in bagminhash.near_duplicates(odd).collect()} == set(range(13))
    assert bagminhash.near_duplicates(odd).count() == 13


def test_labels_of_one_kind_score_their_share(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.classify(odd, labels).collect()} == {1.0}
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}


def test_few_labels_are_learnt_from(spark):
    """One bad and three good texts; each text scores on the side of what it resembles."""
    rng = np.random.default_rng(3)
    good, bad = ([" ".join(rng.choice(words, 120)) for _ in range(6)] for words in (["river", "mountain", "weather", "garden", "silent", "morning"], ["zx91", "qq!!", "##%%", "vk07", "$$$$", "wj55"]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    for n_bad in (1, 3):
        labels = spark.createDataFrame([(i, 1) for i in range(3)] + [(6 + i, 0) for i in range(n_bad)], "doc_id bigint, quality int")
        model = quality.fit(docs, labels, F.lit(True))
        scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
        assert min(scores[i] for i in range(6)) > max(scores[i] for i in range(6, 12))


def test_quality_scores_equal_a_plain_recomputation(spark):
    """Differences of compressed sizes, their worst and worst quarter, and the scale."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    keep = shared.fold("doc_id", 5) != 0
    model = quality.fit(docs, labels, keep)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.where(keep).collect() if r.quality in (0, 1)}

    def size(data, which):
        dictionary = zstandard.ZstdCompressionDict(model[which])
        return len(zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False).compress(data))

    def features(data):
        n = max(1, round(len(data) / 256 + 1e-9))
        cuts = [i * 256 for i in range(n)] + [len(data)]
        pairs = [(size(data[a:b], "good"), size(data[a:b], "bad")) for a, b in zip(cuts[:-1], cuts[1:])]
        each = sorted((b - g) / (b + g) for g, b in pairs)
        g, b = (sum(p[i] for p in pairs) for i in (0, 1))
        quarter = each[: max(1, n // 4)]
        return [(b - g) / (b + g), each[0], sum(quarter) / len(quarter), 1.0]

    x = {i: features(t) for i, t in text.items()}
    for i in text:
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(np.dot(x[i], model["weights"]), -40, 40))), abs=1e-12)
    fitted = [i for k in (0, 1) for i in sorted(i for i, y in known.items() if y == k)[1::2]]
    y, z = np.array([known[i] for i in fitted]), np.array([x[i] for i in fitted])
    count = [sum(v == k for v in known.values()) for k in (0, 1)]
    weight = np.array([count[v] / (y == v).sum() for v in y])
    weight *= len(y) / weight.sum()
    scale = np.abs(z).max(0)
    w = model["weights"] * scale  # where the damped likelihood is greatest its slope is none
    slope = (z / scale).T @ (weight * (1 / (1 + np.exp(-z / scale @ w)) - y)) + 1e-2 * w
    assert np.abs(slope).max() < 1e-6


def test_nothing_is_removed_without_blocks_or_arrays(odd):
    """What brings texts together finds nothing by itself."""
    none = lambda doc, bodies, window: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(len(doc), 1 << 40))
    for unit in ("word", "byte"):
        got = repeats.late_spans(shared.texts(odd), unit, 50, 5, none).collect()
        assert not any(r.spans or r.found for r in got)


def test_repeats_in_long_texts_and_hot_passages(spark, monkeypatch):
    """A text over a shard's size, a passage in most texts, shards of every size."""
    monkeypatch.setattr(repeats, "HOT", 20)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1 << 12)
    monkeypatch.setattr(repeats, "LONG_KEY", 2)
    rnd = random.Random(5)
    hot, big = prose(rnd, 60), prose(rnd, 1500)
    texts = [prose(rnd, rnd.randint(0, 12)) + " " + (hot if i % 4 else prose(rnd, 40)) + " " + prose(rnd, rnd.randint(0, 12)) for i in range(120)]
    texts += [big, prose(rnd, 3) + " " + big[2000:6000], "ab " * 400, "b " + "ab " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    first: dict = {}
    for i, t in enumerate(texts):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for r in suffixes.drop_repeats(df).collect():
        b = texts[r.doc_id].encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = True
        assert bytes(r.kept) == bytes(x for x, g in zip(b, gone) if not g), r.doc_id
    seen: dict = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    for r in substring.drop_repeats(df).collect():
        w = WORD.findall(texts[r.doc_id])
        gone = {k + j for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] < r.doc_id for j in range(50)}
        assert r.kept == " ".join(x for k, x in enumerate(w) if k not in gone), r.doc_id


def test_texts_under_one_id_stay_apart(spark):
    rnd = random.Random(2)
    a, b, c = prose(rnd, 120), prose(rnd, 120), prose(rnd, 20)
    df = spark.createDataFrame([(1, a), (2, b), (2, c + " " + a)], "doc_id bigint, text string")
    got = {r.n_words: r.n_removed for r in substring.drop_repeats(df).collect() if r.doc_id == 2}
    assert got == {120: 0, 140: 120}
    assert {r.doc_id for r in bagminhash.near_duplicates(df).collect()} == {1, 2}


def test_two_of_each():
    body = pa.array([b"aa", b"b", b"aa", b"aa", b"c", b"aa"], pa.large_binary())
    enters, stands = repeats._two_of_each(body, np.array([3, 1, 1, 5, 2, 1]))
    assert sorted(enters.tolist())[:2] == [0, 1] and len(enters) == 4
    assert stands[2] == stands[5] and stands[0] == stands[3] != stands[2]


def test_lines_linear_and_clashing(spark):
    many = "\n".join(f"line {i}" for i in range(100_000))
    rows = [(i, many, 7, "x") for i in range(10)] + [(10, "own\nLINE 5 ", 1, "y"), (10, "own\nLINE 5 ", 1, "y"), (None, "line 6\nz", 1, "z"), (11, "n\nline 5", 1, None), (11, "line 7\nother", 1, None)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int, N_Dropped string").repartition(4)).collect()
    assert all((r.n_lines, r.n_dropped, r.text) == (100_000, 100_000, "") for r in got if r.doc_id is not None and r.doc_id < 10)
    assert [r.text for r in got if r.doc_id == 10] == ["own", "own"] and {r.text for r in got if r.doc_id == 11} == {"n", "other"}
    assert [r.text for r in got if r.doc_id is None] == ["z"]


def test_mixing_edges(spark):
    rows = [(1, None, "a", 5), (2, "", "a", 5), (3, "w w", "b", 5), (None, "w", None, 5), (4, "w", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy int")
    got = {(r.doc_id, r.source_size): r for r in mixing.measure_mix(df).collect()}
    assert got[(1, 0)].target == 0 == got[(2, 0)].taken
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "copy"] and out.where("copy < 0 or copy > 2").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0 == mixing.measure_mix(df.limit(0)).count()
    assert mixing.measure_mix(df.where("source = 'a'")).agg({"taken": "sum"}).first()[0] == 0


def test_near_duplicates_of_a_corpus(spark):
    """Classes of all texts at once against all pairs that share a shingle."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    bags, where = {}, {}
    for r in rows:
        w = WORD.findall(r.text or "")
        bags[r.doc_id] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        for s in bags[r.doc_id]:
            where.setdefault(s, []).append(r.doc_id)
    of = {i: i for i in bags}
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        x, y = bags[a], bags[b]
        if min(x.total(), y.total()) >= 0.8 * max(x.total(), y.total()) and (x & y).total() >= 0.8 * (x | y).total() and of[a] != of[b]:
            low, high = sorted((of[a], of[b]))
            of = {k: low if v == high else v for k, v in of.items()}
    got = bagminhash.near_duplicates(spark.createDataFrame(rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == of


def test_decontamination_edges(spark, odd, monkeypatch):
    schema = "item_id bigint, text string"
    assert decontam.drop_contaminated(odd, spark.createDataFrame([], schema)).count() == odd.count()
    assert decontam.find(odd, spark.createDataFrame([], schema)).where("n_hit > 0 or size(items) > 0").count() == 0
    passage = odd.where("doc_id = 4").first().text
    for part in (2 << 20, 40):
        monkeypatch.setattr(decontam, "PART_BYTES", part)
        bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, "never seen here at all"), (None, "x")], schema)
        clean = decontam.drop_contaminated(odd, bench)
        assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {None, 0, 1, 2, 7, 9, 10, 11, 12}
        assert {r.doc_id: r["items"] for r in decontam.find(odd, bench).collect()}[6] == ["1"]


def kneser_ney(texts: dict[str, list[str]], order: int = 4):
    """Interpolated Kneser-Ney from its definition, over letters and single blanks."""
    def symbols_of(t):
        return "_" * (order - 1) + "_".join(re.findall(r"[^\W\d_]+", t.lower())) + "_"

    grams = {x: Counter(s[i : i + order] for t in ts for s in [symbols_of(t)] if len(s) > order for i in range(len(s) - order + 1)) for x, ts in texts.items()}
    levels = {x: {order: g} for x, g in grams.items()}
    for x in levels:
        for n in range(order - 1, 0, -1):
            levels[x][n] = Counter(g[1:] for g in levels[x][n + 1])
    alphabet = len({g for x in levels for g in levels[x][1]}) + 1

    def p(x, gram):
        n = len(gram)
        if not n:
            return 1 / alphabet
        c = levels[x][n]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        total, kinds = sum(v for g, v in c.items() if g[:-1] == gram[:-1]), sum(g[:-1] == gram[:-1] for g in c)
        return (max(c[gram] - d, 0) + d * kinds * p(x, gram[1:])) / total if total else p(x, gram[1:])

    return lambda x, t: -sum(math.log(p(x, s[i : i + order])) for s in [symbols_of(t)] for i in range(len(s) - order + 1)) / (len(symbols_of(t)) - order + 1)


def test_language_model_against_its_definition(spark):
    texts = {"xx": ["ab abc cab", "abba cab bac", "a"], "yy": ["xyz zyx xx", "zy yx zz xyz"], "zz": ["only one text"]}
    rows = [(i, x, t) for i, (x, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)]
    want = kneser_ney(texts)
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    asked = ["abc ab", "zyx", "one", "abq xyz"]
    for r in langid.measured(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect():
        each = {x: want(x, r.text) for x in texts}
        assert r.lang_pred == min(each, key=each.get) and r.cross_entropy == pytest.approx(min(each.values()), abs=1e-5)


def test_letters_of_all_planes():
    raw = "\U00030010\U00010400\U00010428 1".encode()
    s, _ = symbols.symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 1)
    assert (s[1:4] != symbols.BLANK).all() and s[1] != s[2]


def test_quality_finds_the_bad(spark):
    """Held out: of the rare class enough is found, and little else is called so."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    for fit, label, rare, recall, precision in ((quality, "quality", 0, 0.75, 0.9), (toxicity, "toxic", 1, 0.75, 0.85)):
        held = [(r.predicted, known[r.doc_id][label], r.score) for r in fit.classify(docs.join(labels.select("doc_id"), "doc_id"), labels).collect() if r.held_out]
        said, hit = sum(a == rare for a, _, _ in held), sum(a == b == rare for a, b, _ in held)
        assert hit >= recall * sum(b == rare for _, b, _ in held) and hit >= precision * said
        up, down = (np.array([s for _, y, s in held if y == k]) for k in (1, 0))
        assert (up[:, None] > down[None]).mean() > 0.95


def test_sql(spark):
    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in Q.ORACLES.items():
        want = con.sql(sql)
        rows = sorted(map(repr, want.fetchall()))
        assert sorted(repr(tuple(r)) for r in Q.QUERIES[name](spark, d).select(*want.columns).collect()) == rows, name


# ---- the pipeline ----


def test_pipeline_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, d)
        after[name] = (before.collect(), docs.collect())
        docs = spark.createDataFrame(after[name][1], docs.schema)
    old, new = after["language_id"]
    assert len(new) >= 0.97 * len(old) and {tuple(r) for r in new} <= {tuple(r) for r in old}
    assert all(re.search(r"[^\W\d_]", r.text) for r in new)
    old, new = after["line_dedup"]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    often = Counter(k for r in old for k in {key(x) for x in (r.text or "").split("\n")} if k)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if not key(x) or often[key(x)] < 10) for r in old}
    assert {r.doc_id: r.text for r in new} == want and all(r.n_chars == len(r.text) for r in new)
    old, new = after["near_dedup"]
    bags = {}
    for r in old:
        w = WORD.findall(r.text or "")
        bags[r.doc_id] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    of = {i: i for i in bags}
    for a in bags:
        for b in bags:
            if a < b and bags[a] and (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total() and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    assert {r.doc_id for r in new} == set(of.values())
    old, new = after["decontamination"]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [w for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if (w := norm(r.text))]
    wanted = {tuple(w[k : k + min(10, len(w))]) for w in items for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(x) for x in wanted}
    clean = lambda t: not any(tuple(w[k : k + n]) in wanted for w in [norm(t)] for n in sizes for k in range(len(w) - n + 1))
    assert {r.doc_id for r in new} == {r.doc_id for r in old if clean(r.text)}
    old, new = after["mixing"]
    rate = {r.doc_id: (r.target / r.source_size, r.taken // max(1, r["size"])) for r in mixing.measure_mix(spark.createDataFrame(old)).collect()}
    copies = Counter(r.doc_id for r in new)
    assert all(copies[i] in (math.floor(x), math.floor(x) + 1) for i, (x, _) in rate.items())
    assert sorted((r.doc_id, r.copy) for r in new) == sorted((i, k) for i, n in copies.items() for k in range(n))


def test_pipeline_takes_odd_rows(spark, odd):
    docs = odd.drop("copy")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == odd.drop("copy").columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert out.columns == [*docs.columns, "copy"] and out.where("doc_id in (0, 1, 2, 12)").count() == 0
    empty = odd.drop("copy").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_hashes(spark, odd):
    for r in suffixes.drop_repeats(odd).collect():
        assert r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest()
