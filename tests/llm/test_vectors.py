"""Operators 11 to 13 against plain recomputations and on odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from driftlens.llm import codes, merkle, tiles
from driftlens.llm import queries as Q

VECTORS = "vec_id bigint, embedding array<{kind}>, label int, n_links string, h1 int, v string"


def links_of(rows, threshold=0.9):
    """id -> (links, component, kept) by all pairs."""
    ok = [r is not None and len(r) > 0 and all(x is not None and math.isfinite(x) for x in r) and any(r) for _, r in rows]
    unit = [np.array(r, float) / np.abs(r).max() if k else None for (_, r), k in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        best.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        least = min((x for x in best[find(i)] if x is not None), default=None)
        out.append((k, n[i], least, k is not None and k == least))
    return sorted(out, key=str)


def near(df, **kw):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in tiles.near_vectors(df, **kw).collect()), key=str)


def crowd(rnd, n, d):
    """Copies, near copies in a dense group, a chain, scaled copies and strangers."""
    base, other = rnd.normal(size=d), rnd.normal(size=d)
    rows = [base.copy() for _ in range(n // 5)] + [base + rnd.normal(size=d) * 0.05 for _ in range(n // 3)]
    chain = other.copy()
    for _ in range(n // 10):
        chain = chain + rnd.normal(size=d) * 0.25
        rows.append(chain)
    rows += [other * 1e-200, other * 1e150, -other] + [rnd.normal(size=d) for _ in range(n // 3)]
    return rows


@pytest.mark.parametrize("tile", [16, 1024])
def test_links_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "BLOCK_BYTES", 40 * 12 * 8)
    rnd = np.random.default_rng(tile)
    x = crowd(rnd, 200, 12)
    rows = [(int(i), v.tolist()) for i, v in zip(rnd.permutation(len(x)), x)]
    df = spark.createDataFrame([(i, v, 1, "n", 2, "v") for i, v in rows], VECTORS.format(kind="double")).repartition(5)
    assert near(df) == links_of(rows)
    assert near(df, threshold=0.5) == links_of(rows, 0.5)


def test_odd_vectors_link_as_stated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.02]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (None, [-1.0, -1.0]), (None, None)]
    df = spark.createDataFrame([(i, v, None, "n", 2, "v") for i, v in rows], VECTORS.format(kind="double"))
    assert near(df) == links_of(rows)
    assert near(df.limit(0)) == []


def test_a_pair_on_the_threshold(spark):
    """cos = 0.8 in exact arithmetic counts at 0.8, a hair less does not."""
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.6 + 1e-12, 0.8])]
    got = dict((r[0], r[1]) for r in near(spark.createDataFrame([(i, v, 0, "", 0, "") for i, v in rows], VECTORS.format(kind="double")), threshold=0.8))
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_most_tiles_stop_at_the_leading_components():
    """Strangers cost one product over the leading components only."""
    rnd = np.random.default_rng(3)
    rows = {"first": np.arange(300), "h1": np.arange(300), "h2": np.arange(300), "n": np.ones(300, np.int64)}
    v = rnd.normal(size=(300, 64)) * np.linspace(3, 0.1, 64)
    raw = {k: x.astype(np.int64).tobytes() for k, x in rows.items()} | {"sizes": np.full(300, 64, np.int32).tobytes(), "v": v.tobytes(), "wide": 8}
    b = tiles.Block(raw, "", np.eye(64), [16, 32, 64])
    reached = (b.head @ b.head.T >= 0.9).sum() - 300
    full = (b.x @ b.x.T >= 0.9).sum() - 300
    assert full <= reached < 0.02 * 300 * 300
    found = sum(len(i) for i, _ in tiles.tile_links(b, b, [16, 32, 64], 0.9))
    assert 2 * found == full


def plain_lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """vec ids in order -> (code, error), and the books, in Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(rows[0][1])
    wide = -(-d // parts)
    ints = [[max(-(1 << 62), min(1 << 62, math.floor(x * scale))) for x in v] + [0] * (wide * parts - d) if len(v) == d else None for _, v in rows]
    usable = [i for i in ints if i is not None]
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(v, p) for v in usable[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        at = [[place(v, p) for p in range(parts)] for v in usable]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, a in zip(usable, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for (i, _), v in zip(rows, ints):
        if v is None:
            out.append((i, None, None))
        else:
            code = [place(v, p) for p in range(parts)]
            out.append((i, code, min(sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code)), (1 << 63) - 1)))
    return sorted(out, key=str), [x for b in books for e in b for x in e]


def coded(df, **kw):
    done = codes.compress(df, **kw)
    return sorted(((r.vec_id, r.codes, r.error) for r in done.rows.collect()), key=str), [int(x) for x in done.codebooks.ravel()], done


@pytest.mark.parametrize("kind,scale", [("float", 1.0), ("double", 1e12)])
def test_lloyd_against_plain_integers(spark, kind, scale):
    """Small components in doubles, large ones in Python's integers; hot entry, salted runs."""
    rnd = np.random.default_rng(5)
    x = np.r_[rnd.normal(size=(90, 20)), np.tile(rnd.normal(size=20), (60, 1))] * scale
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    rows = [(int(i), v.tolist()) for i, v in zip(rnd.permutation(len(x)), x)]
    df = spark.createDataFrame([(i, v, i % 3, "n", 2, "v") for i, v in rows], VECTORS.format(kind=kind)).repartition(4)
    got, books, done = coded(df)
    want, want_books = plain_lloyd(rows)
    assert got == want and books == want_books
    assert done.moves[0] == 8 * len(rows) and all(m < done.moves[0] for m in done.moves[1:])


def test_odd_vectors_are_coded_as_stated(spark):
    rows = [(5, [1.0, 2.0, 3.0]), (1, [0.5, 0.5, 0.5]), (2, None), (3, [float("nan"), 1.0, 1.0]), (4, [None, 1.0, 1.0]), (6, [1.0]), (None, [9.0, 9.0, 9.0]), (1, [0.25, 0.5, 0.5]), (7, [1e300, -1e300, 0.0]), (8, [])]
    df = spark.createDataFrame([(i, v, None if i == 5 else 1, "n", 2, "v") for i, v in rows], VECTORS.format(kind="double"))
    got, books, done = coded(df)
    want, want_books = plain_lloyd(rows)
    assert got == want and books == want_books
    shown = codes.label_errors(done.rows.where("vec_id <> 7")).select("vec_id", codes.code_text().alias("code"), "label_error").collect()
    assert all((r.code is None) == (r.vec_id in (6, 8)) and (r.code is None or len(r.code) == 16) for r in shown)
    assert coded(df.limit(0))[:2] == ([], [])
    equal = spark.createDataFrame([(i, [1.0] * 8, None, "", 0, "") for i in range(50)], VECTORS.format(kind="double"))
    assert {tuple(r[1]) for r in coded(equal)[0]} == {(0,) * 8}


def test_few_members_move(spark):
    """A part that stays with its entry is not in the next shuffle."""
    done = codes.compress(Q.table(spark, "/root/testdata/sf0.01", "embeddings"))
    assert done.moves == sorted(done.moves, reverse=True) and done.moves[-1] < done.moves[0] / 10


H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf) -> (subroot, root, siblings' hash, folded, verified), with plain lists."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(enc(v) for v in r))
    trees: dict = {}
    for r in rows:
        trees.setdefault("" if r[2] is None else "+" + r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def walk(made, i):
        for level in made[:-1]:
            run = level[i // 2 * 2 : i // 2 * 2 + 2]
            yield run[:i % 2], run[i % 2 + 1 :]
            i //= 2

    made = {}
    for t in sorted(trees, key=str.encode):
        trees[t].sort(key=lambda x: x[:3])
        made[t] = levels([x[2] for x in trees[t]])
    top = levels([made[t][-1][0] for t in made])
    out = []
    for k, t in enumerate(made):
        for i, (_, _, h, r) in enumerate(trees[t]):
            steps = [*walk(made[t], i), *walk(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            fold = leaf((*r[:3], r[3] + 1, r[4])) if bad else h
            for left, right in steps:
                fold = H("".join([*left, fold, *right]))
            out.append((r[0], h, made[t][-1][0], top[-1][0], H("".join(x for s in steps for side in s for x in side)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_rows():
    rows = [(i, "s" if i % 4 else None, ["en", "de", None, "x", "é"][min(4, i % 9)], i * 3 if i % 5 else None, "text é " * (i % 3) if i % 7 else None) for i in range(150)]
    return rows + [rows[3], rows[3], (None, None, None, None, None), (None, "a", "en", 1, ""), (8, "other", "x", 1, "y"), (9999, "s", "alone", 2, "long " * 50_000)]


@pytest.mark.parametrize("span", [1, 2, 3, 10])
def test_manifest_against_plain_lists(spark, monkeypatch, odd_rows, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    monkeypatch.setattr(Q, "table", lambda *_: spark.createDataFrame([(*r, "z", 1.5) for r in odd_rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, path string, digest double").repartition(4))
    got = sorted((tuple(r) for r in Q.op13_merkle_manifest(spark, "").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == plain_manifest(odd_rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_small_manifests(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    assert merkle.build(spark.createDataFrame([], schema)).root is None
    one = merkle.build(spark.createDataFrame([(1, "s", "en", 3, "abc")], schema))
    path = merkle.prove(one).collect()
    assert len(path) == 1 and path[0].path == [] and path[0].digest.hex() == one.root == H("1:11:s2:en1:33:abc")
    assert merkle.prove(merkle.build(spark.createDataFrame([], schema))).count() == 0
