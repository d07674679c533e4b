"""What goes into operator 3's suffix arrays, and what comes out of them, on bodies of bytes."""

import random

import numpy as np
import pyarrow as pa

from driftlens.llm import suffixes, textkit


def letters(rnd: random.Random, n: int, alphabet: str = "etaoinshrdlu ") -> bytes:
    return "".join(rnd.choice(alphabet) for _ in range(n)).encode()


def late(doc: list, bodies: list, window: int) -> list:
    """Brute force: (body, place) of windows that an earlier document has too."""
    first: dict = {}
    places = [(i, k, b[k : k + window]) for i, b in enumerate(bodies) for k in range(len(b) - window + 1)]
    for i, _, w in places:
        first[w] = min(first.get(w, doc[i]), doc[i])
    return [(i, k) for i, k, w in places if first[w] < doc[i]]


def found(doc: list, bodies: list, window: int) -> list:
    seg, at, n = suffixes.resolve(np.array(doc), pa.array(bodies, pa.large_binary()), window)
    assert n.tolist() == [max(0, len(b) - window + 1) for b in bodies]
    return list(zip(seg.tolist(), at.tolist()))


def test_only_shared_stretches_enter_suffix_arrays(monkeypatch):
    """A phrase of 30 bytes brings all bodies together, but no array is made of them."""
    rnd = random.Random(9)
    phrase, passage = letters(rnd, 30), letters(rnd, 80)
    bodies = [letters(rnd, 60) + phrase + letters(rnd, 60) for _ in range(60)]
    sizes, whole = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda s: sizes.append(len(s)) or whole(s))
    assert found(list(range(60)), bodies, 50) == [] and not sizes
    for i in (7, 20, 41):
        bodies[i] += passage
    got = found(list(range(60)), bodies, 50)
    assert got == late(list(range(60)), bodies, 50) and {i for i, _ in got} == {20, 41}
    assert 3 * 80 < sum(sizes) < 3 * 120


def test_late_windows_equal_brute_force():
    """Few letters, copies longer than 64 bytes, shared bytes at edges, one document's bodies."""
    rnd = random.Random(4)
    for n in range(40):
        alphabet, window = ("a", "ab", "abc", "etaoinshrdlu ")[n % 4], rnd.choice([5, 10, 50])
        base = letters(rnd, 700, alphabet)
        bodies = [b"", b"a", base, base]
        for _ in range(20):
            a, m = rnd.randrange(600), rnd.randint(0, 400)
            bodies.append(letters(rnd, rnd.randint(0, 70), alphabet) + base[a : a + m] + letters(rnd, rnd.randint(0, 70), alphabet))
        doc = [rnd.randint(-3, 12) for _ in bodies]
        assert found(doc, bodies, window) == late(doc, bodies, window), (n, alphabet, window)


def test_common_prefixes_of_long_copies():
    """Prefixes of every length around the steps in which they are compared."""
    rnd = random.Random(6)
    base = letters(rnd, 5000)
    parts = [base[:n] + bytes([200 + n % 7]) + letters(rnd, 5) for n in (0, 1, 7, 8, 9, 63, 64, 65, 127, 128, 500, 1023, 1024, 4000, 4999)] + [base, base]
    off = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]
    data = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8)
    s = data.astype(np.int16) + 2
    s[off[1:] - 1], s[-1] = 1, 0
    room = np.zeros(len(s), np.int32)
    for a, b in zip(off, off[1:]):
        room[a : b - 1] = np.arange(b - 1 - a, 0, -1)
    order = suffixes.suffix_array(s)
    got = suffixes.common_prefixes(data, room, order)
    for p, q in zip(order[1:].tolist(), order[:-1].tolist()):
        most = min(room[p], room[q])
        x, y = data[p : p + most], data[q : q + most]
        assert got[p] == (most if (x == y).all() else int(np.argmax(x != y)))


def test_runs_do_not_depend_on_blocks(monkeypatch):
    rnd = random.Random(8)
    texts = [letters(rnd, rnd.choice([0, 3, 49, 50, 51, 300, 2000]), "ab"[: rnd.randint(1, 2)]) for _ in range(80)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    runs = lambda: textkit.Runs(textkit.BYTE_VALUE[data], off[:-1], off[1:], 50, 24, 400)
    whole = runs()
    for block in (1, 60, 1000):
        monkeypatch.setattr(textkit, "BLOCK", block)
        cut = runs()
        for name in ("first", "last", "anchor", "doc"):
            assert (getattr(whole, name) == getattr(cut, name)).all() and len(whole.first) == len(cut.first)
    none = textkit.Runs(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 50, 24)
    assert not len(none.first) and not len(none.doc)
