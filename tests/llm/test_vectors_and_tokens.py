"""Byte-level BPE, whitening and vector codes against the published library and brute force, and on odd rows."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sizeladder.llm import bpe, exact, vector_codes, whitening
from test_text_operators import DOC, LONG, odd_rows

VECTORS = "vec_id bigint, embedding array<double>, label int, _id string, x int, y int, code string, n int, part int, error string"
EXTRA = ("clash", 1, 2, "z", 3, 4, "w")


# --- byte-level BPE ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder()


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=40), st.data())
@settings(max_examples=60, deadline=None)
def test_segment_tree_finds_the_leftmost_minimum(ranks, data):
    tree = bpe.SegmentTree(ranks)
    for _ in range(10):
        here = [(r, i) for i, r in enumerate(ranks) if r is not None]
        assert tree.first() == (min(here)[1] if here else None)
        place, rank = data.draw(st.integers(0, len(ranks) - 1)), data.draw(st.one_of(st.none(), st.integers(0, 9)))
        ranks[place] = rank
        tree.put(place, rank)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(library, encoder, text):
    assert ids_of(encoder([text])[0]) == library.encode_ordinary(text)


def test_ids_where_unicode_versions_differ(library, encoder):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [glue.join(points[i:i + 400]) for i in range(0, len(points), 400) for glue in ("", " ", "a1")]
    assert [ids_of(p) for p in encoder(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 70_000, "ab" * 20_000 + "  x", "!" * 30_000, " " * 30_000 + "b", "\n \n" * 5_000, LONG])
def test_long_matches_and_texts(library, encoder, text):
    assert ids_of(encoder([text])[0]) == library.encode_ordinary(text)


def test_both_merges_agree(encoder):
    rnd = random.Random(4)
    pieces = ["".join(rnd.choice("abcdeinrst") for _ in range(rnd.randint(33, 64))).encode() for _ in range(300)]
    pieces = [p for p in pieces if p not in encoder.ranks]
    side = bpe.merge_side_by_side(pieces, 64, encoder.table)
    assert [ids_of(p) for p in side] == [bpe.merge(p, encoder.ranks) for p in pieces]


def test_a_small_memory_changes_nothing(library, encoder, spark, sf, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 20)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = [p for i in range(0, len(texts), 7) for p in encoder(texts[i:i + 7])]
    assert [ids_of(p) for p in got] == [library.encode_ordinary(t) for t in texts]


def test_tables_are_encoded_and_decoded(library, spark):
    docs = spark.createDataFrame(odd_rows(), DOC).repartition(3)
    out = bpe.decode(bpe.encode(docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in odd_rows()), key=key)
    assert sorted(((r["doc_id"], ids_of(r["ids"]), bytes(r["decoded"])) for r in out), key=key) == want
    assert bpe.decode(bpe.encode(spark.createDataFrame([], DOC))).count() == 0
    nothing = bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids binary")).first()
    assert nothing["decoded"] is None


def test_registered_encoding(library, spark, sf):
    from sizeladder.llm.queries import QUERIES
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op11_byte_level_bpe"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# --- exact sums --------------------------------------------------------------------------------------

@pytest.mark.parametrize("most", [5, 2 ** 19, 2 ** 31, 2 ** 62])
def test_products_and_limbs_are_exact(most):
    rnd = random.Random(most)
    a = np.array([[rnd.randint(-most, most) for _ in range(3)] for _ in range(9000)], dtype=np.int64)
    want = a.astype(object).T @ a.astype(object)
    assert (exact.products(a, a) == want).all()
    rows = exact.limb_rows([(0,), (1,), (2,)], [int(v) for v in want[0]])
    back = [sum(v << (exact.LIMB * k) for p, k, v in rows if p == i) for i in range(3)]
    assert back == want[0].tolist()


# --- whitening ---------------------------------------------------------------------------------------

def slow_polynomial(m):
    """Faddeev-LeVerrier with fractions."""
    d = len(m)
    a = [[Fraction(int(v)) for v in row] for row in m]
    c, b = [Fraction(1)], [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        ab = [[sum(a[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(ab[i][i] for i in range(d)) / k)
        b = [[ab[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(v) for v in reversed(c)]


def scatters():
    rnd = np.random.RandomState(3)
    x = rnd.randint(-50, 50, (30, 6)).astype(object)
    low = x.copy()
    low[:, 3] = low[:, 1]
    low[:, 4] = 0
    return {"full": x.T @ x, "rank four": low.T @ low, "equal roots": np.diag([7, 7, 7, 2, 0, 9]).astype(object),
            "one": np.array([[5]], dtype=object), "huge": (x.T @ x) * 10 ** 40, "zero": np.zeros((3, 3), dtype=object),
            "blocks": np.kron(np.eye(3, dtype=int), np.array([[4, 1], [1, 4]])).astype(object)}


@pytest.mark.parametrize("name", sorted(scatters()))
def test_polynomial_roots_and_components(spark, name):
    m = scatters()[name]
    poly = whitening.characteristic_polynomial(spark, m)
    assert poly == slow_polynomial(m)
    if name == "zero":
        return
    scale = float(np.trace(m))
    values, vectors = np.linalg.eigh(m.astype(float))
    positive = sorted(v for v in values if v > 1e-9 * scale)[::-1]
    roots = whitening.largest_roots(poly, 4)
    got = [a / 2 ** s for a, s in roots]
    assert np.allclose(got, positive[:4], rtol=1e-10)
    units, bits = whitening.null_vectors(m, roots)
    v = np.array([[int(x) / 2 ** bits for x in u] for u in units])
    assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-14
    assert np.abs(v @ (m.astype(float)) - np.array(got)[:, None] * v).max() < 1e-12 * scale


def vector_rows(d=8, n=60, seed=5, spread=1.0):
    rnd = np.random.RandomState(seed)
    mix = rnd.normal(size=(d, d)) * spread
    rows = [(int(i), [float(v) for v in rnd.normal(size=d) @ mix], int(i % 3), *EXTRA) for i in range(n)]
    rows += [rows[4], (None, rows[5][1], None, *EXTRA), (7, rows[8][1], None, *EXTRA), (n, None, 1, *EXTRA),
             (n + 1, [math.nan] + [0.0] * (d - 1), 1, *EXTRA), (n + 2, [math.inf] + [0.0] * (d - 1), 1, *EXTRA),
             (n + 3, [None] + [0.0] * (d - 1), 1, *EXTRA)]
    return rows


def usable_rows(rows):
    return [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


@pytest.mark.parametrize("d, spread", [(8, 1.0), (20, 1.0), (5, 1e6), (8, 1e12)])
def test_whitening_against_dense_eigenvectors(spark, d, spread):
    rows = vector_rows(d, spread=spread)
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    kept = usable_rows(rows)
    k = min(16, d)
    assert len(out) == k * len(kept)
    x = [[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in kept]
    fit = [list(t) for t in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(row, sums)] for row in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    want = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(row, sums)] for row in x]) @ vectors / np.sqrt(values)
    by_row = defaultdict(list)
    for r in out:
        by_row[r["vec_id"], r["deviation"]].append(r)
    sign = None
    for r, w, e in zip(kept, want, dev):
        mine = sorted(by_row[r[0], e if e < 2 ** 63 else None], key=lambda q: q["component"])
        got = np.array([q["whitened"] for q in mine]).reshape(-1, k, order="F") if len(mine) == k else None
        if got is None:
            continue  # rows of one id are looked at by their covariance below
        sign = np.sign(got[0] * w) if sign is None else sign
        assert np.allclose(got[0] * sign, w, atol=1e-6)
    assert {r["n"] for r in out} == {n} and len({r["identity_error"] for r in out}) == 1
    assert out[0]["identity_error"] < 1e-10
    shares = {r["component"]: r["explained"] for r in out}
    assert np.allclose([shares[c + 1] for c in range(k)], values / np.trace(centred.T @ centred / n), rtol=1e-8)
    first = {}
    for r in out:  # covariance over one row per distinct vector
        first[r["vec_id"], r["component"]] = r["whitened"]
    ids = {tuple(v): r[0] for v, r in zip(x, kept)}
    white = np.array([[first[i, c + 1] for c in range(k)] for i in ids.values() if i not in (None, 7)])
    if len(white) == n:
        assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8


def test_whitening_without_variance_or_rows(spark):
    table = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(table([])).count() == 0
    assert whitening.whiten(table([(1, [1.0, 2.0], 0, *EXTRA)] * 3)).count() == 0
    assert whitening.whiten(table([(1, [], 0, *EXTRA)])).count() == 0
    flat = whitening.whiten(table([(i, [float(i), 3.0, float(i)], 0, *EXTRA) for i in range(5)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 5
    assert abs(sum(r["whitened"] ** 2 for r in flat) / 5 - 1) < 1e-12
    huge = whitening.whiten(table([(i, [1e300 * (i - 2), float(i)], 0, *EXTRA) for i in range(5)])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 2} == {None} and huge[0]["identity_error"] < 1e-4
    with pytest.raises(Exception, match="width"):
        whitening.whiten(table([(1, [1.0, 2.0], 0, *EXTRA), (2, [1.0], 0, *EXTRA)])).count()


# --- vector codes ------------------------------------------------------------------------------------

def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(r[0], r[2], [max(-2 ** 62, min(2 ** 62, math.floor(scale * v))) for v in r[1]]) for r in usable_rows(rows)]
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[list(cut(r[2], p)) for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for r in kept:
                members[nearest(r[2], p)[1]].append(cut(r[2], p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if members[k] else e for k, e in enumerate(books[p])]
    out = []
    for i, label, v in kept:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    sums = defaultdict(int)
    for r in out:
        sums[r[1]] += r[3] if r[3] < 2 ** 63 else 2 ** 63
    fits = lambda v: v if v < 2 ** 63 else None
    sha = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    return sorted(((str(i), code, fits(e), fits(sums[label]), sha) for i, label, code, e in out), key=str)


def our_codes(table):
    coded, books = vector_codes.compress(table)
    out = vector_codes.label_errors(coded).withColumn("code", vector_codes.code_text("code")).collect()
    return sorted(((str(r["vec_id"]), r["code"], r["error"], r["label_error"], books.sha256()) for r in out), key=str)


@pytest.mark.parametrize("n, d, spread", [(60, 16, 1.0), (300, 8, 0.002), (9, 8, 1.0), (120, 24, 1e6), (40, 8, 0.0)])
def test_codes_equal_full_rounds(spark, n, d, spread):
    rows = vector_rows(d, n, spread=spread)
    got = our_codes(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert got == brute_codes(rows)


def test_codes_beyond_double_precision(spark):
    rows = [(i, [(i * 7919 % 101) * 1e9 + k for k in range(8)], i % 2, *EXTRA) for i in range(50)]
    assert our_codes(spark.createDataFrame(rows, VECTORS)) == brute_codes(rows)


def test_moved_entries_are_all_that_is_looked_at():
    """A kept distance is trusted: a wrong one for an entry that stayed shows in the result, for one that moved it does not."""
    x = np.array([[0], [10], [20]], dtype=np.int64)
    code, distance = vector_codes.assign(x, [[0], [10], [21]], [False, False, True], np.array([0, 1, 2]), np.array([500, 0, 999]))
    assert code.tolist() == [2, 1, 2] and distance.tolist() == [441, 0, 1]
    tie, _ = vector_codes.assign(np.array([[5]]), [[0], [10]], [True, False], np.array([1]), np.array([25]))
    assert tie.tolist() == [0]  # equally far: the lower entry
    tie, _ = vector_codes.assign(np.array([[5]]), [[0], [10]], [False, True], np.array([0]), np.array([25]))
    assert tie.tolist() == [0]


def test_codes_of_nothing_and_of_odd_widths(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert vector_codes.label_errors(coded).count() == 0 and books.entries == [[]] * 8
    with pytest.raises(ValueError, match="do not divide"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 0, *EXTRA)], VECTORS))
