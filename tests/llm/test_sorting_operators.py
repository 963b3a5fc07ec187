"""Suffix-sort dedup, fill-in-middle and whitening against plain forms of their definitions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from paysift.llm import fim, suffix_dedup, whitening

WORDS = "ash birch cedar dogwood elm fir gorse hazel iris juniper kelp larch maple nettle oak pine quince rowan spruce thorn".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# suffix_dedup ---------------------------------------------------------------------------------------------------------

def brute_dedup(rows, length):
    """rows: (order key, bytes); a set of strings seen so far, start by start."""
    seen, out = set(), []
    for _, body in sorted(rows, key=lambda r: r[0]):
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            s = body[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        left = bytes(c for c, g in zip(body, gone) if not g)
        out.append((len(body), sum(gone), runs, hashlib.sha256(left).hexdigest(), left))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    passage, other = prose(rng, 60), prose(rng, 40)
    texts = [prose(rng, 80) for _ in range(12)]
    for i in range(14):  # a passage in different surroundings, near and exact copies
        texts.append(prose(rng, rng.randrange(0, 30)) + passage[i:] + prose(rng, 5))
    texts += [texts[0], texts[1][:200] + "X" + texts[1][200:], texts[2][3:], "", None, "short", other + " " + other, "a" * 500, "ab" * 180,
              "ü€𝄞" * 40, "x" * 99, "x" * 100, texts[3] + texts[4]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot", [8192, 2])
@pytest.mark.parametrize("parts", [1, 7])
def test_dedup_equals_brute_force(spark, hot, parts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    got = suffix_dedup.cut_out(docs, hot=hot).orderBy("doc_id").collect()
    want = brute_dedup([(i, (t or "").encode()) for i, t in enumerate(texts)], 100)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == [w[:4] for w in want]
    assert all((r["kept"] is None) == (w[1] == 0) and (r["kept"] is None or bytes(r["kept"]) == w[4]) for r, w in zip(got, want))
    assert sum(w[1] for w in want) > 5000


def test_dedup_short_length_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)  # a long text is cut into many overlapping parts
    rng = random.Random(5)
    line = prose(rng, 30)
    texts = [prose(rng, 900) + line, line + prose(rng, 500), "q" * 3000 + line, prose(rng, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = suffix_dedup.cut_out(docs, length=24, gram=8).orderBy("doc_id").collect()
    want = brute_dedup([(i, t.encode()) for i, t in enumerate(texts)], 24)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == [w[:4] for w in want]


def test_dedup_repeated_rows_null_ids_and_clashing_names(spark):
    rng = random.Random(7)
    a, b = prose(rng, 40), prose(rng, 40)
    names = ["h", "s", "k", "b", "at", "n", "lo", "hi", "sha", "id", "m", "p", "spans", "n_removed", "kept", "n_bytes"]
    rows = [(3, a), (3, a), (3, b), (None, b), (None, a + b), (9, a), (2, None)]
    docs = spark.createDataFrame([(i, t, *["z"] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.cut_out(docs).collect())
    order = sorted({(i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    by = {(o[0], o[1], o[3]): w for o, w in zip(order, brute_dedup([(o[:3], o[3].encode()) for o in order], 100))}
    want = sorted((i is not None, i or 0, *by[i is not None, i or 0, t or ""][:2]) for i, t in rows)
    assert got == want
    named = spark.createDataFrame([("x", a), ("y", a)], "doc_id string, text string")
    assert [(r["doc_id"], r["n_removed"]) for r in suffix_dedup.cut_out(named).orderBy("doc_id").collect()] == [("x", 0), ("y", len(a))]


def test_dedup_empty_table(spark):
    got = suffix_dedup.cut_out(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"] and got.count() == 0


@pytest.mark.parametrize("alphabet,length,shallow", [("ab", 40, 8), ("abc", 33, 24), ("a", 30, 16), ("abcdefgh", 24, 24), ("ab", 100, 24)])
def test_deep_shallow_sorts(alphabet, length, shallow):
    rng = random.Random(length)
    text = "".join(rng.choice(alphabet) for _ in range(1500)).encode()
    text += text[100:400] + b"\0" * 60 + b"\xff" * 60
    pos = np.arange(len(text) - length + 1)
    order, tied = suffix_dedup.deep_shallow(np.frombuffer(text, np.uint8), pos, length, shallow)
    want = sorted(range(len(pos)), key=lambda p: (text[p:p + length], p))
    assert order.tolist() == want
    assert tied.tolist() == [False] + [text[a:a + length] == text[b:b + length] for a, b in zip(want, want[1:])]


def test_blind_trie_orders_any_strings():
    rng = random.Random(3)
    for _ in range(200):
        strings = ["".join(rng.choice("ab") for _ in range(9)).encode() for _ in range(rng.randrange(1, 30))]
        trie = suffix_dedup.BlindTrie()
        for i, s in enumerate(strings):
            trie.add(s, i)
        assert [sorted(x) for x in trie.leaves()] == [[i for i, s in enumerate(strings) if s == u] for u in sorted(set(strings))]


def test_segments_hold_every_start_once():
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(0, 200)).encode() for _ in range(30)] + [b"a" * 400]
    offsets = np.cumsum([0, *map(len, texts)])
    found = set()
    for h, s, row, p, n in suffix_dedup.segments(offsets, np.frombuffer(b"".join(texts), np.uint8)):
        for r, at, count in zip(row.tolist(), p.tolist(), n.tolist()):
            new = {(r, x) for x in range(at, at + count)}
            assert not new & found
            found |= new
    assert found == {(r, x) for r, t in enumerate(texts) for x in range(len(t) - 99)}


# fim ------------------------------------------------------------------------------------------------------------------

def brute_fim(key, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    d = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i:8 * i + 8], 16) for i in range(4))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, sha(text), sha(text), text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text), out


def fim_texts():
    rng = random.Random(11)
    odd = ["", None, "\n", "\n\n\n", "one", "a\nb", "a\nb\n", "x<P>y\nz", "<S>", "<M>\n", "ü€𝄞\n" * 50, "tail without end\n\nlast", "<P", "\r\n a b\x0bc\n",
           "L" * 50_000 + "\nshort\n" + "M" * 40_000]
    return odd + ["\n".join(prose(rng, rng.randrange(0, 12)) for _ in range(rng.randrange(1, 40))) for _ in range(60)]


@pytest.mark.parametrize("parts,partitions,size", [(1, 1, fim.CHUNK), (5, 4, 50)])
def test_fim_equals_brute_force(spark, parts, partitions, size):
    texts = fim_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: tuple(r)[1:] for r in fim.transform(docs, partitions=partitions, size=size).collect()}
    assert got == {i: brute_fim(i, t or "")[:6] for i, t in enumerate(texts)}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}
    out = {r["doc_id"]: (r["form"], r["output"]) for r in fim.outputs(docs, partitions=partitions, size=size).collect()}
    assert out == {i: (brute_fim(i, t or "")[1], brute_fim(i, t or "")[6]) for i, t in enumerate(texts)}


def test_fim_restores_from_the_output_alone():
    """Digests of a changed output can't be those of the text: the restoration reads what was put out."""
    text = "a\nb\nc\nd\n"
    form, n, a, b = fim.plan(text, "5")
    stream = [((0, 0, *fim.HEAD), ("5", n, form, a, b - a)), *(((0, 0, 0, i), x) for i, x in enumerate(fim.pieces(text, form, a, b)))]
    good = list(fim.restored(sorted(fim.digested(stream), key=lambda x: x[0])))
    assert good[0][-1] == hashlib.sha256(text.encode()).hexdigest()
    bad = [(k, v.replace(b"c", b"!") if isinstance(v, bytes) else v) for k, v in stream]
    assert next(fim.restored(sorted(fim.digested(bad), key=lambda x: x[0])))[-1] == hashlib.sha256(text.replace("c", "!").encode()).hexdigest()


def test_fim_second_sort_moves_nothing(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, "c")], "doc_id long, text string")
    out = fim.sorted_pieces(fim.emitted(docs), 3)
    again = fim.sorted_pieces(out.mapPartitions(fim.digested, preservesPartitioning=True), 3)
    assert again.toDebugString().decode().count("PairwiseRDD") == 1


def test_fim_odd_rows(spark):
    names = ["_key", "k", "t", "n", "form", "output_sha256"]
    docs = spark.createDataFrame([(4, "a\nb\n", *"zzzzzz"), (4, "a\nb\n", *"zzzzzz"), (None, "q\nr", *"zzzzzz")], "doc_id int, text string, " + ", ".join(f"{c} string" for c in names))
    got = fim.transform(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[1:] for r in rows) == sorted([brute_fim(4, "a\nb\n")[:6]] * 2 + [brute_fim("null", "q\nr")[:6]])
    assert fim.transform(docs.limit(0)).count() == 0
    rates = [r["form"] for r in fim.transform(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text")), fim_percent=30, spm_percent=0).collect()]
    assert set(rates) == {"plain", "psm"} and 70 < rates.count("psm") < 170


# whitening ------------------------------------------------------------------------------------------------------------

def brute_white(vectors, p=8):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (x - s // n) - (s % n) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:p], u[:, ::-1][:, :p]
    return n, ((n * x.astype(object) - s) ** 2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def whitened(df):
    rows = sorted(df.collect(), key=lambda r: (r["vec_id"], r["component"]))
    ids = sorted({r["vec_id"] for r in rows})
    return rows, ids, np.array([r["whitened"] for r in rows]).reshape(len(ids), -1)


@pytest.mark.parametrize("d,parts", [(20, 1), (48, 6), (3, 2), (1, 1)])
def test_whitening_equals_numpy(spark, d, parts):
    rng = np.random.default_rng(d)
    v = rng.standard_normal((300, d)) * np.linspace(1, 3, d)
    docs = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(parts)
    rows, ids, z = whitened(whitening.whiten(docs))
    n, deviation, want, explained = brute_white(v)
    assert ids == list(range(300)) and z.shape == want.shape
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-9
    assert [r["deviation"] for r in rows][::want.shape[1]] == deviation.tolist() and {r["n"] for r in rows} == {n}
    assert np.allclose([r["explained"] for r in rows[:len(explained)]], explained, rtol=1e-10)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    schema = StructType([StructField("vec_id", StringType()), StructField("embedding", ArrayType(DoubleType())), StructField("x", LongType()), StructField("id", LongType())])
    rows = [("a", [1.0, 2.0, 0.5], 1, 1), ("a", [1.0, 2.0, 0.5], 1, 1), (None, [0.0, 1.0, 4.0], 1, 1), ("b", [3.0, -1.0, 0.0], 1, 1), ("n", None, 1, 1),
            ("o", [1.0, None, 2.0], 1, 1), ("p", [nan, 1.0, 1.0], 1, 1), ("q", [inf, 1.0, 1.0], 1, 1), ("r", [1.0], 1, 1), ("s", [], 1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted({r["vec_id"] or "" for r in got}) == ["", "a", "b"] and {r["n"] for r in got} == {4}
    # three different points span a plane: two components, and a row of each for every vector
    assert len(got) == 8 and max(r["component"] for r in got) == 2
    same = spark.createDataFrame([(str(i), [1.0, 1.0], 1, 1) for i in range(5)], schema)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0 and whitening.whiten(same.limit(1)).count() == 0


def test_whitening_large_numbers_stay_exact(spark):
    v = [[1e9, -3e8], [2e9, 5e8], [-1e9, 1.0]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit a long"):
        whitening.whiten(docs).collect()
    small = [[1e4, -3e3], [2e4, 5e3], [-1e4, 1.0]]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(small)), "vec_id long, embedding array<double>")).where("component = 1").orderBy("vec_id").collect()
    assert [r["deviation"] for r in got] == brute_white(small)[1].tolist()


@pytest.mark.parametrize("kind", ["plain", "clustered", "low rank", "equal"])
def test_jacobi_davidson_finds_the_leading_pairs(kind):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    e = {"plain": np.linspace(1, 50, 90), "clustered": np.concatenate([np.linspace(10, 10 + 1e-6, 80), np.linspace(20, 20.001, 10)]),
         "low rank": np.concatenate([np.zeros(86), [1, 2, 3, 4]]), "equal": np.concatenate([np.ones(85), np.full(5, 7.0)])}[kind]
    v = (q * e) @ q.T
    values, vectors, residuals = whitening.leading(lambda u: v @ u, 90, 8)
    assert np.allclose(values, np.sort(e)[::-1][:8], rtol=1e-12, atol=1e-12 * e.max())
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12 and max(residuals) < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * e.max()


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    v = (q * np.linspace(1, 9, 30)) @ q.T
    u, theta = q[:, -2:], np.array([8.5, 8.2])
    r = rng.standard_normal((30, 2))
    r -= u @ (u.T @ r)
    t = whitening._minres(lambda x: v @ x, r, theta, [u, u], 60)
    away = np.eye(30) - u @ u.T
    assert np.abs(np.column_stack([away @ (v - np.eye(30) * s) @ away @ x for s, x in zip(theta, t.T)]) - r).max() < 1e-8
