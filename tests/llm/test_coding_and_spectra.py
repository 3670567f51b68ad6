"""The transducer against the public library, whitening against dense eigenvectors, hard negatives against all pairs."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from insight_jobs.llm import hardneg, queries, transducer, whitening

SF = "/root/testdata/sf0.001"
TEXTS = ["", " \n\t ", "one", "It's they'll HE'D", "<|startoftext|>mid<|endoftext|> <|EndOfText|> a<|endoftext|>b", "Été ÉTÉ é ΣΑΣ İstanbul ǅ", "x" * 5000, "ab" * 4000 + "c", "\x1c\x1d a\x1fb c　d", "漢字かな 😀👩‍🚀 ͸ Ᲊ", "1234 ½ Ⅷ ²", "a b\x85c", "!!!???... --- '' \"'s\" 's's", "퟿\U0010ffff", "\x00\x7f"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(transducer.MODEL)
    out.no_padding()
    out.no_truncation()
    return out


@pytest.fixture(scope="module")
def tokenizer():
    return transducer.load(transducer.MODEL, *transducer.classes())


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def many_texts(spark) -> list[str]:
    rng = random.Random(5)
    letters = "abcdeéñ'’.,!1 2\n\tẞßΣσſ漢😀-"
    odd = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(2000)]
    return [*TEXTS, *odd, *[r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]]


def test_tokens_and_decoding_are_the_public_librarys(spark, library, tokenizer):
    texts = many_texts(spark)
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids(tokenizer.encode(t)) for t in texts] == wanted
    decoder = tokenizer.decoder()
    assert [decoder.text(w) for w in wanted] == [library.decode(w, skip_special_tokens=False) for w in wanted]


def test_every_character_is_cut_as_in_the_library(library, tokenizer):
    texts = [f"a{chr(c)}b1{chr(c)}{chr(c)}." for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, w in zip(texts, wanted, strict=True) if ids(tokenizer.encode(t)) != w] == []


def small_merges(rng: random.Random, n: int) -> transducer.Merges:
    """A random merge list over the bytes a, b and c, each rule made of what came before."""
    known, rules = ["a", "b", "c"], []
    while len(rules) < n:
        pair = rng.choice(known), rng.choice(known)
        if pair[0] + pair[1] not in known and len(pair[0] + pair[1]) < 12:
            rules.append(pair)
            known.append(pair[0] + pair[1])
    return transducer.Merges({t: k for k, t in enumerate(known)}, rules, "")


def test_lookahead_is_sufficient_and_windows_change_nothing():
    rng = random.Random(7)
    for _ in range(150):
        merges = small_merges(rng, rng.randrange(1, 14))
        merges.window = merges.lookahead  # emit as early as is allowed
        for _ in range(20):
            text = "".join(rng.choices("abc", k=rng.randrange(1, 60)))
            machine, got, at = transducer.Transducer(merges), [], 0
            while at < len(text):
                step = rng.randrange(1, 9)
                got += machine.feed(text[at : at + step])
                at += step
                assert len(machine.text) <= merges.window + 9  # memory stays bounded
                whole = merges.merged(text[:at] + "".join(rng.choices("abc", k=6)))
                assert whole[: len(got)] == got  # emitted tokens stay, whatever follows
            assert got + machine.finish() == merges.merged(text)


def test_lookahead_by_hand():
    # a|b is decided by whether b|c comes first; nothing else hangs on what follows.
    assert transducer.sufficient_lookahead([("b", "c"), ("a", "b")]) == 3
    assert transducer.sufficient_lookahead([]) == 1


def test_decoder_gives_whole_characters_as_they_come(tokenizer):
    text = "été 漢字 😀 fin"
    code = ids(tokenizer.encode(text))
    machine = tokenizer.decoder(plain=True)
    parts = [machine.feed([k]) for k in code]
    assert "".join(parts) + machine.finish() == "été 漢字 😀 fin "
    broken = transducer.Decoder({0: b"\xf0\x9f", 1: b"\x98\x80", 2: b"\xff"})
    assert [broken.feed([0]), broken.feed([1]), broken.feed([2]), broken.feed([9]), broken.feed([0]), broken.finish()] == ["", "😀", "�", "", "", "�"]


def test_transducer_query_and_edges(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "one", "x"), (2**62, None, None), (3, "one", "x"), (3, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = transducer.digests(docs).collect()
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        code = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(code, skip_special_tokens=False)
        want = (len(code), hashlib.sha256(np.array(code, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert want in {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] == doc_id}
    back = transducer.decode_documents(transducer.encode_documents(docs), plain=True)
    assert {r["text"] for r in back.where("doc_id = 2").collect()} == {"one "}
    assert transducer.digests(docs.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int, x string, n int, grp int, block int"


def clashing(rows):
    return [(*r, "clash", 1, 2, 3) for r in rows]


def dense(x: np.ndarray, most: int = 16):
    """Distinct rows' mean, covariance, eigenvalues and vectors by numpy."""
    u = np.unique(x, axis=0)
    cov = np.cov(u.T, bias=True).reshape(x.shape[1], -1)
    values, basis = np.linalg.eigh(cov)
    return u, values[::-1][:most], basis[:, ::-1][:, :most], np.trace(cov)


def test_whitening_by_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 20)) * np.linspace(1, 4, 20)
    v[250:] = v[:50]  # copies count once in the fit
    odd = [(900, None, 1), (901, [None] + [0.0] * 19, 1), (902, [float("nan")] * 20, 1), (903, [float("inf")] + [0.0] * 19, 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    rows = [(k if k else None, x.tolist(), k % 3) for k, x in enumerate(v)]
    got = whitening.whiten(spark.createDataFrame(clashing(rows + odd), VECTORS)).toPandas()
    x = np.floor(64 * v) + 1_000_000
    u, values, basis, trace = dense(x)
    assert len(got) == 300 * 16 and set(got["n"]) == {250} and set(got["component"]) == set(range(1, 17))
    mine = got.sort_values(["vec_id", "component"], na_position="first")
    away = x - u.mean(0)
    wanted = away @ basis / np.sqrt(values)
    w = mine["whitened"].to_numpy().reshape(300, 16)
    assert np.abs(w * np.sign((w * wanted).sum(0)) - wanted).max() < 1e-8
    assert np.allclose(mine["explained"].to_numpy().reshape(300, 16)[0], values / trace, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    total = u.sum(0).astype(int).tolist()
    exact = [sum((250 * int(c) - s) ** 2 for c, s in zip(r, total, strict=True)) for r in x]
    assert mine["deviation"].to_numpy().reshape(300, 16)[:, 0].tolist() == exact


def test_whitening_edges(spark):
    make = lambda rows: spark.createDataFrame(clashing(rows), VECTORS)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None, 1)])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0  # one x vector: no variance
    two = whitening.whiten(make([(1, [0.0, 0.0], 1), (2, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)])).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(round(r["whitened"], 9)), round(r["explained"], 9)) for r in two] == [(k, 1, 2, 2 * 64 * 64, 1.0, 1.0) for k in (1, 2, 2)]


def test_inertia_and_slices_of_hard_spectra():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        a = rng.integers(-3, 4, size=(n, n)).astype(float)
        a += a.T
        values = np.linalg.eigvalsh(a)
        if np.abs(values).min() > 1e-9:
            assert whitening.inertia(a) == (values > 0).sum()
    for _ in range(60):  # repeated, nearly equal, tiny and zero eigenvalues
        q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
        values = np.sort(rng.choice([1.0, 2.0, 2 + 1e-13, 3.0, 5.0, 7e-9, 0.0], size=20))[::-1]
        cov = q * values @ q.T
        found, basis = whitening.leading((cov + cov.T) / 2, 16)
        assert len(found) == min(16, (values > 0).sum()) and np.allclose(found, values[: len(found)], rtol=1e-6, atol=1e-14)
        assert np.abs(basis.T @ basis - np.eye(len(found))).max() < 1e-9
        assert np.abs(cov @ basis - basis * found).max() < 1e-12


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 25, 1 << 40):
        z = rng.integers(-most, most, size=(50, 4))
        assert (whitening.exact_products(z) == z.astype(object).T @ z.astype(object)).all()


def test_hard_negatives_same_as_all_pairs(spark):
    con = duckdb.connect()
    for sf in (SF, "/root/testdata/sf0.01"):
        con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        wanted = con.execute(hardneg.ORACLE).fetchall()
        got = queries.op13_hard_negatives(spark, sf)
        assert sorted(map(tuple, got.collect())) == sorted(wanted) and got.columns == [c[0] for c in con.description]


def brute_negatives(rows, anchors, k_positive, k_negative):
    out = []
    for a, la, xa in rows:
        if a not in anchors:
            continue
        score = {b: sum(int(p) * int(q) for p, q in zip(xa, xb, strict=True)) for b, _, xb in rows if b != a}
        labels = {b: lb for b, lb, _ in rows}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if labels[b] == la][:k_positive]:
            fits = [b for b in order if labels[b] != la and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(a, p, r, b, score[p], score[b]) for r, b in enumerate(fits[:k_negative], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 2e5])
def test_hard_negatives_by_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6)) * 3
    v = np.round((centres[rng.integers(0, 4, 240)] + rng.normal(size=(240, 6)) * 0.4) * scale, 3)
    v[100:140] = v[100]  # ties
    rows = [(k, x.tolist(), int(rng.integers(0, 3))) for k, x in enumerate(v)]
    odd = [(500, None, 1), (501, [float("nan")] * 6, 1), (502, [1.0] * 6, None), (None, [1.0] * 6, 1), (503, [1.0], 1), (504, [None] * 6, 1), rows[7], rows[7]]
    table = spark.createDataFrame(clashing(rows + odd), VECTORS)
    anchors = set(range(0, 240, 6))
    wanted = brute_negatives([(k, c, [int(np.floor(256 * e)) for e in x]) for k, x, c in rows], anchors, 3, 2)
    for block_rows, group_rows in ((1000, 1000), (50, 7)):
        got = hardneg.hard_negatives(table, F.col("vec_id").isin(anchors), F.col("label"), positives=3, negatives=2, block_rows=block_rows, group_rows=group_rows)
        assert sorted(map(tuple, got.collect())) == wanted and wanted


def test_hard_negatives_edges(spark):
    make = lambda rows: spark.createDataFrame(clashing(rows), VECTORS)
    ask = lambda df: [tuple(r) for r in hardneg.hard_negatives(df, F.col("vec_id") % 2 == 0, F.col("label")).collect()]
    assert ask(make([])) == [] and ask(make([(1, [1.0], 1)])) == []
    assert ask(make([(2, [1.0, 0.0], 1), (3, [0.0, 1.0], 2)])) == []  # no positive
    assert ask(make([(2, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [0.75, 0.0], 2)])) == [(2, 3, 1, 5, 65536, 49152)]
    assert ask(make([(2, [0.0, 0.0], 1), (3, [0.0, 0.0], 1), (5, [0.0, 0.0], 2), (7, [0.0, 0.0], 2)])) == [(2, 3, 1, 5, 0, 0), (2, 3, 2, 7, 0, 0)]


def test_bounds_spare_scores_where_anchors_are_near():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    centre = np.floor(rng.normal(size=(5, 16)) * 900)
    x = np.floor(centre[np.arange(2000) % 5] + rng.normal(size=(2000, 16)) * 4)
    block = hardneg.Block(pa.table({"vec_id": np.arange(2000), "label": np.arange(2000) % 5, "x": x.tolist()}))
    near = np.floor(centre[0] + rng.normal(size=(40, 16)) * 4)
    order, parent = hardneg.spanning_tree(near)
    place = np.empty(40, int)
    place[order] = np.arange(40)
    group = hardneg.Group(pa.table({"vec_id": np.arange(3000, 3040), "label": np.zeros(40, int), "x": near[order].tolist(), "parent": np.where(parent < 0, -1, place[parent])[order], "more": [[int((near[0] * near[0]).sum())]] * 40}))
    walk = hardneg.Walk(block, group)
    for at, low, high in walk:
        exact = x[np.lexsort((np.arange(2000), np.arange(2000) % 5))] @ group.x[at]
        assert (low <= exact).all() and (exact <= high).all()
        p = group.more[at][0]
        walk.exact(at, low, high, np.flatnonzero((100 * high >= 50 * p) & (100 * low <= 95 * p)))
    assert walk.rescored < 0.5 * 40 * 2000


def test_spanning_tree_is_least():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(60, 3)) * 50)
    order, parent = hardneg.spanning_tree(x)
    seen = set()
    for at in order:
        assert parent[at] < 0 or parent[at] in seen
        seen.add(at)
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    mine = sum(away[at, parent[at]] for at in order if parent[at] >= 0)
    joined, total = {0}, 0.0
    while len(joined) < 60:
        length, to = min((away[a, b], b) for a in joined for b in range(60) if b not in joined)
        joined.add(to)
        total += length
    assert len(seen) == 60 and np.isclose(mine, total)
