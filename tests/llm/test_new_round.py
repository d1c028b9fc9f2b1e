"""Spelling variants, whitening and packing against brute force, and the cases that any table can hold."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gazetta.llm import packing, spelling, whitening

SCHEMA = "doc_id long, text string, word string, n long, form string, size int, length int, root string"


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    sets = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) if v and max(map(words.get, v)) >= 2 * words[w] else None for w, v in sets.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(sets[w]), words.get(form[w])) for w, n in words.items()}


def letters_of(rng, alphabet, low, high):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))


@pytest.mark.parametrize("alphabet,block", [("ab", 1024), ("abÀé×ÿ", 7), ("abcdefgh", 3)])
def test_spelling_variants(spark, monkeypatch, alphabet, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "MOST", block + 1)
    monkeypatch.setattr(spelling, "ASKING", 5)
    rng = random.Random(len(alphabet))
    stock = list({letters_of(rng, alphabet, 4, 9) for _ in range(150)})
    words = [rng.choice(stock[: rng.randint(1, len(stock))]) for _ in range(4000)]
    rows = [(i if i % 9 else None, " ".join(words[i * 40 : i * 40 + 40]).replace("a b", "a-B\n")) for i in range(100)]
    long = "xy" * 3000
    rows += [rows[3], (100, None), (101, ""), (102, " 12 Āő "), (103, f"{long} {long} {long}z {long}z {long}z {long}"), (104, f"{long}")]
    docs = spark.createDataFrame([(d, t, "w", 1, "f", 2, 3, "r") for d, t in rows], SCHEMA)
    got = spelling.spelling(docs).collect()
    want = spelled(rows)
    assert len(got) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(v[1] != v[0] and v[0] for v in want.values()) or alphabet != "ab"


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "one two six one two six"), (2, "")]):
        docs = spark.createDataFrame([(d, t, "w", 1, "f", 2, 3, "r") for d, t in rows], SCHEMA)
        assert spelling.spelling(docs).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, n long, component string, x string"


def embedded(rng, n, d):
    base = [[rng.gauss(0, 0.2 + 0.1 * (j < 3)) + (0.3 if j == 5 else 0) for j in range(d)] for _ in range(n)]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(n + i, base[0]) for i in range(40)]  # copies
    rows += [(n + 40, None), (n + 41, [None, *base[1][1:]]), (n + 42, [float("nan"), *base[1][1:]]), (n + 43, [float("inf"), *base[1][1:]]), (None, base[2]), (3, base[3]), (n + 44, [])]
    return [(i, v, 1, 2, "c", "x") for i, v in rows]


@pytest.mark.parametrize("d,k", [(8, 4), (2, 2), (20, 4)])
def test_whitening(spark, d, k):
    rows = embedded(random.Random(d), 150, max(d, 6))
    rows = [(i, v if v is None else v[:d], *rest) for i, v, *rest in rows]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    fine = [(r[0], np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(int)) for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    x = np.array(sorted({tuple(v) for _, v in fine}))
    n, s = len(x), x.sum(0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == k * len(fine) and {r.component for r in got} == set(range(1, k + 1))
    of = {}
    for i, own in fine:
        of.setdefault(i, []).append(own)
    for r in got:
        own, c = of[r.vec_id][0], r.component - 1
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s, strict=True))
        assert abs(abs(r.whitened) - abs((own - s / n) @ v[:, c]) / e[c] ** 0.5) < 1e-9
        assert abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    w = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(w[0, c] == w[150, c] for c in range(1, k + 1))


def test_eigenvectors_by_splitting():
    rng = np.random.default_rng(1)
    for values in ([1, 2, 3], [1] * 30 + [2] * 34, [0, 0, 0, 0, 1], list(np.logspace(0, -12, 40)), [1] * 6, [5] + [1] * 20, [0]):
        n = len(values)
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        a = (q * np.array(values, float)) @ q.T
        e, v = whitening.eigen(a)
        assert np.allclose(e, sorted(values, reverse=True), atol=1e-14 * n) and np.allclose(v @ v.T, np.eye(n), atol=1e-13) and np.allclose(v @ a, e[:, None] * v, atol=1e-13)
        assert np.allclose(whitening.eigen(a, 2)[0], e[:2], atol=1e-14 * n)
    u = whitening.polar(np.diag([3.0, -1e-9, 2.0]))
    assert np.allclose(u, np.diag([1, -1, 1]))


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, []), (2, [])], [(1, [float("nan")])]):
        df = spark.createDataFrame([(i, v, 1, 2, "c", "x") for i, v in rows], VECTORS)
        assert whitening.whitened(df).collect() == []
    big = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e9, 3.0])]
    got = whitening.whitened(spark.createDataFrame([(i, v, 1, 2, "c", "x") for i, v in big], VECTORS), 1).collect()
    assert len(got) == 3 and got[0].deviation is None
    assert whitening.deviations(np.array([[2**61, -(2**61)]]), 3, [1, 2]) == [None] and whitening.deviations(np.array([[10**9, 5]]), 2, [1, 1]) == [(2 * 10**9 - 1) ** 2 + 81]
    assert whitening.fitted(spark.createDataFrame([(i, v, 1, 2, "c", "x") for i, v in big], VECTORS)).total[1] == 6 * 256


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = ["It's. a'S, é. x\x1cy  \x85z  İstanbul. ΣΑΣ. <|endoftext|> a.b, c ., don't.\nyes ", "́a ́", "a​. b", "ﬁ. Ⅻ, ½.", "word " * 9000, "x" * 5000, " \n", "", None]


@pytest.mark.parametrize("window,parts", [(1 << 21, 1), (20_000, 3)])
def test_packing(spark, tokenizer, window, parts):
    rng = random.Random(3)
    rows = [(i if i else None, " ".join(rng.choice(["alpha", "Beta,", "gamma.", "delta", "é"]) for _ in range(int(rng.paretovariate(0.8) * 20)))[:60_000]) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    rows.append(rows[5])
    docs = spark.createDataFrame([(d, t, "w", 1, "f", 2, 3, "r") for d, t in rows], SCHEMA).repartition(parts)
    got = packing.packed(docs, window=window).collect()
    of, want = {}, Counter()
    for d, t in rows:
        ids = tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
        of[d] = ids
        want[d, ids] += 1
    pieces, sequences = {}, {}
    for r in got:
        assert tuple(r.ids) == of[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(of[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.cost))
    for (d, ids), times in want.items():
        seen = Counter(i for s, n in pieces[d] for i in range(s, s + n))
        assert set(seen.values()) == {times} and len(seen) == len(ids)
    short = 0
    for own in sequences.values():
        at = 0
        for offset, n, _ in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
        assert abs(own[0][2] - sum(packing.cost(n) for _, n, _ in own)) < 1e-6
        short += at < 4096
    assert short <= 12 * parts


def test_packing_takes_the_sequence_of_lowest_cost():
    lengths, rooms = np.array([5, 3, 9, 9, 2, 1, 4]), np.array([12, 12, 12])
    out, rest = packing.assigned(lengths, rooms)
    room, costs, at = [12] * 3, [0.0] * 3, {}
    queue = sorted(range(7), key=lambda i: -lengths[i])
    for i in queue:
        left = int(lengths[i])
        while left and sum(room):
            able = [s for s in range(3) if room[s] >= left] or [s for s in range(3) if room[s]]
            to = min(able, key=lambda s: (costs[s], s))
            n = min(left, room[to])
            at.setdefault(i, []).append((int(lengths[i]) - left, n, to, 12 - room[to]))
            room[to], costs[to], left = room[to] - n, costs[to] + packing.cost(n), left - n
    seen = {}
    for p, *piece in out:
        seen.setdefault(p, []).append(tuple(piece))
    assert seen == at and rest == [] and packing.powers(13) == [8, 4, 1] and packing.powers(0) == []
    assert packing.assigned(np.array([5, 2]), np.array([4])) == ([(0, 0, 4, 0, 0)], [(0, 4, 1), (1, 0, 2)])


def test_long_texts_are_split_at_spaces(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CHARS", 50)
    monkeypatch.setattr(packing, "KEPT", 20)
    own = packing.Encoder()
    texts = [t or "" for t in ODD[:5]] + ["one two. three, " * 40, "y" * 400 + " z"]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert own.encode(pa.array([], pa.string())) == []


def test_nothing_to_pack(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = packing.packed(spark.createDataFrame([(None, None, "w", 1, "f", 2, 3, "r")], SCHEMA)).collect()
    assert (row.doc_id, row.start, row.length, row.doc_tokens, row.offset, row.ids) == (None, 0, 1, 1, 0, [2])


@pytest.mark.parametrize("name", ["base_counts", "base_licenses", "base_secrets", "base_sizes"])
def test_columns_that_sql_tells(spark, sf_dir, name):
    import duckdb

    from gazetta.llm import base_columns

    got = base_columns.QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(base_columns.ORACLE_SQL[name]).df()[list(got.columns)]
    plain = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).replace({float("nan"): None}).itertuples(index=False, name=None)))
    assert [x.replace(".0", "") for x in plain(got)] == [x.replace(".0", "") for x in plain(want)]


def test_base_counts_ask_no_vocabulary(spark, tmp_path, monkeypatch):
    from gazetta.llm import base_columns, fertility

    rows = [(1, "one two three four five six seven eight " * 4 + "#x\n#x", "en"), (2, None, None), (None, "", "de"), (3, "Zoë\u2003|ein\n\nein " * 30, "de"), (3, "Zoë\u2003|ein\n\nein " * 30, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want = fertility.ruled(spark.read.parquet(str(tmp_path / "documents.parquet")))
    want = want.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    monkeypatch.setattr(fertility, "PIECES", "no file")
    monkeypatch.setattr(fertility, "measured", None)
    assert sorted(map(str, base_columns.base_counts(spark, str(tmp_path)).collect())) == sorted(map(str, want))
