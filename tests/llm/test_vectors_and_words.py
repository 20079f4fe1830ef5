"""Operators 11 to 13 against plain computations, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalake.llm import multi_index, spelling, vector_codes

#: Columns whose names the operators use inside.
CLASH = "raw string, ids int, n string, mark double, cell string, shard string, row string, code string, pos string, part string, root string, word int"


def clashing(spark, rows, head):
    return spark.createDataFrame([(*r, *([None] * 12)) for r in rows], f"{head}, {CLASH}").repartition(3)


# ---------------------------------------------------------------- nearest neighbours


def vectors(n=700, d=6, seed=1):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.normal(size=(n, d)), 1).astype(np.float32)  # many equal distances
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n + i, rows[200][1]) for i in range(40)] + [(2000 + 10 * i, rows[300][1]) for i in range(30)]
    rows += [(200, rows[200][1]), (100, rows[5][1]), (None, rows[7][1]), (None, rows[200][1])]
    rows += [(3000, None), (3100, []), (3200, [0.0] * d), (3300, [1.0, None, 0.0]), (3400, [math.nan] * d), (3500, [math.inf] + [0.0] * (d - 1))]
    rows += [(4000, [1.0, 2.0]), (4001, [1.0, 3.0]), (4100, [1.0, 2.5]), (5000, [7.0]), (5100, [1e30] * d), (5101, [-1e30] * d)]
    return rows


def neighbours(rows, every=100, k=10):
    """query_id, rank, vec_id, score by comparing each query with every row."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q is not None and q % every == 0:
            near = [(float(np.sqrt(((x - y) ** 2).sum())), i is None, i or 0) for b, (i, y) in enumerate(ok) if b != a and len(y) == len(x)]
            out += [(q, r, None if z else i, s) for r, (s, z, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_search_is_exact_on_small_tables(spark):
    rows = vectors()
    df = clashing(spark, rows, "vec_id long, embedding array<float>, label int".replace(", label int", ""))
    want = neighbours([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    assert found(multi_index.search(df, F.col("vec_id") % 100 == 0)) == want
    assert found(multi_index.search(df.limit(0), F.col("vec_id") % 100 == 0)) == []
    assert found(multi_index.search(df.where("vec_id in (4000, 5000)"), F.col("vec_id") % 100 == 0)) == []


def test_search_in_many_shards_and_by_shares_of_queries(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD", 32)
    monkeypatch.setattr(multi_index, "ASKS", 3)
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in vectors(900)]
    df = clashing(spark, rows, "vec_id long, embedding array<double>")
    assert found(multi_index.search(df, F.col("vec_id") % 20 == 0)) == neighbours(rows, 20)


def test_search_recall_and_share(spark, monkeypatch):
    """On clustered vectors a query sees a small share of them and still finds its neighbours."""
    monkeypatch.setattr(multi_index, "LEAST", 50)
    enough = []
    needed = multi_index._needed
    monkeypatch.setattr(multi_index, "_needed", lambda *a: enough.append(needed(*a)) or enough[-1])
    rnd = np.random.default_rng(5)
    centre = rnd.normal(size=(60, 24))
    x = (centre[rnd.integers(0, 60, 8000)] + rnd.normal(size=(8000, 24)) * 0.25).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(q, i) for q, _, i, _ in found(multi_index.search(df, F.col("vec_id") % 100 == 0))}
    x = x.astype(np.float64)
    want = set()
    for q in range(0, 8000, 100):
        s = ((x - x[q]) ** 2).sum(1)
        s[q] = np.inf
        want |= {(q, int(i)) for i in np.lexsort((np.arange(8000), s))[:10]}
    assert len(got) == len(want) and len(got & want) >= 0.92 * len(want)
    assert enough[0] < 1600


def test_walk_is_by_summed_distance():
    rnd = random.Random(2)
    a, b = np.array([rnd.random() for _ in range(7)]), np.array([rnd.random() for _ in range(9)])
    held = np.array([[rnd.randint(0, 3) for _ in range(9)] for _ in range(7)])
    order = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(9) if held[i, j])
    assert multi_index.walk(a, b, held, 10**9) == [(i, j) for _, i, j in order]
    part = multi_index.walk(a, b, held, 20)
    assert part == [(i, j) for _, i, j in order][: len(part)]
    assert sum(held[p] for p in part) >= 20 > sum(held[p] for p in part[:-1])


# ---------------------------------------------------------------- vector codes


def codes(rows):
    """Rows of compressed() by plain Lloyd rounds over all vectors; rows: vec_id, label, vector."""
    kept = [(i, lab, [math.floor(256 * c) for c in v]) for i, lab, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    w = len(kept[0][2]) // 16
    cut = lambda v, p: tuple(v[p * w : (p + 1) * w])
    books = [[cut(v, p) for _, _, v in kept[:64]] for p in range(16)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        groups = [{} for _ in range(16)]
        for _, _, v in kept:
            for p in range(16):
                groups[p].setdefault(near(p, cut(v, p))[1], []).append(cut(v, p))
        books = [[tuple(sum(c) // len(g) for c in zip(*g, strict=True)) if (g := groups[p].get(k)) else e for k, e in enumerate(books[p])] for p in range(16)]
    out, total = [], Counter()
    for i, lab, v in kept:
        each = [near(p, cut(v, p)) for p in range(16)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in each), sum(e for e, _ in each)))
        total[lab] += out[-1][3]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, total[lab], sha) for i, lab, code, e in out), key=repr)


@pytest.mark.parametrize("n", [400, 30])
def test_codes(spark, n):
    rnd = np.random.default_rng(n)
    x = np.round(rnd.normal(size=(n, 32)), 1).astype(np.float32)
    rows = [(i * 3 - 50, [0, 1, None][i % 3], v.tolist()) for i, v in enumerate(x)]
    rows += [(9000 + i, 1, rows[4][2]) for i in range(50)] + [(-50, 2, rows[6][2]), (None, None, rows[8][2]), (None, 5, rows[9][2])]
    bad = [(-99, 1, None), (-98, 1, []), (-97, 1, [math.nan] * 32), (-96, None, [None] * 32), (-95, 1, [math.inf] * 32), (7, 7, [1.0] * 31), (8, 7, [1e9] * 32)]
    df = clashing(spark, rows + bad, "vec_id long, label int, embedding array<float>")
    got = sorted((tuple(r) for r in vector_codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)
    assert got == codes(rows)
    assert vector_codes.compressed(df.limit(0)).collect() == [] and vector_codes.compressed(df.where("vec_id < -90")).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compressed(df.where("vec_id = 7 and label = 7"))


# ---------------------------------------------------------------- spelling variants


def variants(rows):
    """Rows of grouped() by comparing all words."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        others = sorted((-n[o], o) for o in n if near(w, o))
        count[w] = len(others)
        if others and -others[0][0] >= 10 * n[w]:
            form[w] = others[0][1]
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], count[w], n.get(form.get(w))))
    return sorted(out, key=repr)


def prose(seed=3):
    rnd = random.Random(seed)
    alphabet = "abcdefghéß×"
    base = ["".join(rnd.choices(alphabet, k=rnd.randint(6, 12))) for _ in range(60)]
    base += ["listens", "silents", "enlists", "listenss", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÉtéÉtéÉt", "étéétéét", "abcdefgabcdefg"]
    weight = [3 ** rnd.randint(0, 6) for _ in base]

    def one():
        w = rnd.choices(base, weight)[0]
        k = rnd.random()
        i = rnd.randrange(len(w))
        if k < 0.06:
            w = w[:i] + rnd.choice(alphabet) + w[i:]
        elif k < 0.12:
            w = w[:i] + rnd.choice(alphabet) + w[i + 1 :]
        elif k < 0.14:
            w = w[:i] + w[i + 1 :]
        return w.upper() if k > 0.95 and w.isascii() else w

    rows = [(i, rnd.choice([" ", "\n", "1", "Ā", "'"]).join(one() for _ in range(rnd.choice([0, 1, 40, 300])))) for i in range(80)]
    # a chain of forms, each ten times as frequent as the one before
    rows += [(200, "chaining " * 2500 + "chainins " * 240 + "chanins " * 23 + "chaninsx " * 2)]
    rows += [(300, None), (301, ""), (302, "short 12 !"), (None, rows[5][1]), (7, rows[7][1]), (7, rows[7][1]), (303, "z" * 100_000 + " " + "z" * 100_000), (304, "z" * 99_999 + " " + "z" * 99_999)]
    return rows


def test_spelling(spark):
    rows = prose()
    df = clashing(spark, rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in spelling.grouped(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    want = variants(rows)
    assert got == want
    assert any(f for _, f, *_ in want) and any(r not in (w, f) for w, f, r, *_ in want)
    assert spelling.grouped(df.limit(0)).collect() == [] and spelling.grouped(df.where("doc_id >= 300 and doc_id < 303")).collect() == []


def test_spelling_pairs_meet_once(spark):
    """Words of one letter set in all orders: only those near are paired, each pair once."""
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choices("ab", k=rnd.randint(7, 9))) for _ in range(300)})
    got = [(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    near = [(a, b) for a in words for b in words if a < b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or abs(len(a) - len(b)) == 1 and any((c := max(a, b, key=len))[:i] + c[i + 1 :] == min(a, b, key=len) for i in range(len(max(a, b, key=len)))))]
    assert sorted(got) == near
