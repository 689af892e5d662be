"""Divergence, clustering and mixing against brute-force versions, on tables with every kind of odd row, and against DuckDB."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import delta_lloyd, divergence, mixing, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, rows):
    """The rows in several partitions, with further columns whose names the operators use themselves."""
    made = spark.createDataFrame(rows, DOCS).repartition(3)
    return made.withColumns({c: F.lit("x") for c in ("term", "c", "p", "q", "size", "target", "taken", "h1", "h2", "n", "salt", "pos", "boundary", "value", "rank")})


def odd_documents(seed, n=120):
    rng = random.Random(seed)
    letters = ["Éa", "b", "B", "日本", "c", "ß", "d", "e1f", "g", "it"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "Z", None, "é"])
        text = rng.choice([None, "", " \n", "12 34", "b"] + [" ".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 30])))] * 12)
        rows.append((rng.choice([i, i, i, None]), text, lang, source))
    rows += [rows[5]] * 4 + [(5000, "long word " * 20_000, "en", "s1"), (5001, "b", "xx", "only"), (5002, "b", "xx", "other"), (5003, None, "yy", "alone")]
    return rows


# 11


def brute_divergence(rows, least_docs, smoothing, scale, top):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= least_docs)
        sources = sorted({d[1] for d in own})
        count = {s: Counter(t for _, a, w in own if a == s for t in w if df[t] >= least_docs) for s in sources}
        whole = sum(count.values(), Counter())

        def share(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + scale * (c[t] + smoothing) // (n + smoothing * len(kept)) for t in kept}

        p, q = {s: share(count[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", x[2], -x[0], i) for i, x in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", x[2], -x[0], i) for i, x in enumerate(sorted(terms), 1) if i <= top}
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 50), (10, 2), (10_000, 50)])
def test_divergence(spark, monkeypatch, least, top):
    monkeypatch.setattr(divergence, "PART", 2)
    rows = odd_documents(least)
    got = [tuple(r) for r in divergence.audit(documents(spark, rows), least, 5, 10**9, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_divergence(rows, least, 5, 10**9, top)


def test_divergence_without_rows(spark):
    none = divergence.audit(documents(spark, []))
    assert none.count() == 0
    assert none.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_shares_are_exact_where_products_exceed_64_bits(spark):
    row = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_007, 3)], "c long, n long, v long")
    assert row.select(divergence._share("c", "n", 5, 10**9)).first()[0] == 1 + 10**9 * (9_000_000_000_000 + 5) // (9_000_000_000_007 + 15)


# 12


def brute_lloyd(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * float(c)) for c in e]) for i, e in rows if e is not None and len(e) == dims and all(c is not None and math.isfinite(c) for c in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]
    for r in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids)) for _, x in kept]
        if r < rounds:
            for n in range(len(centroids)):
                own = [x for (_, x), (_, c) in zip(kept, best, strict=True) if c == n]
                if own:
                    centroids[n] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    inertia = Counter()
    for d, c in best if kept else []:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, best, strict=True)), key=str)


def odd_vectors(seed, n=300, dims=4):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 1), rng.gauss(3, 0.1), 0.5]) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * dims) for i in range(n // 2)]  # a group of copies
    rows += [rows[3], rows[3], (None, [1.0] * dims), (None, [2.0] * dims), (7, [9.0] * dims)]
    return rows + [(2000, None), (2001, []), (2002, [1.0] * (dims + 1)), (2003, [None, *[1.0] * (dims - 1)]), (2004, [math.nan] * dims), (2005, [math.inf, *[1.0] * (dims - 1)])]


def vectors(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return made.withColumns({c: F.lit("x") for c in ("raw", "x", "cluster", "distance", "was", "inertia", "label")})


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (7, 5), (40, 5), (1000, 2)])
def test_delta_lloyd(spark, k, rounds):
    import numpy as np

    rows = odd_vectors(k)
    as_floats = [(i, None if e is None else [None if c is None else float(np.float32(c)) for c in e]) for i, e in rows]
    got = delta_lloyd.clusters_of(vectors(spark, rows), k, rounds, 4, 256, 2).collect()
    assert sorted(map(tuple, got), key=str) == brute_lloyd(as_floats, k, rounds, 4, 256, 2)


def test_delta_lloyd_looks_at_changes_only(spark):
    """Once clusters settle, no centroid is compared and no vector moves."""
    rows = [(i, [float(i % 3) * 10, 0.0, 0.0, 0.0]) for i in range(60)]
    done = delta_lloyd.cluster(vectors(spark, rows), k=3, rounds=5, dims=4)
    assert done.log[0] == {"compared": 3, "moved": 60}
    assert len(done.log) < 5
    assert sum(x["moved"] for x in done.log[1:]) < 60


def test_delta_lloyd_without_vectors_and_beyond_the_bound(spark):
    assert delta_lloyd.clusters_of(vectors(spark, []), 3, 2, 4).count() == 0
    assert delta_lloyd.clusters_of(vectors(spark, [(1, [1.0])]), 3, 2, 4).count() == 0
    with pytest.raises(Exception, match="beyond the bound"):
        delta_lloyd.clusters_of(vectors(spark, [(1, [1e30] * 4)]), 3, 2, 4).count()


# 13


def brute_targets(sizes, weights, share, repeats):
    targets = [share * sum(sizes) * w / sum(weights) for w in weights] if sizes else []
    while True:
        over = [i for i, t in enumerate(targets) if t > repeats * sizes[i]]
        if not over:
            return targets
        excess = sum(targets[i] - repeats * sizes[i] for i in over)
        for i in over:
            targets[i] = Fraction(repeats * sizes[i])
        free = [i for i, t in enumerate(targets) if t < repeats * sizes[i]]
        for i in free:
            targets[i] += excess * weights[i] / sum(weights[j] for j in free)


@pytest.mark.parametrize("seed", range(20))
def test_water_filled(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, rng.randrange(100), rng.randrange(10_000)]) for _ in range(rng.randrange(8))]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert mixing.water_filled(sizes, weights, Fraction(3, 2), 2) == brute_targets(sizes, weights, Fraction(3, 2), 2)


def mixed(spark, rows, **more):
    return mixing.mix(documents(spark, rows), **more).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rows = odd_documents(seed)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixed(spark, rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, _, s in rows)
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, _, s in rows if s == n) for n in names]
    targets = dict(zip(names, brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], Fraction(3, 2), 2), strict=True))
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert (r.source_size, r.target) == (sizes[names.index(r.source)], float(targets[r.source]))
        assert r.taken in {k * r.size for k in range(3)}
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for n in names:
        assert abs(taken[n] - targets[n]) <= Fraction(largest[n], 2)
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows)))


def test_mixing_is_nested(spark):
    """A larger share takes of every document what a smaller one takes, or more, where no target is capped."""
    rows = [(i, "w " * (i % 17), "en", f"s{i % 3}") for i in range(600)]
    least = {r.doc_id: r.taken for r in mixed(spark, rows, weights=(1,), share=Fraction(1, 3))}
    more = {r.doc_id: r.taken for r in mixed(spark, rows, weights=(1,), share=Fraction(4, 3))}
    assert all(least[i] <= more[i] for i in least)
    assert sum(least.values()) < sum(more.values())


def test_mixing_of_repeated_rows(spark):
    """Rows that nothing tells apart fill most of a source: as many are taken as its target needs."""
    rows = [(None, "a b c d", "en", "s")] * 500 + [(i, "a b", "en", "t") for i in range(2000)]
    got = mixed(spark, rows, weights=(1, 6), share=Fraction(1, 2))
    for s in ("s", "t"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2
    assert Counter(map(str, got)) == Counter(map(str, mixed(spark, rows, weights=(1, 6), share=Fraction(1, 2))))


def test_mixing_refines_the_boundary_bucket_only(spark, monkeypatch):
    """With few bits a level, thresholds take several passes and come out as near to the target."""
    monkeypatch.setattr(mixing, "BITS", 3)
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    monkeypatch.setattr(mixing, "LEVELS", 20)
    got = mixed(spark, [(i, "w " * (1 + i % 7), "en", f"s{i % 2}") for i in range(2000)])
    for s in ("s0", "s1"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3.5


def test_mixing_without_rows_or_words(spark):
    assert mixed(spark, []) == []
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixed(spark, [(1, None, None, None), (2, "", None, "a")])] == [(0, 0, 0.0, 0)] * 2


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_delta_lloyd", "op13_source_mixing"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, got[columns].itertuples(index=False, name=None))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))
