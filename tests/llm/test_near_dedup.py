import random

import numpy as np
import pytest

from palimpsest.llm import near_dedup
from palimpsest.llm.components import connected_components
from palimpsest.llm.near_dedup import exact_links, keep_one, near_duplicates


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for part in w for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", part)]
    return frozenset([tuple(w)] if 0 < len(w) < k else zip(*(w[i:] for i in range(k)), strict=False))


def brute(rows, k):
    """(doc, set size, component) by all pairs."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    kinds = {}
    for _, s in sets:
        kinds.setdefault(s, len(kinds))
    root = list(range(len(kinds)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    each = [(i, s) for s, i in kinds.items() if s]
    where = {}
    for i, s in each:
        for x in s:
            where.setdefault(x, []).append(i)
    by = dict(each)
    for i, s in each:
        for j in {j for x in s for j in where[x] if j < i}:
            n = len(s & by[j])
            if 100 * n >= 80 * (len(s) + len(by[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for d, s in sets:
        if s:
            c = find(kinds[s])
            least[c] = min(d, least.get(c, d))
    return sorted((d, len(s), least[find(kinds[s])] if s else d) for d, s in sets)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_like_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (2, 5):
        assert result(near_duplicates(docs, k=k)) == brute(rows, k)
    docs = odd.where("doc_id is not null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_duplicates(docs, k=2)) == brute(rows, 2)
    got = near_duplicates(odd, k=2).where("doc_id is null").first()
    assert got.component_id is None and got.kept


def copies(n=150, seed=2):
    """Groups of near-copies around the threshold, and chains of them."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, text = [], None
    for i in range(n):
        if i % 50 == 0:
            base = rng.choices(vocab, k=60)
            text = list(base)
        now = list(text if i % 3 else base)
        for _ in range(rng.randrange(5)):
            now[rng.randrange(len(now))] = rng.choice(vocab)
        if i % 3 == 1:
            text = now
        rows.append((i, " ".join(now)))
    return rows


@pytest.mark.parametrize(("block", "chunk"), [(1024, 512), (30, 4)])
def test_crowded_regions(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    assert 3 < len({c for *_, c in want}) < 140
    assert result(near_duplicates(docs, k=2)) == want


@pytest.mark.parametrize("chunk", [512, 16])
def test_small_groups_under_one_template(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rng = random.Random(11)
    frame, rows = [f"t{i}" for i in range(60)], []
    for g in range(200):
        own = [f"g{g}x{i}" for i in range(36)]
        for m in range(2):
            now = list(own)
            for i in rng.sample(range(0, 36, 4), 2 + m):
                now[i] = f"g{g}m{m}y{i}"
            rows.append((2 * g + m, " ".join(frame + now)))
    want = brute(rows, 2)
    assert 200 <= len({c for *_, c in want}) < 210
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)) == want


def boilerplate(n, share, seed=3):
    """Texts with a frame in common that makes them ``share`` similar, no two of them linked but for a copy of every 50th with one word changed."""
    rng = random.Random(seed)
    size = 100
    common = round(2 * share / (1 + share) * size)
    frame, rows = [f"t{i}" for i in range(common)], []
    for i in range(n):
        words = frame + [f"d{i}x{j}" for j in range(size - common)]
        rows.append((2 * i, " ".join(words)))
        if i % 50 == 0:
            words[rng.randrange(common, size)] = "other"
            rows.append((2 * i + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("share", [0.62, 0.77])
def test_boilerplate_without_links(spark, monkeypatch, share):
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    monkeypatch.setattr(near_dedup, "CHUNK", 40)
    monkeypatch.setattr(near_dedup, "SLACK", 20.0)  # all pairs are candidates by their sketches
    met, plain = [], near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, label: met.append((label, plain(df, label))) or met[-1][1])
    rows = boilerplate(600, share)
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2))
    assert got == sorted((d, n, d - d % 2) for d, n, _ in got) and len(got) == 612
    (region,) = [df for label, df in met if label == "regions"]
    assert region.select("region").distinct().count() == 1 and region.count() == 612
    meetings = [df.count() for label, df in met if label == "meetings"]
    assert sum(meetings) <= 4 * 12


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "small", lambda *a, **b: False)
    rows = copies(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, k=2)) == brute(rows, 2)
    assert keep_one(docs, k=2).count() == len({c for *_, c in brute(rows, 2)})


def test_exact_links():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25)).astype(np.uint64)) for _ in range(60)]
    got = exact_links(sets, 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            n, u = len(set(a) & set(b)), len(set(a) | set(b))
            assert got[i, j] == (n > 0 and 100 * n >= 50 * u)


def test_one_of_each_group_stays(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for *_, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5)})
    out = sorted(str(r.doc_id) for r in keep_one(odd).collect())
    assert out == ["0", "1", "3", "5", "6", "7", "None"]
    assert keep_one(empty).count() == 0 and near_duplicates(empty).count() == 0
