import random
import re
from itertools import combinations

import duckdb

from palimpsest.llm import decontaminate, sql
from palimpsest.llm.decontaminate import LIGHT, MASKS, MIN_EQUAL, REACH, SHORT, SHORT_SHARE, WEIGHT, leaks, without_leaks


def words(text):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())


def brute(docs, items):
    """All (doc, smallest item) pairs with a seed hit and enough equal tokens around it."""
    kinds = {}
    for k, t in items:
        w = tuple(words(t))
        if w:
            kinds[w] = min(k, kinds.get(w, k))
    out = set()
    for doc, text in docs:
        d = words(text)
        for w, k in kinds.items():
            if len(w) < WEIGHT:
                out |= {(doc, k)} if tuple(d) == w else set()
                continue
            for shift in range(-len(w), len(d)):
                lo, hi = max(0, -shift), min(len(w), len(d) - shift)
                eq = [d[j + shift] == w[j] for j in range(lo, hi)]
                if sum(eq) < 3:
                    continue
                for m in MASKS + LIGHT * (len(w) <= SHORT):
                    for j in range(len(eq) - len(m) + 1):
                        if all(eq[j + x] for x, c in enumerate(m) if c == "1"):
                            n = sum(eq[max(0, j - REACH) : j + REACH])
                            if n >= min(MIN_EQUAL, -int(-len(w) * SHORT_SHARE // 1)):
                                out.add((doc, k))
    return out


def planted(spark, odd):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "Été"] * 20
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(n)) for i, n in enumerate((30, 45, 60, 9, 6, 3, 30))] + [(50, None), (51, "")]
    items.append((60, items[0][1].upper() + "."))  # the same tokens again
    docs = []
    for i in range(40):
        body = text(80).split()
        passage = items[i % 7][1].split()
        if i % 4 == 1:
            for _ in range(len(passage) // 6):
                passage[rng.randrange(len(passage))] = "zzz"
        if i % 4 == 2:
            passage = passage[: len(passage) // 2]
        if i % 4 != 3:
            body[40:40] = passage
        docs.append((100 + i, " ".join(body)))
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 1, "h", 1) for i, t in docs], odd.schema).unionByName(odd.where("doc_id is not null"))
    return frame, spark.createDataFrame(items, "item_id long, text string")


def test_like_brute_force_by_both_ways(spark, odd, monkeypatch):
    docs, items = planted(spark, odd)
    want = brute([(r.doc_id, r.text if r.doc_id != 6 else "") for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert len(want) > 15
    got = leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.n_items for r in got if r.item_id == 0} == {2}
    bad = {d for d, _ in want}
    stay = without_leaks(docs, items)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)
    monkeypatch.setattr(decontaminate, "small", lambda *a, **b: False)
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == want
    assert without_leaks(docs, items).count() == stay.count()


def test_both_ways_give_the_same_rows(spark, odd, monkeypatch):
    item = [f"a{i}" for i in range(200)]
    other = lambda keep: " ".join(w if keep(i) else f"b{i}" for i, w in enumerate(item))
    rows = [(1, other(lambda i: 30 <= i < 130)), (2, other(lambda i: 64 <= i < 69 or 121 <= i < 132)), (3, other(lambda i: 64 <= i < 69))]
    docs, items = planted(spark, odd)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = items.unionByName(spark.createDataFrame([(70, " ".join(item))], items.schema))
    one = sorted(map(tuple, leaks(docs, items).collect()), key=str)
    assert [(r[0], r[3]) for r in one if r[1] == 70 and r[0] < 4] == [(1, 100), (2, 16)]
    monkeypatch.setattr(decontaminate, "small", lambda *a, **b: False)
    assert sorted(map(tuple, leaks(docs, items).collect()), key=str) == one


def test_short_items(spark, odd, monkeypatch):
    """Items of 5 to 12 tokens are found under every substitution that leaves four fifths of them; shorter ones only as whole documents."""
    items, rows, want = [(0, "solo"), (1, "one Two"), (2, "p q r s")], [(1, "SOLO!"), (2, "one two"), (3, "p q r s"), (4, "a solo one two p q r s b"), (5, "p q r"), (6, None), (7, "")], {(1, 0), (2, 1), (3, 2)}
    for n in range(5, 13):
        item = [f"i{n}t{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        for size in range(n - -int(-n * SHORT_SHARE // 1) + 2):
            for gone in combinations(range(n), size):
                doc = len(rows) + 10
                rows.append((doc, " ".join(["before", *("zz" if j in gone else w for j, w in enumerate(item)), "after"])))
                if size <= n - -int(-n * SHORT_SHARE // 1):
                    want.add((doc, n))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, leaks(docs, bench).collect()))
    assert {r[:2] for r in one} == want
    db = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        db.register(name, df.toArrow())
    assert sorted(db.sql(sql.OP10).fetchall()) == one
    monkeypatch.setattr(decontaminate, "small", lambda *a, **b: False)
    assert sorted(map(tuple, leaks(docs, bench).collect())) == one


def test_odd_tables(spark, sf, odd, empty):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert leaks(empty, benchmark).count() == 0 and leaks(odd, benchmark).count() == 0
    assert without_leaks(odd, benchmark).count() == odd.count() and without_leaks(odd, benchmark.limit(0)).count() == odd.count()
