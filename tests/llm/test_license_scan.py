import random
import re
import time

from palimpsest.llm.license_scan import COVER, GAP, MIN_RUN, PHRASES, TEMPLATES, SuffixAutomaton, covered_spans, license_scan, scan


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at = {i: v for i in range(len(words)) for k, v in PHRASES.items() if words[i : i + len(k.split())] == k.split()}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(set(at.values())))


def test_like_brute_force(spark, sf, odd, empty):
    key = lambda r: tuple(map(str, r))
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=key)
        got = license_scan(docs).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_scan(empty).count() == 0


def test_phrases_that_overlap():
    assert scan(b"MIT license mit license, MIT-License cc by cc by. gnu General public license")[1:6] == (6, 0, 10, "cc-by,gpl,mit", "cc-by,gpl,mit")


def test_statistics_like_brute_force():
    rng = random.Random(1)
    lists = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(5)]
    subs = {tuple(x[i:j]): None for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for _ in range(200):
        text = [rng.randrange(5) for _ in range(15)]
        a = SuffixAutomaton(lists)
        for i, (n, v) in enumerate(a.statistics(text)):
            assert n == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in subs), default=0)
            for t, end in a.ends[v].items():
                assert n == 0 or lists[t][end - n : end] == text[i + 1 - n : i + 1]


def test_every_template_is_found_with_gaps():
    for label, notice in TEMPLATES:
        words = notice.split()
        if len(words) >= 12:  # a gap between two runs
            words.insert(len(words) // 2, "xyzzy")
        r = scan(("lorem ipsum " * 20 + " ".join(words) + " dolor sit").encode())
        assert label in r[5].split(","), notice
    assert scan(b"the software is under a work of the license to any person of this")[5] == ""


def naive_spans(words):
    """By definition: maximal runs from all substrings of all templates, chained for one template after the other."""
    lists = [t.split() for _, t in TEMPLATES]
    place = {}  # substring -> template -> end of its first place
    for k, t in enumerate(lists):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                place.setdefault(tuple(t[i:j]), {}).setdefault(k, j)
    long_ = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in place), default=0) for i in range(len(words))] + [0]
    runs = [(i + 1 - n, i + 1) for i, n in enumerate(long_[:-1]) if n >= MIN_RUN and long_[i + 1] != n + 1]
    out = []
    for k, t in enumerate(lists):
        chains = []
        for start, end in runs:
            at = place[tuple(words[start:end])].get(k)
            if at is None:
                continue
            if chains and end > chains[-1][1] and start - chains[-1][1] <= GAP and at > chains[-1][3]:
                first, before, covered, at0 = chains[-1]
                chains[-1] = [first, end, covered + min(end - start, at - at0, end - before), at]
            else:
                chains.append([start, end, end - start, at])
        out += [(k, a, b, c) for a, b, c, _ in chains if c >= COVER * len(t)]
    return sorted(out)


def test_chains_like_brute_force():
    rng = random.Random(4)
    found = 0
    for _ in range(60):
        words = []
        while len(words) < 150:
            t = rng.choice(TEMPLATES)[1].split()
            i = rng.randrange(len(t)) if rng.random() < 0.5 else 0
            words += t[i : i + rng.randrange(3, 40)]
            words += rng.choices([*t, "xyzzy", "license"], k=rng.randrange(0, 6))
        got = covered_spans([w.encode() for w in words])
        assert got == naive_spans(words)
        found += len(got)
    assert found > 100


def test_long_texts_take_linear_time():
    for text in (b"mit license " * 850_000, b"permission is hereby granted free of charge " * 230_000):
        began = time.perf_counter()
        r = scan(text)
        assert time.perf_counter() - began < 20
        assert r[0] == text.count(b" ")
    assert scan(b"x mit license " * 1000)[1:4] == (1000, 1, 2998)
