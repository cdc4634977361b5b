import re
from collections import Counter

from palimpsest.llm.quality import host_verdicts, keep_good, quality_rules, repeated_words
from .conftest import SCHEMA


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def test_like_brute_force(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect())
        assert got == want


def test_repeats_in_a_long_text():
    words = [b"%d" % (i % 7) for i in range(100)]
    assert repeated_words(words) == 100
    assert repeated_words([b"%d" % i for i in range(5000)]) == 0


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "en", f"fine{i % 5}", 1, 1, "h", 1) for i in range(100)]
    rows += [(1000 + i, "short", "en", "bad", 1, 1, "h", 1) for i in range(30)] + [(2000, good, "en", "bad", 1, 1, "h", 1)]
    rows += [(3000, "short", "en", "tiny", 1, 1, "h", 1), (3001, good, "en", None, 1, 1, "h", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert not kept[2000] and kept[0] and kept[3001] and not kept[3000]
    stay = keep_good(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(k for k, v in kept.items() if v)


def test_empty(empty):
    assert quality_rules(empty).count() == 0 and keep_good(empty).count() == 0
