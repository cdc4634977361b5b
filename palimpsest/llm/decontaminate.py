"""Benchmark decontamination by spaced-seed hashing.

A spaced seed looks at some token positions of a short span and ignores the
others, so a hash of what it sees survives substitutions at the ignored places.
The seeds of all benchmark items are joined with those of all documents; around
each hit the two texts are laid side by side and equal tokens are counted, which
tolerates further substitutions. DataFrame functions only.

Which items can slip through with few enough substitutions follows from the masks
alone: those of MASKS miss none of 8, 9 and 11 to 17 tokens, and with those of
LIGHT, for items of up to SHORT tokens, none of 5 to 17. Items below that are
matched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, materialise, small

#: Fixed masks; 1 is looked at. All have five ones.
MASKS = ("11111", "1101011", "110010101")
WEIGHT = 5
#: Masks for items of at most SHORT tokens.
LIGHT, SHORT = ("111", "11011"), 10
#: Overlaps need this many equal tokens at equal places, or this share of a shorter item.
MIN_EQUAL, SHORT_SHARE = 13, 0.8
#: Tokens to either side of a hit that are compared.
REACH = 64
SEPARATOR = r"[\x00-/:-@\[-`{-\x7f]+"


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters, digits and non-ASCII characters; null text: none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_tokens(df: DataFrame, keep: list[Column], text: Column, name: str) -> DataFrame:
    """``keep`` and the tokens of ``text``. Exploding an array of one keeps the optimiser from copying the expression into the lambdas that read it, where it would run once per token."""
    return df.select(*keep, F.explode(F.array(tokens(text))).alias(name))


def seeds(h: Column, mask: int) -> Column:
    """Hash of what the mask, by its number in MASKS and then LIGHT, sees at each place of the token array."""
    form = (MASKS + LIGHT)[mask]
    at = [i for i, c in enumerate(form) if c == "1"]
    places = F.slice(h, F.lit(1), F.greatest(F.size(h) - (len(form) - 1), F.lit(0)))
    return F.transform(places, lambda x, i: F.xxhash64(F.lit(mask), x, *(F.get(h, i + k) for k in at[1:])))


def whole_seed(h: Column) -> Column:
    """The hash of all tokens, of a text too short for MASKS; longer ones have none."""
    return F.when((F.size(h) > 0) & (F.size(h) < WEIGHT), F.array(F.xxhash64(F.lit(-1), h))).otherwise(F.array().cast("array<bigint>"))


def with_seeds(df: DataFrame, keep: list[str], light: bool = False) -> DataFrame:
    """One row per seed of column ``h``: ``keep``, ``seed`` and its place ``i``; ``light``: by the masks of LIGHT too."""
    masks, n = MASKS + LIGHT * light, F.size("h")
    every = [*(seeds(F.col("h"), m) for m in range(len(masks))), whole_seed(F.col("h"))]
    each = df.select(*keep, n.alias("n"), F.concat(*every).alias("all")).select(*keep, "n", F.posexplode("all").alias("at", "seed"))
    i, before = F.col("at"), F.lit(0)
    for mask in masks:  # the seeds of one mask follow those of another
        before = before + F.greatest(F.col("n") - (len(mask) - 1), F.lit(0))
        i = F.when(F.col("at") >= before, F.col("at") - before).otherwise(i)
    return each.select(*keep, "seed", i.cast("int").alias("i"))


def benchmark_items(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each different token sequence of the benchmark once: smallest id, number of items, tokens."""
    slim = with_tokens(benchmark, [F.col(item_col).alias("item_id")], F.col(text_col), "item_h").where(F.size("item_h") > 0)
    return slim.groupBy("item_h").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items")).withColumn("item_key", F.xxhash64("item_h"))


def _verified(hits: DataFrame, keep: list[str]) -> DataFrame:
    """Of rows with h, item_h and the places i and j of a hit: those with enough equal tokens, with counts and places."""
    back = F.least(F.col("i"), F.col("j"), F.lit(REACH))
    n = F.least(F.size("h") - F.col("i"), F.size("item_h") - F.col("j"), F.lit(REACH)) + back
    side = lambda a, at: F.slice(F.col(a), F.col(at) - back + 1, n)
    equal = F.aggregate(F.zip_with(side("h", "i"), side("item_h", "j"), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    need = F.least(F.lit(MIN_EQUAL), F.ceil(F.size("item_h") * SHORT_SHARE))
    return hits.select(*keep, (F.col("i") - back).alias("doc_word"), (F.col("j") - back).alias("item_word"), n.alias("n_aligned"), equal.alias("n_equal"), need.alias("need")).where("n_equal >= need").drop("need")


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: list[Column], text: Column) -> DataFrame:
    """Verified hits: the named ``keys`` of the document, item_id, n_items, doc_word, item_word, n_aligned, n_equal (best first is not implied).

    While the benchmark's seeds are few by check they are broadcast, and a
    document is scanned, joined and verified in one go, without a shuffle.
    Beyond that the seeds are shuffled; documents are joined back for the
    verification by a hash of their text, once per item and diagonal, with all
    hits of the diagonal. Both ways verify every hit. Documents get the seeds of
    LIGHT only while some item is short enough to need them.
    """
    items = materialise(benchmark_items(benchmark), "items")
    plain = items.withColumnRenamed("item_h", "h")
    few = plain.where(F.size("h").between(WEIGHT, SHORT))
    light = bool(few.head(1))
    both = with_seeds(plain, ["item_key"]).unionByName(with_seeds(few, ["item_key"], True)) if light else with_seeds(plain, ["item_key"])
    seeded = materialise(both.withColumnRenamed("i", "j").distinct(), "seeds")
    tail = ["item_id", "n_items"]
    if small(seeded) and small(items.select(F.explode("item_h"))):
        names = [f"key{i}" for i in range(len(keys))]
        scanned = with_tokens(docs, [k.alias(n) for k, n in zip(keys, names, strict=True)], text, "h")
        hits = with_seeds(scanned, [*names, "h"], light).join(F.broadcast(seeded), "seed").join(F.broadcast(items), "item_key")
        return _verified(hits, [*names, *tail])
    return _by_shuffle(docs, items, seeded, keys, text, light)


def _by_shuffle(docs: DataFrame, items: DataFrame, seeded: DataFrame, keys: list[Column], text: Column, light: bool) -> DataFrame:
    names, tail = [f"key{i}" for i in range(len(keys))], ["item_id", "n_items"]
    full = F.coalesce(text, F.lit(""))
    key = {"k1": F.xxhash64(full), "k2": F.xxhash64(F.lit(1), full)}
    each = docs.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), *(v.alias(n) for n, v in key.items()), full.alias("full"))
    hits = with_seeds(with_tokens(each, [F.col("k1"), F.col("k2")], F.col("full"), "h"), ["k1", "k2"], light).join(seeded, "seed")
    spots = hits.groupBy("k1", "k2", "item_key", (F.col("i") - F.col("j")).alias("shift")).agg(F.collect_set("j").alias("js"))  # all hits of a diagonal: no more than the item has tokens
    spots = materialise(spots, "spots")
    texts = each.join(spots.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    texts = with_tokens(texts, [F.col(c) for c in (*names, "k1", "k2")], F.col("full"), "h")
    paired = texts.join(spots, ["k1", "k2"]).join(items, "item_key")
    each_hit = paired.select(*names, *tail, "h", "item_h", "shift", F.explode("js").alias("j")).withColumn("i", F.col("j") + F.col("shift"))
    return _verified(each_hit, [*names, *tail])


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and different benchmark text that it overlaps: doc_id, item_id (the smallest with that text), n_items (how many have it), n_equal, n_aligned, doc_word, item_word of the best overlap.

    Null and empty texts overlap nothing, and an empty table gives no rows. Items
    of fewer than WEIGHT tokens stand in many clean texts; they overlap documents
    that have the same tokens and no others. Texts may be of any length: they are
    cut into tokens and seeds row by row, in time that is linear in them.
    Documents with one id (repeated rows, null) give one row together.
    """
    found = overlaps(docs, benchmark, [F.col(id_col)], F.col(text_col))
    best = F.max(F.struct("n_equal", "n_aligned", (-F.col("doc_word")).alias("doc_word"), (-F.col("item_word")).alias("item_word"))).alias("best")
    rows = found.groupBy("key0", "item_id").agg(F.max("n_items").alias("n_items"), best)
    return rows.select(F.col("key0").alias("doc_id"), "item_id", "n_items", *(F.abs(f"best.{c}").cast("long").alias(c) for c in ("n_equal", "n_aligned", "doc_word", "item_word")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that overlap a benchmark item.

    Documents are told by two hashes of their text, so null or repeated ids do
    no harm and copies share a verdict.
    """
    full = F.coalesce(F.col(text_col), F.lit(""))
    a, b = fresh(docs, "leak_a", "leak_b")
    found = overlaps(docs, benchmark, [F.xxhash64(full), F.xxhash64(F.lit(1), full)], F.col(text_col))
    bad = materialise(found.select(F.col("key0").alias(a), F.col("key1").alias(b)).distinct(), "leaks")
    side = F.broadcast(bad) if small(bad) else bad
    return docs.join(side, (F.xxhash64(full) == F.col(a)) & (F.xxhash64(F.lit(1), full) == F.col(b)), "left_anti")
