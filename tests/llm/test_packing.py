import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm.packing import curve_keys, pack


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def hold(docs, rows, length):
    """Round trip: pieces give back each document's ids, sequences have no gap and no padding."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*t.encode(r.text or "", add_special_tokens=False).ids, 0])
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
        pieces.setdefault(r.doc_id, []).append(r)
    for x in sequences.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at and n > 0
            at += n
        assert at <= length and at & (at - 1) == 0
    assert pieces.keys() == want.keys()
    for doc, each in want.items():
        left = sorted((r.start, r["length"], r.ids_crc32, r.doc_tokens) for r in pieces[doc])
        for ids in each:
            assert all(t == len(ids) for *_, t in left)
            at = 0
            while at < len(ids):
                i = next(k for k, x in enumerate(left) if x[0] == at)
                _, n, c, _ = left.pop(i)
                assert c == crc(ids[at : at + n])
                at += n
            assert at == len(ids)
        assert not left


def test_round_trip(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hold(docs, pack(docs).collect(), 1024)
    odd = odd.where("not (doc_id <=> 3)").unionByName(odd.where("doc_id = 3"))
    hold(odd.where("doc_id is null or doc_id <> 3"), pack(odd.where("doc_id is null or doc_id <> 3"), length=64).collect(), 64)
    assert pack(empty).count() == 0
    twice = odd.where("doc_id = 3")
    rows = pack(twice).collect()
    assert sum(r["length"] for r in rows) == 2 * rows[0].doc_tokens


def test_near_vectors_get_near_keys():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    order = np.argsort(curve_keys(x))
    step = np.linalg.norm(np.diff(x[order], axis=0), axis=1).mean()
    assert step < 0.35 * np.linalg.norm(np.diff(x, axis=0), axis=1).mean()
