import itertools
import random
import zlib

import numpy as np
import pytest

from folioworks.llm import packing

ROWS = [(1, "Hello world, it's   fine ok"), (2, None), (3, ""), (4, "É " * 3000), (5, "x\x1cy Á ǅ"), (6, "word " * 9000), (6, "word " * 9000), (None, "a")]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_pieces_equal_plain_encoding(spark, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in packing.token_pieces(spark.createDataFrame(ROWS, "doc_id long, text string"), path).collect()), key=str)
    want = []
    for key, text in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            cut = ids[start : start + 4096]
            want.append((key, k, start, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())))
    assert got == sorted(want, key=str)


def valid(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_is_valid_and_near_the_bound(spark):
    rnd = random.Random(1)
    rows = [(i, 0, 0, rnd.choice([rnd.randint(1, 300), rnd.randint(1, 4096)]), 0) for i in range(3000)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), per_group=400).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    bins = valid(out, 4096)
    assert bins <= packing.dual_bound(np.array([r[3] for r in rows]), 4096) + 2


def test_repeated_rows_and_null_ids_are_dealt_like_others(spark):
    rows = [(None, 0, 0, 1500, 5)] * 900 + [(9_007_199_254_740_993, 0, 0, 1300, 6)] * 900
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), per_group=200).collect()
    assert valid(out, 4096) <= len(packing.best_fit_decreasing(np.array([r[3] for r in rows]), 4096)[1]) + 9
    assert sum(r["doc_id"] is None for r in out) == 900 and sum(r["doc_id"] == 9_007_199_254_740_993 for r in out) == 900


def test_bound_never_exceeds_the_optimum():
    rnd = random.Random(2)

    def optimum(items, size):
        for n in itertools.count(1):
            def place(i, room):
                if i == len(items):
                    return True
                tried = set()
                for b in range(n):
                    if room[b] >= items[i] and room[b] not in tried:
                        tried.add(room[b])
                        room[b] -= items[i]
                        if place(i + 1, room):
                            return True
                        room[b] += items[i]
                return False
            if place(0, [size] * n):
                return n

    for _ in range(60):
        items = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        assert packing.dual_bound(np.array(items), 20) <= optimum(items, 20) <= len(packing.best_fit_decreasing(np.array(items), 20)[1])


def test_empty_table(spark, path):
    none = spark.createDataFrame([], "doc_id long, text string, sequence_id long")
    assert packing.pack(packing.token_pieces(none, path)).count() == 0
