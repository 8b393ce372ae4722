import zlib
from collections import Counter

from navspark.llm.sharding import balanced_shards


def placed(frame, shards):
    rows = balanced_shards(frame, shards=shards).collect()
    sizes = Counter(r["shard"] for r in rows)
    if rows:
        assert set(sizes) <= set(range(shards))
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    return rows


def test_copies_gather_and_sizes_stay_even(documents):
    rows = [(i, f"text {i}", "en", "a") for i in range(90)] + [(100 + i, "five of these", "en", "a") for i in range(5)]
    rows += [(200 + i, f"pair {i // 2}", "en", "a") for i in range(20)] + [(300, None, None, None), (301, None, None, None), (302, "", "en", "a")]
    out = placed(documents(rows), 8)
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert len({r["shard"] for r in out if 100 <= r["doc_id"] < 105}) == 1
    for i in range(10):
        assert len({r["shard"] for r in out if r["doc_id"] in (200 + 2 * i, 201 + 2 * i)}) == 1
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        text = texts[r["doc_id"]]
        assert r["size"] == 16 + len((text or "").encode())
        assert r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_group_larger_than_a_shard_fills_few(documents):
    rows = [(i, "same", "en", "a") for i in range(40)] + [(100 + i, f"t{i}", "en", "a") for i in range(60)]
    out = placed(documents(rows), 5)
    assert len({r["shard"] for r in out if r["doc_id"] < 40}) <= 3


def test_all_rows_linked(documents):
    placed(documents([(i, f"g{i % 3}", "en", "a") for i in range(31)]), 4)


def test_repeated_rows_and_empty_table(documents):
    out = placed(documents([(1, "a", "en", "s")] * 7 + [(None, "b", "en", "s")] * 2), 3)
    assert len(out) == 9
    assert placed(documents([]), 3) == []
