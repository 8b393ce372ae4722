import random

from navspark.llm.lines import _keys, probes, repeated_lines, segments, within, without_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(draw, line, n):
    line = list(line)
    for _ in range(n):
        at, kind = draw.randrange(len(line)) if line else 0, draw.randrange(3) if line else 2
        if kind == 0:
            line[at] = draw.choice("abxyz")
        elif kind == 1:
            del line[at]
        else:
            line.insert(at, draw.choice("abxyz"))
    return "".join(line)


def test_banded_distance():
    draw = random.Random(2)
    for _ in range(3000):
        a = "".join(draw.choice("ab") for _ in range(draw.randrange(12)))
        b = edited(draw, a or "a", draw.randrange(5))
        for k in (1, 2, 3):
            assert within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_segments_cover_a_line():
    for n in range(3, 40):
        parts = segments(n, 2)
        assert [at for at, _ in parts] == [0, parts[0][1], parts[0][1] + parts[1][1]] and sum(size for _, size in parts) == n
        assert max(s for _, s in parts) - min(s for _, s in parts) <= 1


def test_against_all_pairs(documents):
    draw = random.Random(3)
    bases = ["".join(draw.choice("abcdefghij éß") for _ in range(draw.choice([10, 19, 20, 21, 25, 60, 300]))) for _ in range(25)]
    rows = []
    for d in range(40):
        lines = [edited(draw, draw.choice(bases), draw.randrange(4)) for _ in range(draw.randrange(6))]
        rows.append((d, "\n".join([*lines, draw.choice(["", "  ", "abc"])])))
    rows += [(100, None), (101, ""), (102, "abc\nabc"), (103, bases[0] * 2000)]
    frame = documents([(d, t, None, None) for d, t in rows])
    expected, earlier = {}, []
    for d, text in rows:
        gone = []
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if not line.strip(" "):
                continue
            if any(line == x or min(len(line), len(x)) >= 20 and abs(len(line) - len(x)) <= 2 and distance(line, x) <= 2 for x in earlier):
                gone.append(i)
            if line not in earlier:
                earlier.append(line)
        expected[d] = gone
    dropped = repeated_lines(frame)
    out = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in dropped.collect()}
    assert out == {d: (0 if t is None else t.count("\n") + 1, expected[d]) for d, t in rows}
    assert sum(len(g) for g in expected.values()) > 20
    clean = without_lines(frame, dropped)
    assert clean.columns == frame.columns
    for r in clean.collect():
        text = dict(rows)[r["doc_id"]]
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in expected[r["doc_id"]])
        assert r["text"] == kept


def test_repeated_rows_and_empty_table(documents):
    line = "a line that is quite long"
    out = repeated_lines(documents([(2, line, None, None), (2, line, None, None), (None, line, None, None), (1, line, None, None)])).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["dropped"]) for r in out) == [(1, 1, []), (2, 1, [0])]
    assert repeated_lines(documents([])).collect() == []


def test_a_large_group_of_near_equal_lines(documents):
    draw = random.Random(9)
    base = "this line stands in very many documents, each time with other small faults in it"
    rows = [(0, base)] + [(i, edited(draw, base, 2) if i % 3 else edited(draw, base, 1)) for i in range(1, 2000)]
    # Lines that share two segments with all others but lie further apart than the distance.
    rows += [(5000 + i, f"{base[:30]}{draw.randrange(10**9):09d}{base[39:]}") for i in range(150)]
    frame = documents([(d, t, None, None) for d, t in rows]).repartition(6)
    out = {r["doc_id"]: r["dropped"] for r in repeated_lines(frame).collect()}
    lines = dict(rows)
    for d, t in rows:
        if 0 < d < 2000:
            assert out[d] == [0], t  # within 2 edits of the first
    far = [d for d, _ in rows if d >= 5000]
    for d in far:
        expected = any(within(lines[d], lines[x], 2) for x in lines if x < d)
        assert out[d] == ([0] if expected else [])


def test_a_line_goes_to_a_tile_once(spark):
    draw = random.Random(4)
    lines = [(h, "".join(draw.choice("abcdefgh ") for _ in range(n)), h) for h, n in enumerate([20, 21, 22, 47, 300])]
    rows = _keys(spark.createDataFrame(lines, "h long, line string, doc_id long").coalesce(1), 2).collect()
    for h, line, _ in lines:
        keys = [r["key"] for r in rows if r["h"] == h]
        spots = {(other, i, at) for other, i, at, _ in probes(len(line), 2)}
        assert len(keys) == len(spots) == len({k >> 1 for k in keys}) and sum(k % 2 == 0 for k in keys) == 3
