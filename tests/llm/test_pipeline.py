import random
from collections import Counter

import corpus_pipeline

from tests.llm.test_decontaminate import plain as leaks
from tests.llm.test_jaccard import plain as components


def test_stages_one_by_one(spark, documents, tmp_path):
    draw = random.Random(6)
    words = {"en": ["en%d" % i for i in range(400)], "de": ["ürgh%s" % chr(97 + i % 26) * (1 + i // 26) for i in range(200)]}
    text = lambda lang, n: " ".join(draw.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang := draw.choice(["en", "de"]), draw.choice([4, 30, 90])), lang, draw.choice(["s1", "s2", None])) for i in range(60)]
    items = [(i, text("en", 25)) for i in range(4)]
    rows += [(100 + i, rows[i][1] + " extra", "en", "s1") for i in range(0, 30, 3)] + [(200, rows[0][1], "en", "s2")]
    rows += [(300 + i, f"{text('en', 20)} {items[i % 4][1]}", "en", "s1") for i in range(6)]
    rows += [(400, None, "en", "s1"), (401, "", None, "s1"), (402, "123 456", None, "s2"), (7, rows[7][1], rows[7][2], rows[7][3])]
    sf_dir = str(tmp_path)
    documents(rows, extra=False).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        after = docs.collect()
        ids = Counter(r["doc_id"] for r in after)
        if name != "shards":
            assert docs.columns == columns
        if name == "language":
            expected = Counter(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
            assert ids == expected
        elif name == "near_copies":
            roots = components([(r["doc_id"], r["text"]) for r in before])
            assert ids == Counter(i for i, (_, root) in roots.items() if i == root)
        elif name == "leaks":
            bad = {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in before], items)}
            assert bad and ids == Counter(r["doc_id"] for r in before if r["doc_id"] not in bad)
        elif name == "mixture":
            size = lambda r: len((r["text"] or "").split())
            assert max(ids.values()) == 2
            assert abs(sum(map(size, after)) - 1.5 * sum(map(size, before))) < 200
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        else:
            assert ids == Counter(r["doc_id"] for r in before)
            sizes = Counter(r["shard"] for r in after)
            assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
    assert set(kept) >= {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_empty_table(spark, documents, tmp_path):
    sf_dir = str(tmp_path)
    documents([], extra=False).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf_dir).collect() == []
