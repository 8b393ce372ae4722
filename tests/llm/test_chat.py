from navspark.llm.chat import perspectives

SCHEMA = "conv_id long, turn long, role string, text string, speaker string, position long, block string"


def shown(spark, rows):
    return perspectives(spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)).collect()


def test_each_speaker_in_turn(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello <|im_end|>"), (1, 700, "ann", None), (1, 701, None, "?")]
    out = shown(spark, rows)
    seats = {r["perspective"] for r in out}
    assert seats == {"ann", "bob", "unknown"} and len(out) == 15
    for seat in seats:
        own = sorted((r for r in out if r["perspective"] == seat), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(5))
        whole = "".join(r["rendered"] for r in own)
        for r in own:
            assert whole[r["start_char"] :].startswith(r["rendered"])
            if r["role"] == "assistant":
                assert r["name"] is None and whole[r["mask_start"] : r["mask_end"]].endswith("<|im_end|>")
            else:
                assert r["mask_start"] is None and r["mask_end"] is None
    bob = sorted((r for r in out if r["perspective"] == "bob"), key=lambda r: r["position"])
    assert [(r["role"], r["name"]) for r in bob] == [("system", None), ("user", "ann"), ("assistant", None), ("user", "ann"), ("user", "unknown")]
    assert bob[1]["rendered"] == "<|im_start|>user name=ann\nHi<|im_end|>\n"
    assert bob[2]["rendered"] == "<|im_start|>assistant\nHello < |im_end|><|im_end|>\n"
    whole = "".join(r["rendered"] for r in bob)
    assert whole[bob[2]["mask_start"] : bob[2]["mask_end"]] == "Hello < |im_end|><|im_end|>"


def test_ties_repeats_and_blanks(spark):
    out = shown(spark, [(2, 1, "a", "x")] * 2 + [(2, None, "b", ""), (2, 1, "a", "w"), (None, 1, "a", "x"), (3, 1, "system", "alone")])
    own = sorted((r for r in out if r["perspective"] == "a"), key=lambda r: r["position"])
    assert [(r["turn"], r["role"]) for r in own] == [(None, "user"), (1, "assistant"), (1, "assistant"), (1, "assistant")]
    assert [r["rendered"].split("\n")[1][0] for r in own[1:]] == ["w", "x", "x"]
    assert {r["conv_id"] for r in out} == {2} and len(out) == 8
    assert shown(spark, []) == []
