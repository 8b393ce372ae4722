import hashlib
import random
import re
from collections import defaultdict

import pytest

from navspark.llm.sanitise import SUPPORT, disclosures, mentions, private_spans, sanitised

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def context(text, kind, start, end, reach=200):
    """Whole words beside a span, up to the next match of its kind, valid or not."""
    spans = [m.span() for m in PATTERNS[kind].finditer(text)]
    if kind == "card":  # Shorter and longer numbers never count as matches.
        spans = [(a, b) for a, b in spans if 16 <= len(re.sub("[^0-9]", "", text[a:b])) <= 19]
    low = max([b for _, b in spans if b <= start], default=0)
    high = min([a for a, _ in spans if a >= end], default=len(text))
    left, right = text[low:start], text[end:high]
    if len(left) > reach:
        left = re.sub(r"^[^\W\d_]+", "", left[-reach:])
    if len(right) > reach:
        right = re.sub(r"[^\W\d_]+$", "", right[:reach])
    return {w for w in WORD.findall((left + " " + right).translate(LOWER)) if len(w) >= 4}


def plain(texts, support=SUPPORT):
    """Spans of each text, by sets of texts."""
    texts = {t for t in texts if t is not None}
    beside, with_entity, with_term = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        for w in WORD.findall(t.translate(LOWER)):
            if len(w) >= 4:
                with_term[w].add(t)
        for kind, a, b in base(t):
            value = t[a:b].translate(LOWER) if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])
            with_entity[kind, value].add(t)
            for w in context(t, kind, a, b):
                beside[(kind, value), w].add(t)
    given = {w for (e, w), own in beside.items() if len(own) >= support and own == with_term[w] and len(with_entity[e]) < len(texts)}
    out = {}
    for t in texts:
        spans = base(t)
        terms = [("term", m.start(), m.end()) for m in WORD.finditer(t.translate(LOWER)) if m[0] in given]
        spans += [x for x in terms if not any(a < x[2] and b > x[1] for _, a, b in base(t))]
        out[t] = spans
    return out, given


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


TRICKY = [
    "a@b.c_d@e.f", "a@b", "@b.c", "x.@y..z a@b-.c-d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.000.1.01 1.2.3", "a1.2.3.4b", "999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111 1111 1111", "41111111111111111111111", "4111111111111111", "04111111111111111", "7 4111111111111111", "5 6",
    "+1 (212) 555-0153", "+12345678", "+1234567", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++49 (0) 30-1234567.", "+(1)23456789", "é@x.de ünï+1@ß.com", "",
    "tel +49 30 1234567 oder +49-30-7654321", " \n\t", "😀a@b.c😀 +1 212 555 0153",
]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    words = ["Anton", "berta", "Cäsar", "dora", "emil", "friedrich", "gustav", "im", "é"]
    out = list(TRICKY)
    for _ in range(150):
        out.append(" ".join(draw.choice([*words, "x@y.de", "+49 30 1234567", "10.0.0.1", "4111 1111 1111 1111", "12 34", "p.q@r.org"]) for _ in range(draw.randint(1, 80))))
    # Terms that stand in these texts alone, each time beside one address.
    out += [f"{'lorem ipsum ' * n} Zaphod of Betelgeuse, write to zb@heart.gold soon {'dolor ' * n}" for n in (1, 3, 30)]
    out += ["zb@heart.gold once more, without a name", "marvin marvin trillian", "Marvin, zb@heart.gold", "Trillian trillian@heart.gold", "trillian@heart.gold asks Trillian: why"]
    return out


def test_equals_plain_spans(spark, documents, texts):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(5000 + i, texts[40], "en", "s") for i in range(400)] + [(None, texts[41], "en", "s"), (None, None, "en", "s"), (7, None, "en", "s"), (8, "x@y.de", None, None)]
    rows.append((9000, "word a@b.com 10.1.1.1 " * 4000, "en", "s"))
    truth, given = plain([r[1] for r in rows])
    assert {"zaphod", "betelgeuse", "trillian"} & given == {"zaphod", "betelgeuse"}
    out = private_spans(documents(rows).repartition(5)).collect()
    assert len(out) == len(rows)
    expected = []
    for i, t, _, _ in rows:
        spans = truth.get(t, [])
        own = [x for x in spans if x[0] != "term"]
        counts = [sum(x[0] == k for x in own) for k in PATTERNS]
        expected.append((i, *counts, hashlib.sha256(listed(own).encode()).hexdigest(), listed(spans)))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))


def test_disclosure_measures(spark, documents, texts):
    frame = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    found = mentions(frame)
    given, held = disclosures(frame, found)
    rows = {(r["entity"], r["term"]): r for r in given.collect()}
    one = rows["email:zb@heart.gold", "zaphod"]
    assert (one["together"], one["with_term"], one["with_entity"]) == (3, 3, 5)
    assert one["pmi"] == pytest.approx(one["ic"])
    assert {r["term"] for r in held.collect()} == {t for _, t in rows}
    # A lower threshold also takes terms that stand elsewhere now and then.
    loose = {(r["entity"], r["term"]) for r in disclosures(frame, found, disclosure=0.6)[0].collect()}
    assert set(rows) < loose
    assert disclosures(frame, found, support=4)[0].where("term = 'zaphod'").count() == 0


def test_sanitised_text(spark, documents):
    rows = [(1, "Zaphod, a@b.com! +1 212 555 0153", "en", "s"), (2, "say Zaphod\na@b.com twice a@b.com", "en", "s"), (3, "nothing here, été", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s")]
    rows += [(10 + i, f"zaph{c} goes about", "en", "s") for i, c in enumerate("abcdef")]
    frame = documents(rows)
    out = sanitised(frame)
    assert out.columns == frame.columns
    shown = {r["doc_id"]: r["text"] for r in out.collect()}
    # Other words begin alike, so the name keeps its beginning.
    assert shown[1] == "zaph…, [EMAIL]! [PHONE]"
    assert shown[2] == "say zaph…\n[EMAIL] twice [EMAIL]"
    assert {k: shown[k] for k in (3, 4, 5, 10)} == {3: rows[2][1], 4: None, 5: "", 10: rows[5][1]}
    alone = {r["doc_id"]: r["text"] for r in sanitised(documents(rows[:5])).collect()}
    assert alone[1] == ", [EMAIL]! [PHONE]"


def test_empty_and_clean_tables(spark, documents):
    assert private_spans(documents([])).collect() == []
    assert sanitised(documents([])).collect() == []
    clean = private_spans(documents([(1, "no such thing", "en", "s")])).collect()
    assert [(r["doc_id"], r["n_email"], r["spans"]) for r in clean] == [(1, 0, "")]


def test_long_runs_stay_linear(spark, documents):
    rows = [(1, "a" * 400_000, "en", "s"), (2, "7" * 400_000, "en", "s"), (3, "x@" + "a." * 100_000 + "b", "en", "s"), (4, "1 " * 200_000, "en", "s")]
    out = {r["doc_id"]: r for r in private_spans(documents(rows)).collect()}
    assert (out[1]["spans"], out[2]["spans"], out[4]["spans"]) == ("", "", "")
    assert out[3]["spans"] == "email:0:200003"
