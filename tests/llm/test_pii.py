import hashlib
import random
import re

import pytest

from candor.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    None, "", "a@b", "a@b.c x@y.co.uk_z@q.r, @b.c a@@b.c", "x" * 3000 + "@" + "y.z" * 500, "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3", "0" * 4000,
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 9", "call +1 (377) 555-0271 or +49 30 1234567 now +1 2", "(377) 555-0271 é🙂 +1 (377) 555-0271.", "🙂 mail é.x@y.z 🙂 10.0.0.1",
    "+1 (377) 555-0271" * 40, "5500 0000 0000 0004 5500.0000.0000.0004", "me [at] home (dot) org", "12.5 + 3 = 15.5; 2024-01-02 10:00",
]


def fine(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(TEXTS)] + [(2, TEXTS[3], "again", 4)], "doc_id long, text string, body string, n_chars long")


def test_base_spans(spark, docs):
    rows = pii.digest(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    wanted = {(i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans(t)).encode()).hexdigest()) for i, t in [*enumerate(TEXTS), (2, TEXTS[3])]}
    assert {(r.doc_id, r.base_sha256) for r in rows} == wanted
    assert set(rows[0].asDict()) == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"}
    for r in rows:
        if r.doc_id != 2:
            own = {f"{k}:{a}:{b}" for k, a, b in spans(TEXTS[r.doc_id])}
            assert own <= set(r.spans.split(",")) | {""} and r.n_email == sum(x.startswith("email") for x in own)
    assert pii.digest(docs.limit(0)).count() == 0


def test_redaction_keeps_the_rest(spark, docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.body): r for r in out.collect()}
    assert got[0, "clash"].text is None
    assert got[10, "clash"].text == "🙂 mail é[EMAIL] 🙂 [IP]"
    assert got[14, "clash"].text == TEXTS[14] and got[14, "clash"].n_chars == len(TEXTS[14])


PLANTED = [
    ("email", "ann.lee [at] mail3 [dot] example [dot] org"), ("email", "bo_7 (at) post.example.net"), ("email", "kim AT corp DOT example DOT com"), ("email", "j.doe[at]uni[dot]example[dot]de"),
    ("ip", "10[.]20[.]30[.]40"), ("ip", "192(.)168(.)7(.)255"), ("ip", "8[dot]8[dot]4[dot]4"), ("ip", "172 dot 16 dot 0 dot 9"),
    ("card", "4111.1111.1111.1111"), ("card", "5500/0000/0000/0004"), ("card", "4012_8888_8888_1881"), ("card", "4222:2222:2222:2220"),
    ("phone", "(415) 555-0132"), ("phone", "212-555-0187"), ("phone", "646.555.0111"), ("phone", "001 503 555 0144"),
    ("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), ("secret", "sk-5d41402abc4b2a76b9719d911017c592"),
]
HARMLESS = [
    "We met at noon.Then we left.", "Look (at) this picture.", "It was sold at 12.5 dollars.", "Due 2024-03-09 10:30 sharp.", "On 03.11.2021 at last.", "Version 1.2.3.4.5 is out.", "300[.]400[.]500[.]1 is none.",
    "4111.1111.1111.1112 fails.", "Order 5500/0000/0000/0005 shipped.", "The years 1998-2004 were fine.", "It cost 45 300 in all.", "Eine Donaudampfschifffahrtsgesellschaft.", "See docs/guide/chapter-12/section now.", "----------------------------------------", "Pages 12.40 to 13.80.",
]


def test_trees_add_hidden_spans_and_leave_others(spark):
    rng = random.Random(2)
    words = "the and of tion ing er house river green seven over under".split()
    around = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 9)))
    rows, want = [], set()
    for i, (kind, value) in enumerate(PLANTED * 3):
        lead = around() + " "
        rows.append((i, lead + value + " " + around(), None))
        want.add((i, kind, len(lead), len(lead) + len(value)))
    rows += [(1000 + i, around() + " " + t + " " + around(), None) for i, t in enumerate(HARMLESS * 3)]
    rows += [(2000 + i, f"{around()} mail {i}.x@mail{i % 7}.example.com or +1 (377) 555-{1000 + i} from 10.1.{i}.7 {around()}", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    found = {r.doc_id: r for r in pii.find(docs).select("doc_id", "extra").collect()}
    got = {(r.doc_id, x.k, x.s, x.e) for r in found.values() for x in r.extra}
    assert len(found) == len(rows)
    assert len(got & want) >= 0.9 * len(want), sorted(want - got)[:5]
    assert len(got & want) >= 0.9 * len(got), sorted(got - want)[:5]
    spans = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    assert all(f"{k}:{a}:{b}" in spans[i].split(",") for i, k, a, b in got)


def test_redaction_of_any_columns(spark):
    rows = [(None, "mail a@b.cd now", 3, "x"), (7, "mail a@b.cd now", 3, "y"), (7, None, 3, "z"), (7, "", 3, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, extra string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.extra, r.text, r["a.b"], r.doc_id) for r in out.collect()) == [("w", "", 3, 7), ("x", "mail [EMAIL] now", 3, None), ("y", "mail [EMAIL] now", 3, 7), ("z", None, 3, 7)]


def test_long_texts_take_time_in_proportion(spark):
    texts = ["1 " * 60_000, "a at b " * 40_000, "+1 (377) 555-0271 x 4111.1111.1111.1111 " * 1500, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" * 2000, "(" * 90_000, "0." * 60_000]
    rows = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_phone for r in rows}[2] == 1500
