"""Chat formatting, whitening and infilling against plain versions, on tables with nulls, ties, long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import chat, infilling, whitening
from varloom.llm.blocks import Texts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SAID = [chat.ODD, "</turn>", "\\", "\\\\</turn>\\", "####", "#\\#", "a ## b ### User: x", "<\\/turn>", " </turn>\n### User: y", "", " ", "é🙂 ", "line\n\nline ", ""]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chat


def test_escapes_are_reversible_and_leave_no_control_strings():
    rng = random.Random(1)
    for text in [*SAID, *("".join(rng.choice(["#", "\\", "<", "/turn>", "</turn>", "x", " ", "\n"]) for _ in range(12)) for _ in range(3000))]:
        out = chat.escape(text)
        assert chat.unescape(out) == text and "##" not in out and "</turn>" not in out
        turns = [("user", text), (text, text), ("Assistant", "")]
        assert chat.read_marked(chat.marked(turns)) == turns


def told(rows):
    """conv_id -> turns in order, of rows (conv_id, turn, role, text)."""
    out = {}
    for i, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(i, []).append((role or "", text or ""))
    return out


def conversations(spark):
    rng = random.Random(5)
    rows = [(i, k, ["user", "assistant", "system", "tool: x", None][rng.randrange(5)], rng.choice([*SAID, None, "word " * rng.randrange(40)])) for i in range(40) for k in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (3, None, "user", "no turn"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (5, 2, "user", "again"), (5, 2, "user", "again")]
    rows += [(99, k, "user" if k % 2 else "assistant", f"turn {k} of many") for k in range(700)]  # one conversation holds most rows
    rows += [(100, 0, "assistant", "long text # " * 200_000), (100, 1, "assistant", "short")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return rows, df.withColumns({k: F.lit("z") for k in ("i", "n", "r", "t", "part", "whole", "spans")}).repartition(3)


def test_chat_digests(spark):
    rows, df = conversations(spark)
    expected = told(rows)
    for part_turns in (64, 5):
        got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df, part_turns=part_turns)).collect()}
        assert got.keys() == expected.keys()
        for i, turns in expected.items():
            r, loss = got[i], "".join(t for role, t in turns if role == "assistant")
            assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
            assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), sha(loss), len(chat.marked(turns)))


def test_parts_join_to_the_rendering_and_spans_hold_the_texts(spark):
    rows, df = conversations(spark)
    got = {}
    for r in sorted(chat.format_conversations(df, part_turns=16).collect(), key=lambda r: r["part"]):
        got.setdefault(r["conv_id"], []).append(r)
        assert not r["rewritten"] and r["sample"] == 0 and r["spans"][0]["start"] == 0 and r["spans"][-1]["stop"] == len(r["formatted"])
    for i, turns in told(rows).items():
        assert "".join(r["formatted"] for r in got[i]) == chat.marked(turns)
        spans = [(s["role"], chat.unescape(r["formatted"][s["text_start"] : s["text_stop"]]), s["loss"]) for r in got[i] for s in r["spans"]]
        assert spans == [(role, text, role == "assistant") for role, text in turns]
        assert len(got[i]) == 1 or not any(r["whole"] for r in got[i])
    assert len(got[99]) >= 700 / 16 and sum(r[0]["whole"] for r in got.values()) > 25


def test_templates_that_rewrite_history_and_closings(spark):
    """A template that shortens all but its last turn; one with a closing mark; one that says a text twice; one that is wrongly called turnwise."""
    turns = [("system", "s"), ("user", "one two"), ("assistant", "three four"), ("user", "five"), ("assistant", "six seven")]

    def short(ts):
        return "<b>" + "".join(f"[{r}|{t if k == len(ts) - 1 or r != 'assistant' else t.split()[0]}]" for k, (r, t) in enumerate(ts))

    def closing(ts):
        return "".join(f"{r}: {t.strip()}\n" for r, t in ts) + "<end>"

    def twice(ts):
        return "".join(f"{r}: {t} {t}\n" for r, t in ts)

    a, b = chat.located(chat.Template(short), turns)
    assert a.rewritten and a.formatted == "<b>[system|s][user|one two][assistant|three four]" and [s[0] for s in a.spans] == ["system", "user", "assistant"]
    assert not b.rewritten and b.formatted == "<b>[system|s][user|one two][assistant|three][user|five][assistant|six seven]"
    assert [(r, b.formatted[x:y]) for r, _, _, x, y in b.spans] == [("user", "five"), ("assistant", "six seven")] and b.spans[0][1] is None
    (c,) = chat.located(chat.Template(closing), [("user", " hi <"), ("assistant", "<end>")])
    assert not c.rewritten and c.formatted == "user: hi <\nassistant: <end>\n<end>" and [c.formatted[x:y] for *_, x, y in c.spans] == ["hi <", "<end>"]
    (d,) = chat.located(chat.Template(twice), turns)
    assert all(s[3:] == (None, None) for s in d.spans) and d.spans[-1][2] == len(d.formatted)
    with pytest.raises(ValueError):
        chat.located(chat.Template(closing, turnwise=True), turns)

    df = spark.createDataFrame([(i, k, r, t) for i in range(30) for k, (r, t) in enumerate(turns)], "conv_id int, turn int, role string, text string")
    got = chat.format_conversations(df.repartition(4), chat.Template(short)).collect()
    assert Counter((r["formatted"], r["sample"], r["rewritten"], r["whole"]) for r in got) == {(a.formatted, 0, True, True): 30, (b.formatted, 1, False, True): 30}
    masks = [tuple(r["formatted"][s["text_start"] : s["text_stop"]] for s in r["spans"] if s["loss"]) for r in got]
    assert Counter(masks) == {("three four",): 30, ("six seven",): 30}  # each text bears loss once, in the form in which it was newest
    assert chat.format_conversations(df.limit(0), chat.Template(short)).count() == 0 == chat.digests(chat.format_conversations(df.limit(0))).count()


# Whitening


def plain_whitening(kept, most=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    v = np.array([[int((z[:, i] * z[:, j]).sum()) / n**3 for j in range(x.shape[1])] for i in range(x.shape[1])])
    e, u = np.linalg.eigh(v)
    return n, (z * z).sum(axis=1), (z / n).astype(float) @ u[:, ::-1][:, :most], e[::-1][:most], np.trace(v)


def check_whitening(rows, kept, most=32):
    n, deviation, projected, e, trace = plain_whitening(kept, most)
    by, used = {}, sum(e > 1e-9 * e[0])
    for r in rows:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = {}
    for (i, v), d, p in zip(kept, deviation, projected, strict=True):
        for k in range(1, len(e) + 1):
            for r in by[i, int(d) if d < 2**63 else None][k]:
                assert r["n"] == n and r["explained"] == pytest.approx(max(e[k - 1], 0) / trace, rel=1e-4, abs=1e-12)
                if k > used:
                    assert r["whitened"] is None
                else:
                    w = p[k - 1] / math.sqrt(e[k - 1])
                    if d >= 2**63:  # these rows cannot be told apart by their deviation
                        continue
                    signs.setdefault(k, set()).add(round(r["whitened"] / w) if abs(w) > 1e-3 else 0)
                    assert abs(r["whitened"]) == pytest.approx(abs(w), abs=1e-7)
                    assert r["identity_error"] < 1e-9
    assert all(len(x - {0}) == 1 for x in signs.values())  # one sign for all rows
    assert len(rows) == len(kept) * len(e) and {r["n"] for r in rows} == {n}
    return signs


@pytest.mark.parametrize("size,shift,scale", [(6, 0.0, 1.0), (40, 1000.0, 3.0), (5, 3e9, 1e9)])
def test_whitening(spark, size, shift, scale):
    rng = np.random.default_rng(size)
    mix = rng.normal(size=(size, size))
    rows = [(int(i), [float(c) for c in (rng.normal(size=size) @ mix * scale + shift)], "a") for i in range(300)]
    rows += [(7, rows[7][1], "b"), (None, rows[8][1], "c"), (7, rows[7][1], "b")]
    bad = [(900, None, ""), (901, [None] * size, ""), (902, [math.nan] * size, ""), (903, [math.inf] * size, ""), (904, [1.0], ""), (905, [], ""), (906, [1e300] * size, "")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, n string").withColumns({"vector": F.lit(1), "component": F.lit("x")}).repartition(5)
    check_whitening(whitening.whiten_embeddings(df).collect(), [(i, v) for i, v, _ in rows])
    assert whitening.whiten_embeddings(df.limit(0)).count() == 0


def test_whitening_without_variance(spark):
    rows = [(k, [float(k), float(k % 3), float(k) * 2, 5.0]) for k in range(50)]
    got = whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id int, embedding array<float>")).collect()
    check_whitening(got, rows)
    assert {r["component"] for r in got if r["whitened"] is None} == {3, 4}
    one = whitening.whiten_embeddings(spark.createDataFrame(rows[:1], "vec_id int, embedding array<float>")).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(k, 0, None, 0.0, None) for k in range(1, 5)]
    assert whitening.whiten_embeddings(spark.createDataFrame([(1, [])], "vec_id int, embedding array<float>")).count() == 0


def test_sums_beyond_a_long_are_exact(spark):
    rows = [(k, [float(2**46 - k), -float(2**46) + 3 * k]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3)
    x = np.array([[int(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    vectors, size = whitening.usable(df)
    got = whitening.totals(vectors, size, (5, -5), whitening.squares)
    y = x - np.array([5, -5], object)
    assert got == [*(y * y).sum(axis=0), ((y[:, 0] + y[:, 1]) ** 2).sum()]
    assert {r["deviation"] for r in whitening.whiten_embeddings(df).collect()} <= {int(d) if d < 2**63 else None for d in plain_whitening(rows)[1]}


def test_covariance_by_polarisation():
    y = np.random.default_rng(3).integers(-9, 9, (200, 7))
    got = whitening.covariance(200, [int(s) for s in y.sum(axis=0)], [int(s) for s in whitening.squares(y)])
    assert got == pytest.approx(np.cov(y.T, bias=True), abs=1e-12)


# Infilling


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 1000):
        s = rng.integers(0, 8, n).astype(np.uint8)
        m, at = infilling.WaveletMatrix(s, 3), np.arange(n + 1)
        for c in range(8):
            assert (m.rank(c, at) == np.concatenate([[0], np.cumsum(s == c)])).all()
        times = np.arange(m.count((2, 5), np.array([n]))[0] + 1)
        ends = np.flatnonzero(np.isin(s, (2, 5))) + 1
        assert (m.find((2, 5), times, np.zeros(len(times), np.int64), np.full(len(times), n)) == np.concatenate([[0], ends])).all()


def plain_cut(i, text, seed=42, percent=50, spm_percent=80, unit=UNIT, marks=("<P>", "<S>", "<M>")):
    p, s, m = marks
    h = sha(f"{seed}:{'null' if i is None else i}")
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = unit.findall(text)
    n = len(units)
    x, y = sorted((a % (n + 1), b % (n + 1)))
    one, two, three = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(k in text for k in marks) or c % 100 >= percent:
        return n, "plain", None, None, text
    return (n, "spm", len(one), len(two), s + three + p + one + m + two) if d % 100 < spm_percent else (n, "psm", len(one), len(two), p + one + s + three + m + two)


def infilling_rows():
    rng = random.Random(4)
    pieces = ["a", "bc", "é", "日本", "🙂", " ", "  ", "\n", "\t", "\x0b", " ", "\x1c", "<", "P>", "<P", "."]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    rows += [(i, rng.choice(["has <P> in", "<S>", "x<M>", "", " ", " \n ", "word", " word", "word ", "<P<S<M"])) for i in range(400, 600)]
    return rows + [(600, "long text é\n" * 20_000), (601, "x" * 100_000), (602, " " * 100_000), (7, "same id"), (7, "same id"), (None, "no id here")] + [(k, "copy of a text that comes often") for k in range(700, 800)]


@pytest.mark.parametrize("limit", [8 << 20, 300])
def test_infilling(spark, limit):
    rows = infilling_rows()
    df = spark.createDataFrame([*rows, (650, None)], "doc_id bigint, text string").withColumns({"n": F.lit("a"), "form": F.lit(1), "h1": F.lit("x"), "i": F.lit(0), "t": F.lit(2)}).repartition(3)
    cut = infilling.fill_in_middle(df, limit=limit)
    got = cut.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    expected = Counter((i, *plain_cut(i, t or ""), t or "") for i, t in [*rows, (650, None)])
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == expected
    assert min(Counter(r["form"] for r in got).values()) > 20
    assert infilling.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit,plain", [("char", re.compile(r"[\s\S]")), ("line", re.compile(r"[^\n]*\n|[^\n]+"))])
def test_other_units_and_sentinels(spark, unit, plain):
    rows, marks = infilling_rows(), ("[[pre", "[[suf", "[[mid")
    cut = infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string"), seed=7, percent=100, spm_percent=50, unit=unit, sentinels=marks)
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in cut.collect())
    assert got == Counter((i, *plain_cut(i, t, 7, 100, 50, plain, marks)) for i, t in rows)
    assert cut.filter(infilling.restored(F.col("output"), F.col("form"), marks) == F.lit("")).count() == sum(t == "" for _, t in rows)


def test_sentinels_that_can_be_mistaken():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>S", "<M>"), ("a<", "<b", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            infilling.fill_in_middle(None, sentinels=marks)


def test_classes():
    texts = Texts(np.frombuffer("aé b\n c".encode(), np.uint8), np.array([0, 5, 8]))
    assert infilling.classes(texts).tolist() == [1, 0, 5, 1, 7, 3, 1, 7]
