"""The operators on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import exact, language, language_model, mixing, near, packing, quality, token_counts
from varloom.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    base = ["\n".join(sentence(rng.randrange(8, 30)) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    out = [None, None, "", "", " \n\t", "one", "one two", "ONE two", "one  two", "a b c", "a b c", "x" * 20000, "the " * 5000, "\n".join(["same line here today now ok."] * 40), "Home | About | Help | More\nReal text stays here with enough words."]
    out += base
    for b in base[:12]:  # exact copies, and near copies of several degrees
        out += [b, b.upper()]
        for k in (1, 3, 8, 20):
            w = b.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    sources = ["s1", "s2", None, "é", "s10"]
    return [(i, x, ["en", "fr", None][i % 3], sources[0] if i % 3 == 0 else sources[i % 5]) for i, x in enumerate(t)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns that share names with those of the results.
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({"kept": F.lit("x"), "size": F.lit(1), "n_words": F.lit("y"), "band": F.lit(2), "key": F.lit("k"), "i": F.lit(5), "t": F.lit("z")}).repartition(3)


def empty(docs):
    return docs.limit(0)


OPERATORS = {
    "quality": lambda d: quality.line_quality(d),
    "exact": lambda d: exact.exact_groups(d),
    "near": lambda d: near.near_duplicates(d),
    "mixing": lambda d: mixing.mix_sources(d),
    "counts": lambda d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "packing": lambda d: packing.pieces(packing.vector_packed(d)).filter("start = 0"),
    "matrices": lambda d: packing.packed(d, public_tokenizers.path("byte_bpe_50k.json"), 50256, packing.best_fit_decreasing(512)).select(F.explode("pieces").alias("p")).filter("p.start = 0"),
    "language": lambda d: language.identify_language(d, language.learn_dictionaries(d)),
    "model": lambda d: language_model.score_texts(d, F.col("doc_id") % 5 != 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(name, docs):
    assert OPERATORS[name](empty(docs)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_with_null_ids_and_repeated_rows(name, spark, docs, rows):
    again = docs.select("doc_id", "text", "lang", "source").filter("doc_id % 4 = 0")
    odd = docs.select("doc_id", "text", "lang", "source").unionByName(again).unionByName(again.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    assert OPERATORS[name](odd).count() == odd.count()


def test_quality(docs, rows):
    got = {r["doc_id"]: r for r in quality.line_quality(docs).collect()}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = {w for w, n in collections.Counter(windows).items() if n > 1}
        repeated = len({k + j for k, w in enumerate(windows) if w in twice for j in range(8)})
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), repeated)
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["base_failed"] == (len(words) < 20 or 100 * repeated > 30 * len(words))
    by_text = {t: got[i] for i, t, *_ in rows}
    nav = by_text["Home | About | Help | More\nReal text stays here with enough words."]
    assert nav["failed_navigation"] == 1 and nav["cleaned"] == "Real text stays here with enough words."
    clean = [got[i] for i, t, *_ in rows if t and 15 <= i < 75]
    assert all(r["cleaned"] == t for r, (_, t, *_) in zip(clean, rows[15:75]))
    assert all(r["kept"] or r["base_failed"] for r in clean)


def test_line_rules():
    fails = lambda line: quality.line_failure(line, len(line.encode().split()))
    for line in ("All Rights Reserved.", "Tous droits réservés.", "Alle Rechte vorbehalten 2020.", "Todos los derechos reservados."):
        assert fails(line) == "boilerplate"
    for line in ("Home | News | Contact | Login", "Startseite Aktuelles Kontakt Anmelden", "see www.a.example and https://b.example/x", "#one #two a@b.example."):
        assert fails(line) == "navigation"
    for line in ("read next", "a### b$$$ c%%% d*** e### f$$$.", "This line is a sentence without an end", "The Old Man and the Sea"):
        assert fails(line) == "punctuation"
    for line in ("This line is a plain sentence.", "Short.", "He said: “yes”", "Ist das wahr?", "Home News Contact Login.", "Cost is 5 / 6 of that.", "日本語の文。"):
        assert fails(line) is None


def test_prose_that_mentions_phrases_stays():
    fails = lambda line: quality.line_failure(line, len(line.encode().split()))
    for line in ("I read more books that year than in any other, and the library had to order them from far away.", "Many visitors log in to the guest book before they leave.", "They follow us.",
                 "The museum states in its terms of use that visitors may copy the pictures, as long as they name the painter and all rights reserved elsewhere."):
        assert fails(line) is None
    for line in ("Read more about this topic here.", "» Click here to subscribe!", "This site uses cookies.", "Log in to continue.", "© 2021 A and B."):
        assert fails(line) == "boilerplate"


def test_closing_marks_of_other_scripts(spark):
    lines = {"ar": "هل هذا سؤال طويل يكتب هنا؟", "hi": "यह एक पूरा वाक्य है और यहाँ समाप्त होता है।", "th": "นี่คือประโยคภาษาไทย ที่ไม่มีเครื่องหมายปิดท้าย", "hy": "Սա ամբողջական նախադասություն է։", "am": "ይህ ሙሉ ዓረፍተ ነገር ነው።", "de": "Er sagte: „Nein“", "ur": "یہ ایک مکمل جملہ ہے۔", "ja": "これは文です。"}
    for line in lines.values():
        assert quality.line_failure(line, len(line.encode().split())) is None
    for line in ("ends with a comma,", "and / or /", "well &", "no end at all"):
        assert quality.line_failure(line, 4) == "punctuation"
    words = [" ".join(f"كلمة{i}ب{k}" for i in range(10)) + "؟" for k in range(3)]
    got = quality.line_quality(spark.createDataFrame([(1, "\n".join(words))], "doc_id int, text string")).first()
    assert got["kept"] and got["lost_share"] == 0.0


def test_blocks_shorter_than_texts(docs):
    """Texts longer than a block are blocks of their own; results do not change."""
    for small, usual in (
        (quality.line_quality(docs, limit=500), quality.line_quality(docs)),
        (token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), block=500), OPERATORS["counts"](docs)),
    ):
        assert sorted(map(str, small.collect())) == sorted(map(str, usual.collect()))


def test_texts_that_lose_too_much_go(spark):
    good = "This is a line of plain prose that has quite enough words to count. Another sentence follows here, which says something else."
    rows = [(1, good + "\n" + "Home | About | Help | More"), (2, good.split(". ")[0] + ".\n" + "no closing mark here but many other words that go on and on without any end at all, as titles and lists may"), (3, good + "\n" + "x\n" * 3), (4, "word " * 300_000 + "end."), (5, "\n".join(f"Line {i} has its own number {i * i} and ends." for i in range(40_000)))]
    got = {r["doc_id"]: r for r in quality.line_quality(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == good and got[1]["failed_navigation"] == 1
    assert not got[2]["kept"] and not got[2]["base_failed"] and got[2]["lost_share"] > 0.5 and got[2]["cleaned"] == good.split(". ")[0] + "."
    assert got[3]["kept"] and got[3]["failed_punctuation"] == 3 and got[3]["n_dup_lines"] == 2
    assert got[4]["base_failed"] and got[4]["n_words"] == 300_001 and got[4]["n_repeat_words"] == 300_000
    assert got[5]["kept"] and got[5]["n_lines"] == 40_000 and got[5]["cleaned"] == rows[4][1]


def test_exact(docs, rows):
    groups = collections.defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    for r in exact.exact_groups(docs).collect():
        text = rows[r["doc_id"]][1] or ""
        own = groups[text]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij é.,\n🙂") for _ in range(50000))
    df = spark.createDataFrame([(0, long), (1, "xyz" + long), (2, ""), (3, "z" * 30000)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", exact.chunks(F.col("t")).alias("c")).collect()}
    assert "".join(got[0]) == long and "".join(got[1]) == "xyz" + long and got[2] == [] and "".join(got[3]) == "z" * 30000
    assert len(set(got[0]) & set(got[1])) > 0.8 * len(got[0])
    assert max(map(len, itertools.chain(*got.values()))) <= exact.MOST


def test_identifiers_are_verified(spark):
    parts = spark.createDataFrame([(["a", "b"],), (["c"],)], "chunks array<string>")
    assert not exact.told_apart(parts, lambda c: F.length(c).cast("string").cast("binary"))
    assert exact.told_apart(parts, exact.SCHEMES[0])


@pytest.mark.parametrize("percent,width,block", [(85, 3, 512), (80, 5, 512), (85, 3, 2)])
def test_near(docs, rows, percent, width, block):
    sets = {}
    for i, text, *_ in rows:
        w = WORDS.findall((text or "").encode().lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    got = near.near_duplicates(docs, percent=percent, width=width, block=block).collect()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"])), rows[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert sum(not r["kept"] for r in got) > 20


def test_texts_that_share_an_id_keep_their_own_links(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (5, c), (1, a), (None, a), (6, None), (6, "")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), percent=80, width=5).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (None, 1, False), (6, 6, True)}
    assert sum(r["stands"] for r in got if r["doc_id"] == 1) == 3 and not any(r["stands"] for r in got if r["doc_id"] in (2, 3, 5))
    # a third of all rows has one id
    many = [(0, " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(30))) for _ in range(150)]
    copies = [(k + 1, t + " more") for k, (_, t) in enumerate(many)]
    got = near.near_duplicates(spark.createDataFrame(many + copies, "doc_id int, text string"), percent=80, width=5).collect()
    assert all(r["component_id"] == 0 for r in got) and sum(r["stands"] for r in got) == 150


def test_sketch_estimates_similarity():
    rng, sketch = np.random.default_rng(0), near.Sketch()
    for share, expected in ((0.95, True), (0.75, False)):
        hits = []
        for _ in range(40):
            common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (int(1000 * share), int(500 * (1 - share)), int(500 * (1 - share))))
            s = np.concatenate([common, a, common, b])
            k = sketch.of(s, np.array([0, len(common) + len(a), len(s)]))
            n = np.array([len(common) + len(a)]), np.array([len(common) + len(b)])
            hits.append(bool(sketch.at_least(0.85, *n, (k[:1] > k[1:]).sum(1), (k[:1] < k[1:]).sum(1))[0]))
        assert (np.mean(hits) > 0.9) == expected
    merged = np.concatenate([common, a, b])
    left, right, both = (sketch.of(x, np.array([0, len(x)])) for x in (np.concatenate([common, a]), np.concatenate([common, b]), merged))
    assert (np.maximum(left, right) == both).all()  # registers of a union


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 302), (302, 300)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and {got[300], got[301], got[302]} == {300}


def fill(sizes, weights):
    """Targets by passing excess on until none is above."""
    total, target = sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > 3 * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
        free -= over
    return target


def test_mixing(docs, rows):
    size = {i: len(WORDS.findall((t or "").encode())) for i, t, *_ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    per = [sum(size[i] for i, _, _, s in rows if s == n) for n in names]
    targets = dict(zip(names, fill(per, [1 + k % 3 for k in range(len(names))])))
    got = mixing.mix_sources(docs).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    taken = collections.Counter()
    for r in got:
        source = rows[r["doc_id"]][3]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[names.index(source)]
        assert r["target"] == pytest.approx(targets[source])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for n in names:
        assert abs(taken[n] - targets[n]) <= max((size[i] for i, _, _, s in rows if s == n), default=0)


def test_mixing_is_unbiased_and_near_target_over_many_groups(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 10 < 3, "a").otherwise("b").alias("source"))
    runs = [mixing.mix_sources(df, seed=s, weights=(1, 1)).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.sum(F.when(F.col("size") > 30, F.col("copies"))).alias("large"), F.sum((F.col("size") > 30).cast("int")).alias("n_large"), F.first("source_size").alias("s")).collect() for s in range(3)]
    for r in itertools.chain(*runs):
        assert abs(r["n"] - r["t"]) <= 37
        assert r["large"] / r["n_large"] == pytest.approx(r["t"] / r["s"], rel=0.12)


def test_mixing_of_rows_that_repeat_an_id(spark):
    """Half of all rows are one row; as many rows come back, and each source is near its target."""
    same = F.col("id") % 2 == 0
    df = spark.range(4000).select(F.when(same, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), F.when(same, 9).otherwise((F.col("id") % 37 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 10 < 3, "a").otherwise("b").alias("source"))
    out = mixing.mix_sources(df, weights=(1, 1)).withColumn("more", F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).withColumn("same", (F.col("doc_id") == 7) & (F.col("size") == 9))
    per = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("more").alias("most"), F.count_if("same").alias("same"), F.sum(F.when(F.col("same"), F.col("copies"))).alias("copies")).collect()
    assert len(per) == 2 and sum(r["n"] for r in per) == 4000 and sum(r["same"] for r in per) == 2000
    for r in per:
        assert r["size"] == r["source_size"] and abs(r["taken"] - r["target"]) <= 37 and r["most"] <= 1
        assert abs(r["copies"] - r["same"] * r["target"] / r["source_size"]) <= 1


def test_targets_with_caps(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 200), ("z", 0)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    names = ["a", "b", "c", "z", None]
    assert [got[n] for n in names] == pytest.approx(fill([1000, 10, 10, 0, 200], [1, 2, 3, 1, 2]))


def test_counts_and_pieces(docs, rows):
    from tokenizers import Tokenizer

    t, w = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        text = rows[r["doc_id"]][1] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
    parts = collections.defaultdict(list)
    used, segments, bearing = collections.Counter(), collections.Counter(), collections.Counter()
    for r in packing.pieces(packing.vector_packed(docs), with_ids=True).collect():
        parts[r["doc_id"]].append(r)
        used[r["sequence_id"]] += r["length"]
        segments[r["sequence_id"]] += 1
        bearing[r["sequence_id"]] += r["loss_tokens"]
    for i, text, *_ in rows:
        ids, at = np.array(w.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        head, more, _ = (text or "").partition("\n")
        prompt = len(w.encode(head, add_special_tokens=False).ids) if text and more and len(head) + 1 < len(text) else 0
        for r in sorted(parts[i], key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]].tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and bytes(r["ids"]) == piece
            assert r["ids_crc32"] == zlib.crc32(piece)
            assert r["loss_tokens"] == r["length"] - min(r["length"], max(0, max(1, prompt) - at))
            at += r["length"]
        assert at == len(ids)
    for most, limit in zip((used, segments, bearing), packing.LIMITS):
        assert max(most.values()) <= limit


def test_limits_of_the_query_bind(spark):
    """Long texts meet the limit of loss-bearing tokens, many short ones that of segments, and what is left is small."""
    rng = random.Random(9)
    word = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, word(9) + "\n" + word(rng.randrange(500, 6000))) for i in range(60)] + [(i, word(40) + "\n" + word(5)) for i in range(60, 400)] + [(i, "a b") for i in range(400, 500)] + [(i, word(200) + "\n" + word(rng.randrange(400, 1500))) for i in range(500, 600)]
    seqs = packing.vector_packed(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)).select("n_tokens", F.size("pieces").alias("k"), F.expr("aggregate(pieces, 0L, (a, x) -> a + x.loss_tokens)").alias("loss")).collect()
    tokens, segments, loss = packing.LIMITS
    assert all(r["n_tokens"] <= tokens and r["k"] <= segments and r["loss"] <= loss for r in seqs)
    assert sum(r["loss"] == loss for r in seqs) > 10 and sum(r["k"] == segments for r in seqs) > 10 and sum(r["n_tokens"] == tokens for r in seqs) > 10


def test_packed_ids_against_the_library(spark, rows):
    """The rows of the first query: ids, segments and positions of each sequence, rebuilt from the library's ids; texts longer than a block."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = spark.createDataFrame([*rows, (10**6, "long text. " * 9000, "en", "s1")], "doc_id bigint, text string, lang string, source string").coalesce(1)
    expected = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 50256] for r in docs.collect()}
    seqs = packing.packed(docs, path, 50256, packing.best_fit_decreasing(2048), positions=True, limit=20_000).collect()
    rebuilt = collections.defaultdict(dict)
    for r in seqs:
        ids, positions = np.frombuffer(r["ids"], "<u4").tolist(), np.frombuffer(r["positions"], "<u4").tolist()
        assert r["segments"] == [0, *itertools.accumulate(p["length"] for p in r["pieces"])] and len(ids) == r["n_tokens"] == r["segments"][-1] <= 2048
        assert positions == [k for p in r["pieces"] for k in range(p["length"])]
        for p, a, b in zip(r["pieces"], r["segments"], r["segments"][1:]):
            assert p["offset"] == a
            rebuilt[p["doc_id"]][p["start"]] = ids[a:b]
    assert {i: sum((x[k] for k in sorted(x)), []) for i, x in rebuilt.items()} == expected
    assert all(len(x) == -(-len(expected[i]) // 2048) for i, x in rebuilt.items())  # cut where it must be, and nowhere else
    assert len({r["sequence_id"] for r in seqs}) == len(seqs)


def test_matrices_and_prompts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    w = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, f"prompt number {i} asks", "answer " * (i * 7 % 90)) for i in range(60)] + [(99, None, None)], "doc_id bigint, ask string, text string")
    seqs = packing.packed(df, path, 1, packing.dot_product_packing(128, 8, 90, 16), prompt_col="ask", positions=True)
    packing.write_matrices(seqs, str(tmp_path / "m"), 128, 0)
    rebuilt = collections.defaultdict(dict)
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, positions = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4")
        assert len(ids) == 128 and (ids[r["n_tokens"] :] == 0).all() and r["segments"][0] == 0 and r["segments"][-1] == r["n_tokens"]
        assert positions.tolist() == [k for p in r["pieces"] for k in range(p["length"])]
        assert len(r["pieces"]) <= 8 and sum(p["loss_tokens"] for p in r["pieces"]) <= 90
        for p in r["pieces"]:
            rebuilt[p["doc_id"]][p["start"]] = ids[p["offset"] : p["offset"] + p["length"]].tolist()
    for i, ask, text in df.collect():
        expected = [x for t in (ask or "", text or "") for x in w.encode(t, add_special_tokens=False).ids] + [1]
        assert sum((rebuilt[i][k] for k in sorted(rebuilt[i])), []) == expected


def test_the_sample_of_languages_stays_small(spark):
    """However many rows a language has, or an id, some 131 passages are taken."""
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id", F.lit(" end")).alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("h"), F.lit(2).alias("n"))
    taken = language.learn_dictionaries(df)["en"].count(b" end")
    assert 80 < taken < 190 and language.learn_dictionaries(df) == language.learn_dictionaries(df.repartition(5).unionByName(df.limit(0)))


def test_language(spark):
    rng = random.Random(1)
    words = {"en": "the of and to in that is was for with".split(), "de": "der und die nicht ist ein von zu mit auf".split(), "fr": "le la les des est une pour que dans avec".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(list(words) * 60)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, "und", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language.learn_dictionaries(df.filter("doc_id % 4 <> 2"))
    assert set(learned) == set(words) and all(len(v) <= 65536 for v in learned.values())
    got = {r["doc_id"]: r for r in language.identify_language(df, learned).collect()}
    assert all(got[i]["lang_pred"] == k and 0 < got[i]["score"] <= 1 and not got[i]["rejected"] for i, t, k in rows if i < 1000)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert {r["lang_pred"] for r in language.identify_language(df, {}).collect()} == {"und"}
