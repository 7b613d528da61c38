"""Language identification against plain compression, with ties, narrow margins and many languages."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from varloom.llm import common, language


def sizes(text, dictionaries, level=6):
    out = []
    for content in dictionaries.values():
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made = zstandard.ZstdCompressor(level=level, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)
        out.append(len(made.compress(f" {text.lower()} ".encode())))
    return out


def test_sizes_decide(spark):
    rng = random.Random(4)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(120)] for k, letters in {"a": "abcdefgh", "b": "efghijkl", "c": "éèàstu", "d": "abcdefgh"}.items()}
    dictionaries = {k: " ".join(rng.choice(v) for _ in range(400)).encode() for k, v in vocabulary.items()}
    dictionaries["same as a"] = dictionaries["a"]
    texts = [" ".join(rng.choice(vocabulary[rng.choice("abcd")]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    texts += ["A", "é", "x" * 200_000, "ABC def " * 50_000, vocabulary["b"][0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " 1 2 \n"), (903, texts[5]), (None, texts[6])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "t": F.lit(2)}).repartition(3)
    got = language.identify_language(docs, dictionaries).join(docs.select("doc_id", "text"), "doc_id").collect()
    narrow = 0
    for r in got:
        if r["text"] is None or not any(map(str.isalpha, r["text"])):
            assert (r["lang_pred"], r["score"], r["margin"], r["rejected"]) == ("und", 0.0, 0.0, True)
            continue
        each = sizes(r["text"], dictionaries)
        best, second = sorted(each)[:2]
        margin = 1 - best / second
        assert r["lang_pred"] == list(dictionaries)[each.index(best)]  # ties go to the first
        assert r["margin"] == pytest.approx(margin) and r["score"] == pytest.approx(1 - (1 - margin) ** 8) and r["rejected"] == (margin < 0.02)
        narrow += r["rejected"]
    assert narrow > 5  # equal dictionaries leave no margin
    assert language.identify_language(docs, dictionaries).count() == len(rows)


def test_more_languages_than_are_held_at_once(spark, monkeypatch):
    rng = random.Random(8)
    dictionaries = {f"l{k}": " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(80)).encode() for k in range(11)}
    texts = [d.decode()[k : k + 150] for k, d in enumerate(dictionaries.values())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    whole = {tuple(r) for r in language.identify_language(docs, dictionaries).collect()}
    monkeypatch.setattr(language, "AT_ONCE", 3)
    assert {tuple(r) for r in language.identify_language(docs, dictionaries).collect()} == whole
    assert {r[1] for r in whole} == set(dictionaries)


def test_hundreds_of_languages_are_learned(spark):
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 650).alias("text"), F.concat(F.lit("x"), F.col("id") % 650).alias("lang"))
    learned = language.learn_dictionaries(docs)
    assert len(learned) == 650 and list(learned) == sorted(learned)  # equal numbers of rows: by name
    assert language.learn_dictionaries(docs.limit(0)) == {}
    assert language.identify_language(docs.limit(0), learned).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_written_tables_can_be_removed(spark):
    kept = common.written(spark.range(3))
    path = common._TABLES[-1]
    assert kept.count() == 3 and common.remove_tables(spark) >= 1 and common.remove_tables(spark) == 0
    import os

    assert not os.path.exists(path.removeprefix("file:"))
