"""Line-first cleaning: judge each line, remove those that fail, reject texts that lose too much."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.blocks import SPACE, Texts, blocks, words
from varloom.llm.common import documents

#: Classes of marks that may end a sentence or a quotation of one, and marks of those classes that do not.
CLOSING, OPEN = frozenset({"Po", "Pe", "Pf", "Pi"}), frozenset(",/&@#*%\\·•،、")
#: Marks that separate links in menus and bread crumbs.
SEPARATORS = re.compile(r"[|»›•·>]")
#: Marks that prose hardly uses.
NOISE = re.compile(r"[#*$%&<>~^=_\\{}]")
#: Words that are addresses, tags or mail addresses rather than prose.
LINK = re.compile(r"(?<!\S)(?:https?://|www\.|[#@]\w|[\w.+-]+@[\w-]+\.\w)\S*", re.IGNORECASE)
#: Frequent function words of English, French, German and Spanish; menus have none.
FUNCTION_WORDS = frozenset(
    "a an and are as at by for from in is it of on or that the this to was with"
    " au aux ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une"
    " auf das dem den der die ein eine für ist mit nicht sich und von zu"
    " al con del el es las los no para por su una y".split()
)
#: Phrases of legal notices and cookie banners in those languages.
NOTICES = (
    r"all rights reserved", r"copyright (?:\(c\)|©|\d{4})", r"©", r"licensed under", r"released under the", r"terms of (?:use|service)", r"privacy policy",
    r"cookie policy", r"uses? cookies", r"accept cookies", r"enable javascript", r"javascript is (?:disabled|required)", r"lorem ipsum",
    r"tous droits réservés", r"mentions légales", r"politique de confidentialité", r"accepter les cookies", r"conditions d'utilisation",
    r"alle rechte vorbehalten", r"impressum", r"datenschutzerklärung", r"cookies akzeptieren", r"nutzungsbedingungen",
    r"todos los derechos reservados", r"aviso legal", r"política de (?:privacidad|cookies)", r"aceptar (?:las )?cookies", r"condiciones de uso",
)
#: Phrases of page furniture, which prose has too, so that they count only at the start of a line of half as many words.
FURNITURE = (
    r"sign up for", r"subscribe to our", r"log ?in to", r"click here", r"read more", r"share (?:this|on)", r"follow us", r"skip to (?:main )?content", r"back to top", r"powered by",
    r"en savoir plus", r"cliquez ici", r"weiterlesen", r"hier klicken", r"leer más", r"haga clic aquí",
)
NOTICE, START = re.compile("|".join(NOTICES), re.IGNORECASE), re.compile(rf"\W*(?:{'|'.join(FURNITURE)})\b", re.IGNORECASE)
#: Whatever may be a separator, noise or part of an address.
UNUSUAL = re.compile(r"[|»›•·>#*$%&<~^=_\\{}@/]|www\.", re.IGNORECASE)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = (
    "doc_id {id}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "n_lines bigint, failed_punctuation bigint, failed_navigation bigint, failed_boilerplate bigint, lost_share double, kept boolean, cleaned string"
)


def closed(line: str) -> bool:
    """Whether a line ends in a closing mark of any script, or in Thai or Lao, which have none."""
    last = line.rstrip()[-1:]
    return "\u0e00" <= last <= "\u0eff" or (unicodedata.category(last) in CLOSING and last not in OPEN)


def line_failure(line: str, n_words: int, separators: int = 3, brief: int = 14) -> str | None:
    """The rule that a line with words fails: boilerplate, navigation or punctuation; else None."""
    if n_words <= brief and (NOTICE.search(line) or (2 * n_words <= brief and START.match(line))):
        return "boilerplate"
    if UNUSUAL.search(line):
        marks = len(SEPARATORS.findall(line))
        if marks >= separators and marks * 4 >= n_words:
            return "navigation"
        if len(LINK.findall(line)) * 3 >= n_words:
            return "navigation"
        if len(NOISE.findall(line)) * 10 > len(line):
            return "punctuation"
    if not closed(line):
        words = line.split()
        capital = sum(w[0].isupper() for w in words)
        menu = len(words) >= 4 and capital * 5 >= len(words) * 4 and FUNCTION_WORDS.isdisjoint(map(str.lower, words))
        return "navigation" if menu else "punctuation"
    return None


def repeated_words(codes: np.ndarray, start: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For each text the words that lie in a window of ``width`` words found twice or more in it.

    Windows are compared by a 64-bit key first; those whose key repeats are compared word by word.
    """
    n = len(start) - 1
    if len(codes) < width:
        return np.zeros(n, np.int64)
    factors = np.random.default_rng(7).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    c = codes.astype(np.uint64) + np.uint64(1)
    size = len(codes) - width + 1
    key = owner[:size].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(width):
        key += c[j : j + size] * factors[j]
    key ^= key >> np.uint64(31)
    inside = np.flatnonzero(owner[:size] == owner[width - 1 :])
    key = key[inside]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    inside = inside[np.isin(key, twice)]
    rows = np.stack([owner[inside], *(codes[inside + j] for j in range(width))], axis=1)
    _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    inside = inside[times[which.ravel()] > 1]
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, inside, 1)
    np.add.at(depth, inside + width, -1)
    return np.diff(np.searchsorted(np.flatnonzero(np.cumsum(depth[:-1]) > 0), start))


def line_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    separators: int = 3,
    max_lost: float = 0.5,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    window: int = 8,
    carry: tuple[str, ...] = (),
    brief: int = 14,
    limit: int = 16 << 20,
) -> DataFrame:
    """One row per row of ``docs``: counts, the verdict, and the text without the lines that failed.

    A line (split at ``\\n``) with at least one word fails as boilerplate if it has ``brief`` words at the most and holds one of
    ``NOTICES``, or half as many at the most and begins with one of ``FURNITURE``, so that paragraphs that mention them stay; as
    navigation if it has ``separators`` or more separator marks, one for every four words at least, if a third of its
    words are addresses, or if it is a menu (four or more words, four fifths of them capitalised, no function word, no
    closing mark); and for its punctuation if a tenth of it or more are noise marks, or if it has no closing mark (see ``closed``).
    Failing lines are removed.  ``base_failed``:
    fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of the words lie in
    repeated windows of ``window`` words.  ``kept`` is false if ``base_failed`` or if the removed
    lines held more than ``max_lost`` of the words.

    Null text: no words, base_failed, cleaned is null.  Empty text: the same with cleaned ''.  Null
    ids and repeated rows are judged like any other.  Only the id, the text and the columns named in
    ``carry`` are read; those are returned as the struct ``carried``, so their names do no harm.  An empty table gives an empty result.  Needs no shuffle; a task
    holds one block of texts (``limit`` bytes, or one longer text).
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "t", limit):
            texts = Texts.of(table.column("t"))
            tokens = words(texts, lower=False)
            n = tokens.counts
            repeat = repeated_words(tokens.code, tokens.start, tokens.owner, window)
            base = (n < min_words) | (100 * repeat > max_repeat_percent * n)
            chars = texts.count(~SPACE[texts.data] & ((texts.data & 0xC0) != 0x80))
            out: dict[str, list] = {k: [] for k in ("dup", "lines", "punctuation", "navigation", "boilerplate", "lost", "cleaned")}
            for i, text in enumerate(table.column("t").to_pylist()):
                seen, good, failed, dup, lines, lost = set(), [], {"punctuation": 0, "navigation": 0, "boilerplate": 0}, 0, 0, 0
                for line in (text or "").split("\n"):
                    if not (size := len(line.encode().split())):
                        good.append(line)
                        continue
                    lines += 1
                    dup += line in seen
                    seen.add(line)
                    if rule := line_failure(line, size, separators, brief):
                        failed[rule] += 1
                        lost += size
                    else:
                        good.append(line)
                out["dup"].append(dup)
                out["lines"].append(lines)
                out["lost"].append(lost / n[i] if n[i] else 0.0)
                out["cleaned"].append(None if text is None else "\n".join(good))
                for rule, times in failed.items():
                    out[rule].append(times)
            lost = np.array(out["lost"])
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("i").combine_chunks(), pa.array(n.astype(np.int64)), pa.array(chars.astype(np.int64)),
                    pa.array(texts.count(SYMBOLS[texts.data]).astype(np.int64)), pa.array(out["dup"], pa.int64()), pa.array(repeat.astype(np.int64)),
                    pa.array(base), *(pa.array(out[k], pa.int64()) for k in ("lines", "punctuation", "navigation", "boilerplate")),
                    pa.array(lost, pa.float64()), pa.array(~base & (lost <= max_lost)), pa.array(out["cleaned"], pa.string()),
                    *([table.column("carried").combine_chunks()] if carry else []),
                ],
                names=[*(x.split()[0] for x in SCHEMA.split(", ")), *(["carried"] if carry else [])],
            )

    kept = [F.struct(*(docs[c] for c in carry)).alias("carried")] if carry else []
    read = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"), *kept)
    types = dict(read.dtypes)
    return read.mapInArrow(judge, SCHEMA.format(id=types["i"]) + (f", carried {types['carried']}" if carry else ""))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(documents(spark, sf_dir)).drop("cleaned")
