"""Operator 13: spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, whatever their order. Two words that differ by one letter have keys that
differ by that letter's power (addition or removal), or by the difference of two (exchange). So a word is looked for under its own
key and under its key less each of its letters: an addition meets as own key and lessened key, an exchange as two lessened keys,
and no value of the alphabet has to be tried. An edit leaves the first or the last ``SIDE`` letters of both words alone, so these are
part of what words meet by; the order of the letters between is verified then. The work is linear in the words but for words that
share all this.

Words are counted within tasks, then by word. Forms lead to words at least ten times as frequent, so chains are short:
they are followed by doubling, in joins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, release, scratch, table

#: Code points that words have at least, occurrences, and how much more frequent a form is.
LEAST, SEEN, FACTOR = 7, 2, 10
#: One of so many runs loses a letter.
SPOILT = 31
#: Letters on either side that words meet by; 2 * SIDE < LEAST.
SIDE = 3
#: Distinct words that a task gathers before it hands them on.
FLUSH = 200_000

_LONG = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)
_MASK = (1 << 64) - 1
_POWER = {chr(c): c**5 for c in (*range(97, 123), *range(0xC0, 0x100))}


def runs(doc_id: int | None, text: str) -> Counter:
    """The words of a text and how often they occur; those under LEAST letters are left out."""
    out: Counter = Counter()
    name = "" if doc_id is None else str(doc_id)
    for run, n in Counter(_LONG.findall(text.encode().lower().decode())).items():  # bytes.lower() is for A-Z alone
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % SPOILT == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < LEAST:
                continue
        out[run] += n
    return out


def _counted(batches):
    found: Counter = Counter()

    def flush():
        return table(word=pa.array(found.keys(), pa.string()), n=pa.array(found.values(), pa.int64()))

    for rb in batches:
        for doc_id, text in zip(rb.column("doc_id").to_pylist(), rb.column("text").to_pylist(), strict=True):
            for w, n in runs(doc_id, text).items():
                found[w] += n
            if len(found) >= FLUSH:
                yield flush()
                found.clear()
    if found:
        yield flush()


def meetings(word: str) -> list[tuple[int, bool]]:
    """Keys that a word is looked for under: its own, and (less) its key without each of its letters."""
    powers = {c: _POWER[c] for c in word}
    own = sum(powers[c] * n for c, n in Counter(word).items())
    return [(own & _MASK, False), *(((own - p) & _MASK, True) for p in powers.values())]


def _keyed(batches):
    """meet, end, less, word, n: a word under each key, by its first and by its last letters."""
    for rb in batches:
        meet, end, less, at = [], [], [], []
        for i, w in enumerate(rb.column("word").to_pylist()):
            for k, without in meetings(w):
                for last in (False, True):
                    meet.append(k)
                    end.append(w[-SIDE:] + "$" if last else w[:SIDE])
                    less.append(without)
                    at.append(i)
        rows = rb.take(pa.array(at, pa.int32()))
        yield table(meet=np.array(meet, np.uint64).view(np.int64), end=pa.array(end, pa.string()), less=pa.array(less, pa.bool_()), word=rows.column("word"), n=rows.column("n"))


def words(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = d.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= SEEN)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: words of vocabulary (word, n; each once) that differ by one inserted, deleted or replaced letter, a < b."""
    keyed = vocabulary.mapInArrow(_keyed, "meet long, end string, less boolean, word string, n long")
    a, b = (keyed.select("meet", "end", *[F.col(c).alias(f"{x}_{c}") for c in ("less", "word", "n")]) for x in "ab")
    pairs = a.join(b, ["meet", "end"]).where("a_word < b_word and (a_less or b_less)")
    # a pair that meets by its first letters is not counted by its last ones again
    again = F.col("end").endswith("$") & (F.substring("a_word", 1, SIDE) == F.substring("b_word", 1, SIDE))
    longer = F.length("a_word") - F.length("b_word")
    # additions meet as own key and lessened key, exchanges as two lessened keys
    alike = F.when(longer == 0, F.col("a_less") & F.col("b_less")).when(longer == 1, F.col("a_less") & ~F.col("b_less")).when(longer == -1, ~F.col("a_less") & F.col("b_less")).otherwise(F.lit(False))
    pairs = pairs.where(~again & alike & (F.levenshtein("a_word", "b_word", 1) == 1))
    return pairs.select(F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n"))


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text); other columns are ignored.

    Words come from maximal runs [A-Za-z\\u00C0-\\u00FF]+ with A-Z lower-cased; where 31 divides h, the unsigned crc32 of
    "<doc_id>:<run>" (a null doc_id: nothing before the colon), the run's letter number h modulo its length is left out. A word has 7 letters
    and 2 occurrences (n) at least. n_near: words one inserted, deleted or replaced letter away; form: the most frequent of
    them (of equal ones the first in code-point order) if it is at least 10 times as frequent, else null, and form_n its n; root: the last
    word of the chain of forms, the word itself if it has none. Null texts have no words; repeated rows count as often as they
    come; an empty table gives an empty result. A text is worked on whole in one task, at some 10 bytes of memory for each of its bytes.
    """
    spark = docs.sparkSession
    vocabulary = scratch(words(docs), "words")
    pairs = scratch(near_pairs(vocabulary), "near")
    release(spark)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = vocabulary.join(near, "word", "left")
    good = -F.col("best.m") >= FACTOR * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))
    near = scratch(near, "forms")
    jump = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps; a form is ten times as frequent, so there are at most five
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = scratch(jump.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "chains")
        more = longer.where("more").limit(1).count()
        discard(jump)
        jump = longer.select("word", "root")
        jump.scratch_path = longer.scratch_path
        if not more:
            break
    out = near.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    discard(vocabulary, pairs)
    return out
