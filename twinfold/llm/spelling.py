"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by two-dimensional range reporting.

Words that share a prefix lie in one interval of the sorted words, those that share a suffix in one interval of the words sorted
from their ends. Each word is a point at its two ranks, and for each edit position the near words are the points in the rectangle of the
prefix before it and the suffix behind it. A wavelet tree over the second ranks in the order of the first reports them.

No one tree holds all words. Words of one length that may differ at the positions a .. b - 1 share what is before a and what is behind b; they
are one group with a tree of its own. A group starts with half of the positions; one with over GROUP members is divided into two halves of its
positions, with longer keys, until it is small or has one position, where the members are as many as different code points in one place at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.wavelet import WaveletTree
from twinfold.plans.storage import Scratch, join_facts

#: Members of a group whose words may differ at several positions.
GROUP = 1 << 14

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_n: int = 2, slip: int = 31) -> DataFrame:
    """Rows (word, n): maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, that have min_chars code points and occur min_n times at least.

    Before that, with h the CRC-32 of "<id>:<run>", a run whose h is divisible by `slip` loses its code point h % length. A null text has no words; a null id
    is written as nothing. Rows with one id are rows of their own. An empty table gives no rows; a very long text is one row of one task. Other columns are ignored.
    """
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{min_chars},}})"), 1)
    found = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    cut = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), cut), F.substr("run", cut + 2, F.length("run")))
    words = found.select(F.when(F.col("h") % slip == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def _members(rows: DataFrame) -> DataFrame:
    """Rows (size, a, b, prefix, suffix, asks, word) as keys of words of `size` code points that may differ at positions a .. b - 1; one that asks is shorter by one."""
    own = F.col("size") - F.col("asks").cast("int")
    end = F.col("b") - F.col("asks").cast("int")
    return rows.withColumns({"prefix": F.substr("word", F.lit(1), F.col("a")), "suffix": F.substr("word", end + 1, own)})


def near_words(words: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """Rows (word, near), both ways, for all pairs of different words at one edit. A word is named once in `words`; null ones are left out, the empty one is near all of one code point. Words hold no U+0000."""
    names = words.where("word is not null").select("word", F.length("word").alias("own"))
    both = names.select("word", F.explode(F.array(F.struct(F.col("own").alias("size"), F.lit(False).alias("asks")), F.struct((F.col("own") + 1).alias("size"), F.lit(True).alias("asks")))).alias("r"))
    half = F.floor(F.col("r.size") / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("r.size").alias("b")))
    rows = both.select("word", "r.size", "r.asks", F.explode(spans).alias("s")).select("size", "s.a", "s.b", "asks", "word").where("a < b")
    place = ["size", "a", "b", "prefix", "suffix"]
    links = None
    while True:
        rows = scratch.save(_members(rows), "members")
        # a group needs a word that is asked for, and another
        sizes = rows.groupBy(*place).agg(F.count("*").alias("members"), F.count_if(~F.col("asks")).alias("told")).where("told > 0 and members > 1").select(*place, "members")
        rows = scratch.save(join_facts(rows, sizes, place), "groups")
        large = (F.col("members") > group) & (F.col("b") > F.col("a") + 1)
        found = _reported(rows.where(~large), place)
        links = found if links is None else links.unionByName(found)
        if rows.where(large).isEmpty():
            break
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
        rows = rows.where(large).select("size", "asks", "word", F.explode(halves).alias("s")).select("size", "s.a", "s.b", "asks", "word")
    links = scratch.save(links, "near")  # each pair of words once: replaced, or the shorter one first
    return links.unionByName(links.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _reported(rows: DataFrame, place: list[str]) -> DataFrame:
    dealt = rows.select(*place, "asks", "word").repartition(*place).sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie one after another. Those at the same positions share a tree, up to GROUP members; no more than these and one group are held."""
        now, last, number, told, asking = None, None, 0, ([], []), ([], [])
        for batch in batches:
            for size, a, b, prefix, suffix, asks, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = size, a, b, prefix, suffix
                if key != last:
                    if key[:3] != now or len(told[0]) + len(asking[0]) >= GROUP:
                        if now:
                            yield from found(now, told, asking)
                        now, number, told, asking = key[:3], 0, ([], []), ([], [])
                    last, number = key, number + 1
                side = asking if asks else told
                side[0].append(word)
                side[1].append(number)
        if now:
            yield from found(now, told, asking)

    def found(now, told, asking) -> Iterator[pa.RecordBatch]:
        pairs = edits(*told, *asking, *now[1:])
        while part := list(islice(pairs, 10000)):
            one, two = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.string()), pa.array(two, pa.string())], names=["word", "near"])

    return dealt.mapInArrow(run, "word string, near string")


def edits(told: list[str], told_group: list[int], asking: list[str], asking_group: list[int], a: int, b: int) -> Iterator[tuple[str, str]]:
    """Pairs at one edit among words of one group, which share what is before position a and from b on: replaced ones of `told`, each once, and (shorter, longer) of asking and told.

    A group's number stands before its words in both orders, as one code point, so one tree serves many groups. An inserted code point that
    repeats the one before it counts at the first place of its run only, so no pair comes twice.
    """
    if not told:
        return
    width, mark = b - a, lambda g: chr(0x10000 + g)
    middles = [mark(g) + w[a:b] for w, g in zip(told, told_group, strict=True)]
    turned = [m[0] + m[:0:-1] for m in middles]
    forward, backward = (sorted(range(len(told)), key=x.__getitem__) for x in (middles, turned))
    rank = np.empty(len(told), np.int64)  # place among those sorted from their ends
    rank[backward] = np.arange(len(told))
    tree = WaveletTree(rank[forward])
    ahead, behind = np.array(middles, f"U{width + 1}")[forward], np.array(turned, f"U{width + 1}")[backward]

    def interval(table: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a sorted table that start as each of the others does, with its group and `size` code points."""
        short, part = table.astype(f"U{size + 1}"), words.astype(f"U{size + 1}")
        return np.searchsorted(short, part, "left"), np.searchsorted(short, part, "right")

    asked = [mark(g) + w[a : b - 1] for w, g in zip(asking, asking_group, strict=True)]
    for replaced, queries in ((True, middles), (False, asked)):
        if not queries:
            continue
        plain, back = np.array(queries, f"U{width + 1}"), np.array([q[0] + q[:0:-1] for q in queries], f"U{width + 1}")
        for k in range(width):  # the position in the longer word
            low, high = interval(ahead, plain, k)
            least, end = interval(behind, back, width - 1 - k)
            open_ = np.flatnonzero((high - low > replaced) & (end - least > replaced))  # a replaced word finds itself
            query, value = tree.report(low[open_], high[open_], least[open_], end[open_])
            for q, v in zip(open_[query].tolist(), value.tolist(), strict=True):
                other = backward[v]
                if replaced:
                    if q < other:
                        yield told[q], told[other]
                elif not a + k or told[other][a + k] != told[other][a + k - 1]:
                    yield asking[q], told[other]


def grouped(words: DataFrame, scratch: Scratch, factor: int = 10, group: int = GROUP) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of rows (word, n), each word once.

    form: of the words at one edit the most frequent one (of equals the smallest in code-point order), if it is at least `factor` times as frequent. root: what forms
    lead to in the end, or the word itself. An empty table gives no rows; words without near ones have n_near 0. Other columns are ignored.
    """
    words = scratch.save(words.where("word is not null").select("word", F.col("n").cast("bigint").alias("n")), "words")
    links = near_words(words, scratch, group)
    told = links.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = told.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("m"))
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("m.less") >= factor * F.col("n"), F.col("m.near")).alias("form"), (-F.col("m.less")).alias("form_n"))
    out = scratch.save(out.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n"))), "forms")
    # each round doubles the steps that are known; a step multiplies n, so there are few
    leads = scratch.save(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = leads.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = scratch.save(join_facts(leads, onward, ["root"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        scratch.drop(leads)
        leads = new
        if new.where("moved").isEmpty():
            break
    return out.join(leads.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
