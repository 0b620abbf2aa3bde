"""Benchmark decontamination: BM25 over an inverted index of test items, pruned by block maxima."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Memo, Scratch, append_columns, documents, materialize, table

WORD = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?](?=\s)|\n")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence or line, and those of it; all are the question if there is only one."""
    ends = [m.end() for m in END.finditer(text)]
    for cut in reversed(ends):
        question, answer = words(text[:cut]), words(text[cut:])
        if question and answer:
            return question, answer
    return words(text), []


@dataclass
class Class:
    """Items of similar length and their postings: term -> blocks -> (item, impact).

    Impacts are divided by the score of the item's own text, so that 1 is a whole
    match.  ``entry`` ranges over (term, block) pairs in term order; ``best`` is
    the largest impact of an entry, ``top`` that of a term.
    """

    stride: int
    terms: dict[str, int]
    top: np.ndarray
    term_at: np.ndarray
    block: np.ndarray
    best: np.ndarray
    entry_at: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    blocks: int


@dataclass
class Index:
    ids: list
    parts: list[tuple[list[str], list[str]]]
    classes: list[Class]


def build(items: DataFrame, id_col: str = "item_id", text_col: str = "text", max_items: int = 50_000, **options) -> Iterator[Index]:
    """Indexes over all test items, one after the other, each of at most about ``max_items``, which bounds what the driver holds and broadcasts.

    Document frequencies and the mean length are those of all items.  Items
    without words (null or empty) match nothing; repeated rows count once.
    """
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct()
    fields = [T.StructField("words", T.ArrayType(T.StringType()))]
    rows = append_columns(rows, "text", lambda: lambda texts: [[words(t) for t in texts]], fields)
    rows = materialize(rows.withColumn("key", F.xxhash64(F.col("id").cast("string"), "text")).where(F.size("words") > 0), "test-items")
    n, mean = rows.agg(F.count("*"), F.avg(F.size("words"))).first()
    frequency = rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    parts = -(-n // max_items)
    for k in range(parts):
        shard = rows.where(F.pmod("key", F.lit(parts)) == k)
        here = shard.select(F.explode("words").alias("term")).distinct()
        df = {r.term: r.df for r in frequency.join(here, "term", "left_semi").collect()}
        got = sorted((str(r.id), r.text, r.id) for r in shard.select("id", "text").collect())
        if got:
            yield index_of(got, df, n, mean, **options)


def index_of(got: list[tuple], df: dict[str, int], n: int, mean: float, k1: float = 1.2, b: float = 0.75, block: int = 8, least: int = 64) -> Index:
    """The index of (key, text, id) rows.  df, n, mean: document frequencies, number and mean length of all items."""
    by: dict[int, list] = {}
    for i, (_, text, _) in enumerate(got):
        bag = Counter(words(text))
        size = bag.total()
        w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean)) for t, f in bag.items()}
        own = sum(w.values())
        stride = max(least, 1 << (size - 1).bit_length())
        by.setdefault(stride, []).extend((t, i, x / own) for t, x in w.items())
    return Index([r[2] for r in got], [question_answer(r[1]) for r in got], [_class(k, v, block) for k, v in sorted(by.items())])


def _class(stride: int, postings: list, block: int) -> Class:
    postings.sort()
    terms: dict[str, int] = {}
    term = np.array([terms.setdefault(t, len(terms)) for t, _, _ in postings])
    item, impact = np.array([i for _, i, _ in postings]), np.array([w for _, _, w in postings])
    local = np.unique(item, return_inverse=True)[1] // block
    entry = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(local) != 0)])
    first = np.flatnonzero(np.r_[True, np.diff(term) != 0])
    best = np.maximum.reduceat(impact, entry)
    return Class(stride, terms, np.maximum.reduceat(impact, first), np.r_[np.searchsorted(entry, first), len(entry)], local[entry], best, np.r_[entry, len(item)], item, impact, int(local.max()) + 1)


def _spread(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the numbers at[key] .. at[key + 1] - 1, with the place of their key."""
    n = at[keys + 1] - at[keys]
    which = np.repeat(np.arange(len(keys)), n)
    return at[keys][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


class Terms(Memo):
    """Numbers of tokens without white space: a term, -1 for a word that no item has, -2 - k for the words many[k]."""

    def __init__(self, c: Class, limit: int = 400_000):
        get, self.many = c.terms.get, []

        def number(token: str) -> int:
            found = [get(w, -1) for w in words(token)]
            if len(found) == 1:
                return found[0]
            self.many.append(found)
            return -1 - len(self.many)

        super().__init__(number, limit)

    def clear(self):
        super().clear()
        self.many.clear()

    def of(self, text: str) -> np.ndarray:
        """A number for each word of the text."""
        tokens, out = text.split(), []
        half = self.limit // 2
        for at in range(0, len(tokens), half):
            if len(self) + half > self.limit:
                self.clear()
            ids = np.array(list(map(self.__getitem__, tokens[at : at + half])), np.int64)
            if ids.min() < -1:
                ids = np.fromiter(chain.from_iterable(self.many[-2 - k] if k < -1 else (k,) for k in ids.tolist()), np.int64)
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def search(c: Class, texts: list[str], least: float, terms: Terms, most: int = 1 << 20) -> list[tuple[int, int, int, float]]:
    """(document, chunk, item, score) of every passage whose normalised BM25 score reaches ``least``.

    A document is cut into chunks of ``stride`` words; a chunk and the next one are
    a passage, in which a term counts once a chunk.  Block-max WAND: a passage's
    terms are put in the order of their largest impacts, and the least ones, which
    cannot reach half of ``least`` together, open no block.  A block that the others
    open goes on if their block maxima and what the least ones could add reach
    ``least``; then the maxima of the least ones are looked up in that block alone,
    and postings are read where the whole bound still reaches ``least``.  Passages
    go in slices that open about ``most`` blocks, which bounds the memory.
    """
    tid = [terms.of(t) for t in texts]
    chunks = np.array([-(-len(d) // c.stride) for d in tid], np.int64)
    start = np.r_[0, np.cumsum(chunks)]
    total, kinds = int(start[-1]), len(c.terms)
    if not total:
        return []
    chunk = np.concatenate([start[i] + np.arange(len(x)) // c.stride for i, x in enumerate(tid)])
    term = np.concatenate(tid)
    key = np.unique(chunk[term >= 0] * kinds + term[term >= 0])
    chunk, term = key // kinds, key % kinds
    doc = np.repeat(np.arange(len(texts)), chunks)
    # Terms of each passage: those of its chunk, and those of the next chunk of the same document.
    back = np.flatnonzero((chunk > 0) & (doc[np.maximum(chunk, 1) - 1] == doc[chunk]))
    passage, term = np.r_[chunk, chunk[back] - 1], np.r_[term, term[back]]
    live = np.bincount(passage, weights=c.top[term], minlength=total)[passage] >= least
    passage, term = passage[live], term[live]
    order = np.lexsort((c.top[term], passage))
    passage, term = passage[order], term[order]
    if not len(term):
        return []
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    sums = np.cumsum(c.top[term])
    within = sums - np.repeat(np.r_[0.0, sums[first[1:] - 1]], np.diff(np.r_[first, len(term)]))
    opens = within >= least / 2
    work = np.add.reduceat(np.where(opens, c.term_at[term + 1] - c.term_at[term], 0), first) + c.blocks // 4
    ends = np.r_[first[1:], len(term)]
    out, at = [], 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(work[at:]), most, "right")) + at)
        rows = slice(first[at], ends[stop - 1])
        out += _scored(c, passage[rows], term[rows], opens[rows], least, most)
        at = stop
    return [(int(doc[p]), int(p - start[doc[p]]), i, v) for p, i, v in out]


def _scored(c: Class, passage: np.ndarray, term: np.ndarray, opens: np.ndarray, least: float, most: int) -> list[tuple[int, int, float]]:
    """(passage, item, score) that reach ``least``, in the blocks that the opening terms have."""
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    ends = np.r_[first[1:], len(passage)]
    number = np.repeat(np.arange(len(first)), ends - first)
    entry, which = _spread(c.term_at, term[opens])
    bound = np.bincount(number[opens][which] * c.blocks + c.block[entry], weights=c.best[entry], minlength=len(first) * c.blocks).reshape(len(first), -1)
    rest = np.bincount(number[~opens], weights=c.top[term[~opens]], minlength=len(first))
    own, block = np.nonzero((bound > 0) & (bound + rest[:, None] >= least - 1e-9))
    cells = passage[first[own]] * c.blocks + block
    n = (ends - first)[own]
    # Where (term, block) stands among the entries, whose keys ascend.
    keys = np.repeat(np.arange(len(c.term_at) - 1), np.diff(c.term_at)) * c.blocks + c.block
    out, at = [], 0
    while at < len(cells):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 4 * most, "right")) + at)
        part = slice(at, stop)
        cell = np.repeat(np.arange(stop - at), n[part])
        row = np.repeat(first[own[part]], n[part]) + np.arange(len(cell)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        want = term[row] * c.blocks + (cells[part] % c.blocks)[cell]
        e = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        there = keys[e] == want
        e, cell = e[there], cell[there]
        keep = np.bincount(cell, weights=c.best[e], minlength=stop - at)[cell] >= least - 1e-9
        e, cell = e[keep], cell[keep]
        at = stop
        if len(e):
            post, which = _spread(c.entry_at, e)
            items = int(c.item.max()) + 1
            key, place = np.unique((cells[part] // c.blocks)[cell[which]] * items + c.item[post], return_inverse=True)
            value = np.bincount(place, weights=c.impact[post])
            hit = np.flatnonzero(value >= least)
            out += zip((key[hit] // items).tolist(), (key[hit] % items).tolist(), value[hit].tolist(), strict=True)
    return out


def overlap(part: list[str], passage: list[str], n: int = 3) -> float:
    """The share of the part's word n-grams (shorter ones for a shorter part) that the passage has."""
    n = min(n, len(part))
    if not n:
        return 1.0
    have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    grams = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(g in have for g in grams) / len(grams)


def leaks_of(index: Index, texts: list[str], least: float, verify: float, memos: list[Terms]) -> list[list[tuple]]:
    found: list[dict] = [{} for _ in texts]
    read: dict[int, list[str]] = {}
    for c, memo in zip(index.classes, memos, strict=True):
        for d, k, i, score in search(c, texts, least, memo):
            if d not in read:
                read[d] = words(texts[d])
            question, answer = index.parts[i]
            extra = len(question) + len(answer)
            passage = read[d][max(0, k * c.stride - extra) : (k + 2) * c.stride + extra]
            q, a = overlap(question, passage), overlap(answer, passage)
            if q >= verify and a >= verify and (q + a, score) > found[d].get(i, (0, 0))[:2]:
                found[d][i] = (q + a, score, q, a, k * c.stride)
    return [[(index.ids[i], *v[1:]) for i, v in sorted(f.items())] for f in found]


def leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", least: float = 0.7, verify: float = 0.6, keep: list[str] | None = None, **options) -> DataFrame:
    """``df`` with ``leaks``: the test items that a document holds, from all its passages.

    A passage is reported for an item if its BM25 score reaches ``least`` of what
    the item's own text scores, and at least ``verify`` of the word 3-grams of both
    question and answer stand there.  Each leak has item (text), score, question,
    answer (shares) and word (where the passage starts).  A null text has none.
    """
    spark = df.sparkSession
    fields = [T.StructField("leaks", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType()), T.StructField("word", T.LongType())])))]
    out, scratch = None, Scratch(spark, "leaks")
    for index in build(items, item_col, **options):
        shared = spark.sparkContext.broadcast(index)

        def factory(shared=shared):
            index = shared.value
            memos = [Terms(c) for c in index.classes]

            def run(texts: list) -> list:
                got = leaks_of(index, [t or "" for t in texts], least, verify, memos)
                return [[[{"item": str(x[0]), "score": x[1], "question": x[2], "answer": x[3], "word": x[4]} for x in row] for row in got]]

            return run

        if out is None:
            out, last = append_columns(df, text_col, factory, fields, None if keep is None else [*keep, text_col]), shared
        else:  # more items than one index may hold: one index at a time
            out = scratch.keep(out, "leaks")
            last.destroy()
            last = shared
            out = append_columns(out.withColumnRenamed("leaks", "__more"), text_col, factory, fields).withColumn("leaks", F.concat("__more", "leaks")).drop("__more")
    if out is None:
        out = df.withColumn("leaks", F.array().cast(fields[0].dataType))
    return out if keep is None else out.select(*keep, "leaks")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    out = out.select("doc_id", F.explode("leaks").alias("x"))
    return out.select("doc_id", F.col("x.item").cast("long").alias("item_id"), "x.score", "x.question", "x.answer", "x.word")
