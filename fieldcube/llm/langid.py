"""Language identification by words first, backing off to character n-grams."""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Memo, append_columns, documents, materialize, sample_rows

#: Words, by one rule in training and in use.
WORD = r"\p{L}+"
LETTERS = regex.compile(WORD)
UND = "und"


class BackoffModel:
    """Log frequencies by language of words and of character n-grams of order 4 to 1."""

    def __init__(self, langs: list[str], words: dict[str, list[float]], grams: dict[str, list[float]], order: int):
        self.langs, self.words, self.grams, self.order = langs, words, grams, order

    def word_score(self, word: str) -> list[float]:
        """A known word's log frequencies; else the mean over its longest known n-grams."""
        known = self.words.get(word)
        if known is not None:
            return known
        padded = f"^{word}$"
        for n in range(self.order, 0, -1):
            hits = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i : i + n])) is not None]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits, strict=True)]
        return [0.0] * len(self.langs)


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 20_000,
    order: int = 4,
    smoothing: float = 0.1,
    least_count: int = 2,
) -> BackoffModel:
    """Count words and n-grams by language over at most about ``max_rows`` labelled rows.

    Rows whose text or language is null are left out.  Without any row the model
    knows no language.  A word is known if these rows have it ``least_count`` times;
    all n-grams are.  ``max_rows`` is what bounds the model.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = sample_rows(rows.where("text is not null and lang is not null"), "id", max_rows)
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word")
    counts = materialize(rows.select("lang", word).groupBy("lang", "word").agg(F.count("*").alias("n")), "langid-words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return BackoffModel([], {}, {}, order)

    def all_of(df: DataFrame, least: int) -> tuple[list[str], np.ndarray]:
        """Keys that occur ``least`` times, and their counts by language."""
        by = df.groupBy("key").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)])
        got = by.where(sum((F.col(f"n{i}") for i in range(len(langs))), F.lit(0)) >= least).toArrow()
        return got.column(0).to_pylist(), np.stack([got.column(1 + i).to_numpy() for i in range(len(langs))], 1)

    words, by_word = all_of(counts.select(F.col("word").alias("key"), "lang", "n"), least_count)
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def cut(n: int):
        at = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        return F.when(F.length(padded) >= n, F.transform(at, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    pieces = F.flatten(F.array(*[cut(n) for n in range(1, order + 1)]))
    grams, by_gram = all_of(counts.select(F.explode(pieces).alias("key"), "lang", "n").groupBy("key", "lang").agg(F.sum("n").alias("n")), 1)

    def logs(keys: list[str], by: np.ndarray) -> dict[str, list[float]]:
        return dict(zip(keys, np.log((by + smoothing) / (by.sum(0) + smoothing * len(keys))).tolist(), strict=True)) if keys else {}

    lengths = np.array([len(g) for g in grams])
    scored: dict[str, list[float]] = {}
    for n in range(1, order + 1):
        at = np.flatnonzero(lengths == n)
        scored |= logs([grams[k] for k in at], by_gram[at])
    return BackoffModel(langs, logs(words, by_word), scored, order)


def identify(df: DataFrame, model: BackoffModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the posterior of that language, 0 to 1).

    A null text, one without letters, or a model without languages gives ``und``
    with score 0.  Ties go to the language that sorts first.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value
        limit = 300_000
        rows = np.zeros((limit, max(1, len(m.langs))))

        def place(word: str) -> int:
            rows[(at := len(memo))] = m.word_score(word)
            return at

        memo = Memo(place, limit)

        def predict(texts: list) -> list:
            langs, scores = [], []
            for text in texts:
                counts = Counter(LETTERS.findall(text.lower())) if text and m.langs else None
                if not counts:
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                if len(memo) + len(counts) > limit:  # rows of one text stay in place together
                    memo.clear()
                if len(counts) <= limit:
                    total = np.fromiter(counts.values(), float, len(counts)) @ rows[[memo[w] for w in counts]]
                else:
                    total = sum(n * np.array(m.word_score(w)) for w, n in counts.items())
                best = int(np.argmax(total))
                langs.append(m.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            return [langs, scores]

        return predict

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(df, text_col, factory, fields, keep)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
