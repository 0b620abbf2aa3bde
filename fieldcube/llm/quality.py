"""Quality rules: base counts of a text, and lines that many documents of a host share, with the text without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import documents, materialize

SPACE = r"[\x20\x09-\x0D]+"
#: A line in more documents of its host than this is frequent.
MAX_DOCS = 3


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null or empty text has none of anything, and fails.  Words of a repeated
    three-word window count once each, the first occurrence included.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__words": F.filter(F.split(text, SPACE, -1), lambda w: w != ""), "__lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    )
    df = df.withColumn("n_repeat_words", _repeat_words(df, F.col("__words")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__words", "__lines")


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _repeat_words(df: DataFrame, words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more, each once.

    A window is one long: its hash, and in the low bits, as many as the text needs,
    its position.  Sorted, equal windows stand together in the order of their
    positions.  Where windows of one hash differ, which neighbours show, that text's
    windows are sorted by their words instead, so the count is exact.
    """
    n = F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    bits = F.length(F.bin(n)).cast("int")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    keys = F.transform(at, lambda i: _hash(words, i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    packed = F.struct(low.alias("low"), F.sort_array(keys).alias("keys"))
    return _let(packed, lambda x: _covered_of(words, at, x["low"], x["keys"]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not for each element of the lambdas that use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered_of(words: Column, at: Column, low: Column, keys: Column) -> Column:
    def place(k: Column) -> Column:
        return k.bitwiseAND(low).cast("int")

    def hashed_alike(a: Column, b: Column) -> Column:
        return a.bitwiseOR(low) == b.bitwiseOR(low)

    def same(a: Column, b: Column) -> Column:
        i, j = place(a), place(b)
        return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    clash = F.exists(F.transform(keys, lambda k, i: (i > 0) & hashed_alike(k, F.get(keys, F.greatest(i - 1, F.lit(0)))) & ~same(k, F.get(keys, F.greatest(i - 1, F.lit(0))))), lambda x: x)
    twice = F.filter(keys, lambda k, i: ((i > 0) & hashed_alike(k, F.get(keys, F.greatest(i - 1, F.lit(0))))) | ((i + 1 < F.size(keys)) & hashed_alike(k, F.get(keys, i + 1))))
    fast = _covered(F.transform(twice, place))
    return F.when(clash, _covered(_by_words(words, at))).otherwise(fast)


def _by_words(words: Column, at: Column) -> Column:
    """Positions of repeated windows, by sorting the windows themselves."""
    windows = F.transform(at, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))

    def alike(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def repeated(whole: Column) -> Column:
        hit = F.filter(whole, lambda x, k: ((k > 0) & alike(x, F.get(whole, F.greatest(k - 1, F.lit(0))))) | ((k + 1 < F.size(whole)) & alike(x, F.get(whole, k + 1))))
        return F.transform(hit, lambda x: x["i"])

    return _let(F.array_sort(windows), repeated)


def _covered(places: Column) -> Column:
    """Words in the three-word windows that start at these places."""

    def count(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    return _let(F.sort_array(places), count)


def normalized(line: Column) -> Column:
    """A line in lower case, its digits as 0, its white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), SPACE, " "))


def line_hashes(text: Column) -> Column:
    """Distinct hashes of the normalised lines that are not blank, each with the words it covers in the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normalized(x)).alias("line"), F.size(F.filter(F.split(x, SPACE, -1), lambda w: w != "")).alias("words")))


def lines_of(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, key, at, line, words): each line that is not blank; key: a hash of the text.  A null host is a host of its own ("")."""
    text = F.col(f"`{text_col}`")
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), F.xxhash64(text).alias("key"), F.posexplode(line_hashes(text)).alias("at", "x"))
    return rows.select("id", "host", "key", "at", "x.line", "x.words")


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, docs): lines of ``lines_of`` in more than ``max_docs`` documents of a host.

    An absolute limit, so it means the same on a table of any size.  docs counts
    different ids; a null one does not count.
    """
    return lines.groupBy("host", "line").agg(F.count_distinct("id").alias("docs")).where(F.col("docs") > max_docs)


def depleted(lines: DataFrame, often: DataFrame) -> DataFrame:
    """(id, key, removed_words, lines): words on frequent lines and these lines' hashes, for documents that have such lines.

    One line may stand in a third of all documents.  Lines of at least a thousandth
    of all rows - a thousand at most - are looked up by a broadcast, the others by
    a shuffle.
    """
    cut = F.lit(max(1, lines.count() // 1000))
    hot = often.where(F.col("docs") >= cut).select("host", "line")
    rest = often.where(F.col("docs") < cut).select("host", "line")
    rows = lines.join(F.broadcast(hot), ["host", "line"], "left_semi").unionByName(lines.join(rest, ["host", "line"], "left_semi"))
    # Repeated rows (same id and text) bring each line several times: the sum is divided by that.
    words = F.sum("words") * F.size(F.collect_set("at")) / F.count("*")
    return rows.groupBy("id", "key").agg(words.cast("long").alias("removed_words"), F.collect_set("line").alias("lines"))


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines that have these hashes; blank lines stay."""
    lines = F.split(text, "\n", -1)
    stays = F.filter(lines, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains(hashes, F.xxhash64(normalized(x))))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(stays, "\n"))


def rate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_removed: float = 0.5) -> DataFrame:
    """Per row: the id, the base counts, removed_words, kept and clean_text, the text without frequent lines.

    Kept: the base rules hold and frequent lines, those of more than ``max_docs``
    documents of a host, have no more than ``max_removed`` of the words.  Rows with
    the same id and text are copies of one document and get the same verdict; a
    null or empty text fails.
    """
    src = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__t"), F.xxhash64(f"`{text_col}`").alias("__key"))
    base = base_counts(src, "__t")
    lines = materialize(lines_of(df, id_col, text_col, host_col), "quality-lines")
    hit = depleted(lines, frequent_lines(lines, max_docs))
    joined = base.join(hit, base[id_col].eqNullSafe(hit["id"]) & (base["__key"] == hit["key"]), "left").drop("id", "key", "__key")
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (removed <= max_removed * F.col("n_words"))
    joined = joined.withColumn("removed_words", removed).withColumn("kept", kept)
    return joined.withColumn("clean_text", without_lines(F.col("__t"), F.col("lines"))).drop("__t", "lines")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    out = rate(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
