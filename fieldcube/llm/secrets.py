"""Secret scans: base patterns, and weak parts that count only near a part that completes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import documents, materialize

#: kind: (role of the part, pattern, group whose length counts, least length)
BASE = {
    "assign": ("secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("identifier", r"AKIA[A-Z0-9]+", 0, 20),
    "hex": ("secret", r"[0-9a-f]{24,}", 0, 24),  # the same as runs of hex digits that have 24 or more
}
WEAK = {
    "identifier": ("identifier", r"""(?i)(?:client|account|access|user|app|tenant|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 0, 1),
    "key": ("secret", r"""(?i)(?:key|pwd|pass|credential|bearer)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", 0, 1),
    "blob": ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{32,}", 0, 1),
    "endpoint": ("endpoint", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 1),
    "address": ("endpoint", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])", 0, 1),
}
ORDER = {kind: i for i, kind in enumerate([*BASE, *WEAK])}
#: Cheap tests that hold wherever the pattern can match.
WORDS = {"assign": ["password", "passwd", "secret", "token", "api_key", "apikey"], "key": ["key", "pwd", "pass", "credential", "bearer"]}


def _may(kind: str, text: Column) -> Column:
    if kind in WORDS:
        low = F.lower(text)
        found = [F.contains(low, F.lit(w)) for w in WORDS[kind]]
        may = found[0]
        for x in found[1:]:
            may = may | x
        return may
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    if kind == "endpoint":
        return F.contains(text, F.lit("://"))
    return text.rlike({"hex": "[0-9a-f]{24}", "identifier": "(?i)(?:id|name)[\"']?\\x20*[:=]", "blob": "[A-Za-z0-9+/_-]{32}", "address": r"[0-9]\.[0-9]"}[kind])


def _matches(kind: str, text: Column) -> Column:
    """(kind, i, gap, length, valid): each match, the gap before it and whether it is long enough.

    The pattern splits the text into the gaps, so positions follow by summing.
    """
    _, pattern, group, least = (BASE | WEAK)[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)

    def item(z: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["w"]).alias("length"), (F.length(z["p"]) >= least).alias("valid"))

    zipped = F.arrays_zip(whole.alias("w"), parts.alias("p"), F.slice(gaps, 1, F.size(whole)).alias("g"))
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,length:int,valid:boolean>>")
    return F.when(_may(kind, text), F.transform(zipped, item)).otherwise(none)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 300) -> DataFrame:
    """(id, key, kind, start, end, base): base spans, and weak parts that complete each other.

    Positions are code points, the end exclusive.  key: a hash of the text.  A weak
    part (an identifier, a secret or an endpoint) is reported if it lies outside
    all base spans and a complementary part - a secret for an identifier or an
    endpoint, either of those for a secret - starts within ``window`` code points.
    Base spans count as parts too.  Rows that repeat an id and a text count once.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), F.explode(F.concat(*[_matches(k, text) for k in ORDER])).alias("m"))
    rows = rows.select("id", "key", "m.*").dropDuplicates(["id", "key", "kind", "i"])
    so_far = Window.partitionBy("id", "key", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).withColumn("start", F.col("end") - F.col("length"))
    rows = rows.where("valid").select("id", "key", "kind", "start", "end", F.col("kind").isin(list(BASE)).alias("base"))
    roles = F.create_map(*[x for k, v in (BASE | WEAK).items() for x in (F.lit(k), F.lit(v[0]))])
    rows = materialize(rows.withColumn("role", roles[F.col("kind")]), "secret-parts")
    # Interval joins by buckets of the window's size within one text.
    weak = rows.where("not base").withColumn("bucket", F.floor(F.col("start") / window))
    cover = F.sequence(F.floor(F.col("start") / window), F.floor((F.col("end") - 1) / window))
    base = rows.where("base").select(F.col("id").alias("b_id"), F.col("key").alias("b_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.explode(cover).alias("b_bucket"))
    same = F.col("id").eqNullSafe(F.col("b_id")) & (F.col("key") == F.col("b_key")) & (F.col("bucket") == F.col("b_bucket"))
    weak = weak.join(base.hint("merge"), same & (F.col("start") >= F.col("b_start")) & (F.col("start") < F.col("b_end")), "left_anti")
    at = F.floor(F.col("start") / window)
    near = rows.select(F.col("id").alias("b_id"), F.col("key").alias("b_key"), F.col("start").alias("b_start"), F.col("role").alias("b_role"), F.explode(F.array(at - 1, at, at + 1)).alias("b_bucket"))
    complete = (F.col("role") == "secret") != (F.col("b_role") == "secret")
    weak = weak.join(near.hint("merge"), same & complete & (F.abs(F.col("start") - F.col("b_start")) <= window), "left_semi")
    return rows.where("base").unionByName(weak.drop("bucket")).drop("role")


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 300) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, found) for every row; found: the spans as an array.

    A null text is empty.  Rows that repeat an id and a text get the same result.
    """
    rank = F.create_map(*[x for k, i in ORDER.items() for x in (F.lit(k), F.lit(i))])
    found = spans(df, id_col, text_col, window).withColumn("rank", rank[F.col("kind")])
    by = found.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "base"))).alias("found"))
    by = by.withColumnsRenamed({"id": "f_id", "key": "f_key"})
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"))
    out = rows.join(by.hint("merge"), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left")
    out = out.withColumn("found", F.coalesce("found", F.array().cast(by.schema["found"].dataType)))
    counts = {f"n_{kind}": F.size(_of_kind(F.col("found"), kind)).cast("long") for kind in BASE}
    base = F.filter("found", lambda x: x["base"])
    return out.withColumns(counts | {"base_sha256": F.sha2(_joined(base), 256), "spans": _joined(F.col("found"))}).drop("f_id", "f_key")


def _of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: x["kind"] == kind)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 300, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``scan`` replaced by ``mark``; overlapping spans become one mark.

    Rows without spans stay as they are, null texts stay null.
    """
    found = spans(df, id_col, text_col, window)
    by = found.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__found")).withColumnsRenamed({"id": "__id", "key": "__key"})
    text = F.col(f"`{text_col}`")
    on = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__key"))
    out = df.join(by.hint("merge"), on, "left")
    zero = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("done"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["done"] + 1).cast("int"), F.greatest(x["start"] - s["done"], F.lit(0)).cast("int"))
        joined = F.when(x["start"] < s["done"], s["text"]).otherwise(F.concat(s["text"], gap, F.lit(mark)))
        return F.struct(joined.alias("text"), F.greatest(s["done"], x["end"]).alias("done"))

    cut = F.aggregate("__found", zero, step, lambda s: F.concat(s["text"], F.substring(text, (s["done"] + 1).cast("int"), F.length(text))))
    return out.withColumn(text_col, F.when(F.col("__found").isNull(), text).otherwise(cut)).select(*df.columns)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
