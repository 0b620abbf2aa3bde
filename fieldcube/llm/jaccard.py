"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections, connected groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Memo, Scratch, documents, lookup, sample_rows

#: Least bits of a signature; a large set has twice its size, rounded up to a power of two.
BITS = 1024
NGRAM = 5
#: Two documents link when 5 * intersection >= 4 * union, a similarity of 0.8.
PART, WHOLE = 4, 5
#: Rows of a block of a tile, and shingles of its sets: a task holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22
#: So many of a document's tiles tell where a pair has been met before.
FIRST = 32
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of the word 5-grams of a text (A-Z in lower case, ASCII white space between words).

    A text of one to four words has one shingle, all its words.
    """

    def __init__(self, limit: int = 500_000):
        self.table = np.empty(limit, np.uint64)
        self.memo = Memo(self._place, limit)

    def _place(self, word: bytes) -> int:
        at = len(self.memo)
        self.table[at] = xxhash.xxh64_intdigest(word)
        return at

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        pieces, limit = [], self.memo.limit
        for at in range(0, len(words), limit // 2):
            part = words[at : at + limit // 2]
            if len(self.memo) + len(part) > limit:
                self.memo.clear()
            pieces.append(self.table[list(map(self.memo.__getitem__, part))])
        h = np.concatenate(pieces)
        n = min(NGRAM, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * _M1 + h[k : len(h) - n + 1 + k]
        return np.unique(mix(out))


def prefix_size(n: int) -> int:
    """So many first shingles, in any common order, that two linked sets share one of them."""
    return n - (PART * n + WHOLE - 1) // WHOLE + 1 if n else 0


def short_prefix(n: int) -> int:
    """So many suffice for the smaller set of a linked pair: its overlap is at least 2 PART / (PART + WHOLE) of it."""
    return n + 1 + -2 * PART * n // (PART + WHOLE) if n else 0


def band_starts(most: int = 1 << 40) -> np.ndarray:
    """Least sizes of the bands: linked sets lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * WHOLE // PART + 1)
    return np.array(out)


def bitmap(s: np.ndarray) -> bytes:
    size = max(BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else BITS
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bitmaps: list[bytes], words: int | None = None) -> np.ndarray:
    """The signatures as rows of 64-bit words, all as wide as the narrowest (or ``words``): a wide one is folded by "or"."""
    words = words or min(map(len, bitmaps)) // 8
    out = np.empty((len(bitmaps), words), np.uint64)
    for k, b in enumerate(bitmaps):
        x = np.frombuffer(b, np.uint64)
        out[k] = x if len(x) == words else np.bitwise_or.reduce(x.reshape(-1, words), axis=0)
    return out


def _scan(df: DataFrame, id_col: str, text_col: str, schema: T.StructType, make) -> DataFrame:
    """mapInArrow over (id, text); ``make`` is called once a task and maps ids and texts to a dict of columns."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        f, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_pydict(f(part.column(0).to_pylist(), part.column(1).to_pylist()), schema=arrow)

    return src.mapInArrow(run, schema)


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def common_shingles(df: DataFrame, id_col: str, text_col: str, sample: int = 40_000, most: int = 300_000) -> np.ndarray:
    """At most ``most`` shingles that several documents of a bounded sample have, the commonest last.

    They only order the shingles (common ones last), so any choice gives the same
    links.  Without them prefixes hold the smallest hashes, so only those are counted.
    """
    rows = sample_rows(df.where(F.col(f"`{id_col}`").isNotNull()), id_col, sample)

    def make():
        s = Shingles()
        return lambda ids, texts: {"s": [x[: 5 + prefix_size(len(x)) * 5 // 4].view(np.int64) for x in map(s.of, texts)]}

    each = _scan(rows, id_col, text_col, _struct(s=T.ArrayType(T.LongType())), make)
    by = each.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n >= 3")
    got = by.orderBy(F.desc("n"), "s").limit(most).collect()
    return np.array([r.s for r in reversed(got)], np.int64).view(np.uint64)


def sketches(df: DataFrame, id_col: str, text_col: str, common: np.ndarray) -> DataFrame:
    """(id, n, class, bits, prefix, short, band, low): set size, a 128-bit hash of the set, its bitmap signature, its
    rarest shingles, how many of them suffice against larger sets, the band of its size, and whether it may link with the band below."""
    shared = df.sparkSession.sparkContext.broadcast(common)

    def make():
        s, common = Shingles(), shared.value
        order = np.argsort(common)
        known = common[order]

        def run(ids, texts):
            n, classes, bits, prefixes = [], [], [], []
            starts = band_starts()
            for t in texts:
                x = s.of(t)
                n.append(len(x))
                classes.append(xxhash.xxh128_digest(x.tobytes()))
                bits.append(bitmap(x))
                if len(known) and len(x):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[at] == x, order[at] + 1, 0)
                    x = x[np.argsort(rank, kind="stable")]
                prefixes.append(x[: prefix_size(len(x))].view(np.int64))
            size = np.array(n, np.int64)
            band = np.searchsorted(starts, size, "right") - 1
            low = (band > 0) & (PART * size <= WHOLE * (starts[band] - 1))
            return {"id": ids, "n": n, "class": classes, "bits": bits, "prefix": prefixes, "short": [short_prefix(x) for x in n], "band": band, "low": low}

        return run

    return _scan(df, id_col, text_col, _struct(id=T.LongType(), n=T.LongType(), **{"class": T.BinaryType()}, bits=T.BinaryType(), prefix=T.ArrayType(T.LongType()), short=T.LongType(), band=T.LongType(), low=T.BooleanType()), make)


def tiles(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(tile, doc, n, lead, lead_n): documents that share a prefix shingle and lie in one band of sizes.

    A document also stands in the tile of the band below, where it may link with
    documents of that band.  Tiles with the same members are one, and tiles in
    which the shingle is in no prefix that suffices against larger sets are none.
    lead: the smallest id of the tile's own band.
    """
    rows = reps.select(F.posexplode("prefix").alias("pos", "s"), F.col("id").alias("doc"), "n", "band", "low", "short")
    rows = rows.select("s", "doc", "n", "band", "low", (F.col("pos") < F.col("short")).alias("short"))
    again = scratch.keep(rows.groupBy("s").agg(F.count("*").alias("rows")).where("rows > 1").select("s"), "again")
    rows = scratch.keep(rows.join(again, "s", "left_semi"), "shared")
    rows = rows.withColumn("tile", F.explode(F.expr("if(low, array(band, band - 1), array(band))")))
    own = F.col("band") == F.col("tile")
    h = F.xxhash64("doc", "n", own)
    by = rows.groupBy("s", "tile").agg(
        F.count("*").alias("rows"),
        F.min(F.when(own, F.struct("doc", "n"))).alias("lead"),
        F.max("short").alias("some"),
        F.bit_xor(h).alias("x"),
        F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("y"),
    )
    by = by.where("rows > 1 and some and lead is not null").withColumn("name", F.xxhash64("x", "y", "rows", "lead.doc", "lead.n"))
    named = by.groupBy("name").agg(F.min(F.struct("s", "tile", "lead")).alias("one"))
    named = scratch.keep(named.select(F.col("one.s").alias("s"), F.col("one.tile").alias("tile"), "name", F.col("one.lead.doc").alias("lead"), F.col("one.lead.n").alias("lead_n")), "names")
    out = rows.join(named, ["s", "tile"]).select(F.col("name").alias("tile"), "doc", "n", "lead", "lead_n")
    out = scratch.keep(out, "tiles")
    scratch.drop("again", "shared", "names")
    return out


def membership_bits(ids: DataFrame, most: int = 1 << 28) -> np.ndarray:
    """A bit array with the bits of these ids' hashes set: 16 bits an id, and never more than ``most`` bits."""
    n = ids.count()
    size = min(most, max(1 << 16, 1 << (16 * max(1, n) - 1).bit_length()))
    at = F.pmod(F.xxhash64("doc"), F.lit(size))
    each = 32768
    by = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / each).alias("k")).agg(F.bitmap_construct_agg((F.col("at") % each)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in by.toLocalIterator():
        out[r.k * each // 8 : (r.k + 1) * each // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def texts_of(df: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(doc, text) of the documents with these ids, and by chance of a few others.

    Texts travel, not sets: a word is shorter than its shingle's hash and packs better.
    """
    bits = membership_bits(ids)
    shared, size = df.sparkSession.sparkContext.broadcast(bits), len(bits) * 8
    at = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long")), F.lit(size))
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"), at.alias("at"))

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(keep):
                yield batch.select(["doc", "text"]).take(pa.array(keep))

    return src.where(F.col("doc").isNotNull()).mapInArrow(run, _struct(doc=T.LongType(), text=T.StringType()))


def _overlap_bound(n_a, bits_a, n_b, bits_b) -> np.ndarray:
    """The largest overlap that sizes and signatures allow; a row of words each signature."""
    lone_a = np.bitwise_count(bits_a & ~bits_b).sum(-1, dtype=np.int64)
    lone_b = np.bitwise_count(bits_b & ~bits_a).sum(-1, dtype=np.int64)
    return np.minimum(n_a - lone_a, n_b - lone_b)


def possible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that a bound from the signatures (doc, n, bits) lets through.

    A bit that only one set has stands for at least one shingle that the other
    lacks, so the overlap is at most the set's size less the number of such bits.
    """
    pairs = pairs.join(signatures.toDF("a", "n_a", "bits_a"), "a").join(signatures.toDF("b", "n_b", "bits_b"), "b")
    schema = _struct(a=T.LongType(), b=T.LongType())

    def bounded(batches):
        for x in batches:
            if not x.num_rows:
                continue
            n = [x.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")]
            bits = [x.column(c).to_pylist() for c in ("bits_a", "bits_b")]
            words = np.array([min(len(p), len(q)) // 8 for p, q in zip(*bits, strict=True)])
            most = np.empty(x.num_rows, np.int64)
            for w in np.unique(words).tolist():
                at = np.flatnonzero(words == w)
                p, q = (folded([b[k] for k in at], w) for b in bits)
                most[at] = _overlap_bound(n[0][at], p, n[1][at], q)
            keep = pa.array(np.flatnonzero(WHOLE * most >= PART * (n[0] + n[1] - most)))
            yield pa.RecordBatch.from_arrays([x.column("a").take(keep), x.column("b").take(keep)], names=["a", "b"])

    return pairs.mapInArrow(bounded, schema).dropDuplicates()


def linked(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets link, by their exact intersection."""
    if len(p) > len(q):
        p, q = q, p
    common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
    return bool(common) and WHOLE * common >= PART * (len(p) + len(q) - common)


def verified(near: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; all b of one a are held against its set, those of a common a in several tasks."""
    per = near.groupBy("a").agg(F.ceil(F.count("*") / (BLOCK // 4 or 1)).cast("long").alias("k"))
    rows = near.join(per, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).alias("block"), F.lit(1).alias("role"), F.col("b").alias("doc"))
    leads = per.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("doc"))
    rows = rows.unionByName(leads).join(texts.hint("merge"), "doc").select("a", "block", "role", "doc", "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "role")
    schema = _struct(a=T.LongType(), b=T.LongType())

    def run(batches):
        key, lead, shingles = None, [], Shingles()
        for x in batches:
            got: list[list] = [[], []]
            cols = [x.column(i).to_pylist() for i in range(4)]
            for a, block, role, doc, text in zip(*cols, x.column(4), strict=True):
                s = shingles.of(text.as_py())
                if role == 0:
                    lead = [*lead, s] if key == (a, block) else [s]
                    key = a, block
                elif any(linked(p, s) for p in lead):
                    got[0].append(a)
                    got[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=schema.names)

    return rows.mapInArrow(run, schema).dropDuplicates()


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, component): the smallest id that each linked id reaches.

    Labels go to neighbours and jump to their own labels until none changes; each
    round is written to the shared folder, in place of the one before the last.
    """
    both = scratch.keep(links.union(links.select("b", "a")).toDF("doc", "other").distinct(), "both")
    now = scratch.keep(both.groupBy("doc").agg(F.least(F.col("doc"), F.min("other")).alias("component")), "round-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(now.toDF("other", "c"), "other").groupBy("doc").agg(F.min("c").alias("near"))
        new = now.join(near, "doc").select("doc", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = now.toDF("c", "up")
        new = new.join(jump, "c", "left").select("doc", "old", F.least(F.col("c"), F.coalesce("up", "c")).alias("component"))
        new = scratch.keep(new, f"round-{turn}")
        scratch.drop(f"round-{turn - 1}")
        if not new.where("component < old").limit(1).count():
            break
        now = new.select("doc", "component")
    out = scratch.keep(new.select("doc", "component"), "components")
    scratch.drop("both", f"round-{turn}")
    return out


def blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (tile, doc, n, group, ...) dealt to tasks: a column ``task``, and ``side`` (0 or 1, or 2 in both).

    A tile is cut into blocks of bounded size, a task gets two of them (or one
    twice).  Documents of a large group have blocks of their own, which are not
    held against each other, so a tile of one large group and a few others is
    no square.
    """
    size = lambda rows, n: F.greatest(F.ceil(rows / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("long")
    each = rows.groupBy("tile", "group").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    own = (F.col("rows") >= BLOCK) | (F.col("n") >= BLOCK_SHINGLES)
    grp = F.when(own, F.col("group")).otherwise(F.lit(0)).alias("grp")
    large = each.where(own).select("tile", "group")
    each = scratch.keep(each.groupBy("tile", own.alias("own"), grp).agg(size(F.sum("rows"), F.sum("n")).alias("k")), "blocks")
    rows = rows.join(large.withColumn("own", F.lit(True)), ["tile", "group"], "left")
    rows = rows.withColumn("own", F.coalesce("own", F.lit(False))).withColumn("grp", F.when(F.col("own"), F.col("group")).otherwise(F.lit(0)))
    rows = rows.join(each, ["tile", "own", "grp"]).withColumn("j", F.pmod(F.xxhash64("doc"), F.col("k")))
    one = each.select("tile", "own", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j")).select("tile", F.struct("own", "grp", "j").alias("at"))
    two = one.join(one.withColumnRenamed("at", "with"), "tile").where("at <= with and not (at.own and with.own and at.grp = with.grp)")
    two = two.withColumn("task", F.xxhash64("tile", "at", "with"))
    sides = F.expr("if(at = with, array(struct(at, 2 as side)), array(struct(at, 0 as side), struct(with as at, 1 as side)))")
    sides = two.select("tile", "task", F.explode(sides).alias("x")).select("tile", "task", "x.at.*", "x.side")
    return rows.join(sides, ["tile", "own", "grp", "j"]).drop("own", "grp", "j", "k")


def runs(batches, key: str):
    """Tables of the rows of one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        if not x.num_rows:
            continue
        k = x.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if held and held[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(x.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _met_before(tile: int, first: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the documents of left and right (a matrix) stand together in a tile of a smaller name, as far as ``first`` tells."""
    out = np.zeros((len(left), len(right)), bool)
    rows = np.repeat(np.arange(len(first)), [len(f) for f in first])
    names = np.concatenate(first) if len(rows) else np.zeros(0, np.int64)
    rows, names = rows[names < tile], names[names < tile]
    _, at, n = np.unique(names, return_inverse=True, return_counts=True)
    use = n > 1
    to = np.cumsum(use) - 1
    rows, at = rows[use[at]], to[at[use[at]]]
    for low in range(0, int(use.sum()), 4096):
        now = (at >= low) & (at < low + 4096)
        inside = np.zeros((len(first), min(4096, int(use.sum()) - low)), np.float32)
        inside[rows[now], at[now] - low] = 1
        out |= inside[left] @ inside[right].T > 0
    return out


def _candidates(x: pa.Table, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in the rows of one task whose documents may link and are met here first, the likeliest first."""
    n, group, side, doc = (x.column(c).to_numpy() for c in ("n", "group", "side", "doc"))
    first = [np.asarray(f, np.int64) for f in x.column("first").to_pylist()]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    ok = (group[left][:, None] != group[right]) & (doc[left][:, None] != doc[right])
    if side[0] == 2:
        ok &= left[:, None] < right
    ok &= WHOLE * np.minimum(n[left][:, None], n[right]) >= PART * np.maximum(n[left][:, None], n[right])
    if ok.any():
        ok &= ~_met_before(x.column("tile")[0].as_py(), first, left, right)
    i, j = (f[k] for f, k in zip((left, right), np.nonzero(ok), strict=True))
    step = max(1, (1 << 20) // bits.shape[1])
    most = np.concatenate([np.zeros(0, np.int64), *(_overlap_bound(n[i[k : k + step]], bits[i[k : k + step]], n[j[k : k + step]], bits[j[k : k + step]]) for k in range(0, len(i), step))])
    keep = np.flatnonzero(WHOLE * most >= PART * (n[i] + n[j] - most))
    keep = keep[np.argsort(-most[keep] / (n[i[keep]] + n[j[keep]]), kind="stable")]
    return i[keep], j[keep]


_TASK = {"task": T.LongType(), "side": T.IntegerType(), "tile": T.LongType(), "doc": T.LongType(), "n": T.LongType(), "group": T.LongType(), "first": T.ArrayType(T.LongType())}


def needed(rows: DataFrame) -> DataFrame:
    """The rows of each task whose document may link with one of another group in the same task, by sizes and signatures."""
    schema = _struct(**_TASK)

    def run(batches):
        for x in runs(batches, "task"):
            i, j = _candidates(x, folded(x.column("bits").to_pylist()))
            if len(i):
                yield from x.select(schema.names).take(pa.array(np.union1d(i, j))).to_batches()

    # A fixed number: the work of a tile is more than its bytes tell, so tasks are not merged.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*schema.names, "bits").repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, schema)


def joining(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join groups, from rows with their texts: every candidate pair of a task is held against each
    other, unless links that this worker has found have joined their groups already.  So at most one link a group comes out of a worker."""
    schema = _struct(a=T.LongType(), b=T.LongType())

    def run(batches):
        up: dict[int, int] = {}
        shingles = Shingles()

        def top(g: int) -> int:
            while (h := up.get(g, g)) != g:
                up[g] = g = up.get(h, h)
            return g

        for x in runs(batches, "task"):
            sets = [shingles.of(t.as_py()) for c in x.column("text").chunks for t in c]
            doc, group = x.column("doc").to_pylist(), x.column("group").to_pylist()
            got: list[list] = [[], []]
            i, j = _candidates(x, folded([bitmap(s) for s in sets]))
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                g, h = top(group[a]), top(group[b])
                if g != h and linked(sets[a], sets[b]):
                    up[max(g, h)] = min(g, h)
                    got[0].append(min(doc[a], doc[b]))
                    got[1].append(max(doc[a], doc[b]))
            if got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=schema.names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*_TASK, "text").repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, schema).dropDuplicates()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row; links need a Jaccard similarity of 0.8 of word 5-gram sets.

    Documents with equal sets are one class, joined by its smallest id.  Classes
    meet in tiles: a rare prefix shingle and a band of sizes.  In each tile all are
    first held against the smallest id.  Where that leaves several groups, every
    pair of different groups whose sizes and signatures allow a link is compared
    inside the task that holds the tile (or two blocks of it), once among all
    tiles that hold both; only links that join groups come out.  So components are
    whole; links within a group are not all tried.  A null or empty text
    has no shingles and is alone; a row without an id is in no group (null).  Rows
    that repeat an id count as one document.  Ids are integers.
    """
    scratch = Scratch(df.sparkSession, "jaccard")
    rows = scratch.keep(sketches(df, id_col, text_col, common_shingles(df, id_col, text_col)), "sketches")
    classes = rows.where("n > 0 and id is not null").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    classes = scratch.keep(classes, "classes")
    reps = rows.join(classes.select("class", F.col("rep").alias("id")), ["class", "id"], "left_semi").dropDuplicates(["class", "id"])
    reps = scratch.keep(reps.drop("class"), "reps")
    rows = scratch.keep(rows.select("id", "n", "class"), "slim")
    scratch.drop("sketches")
    again = rows.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count() > 0
    signatures = reps.select(F.col("id").alias("doc"), "n", "bits")
    met = tiles(reps, scratch)

    def texts(ids: DataFrame) -> DataFrame:
        got = texts_of(df, id_col, text_col, ids.distinct())
        return got.dropDuplicates() if again else got

    star = met.where((F.col("doc") != F.col("lead")) & (WHOLE * F.least("n", "lead_n") >= PART * F.greatest("n", "lead_n")))
    star = star.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    near = scratch.keep(possible(star, signatures), "near")
    links = scratch.keep(verified(near, texts(near.select(F.explode(F.array("a", "b")).alias("doc")))), "links")
    scratch.drop("near")
    found = connected(links, scratch)
    grouped = met.join(found, "doc", "left").select("tile", "doc", "n", F.coalesce("component", "doc").alias("group"))
    several = grouped.groupBy("tile").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("tile")
    several = scratch.keep(several, "several")
    mixed = scratch.keep(grouped.join(several, "tile", "left_semi"), "mixed")
    scratch.drop("tiles", "several")
    first = mixed.groupBy("doc").agg(F.slice(F.array_sort(F.collect_set("tile")), 1, FIRST).alias("first"))
    tasks = blocks(mixed, scratch).join(first, "doc").join(signatures, ["doc", "n"])
    tasks = scratch.keep(needed(tasks), "tasks")
    scratch.drop("mixed", "blocks", "reps")
    if tasks.limit(1).count():
        more = scratch.keep(joining(tasks.join(texts(tasks.select("doc")).hint("merge"), "doc")), "more")
        found = connected(links.union(more), scratch)
        scratch.drop("more")
    scratch.drop("tasks", "links")
    named = classes.join(found.withColumnRenamed("doc", "rep"), "rep", "left")
    named = scratch.keep(named.select("class", F.coalesce("component", "rep").alias("component_id"), "rows"), "named")
    total = rows.count()
    whole = lookup(rows.where("n > 0 and id is not null").select("id", "n", "class"), named, "class", "component_id", "rows", total)
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    alone = alone.withColumn("component_id", F.when(F.col("n") == 0, F.col("id")))
    out = whole.select("id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
    out = scratch.keep(out, "groups")
    scratch.drop("slim", "classes", "components", "named")
    return out


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the document of the smallest id of each group; of rows that repeat an id one stays.

    Rows without an id stay.
    """
    found = groups(df, id_col, text_col)
    ids = found.where("id is not null").groupBy("id").agg(F.count("*").alias("rows"), F.min("component_id").alias("c"))
    key = F.col(f"`{id_col}`") == F.col("__id")
    rest = df.join(ids.where("id != c or rows > 1").select(F.col("id").alias("__id")), key, "left_anti")
    again = df.join(ids.where("id = c and rows > 1").select(F.col("id").alias("__id")), key, "left_semi")
    return rest.unionByName(again.dropDuplicates([id_col]))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
